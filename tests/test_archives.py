"""Archives with members that lead out, damaged ones, and what is no archive."""

import io
import tarfile
import zipfile

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException

from lakeloom.sources.readers import archive_members, expand_archives


def _zip(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, blob in members:
            z.writestr(name, blob)
    return out.getvalue()


def _tar(members, mode="w"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, blob in members:
            info = tarfile.TarInfo(name)
            info.size = len(blob)
            t.addfile(info, io.BytesIO(blob))
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(link)
    return out.getvalue()


def test_members_faults_and_broken_archives(spark):
    good = [("a.txt", b"one"), ("d/b.txt", b""), ("a.txt", b"again")]
    bad = [("../x", b"1"), ("/etc/x", b"2"), ("c:\\x", b"3"), ("a\\..\\x", b"4"), ("d/../../x", b"5")]
    damaged = bytearray(_zip([("a.txt", b"hello hello"), ("b.txt", b"fine")]))
    damaged[damaged.index(b"hello")] ^= 1
    cut = _tar([("first", b"x" * 700), ("second", b"y" * 5000)], "w")[:2600]
    files = {"zip": _zip([*good[:2], *bad, ("d/", b"")]), "tar": _tar(good + bad[:2], "w:xz"), "damaged": bytes(damaged), "cut": cut, "none": b"no archive", "empty": b"", "null": None, "bare": _zip([])}
    df = spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in files.items()], "path string, content binary")
    rows = {}
    for r in archive_members(df).collect():
        rows.setdefault(r.archive, []).append((r.name, None if r.content is None else bytes(r.content), r.fault))
    assert rows["zip"] == [(n, b, None) for n, b in good[:2]] + [(n, None, "outside") for n, _ in bad]
    assert rows["tar"] == [(n, b, None) for n, b in good] + [(n, None, "outside") for n, _ in bad[:2]]
    assert rows["damaged"][0][:2] == ("a.txt", None) and "CRC" in rows["damaged"][0][2] and rows["damaged"][1] == ("b.txt", b"fine", None)
    assert rows["cut"][0] == ("first", b"x" * 700, None) and rows["cut"][-1][1] is None and rows["cut"][-1][2]
    for k in ("none", "empty", "null"):
        assert len(rows[k]) == 1 and rows[k][0][:2] == (None, None) and rows[k][0][2]
    assert "bare" not in rows
    assert expand_archives(df.where("path IN ('zip', 'tar')")).count() == 5
    with pytest.raises(PySparkException, match="not a|ReadError|empty"):
        expand_archives(df.where("path = 'none'")).count()


def test_members_are_sent_together(spark):
    """2500 small members and four large ones come in a few batches, not one each."""
    big = bytes(3 << 20)
    df = spark.createDataFrame([("small", bytearray(_zip([(f"{i}.txt", b"%d" % i) for i in range(2500)]))), ("big", bytearray(_zip([(f"{i}", big) for i in range(4)])))], "path string, content binary").coalesce(1)
    one_each = lambda it: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in it)
    assert archive_members(df).mapInArrow(one_each, "n long").count() <= 5
    assert sorted(int(r.content) for r in archive_members(df).where("archive = 'small'").collect()) == list(range(2500))
