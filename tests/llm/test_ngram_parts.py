"""Two components joined by one link are not verified pair by pair."""

from pyspark.sql import functions as F

from lakeloom.llm import ngram_join


def test_likeliest_pair_of_two_parts_goes_first(spark, monkeypatch):
    """A set near all of a group meets one of it, a set that links with none of it meets them all."""
    words = [f"w{i}" for i in range(200)]
    group = [" ".join([*words, f"end{i}"]) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate([*group, " ".join([*words, "near", "it"]), " ".join([*words[:120], *[f"o{i}" for i in range(80)]])])), "doc_id long, text string")
    own = ngram_join._sets(docs, 6).where("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("lo").alias("key"), "hi").cache()
    key = {r.doc_id: r.key for r in own.collect()}
    part = min(key[i] for i in range(20))
    rows = [(min(key[i], key[x]), max(key[i], key[x]), min(part, key[x]), max(part, key[x]), 0.1 + i / 100) for i in range(20) for x in (20, 21)]
    met, verify = [], ngram_join._verify
    monkeypatch.setattr(ngram_join, "_verify", lambda pairs, sets: met.extend((r.a, r.b) for r in pairs.collect()) or verify(pairs, sets))
    links = ngram_join._by_parts(docs, own, spark.createDataFrame(rows, "a long, b long, pa long, pb long, apart double"))[2]
    assert [(r.a, r.b) for r in links.collect()] == [tuple(sorted((key[0], key[20])))]
    assert len(met) == len(set(met)) == 1 + 20
