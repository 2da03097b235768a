"""History folded by key: as one batch would give it, rerun without new files, and with new ones."""

from pyspark.sql import functions as F

from lakeloom.operators.memory import current_state
from lakeloom.streaming.history import fold_history_by_key

SCHEMA = "id long, memory_id long, event string, new_memory string, created_at timestamp"


def test_by_key_equals_one_batch(spark, tmp_path):
    rows = [(i, None if i % 11 == 5 else i % 5, "DELETE" if i % 7 == 0 else "ADD", f"v{i}") for i in range(60)]
    h = spark.createDataFrame([*rows, rows[3]], "id long, memory_id long, event string, new_memory string").withColumn("created_at", F.timestamp_seconds("id"))
    h.where("id < 40").repartitionByRange(2, "id").write.parquet(str(tmp_path / "in"))
    fold = lambda: {(r.memory_id, r.id) for r in fold_history_by_key(spark, str(tmp_path / "in"), SCHEMA, str(tmp_path / "cp"), str(tmp_path / "state"), 4).collect()}
    want = lambda df: {(r.memory_id, r.id) for r in current_state(df.where("memory_id IS NOT NULL")).collect()}
    assert fold() == want(h.where("id < 40")) == fold()
    h.where("id >= 40").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert fold() == want(h)
    assert len([p for p in (tmp_path / "state" / "manifest").iterdir() if p.name.startswith("v=")]) == 2
