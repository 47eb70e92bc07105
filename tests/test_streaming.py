"""Changes in files, taken one by one."""

import pytest

from seasonframe.operators.change_table import ChangeTable
from seasonframe.streaming.change_stream import apply_stream, start_table

SCHEMA = "id int, owner int, actor int, v string, seq int, deleted boolean"


def test_changes_take_effect_once(spark, tmp_path):
    table, log = str(tmp_path / "table"), str(tmp_path / "log")
    start_table(spark.createDataFrame([(1, 7, "a"), (2, 8, "b")], "id int, owner int, v string"), table, parts=2)
    for k, row in enumerate([(1, 7, 7, "A", 1, False), (2, 7, 7, "stolen", 2, False), (1, 7, 7, None, 3, True)]):
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").json(log)
        stream = spark.readStream.schema(SCHEMA).json(log)
        apply_stream(stream, table, str(tmp_path / "checkpoint"), once=True).awaitTermination()
        rows = sorted((r["id"], r["v"]) for r in ChangeTable(spark, table).read().collect())
        assert rows == [[(1, "A"), (2, "b")], [(1, "A"), (2, "b")], [(2, "b")]][k]
    assert spark.read.parquet(f"{table}/rejected").first()["v"] == "stolen"


@pytest.mark.parametrize("fresh", [False, True])
def test_late_files_and_new_checkpoints(spark, tmp_path, fresh):
    """A newer change in an earlier file stands; a checkpoint that starts anew runs the whole log again, without effect."""
    table, log = str(tmp_path / "table"), str(tmp_path / "log")
    start_table(spark.createDataFrame([(1, 7, "a")], "id int, owner int, v string"), table, parts=2)
    for k, rows in enumerate([[(1, 7, 7, "newest", 5, False)], [(1, 7, 7, "old", 1, False), (None, 7, 7, "added", 2, False)]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(log)
        stream = spark.readStream.schema(SCHEMA).json(log)
        apply_stream(stream, table, str(tmp_path / (f"checkpoint{k}" if fresh else "checkpoint")), once=True).awaitTermination()
    assert sorted((r["id"], r["v"]) for r in ChangeTable(spark, table).read().collect()) == [(1, "newest"), (2, "added")]
