"""A stream of user changes against a table of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.change_table import ChangeTable


def start_table(rows: DataFrame, folder: str, **names) -> ChangeTable:
    """Write the rows that the stream finds; ``names`` as in ``change_table.Names``."""
    return ChangeTable.create(rows, folder, **names)


def apply_stream(changes: DataFrame, folder: str, checkpoint: str, once: bool = False, keep: int = 2) -> StreamingQuery:
    """Apply each micro-batch to the table in ``folder``.

    Batch numbers play no part: a batch that is run again, after a failure or under a new checkpoint, finds its changes in
    the table and changes nothing. The last ``keep`` versions stay readable.
    """

    def apply(batch: DataFrame, n: int) -> None:
        table = ChangeTable(batch.sparkSession, folder)
        table.apply(batch)
        table.clear(keep)

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
