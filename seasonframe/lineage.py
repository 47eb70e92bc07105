"""Frames that are written before they are read again."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows of two numbers that are sent to all tasks.
SENT_PAIRS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local session that names none gets a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR"))
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def materialized(df: DataFrame) -> DataFrame:
    """Written to the folder that all executors share and read back, so that a lost executor costs no recomputation.

    For frames whose partitions a second run could deal out differently (ranges), and for loops, whose lineage
    would grow.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *columns: str, rows: int = 250_000) -> DataFrame:
    """Rows dealt out anew to tasks of about ``rows`` each, by columns or, without any, by their position.

    A table may be one file of one row group, which one task reads whatever its size; from here on its rows are in as many
    tasks as their number asks for. They are counted first.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(tasks, *(columns or [F.monotonically_increasing_id()]))


def sent_pairs(rows: DataFrame) -> DataFrame:
    """Rows of two numbers, to be sent to all tasks if they are few; they are counted."""
    return F.broadcast(rows) if rows.count() <= SENT_PAIRS else rows


def number_rows(df: DataFrame, order: list[str], output: str) -> DataFrame:
    """Numbers from 1 in order, without gaps: sorted ranges are counted, and each starts where the last one ended.

    Only one count a partition reaches the driver.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__k", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    ranged = materialized(ranged)  # a second run could cut the ranges elsewhere
    starts, total = [], 1
    for r in sorted(ranged.groupBy("__p").agg(F.count("*").alias("n")).collect()):
        starts.append((r["__p"], total))
        total += r["n"]
    offsets = df.sparkSession.createDataFrame(starts or [(0, 1)], "__p int, __s long")
    return ranged.join(F.broadcast(offsets), "__p").withColumn(output, F.col("__s") + F.col("__k")).drop("__p", "__k", "__s")


def number_within(df: DataFrame, group: list[str], order: list[Column], output: str) -> DataFrame:
    """Numbers from 1 in order within each group, without gaps; a group of any size is spread over many tasks.

    Rows are sorted by ranges of group and order. A group that a range cuts goes on from the last range's count: the
    driver sees two groups and their counts a partition at most.
    """
    names = [f"__o{k}" for k in range(len(order))]
    keyed = df.select("*", *[o.alias(n) for o, n in zip(order, names, strict=True)])
    ranged = keyed.repartitionByRange(*group, *names).sortWithinPartitions(*group, *names)
    ranged = materialized(ranged.withColumn("__p", F.spark_partition_id()).withColumn("__k", F.monotonically_increasing_id()))
    counts = ranged.groupBy("__p", *group).agg(F.count("*").alias("n"), F.min("__k").alias("__first"))
    # the last group of a range, the first one of the next
    ends = counts.groupBy("__p").agg(F.min(F.struct("__first", "n", *group)).alias("a"), F.max(F.struct("__first", "n", *group)).alias("b")).orderBy("__p").collect()
    starts, last, held = [], None, 0
    for r in ends:
        a, b = tuple(r["a"])[2:], tuple(r["b"])[2:]
        same = a == last
        if same:
            starts.append((r["__p"], *a, held))
        held = r["b"]["n"] + (held if same and a == b else 0)
        last = b
    kinds = [ranged.schema[g].dataType for g in group]
    schema = T.StructType([T.StructField("__p", T.IntegerType()), *[T.StructField(f"__g{k}", t) for k, t in enumerate(kinds)], T.StructField("__s", T.LongType())])
    carried = F.broadcast(df.sparkSession.createDataFrame(starts, schema))  # one row a partition at most
    same = [F.col(g).eqNullSafe(F.col(f"__g{k}")) for k, g in enumerate(group)]
    within = ranged.withColumn("__n", F.row_number().over(Window.partitionBy("__p", *group).orderBy("__k"))).withColumnRenamed("__p", "__part")
    out = within.join(carried, reduce(lambda x, y: x & y, same, F.col("__part") == F.col("__p")), "left").withColumn(output, F.col("__n") + F.coalesce("__s", F.lit(0)))
    return out.select(*[c for c in df.columns if c != output], output)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Within, the session has a setting; after, what it had before."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shuffles_released(spark: SparkSession) -> AbstractContextManager[None]:
    """Within, what a job shuffled is removed when it ends; else it stays until the driver happens to collect garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def written(df: DataFrame, path: str, by: list[str] | None = None, codec: str = "snappy") -> DataFrame:
    """Written as Parquet to ``path``, which takes the place of what is there, and read back with the same types."""
    writer = df.write.mode("overwrite").option("compression", codec)
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that the library wrote; one that isn't there is no error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
