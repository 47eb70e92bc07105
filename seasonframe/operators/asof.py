"""As-of lookups: the last breakpoint at or before a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ..functions.dims import FIRST_PATENT_YEAR, FIRST_PATENTS
from ..functions.fields import patent_expiry_seconds
from ..lineage import materialized

#: Breakpoint tables up to this many rows are constants of a search tree; up to the next, a broadcast of intervals;
#: longer ones are merged by one sort.
TREE_LIMIT = 128
INTERVAL_LIMIT = 1000


def asof_tree(key: Column, starts: list, values: list) -> Column:
    """The value of the last start <= key; the first value below the first start; null for a null key.

    A binary search over constants, as nested conditions that are compiled: no join and no shuffle.
    """

    def found(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(values[lo])
        middle = (lo + hi) // 2
        return F.when(key < F.lit(starts[middle]), found(lo, middle)).otherwise(found(middle, hi))

    return F.when(key.isNotNull(), found(0, len(starts)))


def _asof_intervals(df: DataFrame, key: str, rows: list[tuple], kinds: tuple[DataType, DataType], output: str) -> DataFrame:
    """Join with the intervals between breakpoints; the first reaches down, the last up without end."""
    bounds = [None, *(r[0] for r in rows[1:]), None]
    schema = StructType([StructField("__lo", kinds[0]), StructField("__hi", kinds[0]), StructField("__v", kinds[1])])
    intervals = F.broadcast(df.sparkSession.createDataFrame([(bounds[k], bounds[k + 1], r[1]) for k, r in enumerate(rows)], schema))
    inside = F.col(key).isNotNull() & (F.col("__lo").isNull() | (F.col(key) >= F.col("__lo"))) & (F.col("__hi").isNull() | (F.col(key) < F.col("__hi")))
    return df.join(intervals, inside, "left").withColumn(output, F.col("__v")).drop("__lo", "__hi", "__v")


def asof_lookup(df: DataFrame, key: str, breakpoints: DataFrame, start: str, value: str, output: str, by: list[str] | None = None) -> DataFrame:
    """Add ``output``: the value of the last breakpoint at or before the key, the first one's below it.

    A short table without groups is read to the driver, its count checked, and searched in each row. Another one is
    merged by one sort: rows and breakpoints go by ranges of group and key to the partitions, the last breakpoint of
    each partition is carried to the next ones as one row a partition, so that no group has to fit in one task. Rows with
    a null in ``by`` are a group like any other, and take the breakpoints that have the null too.

    Only a number of each row, its group and its key are sorted; the rows meet their value by that number.
    """
    kind = breakpoints.schema[value].dataType
    if not by:
        head = breakpoints.select(start, value).filter(F.col(start).isNotNull()).limit(INTERVAL_LIMIT + 1).collect()
        if not head:
            return df.withColumn(output, F.lit(None).cast(kind))
        rows = sorted(((r[0], r[1]) for r in head), key=lambda r: r[0])
        if len(head) <= TREE_LIMIT:
            return df.withColumn(output, asof_tree(F.col(key), [r[0] for r in rows], [r[1] for r in rows]).cast(kind))
        if len(head) <= INTERVAL_LIMIT:
            return _asof_intervals(df, key, rows, (breakpoints.schema[start].dataType, kind), output)
    by = by or []
    marks = breakpoints.filter(F.col(start).isNotNull()).select(*by, F.col(start).alias("__k"), F.col(value).alias("__v"), F.lit(0).alias("__side"))
    names = [f"__g{k}" for k in range(len(by))]
    groups = [F.col(c).alias(n) for c, n in zip(by, names, strict=True)]
    # numbers have to be the same when rows are read again: written once
    numbered = materialized(df.withColumn("__id", F.monotonically_increasing_id()))
    rows = numbered.select(*groups, F.col(key).alias("__k"), F.lit(None).cast(kind).alias("__v"), F.lit(1).alias("__side"), "__id")
    marks = marks.select(*groups, "__k", "__v", "__side", F.lit(None).cast("long").alias("__id"))
    order = [*names, "__k", "__side"]
    placed = materialized(marks.unionByName(rows).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()))
    mark = F.struct(*names, "__k", "__v")
    last = placed.groupBy("__p").agg(F.max(F.when(F.col("__side") == 0, mark)).alias("__last"))
    before = last.select("__p", F.last("__last", ignorenulls=True).over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))  # one row a partition
    within = Window.partitionBy("__p", *names).orderBy("__k", "__side")
    found = placed.withColumn("__f", F.last(F.when(F.col("__side") == 0, mark), ignorenulls=True).over(within)).filter("__side = 1").join(F.broadcast(before), "__p", "left")
    mine = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"__before.{n}")) for n in names], F.col("__before").isNotNull())
    found = found.withColumn("__f", F.coalesce("__f", F.when(mine, F.col("__before"))))
    # below the first breakpoint: the first one's value
    if by:
        firsts = marks.groupBy(*[F.col(n).alias(f"{n}f") for n in names]).agg(F.min(mark).alias("__first"))
        found = found.join(firsts, reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{n}f")) for n in names]), "left")
    else:
        found = found.join(F.broadcast(marks.agg(F.min(mark).alias("__first"))))  # one row
    value_ = F.when(F.col("__k").isNotNull(), F.coalesce("__f", "__first")["__v"])
    out = numbered.join(found.select(F.col("__id").alias("__of"), value_.alias("__found")), F.col("__id") == F.col("__of"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c != output], F.col("__found").alias(output))


def patent_year(number: Column) -> Column:
    """Year of grant by patent number; 1931 below the first."""
    return asof_tree(number.cast("long"), FIRST_PATENTS, [FIRST_PATENT_YEAR + k for k in range(len(FIRST_PATENTS))])


def fill_from_patent(df: DataFrame, number: str = "patent_number", year: str = "release_year", note: str = "release_note", expires: str = "patent_expires", estimated: str = "patent_estimated") -> DataFrame:
    """Fill a missing release year, with a note, and a missing expiry (unix seconds), marked as estimated.

    Numbers that are no integers fill nothing.
    """
    granted = patent_year(F.col(number).cast("string").try_cast("int"))
    out = df.withColumn("__granted", granted)
    no_year, no_expiry = F.col(year).isNull() & F.col("__granted").isNotNull(), F.col(expires).isNull() & F.col("__granted").isNotNull()
    return (
        out.withColumn(note, F.when(no_year, "from patent number").otherwise(F.col(note) if note in df.columns else F.lit(None)))
        .withColumn(estimated, F.coalesce(F.col(estimated) if estimated in df.columns else F.lit(None).cast("boolean"), F.lit(False)) | no_expiry)
        .withColumn(expires, F.when(no_expiry, patent_expiry_seconds(F.col("__granted"))).otherwise(F.col(expires)))
        .withColumn(year, F.when(no_year, F.col("__granted")).otherwise(F.col(year)))
        .drop("__granted")
    )
