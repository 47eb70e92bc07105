"""Pages of a table of any size: it is sorted once, and a page reads the ranges that hold it."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import discard, written
from .search import Page


@dataclass(frozen=True)
class RankIndex:
    """Ranges of a sorted table, in order: how many rows each has, how many of these have a ``mark``, and the least and
    greatest of them."""

    rows: DataFrame  # with __range, __at (place within the range, from 0)
    ranges: list[int]
    sizes: list[int]
    marked: list[int]
    low: list
    high: list
    mark: str | None
    starts: list[int] = field(default_factory=list)

    @property
    def count(self) -> int:
        return sum(self.sizes)

    def ranges_of(self, first: int, n: int) -> list[int]:
        """Which ranges hold the rows with the places first to first + n - 1, from 0."""
        if n <= 0 or first >= self.count:
            return []
        at = max(0, bisect_right(self.starts, first) - 1)
        end = bisect_right(self.starts, min(first + n, self.count) - 1)
        return [k for k in range(at, end) if self.sizes[k]]

    def slice(self, first: int, n: int) -> DataFrame:
        """The rows with the places first to first + n - 1, from 0, in order."""
        held = self.ranges_of(first, n)
        names = [c for c in self.rows.columns if c not in ("__range", "__at")]
        start = F.lit(None).cast("long")
        for k in held:
            start = F.when(F.col("__range") == self.ranges[k], F.lit(self.starts[k]).cast("long")).otherwise(start)
        found = self.rows.filter(F.col("__range").isin([self.ranges[k] for k in held])).withColumn("__place", start + F.col("__at"))
        return found.filter((F.col("__place") >= first) & (F.col("__place") < first + n)).orderBy("__place").select(*[F.col(f"`{c}`") for c in names])

    def before(self, bound) -> int:
        """How many rows have a ``mark`` below the bound: whole ranges by their size, and the one it cuts by a count."""
        if self.mark is None:
            raise ValueError("the index has no mark")
        spark = self.rows.sparkSession
        kind = self.rows.schema[self.mark].dataType
        value = spark.range(1).select((bound if isinstance(bound, Column) else F.lit(bound)).cast(kind)).first()[0]
        whole = sum(n for n, high in zip(self.marked, self.high, strict=True) if high is not None and high < value)
        cut = [r for r, low, high in zip(self.ranges, self.low, self.high, strict=True) if low is not None and low < value <= high]
        return whole + (self.rows.filter(F.col("__range").isin(cut)).agg(F.count_if(F.col(self.mark) < value)).first()[0] if cut else 0)

    def page(self, page: int | str | None = 1, per_page: int | None = None, now=None) -> Page:
        """Page by page from 1, as ``search.paginate`` gives them. ``mid`` is the page where marks before ``now`` end."""
        middle = 1 + self.before(now) // per_page if now is not None and per_page else None
        if page == "mid":
            if middle is None:
                raise ValueError("no midpoint to turn to")
            page = middle
        page = 1 if page is None else int(page)
        if page < 1 or (per_page is None and page != 1):
            raise ValueError(f"no page {page}")
        n = self.count if per_page is None else per_page
        return Page(self.slice((page - 1) * n, n), self.count, page, 1 if per_page is None else -(-self.count // per_page), middle)


def build_rank_index(df: DataFrame, sort: list[Column], folder: str, range_rows: int = 100_000, mark: str | None = None) -> RankIndex:
    """Sort the rows by ranges of about ``range_rows`` and write each to its own folder below ``folder``, with their counts.

    ``sort`` has to tell all rows apart for pages to be the same on every build. ``mark``: the first sort column, if
    midpoints are asked for; nulls in it are before and after nothing.
    """
    spark = df.sparkSession
    n = max(1, -(-df.count() // range_rows))
    ranged = df.repartitionByRange(n, *sort).sortWithinPartitions(*sort)
    placed = ranged.withColumn("__range", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    rows = written(placed, f"{folder}/ranges", ["__range"])
    value = F.col(mark) if mark is not None else F.lit(None).cast("int")
    written(rows.groupBy("__range").agg(F.count("*").alias("n"), F.count(value).alias("marked"), F.min(value).alias("low"), F.max(value).alias("high")).withColumn("mark", F.lit(mark).cast("string")), f"{folder}/counts")
    return open_rank_index(spark, folder, rows.schema)


def open_rank_index(spark: SparkSession, folder: str, schema: T.StructType | None = None) -> RankIndex:
    """The index that ``build_rank_index`` wrote; one row a range comes to the driver."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    counts = spark.read.parquet(f"{folder}/counts").orderBy("__range").collect()
    sizes = [r["n"] for r in counts]
    mark = counts[0]["mark"] if counts else None
    return RankIndex(reader.parquet(f"{folder}/ranges"), [r["__range"] for r in counts], sizes, [r["marked"] for r in counts], [r["low"] for r in counts], [r["high"] for r in counts], mark, list(accumulate(sizes, initial=0))[:-1])


def drop_rank_index(spark: SparkSession, folder: str) -> None:
    discard(spark, folder)
