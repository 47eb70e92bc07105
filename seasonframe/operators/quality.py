"""Integrity checks as rows (check, key, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import spread

#: Keys that a task counts.
TASK_KEYS = 1_000_000
SCHEMA = "`check` string, `key` string, detail string"


def violations(df: DataFrame, check: str, condition: Column, key: Column, detail: Column | None = None) -> DataFrame:
    """A row for each of ``df`` where the condition holds."""
    return df.filter(condition).select(F.lit(check).alias("check"), key.cast("string").alias("key"), (F.lit("") if detail is None else detail.cast("string")).alias("detail"))


def name_xor_names(entries: DataFrame, key: Column, name: str = "name", names: str = "names") -> DataFrame:
    return violations(entries, "name xor names", F.col(name).isNull() == F.col(names).isNull(), key)


def empty_time(entries: DataFrame, key: Column, time: str = "harvest_time") -> DataFrame:
    return violations(entries, "empty time", F.trim(F.col(time)) == "", key)


def unparsed_time(entries: DataFrame, key: Column, parsed: Column, time: str = "harvest_time") -> DataFrame:
    return violations(entries, "unparsable time", F.col(time).isNotNull() & (F.trim(F.col(time)) != "") & parsed.isNull(), key, F.col(time))


def duplicate_keys(df: DataFrame, columns: list[str], check: str = "duplicate key") -> DataFrame:
    """Keys that occur more than once; null parts are no keys. Most occur once, so that only a bounded number goes to a task."""
    keyed = df.select(*columns).filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))
    rows = spread(keyed, *columns, rows=TASK_KEYS).groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")
    return violations(rows, check, F.lit(True), F.concat_ws("/", *columns), F.col("n"))


def missing(df: DataFrame, check: str, columns: list[str]) -> DataFrame:
    """For frames of what ought to be empty: missing references, unknown kinds, alias or field conflicts."""
    return violations(df, check, F.lit(True), F.concat_ws("/", *columns))


def quality_report(parts: list[DataFrame], strict: bool = False) -> DataFrame:
    """All violations together; ``strict`` raises if there is one."""
    report = reduce(DataFrame.unionByName, parts)
    if strict and (first := report.head(3)):
        raise ValueError("quality checks failed: " + "; ".join(f"{r['check']}: {r['key']} {r['detail']}".strip() for r in first))
    return report
