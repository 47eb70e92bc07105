"""User changes to a table of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import number_rows


def latest_changes(changes: DataFrame, key: str = "id", sequence: str = "seq") -> DataFrame:
    """The last change of each key; changes without a key, which insert, all stay."""
    columns = changes.columns
    last = changes.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(sequence, *[c for c in columns if c not in (key, sequence)])).alias("c"))
    last = last.select(*[F.col(c) if c == key else F.col(f"c.{c}").alias(c) for c in columns])
    return last.unionByName(changes.filter(F.col(key).isNull()))


def apply_changes(rows: DataFrame, changes: DataFrame, key: str = "id", owner: str = "owner", sequence: str = "seq", delete: str = "deleted", actor: str = "actor", guard: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): key and ``deleted`` delete, a key updates, no key inserts with the next keys, in sequence and
    without gaps.

    A change is rejected unless its owner is the actor, the ``guard`` column (a publication's id) is null, and the
    row that it names is there and the actor's own. Columns that a change lacks keep their value.
    """
    allowed = F.coalesce(F.col(owner) == F.col(actor), F.lit(False))
    if guard is not None and guard in changes.columns:
        allowed = allowed & F.col(guard).isNull()
    known = rows.select(F.col(key).alias("__k"), F.col(owner).alias("__owner"))
    joined = changes.join(known, F.col(key) == F.col("__k"), "left")
    fine = allowed & (F.col(key).isNull() | F.coalesce(F.col("__owner") == F.col(actor), F.lit(False)))
    rejected = joined.filter(~fine).drop("__k", "__owner")
    last = latest_changes(joined.filter(fine).drop("__k", "__owner"), key, sequence)
    data = [c for c in rows.columns if c != key]
    named = last.filter(F.col(key).isNotNull()).select(F.col(key).alias("__k"), F.coalesce(F.col(delete), F.lit(False)).alias("__delete"), *[F.col(c).alias(f"__{c}") for c in data if c in last.columns])
    merged = rows.join(named, F.col(key) == F.col("__k"), "left").filter(~F.coalesce("__delete", F.lit(False)))
    updated = merged.select(*[F.when(F.col("__k").isNotNull(), F.coalesce(F.col(f"__{c}"), F.col(c))).otherwise(F.col(c)).alias(c) if c in data and c in last.columns else F.col(c) for c in rows.columns])
    new = last.filter(F.col(key).isNull() & ~F.coalesce(F.col(delete), F.lit(False)))
    top = rows.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    # by sequence, then by the row's text: the same keys when a batch is run again on other partitions
    tie = F.to_json(F.struct(*new.columns))
    numbered = number_rows(new.withColumn("__tie", tie), [sequence, "__tie"], "__number")
    inserted = numbered.select((F.lit(top) + F.col("__number")).cast(rows.schema[key].dataType).alias(key), *[F.col(c) if c in new.columns else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in data])
    return updated.unionByName(inserted.select(*rows.columns)), rejected


def replace_builtin_rows(df: DataFrame, path: str, is_user: str = "is_user") -> None:
    """Replace all rows that no user owns, and keep users' rows: the table is partitioned by ownership."""
    df.withColumn(is_user, F.lit(False)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(is_user).parquet(path)
