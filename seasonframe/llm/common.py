"""What the text operators share: reading tables, cutting lineage, mapping Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import materialized as checkpointed  # noqa: F401

#: Rows that Python code holds as objects at one time.
SLICE_ROWS = 256


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; null for a null key."""
    return F.crc32(quoted(key).cast("string").cast("binary")) % modulus


def map_columns(
    df: DataFrame,
    inputs: list[str],
    outputs: str,
    make: Callable[[], Callable[..., Iterable[list]]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Add the columns of the DDL ``outputs``, computed in Python from the columns ``inputs``.

    ``make`` runs once a task and returns a function from lists of input values to lists of output values.
    Only the columns ``keep`` (all, if None) stay beside the new ones; an input column with the name of an
    output gives way to it.
    """
    added = T._parse_datatype_string(outputs)
    new = {f.name.lower() for f in added.fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    used = list(dict.fromkeys([*kept, *inputs]))
    # plain names within: mapInArrow() can't take a dot in a name
    plain = {c: f"__c{k}" for k, c in enumerate(used)}
    source = df.select(*[quoted(c).alias(n) for c, n in plain.items()])
    schema = T.StructType([T.StructField(plain[c], source.schema[plain[c]].dataType, True) for c in kept] + added.fields)
    names = [f.name for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        compute = make()
        kinds = [to_arrow_type(f.dataType) for f in added.fields]
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                values = compute(*[batch.column(used.index(c)).to_pylist() for c in inputs])
                arrays = [batch.column(used.index(c)) for c in kept]
                arrays += [pa.array(v, k) for v, k in zip(values, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(run, schema).select(*[F.col(plain[c]).alias(c) for c in kept], *names)


def filter_rows(df: DataFrame, column: str, make: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows of ``df`` for which the function that ``make`` returns says true of the values of ``column``."""
    at = df.columns.index(column)
    plain = {c: f"__c{k}" for k, c in enumerate(df.columns)}
    source = df.select(*[quoted(c).alias(n) for c, n in plain.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = make()
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(start, SLICE_ROWS)
                out = batch.filter(pa.array(decide(batch.column(at).to_pylist()), pa.bool_()))
                if out.num_rows:
                    yield out

    return source.mapInArrow(run, source.schema).select(*[F.col(n).alias(c) for c, n in plain.items()])
