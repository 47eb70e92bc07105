"""Shards along a Hilbert curve.

Several metadata dimensions (host, language, size) are quantised at quantiles taken over all rows, a row's cell
has a place on a Hilbert curve, and the rows in curve order are cut into runs of equal row counts. A shard then
covers a compact block of every dimension, so that file statistics on any of them prune shards.

Equal texts take the metadata of their first row (least key) and so have one place on the curve; text hash and
key order the rows within a place, then their position in the input: rows alike in all of it may be a third of the
table, and are sorted by several tasks. A group of copies is one contiguous run: it lies in one shard but where a cut
falls, as it must for groups larger than a shard.

What is coarse is placement alone: a text dimension is read by the seven bytes after the prefix that all its values
share, so values alike in them are one step; a dimension has at most 2^bits - 1 steps beside null.

Defined results: null metadata come first in their dimension; a null text has size 8 and the CRC of the empty
text; rows with a null key come first among their copies; repeated rows take neighbouring slots; an empty table
gives an empty one; columns of the input with an output's name give way to the output.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, quoted

ROW_BYTES = 8


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points (rows, dimensions) with coordinates under 2^bits.

    Gray-code form: reflections and swaps of the lower bits are undone from the top bit down, then the bits of all
    dimensions are interleaved and read as a Gray code.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for k in range(dims):
            set_ = (x[k] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[k] ^= swap
        q >>= 1
    for k in range(1, dims):
        x[k] ^= x[k - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for k in range(dims):
            place = (place << 1) | ((x[k] >> b) & 1)
    return place


def _as_number(column: Column, skip: int) -> Column:
    """The seven bytes of a string after its first ``skip``, as a number in the same order."""
    part = F.hex(F.substring(F.encode(F.substring(column, skip + 1, 7), "UTF-8"), 1, 7))
    return F.conv(F.rpad(part, 14, "0"), 16, 10).cast("long")


def _common_prefix(a: str | None, b: str | None) -> int:
    n = 0
    while a and b and n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def _text_columns(text: str) -> tuple[Column, Column, Column]:
    """Size, CRC and hash of a text."""
    body = F.coalesce(quoted(text), F.lit("")).cast("binary")
    return (F.length(body).cast("long") + ROW_BYTES).alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("__text")


def _curve_places(docs: DataFrame, key: str, text: str, dimensions: tuple[str, ...], bits: int) -> DataFrame:
    """``__key, size, text_crc32, __text, curve, __tie`` of every row; ``__tie`` keeps rows alike in all else apart."""
    names = [f"__d{k}" for k in range(len(dimensions))]
    rows = docs.select(quoted(key).alias("__key"), *_text_columns(text), *[quoted(d).cast("string").alias(n) for d, n in zip(dimensions, names, strict=True)])
    rows = checkpointed(rows)  # whole texts are read once
    # copies take the metadata of the least key among them
    groups = rows.groupBy("__text", "size").agg(F.min(F.struct("__key", *names)).alias("g"))
    groups = checkpointed(groups)  # else the join shares the sum's partitions, and a hot group's rows can't be split
    rows = rows.drop(*names).join(groups, ["__text", "size"]).select("__key", "size", "text_crc32", "__text", *[F.col(f"g.{n}").alias(n) for n in names])
    ends = groups.agg(*[f(F.col(f"g.{n}")) for n in names for f in (F.min, F.max)]).first() if names else ()
    numbers = [_as_number(F.col(n), _common_prefix(*ends[2 * k : 2 * k + 2])) for k, n in enumerate(names)] + [F.col("size")]
    rows = checkpointed(rows.select("__key", "size", "text_crc32", "__text", *[x.alias(f"__n{k}") for k, x in enumerate(numbers)]))
    cells = 1 << bits
    steps = F.array(*[F.lit(i / cells) for i in range(1, cells)])
    cuts = rows.agg(*[F.percentile_approx(f"__n{k}", steps, F.lit(10_000)) for k in range(len(numbers))]).first()

    def cell(k: int) -> Column:
        """0 for null, else the number of distinct cuts below the value, and one."""
        distinct = sorted(set(cuts[k] or []))
        if len(distinct) == cells - 1:  # one step is for nulls: the middle cut goes
            del distinct[len(distinct) // 2]
        below = [F.when(F.col(f"__n{k}") > F.lit(c), 1).otherwise(0) for c in distinct]
        return F.when(F.col(f"__n{k}").isNull(), 0).otherwise(sum(below, F.lit(1)))

    def place(*coordinates: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in coordinates], axis=1), bits))

    curve = F.pandas_udf(place, "bigint")(*[cell(k).cast("int") for k in range(len(numbers))])
    return rows.select("__key", "size", "text_crc32", "__text", curve.alias("curve"), F.monotonically_increasing_id().alias("__tie"))


def _cut(placed: DataFrame, n_shards: int) -> DataFrame:
    """Replace ``__tie`` by ``shard`` and ``slot``, in the order of curve, text hash and key."""
    order = ["curve", "__text", "__key", "__tie"]
    # sorted runs are written once: partition numbers and places within hold for the counts and for the answer
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("__tie")
    placed = checkpointed(placed.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = sorted((r["__part"], r["n"]) for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect())
    total, offsets = 0, {}
    for part, n in counts:
        offsets[part] = total
        total += n
    starts = placed.sparkSession.createDataFrame([*offsets.items()] or [(0, 0)], "__part int, __start bigint")
    ranked = placed.join(F.broadcast(starts), "__part").withColumn("__rank", F.col("__start") + F.col("__at"))  # one row a partition
    # the first ``long`` shards hold one row more than the others
    short, long = divmod(total, n_shards)
    head = long * (short + 1)
    rank = F.col("__rank")
    shard = F.when(rank < head, F.floor(rank / (short + 1))).otherwise(long + F.floor((rank - head) / max(1, short)))
    slot = F.when(rank < head, F.pmod(rank, F.lit(short + 1))).otherwise(F.pmod(rank - head, F.lit(max(1, short))))
    return ranked.withColumn("shard", shard.cast("int")).withColumn("slot", slot.cast("long")).drop("__part", "__at", "__start", "__rank")


def hilbert_shards(docs: DataFrame, n_shards: int = 24, key: str = "doc_id", text: str = "text", dimensions: tuple[str, ...] = ("source", "lang"), bits: int = 5) -> DataFrame:
    """Key, ``size``, ``text_crc32``, the curve place ``curve``, ``shard`` and ``slot`` of every row.

    Row counts of the shards differ by one at most. The driver sees one count a partition and the quantiles.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    cut = _cut(_curve_places(docs, key, text, dimensions, bits), n_shards)
    return cut.select(F.col("__key").alias(key), "size", "text_crc32", "curve", "shard", "slot")


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, key: str = "doc_id", text: str = "text", dimensions: tuple[str, ...] = ("source", "lang"), bits: int = 5) -> None:
    """Write the rows of ``docs`` below ``path``, one folder a shard, each file in the order of the slots.

    All rows are written, those with null and repeated keys too. Texts are shuffled twice: to meet their places, by
    text hash, and to be sorted by ranges of the curve, from which the shards are written as they lie.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    names = [c for c in docs.columns if c.lower() != "shard"]
    size, _, hashed = _text_columns(text)
    places = _curve_places(docs, key, text, dimensions, bits).groupBy("__text", "size").agg(F.min("curve").alias("curve"))
    places = checkpointed(places)  # as above: a hot text's rows must be free to be split
    row = F.struct(*[quoted(c).alias(f"c{k}") for k, c in enumerate(names)]).alias("__row")
    rows = docs.select(quoted(key).alias("__key"), size, hashed, row, F.monotonically_increasing_id().alias("__tie"))
    cut = _cut(rows.join(places, ["__text", "size"]), n_shards).sortWithinPartitions("shard", "slot")
    cut.select(*[F.col(f"__row.c{k}").alias(c) for k, c in enumerate(names)], "shard").write.partitionBy("shard").mode("overwrite").parquet(path)
