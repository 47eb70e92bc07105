"""SimHash near-duplicates by a Gray-order hierarchical index.

Each text gets a 64-bit fingerprint of its word shingles. Fingerprints at three or fewer differing bits are
linked; linked documents, directly or over others, form a component named by its smallest id.

Search: of the four 16-bit blocks of two linked fingerprints at least one is equal, so every distinct fingerprint
goes to four runs (block number, block value). A run's fingerprints are sorted by Gray rank and grouped bottom-up;
a node holds the bits that all its members share and its parent's do not yet cover. A search walks down from the
top, adds up the differences in the shared bits, and drops a whole group once they exceed three. Runs larger than
``run_limit`` are cut again by the blocks of their remaining bits, so no run has to be read by one task.

Defined results: null and empty texts have fingerprint zero and are linked like any other; repeated rows share a
component; rows with a null id take part, and a component of such rows alone has a null id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_columns, quoted

SHINGLE_WORDS = 3
MAX_DIFFERENCES = 3
_SEED = 42
_LEAF = 16
_FANOUT = 8
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _fingerprint(text: str | None, size: int = SHINGLE_WORDS) -> int:
    import xxhash

    # words of bytes: bytes.split() cuts at the six ASCII white-space characters only
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(joined, _SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.append(0, ends[: len(words) - size]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], _SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        part = np.array(hashes[at : at + 4096], ">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprint_texts(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``fp``, the fingerprint as a signed 64-bit integer."""

    def make():
        def compute(texts):
            return [[f - (1 << 64) if f >> 63 else f for f in map(_fingerprint, texts)]]

        return compute

    return map_columns(docs, [text], "fp bigint", make, keep)


def gray_rank(code: np.ndarray) -> np.ndarray:
    """The place of each 64-bit code in the reflected Gray order."""
    rank = code.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """The hierarchy over fingerprints sorted by (run, Gray rank); no node reaches over the end of a run."""

    def __init__(self, run: np.ndarray, code: np.ndarray):
        self.code = code
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        edges = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        lo, hi = _cut(edges, np.append(edges[1:], len(code)), _LEAF)
        both, either = np.bitwise_and.reduceat(code, lo), np.bitwise_or.reduceat(code, lo)
        # levels from the leaves up: (first child, end of children, mask of shared bits, their pattern)
        self.levels = [(lo, hi, ~(both ^ either), both)]
        node_run = run[lo]
        while True:
            edges = np.flatnonzero(np.append(True, node_run[1:] != node_run[:-1]))
            if len(edges) == len(node_run):
                break
            lo, hi = _cut(edges, np.append(edges[1:], len(node_run)), _FANOUT)
            mask, pattern = self.levels[-1][2:]
            shared = np.bitwise_and.reduceat(mask & ~(pattern ^ np.repeat(pattern[lo], hi - lo)), lo)
            self.levels.append((lo, hi, shared, pattern[lo]))
            node_run = node_run[lo]
        self.root_run = node_run
        # what a parent covers is not counted again below it
        self.rest = [full] * len(self.levels)
        for k in range(len(self.levels) - 1):
            lo, hi, shared, _ = self.levels[k + 1]
            self.rest[k] = ~np.repeat(shared, hi - lo)
        self.leaf_rest = ~np.repeat(self.levels[0][2], self.levels[0][1] - self.levels[0][0])

    def search(self, query: np.ndarray, root: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (place in ``query``, place in the index) at ``limit`` or fewer differing bits.

        ``root``: the top node in which each query searches.
        """
        who, node = np.arange(len(query)), root
        far = np.zeros(len(query), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            lo, hi, mask, pattern = self.levels[k]
            rest = self.rest[k] if isinstance(self.rest[k], np.ndarray) else np.full(len(lo), self.rest[k])
            far = far + np.bitwise_count((query[who] ^ pattern[node]) & mask[node] & rest[node])
            near = far <= limit
            who, node, far = who[near], node[near], far[near]
            count = hi[node] - lo[node]
            first = np.repeat(lo[node] - np.cumsum(count) + count, count)
            who, far = np.repeat(who, count), np.repeat(far, count)
            node = first + np.arange(len(first))
        far = far + np.bitwise_count((query[who] ^ self.code[node]) & self.leaf_rest[node])
        near = far <= limit
        return who[near], node[near]


def _cut(starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut the spans into pieces of at most ``size``."""
    pieces = -(-(ends - starts) // size)
    first = np.repeat(starts, pieces)
    at = np.arange(len(first)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lo = first + at * size
    return lo, np.minimum(lo + size, np.repeat(ends, pieces))


def _linked(run: np.ndarray, code: np.ndarray, limit: int, block: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of codes that span the same components as all links within each run do."""
    order = np.lexsort((gray_rank(code), run))
    run, code = run[order], code[order]
    index = GrayIndex(run, code)
    roots = np.searchsorted(index.root_run, run)
    parent = np.arange(len(code))
    # a run of one has nothing to find
    alone = np.append(True, run[1:] != run[:-1]) & np.append(run[1:] != run[:-1], True)
    todo = np.flatnonzero(~alone)
    for at in range(0, len(todo), block):
        part = todo[at : at + block]
        who, found = index.search(code[part], roots[part], limit)
        a = part[who]
        keep = found < a
        a, b = a[keep], found[keep]
        # components so far: links inside one are not passed on
        new = parent[a] != parent[b]
        a, b = a[new], b[new]
        if len(a):
            start = parent
            while True:
                low = np.minimum(parent[a], parent[b])
                before, parent = parent, parent.copy()
                np.minimum.at(parent, before[a], low)
                np.minimum.at(parent, before[b], low)
                parent = parent[parent]
                if np.array_equal(parent, before):
                    break
            moved = np.flatnonzero(parent != start)
            yield code[moved], code[parent[moved]]


def _runs(codes: DataFrame, run_limit: int) -> DataFrame:
    """Each code in four runs; a run above the limit is cut in four by the blocks of its other 48 bits.

    Three differences at most leave one of those four blocks equal too, so no link is lost by the cut.
    """
    fp = F.col("fp")

    def bits(blocks: list[tuple[int, int]]) -> Column:
        """An array of (kind, value) of the blocks (shift, width)."""
        return F.array(*[F.struct(F.lit(k).alias("kind"), F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1)).alias("value")) for k, (s, w) in enumerate(blocks)])

    runs = codes.select("fp", F.explode(bits([(0, 16), (16, 16), (32, 16), (48, 16)])).alias("b"))
    runs = runs.select("fp", F.col("b.kind").cast("long").alias("kind"), F.col("b.value").alias("value"))
    big = runs.groupBy("kind", "value").agg(F.count("*").alias("n")).filter(F.col("n") > run_limit)
    if big.isEmpty():
        return runs
    # the other 48 bits as four blocks of 12: the run's own block is rotated to the top first
    sized = runs.join(big.select("kind", "value", F.lit(True).alias("big")), ["kind", "value"], "left")
    turned = F.when(F.col("kind") == 3, fp)
    for k in range(3):
        turned = turned.when(F.col("kind") == k, F.shiftleft(fp, 48 - 16 * k).bitwiseOR(F.shiftrightunsigned(fp, 16 + 16 * k)))
    cut = sized.filter(F.col("big")).withColumn("turned", turned)
    parts = F.array(*[F.struct(F.lit(k).alias("k"), F.shiftrightunsigned("turned", 12 * k).bitwiseAND(F.lit(4095)).alias("v")) for k in range(4)])
    cut = cut.select("fp", "kind", "value", F.explode(parts).alias("p"))
    cut = cut.select("fp", (F.col("kind") * 5 + F.col("p.k") + 1).alias("kind"), F.col("value").bitwiseOR(F.shiftleft(F.col("p.v"), 16)).alias("value"))
    whole = sized.filter(F.col("big").isNull()).select("fp", (F.col("kind") * 5).alias("kind"), "value")
    return whole.unionByName(cut)


def link_codes(codes: DataFrame, max_differences: int = MAX_DIFFERENCES, run_limit: int = 200_000) -> DataFrame:
    """Links ``src`` > ``dst`` between the distinct 64-bit codes of column ``fp``: not every pair at
    ``max_differences`` (three at most) or fewer differing bits, but enough to span the same components."""
    if max_differences > 3:
        raise ValueError("four blocks find three differences at most")
    runs = _runs(codes, run_limit).select("fp", F.xxhash64("kind", "value").alias("run"))
    # more rows than a task should hold are spread by Spark's own partition count; runs are whole within one
    runs = runs.repartition("run").sortWithinPartitions("run")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_run: list[np.ndarray] = []
        held_code: list[np.ndarray] = []
        held = 0

        def flush(run: np.ndarray, code: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a, b in _linked(run, code.view(np.uint64), max_differences):
                a, b = a.view(np.int64), b.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["src", "dst"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held_code.append(batch.column(0).to_numpy())
            held_run.append(batch.column(1).to_numpy())
            held += batch.num_rows
            # whole runs go on as soon as there are enough rows; the last run may not be complete
            if held >= 200_000 and held_run[0][0] != held_run[-1][-1]:
                run, code = np.concatenate(held_run), np.concatenate(held_code)
                end = np.searchsorted(run, run[-1])
                yield from flush(run[:end], code[:end])
                held_run, held_code, held = [run[end:]], [code[end:]], len(run) - end
        if held:
            yield from flush(np.concatenate(held_run), np.concatenate(held_code))

    return runs.mapInArrow(search, "src bigint, dst bigint").distinct()


def connected(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of the links ``src`` > ``dst``, root being the smallest node of its component.

    Alternating large-star and small-star steps, each written to the checkpoint folder. A node's neighbours are
    only reduced to their minimum and joined back, never gathered.
    """
    links = checkpointed(links.select("src", "dst").filter("src > dst").distinct())
    state = None
    for _ in range(max_rounds):
        both = links.union(links.select("dst", "src"))
        low = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("low"))
        large = both.filter("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(low, "src")
        small = small.filter("dst > low").select(F.col("dst").alias("src"), F.col("low").alias("dst")).union(small.select("src", F.col("low").alias("dst")))
        links = checkpointed(small.filter("src > dst").distinct())
        seen = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components not found in {max_rounds} rounds")
    return links.select(F.col("src").alias("node"), F.col("dst").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """One row a document: its key, ``fp``, ``root`` (the code that names its component) and ``component`` (the
    smallest key reachable); ``extra``: more columns, expressions over ``docs``, to carry along."""
    extra = extra or {}
    rows = docs.select(quoted(key).alias(key), quoted(text).alias("__text"), *[c.alias(n) for n, c in extra.items()])
    rows = checkpointed(fingerprint_texts(rows, "__text", [key, *extra]))
    codes = checkpointed(rows.groupBy("fp").agg(F.min(quoted(key)).alias("least")))
    roots = connected(link_codes(codes.select("fp")))
    named = codes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component"))
    classes = named.join(smallest, "root").select(F.col("fp").alias("code"), "root", "component")
    return rows.join(classes, rows["fp"] == classes["code"], "left").drop("code")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", filter_bits: int = 28) -> DataFrame:
    """One row of each component: that with the smallest key; of several with it, that with the smallest text hash; of
    repeated rows with both alike, one.

    Slim rows (key, text hash, root) decide. Rows of a key and hash to drop, or to keep once, are marked in a filter
    of sixteen bits each, up to 2^``filter_bits`` (32 MB), which goes to all tasks: a row that it does not hold stays
    where it is, and only the others are shuffled, with their texts, to meet the exact list. A full filter costs
    shuffle, not rows.
    """
    names = docs.columns
    docs = docs.select(*[quoted(c).alias(f"c{k}") for k, c in enumerate(names)])
    key, text = (f"c{names.index(c)}" for c in (key, text))
    mark = F.xxhash64(F.coalesce(quoted(text), F.lit("")))
    found = near_duplicates(docs, key, text, {"__mark": mark})
    order = F.struct(quoted(key).isNull().alias("no"), quoted(key).alias("k"), F.col("__mark").alias("m"))
    groups = found.groupBy("root", quoted(key).alias("__k"), F.col("__mark").alias("__m")).agg(F.count("*").alias("n"), F.min(order).alias("o"))
    best = groups.groupBy("root").agg(F.min("o").alias("b")).select(F.col("b.k").alias("__bk"), F.col("b.m").alias("__bm"))
    # by key and hash, not by root: a component may hold a third of all rows
    judged = groups.join(best, F.col("__k").eqNullSafe(F.col("__bk")) & (F.col("__m") == F.col("__bm")), "left").select("__k", "__m", F.col("__bm").isNotNull().alias("once"), "n")
    listed = checkpointed(judged.filter(~F.col("once") | (F.col("n") > 1)).select("__k", "__m", "once"))
    # the filter: rows of 4096 bytes, by the number of the block
    bits = min(filter_bits, max(15, (16 * listed.count()).bit_length()))
    place = lambda k, m: F.pmod(F.xxhash64(k, m), F.lit(1 << bits)) + 1
    spots = listed.select(place(F.col("__k"), F.col("__m")).alias("p"))
    blocks = spots.groupBy(F.bitmap_bucket_number("p").alias("__block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__bits"))
    rows = docs.withColumn("__mark", mark).withColumn("__p", place(quoted(key), F.col("__mark")))
    rows = rows.withColumn("__block_of", F.bitmap_bucket_number("__p")).join(F.broadcast(blocks), F.col("__block_of") == F.col("__block"), "left")
    bit = F.bitmap_bit_position("__p").cast("int")
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright(bit, 3) + 1, 1)), 16, 10).cast("int")
    held = F.coalesce(F.expr("__byte >> (__bit & 7) & 1 = 1"), F.lit(False))
    rows = rows.withColumn("__bit", bit).withColumn("__byte", byte).withColumn("__held", held)
    sure = rows.filter(~F.col("__held")).select(*docs.columns)
    asked = rows.filter("__held").select(*docs.columns, "__mark").join(listed, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__mark") == F.col("__m")), "left")
    clear = asked.filter(F.col("once").isNull()).select(*docs.columns)
    single = asked.filter("once").dropDuplicates([key, "__mark"]).select(*docs.columns)
    out = sure.unionByName(clear).unionByName(single)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)])
