"""Collocations: frequent phrases found by dynamic itemset counting, scored by how much more often than by chance they stand.

The corpus is dealt into shards that are scanned in a cycle, one a step. Words are counted from the first step on. A
longer phrase becomes active at the step after both its parts (all words but the last, all but the first) have been
seen ``min_count`` times, wherever in the cycle that is, and is counted for one full cycle from there on. So lengths
interleave: while rare words wait for their last shard, phrases of common ones are already counted. The scans end when no
phrase has been reached for a full cycle.

Within the scans a phrase is its 64-bit hash. A table of at most 2^25 cells says at which step a hash reached the
threshold; it goes to all tasks. Cells that several phrases share, and equal hashes, can only make a phrase active
that need not be, never keep one back. A last scan counts the texts of phrases that were reached, by two independent
64-bit hashes, and that count decides.

Odd input: null and empty texts have no words; a null language is ``und``; repeated rows count as often as they stand
there. Columns of other names don't matter. An empty table gives an empty one.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import shared_folder
from .common import SLICE_ROWS, checkpointed, quoted

#: Bytes of text of one language that are looked at together.
SLICE_BYTES = 1 << 20
#: Phrases that a task holds before it counts them.
HELD = 1 << 19
NEVER = 255
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SEPARATORS = ".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(ord(".") if chr(c) in _SEPARATORS else ord(" ") if chr(c) == "\t" else ord(chr(c).lower()) if chr(c) in string.ascii_uppercase else c for c in range(256))


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _joined(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase and a further word."""
    return _mixed(before * np.uint64(0xBF58476D1CE4E5B9) + word)


class Words:
    """The words of some texts of one language: where they lie in the bytes, and which piece each is in."""

    def __init__(self, lang: str, texts: list[str]):
        self.data = b".".join(t.encode("utf-8", "surrogatepass") for t in texts).translate(_TABLE)
        self.lang = lang
        self.bytes = np.frombuffer(self.data, np.uint8)
        self.inside = (self.bytes != ord(" ")) & (self.bytes != ord("."))
        edge = np.diff(self.inside.astype(np.int8), prepend=0, append=0)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.piece = np.cumsum(self.bytes == ord("."), dtype=np.int64)[self.start]

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, by language: a polynomial of its bytes."""
        lengths = self.end - self.start
        place = np.repeat(self.end, lengths) - 1 - np.flatnonzero(self.inside)
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.r_[np.uint64(1), np.full(int(lengths.max()), FACTORS[which], np.uint64)])
            values = (self.bytes[self.inside].astype(np.uint64) + np.uint64(1)) * powers[place]
            seed = np.uint64(int.from_bytes(self.lang.encode("utf-8", "surrogatepass"), "little") % (2**61 - 1))
            return _mixed(np.add.reduceat(values, np.cumsum(lengths) - lengths) + seed * np.uint64(FACTORS[1 - which]))

    def phrase(self, at: int, size: int) -> str:
        return b" ".join(self.data[self.start[k] : self.end[k]] for k in range(at, at + size)).decode("utf-8", "surrogatepass")


def _places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The three cells of each hash: bits at its top, in its middle and at its end."""
    mask = np.uint64((1 << bits) - 1)
    return [h >> np.uint64(64 - bits), (h >> np.uint64(20)) & mask, h & mask]


class Cells:
    """At which step a hash reached the threshold, or an earlier one; ``NEVER`` if it did not.

    Each hash has three cells that hold the first step that set them, and the latest of these is what is said. Cells
    never change once they are set, so that what is said of a hash that was reached never changes either.
    """

    def __init__(self, bits: int):
        self.bits = bits
        self.steps = np.full(1 << bits, NEVER, np.uint8)

    def step(self, h: np.ndarray) -> np.ndarray:
        one, two, three = (self.steps[p] for p in _places(h, self.bits))
        return np.maximum(np.maximum(one, two), three)

    def reach(self, places: np.ndarray, step: int) -> None:
        self.steps[places] = np.minimum(self.steps[places], step)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """The words of all rows (lang, text), some texts of one language at a time; a longer text is a slice of its own."""
    held: dict[str, list[str]] = {}
    sizes: dict[str, int] = {}
    for whole in batches:
        for lo in range(0, whole.num_rows, SLICE_ROWS):
            batch = whole.slice(lo, SLICE_ROWS)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text) + 1
                if sizes[lang] >= SLICE_BYTES or sum(sizes.values()) >= 4 * SLICE_BYTES:
                    largest = max(sizes, key=sizes.get)
                    yield Words(largest, held.pop(largest))
                    sizes.pop(largest)
    for lang, texts in held.items():
        yield Words(lang, texts)


def _extended(words: Words, first: np.ndarray, cells: Cells, max_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(size, places, hashes, step of the later part) of all phrases of two words or more whose parts were both reached."""
    h, step = first, cells.step(first)
    for size in range(2, max_words + 1):
        m = len(words) - size + 1
        if m <= 0:
            return
        both = (step[:m] != NEVER) & (step[1 : m + 1] != NEVER) & (words.piece[:m] == words.piece[size - 1 :])
        at = np.flatnonzero(both)
        if not len(at):
            return
        longer = _joined(h[at], first[at + size - 1])
        yield size, at, longer, np.maximum(step[at], step[at + 1])
        h, before = np.zeros(m, np.uint64), step
        h[at] = longer
        step = np.full(m, NEVER, before.dtype)
        step[at] = cells.step(longer)


def _scan(shard: DataFrame, cells, step: int, shards: int, max_words: int) -> DataFrame:
    """(hash, size, until, n): what is active at this step, counted in a shard; ``until``: the last step of its cycle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: Cells = cells.value
        held: list[tuple[np.ndarray, int, np.ndarray]] = []

        def counted() -> pa.RecordBatch:
            h = np.concatenate([x[0] for x in held])
            size = np.concatenate([np.full(len(x[0]), x[1], np.int32) for x in held])
            until = np.concatenate([x[2] for x in held])
            found, first, n = np.unique(h, return_index=True, return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(size[first]), pa.array(until[first]), pa.array(n.astype(np.int64))], names=["hash", "size", "until", "n"])

        with np.errstate(over="ignore"):
            for words in _slices(batches):
                if not len(words):
                    continue
                h = words.hashes()
                if step < shards:
                    held.append((h, 1, np.full(len(h), shards - 1, np.int32)))
                for size, _, longer, later in _extended(words, h, table, max_words):
                    until = later.astype(np.int32) + shards
                    active = until >= step
                    if active.any():
                        held.append((longer[active], size, until[active]))
                if sum(len(x[0]) for x in held) >= HELD:
                    yield counted()
            if held:
                yield counted()

    return shard.mapInArrow(run, "hash long, size int, until int, n long")


def _reached(now: DataFrame, bits: int, max_words: int) -> tuple[np.ndarray, bool]:
    """The cells (as in ``_places``) of hashes that were reached, as bitmaps of at most as many bits as there are cells;
    and whether one of them can be a part of something longer."""
    mask = F.lit((1 << bits) - 1)
    h = F.col("hash")
    places = F.array(F.shiftrightunsigned(h, 64 - bits), F.shiftrightunsigned(h, 20).bitwiseAND(mask), h.bitwiseAND(mask))
    spots = now.select((F.col("size") < max_words).alias("part"), F.explode(places).alias("place")).withColumn("place", F.col("place") + 1)
    blocks = spots.groupBy(F.bitmap_bucket_number("place").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"), F.bool_or("part").alias("part")).collect()
    found = [np.flatnonzero(np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")) + (r["block"] - 1) * 32768 for r in blocks]
    return np.concatenate(found) if found else np.zeros(0, np.int64), any(r["part"] for r in blocks)


class Tally:
    """Counts of phrases by two hashes; a phrase's text is read when it is first met."""

    def __init__(self):
        self.one, self.two, self.n, self.row = (np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
        self.rows: list[tuple[str, str, int]] = []

    def __len__(self) -> int:
        return len(self.rows)

    def add(self, words: Words, one: np.ndarray, two: np.ndarray, size: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(one)
        one, two, size, at = one[order], two[order], size[order], at[order]
        new = one[1:] != one[:-1]
        if (~new & (two[1:] != two[:-1])).any():  # equal first hashes of different phrases lie in any order
            order = np.lexsort((two, one))
            one, two, size, at = one[order], two[order], size[order], at[order]
            new = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        first = np.flatnonzero(np.r_[True, new])
        n = np.diff(np.r_[first, len(one)])
        one, two, size, at = one[first], two[first], size[first], at[first]
        place = np.searchsorted(self.one, one)
        known = np.zeros(len(one), bool)
        inside = place < len(self.one)
        known[inside] = (self.one[place[inside]] == one[inside]) & (self.two[place[inside]] == two[inside])
        self.n[place[known]] += n[known]  # each phrase once
        fresh = np.flatnonzero(~known)
        if len(fresh):
            start = len(self.rows)
            self.rows += [(words.lang, words.phrase(k, s), s) for k, s in zip(at[fresh].tolist(), size[fresh].tolist(), strict=True)]
            self.one, self.two, self.n = np.r_[self.one, one[fresh]], np.r_[self.two, two[fresh]], np.r_[self.n, n[fresh]]
            self.row = np.r_[self.row, np.arange(start, len(self.rows))]
            order = np.lexsort((self.two, self.one))
            self.one, self.two, self.n, self.row = (x[order] for x in (self.one, self.two, self.n, self.row))

    def batch(self) -> pa.RecordBatch:
        lang, phrase, size = zip(*self.rows, strict=True)
        n = np.empty(len(self.rows), np.int64)
        n[self.row] = self.n
        return _counts(lang, phrase, size, n)


def _counts(lang, phrase, size, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(size, pa.int32()), pa.array(n, pa.int64())], names=["lang", "phrase", "size", "n"])


def _phrases(rows: DataFrame, cells, max_words: int) -> DataFrame:
    """(lang, phrase, size, n): how often each phrase that was reached stands in a task's texts; size 0: all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: Cells = cells.value
        tally, totals = Tally(), {}
        with np.errstate(over="ignore"):
            for words in _slices(batches):
                if not len(words):
                    continue
                totals[words.lang] = totals.get(words.lang, 0) + len(words)
                one, two = words.hashes(0), words.hashes(1)
                at = np.flatnonzero(table.step(one) != NEVER)
                found = [(one[at], two[at], 1, at)]
                for size, at, longer, _ in _extended(words, one, table, max_words):
                    good = table.step(longer) != NEVER
                    at, longer = at[good], longer[good]
                    other = two[at]
                    for k in range(1, size):
                        other = _joined(other, two[at + k])
                    found.append((longer, other, size, at))
                if sum(len(x[0]) for x in found):
                    tally.add(words, np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]), np.repeat([x[2] for x in found], [len(x[0]) for x in found]), np.concatenate([x[3] for x in found]))
                if len(tally) > HELD // 2:
                    yield tally.batch()
                    tally = Tally()
            if len(tally):
                yield tally.batch()
            if totals:
                yield _counts(list(totals), [""] * len(totals), [0] * len(totals), list(totals.values()))

    return rows.mapInArrow(run, "lang string, phrase string, size int, n long")


def _discard(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = 100, max_words: int = 5, shards: int = 4) -> DataFrame:
    """(lang, phrase, size, n): the phrases of up to ``max_words`` words that stand ``min_count`` times or more in a
    language, with their exact counts; a row of size 0 has the number of all words of a language.

    Shards and what is counted so far are written to the shared folder, and removed at the end.
    """
    if shards * max_words >= NEVER:
        raise ValueError("too many steps for a byte")
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/collocations-{uuid.uuid4().hex}"
    rows = docs.select(F.coalesce(quoted(lang), F.lit("und")).alias("lang"), F.coalesce(quoted(text), F.lit("")).alias("text"))
    rows.withColumn("shard", F.monotonically_increasing_id() % shards).write.partitionBy("shard").parquet(f"{folder}/texts")
    texts = spark.read.schema("lang string, text string, shard int").parquet(f"{folder}/texts")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(25, max(16, (size // 64).bit_length()))
    cells = Cells(bits)
    state = spark.createDataFrame([], "hash long, size int, until int, n long, reached boolean")
    step, last_reached = 0, -shards - 1
    while step < shards or last_reached >= step - shards:
        sent = spark.sparkContext.broadcast(cells)
        shard = texts.filter(F.col("shard") == step % shards).select("lang", "text")
        new = _scan(shard, sent, step, shards, max_words).withColumn("reached", F.lit(False))
        merged = state.union(new).groupBy("hash").agg(F.max("size").alias("size"), F.max("until").alias("until"), F.sum("n").alias("n"), F.max("reached").alias("reached"))
        merged = merged.select("hash", "size", "until", "n", (F.col("n") >= min_count).alias("reached"), ((F.col("n") >= min_count) & ~F.col("reached")).alias("now"))
        merged.write.parquet(f"{folder}/step={step}")
        sent.destroy()
        merged = spark.read.schema(merged.schema).parquet(f"{folder}/step={step}")
        if step:
            _discard(spark, f"{folder}/step={step - 1}")
        reached, longer = _reached(merged.filter("now"), bits, max_words)
        cells.reach(reached, step)
        if longer:
            last_reached = step
        # a full cycle is over: whatever was reached is in the cells
        state = merged.filter(F.col("until") > step).drop("now")
        step += 1
    sent = spark.sparkContext.broadcast(cells)
    # a task passes on each phrase once, whatever it reads: few and large tasks combine more
    wide = texts.select("lang", "text").coalesce(2 * spark.sparkContext.defaultParallelism)
    found = _phrases(wide, sent, max_words).groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))
    found = checkpointed(found.filter((F.col("n") >= min_count) | (F.col("size") == 0)))
    sent.destroy()
    _discard(spark, folder)
    return found


def score_phrases(phrases: DataFrame, covered_percent: int = 100) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of two words or more, but those that a longer one covers.

    A phrase is cut in two where floor(1000 * a * n / (l * r)) is least, at the first of equal cuts. It is covered if
    one of the phrases stands in its place ``covered_percent`` of the time; it is enough to ask those with one word more.
    """
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    words = F.split("phrase", " ")
    longer = phrases.filter("size >= 2").select("lang", "phrase", "size", F.col("n").alias("a"), words.alias("w"))
    parts = longer.filter("size >= 3").select("lang", "a", F.explode(F.array(F.array_join(F.slice("w", F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice("w", F.lit(2), F.col("size") - 1), " "))).alias("phrase"))
    most = parts.groupBy("lang", "phrase").agg(F.max("a").alias("above"))
    left = longer.join(most, ["lang", "phrase"], "left").filter(F.col("above").isNull() | (F.col("above") * 100 < F.col("a") * covered_percent))
    cuts = left.select("lang", "phrase", "size", "a", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("one"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("two"))
    known = phrases.filter("size BETWEEN 1 AND 4")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("one"), F.col("n").alias("l")), ["lang", "one"]).join(known.select("lang", F.col("phrase").alias("two"), F.col("n").alias("r")), ["lang", "two"])
    cuts = cuts.join(phrases.filter("size = 0").select("lang", "n"), "lang")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), wide("l") * wide("r"))
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def mine_collocations(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = 2000, covered_percent: int = 100, **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language by score, then count, then bytes.

    Each task ranks its own rows and passes ``top`` of a language on.
    """
    scored = score_phrases(frequent_phrases(docs, text, lang, **options), covered_percent)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
