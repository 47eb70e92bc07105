"""Benchmark decontamination under edit distance.

Words of items and documents become codes. The CGK random walk turns a word sequence into an embedding whose
Hamming distance follows the edit distance: at step j it puts out the word under a pointer, and a random bit of
(j, word) moves the pointer on or not, so that two walks soon fall in step again after an edit. Every word of a
document starts a window of each item's size; a repetition of the bit-sampling LSH compares a few sampled outputs
of the walk with those of all items. Repetitions differ in walk, samples and the item's part that they start
from, and their number is set by a target recall on randomly edited copies of the items, which every level of
similar lengths has to reach. Items of a level that doesn't, and items that sit out more than half of the
repetitions, are looked up by n-grams, without loss: of one part more than an item may have edits, one is in the
passage as it is. Candidates are then verified by the exact edit distance of the item to the best-placed passage
around the window.

A document is contaminated by an item if some passage of it is within ``max_edits`` (a share of the item's words)
of the item; words are compared in lower case and without ASCII punctuation.

Defined results: null and empty texts have no match; items that are null or have fewer than ``min_words`` words
are not searched for; of several passages of one item in a document the one with the fewest edits, then the first,
is reported; repeated rows and items, and rows with a null key, are each reported; empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_ROWS, filter_rows, quoted

_KEEP = bytes(c if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SPANS = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_SAMPLES = 3
_GROWTH = 1.5
_COPIES = 500
_GRAM = 8
_CELLS = 1 << 21


def _words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_KEEP).split()


@dataclass(frozen=True)
class _Group:
    """Items of similar length in one repetition: where the walk starts in them, its samples, the codes of theirs."""

    offset: int
    steps: tuple[int, ...]  # increasing; the first is the same for all groups of a repetition
    first: np.ndarray  # sorted codes of the first two samples
    codes: np.ndarray  # sorted codes of all samples, and the items with them
    items: np.ndarray


class EditIndex:
    """Items as codes, and the repetitions of the LSH over them."""

    def __init__(self, texts: list[str], max_edits: float = 0.2, min_words: int = 1, recall: float = 0.98, max_repetitions: int = 32, seed: int = 5):
        rng = np.random.default_rng(seed)
        split = [_words(t or "") for t in texts]
        self.used = [k for k, w in enumerate(split) if len(w) >= min_words]
        self.ids: dict[bytes, int] = {}
        self.items = [np.array([self.ids.setdefault(w, len(self.ids)) for w in split[k]], np.int64) for k in self.used]
        self.other = len(self.ids)  # any word that no item has
        self.size = self.other + 1
        self.lengths = np.array([len(x) for x in self.items], np.int64)
        self.edits = np.floor(self.lengths * max_edits).astype(np.int64)
        self.gap = int(self.edits.max(initial=0)) + 1
        self.repetitions: list[tuple[np.ndarray, list[_Group]]] = []
        self.exact = np.empty(0, np.int64)  # items that are looked up by n-grams
        self.grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        if not self.items:
            return
        level = np.floor(np.log(self.lengths) / np.log(_GROWTH)).astype(np.int64)
        # edited copies of each level's items between unknown words, as in a document
        picked = np.concatenate([rng.choice(np.flatnonzero(level == g), _COPIES) for g in np.unique(level)])
        copies = [np.append(self._edited(rng, int(k)), self.size) for k in picked]
        true = np.cumsum([0, *map(len, copies[:-1])]) + self.gap
        text = np.concatenate(copies)
        seen, left = np.zeros(len(picked), bool), np.unique(level)
        # above the target by two standard errors of the measure
        enough = min(1.0, recall + 2 * np.sqrt(recall * (1 - recall) / _COPIES))
        made, had = np.zeros(len(self.items), np.int64), np.zeros(len(self.items), np.int64)
        for r in range(max_repetitions):
            self.repetitions.append(self._repetition(rng, level, (0.0, 0.3, 0.5)[r % 3], left))
            made[np.isin(level, left)] += 1
            for group in self.repetitions[-1][1]:
                had[group.items] += 1
            start, item = self.candidates(text, self.repetitions[-1:])
            spot = np.searchsorted(true, start + self.edits[item], "right") - 1
            near = (spot >= 0) & (picked[spot] == item) & (np.abs(start - true[spot]) <= self.edits[item])
            seen[spot[near]] = True
            left = np.array([g for g in left if seen[level[picked] == g].mean() < enough], np.int64)
            if not len(left):
                break
        #: recall by level of the lengths, as measured; 1 for levels that are looked up
        self.estimated_recall = {int(g): 1.0 if g in left else float(seen[level[picked] == g].mean()) for g in np.unique(level)}
        self.exact = np.flatnonzero(np.isin(level, left) | (2 * had < made))
        useful = [(walk, [g for g in groups if not np.isin(g.items, self.exact).all()]) for walk, groups in self.repetitions]
        self.repetitions = [r for r in useful if r[1]]
        found: dict[int, list[tuple[int, int, int]]] = {}
        for k in self.exact.tolist():
            cuts = np.linspace(0, self.lengths[k], int(self.edits[k]) + 2).astype(int).tolist()
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                n = min(hi - lo, _GRAM)
                if n:
                    found.setdefault(n, []).append((int(self._gram(self.items[k][lo : lo + n], n)[0]), k, lo))
        self.grams = {n: tuple(np.array(sorted(rows), np.int64).T) for n, rows in sorted(found.items())}

    def _gram(self, words: np.ndarray, n: int) -> np.ndarray:
        """A number for each n words in a row; equal words have equal numbers."""
        code = np.zeros(max(len(words) - n + 1, 0), np.uint64)
        for k in range(n if len(code) else 0):
            code = (code ^ words[k : k + len(code)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
        return code.view(np.int64)

    def _edited(self, rng: np.random.Generator, k: int) -> np.ndarray:
        words = self.items[k].tolist()
        for _ in range(int(rng.integers(0, self.edits[k] + 1))):
            at, kind = int(rng.integers(0, max(1, len(words)))), int(rng.integers(0, 3))
            words[at : at + (kind != 0)] = [self.other] * (kind != 1)
        return np.array([*[self.other] * self.gap, *words, *[self.other] * (self.gap + len(words))], np.int64)

    def _repetition(self, rng: np.random.Generator, level: np.ndarray, start: float, left: np.ndarray) -> tuple[np.ndarray, list[_Group]]:
        first = int(rng.integers(0, 4))
        chosen = []
        for g in left:
            members = np.flatnonzero(level == g)
            least = int(self.lengths[members].min())
            offset = int(start * least)
            # the second sample soon after the first, which ends most searches early; the others spread over the rest
            room = max(int(1.6 * (least - offset)) - first, 3 * _SAMPLES)
            second = int(rng.integers(3, 6))
            rest = np.linspace(second, room, _SAMPLES - 1)
            steps = (first, first + second, *(first + 3 + int(rng.integers(a, b)) for a, b in zip(rest[:-1], rest[1:], strict=True)))
            chosen.append((members, offset, steps))
        walk = rng.integers(0, 2, (max(s[-1] for _, _, s in chosen) + 1, self.size + 1)).astype(np.int64)
        walk[:, self.size] = 0  # no walk leads from one document into the next
        groups = []
        for members, offset, steps in chosen:
            codes, pairs, items = [], [], []
            for k in members:
                # one past the vocabulary: the item has ended, and its sample can't be met
                word = np.append(self.items[k][offset:], np.full(steps[-1] + 1, self.size))
                at, out, places = 0, [], set()
                for j in range(steps[-1] + 1):
                    if j in steps:
                        out.append(int(word[at]))
                        places.add(at)
                    at += int(walk[j, word[at]])
                # samples of one and the same word tell too little: the item sits this repetition out
                if self.size not in out and len(places) == _SAMPLES:
                    pairs.append(out[0] * self.size + out[1])
                    codes.append(self._code(out))
                    items.append(k)
            order = np.argsort(codes, kind="stable") if codes else np.empty(0, np.int64)
            groups.append(_Group(offset, steps, np.unique(np.array(pairs, np.int64)), np.array(codes, np.int64)[order], np.array(items, np.int64)[order]))
        return walk, groups

    def _code(self, words: list[int]) -> int:
        total = 0
        for w in words:
            total = total * self.size + w
        return total

    def candidates(self, words: np.ndarray, repetitions=None) -> tuple[np.ndarray, np.ndarray]:
        """Starts of windows, and the items that the windows may be near to."""
        starts, items = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        reach = max((len(walk) for walk, _ in self.repetitions), default=0)
        padded = np.append(words, np.full(reach + 1, self.size)).astype(np.int32)
        for walk, groups in self.repetitions if repetitions is None else repetitions:
            step = groups[0].steps[0]
            at = np.arange(len(words))
            for j in range(step):
                at += walk[j].take(padded.take(at))
            # a bit for each group that has an item with this first sample
            begins = np.zeros(self.size + 1, np.int32)
            for bit, g in enumerate(groups):
                begins[np.unique(g.first // self.size)] |= 1 << bit
            word = padded.take(at)
            begun = begins.take(word)
            for bit, g in enumerate(groups):
                window = np.flatnonzero(begun & (1 << bit))
                if not len(window):
                    continue
                here, code = at.take(window), word.take(window).astype(np.int64)
                for k in range(1, _SAMPLES):
                    for j in range(g.steps[k - 1], g.steps[k]):
                        here += walk[j].take(padded.take(here))
                    code = code * self.size + padded.take(here)
                    known = g.first if k == 1 else g.codes
                    spot = np.searchsorted(known, code)
                    hit = known.take(spot, mode="clip") == code
                    window, here, code = window[hit], here[hit], code[hit]
                if len(window):
                    lo, hi = np.searchsorted(g.codes, code, "left"), np.searchsorted(g.codes, code, "right")
                    n = hi - lo
                    starts.append(np.repeat(window - g.offset, n))
                    items.append(g.items[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())])
        for n, (known, of, offset) in self.grams.items() if repetitions is None else ():
            code = self._gram(words, n)
            lo, hi = np.searchsorted(known, code, "left"), np.searchsorted(known, code, "right")
            window = np.flatnonzero(hi > lo)
            lo, count = lo[window], (hi - lo)[window]
            spot = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
            starts.append(np.repeat(window, count) - offset[spot])
            items.append(of[spot])
        start, item = np.concatenate(starts), np.concatenate(items)
        if len(start):
            both = np.unique(np.stack([start, item], axis=1), axis=0)
            start, item = both[:, 0], both[:, 1]
        return start, item

    def verify(self, words: np.ndarray, start: np.ndarray, item: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, start, end, item, edits) of the passages within an item's edits, near the candidates' windows.

        Document ``row`` has the words from ``first`` to ``last``. A window is verified in each document that it
        touches, with that document's words alone, so that neighbours don't matter.
        """
        found = []
        level = np.floor(np.log(self.lengths) / np.log(_GROWTH)).astype(np.int64)
        for g in np.unique(level[item]):
            longest, slack = int(self.lengths[level == g].max()), int(self.edits[level == g].max())
            at, k = start[level[item] == g], item[level[item] == g]
            lo = np.searchsorted(last, at - slack, "right")
            n = np.maximum(np.searchsorted(first, at + longest + slack, "left") - lo, 0)
            row = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            at, k = np.repeat(at, n), np.repeat(k, n)
            # a few million cells at one time, however long the items are
            size = min(4096, max(1, _CELLS // (longest + 2 * slack)))
            for part in (slice(p, p + size) for p in range(0, len(row), size)):
                found.append(self._align(words, at[part], k[part], row[part], first, last, longest, slack))
        if not found:
            return tuple(np.empty(0, np.int64) for _ in range(5))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _align(self, words: np.ndarray, start: np.ndarray, item: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray, longest: int, slack: int) -> tuple[np.ndarray, ...]:
        width = longest + 2 * slack
        place = start[:, None] - slack + np.arange(width)
        inside = (place >= first[row][:, None]) & (place < last[row][:, None])
        text = np.where(inside, words[np.clip(place, 0, len(words) - 1)], self.other)
        pattern = np.full((len(item), longest), -1, np.int64)
        for spot, k in enumerate(item):
            pattern[spot, : self.lengths[k]] = self.items[k]
        # column c: the edits of the item's first words against the best passage that ends before column c, and
        # where that passage begins; edits and beginning are one number, so that the minimum keeps both
        step = np.int64(1 << 20)
        # what it costs to take a word into the passage that the item lacks: more than any item has for a word
        # outside the document
        cost = np.where(inside, step, step << 20)
        run = np.append(np.zeros((len(item), 1), np.int64), np.cumsum(cost, axis=1), axis=1)
        best = np.broadcast_to(np.arange(width + 1), (len(item), width + 1)).astype(np.int64)
        result = best.copy()
        for i in range(longest):
            new = np.empty_like(best)
            new[:, 0] = best[:, 0] + step
            new[:, 1:] = np.minimum(best[:, :-1] + cost * (text != pattern[:, i : i + 1]), best[:, 1:] + step)
            new = np.minimum.accumulate(new - run, axis=1) + run
            best = new
            ended = self.lengths[item] == i + 1
            result[ended] = best[ended]
        end = np.argmin(result, axis=1)
        value = result[np.arange(len(item)), end]
        edits, begin = value // step, value % step
        near = edits <= self.edits[item]
        base = start - slack
        return row[near], (base + begin)[near], (base + end)[near], item[near], edits[near]


def _search(index: EditIndex, texts: list[str | None]) -> list[tuple[int, int, int, int, int, int]]:
    """(row, item, edits, words, start, end) of each item in each text, start and end in characters."""
    if not index.items:
        return []
    # between two documents: a gap of each, and a word that stops the walks
    gap = np.full(2 * index.gap + 1, index.other)
    gap[index.gap] = index.size
    pieces, first, last, at = [gap], [], [], len(gap)
    get, other = index.ids.get, index.other
    for text in texts:
        words = _words(text) if text else []
        pieces += [np.fromiter(map(get, words, repeat(other)), np.int64, len(words)), gap]
        first.append(at)
        last.append(at + len(words))
        at += len(words) + len(gap)
    words = np.concatenate(pieces)
    found = index.verify(words, *index.candidates(words), np.array(first, np.int64), np.array(last, np.int64))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for row, start, end, item, edits in zip(*(x.tolist() for x in found), strict=True):
        key, value = (row, item), (edits, start - first[row], end - first[row])
        if key not in best or value < best[key]:
            best[key] = value
    out = []
    for (row, item), (edits, start, end) in sorted(best.items()):
        spans = [m.span() for m in _SPANS.finditer(texts[row])]
        if start < end:
            out.append((row, index.used[item], edits, int(index.lengths[item]), spans[start][0], spans[end - 1][1]))
    return out


def _indexes(texts: DataFrame, block_bytes: int, pass_blocks: int, options: dict) -> Iterator[list[tuple[EditIndex, list[str]]]]:
    """The distinct item texts (column ``t``) in blocks of about ``block_bytes``, ``pass_blocks`` of them at a time."""
    texts = texts.filter(F.col("t").isNotNull()).distinct()
    blocks = (texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // block_bytes + 1
    block = F.pmod(F.xxhash64("t"), F.lit(blocks))
    for start in range(0, blocks, pass_blocks):
        indexes = []
        for b in range(start, min(start + pass_blocks, blocks)):
            items = sorted(r["t"] for r in texts.filter(block == b).collect())
            indexes.append((EditIndex(items, **options), [hashlib.sha1(t.encode("utf-8", "surrogatepass")).hexdigest() for t in items]))
        yield indexes


def find_contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_bytes: int = 4 << 20, pass_blocks: int = 8, **options) -> DataFrame:
    """One row for each document and item found in it: the keys, ``edits``, ``item_words``, and the passage's
    ``start`` and ``end`` in characters. A document key with the name of another output is called
    ``document_`` and that name; ``options``: see ``EditIndex``.

    Distinct item texts are sent to every task in blocks of about ``block_bytes``, ``pass_blocks`` of them for one
    pass over the documents. Items with equal texts meet their text's matches afterwards, by its SHA-1.
    """
    items = benchmark.select(quoted(item_key).alias("k"), quoted(item_text).alias("t"))
    rows = docs.select(quoted(key).alias("k"), quoted(text).alias("t"))
    schema = T.StructType([T.StructField("k", docs.schema[key].dataType), T.StructField("item", T.StringType()), *T._parse_datatype_string("edits int, item_words int, start int, end int").fields])
    result = None
    for indexes in _indexes(items.select("t"), block_bytes, pass_blocks, options):
        shared = docs.sparkSession.sparkContext.broadcast(indexes)
        found = rows.mapInArrow(_searcher(shared, schema), schema)
        result = found if result is None else result.unionByName(found)
    named = items.filter(F.col("t").isNotNull()).select(F.col("k").alias("__item"), F.sha1(F.col("t").cast("binary")).alias("item"))
    rest = ["edits", "item_words", "start", "end"]
    name = f"document_{key}" if key.lower() in (item_key.lower(), *rest) else key
    return result.join(named, "item").select(F.col("k").alias(name), F.col("__item").alias(item_key), *rest)


def _searcher(shared, schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        made = to_arrow_schema(schema)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                texts = batch.column(1).to_pylist()
                for index, digests in shared.value:
                    found = _search(index, texts)
                    if found:
                        row, item, *rest = zip(*found, strict=True)
                        columns = [batch.column(0).take(pa.array(row)), pa.array([digests[i] for i in item])]
                        yield pa.RecordBatch.from_arrays(columns + [pa.array(c, pa.int32()) for c in rest], names=made.names)

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_text: str = "text", block_bytes: int = 4 << 20, pass_blocks: int = 8, **options) -> DataFrame:
    """The rows without any match; a row is judged by its own text, whatever its key.

    Texts are not shuffled: rows pass through the search and those with a match stay behind.
    """
    for indexes in _indexes(benchmark.select(quoted(item_text).alias("t")), block_bytes, pass_blocks, options):
        docs = filter_rows(docs, text, _cleaner(docs.sparkSession.sparkContext.broadcast([i for i, _ in indexes])))
    return docs


def _cleaner(shared):
    def make():
        def clean(texts: list[str | None]) -> list[bool]:
            dirty = {f[0] for index in shared.value for f in _search(index, texts)}
            return [k not in dirty for k in range(len(texts))]

        return clean

    return make
