"""Byte-pair encoding and decoding by batched numpy merge rounds.

All words that a slice of rows needs and the cache lacks are encoded together: their symbols lie in one flat
array, a round finds every word's lowest-rank pair by binary search over the sorted pair keys and merges all its
occurrences, and words without a pair left drop out.

Defined results: a null or empty text has no tokens and decodes to the empty text; repeated rows are encoded
alike; columns of the input with an output's name give way to the output.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import map_columns

#: White space of the Unicode standard (fixed values).
_SPACE = "\t-\r \x85\xa0  -     　"
#: Letters and digits of the ``regex`` package that the library's older tables don't know: other signs (fixed values).
_NEWER = (
    "0558 058B-058C 088F 0C5C 0CDC 1C89 208F 209D-209F A7CB-A7CC A7CE-A7CF A7D2 A7D4 A7DA A7DC-A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10D50-10D65 10EC5-10EC7 10ED9-10EEE 11B0A "
    "11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 "
    "1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
#: Signs that the library's older tables take for bases when they compose: marks, and one part of a pair (fixed values).
_BASES = (
    "07FD 0898-089F 08CA-08D3 09FE 0C3C 0D3B-0D3C 0EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A 11930 "
    "1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
)
#: Lower case that the library's newer tables add: code points, or first, last and the distance (fixed values).
_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_LOWER |= {c: c + by for first, last, by in ((0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B)) for c in range(first, last + 1)}


def _signs(ranges: str) -> str:
    """Ranges of code points as the inside of a pattern's set."""
    return "".join("-".join(f"\\U{int(c, 16):08X}" for c in r.split("-")) for r in ranges.split())


_OTHER = _signs(_NEWER)
#: Word forms of the word-end vocabulary (fixed pattern).
_FORMS = rf"(?V1) |'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{_OTHER}]]+|[\p{{N}}--[{_OTHER}]]|[[^{_SPACE}\p{{L}}\p{{N}}][{_OTHER}]]+"
#: str.split() would take these for white space.
_CONTROL = "[\x1c-\x1f]"
_CACHE = 400_000


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    """A vocabulary with word ends, as its JSON text; the tables are built once a task."""

    source: str

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls(f.read())


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        import re

        import regex

        read = json.loads(vocabulary.source)
        model = read["model"]
        ids: dict[str, int] = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in read["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.texts = [""] * size
        for text, i in [*ids.items(), *self.special.items()]:
            self.texts[i] = text
        self.size = size
        symbols = _byte_symbols()
        self.inner = np.array([ids[s] for s in symbols], np.int64)
        self.final = np.array([ids[s + end] for s in symbols], np.int64)
        pairs = [(ids[a], ids[b], ids[a + b]) for a, b in model["merges"]]
        made = {i: r for r, (_, _, i) in enumerate(pairs)}
        if len(made) != len(pairs) or any(max(made.get(a, -1), made.get(b, -1)) >= r for r, (a, b, _) in enumerate(pairs)):
            raise ValueError("merging all occurrences of a pair at once needs one merge for each token, after its parts")
        left, right, to = np.array(pairs, np.int64).T
        keys = left * size + right
        order = np.argsort(keys)
        self.keys, self.rank, self.to = keys[order], np.append(order, len(keys)), np.append(to[order], 0)
        both = np.concatenate([self.inner, self.final])
        self.table = self._find(np.repeat(both, 512), np.tile(both, 512)).reshape(512, 512).astype(np.int32)
        self.forms = regex.compile(_FORMS)
        self.bases, self.newer_capitals = re.compile(f"([{_signs(_BASES)}])"), re.compile("[" + "".join(map(chr, _LOWER)) + "]")
        self.control, self.spaces = re.compile(_CONTROL), re.compile(f"[{_SPACE}]+")
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where the pairs stand among the sorted pair keys; len(keys) if they have no merge."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[np.minimum(at, len(self.keys) - 1)] == key, at, len(self.keys))

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (none empty) one after another, and the number of ids of each."""
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        last = np.cumsum(lengths) - 1
        symbols = self.inner[raw]
        symbols[last] = self.final[raw[last]]
        # byte 0 to 255, or 256 to 511 at a word's end: the first round's pairs come from a table
        code = raw.astype(np.int64)
        code[last] += 256
        at = np.append(self.table[code[:-1], code[1:]], len(self.keys)).astype(np.int64)
        at[last] = len(self.keys)
        word = np.repeat(np.arange(len(words)), lengths)
        none = len(self.keys)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            # at: the merge of each symbol with its right neighbour in the word
            rank = self.rank[at]
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(symbols))))
            active = best < none
            done.append((word[~active], symbols[~active]))
            symbols, word, at, hit = symbols[active], word[active], at[active], (rank == best)[active]
            if not len(symbols):
                break
            # of overlapping occurrences (a a a) every second one merges, from the left
            where = np.arange(len(hit))
            hit &= (where - np.maximum.accumulate(np.where(hit, -1, where)) - 1) % 2 == 0
            spots = np.flatnonzero(hit)
            symbols[spots] = self.to[at[spots]]
            left = np.ones(len(symbols), bool)
            left[spots + 1] = False
            changed = hit[left]
            symbols, word, at = symbols[left], word[left], at[left]
            # only the merged symbols and those before them have new pairs
            changed[:-1] |= changed[1:]
            spots = np.flatnonzero(changed)
            after = np.minimum(spots + 1, len(symbols) - 1)
            inside = (word[spots] == word[after]) & (after > spots)
            at[spots] = np.where(inside, self._find(symbols[spots], symbols[after]), none)
        word, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        return symbols[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def _learn(self, chunks: list[str]) -> None:
        import unicodedata

        # all at once: nothing composes or matches over a space, and a lone space marks each chunk's end
        text = " ".join(chunks)
        if not text.isascii():
            text = "".join(unicodedata.normalize("NFC", part) for part in self.bases.split(text))
            if self.newer_capitals.search(text):
                text = text.translate(_LOWER)
        # lower case character by character: no final sigma
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        found = self.forms.findall(text)
        words = list({*found} - {" "})
        flat, counts = self.merge([w.encode("utf-8") for w in words])
        stream, ends = flat.astype("<u4").tobytes(), np.cumsum(counts * 4).tolist()
        ids = {w: stream[a:b] for w, a, b in zip(words, [0, *ends], ends)}  # noqa: B905
        ids[" "] = b" "
        k, parts = 0, []
        for piece in map(ids.__getitem__, found):
            if piece == b" ":
                self.cache[chunks[k]] = parts[0] if len(parts) == 1 else b"".join(parts)
                k, parts = k + 1, []
            else:
                parts.append(piece)
        self.cache[chunks[k]] = b"".join(parts)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        rows = []
        for text in texts:
            parts = [text or ""] if self.marks is None else self.marks.split(text or "")
            rows.append([p if k % 2 else (self.spaces.split(p) if self.control.search(p) else p.split()) for k, p in enumerate(parts)])
        if len(self.cache) > _CACHE:
            self.cache.clear()
        cache = self.cache
        new = [c for c in {c for row in rows for part in row if isinstance(part, list) for c in part} if c not in cache]
        if new:
            self._learn(new)
        get = cache.__getitem__
        return [b"".join([b"".join(map(get, p)) if isinstance(p, list) else self.special[p].to_bytes(4, "little") for p in row]) for row in rows]

    def decode(self, ids: bytes) -> str:
        """Token texts joined by spaces: the vocabulary's file names no decoder."""
        return " ".join(map(self.texts.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[int, Encoder] = {}


def _encoder(vocabulary: Vocabulary) -> Encoder:
    """The worker process keeps its last encoder, with the words that it has seen, for the next task."""
    key = hash(vocabulary.source)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


def encode_texts(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``ids`` (array of int) and ``decoded`` (the text of the ids)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one file of fixed size

    def make():
        encoder = _encoder(shared.value)

        def compute(texts):
            ids = encoder.encode(texts)
            return [[np.frombuffer(x, "<u4").astype(np.int32) for x in ids], [encoder.decode(x) for x in ids]]

        return compute

    return map_columns(docs, [text], "ids array<int>, decoded string", make, keep)


def token_digests(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``n_tokens``, and the SHA-256 of the ids and of the decoded text; ids and text stay in the task."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        encoder = _encoder(shared.value)

        def compute(texts):
            ids = encoder.encode(texts)
            decoded = [hashlib.sha256(encoder.decode(x).encode("utf-8")).hexdigest() for x in ids]
            return [[len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], decoded]

        return compute

    return map_columns(docs, [text], "n_tokens bigint, ids_sha256 string, decoded_sha256 string", make, keep)
