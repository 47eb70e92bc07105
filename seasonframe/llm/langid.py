"""Language identification by compression.

Each language has a zstandard raw-content dictionary of sample text. A text, in lower case, is encoded block by block
against every one, and the language whose dictionary makes it smallest altogether wins; the margin to the runner-up
tells how sure that is. Blocks are encoded apart, so that a long text meets the dictionary all along, not itself.

Defined results: a null text or one without a letter is ``und`` with score 0 and is rejected; with no learned
language every text is. Ties go to the language with more training documents, then by name, with score 0.
Repeated rows are answered alike; columns of the input with an output's name give way to the output.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, map_columns, quoted

UNKNOWN = "und"
OUTPUTS = "lang_pred string, score double, margin double, rejected boolean"
#: Bytes that are encoded at one time.
BLOCK = 512


@dataclass(frozen=True)
class LanguageProfiles:
    """Sample text by language, most frequent language first."""

    samples: dict[str, bytes]


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def learn_languages(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    trainable: Column | None = None,
    docs_per_language: int = 300,
    dictionary_bytes: int = 1 << 18,
    max_languages: int = 500,
) -> LanguageProfiles:
    """Learn from a bounded sample: whole rows of about ``dictionary_bytes`` a language.

    About ``docs_per_language`` rows a language are drawn by a hash of key and text, with a rate set by the language's
    count. Of these, in the order of the hash, each one that still fits into ``dictionary_bytes`` is taken, with its
    whole text; equal ones count once. So dictionaries are of like size, and the driver holds languages x
    ``dictionary_bytes`` at most, whatever the size of ``docs``. The key serves the draw alone.
    """
    rows = docs.filter(quoted(lang).isNotNull() & quoted(text).isNotNull())
    if trainable is not None:
        rows = rows.filter(trainable)
    counts = {r["k"]: r["n"] for r in rows.groupBy(quoted(lang).alias("k")).agg(F.count("*").alias("n")).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"{len(counts)} languages; at most {max_languages} can be learned")
    if not counts:
        return LanguageProfiles({})
    whole = 1 << 40
    cuts = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(whole, whole * docs_per_language // n + 1))])
    drawn = F.pmod(F.xxhash64(*[quoted(c) for c in (key, text) if c in docs.columns]), F.lit(whole))
    sample = rows.select(quoted(lang).alias("k"), drawn.alias("h"), F.octet_length(quoted(text)).alias("n"), quoted(text).alias("t")).filter(F.col("h") < cuts[F.col("k")])
    room = dict.fromkeys(counts, dictionary_bytes)
    taken = []
    for k, h, n in sorted(tuple(r) for r in sample.select("k", "h", "n").distinct().collect()):
        if n <= room[k]:
            room[k] -= n
            taken.append((k, h))
    chosen = docs.sparkSession.createDataFrame(taken, f"k {docs.schema[lang].dataType.simpleString()}, h long")
    buffers: dict[str, list[bytes]] = {k: [] for k in sorted(counts, key=lambda k: (-counts[k], k))}
    for r in sorted(sample.join(F.broadcast(chosen), ["k", "h"]).select("k", "h", "t").distinct().collect()):
        buffers[r["k"]].append(_bytes(r["t"]))
    return LanguageProfiles({k: b"\n".join(b) for k, b in buffers.items()})


def _classifier(profiles: LanguageProfiles, min_margin: float):
    import zstandard as z

    names = list(profiles.samples)
    encoders = []
    for sample in profiles.samples.values():
        # a dictionary that is empty, or too short for the format, is a blank
        dictionary = z.ZstdCompressionDict(sample if len(sample) >= 8 else b" " * 8, dict_type=z.DICT_TYPE_RAWCONTENT)
        parameters = z.ZstdCompressionParameters.from_level(-1, min_match=5, target_length=1, hash_log=18, window_log=20, write_content_size=False, write_dict_id=False)
        dictionary.precompute_compress(compression_params=parameters)
        encoders.append(z.ZstdCompressor(dict_data=dictionary, compression_params=parameters).compress)

    def one(text: str | None) -> tuple[str, float, float, bool]:
        if not text or not names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0, True
        data = _bytes(text)
        blocks = [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]
        sizes = [sum(map(len, map(encode, blocks))) for encode in encoders]
        first = min(range(len(sizes)), key=sizes.__getitem__)
        second = min((s for k, s in enumerate(sizes) if k != first), default=None)
        margin = 1.0 if second is None else (second - sizes[first]) / second
        return names[first], 1.0 - math.exp(-margin / 0.05), margin, margin < min_margin

    return one


def identify_languages(docs: DataFrame, profiles: LanguageProfiles, text: str = "text", keep: list[str] | None = None, min_margin: float = 0.01) -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1, from the margin), ``margin`` (relative size saved against the
    runner-up) and ``rejected`` (no letter, or a margin under ``min_margin``) to every row."""

    def make():
        one = _classifier(profiles, min_margin)
        return lambda texts: [list(c) for c in zip(*map(one, texts), strict=True)] if texts else [[]] * 4

    return map_columns(docs, [text], OUTPUTS, make, keep)


def drop_rejected(docs: DataFrame, profiles: LanguageProfiles, text: str = "text", min_margin: float = 0.01) -> DataFrame:
    """The rows whose language is found with a sufficient margin; columns as they are."""

    def make():
        one = _classifier(profiles, min_margin)
        return lambda texts: [not one(t)[3] for t in texts]

    return filter_rows(docs, text, make)
