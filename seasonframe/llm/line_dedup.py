"""Lines that many documents share, by one range sort of line hashes; bitmaps of the lines that stay.

A text is cut at line feeds. A line's key is the line without blanks ``[ \\t-\\r]`` at its ends, A-Z lower-cased; keys
of ``min_chars`` code points or more that ``min_documents`` documents hold lose their lines in all documents but the one
with the largest id. Everything is DataFrame code: no Python runs on the executors.

Odd input: a null or empty text is one empty line; null ids are one document, smaller than all others; rows with one id
are one document (a key in two of them counts once, and stays in all of them if the id is the largest). Columns of
any name come back untouched. An empty table gives an empty one.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, quoted

#: Lines of a document that one word of a bitmap stands for.
WORD_LINES = 64
#: Keys with at least one of so many lines are dealt out by document as well: ten thousand of them at most.
HOT_SHARE = 10_000
BLANKS = " \t\n\x0b\x0c\r"


def _text(text: str) -> Column:
    return F.coalesce(quoted(text), F.lit(""))


def line_keys(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 40) -> DataFrame:
    """(doc, mark, pos, h): a row for each line whose key is long enough; ``mark`` is the text's hash, ``h`` the key's
    128-bit digest."""
    rows = docs.select(quoted(key).alias("doc"), _text(text).alias("text"))
    low = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    lines = rows.select("doc", F.xxhash64("text").alias("mark"), F.posexplode(F.split(low, "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(BLANKS))).filter(F.length("line") >= min_chars)
    return lines.select("doc", "mark", "pos", F.unhex(F.md5("line")).alias("h"))


def hot_keys(lines: DataFrame) -> DataFrame:
    """(hot, n): hashes of keys that hold a ``HOT_SHARE``-th of all lines or more, found by a sketch of bounded size in
    one pass. They decide how rows are dealt out, and no result."""
    found = lines.agg(F.expr(f"approx_top_k(xxhash64(h), {HOT_SHARE}, {10 * HOT_SHARE})").alias("top"), F.count("*").alias("n")).first()
    hot = [(r["item"],) for r in found["top"] or [] if r["count"] * HOT_SHARE >= found["n"]]
    return lines.sparkSession.createDataFrame(hot, "hot long")


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 40, min_documents: int = 5, slices: int = 1024) -> DataFrame:
    """(doc, mark, pos) of the lines that go.

    Hashes are sorted by ranges, within them by document (largest first) and position, and streamed: a key's first line
    in each document counts that document, its very first line names the one that keeps it. The rows of a hot key are
    dealt to ``slices`` ranges by document; of those, one row a slice is added up.
    """
    lines = checkpointed(line_keys(docs, key, text, min_chars))
    hot = F.broadcast(hot_keys(lines))
    # a document has one slice: what the slices count can be added
    dealt = lines.join(hot, F.xxhash64("h") == F.col("hot"), "left")
    dealt = dealt.select("doc", "mark", "pos", "h", F.when(F.col("hot").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc"), F.lit(slices)) + 1).alias("slice"))
    ranged = dealt.repartitionByRange("h", "slice")
    group = Window.partitionBy("h", "slice")
    stream = group.orderBy(F.col("doc").desc_nulls_last(), "mark", "pos")
    new = (F.row_number().over(stream) == 1) | ~F.lag("doc").over(stream).eqNullSafe(F.col("doc"))
    seen = ranged.withColumn("new", new.cast("int")).withColumn("keeper", F.first("doc").over(stream)).withColumn("n", F.sum("new").over(group))
    # of keys that are not hot, those of too few documents go no further
    seen = checkpointed(seen.filter((F.col("slice") > 0) | (F.col("n") >= min_documents)))
    totals = seen.filter("slice > 0 AND new = 1").groupBy(F.col("h").alias("__h")).agg(F.count("*").alias("__n"), F.max("doc").alias("__keeper"))
    # a row for each hot key at most
    both = seen.join(F.broadcast(totals), (F.col("slice") > 0) & (F.col("h") == F.col("__h")), "left")
    n, keeper = F.coalesce("__n", "n"), F.when(F.col("slice") > 0, F.col("__keeper")).otherwise(F.col("keeper"))
    return both.filter((n >= min_documents) & ~F.col("doc").eqNullSafe(keeper)).select("doc", "mark", "pos")


def line_bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc, mark, n_dropped, keep) of each id and text that loses lines, and no text.

    ``keep`` is a bitmap in words of 64 lines, the lowest bit first; words in which all lines stay are left out.
    """
    gone = repeated_lines(docs, key, text, **options)
    at = F.floor(F.col("pos") / WORD_LINES).cast("int")
    bit = F.expr(f"shiftleft(1L, pos % {WORD_LINES})")
    words = gone.repartition("doc", "mark").groupBy("doc", "mark", at.alias("at")).agg(F.bit_or(bit).alias("bits"))
    kept = F.struct("at", F.bitwise_not("bits").alias("bits"))
    return words.groupBy("doc", "mark").agg(F.sum(F.bit_count("bits").cast("long")).alias("n_dropped"), F.sort_array(F.collect_list(kept)).alias("keep"))


def _joined(docs: DataFrame, bitmaps: DataFrame, key: str, text: str) -> tuple[DataFrame, list[str]]:
    """Documents under plain names, with their bitmap."""
    rows = docs.select(*[quoted(c).alias(f"c{k}") for k, c in enumerate(docs.columns)])
    key, text = f"c{docs.columns.index(key)}", f"c{docs.columns.index(text)}"
    rows = rows.withColumn("__mark", F.xxhash64(_text(text))).withColumn("__n", F.size(F.split(_text(text), "\n")).cast("long"))
    return rows.join(bitmaps, F.col(key).eqNullSafe(F.col("doc")) & (F.col("__mark") == F.col("mark")), "left"), [key, text]


def keep_bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, n_lines, n_dropped, keep), a row for each document, without its text; ``keep`` as in ``line_bitmaps``."""
    slim = docs.select(quoted(key).alias("doc"), F.xxhash64(_text(text)).alias("mark"), F.size(F.split(_text(text), "\n")).cast("long").alias("n_lines"))
    found = line_bitmaps(docs, key, text, **options).select(F.col("doc").alias("__doc"), F.col("mark").alias("__mark"), "n_dropped", "keep")
    none = F.array().cast(found.schema["keep"].dataType)
    rows = slim.join(found, F.col("doc").eqNullSafe(F.col("__doc")) & (F.col("mark") == F.col("__mark")), "left")
    return rows.select(F.col("doc").alias(key), "n_lines", F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), F.coalesce("keep", none).alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """The lines of a text that its bitmap keeps, joined by line feeds."""
    lines = F.split(text, "\n")
    found = F.map_from_entries(keep)
    n_words = F.floor((F.size(lines) + WORD_LINES - 1) / WORD_LINES).cast("int")
    # all words in an array first: a look-up for each line is then a step, not a search
    words = F.transform(F.sequence(F.lit(0), n_words - 1), lambda k: F.coalesce(F.try_element_at(found, k), F.lit(-1).cast("long")))

    def stays(line: Column, pos: Column) -> Column:
        word = F.get(words, F.floor(pos / WORD_LINES).cast("int"))
        return F.call_function("shiftright", word, pos % WORD_LINES).bitwiseAND(F.lit(1).cast("long")) == 1

    return F.array_join(F.filter(lines, stays), "\n")


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without the lines that go, with ``n_lines`` (before) and ``n_dropped``.

    A null text stays null. Bitmaps come to the documents by id and text hash; a text without a bitmap is not touched.
    """
    rows, (_, c_text) = _joined(docs, line_bitmaps(docs, key, text, **options), key, text)
    out = {c: F.col(f"c{k}") for k, c in enumerate(docs.columns) if c.lower() not in ("n_lines", "n_dropped")}
    out[text] = F.when(F.col("keep").isNull(), F.col(c_text)).otherwise(kept_text(F.col(c_text), F.col("keep")))
    return rows.select(*[c.alias(n) for n, c in out.items()], F.col("__n").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast(T.LongType()).alias("n_dropped"))
