"""A corpus pipeline of five stages: language, quality rules, near-duplicates, benchmark leaks, tokens.

Each stage takes a table of documents with any further columns, whatever their names, and all but the last return the
same columns. An empty table gives an empty one; texts are read whole, however long; a stage judges each row by itself
where its docstring says nothing else, so that repeated rows fare alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonframe.llm import bpe, decontam, host_rules, langid, simhash
from seasonframe.llm.common import checkpointed, quoted, read_table, remainder
from seasonframe.llm.queries import word_vocabulary


def _apart(docs: DataFrame, used: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a stage that adds columns: columns that it doesn't use can't clash with those, and come back alone."""
    names = {c: c if c in used else f"__column{k}" for k, c in enumerate(docs.columns)}
    out = stage(docs.select(*[quoted(c).alias(n) for c, n in names.items()]))
    return out.select(*[quoted(n).alias(c) for c, n in names.items()])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found with a sufficient margin.

    A null or empty text, one without a letter, and all texts where no row has a language, are rejected. Equal sizes
    are no margin. Null ids and sources don't matter; ``lang`` is read of rows that teach, never of those judged.
    """
    return langid.drop_rejected(docs, langid.learn_languages(docs, trainable=remainder("doc_id", 3) != 1))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules, of hosts that pass theirs.

    Null and empty texts have no words and fail. Rows with a null source pass by the base rules alone; repeated rows all
    count for their host; a host at the limit passes.
    """
    return _apart(docs, ("doc_id", "text", "source"), lambda d: host_rules.apply_quality_rules(d).filter(F.col("kept")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id.

    Null and empty texts are one group. A null id comes after all others; of several texts with the smallest id that
    with the smallest hash stays, of repeated rows one.
    """
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts hold none, and null or empty items are in none. Rows with a null id are judged like others.
    """
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, one row a document.

    A null text is empty: no tokens, and the digests of nothing. Null and repeated ids stay.
    """
    return bpe.token_digests(docs, word_vocabulary(), keep=["doc_id"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("tokenize", tokenize),
]

#: Models, components and tokens have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; what a stage leaves is written before the next one reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs
