"""Quality rules with verdicts by host.

Base rules are counted on each whole text. Failures are summed by host, the rates are shrunk towards the corpus
by a beta prior whose two parameters come from the hosts themselves (method of moments over all hosts), and a
host whose shrunken rate passes the limit loses all its documents.

Defined results: a null or empty text has no words and fails the base rules; rows with a null host are judged
by the base rules alone; with fewer than two hosts the prior is the corpus rate with the weight of ten documents;
repeated rows are all counted; columns of the input with an output's name give way to the output.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_columns, quoted

COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
#: Characters that count as symbols (fixed by the rule).
_SYMBOLS = [ord(c) for c in "#*$%&|<>"]
_SPACES = [9, 10, 11, 12, 13, 32]
_WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
BROADCAST_BYTES = 4 << 20


def _repeated_words(words: list[bytes]) -> int:
    """Words inside a window of five that occurs twice or more in the list."""
    n = len(words) - _WINDOW + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    # name pairs, then pairs of pairs: equal names mean equal windows
    name, width = code, 1
    for step in (1, 2, 1):
        tail = name if step != 1 or width == 1 else code
        wide = name[: len(words) - width - step + 1] * (len(words) + 1) + tail[width:][: len(words) - width - step + 1]
        name, width = np.unique(wide, return_inverse=True)[1], width + step
    again = np.bincount(name)[name] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    spots = np.flatnonzero(again)
    np.add.at(covered, spots, 1)
    np.add.at(covered, spots + _WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(covered[:-1])))


def _count(text: str | None) -> tuple[int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # of bytes: at the six ASCII white-space characters only
    tally = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lines = [line for line in text.split("\n") if line.strip(" \t\r\x0b\x0c")] if "\n" in text else []
    return len(words), len(text) - int(tally[_SPACES].sum()), int(tally[_SYMBOLS].sum()), len(lines) - len(set(lines)), _repeated_words(words)


def count_text_rules(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the five counts of every whole text."""

    def make():
        return lambda texts: list(zip(*map(_count, texts), strict=True)) if texts else [[]] * 5

    return map_columns(docs, [text], COUNTS, make, keep)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def host_verdicts(counted: DataFrame, host: str, max_rate: float = 0.5) -> DataFrame:
    """One row a host: documents, failures, shrunken failure rate, and whether the host passes.

    The prior's mean and weight follow from the mean and the variance of the hosts' rates; both come from sums,
    so that no host's rows meet in one task.
    """
    hosts = counted.filter(quoted(host).isNotNull()).groupBy(quoted(host).alias("host")).agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    hosts = checkpointed(hosts)
    rate = F.col("n_failed") / F.col("n_docs")
    m = hosts.agg(F.count("*").alias("hosts"), F.sum("n_failed").alias("failed"), F.sum("n_docs").alias("docs"), F.var_samp(rate).alias("var"), F.avg(1 / F.col("n_docs")).alias("inverse")).first()
    mean = (m["failed"] or 0) / max(1, m["docs"] or 0)
    spread = mean * (1 - mean)
    if m["hosts"] < 2 or not spread:
        weight = 10.0
    else:
        # between-host variance: the variance of the rates less the binomial noise expected of them
        between = max(m["var"] - spread * m["inverse"], 1e-6 * spread)
        weight = min(max(spread / between - 1, 1.0), 1e6)
    shrunken = (F.col("n_failed") + mean * weight) / (F.col("n_docs") + weight)
    return hosts.select("host", "n_docs", "n_failed", shrunken.alias("host_rate"), (shrunken <= max_rate).alias("host_passed"))


def apply_quality_rules(docs: DataFrame, text: str = "text", host: str = "source", keep: list[str] | None = None, max_rate: float = 0.5) -> DataFrame:
    """Add the counts, ``base_failed``, ``host_rate`` and ``kept`` to every row.

    Texts are counted once: the counts, and the columns to keep, are written and read twice (for the hosts, for the
    answer).
    """
    wanted = docs.columns if keep is None else keep
    used = list(dict.fromkeys([*wanted, host]))
    counted = checkpointed(count_text_rules(docs, text, used).withColumn("base_failed", base_failed()))
    verdicts = host_verdicts(counted, host, max_rate).select(F.col("host").alias("__host"), "host_rate", "host_passed")
    # a table of hosts is sent to every executor only where it is small; else the rows are shuffled by host
    if (verdicts.agg(F.sum(F.length("__host") + 32).alias("b")).first()["b"] or 0) <= BROADCAST_BYTES:
        verdicts = F.broadcast(verdicts)
    joined = counted.drop("host_rate", "kept").join(verdicts, quoted(host) == F.col("__host"), "left")
    out = joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("host_passed"), F.lit(True))).drop("__host", "host_passed")
    return out if host in wanted else out.drop(host)
