"""Quality scores from document statistics by kernel ridge regression.

Statistics of each whole text are standardised and mapped by random Fourier features, whose inner products
approximate a Gaussian kernel. Every partition sums its part of the normal equations, Spark adds the parts up,
and the driver solves one system of a few hundred unknowns. Isotonic regression on rows kept out of that fit turns
the raw score into a probability.

Defined results: a null or empty text has all statistics zero and is scored like any other; without labels of both
classes every score is the share of label 1 (0.5 without any label); a key with several labels counts with the
largest; repeated rows score alike; columns of the input with an output's name give way to the output.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_columns, quoted

#: What a byte is, for the shares of a text's bytes.
_CLASSES = (
    b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b".,;:?'\"()-",
    b"!",
    b"#*$%&<>@^_=+~`\\/{}[]",
    b"|",
    b"\n",
    bytes(range(128, 256)),
)
N_STATS = len(_CLASSES) + 9
_BIN = 1000.0


def _class_table() -> np.ndarray:
    table = np.zeros((256, len(_CLASSES)))
    for k, chars in enumerate(_CLASSES):
        table[list(chars), k] = 1
    return table


_TABLE = _class_table()


def text_statistics(text: str | None) -> np.ndarray:
    """Statistics of a whole text; all zero without a word."""
    out = np.zeros(N_STATS)
    data = text.encode("utf-8", "surrogatepass") if text else b""
    words = data.split()
    if not words:
        return out
    n = len(words)
    lines = [line for line in data.split(b"\n") if line]
    lengths = np.fromiter(map(len, words), np.int64, n)
    k = len(_CLASSES)
    out[:k] = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _TABLE / len(data)
    distinct = len(set(words))
    out[k:] = (
        np.log1p(n),
        lengths.mean(),
        np.log1p(lengths.max()),
        distinct / n,
        np.log(distinct) / np.log(n + 1),
        sum(map(operator.eq, words, words[1:])) / n,
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        sum(line.rstrip().endswith((b".", b"!", b"?", b'"')) for line in lines) / len(lines),
    )
    return out


def document_statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``stats``, an array of the statistics of the whole text."""
    return map_columns(docs, [text], "stats array<double>", lambda: lambda texts: [[text_statistics(t) for t in texts]], keep)


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # raw scores and
    levels: np.ndarray  # their calibrated values

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        wave = np.sqrt(2 / len(self.phases)) * np.cos(x @ self.frequencies + self.phases)
        return np.concatenate([wave, np.ones((len(x), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.raw(stats)
        # a thousandth of the raw order keeps rows apart that isotonic regression sets equal
        return 0.999 * np.interp(raw, self.steps, self.levels) + 0.001 / (1 + np.exp(-raw))


def isotonic(score: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; scores ascending. The middles of the pools and their values."""
    pools: list[list[float]] = []
    for s, m, w in zip(score, mean, weight, strict=True):
        pools.append([s * w, m * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    total = np.array(pools)
    return total[:, 0] / total[:, 2], total[:, 1] / total[:, 2]


def _stack(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def train_quality(stats: DataFrame, labels: DataFrame, trainable: Column | None = None, key: str = "doc_id", label: str = "quality", waves: int = 160, length_scale: float = 3.0, ridge: float = 1e-3, seed: int = 11) -> QualityModel:
    """Fit on all labelled rows of ``stats`` (from ``document_statistics``).

    One row in four, by a hash of the key, calibrates; the rest fits the weights. The driver gets sums only: the
    system of waves + 1 unknowns and at most ten thousand score bins.
    """
    rng = np.random.default_rng(seed)
    frequencies = rng.normal(0, 1 / length_scale, (N_STATS, waves))
    phases = rng.uniform(0, 2 * np.pi, waves)
    known = labels.filter(quoted(label).isNotNull() & quoted(key).isNotNull())
    if trainable is not None:
        known = known.filter(trainable)
    known = known.groupBy(quoted(key).alias("__key")).agg(F.max(quoted(label)).cast("double").alias("y"))
    rows = stats.select(quoted(key).alias("key"), "stats").join(known, F.col("key") == F.col("__key"))
    rows = checkpointed(rows.select("stats", "y", (F.pmod(F.xxhash64("key", F.lit("calibrate")), F.lit(4)) == 0).alias("held")))
    moments = rows.agg(F.count("*"), F.avg("y"), *[f(F.col("stats")[k]) for k in range(N_STATS) for f in (F.avg, F.stddev_pop)]).first()
    n, share = moments[0], moments[1]
    flat = np.array([0.0 if v is None else v for v in moments[2:]]).reshape(-1, 2)
    scale = np.where(flat[:, 1] > 1e-9, flat[:, 1], 1.0)

    def model(weights=None, steps=(0.0,), levels=(0.5 if share is None else share,)) -> QualityModel:
        weights = np.zeros(waves + 1) if weights is None else weights
        return QualityModel(flat[:, 0], scale, frequencies, phases, weights, np.array(steps), np.array(levels))

    if not n or share in (0.0, 1.0):
        return model()
    plain = model()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((waves + 1, waves + 2))
        for batch in batches:
            if batch.num_rows:
                z = plain.features(_stack(batch.column(0)))
                total += z.T @ np.concatenate([z, batch.column(1).to_numpy()[:, None]], axis=1)
        if total.any():
            i, j = np.triu_indices(waves + 1, 0, waves + 2)
            yield pa.RecordBatch.from_arrays([pa.array(i * (waves + 2) + j), pa.array(total[i, j])], names=["cell", "value"])

    def bins(weights: np.ndarray, part: DataFrame) -> list:
        fitted = model(weights)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    raw = np.clip(fitted.raw(_stack(batch.column(0))), -5, 5)
                    yield pa.RecordBatch.from_arrays([pa.array(np.floor(raw * _BIN).astype(np.int64)), pa.array(raw), batch.column(1)], names=["bin", "raw", "y"])

        found = part.select("stats", "y").mapInArrow(score, "bin bigint, raw double, y double")
        return sorted(found.groupBy("bin").agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count("*").alias("n")).collect(), key=lambda r: r["bin"])

    fit, held = rows.filter(~F.col("held")), rows.filter("held")
    cells = fit.select("stats", "y").mapInArrow(sums, "cell bigint, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    if not cells:
        return model()
    system = np.zeros((waves + 1) * (waves + 2))
    system[[r["cell"] for r in cells]] = [r["value"] for r in cells]
    system = system.reshape(waves + 1, waves + 2)
    left = np.triu(system[:, :-1])
    left = left + left.T - np.diag(np.diag(left))
    weights = np.linalg.solve(left + ridge * n * np.eye(waves + 1) / (waves + 1), system[:, -1])
    found = bins(weights, held) or bins(weights, fit)
    steps, levels = isotonic(*(np.array([r[c] for r in found], float) for c in ("raw", "y", "n")))
    return model(weights, steps, levels)


def score_quality(stats: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """Replace ``stats`` by ``score`` and ``predicted`` (1 from ``threshold`` on)."""
    shared = stats.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers a statistic

    def make():
        def compute(rows):
            score = shared.value.score(np.array(rows, float).reshape(len(rows), N_STATS))
            return [score, (score >= threshold).astype(np.int32)]

        return compute

    return map_columns(stats, ["stats"], "score double, predicted int", make).drop("stats")
