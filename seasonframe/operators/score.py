"""Scores of sources and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dims import SOURCE_SCORES


def source_score(kind: Column, scores: dict[str, float] | None = None) -> Column:
    """struct(score, explanation) of a kind of source, whatever its case; null for an unknown kind."""
    table = {k.lower(): (k, v) for k, v in (scores or SOURCE_SCORES).items()}
    entries = [F.lit(x) if not isinstance(x, tuple) else F.struct(F.lit(float(x[1])).alias("score"), F.lit(f"{x[0]}: score {x[1]:g}/100").alias("explanation")) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*entries), F.lower(kind))


def score_sources(df: DataFrame, kind: str, scores: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(scored, unknown): ``source_score`` and its explanation; the distinct kinds that have none."""
    scored = df.withColumn("__s", source_score(F.col(kind), scores))
    unknown = scored.filter(F.col("__s").isNull()).select(kind).distinct()
    return scored.withColumn("source_score", F.col("__s.score")).withColumn("score_explanation", F.col("__s.explanation")).drop("__s"), unknown


def _steps(value: Column, steps: list[tuple[int, float, str]], default: tuple[float, str]) -> tuple[Column, Column]:
    """Factor and text of the first step whose bound the value reaches."""
    factor, text = F.lit(default[0]), F.lit(default[1])
    for bound, f, t in reversed(steps):
        factor, text = F.when(value >= bound, f).otherwise(factor), F.when(value >= bound, t).otherwise(text)
    return factor, text


def entity_score(best: Column, best_name: Column, release_year: Column, n_references: Column, patent: Column, as_of_year: int) -> Column:
    """struct(score, explanation): the best source's score times factors for age, references and a patent."""
    age = F.lit(as_of_year) - release_year
    age_factor, age_text = _steps(age, [(41, 0.85, " *0.85 (>40 years old)"), (31, 0.9, " *0.9 (>30 years old)")], (1.0, " *1 (<=30 years old)"))
    age_factor, age_text = F.when(age.isNull(), 0.8).otherwise(age_factor), F.when(age.isNull(), " *0.8 (no release year)").otherwise(age_text)
    steps = [(6, 1.3), (5, 1.2), (4, 1.1), (3, 1.0), (2, 0.9)]
    reference_factor, reference_text = _steps(n_references, [(n, f, f" *{f:g}") for n, f in steps], (0.8, " *0.8"))
    base = F.coalesce(best, F.lit(1.0))
    base_text = F.when(best.isNull(), "1.0 (no collection)").otherwise(F.concat(F.regexp_replace(best.cast("string"), r"\.0$", ""), F.lit(" ("), best_name, F.lit(")")))
    score = base * age_factor * reference_factor * F.when(patent.isNotNull(), 1.2).otherwise(1.0)
    text = F.concat(base_text, age_text, reference_text, F.lit(" ("), n_references.cast("string"), F.lit(" references)"), F.when(patent.isNotNull(), " *1.2 (uspp)").otherwise(" *1.0 (no uspp number)"))
    return F.struct(score.alias("score"), text.alias("explanation"))
