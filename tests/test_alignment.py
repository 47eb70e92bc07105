"""Days of anchors: against a direct solution."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasonframe.operators import align, graph


def direct(rows):
    """The least-squares days of (place, anchor, day) over all pairs of a place, by a dense solver; least day 0."""
    names = sorted({a for _, a, _ in rows})
    at = {a: k for k, a in enumerate(names)}
    by_place = {}
    for p, a, d in rows:
        by_place.setdefault(p, []).append((at[a], d))
    matrix, right = np.zeros((len(names), len(names))), np.zeros(len(names))
    for members in by_place.values():
        k = len(members)
        for i, d in members:
            matrix[i, i] += k
            right[i] += k * d - sum(x for _, x in members)
            for j, _ in members:
                matrix[i, j] -= 1
    x = np.linalg.lstsq(matrix, right, rcond=None)[0]
    return {a: v - x.min() for a, v in zip(names, x, strict=True)}


def table(spark, rows):
    return spark.createDataFrame([(p, "T", a, d) for p, a, d in rows], "place long, type string, name string, start int").withColumn("offset", F.lit(0))


def anchors_of(df):
    return df.select(F.col("type").alias("anchor_type"), F.col("name").alias("anchor_name")).distinct()


def test_many_anchors_in_components(spark):
    """Five thousand anchors; two components of all sizes, one of them with a place that holds a third of all rows."""
    rng = random.Random(3)
    rows, want = [], {}
    for c, size in enumerate((2500, 1700, 797, 2, 1)):
        names = [f"c{c}-{k:05d}" for k in range(size)]
        true = {a: rng.randint(0, 200) for a in names}
        seen = {(c * 100_000 + rng.randrange(max(1, size // 2)), a) for a in names for _ in range(3)}
        # a chain keeps the component whole; a place of its own for each link
        seen |= {(c * 100_000 + 50_000 + k, a) for k in range(size - 1) for a in names[k : k + 2]}
        if c == 1:
            seen |= {(199_999, a) for a in names}
        mine = [(p, a, true[a] + p % 17 + rng.randint(-3, 3)) for p, a in sorted(seen)]
        rows += mine
        if size > 1:
            want[c] = direct(mine)
    df = table(spark, rows)
    found = align.align_anchors(df, anchors_of(df)).collect()
    assert len(found) == 4999 and len({r["component"] for r in found}) == 4
    for r in found:
        assert r["day"] == int(want[int(r["name"][1])][r["name"]] + 1e-6)
    assert align.largest_component(spark.createDataFrame(found)).count() == 2500


def test_residual_is_reported(spark):
    rows = [(p, f"a{k}", 3 * k + p * (k % 3)) for p in range(9) for k in range(p, p + 4)]
    df = table(spark, rows)
    with pytest.raises(RuntimeError, match="residual"):
        align.align_anchors(df, anchors_of(df), max_steps=1).collect()


def test_exact_differences_and_odd_rows(spark):
    """Days that agree are found exactly; null places and starts, repeated rows and lone anchors change nothing."""
    rows = [(1, "x", 10), (1, "y", 15), (2, "y", 40), (2, "z", 47), (3, "w", 9)]
    df = table(spark, rows + rows + [(None, "x", 1), (None, "w", 80), (4, "w", None)])
    got = {r["name"]: r["day"] for r in align.align_anchors(df, anchors_of(df)).collect()}
    assert got == {"x": 0, "y": 5, "z": 12}
    assert align.align_anchors(df.limit(0), anchors_of(df)).collect() == []


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1500)] + [(k, k + 1) for k in range(5000, 5400)] + [(7000, k) for k in range(7001, 7500)] + [(9, 9), (None, 4)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    found = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: root(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []
