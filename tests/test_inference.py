"""The inference against a plain model of its rules, row by row."""

import os
import random
import time
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from seasonframe.functions import dims
from seasonframe.lineage import shared_folder
from seasonframe.operators import infer
from seasonframe.plans import queries
from seasonframe.plans.registry import Star

SCHEMA = "id int, place int, type string, name string, start int, ref_type string, ref_name string, days int, score double, devalue double"
ANCHORS = {"Peach": ("Peach", "Redhaven"), "Nectarine": ("Peach", "Redhaven"), "Apple": ("Apple", "Red Delicious")}


def model(rows, rounds=10):
    """(id -> (offset, round), (type, name) -> offset, the rounds that ran)."""
    calc, entity, ran = {}, {(r[2], r[3]): None for r in rows}, 0
    names = set(ANCHORS.values())
    for i, _, kind, name, _, ref_type, ref_name, days, _, _ in rows:
        if ANCHORS.get(kind) == (kind, name):
            calc[i] = (0, 0.0, (kind, name))
        if ref_name and (ref_type or kind, ref_name) in names:
            calc[i] = (days, 0.0, (ref_type or kind, ref_name))
    for r in range(1, rounds + 1):
        ran, changed, before = r, False, dict(calc)
        for i, place, kind, _, start, *_ in rows:
            anchor = ANCHORS.get(kind)
            if i in before or start is None or place is None or anchor is None:
                continue
            there = sorted((x[0], x) for x in rows if x[1] == place and (x[2], x[3]) == anchor and x[4] is not None and x[0] in before)
            tied = sorted((before[x[0]][1], x[0], x) for x in rows if x[1] == place and x[4] is not None and x[0] in before and before[x[0]][2] == anchor)
            best = there[0][-1] if there else tied[0][-1] if tied else None
            if best is not None:
                calc[i] = (start - best[4] + before[best[0]][0], r if there else r + 0.1, before[best[0]][2])
                changed = True
        before = dict(calc)
        for i, place, _, _, _, ref_type, ref_name, days, _, _ in rows:
            if i in before or ref_name is None or place is None:
                continue
            same = sorted((before[x[0]][1], x[0], x) for x in rows if x[1] == place and x[0] in before and x[6] == ref_name and x[5] == ref_type)
            if same:
                x = same[0][-1]
                calc[i] = (before[x[0]][0] + days - x[7], float(r), before[x[0]][2])
                changed = True
        for i, _, kind, _, _, ref_type, ref_name, days, _, _ in rows:
            if i not in calc and ref_name is not None and entity.get((ref_type or kind, ref_name)) is not None:
                calc[i] = (entity[ref_type or kind, ref_name] + days, r + 0.95, ANCHORS[ref_type or kind])
                changed = True
        done = dict(calc)
        for kind, name in entity:
            own = [(done[x[0]], x) for x in rows if (x[2], x[3]) == (kind, name) and x[0] in done and done[x[0]][2] == ANCHORS.get(kind)]
            if own and (r == 1 or any(c[1] >= r for c, _ in own)):
                weights = [x[8] * 2.0 ** -(c[1] + (x[9] or 0)) for c, x in own]
                mean = sum(w * c[0] for w, (c, _) in zip(weights, own)) / sum(weights)
                entity[kind, name] = int(abs(mean) + 0.5) * (1 if mean > 0 else -1)
                changed = True
                for x in rows:
                    if (x[2], x[3]) == (kind, name) and x[0] not in calc:
                        calc[x[0]] = (entity[kind, name], r + 0.9, ANCHORS[kind])
        if not changed:
            break
    return {i: c[:2] for i, c in calc.items()}, entity, ran


def infer_rows(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("score", "source_score").withColumn("source", F.col("id").cast("string"))
    text = F.concat(F.coalesce(F.concat("ref_type", F.lit(": ")), F.lit("")), "ref_name", F.format_string(" %+d", "days"))
    return infer.infer_offsets(df.withColumn("relative", F.when(F.col("ref_name").isNotNull(), text)), dims.anchors(spark), **options)


def row(i, place, kind, name, start=None, ref=None, days=None, score=100.0, devalue=None, ref_type=None):
    return (i, place, kind, name, start, ref_type, ref, days, score, devalue)


LATE = [
    row(1, 1, "Apple", "Red Delicious", 280), row(2, 1, "Apple", "Foo", 290),
    row(3, 9, "Peach", "Bar", 200, "Foo", 3, ref_type="Apple"), row(4, 9, "Apple", "Baz", 210), row(5, None, "Apple", "Foo", 1), row(6, None, "Apple", "Foo"),
]


def test_a_round_without_a_new_consensus_is_not_the_last(spark):
    """Round 2 resolves Bar alone, whose offset is from another type's anchor; round 3 needs it."""
    found = {r["id"]: (r["offset"], r["round"]) for r in infer_rows(spark, LATE)[0].collect()}
    assert found == {1: (0, 0.0), 2: (10, 1.0), 3: (13, 2.95), 4: (23, 3.1), 5: (10, 1.9), 6: (10, 1.9)} == {**model(LATE)[0]}


def made(seed):
    rng = random.Random(seed)
    names = {"Peach": ["Redhaven", "A", "B", "C", "D", "E"], "Apple": ["Red Delicious", "F", "G", "H", "I"], "Nectarine": ["J", "K"], "Fig": ["L"]}
    rows, used = [], set()
    for i in range(60):
        kind = rng.choice(["Peach", "Peach", "Peach", "Apple", "Apple", "Nectarine", "Fig"])
        place, name = rng.choice([None, *range(9)]), rng.choice(names[kind])
        if place is not None and (place, kind, name) in used or (rng.random() < 0.8 and name.startswith("Red")):
            continue
        used.add((place, kind, name))
        ref_type = rng.choice([None, None, "Peach", "Apple"])
        ref = rng.choice(names[ref_type or kind]) if rng.random() < 0.4 else None
        rows.append(row(i, place, kind, name, rng.randint(100, 300) if rng.random() < 0.5 else None, ref, rng.randint(-20, 20) if ref else None, rng.choice([100.0, 50.0, 7.0]), rng.choice([None, 1.0]), ref_type if ref else None))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_inference_against_the_model(spark, seed):
    rows = [(1000 * k + r[0], None if r[1] is None else 100 * k + r[1], *(f"{v}{k}" if j in (3, 6) and v and not v.startswith("Red") else v for j, v in enumerate(r) if j > 1)) for k in range(6) for r in made(10 * seed + k)]
    want, entity, ran = model(rows)
    got, entities = infer_rows(spark, rows)
    assert ran >= 3 and {r["id"]: (r["offset"], round(r["round"], 2)) for r in got.collect() if r["offset"] is not None} == {i: (o, round(r, 2)) for i, (o, r) in want.items()}
    assert {(r["type"], r["name"]): r["entity_offset"] for r in entities.collect()} == entity


def test_explanations_list_the_members(spark):
    rows = [row(1, 0, "Peach", "Redhaven", 200)] + [row(k, 0, "Peach", "A", 200 + k, score=50.0) for k in range(2, 30)] + [row(40, 7, "Peach", "A", None)]
    out, entities = infer_rows(spark, rows, explain=True)
    text = {r["name"]: r["entity_explanation"] for r in entities.collect()}
    assert text["Redhaven"] == "round 1: [1] 0 (100.00*1.00)"
    assert text["A"].startswith("round 1: [2] 2 (50.00*0.50) [3] 3 (50.00*0.50)") and text["A"].endswith(" and 8 more")
    members = infer.consensus_members(out, entities).filter("name = 'A'")
    assert sorted(r["id"] for r in members.collect()) == list(range(2, 30))


def test_consensus_rounds_halves_alike_in_any_order(spark):
    """Weights such as 3 * 2**-1.9 have no exact sums as doubles: a mean of a half then depends on the order of rows."""
    rng = random.Random(5)
    rows = []
    for k in range(400):
        weights = [rng.randint(1, 25) * 2.0 ** -rng.choice([0.9, 1.1, 1.95, 2.9]) for _ in range(rng.randint(1, 6))]
        low = rng.randint(-30, 30)
        rows += [(k, low + n, w) for w in weights for n in (0, 1)]  # the mean is a half
    exact = {}
    for k, x, w in rows:
        sums = exact.setdefault(k, [0, 0])
        sums[0] += x * round(w * 10**9)
        sums[1] += round(w * 10**9)
    means = {k: Fraction(*v) for k, v in exact.items()}
    want = {k: int((abs(m) + Fraction(1, 2)) // 1) * (1 if m > 0 else -1) for k, m in means.items()}
    for _ in range(3):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "k int, x int, w double").repartition(3).withColumn("u", infer.weight_units(F.col("w")))
        sums = df.groupBy("k").agg(F.sum(F.col("x") * F.col("u")).alias("wx"), F.sum("u").alias("w"))
        assert {r["k"]: r["m"] for r in sums.select("k", infer.rounded_mean("wx", "w").alias("m")).collect()} == want


def test_little_stays_on_disk(spark, sf_dir):
    """Observations are dealt out once and written; what the rounds write and shuffle is gone when they end."""
    star = Star(spark, sf_dir)
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {b for b in manager.getAllBlocks().mkString(" ").split() if b.startswith("shuffle_")}
    before = shuffled()
    rows = queries._referring(star)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    anchors = queries.part_anchors(star)
    found, entities = infer.infer_offsets(rows, anchors)
    for _ in range(50):  # files are removed beside the jobs
        if not (left := shuffled() - before):
            break
        time.sleep(0.2)
    assert not left
    folder = shared_folder(spark).removeprefix("file:")
    assert not [f for f in os.listdir(folder) if f.startswith("inference-")]
    assert found.count() == rows.count() and entities.count() > 0
