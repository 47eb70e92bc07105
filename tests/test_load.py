"""A load of some hundred documents with known counts, and anchors that lie as far apart as their documents say."""

import random

import pytest

from seasonframe.functions import dims
from seasonframe.plans.load import load

#: Days of the anchors after the first (expected values).
DAYS = {
    "Montmorency": 0, "Bing": 3, "Blenheim": 12, "Santa Rosa": 25, "Redhaven": 33, "Legacy": 37, "Heritage": 50, "Bartlett": 58, "Marion": 59, "Shinseiki": 66,
    "Italian": 70, "Nonpareil": 72, "Concord": 77, "Red Delicious": 83, "Wonderful": 101, "Ken's Red": 108, "Chandler": 129, "Hayward": 137,
}
MONTHS = [("Jan", 31), ("Feb", 29), ("Mar", 31), ("Apr", 30), ("May", 31), ("Jun", 30), ("Jul", 31), ("Aug", 31), ("Sep", 30), ("Oct", 31), ("Nov", 30), ("Dec", 31)]


def date(day):
    for name, n in MONTHS:
        if day <= n:
            return f"{name} {day}"
        day -= n
    raise ValueError


def test_load_of_many_documents(spark, tmp_path):
    rng = random.Random(3)
    own = {name: kind for kind, name in {(a[0], a[1]) for a in dims.ANCHORS.values()}}
    assert set(own) == set(DAYS)
    folder = tmp_path / "references"
    entries = observations = places = 0
    named = set()
    for k in range(150):
        n_places = 1 + k % 2
        shift = rng.randint(120, 180)
        plants = []
        for name in rng.sample(sorted(DAYS), 7):
            plants.append(f'{{type: "{own[name]}", name: "{name}", harvest_time: "{date(shift + DAYS[name] + rng.randint(-2, 2))}", locations: ["P0"]}}')
            named.add((own[name], name))
        plants.append(f'{{type: "Peach", names: ["V{k % 40}", "W{k}"], harvest_time: "{date(shift + 40)}", locations: ["P0"]}}')
        plants.append(f'{{type: "Peach", name: "X{k % 30}", harvest_time_relative: "Redhaven +{k % 20}", locations: ["P0"]}}')
        named |= {("Peach", f"V{k % 40}"), ("Peach", f"W{k}"), ("Peach", f"X{k % 30}")}
        where = ", ".join(f'{{name: "P{j}", latitude: {j}, longitude: {k}}}' for j in range(n_places))
        (folder / f"f{k % 5}").mkdir(parents=True, exist_ok=True)
        (folder / f"f{k % 5}" / f"d{k}.json5").write_text(f'{{ title: "D{k}", type: "{"Extension Test" if k else "Unheard Of"}", // note\n locations: [{where}],\n plants: [{", ".join(plants)},] }}')
        entries, observations, places = entries + 10, observations + 10, places + n_places
    t = load(spark, str(folder))
    counts = {r["table"]: r["n"] for r in t.summary.collect()}
    assert counts == {"sources": 150, "places": places, "entries": entries, "observations": observations, "entities": len(named)}
    days = {r["name"]: r["day"] for r in t.anchor_days.collect()}
    assert set(days) == set(DAYS) and all(abs(days[n] - d) <= 3 for n, d in DAYS.items())
    checks = {(r["check"], r["key"]) for r in t.report.collect()}
    assert checks == {("unknown source type", "Unheard Of")}
    rows = t.observations.filter("type = 'Peach'").collect()
    assert sum(r["offset"] is not None for r in rows) >= 0.8 * len(rows)
    assert all(r["offset"] == int(r["relative"].split("+")[1]) for r in rows if r["relative"])
    redhaven = {r["name"]: r for r in t.entities.collect()}["Redhaven"]
    assert redhaven["offset"] == 0 and redhaven["entity_explanation"].startswith("round 1: [")
    with pytest.raises(ValueError, match="Unheard Of"):
        load(spark, str(folder), strict=True)
