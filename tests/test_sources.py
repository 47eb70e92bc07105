"""A hand-written tree of documents through the whole load."""

import pytest
from pyspark.sql import functions as F

from seasonframe.operators import listing
from seasonframe.plans.load import load
from seasonframe.sources import documents as S

DOCUMENT = """{ // comment
  title: "T", type: "Extension Test", url: "http://x/y", harvest_time_devalue_factor: 3, needs_help: true,
  locations: [ {name: "Alpha", latitude: 45.0, longitude: -122.0, short_name: "I"}, {name: "Beta", latitude: 10.0, longitude: 179.5} ],
  categories: [ {name: "early", description: "early ones"} ],
  plants: [
    {type: "Peach", name: "Redhaven", harvest_time: "July 18", locations: ["I", "Beta"]},
    {type: "Peach", name: "Elberta", harvest_time_relative: "Redhaven +30", locations: ["I"], disease_resistance: {PM: "high"}, chill: "900"},
    {type: "Fig", name: "Desert", locations: [ {"Alpha": "Jun/Sep"}, {"Beta": "NA"} ]},
    {type: "Apple", names: ["A1", "A2"], category: "early", description: "long \\
text"}, /* block
    */
  ],
}
"""


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    folder = root / "references" / "Oregon State" / "a+b"
    folder.mkdir(parents=True)
    (folder / "One File.json5").write_text(DOCUMENT)
    (root / "references" / "bad.json5").write_text("{ title: ")
    (root / "curated").mkdir()
    (root / "curated" / "Peach.json5").write_text('[{name: "Redhaven", AKA: ["Red, Haven (tm)"], patent: "USPP9881 expired 2014", released: "MSU 1940*"}, {name: "Unseen"}]')
    (root / "curated" / "Oddball.json5").write_text('[{name: "Quince X", type: "Quince"}]')
    return root


def test_documents(spark, tree):
    docs, bad = S.read_documents(spark, str(tree / "references"))
    row = docs.first()
    assert (docs.count(), bad.count(), row["path"], row["filename"], row["source_id"]) == (1, 1, "Oregon State/a+b/", "One File", 1)
    assert row["plants"][1]["chill"] == "900" and row["plants"][1]["disease_resistance"] == {"PM": "high"}
    assert row["plants"][3]["description"] == "long text"
    entries, wrong = S.explode_entries(docs)
    rows = S.explode_entry_places(entries)
    got = sorted((r["name"], r["place"] or "", r["time"] or "") for r in rows.collect())
    assert got == [("A1", "", ""), ("A2", "", ""), ("Desert", "Alpha", "Jun/Sep"), ("Elberta", "I", ""), ("Redhaven", "Beta", "July 18"), ("Redhaven", "I", "July 18")]
    assert wrong.count() == 0 and [r["number"] for r in S.explode_places(docs).orderBy("number").collect()] == [1, 2]
    assert [r[0] for r in S.needs_help_lines(docs, "https://h/").collect()] == ["* [Oregon State/a+b/One File](https://h/Oregon%20State/a%2Bb/One%20File.json5)"]


def test_files_are_read_once(spark, tree):
    """What follows reads the written documents, and the whole documents aren't shuffled for their numbers."""
    docs, bad = S.read_documents(spark, str(tree / "references"))
    for rows in (docs, bad, S.explode_places(docs), S.explode_entry_places(S.explode_entries(docs)[0])):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "FileScan parquet" in plan and "FileScan text" not in plan and "from_json(StructField(title" not in plan and "hashpartitioning" not in plan


def test_objects_are_parsed_once(spark):
    rows = spark.createDataFrame([(1, "t", ["A", '{"B": "Jun", "C": "NA"}', "{broken", "{}"]), (2, "u", None), (3, None, ['{"D": null}'])], "id int, harvest_time string, locations array<string>")
    out = S.explode_entry_places(rows)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    got = sorted((r["id"], r["place"] or "", r["time"] or "") for r in out.collect())
    assert got == [(1, "A", "t"), (1, "B", "Jun"), (1, "{broken", "t"), (2, "", "u"), (3, "D", "")]


def test_entities_types_and_facts(spark, tree, tmp_path):
    found = {(r["type"], r["name"]) for r in S.read_entities(spark, str(tree / "curated"))[0].collect()}
    assert found == {("Peach", "Redhaven"), ("Peach", "Unseen"), ("Quince", "Quince X")}
    (tmp_path / "types.json5").write_text('[{group_name: "G", types: [{name: "Euro Pear", name_alphabetical: "Pear, Euro"}, {name: "Plum"}, {name: "Apple"}]}]')
    (tmp_path / "facts.json5").write_text('[{contributor: "c", fact: "f", reference: "r"},]')
    types, _ = S.read_types(spark, str(tmp_path / "types.json5"))
    assert types.count() == 3 and S.read_facts(spark, str(tmp_path / "facts.json5"))[0].first()["fact"] == "f"
    groups = types.groupBy("group_name").agg(F.collect_list(F.struct("name", "name_alphabetical")).alias("types"))
    assert [r["name"] for r in listing.type_list(groups).collect()] == ["Apple", "Euro Pear", "Plum"]


def test_gazetteer(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("GEOID\tALAND\tAWATER\tALAND_SQMI\tAWATER_SQMI\tINTPTLAT\tINTPTLONG   \n00601\t1\t1\t1\t1\t18.180555\t -66.749961   \n")
    assert tuple(S.read_gazetteer(spark, str(tmp_path / "g.tsv")).first()) == (601, 18.180555, -66.749961)
    with pytest.raises(ValueError):
        S.read_gazetteer(spark, str(tmp_path / "g.tsv"), 33000)


def test_load(spark, tree, tmp_path):
    t = load(spark, str(tree / "references"), str(tree / "curated"), max_rounds=3)
    rows = {(r["name"], r["place_name"]): r for r in t.observations.collect()}
    assert len(rows) == 6 and rows["A1", None]["place"] is None and rows["A1", None]["number"] == 0
    assert rows["Desert", "Alpha"]["start_2"] == 254 and rows["Elberta", "Alpha"]["start"] == rows["Redhaven", "Alpha"]["start"] + 30
    assert rows["Elberta", "Alpha"]["offset"] == 30 and rows["Redhaven", "Beta"]["offset"] == 0
    assert rows["A1", None]["category_description"] == "early ones"
    entities = {r["name"]: r for r in t.entities.collect()}
    assert set(entities) == {"Redhaven", "Unseen", "Quince X", "Elberta", "Desert", "A1", "A2"}
    assert entities["Redhaven"]["marketing_name"] == "Red Haven" and entities["Redhaven"]["release_year"] == 1940 and entities["Redhaven"]["n_references"] == 1
    assert entities["Unseen"]["n_references"] == 0 and entities["Elberta"]["offset"] == 30
    checks = {r["check"] for r in t.report.collect()}
    assert checks == {"unreadable document"}
    S.write_json_result(t.anchor_days, str(tmp_path / "days"))
    S.write_needs_help(t.sources, str(tmp_path / "help"), "https://h/")
    assert spark.read.text(str(tmp_path / "help")).count() == 2


def test_trees_are_written_by_many_tasks(spark):
    """However few bytes a tree has: files, not bytes, take the time."""
    import pathlib

    from seasonframe.plans import source_queries
    from seasonframe.plans.registry import Star

    path = source_queries._tree(Star(spark, "/root/testdata/sf0.01"), "documents", source_queries._documents, ["doc"])
    files = list(pathlib.Path(path.removeprefix("file:")).rglob("part-*"))
    assert len({f.name.split("-")[1] for f in files}) > 2
