"""Operators on small literal tables."""

import pytest
from pyspark.sql import functions as F

from seasonframe.functions import dims
from seasonframe.lineage import spread
from seasonframe.operators import align, asof, changes, chartprep, geo, infer, listing, quality, resolve, score, search
from seasonframe.plans import queries
from seasonframe.plans.registry import Star

OBSERVED = [
    (1, 1, "Peach", "Redhaven", 200, None), (2, 1, "Peach", "Elberta", 230, None), (3, 2, "Peach", "Elberta", 240, None), (4, 2, "Peach", "Xtra", 235, None),
    (5, 3, "Peach", "Redhaven", None, "Elberta -28"), (6, 3, "Peach", "Cresthaven", None, "Elberta -2"), (7, 4, "Nectarine", "Fantasia", None, "Peach: Redhaven +20"),
    (8, 5, "Peach", "Loner", None, "Xtra +3"), (9, None, "Peach", "Nowhere", 250, None),
]
SCHEMA = "id int, place int, type string, name string, start int, relative string"
WANT = {1: (0, 0.0), 2: (30, 1.0), 3: (30, 1.9), 4: (25, 2.1), 5: (0, 0.0), 6: (26, 1.0), 7: (20, 0.0), 8: (28, 3.95), 9: (None, None)}


def observed(spark, rows=OBSERVED):
    return spark.createDataFrame(rows, SCHEMA).withColumn("source_score", F.lit(100.0)).withColumn("devalue", F.lit(0.0))


@pytest.mark.parametrize("order", [1, -1])
def test_inference(spark, order):
    rows, entities = infer.infer_offsets(observed(spark, OBSERVED[::order]), dims.anchors(spark), explain=order == 1)
    assert {r["id"]: (r["offset"], r["round"]) for r in rows.collect()} == WANT
    found = {r["name"]: r for r in entities.collect()}
    assert (found["Elberta"]["entity_offset"], found["Xtra"]["entity_offset"], found["Nowhere"]["entity_offset"]) == (30, 25, None)
    assert found["Fantasia"]["anchor_name"] == "Redhaven"
    if order == 1:
        assert found["Redhaven"]["entity_explanation"].startswith("round ")


def test_inference_of_nothing(spark):
    rows, entities = infer.infer_offsets(observed(spark, []), dims.anchors(spark))
    assert rows.count() == entities.count() == 0


def test_relative_to_absolute(spark):
    rows = [(1, 1, "Peach", "A", 200, None), (2, 1, "Peach", "B", None, "A +5"), (3, 1, "Peach", "C", None, "B +5"), (4, None, "Peach", "D", None, "A +5"), (5, 1, "Apple", "E", None, "A +1")]
    one = {r["id"]: r["start"] for r in infer.relative_to_absolute(observed(spark, rows)).collect()}
    assert one == {1: 200, 2: 205, 3: None, 4: None, 5: None}
    two = {r["id"]: r["start"] for r in infer.relative_to_absolute(observed(spark, rows), max_hops=2).collect()}
    assert two[3] == 210


def test_alignment(spark):
    rows = [(1, 1, "Peach", "Redhaven", 200), (2, 1, "Apple", "Red Delicious", 250), (3, 2, "Peach", "Redhaven", 210), (4, 2, "Sweet Cherry", "Bing", 180), (5, 3, "Grape", "Concord", 100)]
    df = spark.createDataFrame(rows, "id int, place int, type string, name string, start int").withColumn("offset", F.lit(0))
    days = {(r["type"], r["name"]): r["day"] for r in align.align_anchors(df, dims.anchors(spark)).collect()}
    assert days == {("Sweet Cherry", "Bing"): 0, ("Peach", "Redhaven"): 30, ("Apple", "Red Delicious"): 80}
    assert align.align_anchors(df.limit(0), dims.anchors(spark)).count() == 0


def test_asof(spark, monkeypatch):
    keys = spark.createDataFrame([(1,), (4969,), (4970,), (4971,), (33333,), (0,), (None,)], "n int")
    assert [r[0] for r in keys.select(asof.patent_year(F.col("n"))).collect()] == [1931, 1982, 1983, 1983, 2021, 1931, None]
    marks = spark.createDataFrame([(10, "a"), (20, "b")], "k int, v string")
    rows = spark.createDataFrame([(5,), (10,), (19,), (25,), (None,)], "k int")
    want = {5: "a", 10: "a", 19: "a", 25: "b", None: None}
    assert {r["k"]: r["o"] for r in asof.asof_lookup(rows, "k", marks, "k", "v", "o").collect()} == want
    for tree, intervals in ((1, 1000), (1, 1)):
        monkeypatch.setattr(asof, "TREE_LIMIT", tree)
        monkeypatch.setattr(asof, "INTERVAL_LIMIT", intervals)
        assert {r["k"]: r["o"] for r in asof.asof_lookup(rows, "k", marks, "k", "v", "o").collect()} == want
    grouped = spark.createDataFrame([("x", 10, 1), ("x", 20, 2), ("y", 15, 3)], "g string, k int, v int")
    asked = spark.createDataFrame([("x", 12), ("y", 1), ("z", 5)], "g string, k int")
    assert {r["g"]: r["o"] for r in asof.asof_lookup(asked, "k", grouped, "k", "v", "o", by=["g"]).collect()} == {"x": 1, "y": 3, "z": None}


def test_asof_null_groups_on_several_ranges(spark):
    """A null group is a group like any other, wherever its rows are cut; keys above 31 bits are keys."""
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        marks = spark.createDataFrame([(None, 10, "n"), ("x", 5, "x5"), ("x", 2000, "x2"), ("y", 1, "y")], "g string, k long, v string")
        rows = [(g, k) for k in range(0, 4000, 2) for g in (None, None, "x", "z")]
        df = spark.createDataFrame(rows, "g string, k long").repartition(4)
        got = {(r["g"], r["k"]): r["o"] for r in asof.asof_lookup(df, "k", marks, "k", "v", "o", by=["g"]).collect()}
        want = {(g, k): {None: "n", "x": "x5" if k < 2000 else "x2", "z": None}[g] for g, k in rows}
        assert got == want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    numbers = spark.createDataFrame([(1 << 40,), (4970,)], "n long")
    assert [r[0] for r in numbers.select(asof.patent_year(F.col("n"))).collect()] == [2021, 1983]


def test_scores(spark):
    s = spark.createDataFrame([("Extension Test",), ("unheard of",)], "t string")
    scored, unknown = score.score_sources(s, "t")
    assert [r["score_explanation"] for r in scored.orderBy("t").collect()][0] == "extension test: score 50/100"
    assert [r[0] for r in unknown.collect()] == ["unheard of"]
    e = spark.createDataFrame([(50.0, "collection name", 1975, 1, None), (None, None, None, 6, 5)], "s double, n string, y int, r int, p int")
    got = [tuple(r[0]) for r in e.select(score.entity_score(F.col("s"), F.col("n"), F.col("y"), F.col("r"), F.col("p"), 2021)).collect()]
    assert got[0] == (pytest.approx(34.0), "50 (collection name) *0.85 (>40 years old) *0.8 (1 references) *1.0 (no uspp number)")
    assert got[1][0] == pytest.approx(1.0 * 0.8 * 1.3 * 1.2)


def test_search_cases(spark):
    names = ["Redhaven", "Early Redhaven", "PF 11", "PF 1", "Liberty", "Dapple Dandy", "Burpeachwhatever"]
    types = ["Peach"] * 4 + ["Apple", "Plumcot", "Apple"]
    df = spark.createDataFrame([(k, n, t, float(k)) for k, (n, t) in enumerate(zip(names, types))], "id int, name string, type string, score double")
    df = resolve.attach_search_fields(df)
    find = lambda q: sorted(r["name"] for r in search.search(df, q, ["Peach", "Apple", "Plumcot"]).rows.collect())
    assert find("red") == ["Early Redhaven", "Redhaven"] and find("pf 11") == ["PF 11"] and find("pf-11") == ["PF 11"]
    assert find("pf 1") == ["PF 1", "PF 11"] and find("pf 1 peach") == ["PF 1", "PF 11"] and find("liberty apple") == ["Liberty"]
    assert find("ab") == [] and find("") == []
    page = search.search(df, None, page=2, per_page=3)
    assert (page.count, page.last_page, [r["id"] for r in page.rows.collect()]) == (7, 3, [3, 2, 1])
    with pytest.raises(ValueError):
        search.order_keys("search_quality")
    with pytest.raises(ValueError):
        search.paginate(df, [F.col("id")], page=2)


def test_resolution(spark):
    places = spark.createDataFrame([(1, "I", "Alpha", 0), (1, None, "Beta", 1), (2, None, "Gamma", 0)], "doc int, short_name string, name string, position int")
    entries = spark.createDataFrame([(1, "I"), (1, "Beta"), (1, None), (2, None)], "doc int, place string")
    got = sorted((r["doc"], r["place"] or "", r["place_name"]) for r in resolve.resolve_place_name(entries, places).collect())
    assert got == [(1, "", None), (1, "Beta", "Beta"), (1, "I", "Alpha"), (2, "", "Gamma")]
    refs = spark.createDataFrame([("a", 1, 50.0, True), ("a", 2, 50.0, True), ("b", 3, 1.0, True), ("b", 3, 1.0, False)], "name string, src int, s double, ign boolean")
    rolled = {r["name"]: tuple(r)[1:] for r in resolve.entity_rollup(refs, ["name"], "src", "s", "ign", spark.createDataFrame([("c",)], "name string")).collect()}
    assert rolled == {"a": (2, 50.0, 1, True), "b": (2, 1.0, 3, False), "c": (0, None, None, False)}
    assert resolve.drop_unconfirmed(resolve.entity_rollup(refs, ["name"], "src", "s", "ign")).count() == 1
    aliases = spark.createDataFrame([("P", "x", ["q"]), ("P", "y", ["q", "x"])], "type string, k string, a array<string>")
    assert {(r["alias"], r["kind"]) for r in resolve.alias_conflicts(aliases, ["type"], "k", "a").collect()} == {("q", "repeated"), ("x", "name")}


def test_geography(spark):
    places = spark.createDataFrame([(1, 10.0, 166.1), (2, 10.0, -170.0), (3, 10.0, 0.0)], "id int, lat double, lon double")
    assert [r["id"] for r in geo.bbox(places, 0, 20, -200, -165).orderBy("id").collect()] == [1, 2]
    gazetteer = spark.createDataFrame([(601, 18.180555, -66.749961), (97231, 45.687631, -122.824202), (99929, 56.221499, -131.923588)], "zip int, lat double, lon double")
    texts = ["", "a,b", "45.7,-122.8", "zip:uh", "zip:4294967295", "zip:00601"]
    rows = {r["t"]: (r["geo_error"], r["latitude"], r["longitude"]) for r in geo.geo_input(spark.createDataFrame([(t,) for t in texts], "t string"), "t", gazetteer).collect()}
    assert rows[""][0] == "lat/lon wrong number of elements" and rows["a,b"][0] == "lat/lon didn't parse" and rows["zip:uh"][0] == "zip didn't parse as a number"
    assert rows["zip:4294967295"][0] == "zip code not found" and rows["zip:00601"] == (None, 18.180555, -66.749961) and rows["45.7,-122.8"] == (None, 45.7, -122.8)
    assert geo.places_near(places, 0, 0, "far").count() == 0
    assert sum(r["n"] for r in geo.grid_cluster(places, 3).collect()) == 3


def test_changes(spark):
    rows = spark.createDataFrame([(1, 7, "a"), (2, 7, "b"), (3, 8, "c")], "id int, owner int, v string")
    log = spark.createDataFrame(
        [(1, 7, 7, "A", 1, False), (1, 7, 7, "AA", 2, False), (2, 7, 7, None, 3, True), (3, 7, 7, "stolen", 4, False), (None, 7, 7, "new", 5, False), (3, 8, 7, "forged", 6, False)],
        "id int, owner int, actor int, v string, seq int, deleted boolean",
    )
    more = [(None, 7, 7, f"n{k}", 100 - k // 2, None) for k in range(40)]
    for parts in (1, 7):
        kept, _ = changes.apply_changes(rows, log.unionByName(spark.createDataFrame(more, log.schema)).repartition(parts), sequence="seq")
        new = {r["id"]: r["v"] for r in kept.collect() if r["id"] > 3}
        assert new == {4: "new"} | {5 + k: m[3] for k, m in enumerate(sorted(more, key=lambda m: (m[4], m[3])))}
    kept, rejected = changes.apply_changes(rows, log)
    assert sorted((r["id"], r["owner"], r["v"]) for r in kept.collect()) == [(1, 7, "AA"), (3, 8, "c"), (4, 7, "new")]
    assert sorted(r["seq"] for r in rejected.collect()) == [4, 6]


def test_replace_builtin_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, False), (2, True)], "id int, is_user boolean").write.partitionBy("is_user").parquet(path)
    changes.replace_builtin_rows(spark.createDataFrame([(9,)], "id int"), path)
    assert sorted((r["id"], str(r["is_user"]).lower()) for r in spark.read.parquet(path).collect()) == [(2, "true"), (9, "false")]


def test_charts_and_listings(spark):
    items = spark.createDataFrame([(k, "g", "Peach", f"n{k:02}", 100 + k, None, k, "Peach", "Redhaven", 0.0) for k in range(50)], "id int, g string, type string, name string, start int, end int, offset int, anchor_type string, anchor_name string, round double")
    absolute = chartprep.chart_absolute(items, ["g"]).collect()
    assert {r["sequence"] for r in absolute} == {"Peach"} and max(r["chunk"] for r in absolute) == 1 and {r["width"] for r in absolute} == {10}
    offsets = spark.createDataFrame([("Peach", "Redhaven", 33)], "type string, name string, day int")
    relative = chartprep.chart_relative(items, offsets, ["g"]).collect()
    assert min(r["x"] for r in relative) == 0 and all(r["is_earliest"] and r["is_most_numerous"] for r in relative)
    assert tuple(chartprep.extents(items.limit(1).withColumn("width", F.lit(10)), [], "start").first()) == (75.0, 135.0)
    paths = spark.createDataFrame([("",), ("A/",), ("A/B/",), ("A/B/C/",), ("A_/",)], "path string")
    docs, folders = listing.directory_listing(paths, "A/")
    assert docs.count() == 1 and [r[0] for r in folders.collect()] == ["A/B/"]
    assert listing.sample_one(paths, 3, "path").first() == listing.sample_one(paths.repartition(3), 3, "path").first()


def test_quality_report(spark):
    df = spark.createDataFrame([(1, "x", None), (1, None, None), (2, None, ["y"])], "id int, name string, names array<string>")
    parts = [quality.name_xor_names(df, F.col("id")), quality.duplicate_keys(df, ["id"])]
    assert sorted(r["check"] for r in quality.quality_report(parts).collect()) == ["duplicate key", "name xor names"]
    with pytest.raises(ValueError):
        quality.quality_report(parts, strict=True)


def test_trigram_index_of_one_file_is_made_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(search, "TASK_TEXTS", 100, raising=False)
    df = spark.range(2000).select(F.col("id").alias("key"), F.lit("red car").alias("name")).coalesce(1)
    tasks = search.build_trigram_index(df, "key", "name").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= 15 and max(r["count"] for r in tasks) < 1000 and sum(r["count"] for r in tasks) == 10_000  # before, one task


def test_search_of_a_frequent_word_takes_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(search, "TASK_ROWS", 200, raising=False)
    df = spark.range(2000).select(F.col("id").alias("key"), F.lit("red car").alias("name")).coalesce(1)
    asked = spark.createDataFrame([(1, "red"), (2, "ed c"), (3, "blue"), (4, "re")], "query int, word string")
    found = search.search_index(asked, search.build_trigram_index(df, "key", "name"), df, "key", "name")
    rows = found.select("query", "key", F.spark_partition_id().alias("task")).collect()
    assert len(rows) == len({(r["query"], r["key"]) for r in rows}) == 4000 and {r["query"] for r in rows} == {1, 2}
    assert max(sum(r["task"] == k for r in rows) for k in {r["task"] for r in rows}) < 1000  # before, all were met in one


def moved(spark):
    """Rows that each stage has written for a shuffle."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}


def test_a_posting_moves_once_for_all_words_that_it_meets(spark):
    df = spark.range(2000).select(F.col("id").alias("key"), F.lit("red car").alias("name")).coalesce(1)
    asked = spark.createDataFrame([(k, w) for k in range(25) for w in ("red", "d car")], "query int, word string")
    index = search.build_trigram_index(df, "key", "name")
    earlier = moved(spark)
    rows = search.search_index(asked, index, df, "key", "name").select("query", "key").collect()
    assert len(rows) == len(set(rows)) == 25 * 2000
    assert max(n for k, n in moved(spark).items() if k not in earlier) <= 10_000  # the index; before, 25 times three postings of a text


def test_postings_are_counted_before_they_are_dealt_out_by_trigram(spark):
    df = spark.range(2000).select(F.col("id").alias("key"), F.lit("red car").alias("name")).coalesce(1)
    asked = spark.createDataFrame([(1, "red"), (2, "ed c"), (3, "blue"), (4, "re")], "query int, word string")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        index = search.build_trigram_index(df, "key", "name").unionByName(spark.createDataFrame([("red", -1)], "trigram string, key long"))
        earlier = moved(spark)
        sizes = {r["trigram"]: r["__size"] for r in search.index_sizes(index).collect()}
        found = search.search_index(asked, index, df, "key", "name")
        most = max(n for k, n in moved(spark).items() if k not in earlier)
        rows = found.select("query", "key").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sizes == {"red": 2001, "ed ": 2000, "d c": 2000, " ca": 2000, "car": 2000}
    assert most <= 2000  # the texts; before, all 10,000 postings
    assert len(rows) == 4000 and {r["query"] for r in rows} == {1, 2}


def largest_task(df):
    return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def test_relative_to_absolute_takes_tasks_by_rows(spark, monkeypatch):
    monkeypatch.setattr(infer, "TASK_ROWS", 100, raising=False)
    k = F.col("id")
    rows = spark.range(2000).coalesce(1).select("id", (k % 50).alias("place"), F.lit("T").alias("type"), k.cast("string").alias("name"), F.when(k < 50, k).alias("start"), F.when(k >= 50, F.concat((k % 50).cast("string"), F.lit(" +3"))).alias("relative"))
    out = infer.relative_to_absolute(rows)
    assert {r["id"]: r["start"] for r in out.collect()} == {k: k if k < 50 else k % 50 + 3 for k in range(2000)}
    assert largest_task(out) < 800  # before, one task


def test_checks_take_tasks_by_keys(spark, monkeypatch):
    monkeypatch.setattr(quality, "TASK_KEYS", 100, raising=False)
    monkeypatch.setattr(resolve, "TASK_KEYS", 100, raising=False)
    twice = spark.range(4000).coalesce(1).select((F.col("id") % 2000).alias("a"), (F.col("id") % 1000 % 7).alias("b"))
    found = quality.duplicate_keys(twice, ["a", "b"])
    assert found.count() == 2000 and largest_task(found) < 800  # before, one task
    lost = resolve.missing_references(twice, ["a"], spark.range(1000).select(F.col("id").alias("k")), ["k"])
    assert lost.count() == 1000 and largest_task(lost) < 500


def test_one_file_is_spread(spark, sf_dir):
    df = spark.range(1000).coalesce(1)
    assert spread(df, rows=100).rdd.getNumPartitions() == 10 and spread(df, "id", rows=100).count() == 1000
    rows = queries.observed(Star(spark, sf_dir))
    assert "REPARTITION_BY_NUM" in rows._jdf.queryExecution().executedPlan().toString()  # before, tasks grew with the input


def test_relative_counts(spark):
    rows = [(k, f"p{k % 5}", "T", str(k), [3, None, 0][k % 3 if k % 5 else 0], None if k % 11 == 0 else "A", None if k % 7 == 0 else "ab"[k % 2] if k % 5 != 3 else "a") for k in range(400)] + [(900, None, "T", "x", 1, "A", "a"), (901, None, "T", "x", None, "A", "a")]
    df = spark.createDataFrame(rows, "id long, place string, type string, name string, offset int, anchor_type string, anchor_name string")
    offsets = spark.createDataFrame([("A", "b", 5)], "type string, name string, day int")
    want = chartprep.uncharted_counts(chartprep.chart_relative(df, offsets, ["place"], keep_uncharted=True), ["place"])
    got = chartprep.relative_counts(df, offsets, ["place"])
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 6
