"""Parsers and labels against literal expectations."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from seasonframe.functions import dims, fields, timetext


def evaluate(spark, texts, expression):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r[0] for r in rows.select("k", expression(F.col("t")).alias("v")).orderBy("k").select("v").collect()]


DAYS = {
    "Jan 1": 1, "February 28": 59, "February 29": 60, "March 1": 61, "August 12": 225, "Sep 20": 264, "Dec 31": 366, "early January": 5,
    "early to mid jan": 10, "early-mid jan": 10, "mid jan": 15, "mid-late jan": 20, "late February": 56, "early August": 218,
    "mid-late August": 233, "late August": 238, "mar": 75, "April": 106, "eary Jun": None, " Around April 16 (Gainesville, FL)": 107,
    "Around May 4 (Gainesville, FL)": 125, "9/25": 269, "10/15": 289, "Sept": None, "Sept 5": 249, "": None, "13/45": None, "Feb 30": None,
}


def test_day_of_year(spark):
    assert dict(zip(DAYS, evaluate(spark, DAYS, timetext.day_of_year))) == DAYS


RANGES = {
    "eary Jun": None, "Early": ("Unparsed", None, None), "Summer": ("Unparsed", None, None), "Early August": ("StartOnly", 218, None), "August 7": ("StartOnly", 220, None),
    "August 15": ("StartOnly", 228, None), "mid-late August": ("TwoDates", 228, 238), "mid to late August": ("TwoDates", 228, 238),
    "August": ("TwoDates", 223, 233), "mid September": ("TwoDates", 254, 264), "early to late August": ("TwoDates", 218, 238),
    "late August to mid September": ("TwoDates", 238, 259), "late Aug to Oct": ("TwoDates", 238, 289), "Sep 20-30": ("TwoDates", 264, 274),
    "Sep 25-Oct 5": ("TwoDates", 269, 279), "June 21 to July 10": ("TwoDates", 173, 192), "Oct-Nov": ("TwoDates", 289, 320),
    "late Oct-Nov": ("TwoDates", 299, 320), "July 6": ("StartOnly", 188, None), "June 29": ("StartOnly", 181, None), "10/15": ("StartOnly", 289, None),
    "Average of: July 6, June 29": ("StartOnly", 184, None), "First Harvest: Around April 30 (Gainesville, FL)": ("StartOnly", 121, None),
    "50% Harvest: Around April 25 (Gainesville, FL)": ("TwoDates", 111, 121), "a-b-c": None, "Average of: July 6, nothing": None,
}


def test_day_range(spark):
    got = [None if v is None else tuple(v) for v in evaluate(spark, RANGES, timetext.day_range)]
    assert dict(zip(RANGES, got)) == RANGES


def test_midpoint_and_month_place(spark):
    texts = ["", "mid", "Sep 15-30", "Sep 15", "sep", "mid October"]
    assert evaluate(spark, texts, timetext.is_midpoint) == [False, False, False, False, True, True]
    assert evaluate(spark, ["", "september 23", "mid september", "Sep"], timetext.month_place) == ["none", "start", "end", "start"]


def test_two_season(spark):
    got = evaluate(spark, ["Jun/Sep", "9/25", "July 6"], timetext.two_season)
    assert [tuple(g) for g in got] == [(162, 172, 254, 264), (269, None, None, None), (188, None, None, None)]


def test_parse_report(spark):
    df = spark.createDataFrame([("July 6",), ("nonsense words",), ("nonsense words",), (" ",), (None,), ("Jan 1-9",), ("50% harvest: Jan 2",)], "t string")
    got = {r["outcome"]: (r["n"], r["examples"]) for r in timetext.parse_report(df, "t", timetext.day_range(F.col("t"))).collect()}
    assert got["failed"] == (2, ["nonsense words"]) and got["before_year"][0] == 1 and got["TwoDates"][0] == 1
    assert got["empty"][0] == 1 and got["absent"][0] == 1


def test_parse_report_parses_a_text_once(spark):
    parses = spark.sparkContext.accumulator(0)

    @F.udf("struct<start: int, parse_type: string>")
    def parsed(text):
        parses.add(1)
        return (5, "StartOnly")

    df = spark.range(3000).select(F.concat(F.lit("July "), F.col("id") % 7).alias("t"))
    rows = timetext.parse_report(df, "t", parsed(F.col("t"))).collect()
    assert [(r["outcome"], r["n"], len(r["examples"])) for r in rows] == [("StartOnly", 3000, 7)]
    assert parses.value <= 21  # a plan may name the value a few times; before, all 3000 rows were parsed


RELATIVE = {
    "hi": None, "Redhaven -32": ("Redhaven", None, -32), "Redhaven +0": ("Redhaven", None, 0), "Redhaven +45": ("Redhaven", None, 45),
    "Redhaven -2 weeks": ("Redhaven", None, -14), "Redhaven +0.5 weeks": ("Redhaven", None, 4), "Redhaven -1.5 weeks": ("Redhaven", None, -11),
    "Redhaven +9 weeks": ("Redhaven", None, 63), " with spaces-42": ("with spaces", None, -42), "Bing -10 to -12": ("Bing", None, -11),
    "Bing +14 to +15": ("Bing", None, 14), "Concord -6 weeks": ("Concord", None, -42), "Concord -4 to -5 weeks": ("Concord", None, -31),
    "Red Delicious -5 to -4 weeks": ("Red Delicious", None, -31), "Peach: Redhaven -32": ("Redhaven", "Peach", -32),
    "Apple: Red Delicious -5 to -4 weeks": ("Red Delicious", "Apple", -31), "X +1.2.3": None,
}


def test_relative_offset(spark):
    got = [None if v is None else tuple(v) for v in evaluate(spark, RELATIVE, fields.relative_offset)]
    assert dict(zip(RELATIVE, got)) == RELATIVE


RELEASES = {
    "": None, "WSU 2011*": ("WSU", 2011, True, False), "WSU Mt Vernon 2003": ("WSU Mt Vernon", 2003, False, False), "WSU": ("WSU", None, False, False),
    "WSU*": ("WSU", None, True, False), "2013": (None, 2013, False, False), "2013*": (None, 2013, True, False), "201": (None, None, False, True), "2101": (None, None, False, True),
}


def test_release_info(spark):
    got = [None if v is None else tuple(v) for v in evaluate(spark, RELEASES, fields.release_info)]
    assert dict(zip(RELEASES, got)) == RELEASES


def test_patent_info(spark):
    noon = lambda *d: dt.datetime(*d, 12)
    texts = ["", "http://x/USPP9881 expired 2014", "http://x/USPP30925 expires 2038-03-07", "http://x/USPP30925 2038-03-07", "http://x/USPP30925"]
    want = [(None, None), (9881, noon(2014, 1, 1)), (30925, noon(2038, 3, 7)), (30925, noon(2038, 3, 7)), (30925, None)]
    assert [tuple(v) for v in evaluate(spark, texts, fields.patent_info)] == want


def test_patent_expiry_is_free_of_the_session_zone(spark):
    years = spark.createDataFrame([(1931,), (2021,)], "y int")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert [r[0] for r in years.select(fields.patent_expiry_seconds(F.col("y"))).collect()] == [-694267200, 2145960000]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


MERGES = [
    ("", "", ""), ("", "S4'S9 [1]", "S4'S9 [1]"), ("S1S4' [1]", "", "S1S4' [1]"), ("S1S4 [1]", "S1S4 [2]", "S1S4 [1,2]"),
    ("S1S4' [1]", "S1S4 [2]", "S1S4 [2] or S1S4' [1] (conflicting sources)"),
    ("S1S4 [2] or S1S4' [1] (conflicting sources)", "S1S4' [3]", "S1S4 [2] or S1S4' [1,3] (conflicting sources)"), ("plain text", "S1S4 [2]", "S1S4 [2]"),
]


def test_tags(spark):
    df = spark.createDataFrame([(k, *m) for k, m in enumerate(MERGES)], "k int, a string, b string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", fields.merge_tag_texts(F.col("a"), F.col("b")).alias("got")).collect())


def test_small_texts(spark):
    assert evaluate(spark, ["tulare! (tm)", "Santina ®"], fields.search_key) == ["tulare", "santina"]
    paths = [r".\..\plant_database\references", "./../plant_database/references/Oregon", r".\..\plant_database\references\Oregon\Willamette Valley", "/a/references/Oregon/My File.json5"]
    got = [tuple(v) for v in evaluate(spark, paths, fields.split_source_path)]
    assert got == [("/", None), ("Oregon/", None), ("Oregon/Willamette Valley/", None), ("Oregon/", "My File")]
    plain, readable = "Oregon/Willamette Valley U-picks/Brosi's Sugartree Farms", "Oregon/Willamette_Valley_U-picks/Brosi's_Sugartree_Farms"
    assert evaluate(spark, [plain], fields.slug) == [readable]
    assert evaluate(spark, [readable, "Oregon/Willamette%20Valley%20U-picks%2FBrosi's%20Sugartree%20Farms"], fields.unslug) == [plain, plain]
    view = evaluate(spark, ["Oregon//x/@45.5,-122.75,11z", "Oregon"], fields.map_view)
    assert [tuple(v) for v in view] == [(45.5, -122.75, 11.0, "Oregon/x/"), (None, None, None, "Oregon/")]


def test_aliases_and_labels(spark):
    one = spark.createDataFrame([(["Big, Red", "Sweet (tm)"], 5, None)], "a array<string>, d int, n int")
    row = one.select(fields.alias_fields(F.col("a")).alias("x"), fields.signed_days(F.col("d")).alias("d"), fields.signed_days(F.col("n")).alias("n")).first()
    assert (row["x"]["aka"], row["x"]["aka_fts"], row["x"]["marketing_name"]) == (["Big Red", "Sweet (tm)"], ["bigred", "sweet"], "Sweet")
    assert (row["d"], row["n"]) == ("+5", "(no harvest time)")
    times = spark.createDataFrame([(dt.datetime(2038, 3, 7), False), (dt.datetime(2031, 1, 1), True), (dt.datetime(2014, 1, 1), False)], "t timestamp, e boolean")
    got = [r[0] for r in times.select(fields.expiry_label(F.col("t"), F.col("e"), F.lit("2020-01-01").cast("timestamp"))).collect()]
    assert got == ["March 7, 2038", "2031 (estimated)", "January 1, 2014 (expired)"]


def test_geography(spark):
    pairs = [(0, 0), (180, -180), (-180, -180), (359, -1), (360, 0), (361, 1), (1000, -80), (-1000, 80), (-193.94874081126167, 166.0512591887383)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "a double, b double")
    assert all(abs(r["v"] - r["b"]) < 1e-9 for r in df.select("b", fields.degrees_normalize(F.col("a")).alias("v")).collect())
    kms = spark.createDataFrame([("can't parse", 0.0), ("25", 0.0), ("25", 45.0), ("250.0", 90.0)], "km string, lat double")
    got = [tuple(r[0]) for r in kms.select(fields.km_to_degrees(F.col("km"), F.col("lat"))).collect()]
    assert got[0] == (None, None)
    for g, want in zip(got[1:], [(0.22457891453524642,) * 2, (0.22457891453524642, 0.11228945726762321), (2.245789145352464, 0)]):
        assert g == pytest.approx(want)
    km = spark.range(1).select(fields.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))).first()[0]
    assert km == pytest.approx(20015, abs=1)


def test_dimensions(spark):
    assert (dims.anchors(spark).count(), dims.anchor_set(dims.anchors(spark)).count(), dims.source_scores(spark).count(), dims.patent_years(spark).count()) == (21, 18, 17, 91)
    months = dims.month_grid(spark).orderBy("month").collect()
    assert len(months) == 12 and months[2]["start"] == 60 and months[11]["end"] == 366
