"""Sources and sinks over trees of files that Spark writes from the star-schema tables, beside their DuckDB SQL.

A supplier has one document, with two places and an entry a part; parts and customers in batches make the files of
entities, facts and the gazetteer. Files hold relaxed JSON. A tree is written once a session, into the folder that all
executors share.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import sent_pairs, shared_folder
from ..operators import changes, resolve
from ..sources import documents as source
from .queries import OBSERVED, POINTS, observed, points
from .registry import Star, query

FILES = "*.txt"
_WRITTEN: dict[tuple[str, str, str], str] = {}


def _tasks(t: Star) -> int:
    return max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), 4 * t.spark.sparkContext.defaultParallelism)


def _tree(t: Star, kind: str, make: Callable[[Star], DataFrame], keys: list[str]) -> str:
    """The folder of a tree: one file for each row of ``make``, whose text is ``value``, in folders by the keys."""
    session = (t.spark.sparkContext.applicationId, t.folder, kind)
    if session not in _WRITTEN:
        path = f"{shared_folder(t.spark)}/{kind}-{uuid.uuid4().hex}/references"
        # files take far longer than their bytes: a given number of tasks, and a shuffle of its own, which a join can't replace
        make(t).repartition(_tasks(t), F.xxhash64(*keys)).write.partitionBy(*keys).text(path)
        _WRITTEN[session] = path
    return _WRITTEN[session]


def _documents(t: Star) -> DataFrame:
    """Entries of a supplier are its parts, some hundred whatever the size of the tables."""
    size, name = F.col("p_size"), F.col("part").cast("string")
    what = F.when(size % 5 == 0, F.format_string('names: ["%s a", "%s b"]', name, name)).when(size % 5 == 1, F.lit("category: 'none'")).otherwise(F.format_string('name: "%s"', name))
    where = F.when(size % 3 == 0, F.lit('locations: ["H", "Field"], ')).when(size % 3 == 1, F.format_string('locations: [{"House": "Jun %d"}, {"Field": "NA"}], // one place\n', size % 28 + 1)).otherwise("")
    entry = F.format_string("    {%stype: '%s', %s, harvest_time: \"%d days\"},", where, F.col("p_type"), what, F.col("start"))
    parts = t.part.select(F.col("p_partkey").alias("part"), "p_type", "p_size")
    entries = observed(t).join(parts, "part").repartition(_tasks(t), "place").groupBy("place").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", entry.alias("e")))), lambda x: x["e"]), "\n").alias("entries"))
    rows = t.supplier.join(entries, F.col("s_suppkey") == F.col("place"), "left")
    head = F.format_string('{ // of a supplier\n  title: "%s", type: "Extension Test", needs_help: %s,\n', F.col("s_name"), (F.col("s_acctbal") < 0).cast("string"))
    places = F.format_string('  locations: [ {name: "House", short_name: "H", latitude: %.1f, longitude: 1.5}, {name: "Field", latitude: -2.0, longitude: 3}, ],\n', F.col("s_nationkey").cast("double"))
    return rows.select(F.col("s_suppkey").alias("doc"), F.concat(head, places, F.lit("  plants: [ /* entries\n  */\n"), F.coalesce("entries", F.lit("")), F.lit("\n  ],\n}")).alias("value"))


def _read(t: Star) -> DataFrame:
    docs, bad = source.read_documents(t.spark, _tree(t, "documents", _documents, ["doc"]), pattern=FILES)
    return docs


@query(f"WITH {OBSERVED} SELECT s_name AS title, 'doc=' || s_suppkey || '/' AS path, s_acctbal < 0 AS needs_help, 2 AS n_places, CAST(count(o.part) AS INTEGER) AS n_entries, row_number() OVER (ORDER BY 'doc=' || s_suppkey || '/') AS source_id FROM supplier LEFT JOIN observed o ON place = s_suppkey GROUP BY s_suppkey, s_name, s_acctbal")
def read_documents(t: Star) -> DataFrame:
    """One relaxed-JSON document a file, numbered by the files' names."""
    return _read(t).select("title", "path", "needs_help", F.size("locations").alias("n_places"), F.size("plants").alias("n_entries"), "source_id")


@query("SELECT s_name AS title, k AS number, CASE k WHEN 1 THEN 'House' ELSE 'Field' END AS name, CASE k WHEN 1 THEN CAST(s_nationkey AS DOUBLE) ELSE -2.0::DOUBLE END AS latitude FROM supplier, (VALUES (1), (2)) v(k)")
def explode_places(t: Star) -> DataFrame:
    return source.explode_places(_read(t)).select("title", "number", "name", "latitude")


_ENTRIES = f"""{OBSERVED}, parts AS (SELECT place, part, p_type AS type, p_size, start FROM observed JOIN part ON p_partkey = part),
named AS (SELECT place, part, type, p_size, start, CAST(part AS VARCHAR) || suffix AS name FROM parts JOIN (VALUES (0, ' a'), (0, ' b'), (2, ''), (3, ''), (4, '')) v(k, suffix) ON k = p_size % 5)"""


def _titled(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.join(sent_pairs(docs.select("source_id", F.regexp_extract("path", "doc=([0-9]+)/", 1).cast("bigint").alias("place_key"))), "source_id")


@query(f"WITH {_ENTRIES} SELECT place AS place_key, type, name, start || ' days' AS harvest_time FROM named")
def explode_entries(t: Star) -> DataFrame:
    """One row a name of an entry."""
    docs = _read(t)
    return _titled(source.explode_entries(docs)[0], docs).select("place_key", "type", "name", "harvest_time")


@query(f"WITH {_ENTRIES} SELECT place AS place_key, count(*) AS n FROM parts WHERE p_size % 5 = 1 GROUP BY 1")
def wrong_entries(t: Star) -> DataFrame:
    """Entries with neither a name nor names, a document."""
    docs = _read(t)
    return _titled(source.explode_entries(docs)[1], docs).groupBy("place_key").agg(F.count("*").alias("n"))


@query(f"""
WITH {_ENTRIES} SELECT place AS place_key, name, CASE WHEN p_size % 3 = 2 THEN NULL WHEN k = 1 THEN 'House' ELSE 'Field' END AS place_name,
  CASE WHEN p_size % 3 = 1 THEN 'Jun ' || (p_size % 28 + 1) ELSE start || ' days' END AS time, CASE WHEN p_size % 3 = 2 THEN 0 ELSE k END AS number
FROM named JOIN (VALUES (1), (2)) v(k) ON k = 1 OR p_size % 3 = 0""")
def explode_entry_places(t: Star) -> DataFrame:
    """One row a place of a name: short names, objects with their own times, and no place at all."""
    docs = _read(t)
    places = source.explode_places(docs).withColumn("place_id", F.col("number"))
    rows = source.explode_entry_places(source.explode_entries(docs)[0])
    rows = resolve.resolve_place_name(rows, places, doc="source_id")
    rows = resolve.resolve_place_id(rows, places, doc="source_id")
    return _titled(rows, docs).select("place_key", "name", "place_name", "time", "number")


def _gazetteer(t: Star) -> str:
    session = (t.spark.sparkContext.applicationId, t.folder, "gazetteer")
    if session not in _WRITTEN:
        path = f"{shared_folder(t.spark)}/gazetteer-{uuid.uuid4().hex}"
        nothing = [F.lit(1).alias(c) for c in ("ALAND", "AWATER", "ALAND_SQMI", "AWATER_SQMI")]
        rows = points(t).select(F.lpad(F.col("c_custkey").cast("string"), 7, "0").alias("GEOID"), *nothing, F.format_string("%.6f", "lat").alias("INTPTLAT"), F.format_string(" %.6f  ", "lon").alias("INTPTLONG   "))
        rows.write.csv(path, sep="\t", header=True, ignoreTrailingWhiteSpace=False, ignoreLeadingWhiteSpace=False)
        _WRITTEN[session] = path
    return _WRITTEN[session]


@query(f"WITH {POINTS} SELECT CAST(c_custkey AS INTEGER) AS zip, round(lat, 6) AS lat, round(lon, 6) AS lon FROM points")
def read_gazetteer(t: Star) -> DataFrame:
    return source.read_gazetteer(t.spark, _gazetteer(t), 1)


def _array(rows: DataFrame, keys: list[str], order: str, element: Column) -> DataFrame:
    """Rows of a batch, of five hundred keys at most, as one array with a comma too many."""
    elements = F.transform(F.array_sort(F.collect_list(F.struct(order, element.alias("e")))), lambda x: x["e"])
    return rows.groupBy(*keys).agg(F.concat(F.lit("[ // batch\n"), F.array_join(elements, ",\n"), F.lit(",\n]")).alias("value"))


def _entities(t: Star) -> DataFrame:
    odd = F.col("p_size") % 10 == 0
    element = F.format_string("{name: \"%s %d\", AKA: ['%s'], patent: 'USPP%d'%s}", F.col("p_name"), F.col("p_partkey"), F.col("p_brand"), F.col("p_partkey"), F.when(odd, F.concat(F.lit(', type: "'), "p_type", F.lit('"'))).otherwise(""))
    rows = t.part.withColumn("type", F.when(odd, "Oddball").otherwise(F.col("p_type"))).withColumn("batch", F.floor(F.col("p_partkey") / 500))
    return _array(rows, ["type", "batch"], "p_partkey", element)


@query("SELECT p_type AS type, p_name || ' ' || p_partkey AS name, p_brand AS alias, 'USPP' || p_partkey AS patent FROM part")
def read_entities(t: Star) -> DataFrame:
    """Curated arrays; the type is the folder's name but in the odd ones, which name it."""
    kind = F.regexp_extract("file", "type=([^/]+)/", 1)
    found, _ = source.read_entities(t.spark, _tree(t, "entities", _entities, ["type", "batch"]), FILES, kind)
    return found.select("type", "name", F.get("AKA", F.lit(0)).alias("alias"), "patent")


def _types(t: Star) -> DataFrame:
    element = F.format_string('{name: "%s", latin_name: "%s"}', F.initcap("n_name"), F.col("n_name"))
    rows = _array(t.nation.withColumn("g", F.col("n_regionkey")), ["g"], "n_nationkey", element).join(t.region, F.col("g") == F.col("r_regionkey"))
    return rows.select("g", F.concat(F.lit('[{group_name: "'), "r_name", F.lit('", types: '), "value", F.lit("}]")).alias("value"))


@query("SELECT r_name AS group_name, n_name AS latin_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def read_types(t: Star) -> DataFrame:
    return source.read_types(t.spark, _tree(t, "types", _types, ["g"]), FILES)[0].select("group_name", "latin_name")


def _facts(t: Star) -> DataFrame:
    element = F.format_string("{contributor: '%s', fact: \"balance %.2f\", reference: 'http://x//%d'}", F.col("c_name"), F.col("c_acctbal"), F.col("c_custkey"))
    good = _array(t.customer.withColumn("batch", F.floor(F.col("c_custkey") / 500)), ["batch"], "c_custkey", element)
    return good.unionByName(good.select((-1 - F.col("batch")).alias("batch"), F.concat(F.lit("{ unfinished: "), "value").alias("value")))


@query("SELECT c_name AS contributor, 'http://x//' || c_custkey AS reference FROM customer")
def read_facts(t: Star) -> DataFrame:
    return source.read_facts(t.spark, _tree(t, "facts", _facts, ["batch"]), FILES)[0].select("contributor", "reference")


@query("SELECT DISTINCT -1 - c_custkey // 500 AS batch FROM customer")
def quarantined_files(t: Star) -> DataFrame:
    """Each batch of facts has a broken file beside the good one."""
    bad = source.read_facts(t.spark, _tree(t, "facts", _facts, ["batch"]), FILES)[1]
    return bad.select(F.regexp_extract("file", "batch=(-?[0-9]+)/", 1).cast("bigint").alias("batch"))


@query("SELECT c_custkey AS id, c_name AS name, true AS is_user FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_suppkey, s_name, false FROM supplier")
def replace_builtin_rows(t: Star) -> DataFrame:
    """Rows of users stay, all others are replaced."""
    path = f"{shared_folder(t.spark)}/table-{uuid.uuid4().hex}"
    t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_acctbal") < 0).alias("is_user")).write.partitionBy("is_user").parquet(path)
    changes.replace_builtin_rows(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), path)
    return t.spark.read.parquet(path).select("id", "name", F.col("is_user").cast("boolean").alias("is_user"))


@query("SELECT p_type AS type, CAST(min(p_size) AS BIGINT) AS day FROM part GROUP BY 1")
def json_result(t: Star) -> DataFrame:
    """A small result as one JSON file, read back."""
    path = f"{shared_folder(t.spark)}/result-{uuid.uuid4().hex}"
    source.write_json_result(t.part.groupBy(F.col("p_type").alias("type")).agg(F.min("p_size").alias("day")), path)
    return t.spark.read.json(path).select("type", "day")
