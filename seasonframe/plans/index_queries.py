"""Queries of what is kept in written tables: pages by rank, logs of changes, indexes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import materialized, shared_folder
from ..operators import cells, change_table, listing, paging, ranking, search
from .queries import POINTS, points
from .registry import Star, query


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("""
WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS place, count(*) OVER () AS total FROM orders)
SELECT place, o_orderkey, total, CAST(ceil(total / 40.0) AS BIGINT) AS last_page FROM r WHERE place > (total // 40 - 2) * 40 AND place <= (total // 40 - 1) * 40""")
def deep_page(t: Star) -> DataFrame:
    """The second page before the last of all orders by price: of the ranges, one or two are read."""
    index = paging.build_rank_index(t.orders.select("o_orderkey", "o_totalprice"), [F.desc_nulls_last("o_totalprice"), F.asc("o_orderkey")], scratch(t.spark, "pages"), range_rows=2000)
    page = index.page(index.count // 40 - 1, 40)
    within = Window.orderBy(F.desc_nulls_last("o_totalprice"), F.asc("o_orderkey"))  # of one page
    numbered = page.rows.withColumn("place", F.lit((page.page - 1) * 40) + F.row_number().over(within).cast("bigint"))
    return numbered.select("place", "o_orderkey", F.lit(page.count).cast("bigint").alias("total"), F.lit(page.last_page).cast("bigint").alias("last_page"))


@query("""
WITH f AS (SELECT o_orderkey, o_orderdate, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1997-01-01') OVER () AS past, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS r FROM orders)
SELECT o_orderkey, 1 + past // 50 AS midpoint_page FROM f WHERE r > (past // 50) * 50 AND r <= (past // 50) * 50 + 50""")
def midpoint_page(t: Star) -> DataFrame:
    """The page where the past ends, from the bounds of the ranges and a count in one of them."""
    rows = t.orders.select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("date"))
    index = paging.build_rank_index(rows, [F.asc_nulls_first("date"), F.asc("o_orderkey")], scratch(t.spark, "pages"), range_rows=2000, mark="date")
    page = index.page("mid", 50, now=F.lit("1997-01-01").cast("timestamp"))
    return page.rows.select("o_orderkey", F.lit(page.midpoint_page).cast("bigint").alias("midpoint_page"))


@query("""
WITH log AS (SELECT CASE WHEN event_type <> 'purchase' THEN user_id END AS id, event_id AS seq, event_type = 'error' AS deleted, CASE WHEN event_type <> 'click' THEN value END AS value,
  CASE WHEN event_type <> 'view' THEN props END AS note, user_id % 5 AS actor, CASE WHEN event_type = 'signup' THEN 1 END AS pub FROM events),
ok AS (SELECT log.* FROM log JOIN customer ON c_custkey = id WHERE pub IS NULL AND actor = c_nationkey % 5),
v AS (SELECT id, arg_max(value, seq) FILTER (WHERE value IS NOT NULL AND NOT deleted) AS value, arg_max(note, seq) FILTER (WHERE note IS NOT NULL AND NOT deleted) AS note, bool_or(deleted) AS gone FROM ok GROUP BY 1)
SELECT c_custkey AS id, coalesce(v.value, c_acctbal) AS value, coalesce(v.note, c_name) AS note FROM customer LEFT JOIN v ON v.id = c_custkey WHERE NOT coalesce(gone, false)
UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY seq), value, note FROM log WHERE id IS NULL AND pub IS NULL AND NOT deleted""")
def change_log(t: Star) -> DataFrame:
    """A log of changes in four portions, the latest first and one of them twice: the table that the log makes in order."""
    kind = F.col("event_type")
    rows = t.customer.select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 5).cast("bigint").alias("owner"), F.col("c_acctbal").alias("value"), F.col("c_name").alias("note"))
    log = t.events.select(
        F.when(kind != "purchase", F.col("user_id")).alias("id"), F.col("event_id").alias("seq"), (kind == "error").alias("deleted"), F.when(kind != "click", F.col("value")).alias("value"),
        F.when(kind != "view", F.col("props")).alias("note"), (F.col("user_id") % 5).alias("actor"), (F.col("user_id") % 5).alias("owner"), F.when(kind == "signup", 1).alias("collection_id"),
    )
    table = change_table.ChangeTable.create(rows, scratch(t.spark, "changes"), guard="collection_id", parts=8)
    last = t.events.agg(F.max("event_id")).first()[0] or 0
    for k in (3, 1, 2, 1, 0):
        table.apply(log.filter(F.floor(F.col("seq") * 4 / (last + 1)) == k))
    table.clear()
    return table.read().select("id", "value", "note")


_KM = "2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(p.lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - s.lon) / 2), 2))))"
_ASKED = "asked AS (SELECT s_suppkey, ((s_suppkey * 53) % 1801) / 10.0 - 90 AS lat, ((s_suppkey * 97) % 3600) / 10.0 - 180 AS lon, 20.0 + (s_suppkey * 31) % 900 AS km FROM supplier)"


def asked_points(t: Star) -> DataFrame:
    """A spot and a radius for each supplier, poles included."""
    k = F.col("s_suppkey")
    return t.supplier.select("s_suppkey", (k * 53 % 1801 / 10.0 - 90).alias("lat"), (k * 97 % 3600 / 10.0 - 180).alias("lon"), (20.0 + k * 31 % 900).alias("km"))


@query(f"WITH {POINTS}, {_ASKED} SELECT s_suppkey, c_custkey, round({_KM}, 6) AS distance FROM asked s, points p WHERE {_KM} <= s.km")
def near_many(t: Star) -> DataFrame:
    """All customers around all suppliers, by cells of the globe."""
    met = cells.near_points(asked_points(t), points(t).select("c_custkey", "lat", "lon"))
    return met.select("point.s_suppkey", "place.c_custkey", F.round("distance", 6).alias("distance"))


@query(f"""
WITH {POINTS}, {_ASKED}, d AS (SELECT *, km * 360 / 40075 AS dlat, CASE WHEN abs(lat) >= 90 THEN 0 ELSE km * 360 / 40075 * (90 - abs(lat)) / 90 END AS dlon FROM asked)
SELECT s_suppkey, c_custkey FROM d s, points p WHERE abs(p.lat - s.lat) < dlat AND abs(((p.lon - s.lon + 180) % 360 + 360) % 360 - 180) < dlon""")
def near_many_boxes(t: Star) -> DataFrame:
    """As ``near_many``, by boxes of degrees that narrow to the poles."""
    return cells.near_points(asked_points(t), points(t).select("c_custkey", "lat", "lon"), exact=False).select("point.s_suppkey", "place.c_custkey")


@query()
def cluster_pyramid(t: Star) -> DataFrame:
    """Customers on the map at zooms 0 to 8, past which they lie too far apart to meet; the rounds have no SQL."""
    found = cells.cluster_pyramid(points(t), "c_custkey", "c_acctbal", max_zoom=8)
    return found.select("zoom", "id", "n", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "parent", F.array_join(F.transform("best", lambda b: b.cast("string")), ",").alias("best"))


@query(r"""
WITH q AS (SELECT doc_id AS query, list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS w FROM documents WHERE doc_id % 100 = 0),
d AS (SELECT doc_id AS key, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
sums AS (SELECT count(*) AS n_docs, avg(len(w)) AS mean FROM d),
p AS (SELECT key, len(w) AS length, term, count(*) AS tf FROM (SELECT key, w, unnest(w) AS term FROM d) GROUP BY key, length, term),
t AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT query, key, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean))), 6) AS score FROM (SELECT query, unnest(w) AS term FROM q) JOIN t USING (term) JOIN p USING (term), sums GROUP BY 1, 2)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank, key, score FROM s QUALIFY rank <= 10""")
def ranked_search(t: Star) -> DataFrame:
    """Every hundredth document as a query against all: the ten best of each by BM25."""
    counted = ranking.count_words(t.documents, "doc_id", "text", scratch(t.spark, "words"))
    postings, terms = ranking.postings_of(counted)
    asked = t.documents.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query"), "text")
    found = ranking.bm25_top(asked, postings, terms, k=10, digits=6, counted=counted)
    return found.withColumn("rank", F.col("rank").cast("bigint"))


_MANY = "q AS (SELECT s_suppkey AS query, lower(split_part(p_name, ' ', 1)) AS word, CASE WHEN s_suppkey % 2 = 0 THEN p_size - 8 END AS least, CASE WHEN s_suppkey % 3 = 0 THEN p_type END AS kind FROM supplier JOIN part ON p_partkey = s_suppkey)"


@query(f"""
WITH {_MANY}, h AS (SELECT query, p_partkey, p_retailprice, count(*) OVER (PARTITION BY query) AS total FROM q JOIN part ON length(word) >= 3 AND contains(lower(p_name), word) AND (least IS NULL OR p_size >= least) AND (kind IS NULL OR p_type = kind))
SELECT query, row_number() OVER (PARTITION BY query ORDER BY p_retailprice DESC, p_partkey) AS rank, p_partkey, total FROM h QUALIFY rank <= 20""")
def search_many(t: Star) -> DataFrame:
    """A query for each supplier, with filters of its own: the twenty dearest parts of each, in one job."""
    rows = t.supplier.join(t.part, F.col("p_partkey") == F.col("s_suppkey"))
    asked = rows.select(F.col("s_suppkey").alias("query"), F.lower(F.substring_index("p_name", " ", 1)).alias("word"), F.when(F.col("s_suppkey") % 2 == 0, F.col("p_size") - 8).alias("least"), F.when(F.col("s_suppkey") % 3 == 0, F.col("p_type")).alias("kind"))
    words = asked.select("word").distinct().select(F.col("word").alias("query"), "word")
    hits = search.search_index(words, search.build_trigram_index(t.part, "p_partkey", "p_name"), t.part, "p_partkey", "p_name").withColumnRenamed("query", "word")
    parts = t.part.select("p_partkey", "p_retailprice", "p_size", "p_type")
    found = ranking.search_many(asked, hits, parts, "p_partkey", [F.desc_nulls_last("p_retailprice"), F.asc("p_partkey")], 20, equal={"p_type": "kind"}, at_least={"p_size": "least"}, by="word")
    return found.select("query", F.col("rank").cast("bigint").alias("rank"), "p_partkey", "total")


@query("""
SELECT prefix, row_number() OVER (PARTITION BY prefix ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS rank, c_custkey AS id FROM (SELECT substr(lower(c_name), 1, k) AS prefix, c_acctbal, c_custkey FROM customer, range(3, 21) r(k) WHERE length(c_name) >= k) QUALIFY rank <= 10""")
def completions(t: Star) -> DataFrame:
    """The ten best customers for every beginning of a name; all names begin alike."""
    found = ranking.completions(t.customer, "c_name", "c_acctbal", "c_custkey", longest=20)
    return found.select("prefix", F.col("rank").cast("bigint").alias("rank"), "id")


@query("""
WITH h AS (SELECT regexp_replace(url, '[^/]*$', '') AS path, count(*) AS n FROM pages WHERE url IS NOT NULL GROUP BY 1),
s AS (SELECT path, n, k AS depth, CASE WHEN k = 0 THEN '' ELSE array_to_string(string_split(path, '/')[1:k], '/') || '/' END AS folder, CASE WHEN k = 1 THEN '' WHEN k > 1 THEN array_to_string(string_split(path, '/')[1:k - 1], '/') || '/' END AS parent
  FROM (SELECT path, n, unnest(range(0, len(string_split(path, '/')))) AS k FROM h)),
f AS (SELECT folder, parent, depth, coalesce(sum(n) FILTER (WHERE path = folder), 0) AS n_here, sum(n) AS n_below FROM s GROUP BY ALL)
SELECT f.folder, f.parent, CAST(f.depth AS INTEGER) AS depth, CAST(f.n_here AS BIGINT) AS n_here, CAST(f.n_below AS BIGINT) AS n_below, count(c.folder) AS n_folders FROM f LEFT JOIN f c ON c.parent = f.folder GROUP BY ALL""")
def directory_tree(t: Star) -> DataFrame:
    """All folders of all pages at once."""
    return listing.directory_tree(t.pages.select(F.regexp_replace("url", "[^/]*$", "").alias("path")))


@query("""
WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN lower(p_brand || ' ' || p_name) ELSE lower(p_name) END AS text FROM part WHERE p_partkey % 7 <> 0)
SELECT DISTINCT substr(text, k, 3) AS trigram, p_partkey FROM n, range(1, 200) r(k) WHERE k <= length(text) - 2""")
def update_trigram_index(t: Star) -> DataFrame:
    """An index of all parts after a seventh of them is deleted and a fifth renamed: as a rebuild."""
    rows = t.part.select("p_partkey", F.col("p_name").alias("text"), "p_brand")
    gone, renamed = F.col("p_partkey") % 7 == 0, F.col("p_partkey") % 5 == 0
    after = rows.filter(renamed & ~gone).withColumn("text", F.concat_ws(" ", "p_brand", "text"))
    gained, lost = search.index_changes(rows.filter(gone | renamed), after, "p_partkey", "text")
    return search.merge_trigram_index(search.build_trigram_index(rows, "p_partkey", "text"), gained, lost, "p_partkey")
