"""Substring search with filters, order and paging."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import materialized, spread

#: Rows of rarest trigrams that are sent to all tasks; beyond, Spark joins them as it sees fit.
SENT_ROWS = 200_000
#: Postings, or texts, that a task compares.
TASK_ROWS = 500_000
#: Texts that a task cuts into trigrams.
TASK_TEXTS = 100_000

ORDERS = ("notoriety", "type_then_name", "name_then_type", "patent_expiration", "harvest_time")


@dataclass(frozen=True)
class Terms:
    """Any of ``words`` is to be found; ``type`` limits the kind of entity."""

    words: tuple[str, ...]
    type: str | None = None


def search_terms(text: str, types: list[str]) -> Terms:
    """Words of letters and digits. A last word that is a type becomes a filter; of several words their run-together
    form counts too."""
    words = re.sub("[^0-9A-Za-z ]", "", text.strip()).split()
    several = len(words) >= 2
    kind = None
    if several:
        kind = next((t for t in types if t.lower() == words[-1].lower() and " " not in t), None)
        if kind is not None:
            words = words[:-1]
    joined = ["".join(words)] if several and "".join(words) not in words else []
    return Terms(tuple(words + joined), kind)


def search_terms_column(text: Column, types: list[str]) -> Column:
    """``search_terms`` for a column of queries: struct(words, type)."""
    kinds = F.create_map(*[F.lit(x) for t in types if " " not in t for x in (t.lower(), t)]) if types else None
    words = F.filter(F.split(F.trim(F.regexp_replace(text, "[^0-9A-Za-z ]", "")), " +"), lambda w: w != "")
    several = F.size(words) >= 2
    kind = F.when(several, F.try_element_at(kinds, F.lower(F.try_element_at(words, F.lit(-1))))) if kinds is not None else F.lit(None).cast("string")
    left = F.when(kind.isNotNull(), F.slice(words, F.lit(1), F.size(words) - 1)).otherwise(words)
    return F.struct(F.when(several, F.array_union(left, F.array(F.array_join(left, "")))).otherwise(left).alias("words"), kind.alias("type"))


def trigram_match(entities: DataFrame, words: tuple[str, ...] | list[str], fields: list[str]) -> DataFrame:
    """Rows of which a field contains a word of three signs or more; case does not count."""
    condition = F.lit(False)
    for word in words:
        if len(word) >= 3:
            for f in fields:
                value = F.array_join(F.col(f), " ") if entities.schema[f].dataType.typeName() == "array" else F.col(f)
                condition = condition | F.coalesce(F.lower(value).contains(word.lower()), F.lit(False))
    return entities.filter(condition)


def build_trigram_index(entities: DataFrame, key: str, field: str) -> DataFrame:
    """(trigram, key), distinct: an inverted index to be written once and joined with many queries.

    Texts are dealt out first, so that a task makes, and a writer sorts, the trigrams of ``TASK_TEXTS``.
    """
    low = F.lower(F.col(field))
    grams = F.when(F.length(low) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda k: F.substr(low, k, F.lit(3)))))
    return spread(entities.select(field, key), rows=TASK_TEXTS).select(F.explode(grams).alias("trigram"), key)


def index_changes(before: DataFrame, after: DataFrame, key: str, field: str) -> tuple[DataFrame, DataFrame]:
    """(gained, lost): the (trigram, key) that rows have after a change and not before, and the other way round.

    ``before`` and ``after`` are the changed rows alone; inserted ones are only in the second, deleted ones in the first.
    """
    old, new = build_trigram_index(before, key, field), build_trigram_index(after, key, field)
    return new.join(old, ["trigram", key], "left_anti"), old.join(new, ["trigram", key], "left_anti")


def merge_trigram_index(index: DataFrame, gained: DataFrame, lost: DataFrame, key: str) -> DataFrame:
    """The index with what was gained and without what was lost: as a rebuild would make it, without reading any text.

    What the index has already is not gained twice, so that a change may be merged again.
    """
    kept = index.join(lost.unionByName(gained), ["trigram", key], "left_anti")
    return kept.unionByName(gained.select(*index.columns))


def write_trigram_index(index: DataFrame, table: str, buckets: int = 64, path: str | None = None) -> None:
    """Replace the index table, bucketed by trigram; below ``path``, if one is given."""
    writer = index.write.mode("overwrite").bucketBy(buckets, "trigram").sortBy("trigram")
    (writer if path is None else writer.option("path", path)).saveAsTable(table)


def index_sizes(index: DataFrame) -> DataFrame:
    """(trigram, __size): counted where the postings lie, so that of each task only its distinct trigrams are moved.

    Were postings dealt out by trigram before, a task would have all those of a frequent one.
    """
    return index.groupBy("trigram").agg(F.count("*").alias("__size"))


def search_index(queries: DataFrame, index: DataFrame, entities: DataFrame, key: str, field: str, query: str = "query", word: str = "word") -> DataFrame:
    """(query, key) of a table of (query, word): each word's rarest trigrams meet the index, and hits are verified.

    Postings are counted a trigram; a word with a trigram that the index lacks has no hit. A key needs
    the two rarest of a word; only such candidates are joined with their text. The postings that words meet number what the
    counts say, and are dealt out by key to as many tasks as that asks for.
    """
    low = F.lower(F.col(word))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda k: F.substr(low, k, F.lit(3))))
    asked = queries.filter(F.length(word) >= 3).select(query, word, F.explode(grams).alias("trigram"))
    sized = asked.join(index_sizes(index), "trigram", "left").withColumn("__size", F.coalesce("__size", F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(query, word).orderBy("__size", "trigram"))
    rarest = sized.withColumn("__k", rank).filter((F.col("__k") <= 2) & (F.col("__size") > 0))
    rarest = rarest.withColumn("__n", F.count("*").over(Window.partitionBy(query, word)))
    rarest = materialized(rarest.select(query, word, "trigram", "__size", "__n"))
    rows, postings = rarest.agg(F.count("*"), F.coalesce(F.sum("__size"), F.lit(0))).first()
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-max(postings, entities.count()) // TASK_ROWS))
    if rows <= SENT_ROWS:
        # the index may be small on disk and long, and a bucket hold a trigram of many words: each posting moves once, words meet it there
        wanted = index.join(F.broadcast(rarest.select("trigram").distinct()), "trigram", "left_semi")
        hits = wanted.repartition(tasks, key).join(F.broadcast(rarest), "trigram").select(query, word, key, "__n")
    else:
        hits = index.join(rarest, "trigram").select(query, word, key, "__n").repartition(tasks, key)
    met = hits.groupBy(query, word, key).agg(F.count("*").alias("__met"), F.first("__n").alias("__n")).filter(F.col("__met") == F.col("__n"))
    texts = entities.select(key, F.col(field).alias("__text")).repartition(tasks, key)
    return met.join(texts, key).filter(F.lower("__text").contains(F.lower(F.col(word)))).select(query, key).distinct()


def filter_entities(df: DataFrame, equal: dict | None = None, at_least: dict | None = None, at_most: dict | None = None, present: dict[str, bool] | None = None) -> DataFrame:
    """Equality, inclusive bounds (null fails them), and presence or absence of columns; None values ask nothing."""
    for c, v in (equal or {}).items():
        df = df if v is None else df.filter(F.col(c) == v)
    for c, v in (at_least or {}).items():
        df = df if v is None else df.filter(F.col(c) >= v)
    for c, v in (at_most or {}).items():
        df = df if v is None else df.filter(F.col(c) <= v)
    for c, v in (present or {}).items():
        df = df if v is None else df.filter(F.col(c).isNotNull() if v else F.col(c).isNull())
    return df


def order_keys(order_by: str = "notoriety", order: str | None = None, columns: dict[str, str] | None = None, row_id: str = "id") -> tuple[list[Column], str | None]:
    """(sort keys, the column that must not be null). Descending, but patent expiry ascending; id breaks ties."""
    if order_by not in ORDERS:
        raise ValueError(f"unknown order {order_by!r}")
    if order not in (None, "asc", "desc"):
        raise ValueError(f"unknown direction {order!r}")
    name = {"notoriety": "score", "type": "type", "name": "name", "patent_expiration": "patent_expires", "harvest_time": "offset"} | (columns or {})
    up = (order or ("asc" if order_by == "patent_expiration" else "desc")) == "asc"
    keys = {"type_then_name": ["type", "name"], "name_then_type": ["name", "type"]}.get(order_by, [order_by])
    sort = [F.col(name[k]).asc_nulls_first() if up else F.col(name[k]).desc_nulls_last() for k in keys]
    return [*sort, F.col(row_id).asc()], name[order_by] if order_by in ("patent_expiration", "harvest_time") else None


def patent_midpoint(df: DataFrame, expires: str, now, per_page: int) -> int:
    """The page, from 1, where expired patents end in ascending order."""
    past = df.agg(F.count_if(F.col(expires) < now)).first()[0]
    return 1 + past // per_page


@dataclass
class Page:
    rows: DataFrame
    count: int
    page: int
    last_page: int
    midpoint_page: int | None = None
    terms: Terms | None = field(default=None)


def paginate(df: DataFrame, sort: list[Column], page: int | str | None = 1, per_page: int | None = None, midpoint: int | None = None, count: int | None = None) -> Page:
    """Page by page from 1; ``mid`` is the midpoint's. Without ``per_page`` there is one page."""
    if page == "mid":
        if midpoint is None:
            raise ValueError("no midpoint to turn to")
        page = midpoint
    page = 1 if page is None else int(page)
    if page < 1 or (per_page is None and page != 1):
        raise ValueError(f"no page {page}")
    count = df.count() if count is None else count
    ordered = df.orderBy(*sort)
    if per_page is None:
        return Page(ordered, count, 1, 1)
    return Page(ordered.offset((page - 1) * per_page).limit(per_page), count, page, -(-count // per_page))


def browse_type(df: DataFrame, kind: str, page: int = 0, per_page: int = 50, type_column: str = "type", row_id: str = "id") -> Page:
    """Pages of a type from 0, in order of the id."""
    rows = df.filter(F.col(type_column) == kind)
    found = paginate(rows, [F.col(row_id).asc()], page + 1, per_page)
    return Page(found.rows, found.count, page, max(0, found.last_page - 1))


def search(entities: DataFrame, text: str | None = None, types: list[str] = (), order_by: str = "notoriety", order: str | None = None, page: int | str | None = 1, per_page: int | None = 50, now=None, near: DataFrame | None = None, fields: list[str] = ("name_key", "aka_fts"), columns: dict[str, str] | None = None, row_id: str = "id", **filters) -> Page:
    """One logical plan of text match, filters, nearby entities (``near``: their ids), order and page.

    An empty text finds nothing; ``None`` asks for no text match.
    """
    terms = None
    if text is not None:
        terms = search_terms(text, list(types))
        entities = trigram_match(entities, terms.words, [f for f in fields if f in entities.columns]) if terms.words else entities.filter(F.lit(False))
        entities = filter_entities(entities, equal={"type": terms.type})
    entities = filter_entities(entities, **filters)
    if near is not None:
        entities = entities.join(near.select(row_id), row_id, "left_semi")
    sort, needed = order_keys(order_by, order, columns, row_id)
    if needed is not None:
        entities = entities.filter(F.col(needed).isNotNull())
    middle = None
    counted = [F.count("*")] + ([F.count_if(F.col(needed) < now)] if order_by == "patent_expiration" and now is not None else [])
    sums = entities.agg(*counted).first()
    if len(counted) > 1 and per_page:
        middle = 1 + sums[1] // per_page
    found = paginate(entities, sort, page, per_page, middle, sums[0])
    found.midpoint_page, found.terms = middle, terms
    return found


def autocomplete(entities: DataFrame, prefix: str, name: str = "name", marketing: str = "marketing_name", score: str = "score", n: int = 10, **search_options) -> DataFrame:
    """The ten best by score for three signs or more, as (label, id columns)."""
    if len(prefix) < 3:
        return entities.filter(F.lit(False)).withColumn("label", F.col(name))
    rows = search(entities, prefix, per_page=n, columns={"notoriety": score}, **search_options).rows
    label = F.when(F.col(marketing).isNotNull(), F.format_string("%s (%s)", F.col(name), F.col(marketing))).otherwise(F.col(name)) if marketing in entities.columns else F.col(name)
    return rows.withColumn("label", label)


def rank_by_trigrams(df: DataFrame, text: str, field_: str, output: str = "rank") -> DataFrame:
    """Extension: the share of the text's trigrams that a field contains."""
    low = text.lower()
    grams = sorted({low[k : k + 3] for k in range(len(low) - 2)})
    if not grams:
        return df.withColumn(output, F.lit(0.0))
    return df.withColumn(output, sum((F.lower(F.col(field_)).contains(g).cast("double") for g in grams), F.lit(0.0)) / len(grams))
