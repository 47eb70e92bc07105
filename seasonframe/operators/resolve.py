"""From documents to entities, places and observations: lookups, roll-ups and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import format_tags, parse_tags, search_key

#: Keys that a task compares.
TASK_KEYS = 1_000_000


def lookup_or_self(df: DataFrame, value: str, names: DataFrame, keys: list[str], short: str, full: str, output: str) -> DataFrame:
    """``full`` of the name whose keys and ``short`` equal the row's keys and ``value``, else ``value`` itself.

    Several names with one key and short form: the least by ``position``, if the names have one, else by ``full``.
    """
    by = F.col("position") if "position" in names.columns else F.col(full)
    first = names.filter(F.col(short).isNotNull()).groupBy(*keys, F.col(short).alias("__short")).agg(F.min_by(full, by).alias("__full"))
    joined = df.join(first, [*keys], "left") if not short else df.withColumn("__short", F.col(value)).join(first, [*keys, "__short"], "left")
    return joined.withColumn(output, F.coalesce("__full", F.col(value))).drop("__short", "__full")


def resolve_place_name(entries: DataFrame, places: DataFrame, doc: str = "doc", place: str = "place", short: str = "short_name", name: str = "name", output: str = "place_name") -> DataFrame:
    """Full name for a short one of the same document, else the text; without text the document's only place."""
    only = places.groupBy(doc).agg(F.count("*").alias("__n"), F.min(name).alias("__only")).filter(F.col("__n") == 1).drop("__n")
    found = lookup_or_self(entries, place, places, [doc], short, name, output)
    return found.join(only, doc, "left").withColumn(output, F.coalesce(output, "__only")).drop("__only")


def resolve_place_id(entries: DataFrame, places: DataFrame, doc: str = "doc", name: str = "place_name", place_name: str = "name", place_id: str = "place_id", number: str = "number") -> DataFrame:
    """Id and number of the place if exactly one of the document bears the name; else no id and number 0."""
    unique = places.groupBy(doc, F.col(place_name).alias(name)).agg(F.count("*").alias("__n"), F.min(place_id).alias(place_id), F.min(number).alias(number)).filter(F.col("__n") == 1).drop("__n")
    return entries.join(unique, [doc, name], "left").withColumn(number, F.coalesce(number, F.lit(0)))


def fill_category(description: Column, category: Column, categories: Column) -> Column:
    """Own description, else that of the category in an array of struct(name, description)."""
    found = F.filter(categories, lambda c: c["name"] == category)
    return F.coalesce(description, F.get(found, F.lit(0))["description"])


def attach_attributes(df: DataFrame, other: DataFrame, keys: list[str], attributes: list[str]) -> DataFrame:
    """Left join of some columns of ``other``, whose keys are unique."""
    return df.drop(*[a for a in attributes if a not in keys]).join(other.select(*keys, *attributes), keys, "left")


def attach_entity_id(observations: DataFrame, entities: DataFrame, keys: list[str], entity_id: str = "entity_id") -> DataFrame:
    return attach_attributes(observations, entities, keys, [entity_id])


def entity_rollup(references: DataFrame, keys: list[str], source: str, score: str, ignore: str | None = None, curated: DataFrame | None = None, distinct_sources: bool = False) -> DataFrame:
    """Keys, ``n_references``, ``best_score``, ``best_source`` (the least source of those with the best score) and
    ``ignore`` (true if every source says so).

    Curated entities come with no reference of their own. A source counts once an entry, or once with
    ``distinct_sources``. All aggregates combine before the shuffle.
    """
    ignored = F.lit(False) if ignore is None else F.coalesce(F.col(ignore), F.lit(False))
    rows = references.select(*keys, F.col(source).alias("__source"), F.col(score).cast("double").alias("__score"), ignored.alias("__ignore"))
    if distinct_sources:
        rows = rows.groupBy(*keys, "__source").agg(F.max("__score").alias("__score"), F.min("__ignore").alias("__ignore"))
    rows = rows.withColumn("__one", F.lit(1))
    if curated is not None:
        nothing = [F.lit(None).cast(rows.schema["__source"].dataType).alias("__source"), F.lit(None).cast("double").alias("__score"), F.lit(False).alias("__ignore"), F.lit(0).alias("__one")]
        rows = rows.unionByName(curated.select(*keys, *nothing))
    best = F.min(F.when(F.col("__score").isNotNull(), F.struct((-F.col("__score")).alias("s"), F.col("__source").alias("i"))))
    out = rows.groupBy(*keys).agg(F.sum("__one").alias("n_references"), best.alias("__b"), F.min("__ignore").alias("ignore"))
    return out.select(*keys, "n_references", (-F.col("__b.s")).alias("best_score"), F.col("__b.i").alias("best_source"), "ignore")


def first_value_checked(df: DataFrame, keys: list[str], field: str, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(values, conflicts): the one non-null value of a field, and the keys where there are several.

    The first by ``order`` stands for the value; conflicts are (keys, field, n_values, values), values being the
    least and the greatest.
    """
    pick = F.min(field) if order is None else F.min_by(field, F.when(F.col(field).isNotNull(), F.col(order)))
    found = df.filter(F.col(field).isNotNull()).groupBy(*keys).agg(pick.alias(field), F.min(field).alias("__lo"), F.max(field).alias("__hi"), F.count_distinct(field).alias("__n"))
    conflicts = found.filter(F.col("__n") > 1).select(*keys, F.lit(field).alias("field"), F.col("__n").alias("n_values"), F.array("__lo", "__hi").alias("values"))
    return found.select(*keys, field), conflicts


def merge_tags(df: DataFrame, keys: list[str], text: str | None = None, tag: str | None = None, source: str | None = None, output: str = "tags") -> DataFrame:
    """One text of tags and their sources an entity, from tag texts or from plain (tag, source) columns."""
    if text is not None:
        pairs = df.select(*keys, F.explode(parse_tags(F.col(text))).alias("t")).select(*keys, F.col("t.tag").alias("tag"), F.explode("t.ids").alias("id"))
    else:
        pairs = df.filter(F.col(tag).isNotNull()).select(*keys, F.col(tag).alias("tag"), F.col(source).cast("string").alias("id"))
    sets = pairs.groupBy(*keys, "tag").agg(F.collect_set("id").alias("ids"))
    return sets.groupBy(*keys).agg(format_tags(F.collect_list(F.struct("tag", "ids"))).alias(output))


def release_source(df: DataFrame, keys: list[str], release: str, source: str) -> DataFrame:
    """The source whose release text is authoritative, an entity; the least of several."""
    return df.filter(F.col(release)["authoritative"]).groupBy(*keys).agg(F.min(source).alias(source))


def drop_unconfirmed(entities: DataFrame, ignore: str = "ignore") -> DataFrame:
    """Without entities that only sources to be ignored name."""
    return entities.filter(~F.coalesce(F.col(ignore), F.lit(False)))


def missing_references(df: DataFrame, keys: list[str], dimension: DataFrame, dimension_keys: list[str] | None = None) -> DataFrame:
    """Distinct keys that the dimension lacks. Both sides are dealt out by key, ``TASK_KEYS`` of the longer one a task."""
    known = dimension.select(*[F.col(d).alias(k) for d, k in zip(dimension_keys or keys, keys, strict=True)])
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-max(df.count(), known.count()) // TASK_KEYS))
    dealt = lambda rows: rows.repartition(tasks, *keys).distinct()
    return dealt(df.select(*keys)).join(dealt(known), keys, "left_anti")


def alias_conflicts(entities: DataFrame, scope: list[str], key: str, aliases: str | None = None) -> DataFrame:
    """(scope, alias, kind, n): an alias of two entities of a scope, or an entity's key that is another's alias."""
    if aliases is None:
        return entities.groupBy(*scope, F.col(key).alias("alias")).agg(F.count("*").alias("n")).filter("n > 1").select(*scope, "alias", F.lit("repeated").alias("kind"), "n")
    one = entities.select(*scope, F.col(key).alias("__key"), F.explode(F.array_distinct(aliases)).alias("alias"))
    repeated = one.groupBy(*scope, "alias").agg(F.count("*").alias("n")).filter("n > 1").select(*scope, "alias", F.lit("repeated").alias("kind"), "n")
    keys = entities.select(*scope, F.col(key).alias("alias"), F.col(key).alias("__own")).distinct()
    of_other = one.join(keys, [*scope, "alias"]).filter(F.col("__key") != F.col("__own")).groupBy(*scope, "alias").agg(F.count("*").alias("n")).select(*scope, "alias", F.lit("name").alias("kind"), "n")
    return repeated.unionByName(of_other)


def attach_search_fields(entities: DataFrame, name: str = "name", output: str = "name_key") -> DataFrame:
    return entities.withColumn(output, search_key(F.col(name)))


def source_name_lookup(df: DataFrame, source: str, sources: DataFrame, source_id: str, title: str, output: str = "source_name") -> DataFrame:
    """The title of a source; ``collection N`` for one without, ``collection N not found``, or ``no collection``."""
    known = sources.select(F.col(source_id).alias("__id"), F.col(title).alias("__title"), F.lit(True).alias("__known"))
    number = F.concat(F.lit("collection "), F.col(source).cast("string"))
    name = F.when(F.col(source).isNull(), "no collection").when(F.col("__known").isNull(), F.concat(number, F.lit(" not found"))).otherwise(F.coalesce("__title", number))
    return df.join(known, F.col(source) == F.col("__id"), "left").withColumn(output, name).drop("__id", "__title", "__known")


def source_weights(observations: DataFrame, source: str, sources: DataFrame, source_id: str, score: str, devalue: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(weighted, missing): score and devalue factor joined to each observation; those whose source is not there."""
    factor = F.lit(0.0) if devalue is None else F.coalesce(F.col(devalue).cast("double"), F.lit(0.0))
    known = sources.select(F.col(source_id).alias(source), F.col(score).cast("double").alias("source_score"), factor.alias("devalue"))
    return observations.join(known, source), observations.join(known, source, "left_anti")


def with_children(parents: DataFrame, children: dict[str, tuple[DataFrame, list[str]]], keys: list[str]) -> DataFrame:
    """Each parent with its children nested, as arrays of structs sorted by the columns named first.

    ``children``: name to (rows, columns). Filter the parents first: a parent's children meet in one row.
    """
    for name, (rows, columns) in children.items():
        nested = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
        parents = parents.join(nested, keys, "left").withColumn(name, F.coalesce(name, F.array().cast(nested.schema[name].dataType)))
    return parents
