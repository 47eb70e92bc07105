"""Documents to entities, sources, places and observations with offsets, in one run of stages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.fields import alias_fields, patent_info, release_info, search_key
from ..functions.timetext import day_range, harvest_label, parse_distinct, two_season
from ..lineage import materialized
from ..operators import align, asof, infer, listing, quality, resolve, score
from ..sources import documents as source


@dataclass
class Tables:
    sources: DataFrame
    places: DataFrame
    observations: DataFrame
    entities: DataFrame
    anchor_days: DataFrame
    conflicts: DataFrame
    members: DataFrame  # the rows behind each entity's consensus
    summary: DataFrame  # (table, n)
    report: DataFrame


def load(spark: SparkSession, references: str, curated: str | None = None, as_of_year: int = 2024, max_rounds: int = 10, window: int = 10, strict: bool = False) -> Tables:
    """Read, parse, roll up, resolve, infer, fill, score and align. Frames are lazy but for the inference rounds.

    A source of an unknown type has no score, and its rows take no part in any consensus; the report names the type.
    ``strict`` stops the load at such a type and at unreadable files.
    """
    docs, quarantine = source.read_documents(spark, references)
    docs = docs.persist()
    scored, unknown = score.score_sources(docs, "type")
    base, bad_curated = source.read_entities(spark, curated) if curated is not None else (None, None)
    if bad_curated is not None:
        quarantine = quarantine.unionByName(bad_curated)
    if strict:
        quality.quality_report([quality.missing(quarantine, "unreadable document", ["file"]), quality.missing(unknown, "unknown source type", ["type"])], strict=True)
    sources = scored.select("source_id", "path", "filename", "title", "url", "type", "needs_help", "thumbnail", F.coalesce("harvest_time_devalue_factor", F.lit(0.0)).alias("devalue"), F.coalesce("ignore_unless_in_others", F.lit(False)).alias("ignore"), "source_score", "score_explanation")
    places = source.number_rows(source.explode_places(docs), ["source_id", "number"], "place_id")

    entries, wrong = source.explode_entries(docs)
    rows = source.explode_entry_places(entries.withColumn("category_description", resolve.fill_category(F.col("category_description"), F.col("category"), F.col("categories"))).drop("categories"))
    short = places.filter(F.col("short_name").isNotNull()).groupBy("source_id", F.col("short_name").alias("place")).agg(F.min_by("name", "position").alias("full_name"))
    rows = rows.join(short, ["source_id", "place"], "left")
    rows = rows.withColumn("place_name", F.coalesce("full_name", "place", "only_place")).drop("full_name", "only_place")
    rows = resolve.resolve_place_id(rows, places, doc="source_id", place_name="name")
    rows = parse_distinct(rows, "time", lambda t: F.struct(two_season(t, window).alias("times"), day_range(t, window)["parse_type"].alias("parse_type")), "t")
    rows = rows.select("*", "t.times.*", "t.parse_type").drop("t").withColumnRenamed("harvest_time_relative", "relative")
    rows = rows.withColumn("harvest_label", harvest_label(F.col("time"), F.col("harvest_time_unparsed")))
    rows = materialized(rows)
    docs.unpersist()
    # one row a key: the first entry of a document counts, and the report names the others
    first = Window.partitionBy("source_id", "place_id", "name", "type").orderBy("entry", "place")
    every = rows
    rows = materialized(rows.withColumn("n", F.row_number().over(first)).filter("n = 1 or place_id is null").drop("n"))
    observations = source.number_rows(rows, ["source_id", "entry", "name", "place"], "id").withColumnRenamed("place_id", "place_key")
    observations = observations.withColumn("place_text", F.col("place")).withColumn("place", F.col("place_key")).drop("place_key")

    # entities: curated ones and all that a document names
    with_source = rows.join(sources.select("source_id", "source_score", "ignore"), "source_id")
    once = with_source.dropDuplicates(["source_id", "entry", "name"])
    entities = resolve.entity_rollup(once, ["type", "name"], "source_id", "source_score", "ignore", base)
    entities = resolve.drop_unconfirmed(entities)
    described = once.select("type", "name", "source_id", "AKA", "patent", "released", "s_allele")
    if base is not None:
        described = base.select("type", "name", F.lit(0).cast("long").alias("source_id"), "AKA", "patent", "released", "s_allele").unionByName(described)
    described = described.withColumn("r", release_info(F.col("released"))).withColumn("p", patent_info(F.col("patent")))
    described = described.select("type", "name", "source_id", "AKA", "s_allele", F.col("p.number").alias("patent_number"), F.unix_timestamp("p.expires").alias("patent_expires"), F.col("r.year").alias("release_year"), F.col("r.by").alias("released_by"), "r")
    conflicts = None
    authoritative = resolve.release_source(described, ["type", "name"], "r", "source_id").withColumnRenamed("source_id", "release_source")
    entities = entities.join(authoritative, ["type", "name"], "left")
    for f in ("patent_number", "patent_expires", "release_year", "released_by"):
        values, wrong_values = resolve.first_value_checked(described, ["type", "name"], f, "source_id")
        entities = entities.join(values, ["type", "name"], "left")
        wrong_values = wrong_values.withColumn("values", F.col("values").cast("array<string>"))
        conflicts = wrong_values if conflicts is None else conflicts.unionByName(wrong_values)
    aliases = described.filter(F.col("AKA").isNotNull()).groupBy("type", "name").agg(alias_fields(F.array_sort(F.array_distinct(F.flatten(F.collect_list("AKA"))))).alias("a"))
    tags = resolve.merge_tags(described, ["type", "name"], text="s_allele", output="s_allele")
    entities = entities.join(aliases, ["type", "name"], "left").select("*", "a.*").drop("a").join(tags, ["type", "name"], "left")
    entities = asof.fill_from_patent(entities).withColumn("name_key", search_key(F.col("name")))

    observed = infer.relative_to_absolute(observations).join(sources.select("source_id", "source_score", "devalue"), "source_id").withColumn("source", F.col("source_id").cast("string"))
    inferred, offsets = infer.infer_offsets(observed, dims.anchors(spark), max_rounds, explain=True)
    members = infer.consensus_members(inferred, offsets)
    entities = entities.join(offsets.drop("entity_round"), ["type", "name"], "left").withColumnRenamed("entity_offset", "offset")
    named = resolve.source_name_lookup(entities, "best_source", sources, "source_id", "title")
    entities = named.withColumn("s", score.entity_score(F.col("best_score"), F.col("source_name"), F.col("release_year"), F.col("n_references"), F.col("patent_number"), as_of_year)).select("*", F.col("s.score").alias("score"), F.col("s.explanation").alias("score_explanation")).drop("s")
    entities = source.number_rows(entities, ["type", "name"], "entity_id")
    inferred = resolve.attach_attributes(inferred, entities, ["type", "name"], ["entity_id", "marketing_name"])
    days = align.largest_component(align.align_anchors(inferred, dims.anchors(spark)))
    report = quality.quality_report([
        quality.missing(quarantine, "unreadable document", ["file"]),
        quality.missing(unknown, "unknown source type", ["type"]),
        quality.violations(wrong, "name xor names", F.lit(True), F.col("source_id")),
        quality.empty_time(rows, F.concat_ws("/", "source_id", "name"), "time"),
        quality.unparsed_time(rows, F.concat_ws("/", "source_id", "name"), F.coalesce(F.col("start").cast("string"), F.col("parse_type")), "time"),
        quality.missing(conflicts, "field conflict", ["type", "name", "field"]),
        quality.missing(resolve.alias_conflicts(entities.filter(F.col("aka_fts").isNotNull()), ["type"], "name_key", "aka_fts"), "alias conflict", ["type", "alias"]),
        quality.duplicate_keys(entities, ["type", "name_key"], "duplicate entity key"),
        quality.duplicate_keys(every, ["source_id", "place_id", "name", "type"], "duplicate observation"),
        quality.duplicate_keys(entities, ["patent_number"], "duplicate patent number"),
    ])
    summary = listing.table_counts({"sources": sources, "places": places, "entries": entries, "observations": inferred, "entities": entities})
    return Tables(sources, places, inferred, entities, days, conflicts, members, summary, report)
