"""Sources: trees of relaxed-JSON documents to typed rows; sinks for results and reports.

Unreadable documents go to a quarantine frame instead of ending the job.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import split_source_path
from ..lineage import number_rows, sent_pairs, setting, shared_folder, written

PLACE = "struct<short_name:string,name:string,latitude:double,longitude:double>"
ENTRY = (
    "struct<name:string,names:array<string>,type:string,category:string,category_description:string,locations:array<string>,"
    "description:string,harvest_time:string,harvest_time_relative:string,harvest_time_unparsed:string,"
    "disease_resistance:map<string,string>,chill:string,s_allele:string,AKA:array<string>,patent:string,released:string>"
)
PUBLICATION = (
    "title string, author string, description string, url string, published string, reviewed string, accessed string, needs_help boolean, type string, "
    "harvest_time_devalue_factor double, ignore_unless_in_others boolean, ignore_for_nearby_searches boolean, thumbnail string, "
    f"locations array<{PLACE}>, categories array<struct<name:string,description:string>>, plants array<{ENTRY}>, _corrupt string"
)
ENTITY = "struct<name:string,type:string,description:string,AKA:array<string>,patent:string,released:string,s_allele:string>"
TYPES = "array<struct<group_name:string,types:array<struct<name:string,name_alphabetical:string,latin_name:string>>>>"
FACTS = "array<struct<contributor:string,fact:string,reference:string>>"

_RELAXED = {"allowComments": "true", "allowUnquotedFieldNames": "true", "allowSingleQuotes": "true", "mode": "PERMISSIVE"}


def normalize_json5(text: Column) -> Column:
    """Relaxed JSON that Spark's reader takes: no line continuations, block or whole-line comments, trailing commas.

    Comments after a value on its line are left to the reader: ``//`` may stand in an address.
    """
    for pattern, by in ((r"\\\r?\n", ""), (r"/\*[\s\S]*?\*/", ""), (r"(?m)^[ \t]*//.*$", ""), (r",\s*+([\]}])", "$1")):
        text = F.regexp_replace(text, pattern, by)
    return text


def read_texts(spark: SparkSession, folder: str, pattern: str = "*.json5") -> DataFrame:
    """(file, text): each file below the folder whole.

    Folders are listed, and files read, by some tasks a core and not by one task for each folder or few files.
    """
    least = 4 * spark.sparkContext.defaultParallelism
    with setting(spark, "spark.sql.sources.parallelPartitionDiscovery.parallelism", str(least)):
        rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=True)
    # paths come percent-encoded; a plus sign is no space
    file = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    rows = rows.select(file.alias("file"), F.col("value"))
    # a partition counts a small file as 4 MB, and so has 32 of them at most
    rows = rows.coalesce(max(least, rows.rdd.getNumPartitions() // 32))
    return rows.select("file", normalize_json5(F.col("value")).alias("text"))


def read_documents(spark: SparkSession, folder: str, schema: str = PUBLICATION, pattern: str = "*.json5") -> tuple[DataFrame, DataFrame]:
    """(documents, quarantine), one document a file. Documents have ``path``, ``filename`` and the fields; ids follow the sorted file names.

    Each file is read and parsed once; the documents are written, and all that follows reads the columns it needs. Numbering
    sorts the files' names only, of which there is one a document.
    """
    texts = read_texts(spark, folder, pattern)
    parsed = texts.select("file", F.from_json("text", schema, {**_RELAXED, "columnNameOfCorruptRecord": "_corrupt"}).alias("d"))
    corrupt = F.col("d").isNull() | F.col("d._corrupt").isNotNull()
    parsed = parsed.select("*", corrupt.alias("__bad"), F.monotonically_increasing_id().alias("__n"))
    parsed = written(parsed, f"{shared_folder(spark)}/parsed-{uuid.uuid4().hex}", codec="zstd")
    good = parsed.filter(~F.col("__bad"))
    ids = sent_pairs(number_rows(good.select("file", "__n"), ["file"], "source_id").select("__n", "source_id"))
    documents = good.join(ids, "__n").select("source_id", split_source_path(F.col("file")).alias("p"), "d.*").select("source_id", "p.path", "p.filename", "*").drop("p", "_corrupt")
    return documents, parsed.filter("__bad").select("file", F.col("d._corrupt").alias("text"))


def explode_places(documents: DataFrame) -> DataFrame:
    """One row a place of a document, numbered from 1, with the fields of its publication."""
    rows = documents.select("source_id", "path", "filename", "title", "ignore_for_nearby_searches", F.posexplode("locations").alias("position", "l"))
    return rows.select("source_id", "path", "filename", "title", F.coalesce("ignore_for_nearby_searches", F.lit(False)).alias("ignore_for_nearby_searches"), (F.col("position") + 1).alias("number"), "position", "l.*")


def explode_entries(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, wrong): an entry with ``names`` is one row a name; ``wrong`` have both or neither of name and names."""
    rows = documents.select("source_id", F.size("locations").alias("n_places"), F.get("locations", F.lit(0))["name"].alias("only_place"), "categories", F.posexplode("plants").alias("entry", "e"))
    rows = rows.select("source_id", "entry", F.when(F.col("n_places") == 1, F.col("only_place")).alias("only_place"), "categories", "e.*")
    wrong = F.col("name").isNull() == F.col("names").isNull()
    named = rows.filter(~wrong).withColumn("name", F.explode(F.coalesce("names", F.array("name")))).drop("names")
    return named, rows.filter(wrong)


def explode_entry_places(entries: DataFrame, locations: str = "locations", time: str = "harvest_time") -> DataFrame:
    """One row a place of an entry: ``place`` and ``time``.

    An element is a place, which shares the entry's time, or an object of places with their own times; ``NA``
    drops a place. An entry without elements has one row without a place.
    """
    rows = entries.withColumn("__l", F.explode_outer(locations))
    nested = F.when(F.col("__l").startswith("{"), F.from_json("__l", "map<string,string>"))
    # named once, so that an object is parsed once
    pairs = F.coalesce(F.map_entries(nested), F.array(F.struct(F.col("__l").alias("key"), F.col(time).alias("value"))))
    rows = rows.withColumn("__e", F.explode(pairs)).filter(F.col("__e.value").isNull() | (F.col("__e.value") != "NA"))
    return rows.withColumn("place", F.col("__e.key")).withColumn("time", F.col("__e.value")).drop("__l", "__e", locations)


def read_gazetteer(spark: SparkSession, path: str, least_rows: int | None = None) -> DataFrame:
    """(zip, lat, lon) from a table separated by tabs, by its columns 1, 6 and 7; at least ``least_rows``."""
    raw = spark.read.csv(path, sep="\t", header=True)
    names = raw.columns
    out = raw.select(F.trim(F.col(f"`{names[0]}`")).try_cast("int").alias("zip"), *[F.trim(F.col(f"`{names[k]}`")).try_cast("double").alias(n) for k, n in ((5, "lat"), (6, "lon"))])
    if least_rows is not None and (n := out.count()) < least_rows:
        raise ValueError(f"{n} rows in the gazetteer, {least_rows} expected")
    return out


def _read_arrays(spark: SparkSession, folder: str, schema: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """((file, e), quarantine): the elements of each file's array; files that are no such array are kept apart."""
    texts = read_texts(spark, folder, pattern).withColumn("__a", F.from_json("text", schema, _RELAXED))
    return texts.select("file", F.explode("__a").alias("e")), texts.filter(F.col("__a").isNull()).select("file", "text")


def read_entities(spark: SparkSession, folder: str, pattern: str = "*.json5", kind: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(curated entities, quarantine): arrays by type, the type being the file's name (or ``kind``, of the column
    ``file``) but in ``Oddball`` files, which name it."""
    rows, bad = _read_arrays(spark, folder, f"array<{ENTITY}>", pattern)
    rows = rows.withColumn("file_type", split_source_path(F.col("file"))["filename"] if kind is None else kind)
    return rows.select(F.when(F.col("file_type").startswith("Oddball"), F.col("e.type")).otherwise(F.col("file_type")).alias("type"), *[F.col(f"e.{c}").alias(c) for c in ("name", "description", "AKA", "patent", "released", "s_allele")]), bad


def read_types(spark: SparkSession, path: str, pattern: str = "*.json5") -> tuple[DataFrame, DataFrame]:
    """((group_name, name, name_alphabetical, latin_name), quarantine)"""
    rows, bad = _read_arrays(spark, path, TYPES, pattern)
    return rows.select("e.group_name", F.explode("e.types").alias("t")).select("group_name", "t.*"), bad


def read_facts(spark: SparkSession, path: str, pattern: str = "*.json5") -> tuple[DataFrame, DataFrame]:
    """((contributor, fact, reference), quarantine)"""
    rows, bad = _read_arrays(spark, path, FACTS, pattern)
    return rows.select("e.*"), bad


def write_json_result(df: DataFrame, path: str, by: str = "day") -> None:
    """A small table in order, as one JSON file."""
    df.orderBy(by).coalesce(1).write.mode("overwrite").json(path)


def needs_help_lines(sources: DataFrame, base_url: str, flag: str = "needs_help") -> DataFrame:
    """One markdown line a flagged source, sorted."""
    place = F.concat("path", "filename", F.lit(".json5"))
    link = F.array_join(F.transform(F.split(place, "/"), lambda s: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))), "/")
    line = F.concat(F.lit("* ["), F.concat("path", "filename"), F.lit(f"]({base_url}"), link, F.lit(")"))
    return sources.filter(F.coalesce(F.col(flag), F.lit(False))).select(line.alias("value")).orderBy("value")


def write_needs_help(sources: DataFrame, path: str, base_url: str, header: str = "# Sources that need help") -> None:
    lines = needs_help_lines(sources, base_url)
    first = sources.sparkSession.createDataFrame([(0, header)], "o int, value string")
    first.unionByName(lines.select(F.lit(1).alias("o"), "value")).orderBy("o", "value").select("value").coalesce(1).write.mode("overwrite").text(path)
