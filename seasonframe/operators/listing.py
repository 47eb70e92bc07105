"""Listings: folders, recent and random rows, types, what a viewer may see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def under_path(df: DataFrame, prefix: str, path: str = "path") -> DataFrame:
    """Rows at or below a folder; signs of the prefix stand for themselves."""
    return df.filter(F.col(path).startswith(prefix))


def directory_listing(df: DataFrame, folder: str, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(documents, folders): rows exactly at a folder (``""`` or ending in ``/``), and its direct sub-folders."""
    rest = F.substr(F.col(path), F.lit(len(folder) + 1))
    below = under_path(df, folder, path).filter((F.size(F.split(rest, "/")) == 2) & rest.endswith("/"))
    return df.filter(F.col(path) == folder), below.select(F.col(path).alias("folder")).distinct().orderBy("folder")


def directory_tree(df: DataFrame, path: str = "path") -> DataFrame:
    """(folder, parent, depth, n_here, n_below, n_folders) of every folder that a row is in or below, ``""`` the top.

    Equal paths are counted before they are spread over the folders above them; a folder's page is then the rows of
    which it is the parent. Paths end in ``/``; null ones are in no folder.
    """
    here = df.filter(F.col(path).isNotNull()).groupBy(F.col(path).alias("at")).agg(F.count("*").alias("n"))
    steps = F.split("at", "/")
    depth = F.size(steps) - 1
    name = lambda k: F.when(k <= 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(steps, F.lit(1), F.greatest(k, F.lit(0))), "/"), F.lit("/")))
    above = F.transform(F.sequence(F.lit(0), depth), lambda k: F.struct(name(k).alias("folder"), F.when(k > 0, name(k - 1)).alias("parent"), k.alias("depth")))
    spread = here.select("at", "n", F.explode(above).alias("f")).select("at", "n", "f.*")
    folders = spread.groupBy("folder", "parent", "depth").agg(F.sum(F.when(F.col("at") == F.col("folder"), F.col("n")).otherwise(0)).alias("n_here"), F.sum("n").alias("n_below"))
    inside = folders.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("__of")).agg(F.count("*").alias("n_folders"))
    joined = folders.join(inside, F.col("folder") == F.col("__of"), "left")
    return joined.select("folder", "parent", "depth", "n_here", "n_below", F.coalesce("n_folders", F.lit(0)).alias("n_folders"))


def recent(df: DataFrame, by: str, n: int = 10, tie: list[str] = ()) -> DataFrame:
    """The last rows by a time."""
    return df.orderBy(F.col(by).desc_nulls_last(), *tie).limit(n)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n)"""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sample_one(df: DataFrame, seed: int | None = None, row_id: str | None = None) -> DataFrame:
    """One random row; with a seed and an id the same one whatever the partitions."""
    if seed is not None and row_id is not None:
        return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string")).cast("binary")), row_id).limit(1)
    return df.orderBy(F.rand(seed)).limit(1)


def type_list(groups: DataFrame, types: str = "types") -> DataFrame:
    """Types of all groups, sorted by their alphabetical name if they have one."""
    flat = groups.select(*[c for c in groups.columns if c != types], F.explode(types).alias("t"))
    fields = flat.schema["t"].dataType.names
    by = F.coalesce("t.name_alphabetical", "t.name") if "name_alphabetical" in fields else F.col("t.name")
    return flat.orderBy(by, "t.name").select(*[c for c in flat.columns if c != "t"], "t.*")


def visible_to(df: DataFrame, viewer, owner: str = "owner", public: str = "public") -> DataFrame:
    """Own rows, and others' public ones."""
    shown = F.coalesce(F.col(public), F.lit(False))
    return df.filter(shown if viewer is None else shown | F.coalesce(F.col(owner) == F.lit(viewer), F.lit(False)))


def at_location(df: DataFrame, number: int = 1, location: str = "number") -> DataFrame:
    return df.filter(F.col(location) == number)


def last_modified(changes: DataFrame, path: str = "path", time: str = "commit_time", parents: str | None = "n_parents") -> DataFrame:
    """(path, last_modified): the last change of each path, whatever its case and slashes; merges don't count."""
    rows = changes if parents is None else changes.filter(F.col(parents) <= 1)
    return rows.groupBy(F.lower(F.replace(F.col(path), F.lit("\\"), F.lit("/"))).alias("path")).agg(F.max(time).alias("last_modified"))


def stem(path: Column, extensions: tuple[str, ...] = (".jpg.dvc", ".jpg")) -> Column:
    out = path
    for e in extensions:
        out = F.when(out.endswith(e), F.substr(out, F.lit(1), F.length(out) - len(e))).otherwise(out)
    return out


def orphan_artifacts(artifacts: DataFrame, sources: DataFrame, artifact: str = "path", source: str = "path") -> DataFrame:
    """Derived files whose source is gone."""
    known = sources.select(F.col(source).alias("__stem"))
    return artifacts.withColumn("__stem", stem(F.col(artifact))).join(known, "__stem", "left_anti").drop("__stem")


def artifact_candidates(sources: DataFrame, artifacts: DataFrame, redo: bool = False, key: str = "path", artifact: str = "path", flag: str = "thumbnail", url: str = "url") -> DataFrame:
    """Sources flagged ``website`` without a file yet (all of them with ``redo``), with the ``address`` to take it from."""
    asked = sources.filter(F.col(flag) == "website").withColumn("address", F.get(F.split(F.trim(F.col(url)), r"\s+"), F.lit(0)))
    if redo:
        return asked
    return asked.join(artifacts.select(stem(F.col(artifact)).alias(key)), key, "left_anti")
