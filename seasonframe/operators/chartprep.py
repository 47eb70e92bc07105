"""Rows for charts, for all groups (publications and places, say) at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dims import month_grid
from ..lineage import number_within

WINDOW_DAYS = 10
CHUNK = 40
SINGLE = 30


def chartable_absolute(start: Column, end: Column) -> Column:
    """Start and end are there; 0 counts as missing."""
    return F.coalesce((start != 0) & (end != 0), F.lit(False))


def chartable_relative(offset: Column, anchor_name: Column, anchor_type: Column, round_: Column | None = None, drop_zero: bool = False) -> Column:
    """Offset and anchor are there; with ``round_`` only what was read directly; ``drop_zero`` leaves out offset 0."""
    there = offset.isNotNull() & ~F.isnan(offset.cast("double")) & anchor_name.isNotNull() & anchor_type.isNotNull()
    if drop_zero:
        there = there & (offset != 0)
    return F.coalesce(there if round_ is None else there & (round_ == 0), F.lit(False))


def chart_mode(df: DataFrame, group: list[str], start: str = "start", end: str = "end", offset: str = "offset", anchor_name: str = "anchor_name", anchor_type: str = "anchor_type", round_: str = "round") -> DataFrame:
    """(group, n_absolute, n_relative, mode): absolute where it has at least as many rows."""
    absolute = F.count_if(chartable_absolute(F.col(start), F.col(end)))
    relative = F.count_if(chartable_relative(F.col(offset), F.col(anchor_name), F.col(anchor_type), F.col(round_)))
    counted = df.groupBy(*group).agg(absolute.alias("n_absolute"), relative.alias("n_relative"))
    return counted.withColumn("mode", F.when(F.col("n_absolute") >= F.col("n_relative"), "absolute").otherwise("relative"))


def sequence_chunks(df: DataFrame, group: list[str], order: list[Column], size: int = CHUNK, output: str = "chunk") -> DataFrame:
    """Runs of ``size`` rows of each group in order, numbered from 0."""
    return number_within(df, group, order, "__n").withColumn(output, F.floor((F.col("__n") - 1) / size).cast("int")).drop("__n")


def extents(df: DataFrame, group: list[str] = (), x: str = "x", width: str = "width", least: int = 60) -> DataFrame:
    """(group, min_x, max_x), widened evenly to ``least``."""
    found = df.groupBy(*group).agg(F.min(x).alias("lo"), F.max(F.col(x) + F.col(width)).alias("hi"))
    pad = F.greatest(F.lit(0.0), (F.lit(least) - (F.col("hi") - F.col("lo"))) / 2)
    return found.select(*group, (F.col("lo") - pad).alias("min_x"), (F.col("hi") + pad).alias("max_x"))


def sequence_type(df: DataFrame, group: list[str], kind: str = "type") -> DataFrame:
    """(group, sequence_type): the only type of a group, or ``Mixed``."""
    return df.groupBy(*group).agg(F.when(F.min(kind) == F.max(kind), F.min(kind)).otherwise("Mixed").alias("sequence_type"))


def chart_absolute(df: DataFrame, group: list[str], kind: str = "type", name: str = "name", start: str = "start", end: str = "end", row_id: str = "id", keep_uncharted: bool = False) -> DataFrame:
    """Rows with ``x``, ``width``, ``sequence`` (one for up to 30 rows, else one a type) and ``chunk``.

    A missing end is ten days after the start; longer windows come after shorter ones with the same start. With
    ``keep_uncharted`` the other rows follow too, ``uncharted`` saying why; it is null in charted rows.
    """
    ends = df.withColumn("__e", F.coalesce(F.col(end), F.col(start) + WINDOW_DAYS))
    able = chartable_absolute(F.col(start), F.col("__e"))
    rows = ends.filter(able)
    totals = rows.groupBy(*group).agg(F.count("*").alias("__total"))
    rows = rows.join(totals, group) if group else rows.crossJoin(F.broadcast(totals))  # one row
    rows = rows.withColumn("x", F.col(start)).withColumn("width", F.col("__e") - F.col(start)).withColumn("sequence", F.when(F.col("__total") <= SINGLE, "single").otherwise(F.col(kind)))
    charted = sequence_chunks(rows, [*group, "sequence"], [F.col(start), F.col("__e"), F.col(name), F.col(row_id)]).drop("__e", "__total")
    return _with_uncharted(charted, [(ends.filter(~able).drop("__e"), "no time")]) if keep_uncharted else charted


def _with_uncharted(charted: DataFrame, others: list[tuple[DataFrame, str]]) -> DataFrame:
    out = charted.withColumn("uncharted", F.lit(None).cast("string"))
    for rows, why in others:
        out = out.unionByName(rows.withColumn("uncharted", F.lit(why)), allowMissingColumns=True)
    return out


def uncharted_counts(df: DataFrame, group: list[str]) -> DataFrame:
    """(group, n_charted, n_without_time, n_unknown_anchor) of rows with ``uncharted``."""
    why = F.col("uncharted")
    return df.groupBy(*group).agg(F.count_if(why.isNull()).alias("n_charted"), F.count_if(F.coalesce(why == "no time", F.lit(False))).alias("n_without_time"), F.count_if(F.coalesce(why == "unknown anchor", F.lit(False))).alias("n_unknown_anchor"))


def relative_counts(df: DataFrame, offsets: DataFrame, group: list[str], offset: str = "offset", anchor_type: str = "anchor_type", anchor_name: str = "anchor_name") -> DataFrame:
    """What ``uncharted_counts`` says of ``chart_relative``: from one count an anchor of a group, without charting a row."""
    able = chartable_relative(F.col(offset), F.col(anchor_name), F.col(anchor_type))
    counts = df.groupBy(*group, able.alias("__able"), F.when(able, F.col(anchor_type)).alias(anchor_type), F.when(able, F.col(anchor_name)).alias(anchor_name)).agg(F.count("*").alias("__n"))
    days = offsets.select(F.col("type").alias(anchor_type), F.col("name").alias(anchor_name), F.col("day").alias("__day"))
    # rows of a null group meet no anchor, and so are not charted; those without time stay
    there = reduce(lambda a, b: a & b, [F.col(g).isNotNull() for g in group], F.lit(True))
    counts = counts.filter(there | ~F.col("__able")).join(days, [anchor_type, anchor_name], "left")
    n, known = F.col("__n"), F.col("__day").isNotNull()
    total = lambda which: F.coalesce(F.sum(F.when(F.col("__able") & which, n)), F.lit(0))
    found = counts.groupBy(*group).agg(F.count_if("__able").alias("__anchors"), total(known).alias("__known"), total(~known).alias("__unknown"), F.coalesce(F.sum(F.when(~F.col("__able"), n)), F.lit(0)).alias("n_without_time"))
    single = F.col("__anchors") == 1
    charted = F.when(single, F.col("__known") + F.col("__unknown")).otherwise(F.col("__known"))
    return found.select(*group, charted.alias("n_charted"), "n_without_time", F.when(single, F.lit(0).cast("long")).otherwise(F.col("__unknown")).alias("n_unknown_anchor"))


def chart_relative(df: DataFrame, offsets: DataFrame, group: list[str], kind: str = "type", name: str = "name", offset: str = "offset", anchor_type: str = "anchor_type", anchor_name: str = "anchor_name", row_id: str = "id", keep_uncharted: bool = False) -> DataFrame:
    """Rows with ``x`` (days after the group's earliest anchor), ``width``, ``sequence``, ``chunk`` and the marks
    ``is_earliest`` and ``is_most_numerous`` of their anchor.

    ``offsets``: (type, name, day) of the anchors. A group with one anchor needs none; in one with several, rows
    of anchors that have no day are left out. With ``keep_uncharted`` these, and rows without an offset or an
    anchor, follow too, ``uncharted`` saying why; it is null in charted rows.
    """
    able = chartable_relative(F.col(offset), F.col(anchor_name), F.col(anchor_type))
    rows = df.filter(able)
    days = offsets.select(F.col("type").alias(anchor_type), F.col("name").alias(anchor_name), F.col("day").alias("__day"))
    anchors = rows.groupBy(*group, anchor_type, anchor_name).agg(F.count("*").alias("__n")).join(days, [anchor_type, anchor_name], "left")
    known = F.struct(F.col("__day").alias("d"), F.col(anchor_type).alias("t"), F.col(anchor_name).alias("a"))
    summary = anchors.groupBy(*group).agg(
        F.count("*").alias("__anchors"),
        F.min(F.when(F.col("__day").isNotNull(), known)).alias("__first"),
        F.min(F.struct((-F.col("__n")).alias("m"), F.col(anchor_type).alias("t"), F.col(anchor_name).alias("a"))).alias("__most"),
    )
    anchors = anchors.join(summary, group)
    single = F.col("__anchors") == 1
    day = F.when(single, 0).otherwise(F.col("__day") - F.col("__first.d"))
    same = lambda s: (F.col(anchor_type) == F.col(f"{s}.t")) & (F.col(anchor_name) == F.col(f"{s}.a"))
    unknown = rows.join(anchors.filter(~single & F.col("__day").isNull()).select(*group, anchor_type, anchor_name), [*group, anchor_type, anchor_name], "left_semi")
    anchors = anchors.filter(single | F.col("__day").isNotNull()).select(*group, anchor_type, anchor_name, day.alias("__from"), (single | F.coalesce(same("__first"), F.lit(False))).alias("is_earliest"), same("__most").alias("is_most_numerous"))
    rows = rows.join(anchors, [*group, anchor_type, anchor_name])
    totals = rows.groupBy(*group).agg(F.count("*").alias("__total"))
    rows = rows.join(totals, group).withColumn("x", F.col(offset) + F.col("__from")).withColumn("width", F.lit(WINDOW_DAYS)).withColumn("sequence", F.when(F.col("__total") <= SINGLE, "single").otherwise(F.col(kind)))
    charted = sequence_chunks(rows, [*group, "sequence"], [F.col("x"), F.col(name), F.col(row_id)]).drop("__from", "__total")
    return _with_uncharted(charted, [(df.filter(~able), "no time"), (unknown, "unknown anchor")]) if keep_uncharted else charted


def anchor_offset_join(df: DataFrame, offsets: DataFrame, anchor_type: str = "anchor_type", anchor_name: str = "anchor_name") -> DataFrame:
    """Rows whose anchor has a day, with it."""
    return df.join(offsets.select(F.col("type").alias(anchor_type), F.col("name").alias(anchor_name), "day"), [anchor_type, anchor_name])


def order_sequences(df: DataFrame, group: list[str], sequence: list[str], kind: str = "type", x: str = "x", name: str = "name") -> DataFrame:
    """One row a sequence of a group, longest first: (length, type, first_x, first_name, place), place from 1."""
    first = F.min(F.struct(F.col(x).alias("x"), F.col(name).alias("n")))
    one = df.groupBy(*group, *sequence).agg(F.count("*").alias("length"), F.min(kind).alias("type"), first.alias("f")).select(*group, *sequence, "length", "type", F.col("f.x").alias("first_x"), F.col("f.n").alias("first_name"))
    order = [-F.col("length"), *map(F.col, ("type", "first_x", "first_name", *sequence))]
    return number_within(one, group, order, "place")


def months_of(extent: DataFrame, min_x: str = "min_x", max_x: str = "max_x") -> DataFrame:
    """The months that each extent touches: one row a month, by a join with the twelve of the grid."""
    grid = F.broadcast(month_grid(extent.sparkSession))
    return extent.join(grid, (grid["start"] < F.col(max_x)) & (grid["end"] > F.col(min_x)))
