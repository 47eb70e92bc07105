"""Days between the anchors themselves, from the places that hold several of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import materialized, number_rows
from .graph import components


def place_anchor_means(observations: DataFrame, anchors: DataFrame, place: str = "place", kind: str = "type", name: str = "name", start: str = "start", offset: str = "offset") -> DataFrame:
    """(place, anchor_type, anchor_name, day): the mean of start - offset of each anchor that is itself at a place."""
    distinct = anchors.select("anchor_type", "anchor_name").distinct()
    rows = observations.filter(F.col(place).isNotNull() & F.col(start).isNotNull() & F.col(offset).isNotNull())
    rows = rows.drop("anchor_type", "anchor_name").join(distinct, (F.col(kind) == F.col("anchor_type")) & (F.col(name) == F.col("anchor_name")))
    return rows.groupBy(F.col(place).alias("place"), "anchor_type", "anchor_name").agg(F.avg(F.col(start) - F.col(offset)).alias("day"))


def anchor_pairs(means: DataFrame) -> DataFrame:
    """(type_1, name_1, type_2, name_2, n_places, mean_difference) of anchors that share places, first < second.

    Pairs are made among the anchors of a place, of which there are few.
    """
    one = means.select("place", F.struct("anchor_type", "anchor_name").alias("a"), F.col("day").alias("day_1"))
    two = means.select("place", F.struct("anchor_type", "anchor_name").alias("b"), F.col("day").alias("day_2"))
    pairs = one.join(two, "place").filter(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count("*").alias("n_places"), F.avg(F.col("day_2") - F.col("day_1")).alias("mean_difference"))
    return pairs.select(F.col("a.anchor_type").alias("type_1"), F.col("a.anchor_name").alias("name_1"), F.col("b.anchor_type").alias("type_2"), F.col("b.anchor_name").alias("name_2"), "n_places", "mean_difference")


def shared_places(means: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((a, anchor_type, anchor_name), (place, a, day, k)): anchors by number, in order, and their days at the places
    that hold k of them, two at least."""
    several = means.groupBy("place").agg(F.count("*").alias("k")).filter("k > 1")
    means = means.join(several, "place")
    nodes = materialized(number_rows(means.select("anchor_type", "anchor_name").distinct(), ["anchor_type", "anchor_name"], "a"))
    return nodes, means.join(nodes, ["anchor_type", "anchor_name"]).select("place", "a", "day", "k")


def solve_days(rows: DataFrame, tolerance: float = 1e-12, max_steps: int = 1000) -> DataFrame:
    """(a, x): the days that least-squares makes of (place, a, day, k), by conjugate gradients.

    Every two anchors of a place say that their days differ as they do there. The sum of all these squares is, for each
    place, k times the squares of what the anchors' days differ by from the place's mean; so no pair is ever
    formed. The matrix's product with x is K(a) x(a) less the sum of x over the places of a: one sum by place and one by
    anchor a step, both combined before they are shuffled. All components are solved at once; of each, days are
    fixed but for their origin. The steps end at a residual of ``tolerance`` of the right side's length; if it isn't
    reached, an error says how far they came.
    """
    rows = materialized(rows)
    totals = rows.groupBy("place").agg(F.sum("day").alias("all"))
    right = rows.join(totals, "place").groupBy("a").agg(F.sum("k").cast("double").alias("weight"), F.sum(F.col("k") - 1).cast("double").alias("own"), F.sum(F.col("k") * F.col("day") - F.col("all")).alias("r"))
    state = materialized(right.select("a", "weight", "own", F.lit(0.0).alias("x"), "r", (F.col("r") / F.col("own")).alias("p")))
    first = state.agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("r") * F.col("p")).alias("rz")).first()
    goal, rr, rz = tolerance**2 * (first["rr"] or 0.0), first["rr"] or 0.0, first["rz"]
    for _ in range(max_steps):
        if rr <= goal:
            return state.select("a", "x")
        by_place = rows.join(state.select("a", "p"), "a").groupBy("place").agg(F.sum("p").alias("all"))
        by_anchor = rows.join(by_place, "place").groupBy("a").agg(F.sum("all").alias("others"))
        # the new direction's product with the matrix; its length along the direction decides how far to go
        moved = materialized(state.join(by_anchor, "a").withColumn("q", F.col("weight") * F.col("p") - F.col("others")).drop("others"))
        far = rz / moved.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        moved = moved.select("a", "weight", "own", "p", (F.col("x") + far * F.col("p")).alias("x"), (F.col("r") - far * F.col("q")).alias("r"))
        sums = moved.agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("r") * F.col("r") / F.col("own")).alias("rz")).first()
        state = moved.select("a", "weight", "own", "x", "r", (F.col("r") / F.col("own") + (sums["rz"] / rz) * F.col("p")).alias("p"))
        rr, rz = sums["rr"], sums["rz"]
    raise RuntimeError(f"residual {rr**0.5:g} after {max_steps} steps; {goal**0.5:g} was asked for")


def align_anchors(observations: DataFrame, anchors: DataFrame, tolerance: float = 1e-12, max_steps: int = 1000, **columns) -> DataFrame:
    """(type, name, day, component): each anchor's day after the earliest one of its component, in whole days, by the
    differences seen at shared places.

    Anchors that places connect are a component, named by the number of its first anchor in order of type and name;
    days of two components can't be compared. The days are the least-squares solution over all pairs of anchors at a
    place, each place counting once a pair. Anchors that share no place with another one have none. There may be any
    number of anchors: nothing of them is gathered.
    """
    nodes, rows = shared_places(place_anchor_means(observations, anchors, **columns))
    rows = materialized(rows)
    first = rows.groupBy("place").agg(F.min("a").alias("b"))
    roots = components(rows.join(first, "place").select("a", "b").distinct())
    days = solve_days(rows, tolerance, max_steps).join(roots.select(F.col("node").alias("a"), F.col("root").alias("component")), "a")
    days = materialized(days)
    least = days.groupBy("component").agg(F.min("x").alias("least"))
    # a day that is whole but for rounding is whole
    day = F.floor(F.col("x") - F.col("least") + 1e-6).cast("int")
    return days.join(least, "component").join(nodes, "a").select(F.col("anchor_type").alias("type"), F.col("anchor_name").alias("name"), day.alias("day"), "component")


def largest_component(days: DataFrame) -> DataFrame:
    """(type, name, day) of the component with most anchors; of several, the one that is named first."""
    sizes = days.groupBy("component").agg(F.count("*").alias("n"))
    best = sizes.orderBy(F.desc("n"), "component").limit(1)
    return days.join(F.broadcast(best.select("component")), "component", "left_semi").select("type", "name", "day")
