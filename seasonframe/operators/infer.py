"""Offsets of observations from an anchor of their type, inferred round by round, and their consensus.

Observations have the columns ``id, place, type, name, start, relative`` (relative text, see
``functions.fields.relative_offset``) and, for the weights, ``source_score, devalue``. Anchors are rows
(type, anchor_type, anchor_name). Null places match nothing.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import relative_offset
from ..functions.timetext import parse_distinct
from ..lineage import discard, materialized, shared_folder, shuffles_released, written

CALC = ["offset", "anchor_type", "anchor_name", "round", "explanation"]
EXPLAINED = 20
#: Narrow rows of a round that are sent to all tasks; beyond, both sides are shuffled.
SENT_ROWS = 200_000
#: Rows that a task of ``relative_to_absolute`` brings together.
TASK_ROWS = 500_000
#: Parts of 1 in which the rounds sum weights.
UNITS = 1_000_000_000


def relative_to_absolute(observations: DataFrame, max_hops: int = 1, place: str = "place", kind: str = "type", name: str = "name", starts: tuple[str, ...] = ("start", "end", "start_2", "end_2"), relative: str = "relative") -> DataFrame:
    """Rows with relative text and no start take the times of the row of the same place and type that the text names.

    Null times stay null. One hop by default; more follow chains. A parsed type prefix is ignored. Of several rows
    of one name at a place the one with the least start counts. The rows are written first; they meet in tasks of
    about ``TASK_ROWS``.
    """
    starts = tuple(s for s in starts if s in observations.columns)
    observations = materialized(observations)
    tasks = max(observations.sparkSession.sparkContext.defaultParallelism, -(-observations.count() // TASK_ROWS))
    out = parse_distinct(observations, relative, relative_offset, "__rel")
    for hop in range(max_hops):
        rows = (out if hop else observations).filter(F.col(place).isNotNull())
        known = rows.select(F.col(place).alias("__p"), F.col(kind).alias("__t"), F.col(name).alias("__n"), F.struct(*[F.col(s).alias(f"__{s}") for s in starts]).alias("__k"))
        known = known.repartition(tasks, "__p", "__t", "__n").groupBy("__p", "__t", "__n").agg(F.min("__k").alias("__k"))
        needs = F.col(starts[0]).isNull() & F.col("__rel").isNotNull()
        out = out.withColumn("__ref", F.when(needs, F.col("__rel.name"))).repartition(tasks, place, kind, "__ref")
        joined = out.join(known, (F.col(place) == F.col("__p")) & (F.col(kind) == F.col("__t")) & (F.col("__ref") == F.col("__n")), "left")
        for s in starts:
            joined = joined.withColumn(s, F.when(F.col("__n").isNotNull(), F.col(f"__k.__{s}") + F.col("__rel.days")).otherwise(F.col(s)))
        out = joined.drop("__p", "__t", "__n", "__k", "__ref")
    return out.drop("__rel")


def anchor_rows(observations: DataFrame, anchors: DataFrame, place: str = "place", kind: str = "type", name: str = "name", start: str = "start", value: Column | None = None, row_id: str = "id") -> DataFrame:
    """(place, anchor_type, anchor_name, anchor_start, anchor_value): the anchors present at each place.

    Of several rows of an anchor at a place the one with the least id counts.
    """
    value = F.lit(0) if value is None else value
    distinct = anchors.select("anchor_type", "anchor_name").distinct()
    rows = observations.filter(F.col(place).isNotNull() & F.col(start).isNotNull()).join(distinct, (F.col(kind) == F.col("anchor_type")) & (F.col(name) == F.col("anchor_name")))
    first = F.min_by(F.struct(F.col(start).alias("s"), value.alias("v")), row_id)
    return rows.groupBy(F.col(place).alias("place"), "anchor_type", "anchor_name").agg(first.alias("f")).select("place", "anchor_type", "anchor_name", F.col("f.s").alias("anchor_start"), F.col("f.v").alias("anchor_value"))


def anchor_join(observations: DataFrame, anchors: DataFrame, place: str = "place", kind: str = "type", name: str = "name", start: str = "start", row_id: str = "id") -> DataFrame:
    """Observations at a place where the anchor of their type is: with the anchor and ``offset`` = start - anchor's."""
    there = anchor_rows(observations, anchors, place, kind, name, start, row_id=row_id)
    dim = anchors.select(F.col("type").alias(kind), "anchor_type", "anchor_name")
    rows = observations.filter(F.col(start).isNotNull()).join(dim, kind)
    joined = rows.join(there.withColumnRenamed("place", place), [place, "anchor_type", "anchor_name"])
    return joined.withColumn("offset", F.col(start) - F.col("anchor_start") + F.col("anchor_value")).drop("anchor_start", "anchor_value")


def best_candidates(observations: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """One row a key: the values of the row that is first by ``order``. Combines before the shuffle; no sort."""
    rows = observations.filter(" and ".join(f"`{k}` is not null" for k in keys))
    return rows.groupBy(*keys).agg(F.min(F.struct(*order, *[F.col(v).alias(f"_{v}") for v in values])).alias("b")).select(*keys, *[F.col(f"b._{v}").alias(v) for v in values])


def consensus_offset(rows: DataFrame, keys: list[str], offset: str = "offset", weight: Column | None = None, output: str = "consensus") -> DataFrame:
    """Weighted mean offset a key, rounded half away from zero; with the number of rows and their weight."""
    weight = F.lit(1.0) if weight is None else weight
    rows = rows.filter(F.col(offset).isNotNull()).withColumn("__w", weight)
    return rows.groupBy(*keys).agg(F.round(F.sum(F.col(offset) * F.col("__w")) / F.sum("__w")).cast("int").alias(output), F.count("*").alias("n_rows"), F.sum("__w").alias("weight"))


def round_weight(score: Column, round_: Column, devalue: Column) -> Column:
    """A source's score, halved for each round and each step of devaluation."""
    return score * F.pow(F.lit(2.0), -(round_ + devalue))


def weight_units(weight: Column) -> Column:
    """A weight in whole billionths, so that sums don't depend on the order of rows: halves of a day are then rounded alike."""
    return F.round(weight * UNITS).try_cast("decimal(20,0)")


def rounded_mean(sum_wx: str, sum_w: str) -> Column:
    """The quotient of two whole sums, rounded half away from zero, without passing through a fraction."""
    return F.expr(f"if({sum_w} > 0, sign({sum_wx}) * ((abs({sum_wx}) + abs({sum_wx}) + {sum_w}) div ({sum_w} + {sum_w})), null)").cast("int")


def infer_offsets(observations: DataFrame, anchors: DataFrame, max_rounds: int = 10, explain: bool = False) -> tuple[DataFrame, DataFrame]:
    """(observations, entities) with their offsets from the anchor of the type. Ids are distinct.

    Round 0 gives anchors 0 and reads offsets off texts that name an anchor. Each later round, for rows still
    without one: (A) difference to the anchor at the place, else to the best row tied to it there; (B) rows of a
    place with the same reference; (C) the entity that a text refers to; (D) the weighted consensus of each entity,
    handed on to its rows. It ends with the first round that changes neither a row nor an entity. Ties go to the
    least id.

    The rounds read narrow rows without an offset, and write what they resolve. A row that is open could not use what
    was known a round before, so it meets what the last round resolved and nothing else; sums an entity go on from
    round to round. The open rows are written again when an eighth of them is resolved. Rows that only a consensus can
    reach (without place or start, and without text) stay out of the rounds as one weight an entity. The wide columns
    are joined at the end. Consensus weighs in whole billionths, whose sums are exact.

    On disk are the narrow rows, in columns, what the rounds resolve, and the shuffle of one job at a time; what is written
    again is removed, and at the end all but the offsets. Observations are read four times: have them written, if they cost
    a shuffle.
    """
    spark = observations.sparkSession
    folder = f"{shared_folder(spark)}/inference-{uuid.uuid4().hex}"
    with shuffles_released(spark):
        out = _inferred(observations, anchors, max_rounds, explain, folder)
    discard(spark, folder)
    return out


def _inferred(observations: DataFrame, anchors: DataFrame, max_rounds: int, explain: bool, folder: str) -> tuple[DataFrame, DataFrame]:
    """``infer_offsets``, with what the rounds write in a folder that the results don't need."""
    keep = lambda df, name: written(df, f"{folder}/{name}", codec="zstd")
    spark, columns = observations.sparkSession, observations.columns
    for c, kind in (("source", "string"), ("source_score", "double"), ("devalue", "double")):
        if c not in columns:
            observations = observations.withColumn(c, F.lit(None if kind == "string" else 1.0 if c == "source_score" else 0.0).cast(kind))
    anchors = keep(anchors.select("type", "anchor_type", "anchor_name"), "anchors")
    n_anchors = anchors.count()
    dim = _sent(anchors.select("type", F.col("anchor_type").alias("own_type"), F.col("anchor_name").alias("own_name")), n_anchors)
    candles = anchors.select(F.col("anchor_type").alias("__at"), F.col("anchor_name").alias("__an")).distinct()
    rows = observations.select("id", "place", "type", "name", "start", F.col("source_score").cast("double").alias("score"), F.coalesce("devalue", F.lit(0.0)).alias("devalue"), "relative")
    # each distinct text is parsed once; rows without one don't wait for it
    texts = rows.filter(F.col("relative").isNotNull()).select("relative").distinct()
    texts = keep(texts.select("relative", relative_offset(F.col("relative")).alias("__rel")), "texts")
    said = rows.filter(F.col("relative").isNotNull()).join(_sent(texts, texts.count()), "relative")
    rows = rows.filter(F.col("relative").isNull()).withColumn("__rel", F.lit(None).cast(texts.schema["__rel"].dataType)).unionByName(said).drop("relative")
    rows = rows.select("*", F.col("__rel.name").alias("rel_name"), F.col("__rel.type").alias("rel_type"), F.col("__rel.days").alias("rel_days")).drop("__rel").join(dim, "type", "left")
    every = candles.select(F.col("__at").alias("type"), F.col("__an").alias("name"), F.lit(True).alias("is_candle"))
    rows = rows.join(_sent(every, n_anchors), ["type", "name"], "left")  # an anchor of some type, though perhaps not of its own
    named = F.coalesce("rel_type", "type")
    rows = rows.join(_sent(candles, n_anchors), (named == F.col("__at")) & (F.col("rel_name") == F.col("__an")), "left")
    is_anchor = (F.col("type") == F.col("own_type")) & (F.col("name") == F.col("own_name"))
    first = F.when(F.col("__an").isNotNull(), _calc(F.col("rel_days"), F.col("__at"), F.col("__an"), 0.0, "parsed directly"))
    first = first.when(is_anchor, _calc(F.lit(0), F.col("type"), F.col("name"), 0.0, "standard candle"))
    timed = F.col("place").isNotNull() & F.col("start").isNotNull() & F.col("own_name").isNotNull()
    rows = keep(rows.withColumn("calc", first).withColumn("active", timed | F.col("rel_days").isNotNull()).drop("__at", "__an"), "rows")
    discard(spark, f"{folder}/texts")

    open_ = F.col("calc").isNull()
    idle = F.sum(F.when(open_ & ~F.col("active"), weight_units(F.col("score") * F.pow(F.lit(2.0), -F.col("devalue")))))
    nothing = [*[F.lit(0).cast("decimal(38,0)").alias(c) for c in ("sum_wx", "sum_w")], *[F.lit(None).cast("int").alias(c) for c in ("entity_offset", "first_offset", "first_round", "last_round")]]
    entities = keep(rows.groupBy("type", "name", "own_type", "own_name").agg(F.coalesce(idle, F.lit(0)).cast("double").alias("idle_w")).select("*", *nothing), "entities-0")
    resolved = [rows.filter(~open_)]
    fresh = pushed = resolved[0]
    left, n_written = rows.filter(open_ & F.col("active")).drop("calc"), 0
    n_left, gone, n_gone = left.count(), [], 0
    n_fresh, found = fresh.count(), 0
    n_resolved = n_fresh

    for r in range(1, max_rounds + 1):
        # A: against the anchor at the place, else against the best row that is tied to it
        own = F.when(F.col("x.prior") == 0, F.lit(True)).otherwise(F.lit(False))
        said = F.when(own, f"round {r}: from the anchor at the place").otherwise(f"round {r}: from a tied row at the place")
        calc = _calc(F.col("start") - F.col("x.start") + F.col("x.offset"), F.col("x.t"), F.col("x.n"), F.when(own, float(r)).otherwise(r + 0.1), said)
        candidates = _sent(_place_candidates(fresh), 2 * n_fresh)
        a = keep(_without(left.filter(timed).join(candidates, ["place", "own_type", "own_name"]).withColumn("calc", calc).drop("x"), gone, n_gone), f"timed-{r}")
        n_a = a.count()
        # B: rows of the place with the same reference
        same = fresh.unionByName(a).filter(F.col("place").isNotNull() & F.col("rel_days").isNotNull())
        same = same.groupBy("place", "rel_name", _text("rel_type").alias("rel_key")).agg(F.min(F.struct("calc.round", "id", "calc.offset", "rel_days", F.col("calc.anchor_type").alias("t"), F.col("calc.anchor_name").alias("n"))).alias("x"))
        calc = _calc(F.col("x.offset") + F.col("rel_days") - F.col("x.rel_days"), F.col("x.t"), F.col("x.n"), float(r), f"relative-to-relative: round {r}")
        texts = left.filter(F.col("rel_days").isNotNull())
        b = texts.filter(F.col("place").isNotNull()).withColumn("rel_key", _text("rel_type")).join(_sent(same, n_fresh + n_a), ["place", "rel_name", "rel_key"]).withColumn("calc", calc).drop("x", "rel_key")
        # C: the entity that the text refers to
        known = entities.filter(F.col("last_round") == r - 1).select(F.col("type").alias("ref_type"), F.col("name").alias("rel_name"), F.struct(F.col("entity_offset").alias("offset"), F.col("own_type").alias("t"), F.col("own_name").alias("n")).alias("x"))
        calc = _calc(F.col("x.offset") + F.col("rel_days"), F.col("x.t"), F.col("x.n"), r + 0.95, f"round {r}: from the entity's consensus")
        c = texts.withColumn("ref_type", named).join(_sent(known, found), ["ref_type", "rel_name"]).withColumn("calc", calc).drop("x", "ref_type")
        # a row that both reach takes the first
        steps = reduce(DataFrame.unionByName, [h.select(F.col("id").alias("key"), F.struct(F.lit(k).alias("step"), *left.columns, "calc").alias("h")) for k, h in enumerate((b, c))])
        referred = steps.groupBy("key").agg(F.min_by("h", "h.step").alias("h")).select(*[F.col(f"h.{c}").alias(c) for c in (*left.columns, "calc")])
        referred = keep(_without(referred, [*gone, a], n_gone + n_a), f"referred-{r}")
        new, n_new = a.unionByName(referred), n_a + referred.count()
        # D: consensus of the rows tied to the type's own anchor, where one of them is new
        members = pushed.select("*", F.lit(r == 1).alias("now")).unionByName(new.select("*", F.lit(True).alias("now"))).filter((F.col("calc.anchor_type") == F.col("own_type")) & (F.col("calc.anchor_name") == F.col("own_name")))
        weight = weight_units(round_weight(F.col("score"), F.col("calc.round"), F.col("devalue")))
        gained = members.groupBy("type", "name").agg(F.sum(F.col("calc.offset") * weight).alias("wx"), F.sum(weight).alias("w"), F.max("now").alias("now"))
        entities = keep(_consensus(entities.join(gained, ["type", "name"], "left"), r), f"entities-{r}")
        discard(spark, f"{folder}/entities-{r - 1}")
        found = entities.filter(F.col("last_round") == r).count()
        handed = entities.filter(F.col("last_round") == r).select("type", "name", F.col("entity_offset").alias("new"))
        calc = _calc(F.col("new"), F.col("own_type"), F.col("own_name"), r + 0.9, f"round {r}: weighted consensus")
        pushed = left.join(_sent(handed, found), ["type", "name"]).withColumn("calc", calc).drop("new")
        pushed = keep(_without(pushed, [*gone, new], n_gone + n_new), f"pushed-{r}") if found else new.limit(0)
        n_fresh = n_new + (pushed.count() if found else 0)
        n_resolved += n_fresh
        resolved += [new, pushed]
        fresh = new.unionByName(pushed)
        if not n_new and not found:
            break
        gone, n_gone = [*gone, new, pushed], n_gone + n_fresh
        if n_gone == n_left:
            break
        if 8 * n_gone > n_left:
            left = keep(_without(left, gone, n_gone), f"left-{r}")
            n_left, gone, n_gone = left.count(), [], 0
            if n_written:
                discard(spark, f"{folder}/left-{n_written}")
            n_written = r
    late = rows.filter(open_ & ~F.col("active")).select("id", "type", "name").join(entities.filter(F.col("first_round").isNotNull()), ["type", "name"])
    said = F.concat(F.lit("round "), F.col("first_round").cast("string"), F.lit(": weighted consensus"))
    late = keep(late.select("id", _calc(F.col("first_offset"), F.col("own_type"), F.col("own_name"), F.col("first_round") + 0.9, said).alias("calc")), "late")
    calcs = materialized(reduce(DataFrame.unionByName, [p.select("id", F.col("calc").alias("__calc")) for p in (*resolved, late)]))
    full = observations.drop(*[c for c in CALC if c in columns]).join(_sent(calcs, n_resolved + late.count()), "id", "left").select("*", "__calc.*").drop("__calc")
    has, why = F.col("entity_offset").isNotNull(), F.concat(F.lit("round "), F.col("last_round").cast("string"), F.lit(": weighted consensus"))
    found = materialized(entities).select("type", "name", "entity_offset", F.when(has, F.col("own_type")).alias("anchor_type"), F.when(has, F.col("own_name")).alias("anchor_name"), F.when(has, why).alias("entity_explanation"), F.col("last_round").alias("entity_round"))
    if explain:
        found = found.drop("entity_explanation").join(explain_consensus(consensus_members(full, found)), ["type", "name"], "left")
    return full.select(*[c for c in columns if c not in CALC], *CALC), found.select("type", "name", "entity_offset", "anchor_type", "anchor_name", "entity_explanation", "entity_round")


def _sent(rows: DataFrame, count: int) -> DataFrame:
    """To be sent to all tasks, if the count is small."""
    return F.broadcast(rows) if count <= SENT_ROWS else rows


def _without(rows: DataFrame, others: list[DataFrame], count: int) -> DataFrame:
    """The rows whose ids none of the others has, which are ``count`` together."""
    if not others:
        return rows
    return rows.join(_sent(reduce(DataFrame.unionByName, [o.select("id") for o in others]), count), "id", "left_anti")


def _text(c: str) -> Column:
    """A key that keeps null and the empty text apart."""
    return F.coalesce(F.concat(F.lit(":"), F.col(c)), F.lit(""))


def _place_candidates(rows: DataFrame) -> DataFrame:
    """(place, own_type, own_name, x): for each anchor at a place the anchor's own row, else the first row tied to it."""
    def entry(prior: int, round_: Column, kind: Column, name: Column) -> Column:
        values = {"prior": F.lit(prior), "round": round_, "id": F.col("id"), "start": F.col("start"), "offset": F.col("calc.offset"), "t": F.col("calc.anchor_type"), "n": F.col("calc.anchor_name")}
        return F.struct(kind.alias("own_type"), name.alias("own_name"), F.struct(*[v.alias(c) for c, v in values.items()]).alias("x"))

    there = F.when(F.col("is_candle"), entry(0, F.lit(0.0), F.col("type"), F.col("name")))
    tied = entry(1, F.col("calc.round"), F.col("calc.anchor_type"), F.col("calc.anchor_name"))
    both = rows.filter(F.col("place").isNotNull() & F.col("start").isNotNull()).select("place", F.explode(F.array_compact(F.array(there, tied))).alias("e"))
    return both.select("place", "e.*").groupBy("place", "own_type", "own_name").agg(F.min("x").alias("x"))


def _consensus(entities: DataFrame, r: int) -> DataFrame:
    """Add what the round gained to the sums; where it has a new row, the mean is the entity's offset."""
    wx, w = ((F.col(a) + F.coalesce(b, F.lit(0))).cast("decimal(38,0)") for a, b in (("sum_wx", "wx"), ("sum_w", "w")))
    out = entities.withColumn("sum_wx", wx).withColumn("sum_w", w).withColumn("now", F.coalesce("now", F.lit(False)) & (F.col("sum_w") > 0))
    out = out.withColumn("entity_offset", F.when(F.col("now"), rounded_mean("sum_wx", "sum_w")).otherwise(F.col("entity_offset")))
    out = out.withColumn("last_round", F.when(F.col("now"), F.lit(r)).otherwise(F.col("last_round")))
    # rows that wait for the first consensus alone take it, and weigh in from the next round on
    late = F.when(F.col("now") & F.col("first_round").isNull(), F.round(F.col("idle_w") * 2.0 ** -(r + 0.9)).try_cast("decimal(20,0)")).otherwise(F.lit(0))
    out = out.withColumn("sum_wx", (F.col("sum_wx") + F.coalesce(F.col("entity_offset") * late, F.lit(0))).cast("decimal(38,0)")).withColumn("sum_w", (F.col("sum_w") + F.coalesce(late, F.lit(0))).cast("decimal(38,0)"))
    is_first = F.col("now") & F.col("first_round").isNull()
    out = out.withColumn("first_offset", F.when(is_first, F.col("entity_offset")).otherwise(F.col("first_offset"))).withColumn("first_round", F.when(is_first, F.lit(r)).otherwise(F.col("first_round")))
    return out.drop("wx", "w", "now")


def consensus_members(observations: DataFrame, entities: DataFrame) -> DataFrame:
    """(type, name, entity_round, id, source, offset, source_score, weight): the rows behind each entity's consensus.

    Takes the results of ``infer_offsets``, the observations with ``source, source_score, devalue``.
    """
    known = entities.filter(F.col("entity_offset").isNotNull()).select("type", "name", "anchor_type", "anchor_name", "entity_round")
    rows = observations.join(known, ["type", "name", "anchor_type", "anchor_name"])
    # of the entity's last round, what it handed on itself came after
    before = (F.col("round") < F.col("entity_round") + 1) & (F.abs(F.col("round") - F.col("entity_round") - 0.9) > 0.01)
    weight = round_weight(F.lit(1.0), F.col("round"), F.coalesce("devalue", F.lit(0.0)))
    return rows.filter(before).select("type", "name", "entity_round", "id", "source", "offset", "source_score", weight.alias("weight"))


def explain_consensus(members: DataFrame, limit: int = EXPLAINED) -> DataFrame:
    """(type, name, entity_explanation): ``round N: [source] offset (score*weight) ...`` of an entity's first rows by
    id, and how many more there are; ``consensus_members`` has them all."""
    salt = F.pmod(F.xxhash64("id"), F.lit(64))
    few = members.withColumn("__k", F.row_number().over(Window.partitionBy("type", "name", salt).orderBy("id"))).filter(F.col("__k") <= limit)
    few = few.withColumn("__k", F.row_number().over(Window.partitionBy("type", "name").orderBy("id"))).filter(F.col("__k") <= limit)
    text = F.format_string("[%s] %d (%.2f*%.2f)", F.col("source").cast("string"), F.col("offset"), F.col("source_score"), F.col("weight"))
    listed = few.groupBy("type", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__k", text.alias("t")))), lambda x: x["t"]), " ").alias("__text"))
    counts = members.groupBy("type", "name").agg(F.count("*").alias("__n"), F.max("entity_round").alias("__r"))
    more = F.when(F.col("__n") > limit, F.format_string(" and %d more", F.col("__n") - limit)).otherwise("")
    return counts.join(listed, ["type", "name"]).select("type", "name", F.concat(F.format_string("round %d: ", "__r"), "__text", more).alias("entity_explanation"))


def _calc(offset: Column, kind: Column, name: Column, round_: Column | float, explanation: Column | str) -> Column:
    round_, explanation = (v if isinstance(v, Column) else F.lit(v) for v in (round_, explanation))
    return F.struct(offset.cast("int").alias("offset"), kind.alias("anchor_type"), name.alias("anchor_name"), round_.cast("double").alias("round"), explanation.alias("explanation"))
