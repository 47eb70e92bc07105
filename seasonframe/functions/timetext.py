"""Free-text dates to days of a leap year, as column expressions.

Text that can't be read gives null instead of an error; ``parse_report`` counts the outcomes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import materialized, spread

MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
#: Days of the months of a leap year, and the days before each.
LENGTHS = [31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
STARTS = [sum(LENGTHS[:m]) for m in range(12)]
#: Days of the month for the parts of a month.
PARTS = {"early to mid": 10, "mid to late": 20, "early-mid": 10, "mid-late": 20, "early": 5, "mid": 15, "late": 25}
_ABBREVIATIONS = "|".join(m[:3] for m in MONTHS)
_SEASON = "^(very early|early-mid|mid-late|early|mid|late|early season|mid season|late season|very late|summer)$"


def _found(text: Column, pattern: str, group: int) -> Column:
    """A group of the first match; null without one."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it: keeps long expressions small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def day_of_year(text: Column) -> Column:
    """Of one date: ``m/d`` anywhere, a bare month (its 15th), a part of a month, or a month followed by a day.

    >>> day_of_year(F.lit("mid-late August"))  # 233
    """
    part, in_text = rf"({'|'.join(PARTS)}) (.*)", rf"({_ABBREVIATIONS})[^0-9]*([0-9]+)"
    part_day = F.create_map(*[F.lit(x) for name, day in PARTS.items() for x in (name, str(day))])

    def month_and_day(low: Column) -> Column:
        return (
            F.when(~low.rlike(r"\s"), F.concat(low, F.lit(" 15")))
            .when(low.rlike(part), F.concat(F.regexp_extract(low, part, 2), F.lit(" "), part_day[F.regexp_extract(low, part, 1)]))
            .when(low.rlike(in_text), F.concat_ws(" ", F.regexp_extract(low, in_text, 1), F.regexp_extract(low, in_text, 2)))
            .otherwise(low)
        )

    def dated(low: Column) -> Column:
        """In a leap year; a month is its full name or the first three letters of it."""
        slashed = F.try_to_date(F.concat(F.lit("2020 "), F.regexp_extract(low, "[0-9]+/[0-9]+", 0)), "yyyy M/d")
        named = F.regexp_replace(F.concat(F.lit("2020 "), month_and_day(low)), r"\s+", " ")
        return F.coalesce(slashed, let(named, lambda t: F.coalesce(F.try_to_date(t, "yyyy MMMM d"), F.try_to_date(t, "yyyy MMM d"))))

    return F.dayofyear(let(F.lower(text), dated))


def is_midpoint(text: Column) -> Column:
    """A bare or ``mid`` month: its date is the middle of a window."""
    bare = F.regexp_replace(F.lower(text), r"\s", "")
    return F.when(bare.startswith("mid"), F.substr(bare, F.lit(4))).otherwise(F.lower(text)).rlike(rf"^({_ABBREVIATIONS})[^0-9]*$")


def month_place(text: Column) -> Column:
    """``start``, ``end`` or ``none``: where the text names its month."""
    low = F.lower(text)
    return F.when(low.rlike(rf"^({_ABBREVIATIONS})"), "start").when(low.rlike(rf"({_ABBREVIATIONS})[^0-9]*$"), "end").otherwise("none")


def day_range(text: Column, window: int = 10) -> Column:
    """struct(parse_type, start, end): ``Unparsed`` for words of the season, ``StartOnly``, ``TwoDates``, or null.

    A side of a range without a month takes the other side's. Dates near the new year may give a start of 0 or
    less; ``parse_report`` counts them.
    """
    half = window // 2
    kind = "struct<parse_type:string,start:int,end:int>"

    def made(name: str, start: Column | None = None, end: Column | None = None) -> Column:
        return F.struct(F.lit(name), F.lit(None) if start is None else start, F.lit(None) if end is None else end).cast(kind)

    def averaged(days: Column) -> Column:
        mean = F.floor(F.aggregate(days, F.lit(0), lambda a, d: a + d) / F.size(days))
        return F.when(~F.exists(days, lambda d: d.isNull()), made("StartOnly", mean))

    def ranged(sides: Column) -> Column:
        left, right = F.get(sides, F.lit(0)), F.get(sides, F.lit(1))

        def borrowed(side: Column, other: Column) -> Column:
            month, place = F.regexp_extract(F.lower(other), _ABBREVIATIONS, 0), month_place(other)
            return F.when(place == "start", F.concat_ws(" ", month, side)).when(place == "end", F.concat_ws(" ", side, month))

        def both(days: Column) -> Column:
            first, second = F.get(days, F.lit(0)), F.get(days, F.lit(1))
            other = F.when(second.isNull(), borrowed(right, left)).otherwise(borrowed(left, right))
            return (
                F.when(first.isNull() & second.isNull(), None)
                .when(first.isNotNull() & second.isNotNull(), made("TwoDates", first, second))
                .otherwise(let(day_of_year(other), lambda day: F.when(day.isNotNull(), made("TwoDates", F.coalesce(first, day), F.coalesce(second, day)))))
            )

        return F.when(F.size(sides) == 2, let(F.transform(sides, day_of_year), both))

    def single(day: Column) -> Column:
        low = F.lower(text)
        middle = low.startswith("50% harvest:") | (~low.startswith("first harvest:") & is_midpoint(text))
        return F.when(day.isNull(), None).when(middle, made("TwoDates", day - half, day + half)).otherwise(made("StartOnly", day))

    def read(low: Column) -> Column:
        harvest = low.startswith("first harvest:") | low.startswith("50% harvest:")
        sides = F.when(text.contains("-"), F.split(text, "-")).when(text.contains(" to "), F.split(text, " to "))
        return (
            F.when(low.rlike(_SEASON), made("Unparsed"))
            .when(low.startswith("average of: "), let(F.transform(F.split(F.substr(text, F.lit(len("average of: ") + 1)), ","), day_of_year), averaged))
            .when(harvest & day_of_year(text).isNotNull(), let(day_of_year(text), single))
            .when(sides.isNotNull(), let(sides, ranged))
            .otherwise(let(day_of_year(text), single))
        )

    return let(F.lower(text), read)


def two_season(text: Column, window: int = 10) -> Column:
    """struct(start, end, start_2, end_2); a slash that is no ``m/d`` parts two seasons."""
    parted = text.contains("/") & ~text.rlike("[0-9]+/[0-9]+")
    seasons = F.when(parted, F.transform(F.split(text, "/"), F.trim)).otherwise(F.array(text))

    def two(read: Column) -> Column:
        one, other = F.get(read, F.lit(0)), F.get(read, F.lit(1))
        return F.struct(one["start"].alias("start"), one["end"].alias("end"), other["start"].alias("start_2"), other["end"].alias("end_2"))

    return let(F.transform(seasons, lambda t: day_range(t, window)), two)


def parse_distinct(df: DataFrame, text: str, parser: Callable[[Column], Column], output: str) -> DataFrame:
    """Add ``output``, the parser's value of a text column: each distinct text is parsed once and joined back.

    Texts of one column repeat without end, and their values are few: where these are small, Spark sends them to all
    tasks, else it splits the rows of a frequent text.
    """
    texts = df.select(F.col(text).alias("__text")).filter(F.col("__text").isNotNull()).distinct()
    parsed = texts.select("__text", parser(F.col("__text")).alias("__parsed"))
    return df.join(parsed, F.col(text) == F.col("__text"), "left").withColumn(output, F.col("__parsed")).drop("__text", "__parsed")


def harvest_label(time: Column, unparsed: Column) -> Column:
    return F.coalesce(time, unparsed)


def parse_report(df: DataFrame, text: str, parsed: Column, sample: int = 10) -> DataFrame:
    """(outcome, n, examples) of ``day_range`` over a column: its kinds, ``failed``, ``empty`` and ``before_year``.

    Examples are the ``sample`` least texts of an outcome, kept bounded while they are aggregated. ``parsed`` reads the text
    alone: rows are counted first, and each distinct text is parsed once, with its outcome written.
    """
    value = F.col(text)
    outcome = F.when(F.trim(value) == "", "empty").when(value.isNull(), "absent").when(F.col("__p").isNull(), "failed").when(F.col("__p.start") <= 0, "before_year").otherwise(F.col("__p.parse_type"))
    texts = spread(materialized(df.groupBy(text).agg(F.count("*").alias("__n"))), rows=20_000)  # a text takes a tenth of a millisecond
    kinds = materialized(texts.select(value, "__n", parsed.alias("__p")).select(value.alias("__t"), outcome.alias("outcome"), F.col("__n").alias("n")))
    from pyspark.sql import Window

    ranked = kinds.withColumn("r", F.row_number().over(Window.partitionBy("outcome").orderBy("__t")))
    few = ranked.filter(F.col("r") <= sample).groupBy("outcome").agg(F.sort_array(F.collect_list("__t")).alias("examples"))
    return kinds.groupBy("outcome").agg(F.sum("n").alias("n")).join(few, "outcome")
