"""Structured fields out of text, and text out of fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timetext import _found, let


def relative_offset(text: Column) -> Column:
    """struct(name, type, days) of ``[Type:] Name +3 [weeks]`` or ``Name -5 to -4 weeks``; null if there is none.

    Each end is rounded to days before a range is averaged, and the mean is cut toward zero.
    """
    parts = F.split(text, ":")
    typed = F.size(parts) == 2
    number, weeks = "([-+])([0-9.]+)", "(.*(?:week|Week))?"
    span, single = f"(.+){number} to {number}{weeks}", f"(.+){number}{weeks}"

    def read(rest: Column) -> Column:
        def days(pattern: str, group: int, unit: int) -> Column:
            value = F.concat(_found(rest, pattern, group), _found(rest, pattern, group + 1)).try_cast("double")
            return F.round(value * F.when(F.lower(F.trim(_found(rest, pattern, unit))) == "week", 7).otherwise(1)).cast("int")

        def chosen(d: Column) -> Column:
            name = F.trim(F.when(d["both"].isNotNull(), _found(rest, span, 1)).otherwise(_found(rest, single, 1)))
            value = F.coalesce(_half(d["both"]), d["one"])
            return F.when(value.isNotNull(), F.struct(name.alias("name"), F.when(typed, F.trim(F.get(parts, F.lit(0)))).alias("type"), value.alias("days")))

        return let(F.struct((days(span, 2, 6) + days(span, 4, 6)).alias("both"), days(single, 2, 4).alias("one")), chosen)

    return let(F.when(typed, F.get(parts, F.lit(1))).otherwise(text), read)


def _half(x: Column) -> Column:
    """x / 2 cut toward zero."""
    return F.when(x < 0, F.ceil(x / 2)).otherwise(F.floor(x / 2)).cast("int")


def release_info(text: Column) -> Column:
    """struct(by, year, authoritative, error): ``WSU 2011*``; null for null and empty text.

    A year outside 1800 to 2100 is an error; without a year the whole text (less the star) says who released it.
    """
    dated = r"(.*\s)?([0-9]+)\*?$"
    year = _found(text, dated, 2).try_cast("int")
    by = F.when(text.rlike(dated), F.nullif(F.trim(_found(text, dated, 1)), F.lit(""))).otherwise(F.trim(F.regexp_replace(F.trim(text), r"\*$", "")))
    error = text.rlike(dated) & ~F.coalesce(year.between(1800, 2100), F.lit(False))
    return F.when(text != "", F.struct(F.when(~error, by).alias("by"), F.when(~error, year).alias("year"), text.endswith("*").alias("authoritative"), error.alias("error")))


def patent_info(text: Column) -> Column:
    """struct(number, expires): ``USPP30925 expires 2038-03-07``; a bare year is its first day; noon UTC."""
    number = _found(text, "USPP([0-9]+)", 1).try_cast("int")
    day = F.coalesce(_found(text, "USPP[0-9]+[^0-9].*?([0-9]{4}-[0-9]{2}-[0-9]{2})$", 1), F.concat(_found(text, "USPP[0-9]+[^0-9](?:.*[^0-9])?([0-9]{4})$", 1), F.lit("-01-01")))
    expires = F.try_to_timestamp(F.concat(day, F.lit(" 12:00:00")), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.struct(number.alias("number"), expires.alias("expires"))


def search_key(text: Column) -> Column:
    """Letters and digits of ASCII in lower case, without trademark signs."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"\(tm\)|\(r\)|™|®", ""), "[^a-zA-Z0-9]", ""))


def alias_fields(aliases: Column) -> Column:
    """struct(aka, aka_fts, marketing_name): aliases without commas, their keys, and trademarked ones by ``and``."""
    plain = F.transform(aliases, lambda a: F.replace(a, F.lit(","), F.lit("")))
    marked = F.filter(plain, lambda a: a.rlike(r"\(tm\)|\(r\)|™|®"))
    names = F.transform(marked, lambda a: F.trim(F.regexp_replace(a, r"\(tm\)|\(r\)|™|®", "")))
    return F.struct(plain.alias("aka"), F.transform(plain, search_key).alias("aka_fts"), F.when(F.size(names) > 0, F.array_join(names, " and ")).alias("marketing_name"))


def parse_tags(text: Column) -> Column:
    """``S1S4 [1,2] or S4'S9 [3]`` as an array of struct(tag, ids); text without brackets has none."""
    pattern = r"([a-zA-Z0-9']+) +\[([0-9,]+)\]"
    tags, ids = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.transform(F.arrays_zip(tags.alias("tag"), ids.alias("ids")), lambda p: F.struct(p["tag"].alias("tag"), F.filter(F.split(p["ids"], ","), lambda i: i != "").alias("ids")))


def format_tags(tags: Column) -> Column:
    """The text of an array of struct(tag, ids): ids and tags sorted as text, several tags named a conflict."""
    parts = F.array_sort(F.transform(tags, lambda t: F.concat(t["tag"], F.lit(" ["), F.array_join(F.array_sort(F.array_distinct(t["ids"].cast("array<string>"))), ","), F.lit("]"))))
    return F.concat(F.array_join(parts, " or "), F.when(F.size(parts) > 1, " (conflicting sources)").otherwise(""))


def merge_tag_texts(old: Column, new: Column) -> Column:
    """Union of two tag texts; the empty text is none."""
    both = F.concat(parse_tags(F.coalesce(old, F.lit(""))), parse_tags(F.coalesce(new, F.lit(""))))
    tags = F.array_distinct(F.transform(both, lambda p: p["tag"]))
    return format_tags(F.transform(tags, lambda t: F.struct(t.alias("tag"), F.flatten(F.transform(F.filter(both, lambda p: p["tag"] == t), lambda p: p["ids"])).alias("ids"))))


def slug(path: Column) -> Column:
    """A readable path for a URL: spaces become ``_``, other signs of each segment are percent-encoded but ``'!()*~``."""
    def one(segment: Column) -> Column:
        out = F.replace(F.url_encode(F.replace(segment, F.lit(" "), F.lit("_"))), F.lit("+"), F.lit("%20"))
        for sign, code in (("'", "%27"), ("!", "%21"), ("(", "%28"), (")", "%29"), ("~", "%7E")):
            out = F.replace(out, F.lit(code), F.lit(sign))
        return out

    return F.array_join(F.transform(F.split(path, "/"), one), "/")


def unslug(path: Column) -> Column:
    return F.replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), F.lit("_"), F.lit(" "))


def signed_days(days: Column) -> Column:
    return F.when(days.isNull(), "(no harvest time)").otherwise(F.format_string("%+d", days))


def expiry_label(expires: Column, estimated: Column, now: Column) -> Column:
    """``2031 (estimated)`` or ``March 7, 2038``, with `` (expired)`` for what lies before ``now``."""
    base = F.when(estimated, F.concat(F.date_format(expires, "yyyy"), F.lit(" (estimated)"))).otherwise(F.date_format(expires, "MMMM d, yyyy"))
    return F.concat(base, F.when(expires < now, " (expired)").otherwise(""))


def map_view(path: Column) -> Column:
    """struct(lat, lon, zoom, path): ``@45.5,-122.6,11z`` cut out of a path; slashes of the rest are tidied."""
    number = r"(-?[0-9]+\.?[0-9]*)"
    pattern = rf"@{number},{number},{number}z"
    rest = F.regexp_replace(F.regexp_replace(F.concat(F.regexp_replace(path, pattern, ""), F.lit("/")), "/+", "/"), "^/", "")
    return F.struct(*[_found(path, pattern, k).try_cast("double").alias(n) for k, n in ((1, "lat"), (2, "lon"), (3, "zoom"))], rest.alias("path"))


def split_source_path(path: Column) -> Column:
    """struct(path, filename): the folder below ``references``, with a slash at its end; the name without extension."""
    tidy = F.replace(path, F.lit("\\"), F.lit("/"))
    below = F.when(tidy.contains("references"), F.regexp_replace(tidy, "^.*references", "")).otherwise(tidy)
    last = F.substring_index(below, "/", -1)
    is_file = last.rlike(r"\.[A-Za-z0-9]+$")
    folder = F.when(is_file, F.substr(below, F.lit(1), F.length(below) - F.length(last))).otherwise(below)
    folder = F.concat(F.regexp_replace(folder, "^/+|/+$", ""), F.lit("/"))
    return F.struct(folder.alias("path"), F.when(is_file, F.regexp_replace(last, r"\.[^.]*$", "")).alias("filename"))


def patent_expiry_seconds(year: Column) -> Column:
    """Noon UTC of 1 January seventeen years after the grant, in unix seconds; independent of the session's zone."""
    return F.datediff(F.make_date(year + 17, F.lit(1), F.lit(1)), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + 43200


def degrees_normalize(degrees: Column) -> Column:
    """Into -180 (included) to 180."""
    return F.pmod(degrees + 180, F.lit(360.0)) - 180


def km_to_degrees(km: Column, latitude: Column) -> Column:
    """struct(lat, lon): a distance in degrees; longitude narrows linearly to the pole. Null for unreadable text."""
    lat = km.try_cast("double") * 360 / 40075
    lon = F.when(F.abs(latitude) >= 90, F.lit(0.0)).otherwise(lat * (90 - F.abs(latitude)) / 90)
    return F.struct(lat.alias("lat"), lon.alias("lon"))


def haversine_km(lat_1: Column, lon_1: Column, lat_2: Column, lon_2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat_2 - lat_1) / 2), F.lit(2)) + F.cos(F.radians(lat_1)) * F.cos(F.radians(lat_2)) * F.pow(F.sin(F.radians(lon_2 - lon_1) / 2), F.lit(2))
    return 2 * 6371.0088 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))
