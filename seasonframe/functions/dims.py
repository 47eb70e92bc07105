"""Fixed dimensions: small literal tables, built as DataFrames on demand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .timetext import LENGTHS, MONTHS, STARTS

#: Anchor of each type, as (anchor's type, anchor's name); fixed values.
ANCHORS = {
    "Peach": ("Peach", "Redhaven"),
    "Nectarine": ("Peach", "Redhaven"),
    "Japanese Plum": ("Japanese Plum", "Santa Rosa"),
    "Plumcot": ("Japanese Plum", "Santa Rosa"),
    "Apriplum": ("Japanese Plum", "Santa Rosa"),
    "Euro Plum": ("Euro Plum", "Italian"),
    "Sweet Cherry": ("Sweet Cherry", "Bing"),
    "Sour Cherry": ("Sour Cherry", "Montmorency"),
    "Apple": ("Apple", "Red Delicious"),
    "Grape": ("Grape", "Concord"),
    "Euro Pear": ("Euro Pear", "Bartlett"),
    "Apricot": ("Apricot", "Blenheim"),
    "Almond": ("Almond", "Nonpareil"),
    "Walnut": ("Walnut", "Chandler"),
    "Blueberry": ("Blueberry", "Legacy"),
    "Blackberry": ("Blackberry", "Marion"),
    "Asian Pear": ("Asian Pear", "Shinseiki"),
    "Raspberry": ("Raspberry", "Heritage"),
    "Hardy Kiwi": ("Hardy Kiwi", "Ken's Red"),
    "Fuzzy Kiwi": ("Fuzzy Kiwi", "Hayward"),
    "Pomegranate": ("Pomegranate", "Wonderful"),
}

#: Score of each kind of source, out of 100; fixed values.
SOURCE_SCORES = {
    "state extension guide": 100.0,
    "local extension guide": 90.0,
    "public garden guide": 85.0,
    "U-pick variety list": 80.0,
    "localized book": 50.0,
    "journal article test": 50.0,
    "extension test": 50.0,
    "localized grower or nursery recommendations": 45.0,
    "survey book": 40.0,
    "journal article": 40.0,
    "home grower variety list": 35.0,
    "public breeding program list": 25.0,
    "release article or journal overview": 25.0,
    "private breeding program list": 15.0,
    "IP company list": 15.0,
    "nursery catalog": 10.0,
    "dictionary": 1.0,
}

#: First plant patent number of each year from 1931 on; fixed values.
FIRST_PATENTS = [
    1, 6, 52, 85, 117, 162, 211, 266, 307, 352, 437, 499, 564, 611, 649, 666, 722, 774, 818, 911,
    1001, 1059, 1160, 1238, 1339, 1442, 1543, 1672, 1792, 1893, 2009, 2117, 2208, 2337, 2465, 2585, 2699, 2784, 2856, 2959,
    3011, 3063, 3281, 3413, 3674, 3824, 4001, 4174, 4360, 4491, 4612, 4796, 4970, 5168, 5380, 5622, 5846, 6075, 6501, 7089,
    7408, 7761, 8082, 8527, 9026, 9413, 9776, 10172, 10743, 11169, 11728, 12314, 13447, 14441, 15460, 16176, 17326, 18373, 19613, 20622,
    21604, 22428, 23288, 24135, 25207, 26285, 27520, 28831, 30040, 31315, 32717,
]
FIRST_PATENT_YEAR = 1931


def anchors(spark: SparkSession) -> DataFrame:
    """(type, anchor_type, anchor_name)"""
    return spark.createDataFrame([(t, *a) for t, a in ANCHORS.items()], "type string, anchor_type string, anchor_name string")


def anchor_set(anchors: DataFrame) -> DataFrame:
    """The distinct anchors of a map of types."""
    return anchors.select("anchor_type", "anchor_name").distinct()


def source_scores(spark: SparkSession) -> DataFrame:
    """(source_type, score)"""
    return spark.createDataFrame([*SOURCE_SCORES.items()], "source_type string, score double")


def patent_years(spark: SparkSession) -> DataFrame:
    """(first_number, year)"""
    return spark.createDataFrame([(n, FIRST_PATENT_YEAR + k) for k, n in enumerate(FIRST_PATENTS)], "first_number int, year int")


def month_grid(spark: SparkSession) -> DataFrame:
    """(month, name, start, quarter_1, quarter_2, quarter_3, end) in days of a leap year, counted from 0."""
    rows = [(m + 1, MONTHS[m].capitalize(), STARTS[m], *(STARTS[m] + round(n * q / 4) for q in (1, 2, 3)), STARTS[m] + n) for m, n in enumerate(LENGTHS)]
    return spark.createDataFrame(rows, "month int, name string, start int, quarter_1 int, quarter_2 int, quarter_3 int, end int")
