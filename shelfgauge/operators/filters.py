"""Product filters of the categories."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: pods sold under a coffee search, with one or two e's.
COFFEE_PODS = "Coffe{1,2}.*Pods"

# Words of products that contain peanut butter but are none.
NOT_PEANUT_BUTTER = (
    "Candy", "Bar", "Cereal", "Cookie", "Cups", "Granola", "Cracker", "Treats", "Ice Cream",
    "Protein Shake", "Dessert", "Pretzel", "Sandwich", "Chocolate", "Bone", "Biscuits",
    "Creme Pies", "Mix", "Baking Chips", "Clusters", "Wafers",
)


def mentions_none(text: Column, words: tuple[str, ...]) -> Column:
    """No word occurs in the text, upper and lower case told apart."""
    return ~text.rlike("|".join(words))


def never_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) == 0


def mentions_any_case(text: Column, word: str) -> Column:
    return F.lower(text).contains(word.lower())


def sold_by_count(size: Column) -> Column:
    return size.endswith("ct")


def keep_any_size(df: DataFrame, *size_columns: str) -> DataFrame:
    """Drop offers of which no size could be read."""
    return df.filter(~_none_known(size_columns))


def unparsed(df: DataFrame, *size_columns: str) -> DataFrame:
    """Offers of which no size could be read, for review."""
    return df.filter(_none_known(size_columns))


def _none_known(size_columns: tuple[str, ...]) -> Column:
    return reduce(and_, [F.col(name).isNull() for name in size_columns])
