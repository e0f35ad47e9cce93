"""Schemas of landed JSON; naming only what is used prunes the rest on read."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICE = T.StructType([
    T.StructField("regular", T.DoubleType()),
    T.StructField("promo", T.DoubleType()),
])

ITEM = T.StructType([
    T.StructField("size", T.StringType()),
    T.StructField("price", PRICE),
])

PRODUCT = T.StructType([
    T.StructField("description", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("items", T.ArrayType(ITEM)),
])

META = T.StructType([
    T.StructField("pagination", T.StructType([
        T.StructField("total", T.LongType()),
        T.StructField("start", T.LongType()),
    ])),
])

# Where a reader puts a text that is not JSON of the schema.
UNREADABLE = "unreadable"

PAGE = T.StructType([
    T.StructField("data", T.ArrayType(PRODUCT)),
    T.StructField("meta", META),
    T.StructField(UNREADABLE, T.StringType()),
])

STORE = T.StructType([
    T.StructField("locationId", T.StringType()),
    T.StructField("chain", T.StringType()),
    T.StructField("address", T.StructType([
        T.StructField("addressLine1", T.StringType()),
        T.StructField("city", T.StringType()),
    ])),
])

STORE_PAGE = T.StructType([T.StructField("data", T.ArrayType(STORE))])


def partitioned(page: T.StructType, *folders: str) -> T.StructType:
    """``page`` plus the string columns its landing folders are named after."""
    return T.StructType([*page.fields, *[T.StructField(name, T.StringType()) for name in folders]])


def parse_json(texts: DataFrame, schema: T.StructType, value: str) -> DataFrame:
    """Replace the JSON text ``value`` by the fields of ``schema``; NULL where it is not JSON.

    ``inline`` keeps the text parsed once: a filter on a field stays above it.
    """
    others = [name for name in texts.columns if name != value]
    parsed = F.from_json(value, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": UNREADABLE})
    return texts.select(*others, F.inline(F.array(parsed)))
