"""Offers, landed pages and stores derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfgauge.operators.repair import fixed_table
from shelfgauge.plans.fixed_repairs import MEAT_REPAIRS, PACK_BRAND

# What a product name ends in, by (p_partkey div 16) % 16.
ENDINGS = (
    "", " Coffee Pods", " Tea Bags", " Teabags", " Eggs", " EGG Bites", " Candy", " Granola Bar",
    " Coffe K Pods", " Sandwich Mix", " Ice Cream", " candy", " Organic", " Ground",
    " Family Pack", "",
)

# Compound sizes the repair rules know, by (p_partkey div 16) % 10.
KNOWN_SIZES = (
    "1 pt / 10 oz", "4 ct / 10.5 oz", "4 ct / 15.25 oz", "6 ct / 8 fl oz",
    "12 bottles / 16 fl oz", "12 ct / 1.16 oz", "16 ct / .99 oz", "16 ct / 1.13 oz",
    "4 ct / 12 oz", "8 ct / 1.15 oz",
)

# The brand that stands for the one whose packs are multiplied out.
PACK_BRAND_CODE = "Brand#7"


# Columns the offers are made of; a declared schema spares the look into the files.
COLUMNS = {
    "lineitem": "l_partkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice double, l_discount double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(COLUMNS[name]) if name in COLUMNS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], index: str) -> str:
    listed = ", ".join(f"'{value}'" for value in values)
    return f"element_at(array({listed}), cast({index} as int) + 1)"


SIZE = f"""case cast(p_partkey % 16 as int)
    when 0 then 'each' when 1 then '1 each' when 2 then '1/2 gal' when 3 then 'large dozen'
    when 4 then cast(null as string)
    when 5 then concat(p_size, ' ct') when 6 then concat(p_size, 'ct')
    when 7 then concat(p_size, ' lb') when 8 then concat(p_size, ' fl oz')
    when 9 then concat(p_size, ' qt') when 10 then concat(p_size, ' l')
    when 11 then concat(p_size, ' rolls')
    when 12 then concat(1 + p_size % 6, ' ct / ', p_size, ' oz')
    when 13 then concat(p_size, '.5 oz.') when 14 then concat(p_size, ' oz')
    else {_pick(KNOWN_SIZES, "(p_partkey div 16) % 10")} end"""

DESCRIPTION = f"concat(p_name, {_pick(ENDINGS, '(p_partkey div 16) % 16')})"

RULE = f"""case when p_partkey % 16 = 12 and (p_partkey div 16) % 4 = 3
    then cast((p_partkey div 64) % {len(MEAT_REPAIRS)} as int) end"""

PROMO = """case when l_linenumber = 7 then cast(null as double)
    when l_discount = 0 then cast(0 as double)
    else floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) / 100 end"""


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as products; some compound sizes belong to products with a rule of their own."""
    named = fixed_table(
        spark,
        "rule int, rule_description string, rule_size string",
        [(i, name, size) for i, (name, size, _) in enumerate(MEAT_REPAIRS)],
    )
    part = table(spark, sf_dir, "part").selectExpr("*", f"{RULE} as rule")
    return part.join(named, "rule", "left").selectExpr(
        "p_partkey",
        "p_type as category",
        f"coalesce(rule_description, {DESCRIPTION}) as description",
        f"if(p_brand = '{PACK_BRAND_CODE}', '{PACK_BRAND}', p_brand) as brand",
        f"coalesce(rule_size, {SIZE}) as size",
    )


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as offers: one store's regular and promo price for one product."""
    prices = table(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey", "l_suppkey as store_id", "l_extendedprice as regular", f"{PROMO} as promo",
        "l_linenumber",
    )
    # Both sides grow with the data, so neither is ever broadcast; adaptive
    # execution splits the partition of a hot product.
    parts = products(spark, sf_dir).hint("merge")
    return prices.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        "category", "store_id", "description", "brand", "size", "regular", "promo", "l_linenumber"
    )


def landed_page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search result page of JSON text per offer, as a remote catalogue returns it.

    Each page lists the offer and, behind it in ``items``, another size which
    ingest has to ignore.  Line 1 pages also list the product without any item,
    line 2 pages without a price.  Line 6 pages are cut off and line 7 pages
    are error messages.
    """
    def product(items: Column) -> Column:
        return F.struct(
            F.concat(F.lit("P"), F.col("store_id")).alias("productId"),
            "description",
            "brand",
            items.alias("items"),
        )

    price = F.struct("regular", "promo").alias("price")
    no_price = F.lit(None).cast("struct<regular:double,promo:double>").alias("price")
    item = F.struct("size", price)
    other_item = F.struct(F.lit("1 pallet").alias("size"), no_price)
    normal = product(F.array(item, other_item))
    without_items = product(F.array().cast("array<struct<size:string,price:struct<regular:double,promo:double>>>"))
    without_price = product(F.array(F.struct("size", no_price)))
    line = F.col("l_linenumber")
    listed = (
        F.when(line == 1, F.array(normal, without_items))
        .when(line == 2, F.array(normal, without_price))
        .otherwise(F.array(normal))
    )
    meta = F.struct(F.struct(F.array_size(listed).alias("total")).alias("pagination"))
    store = F.col("store_id").cast("string").alias("store")
    page = F.to_json(F.struct(listed.alias("data"), meta.alias("meta"), store))
    text = (
        F.when(line == 6, F.substring(page, 1, 40))
        .when(line == 7, F.to_json(F.struct(F.lit("timed out").alias("error"))))
        .otherwise(page)
    )
    return offers(spark, sf_dir).select(
        F.col("category").alias("term"),
        store,
        text.alias("value"),
    )


def paged_search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result pages of up to 50 offers per search, as JSON text, with what can go wrong.

    The second page is missing for stores divisible by 3, the first page came
    twice for even stores, the first page is an error message for stores that
    leave 3 modulo 7, and the last page is cut off for those that leave 5 modulo 11.
    """
    search = ("category", "store_id")
    place = F.row_number().over(Window.partitionBy(*search).orderBy("l_linenumber", "regular", "description")) - 1
    numbered = offers(spark, sf_dir).withColumn("page", F.floor(place / 50).cast("int"))
    product = F.struct("description", "brand", F.array(F.struct("size", F.struct("regular", "promo").alias("price"))).alias("items"))
    pages = numbered.groupBy(*search, "page").agg(F.collect_list(product).alias("data"))
    totals = numbered.groupBy(*search).agg(F.count(F.lit(1)).alias("total"), F.max("page").alias("last"))
    pages = pages.join(totals, list(search))
    store, number = F.col("store_id"), F.col("page")
    meta = F.struct(F.struct("total", (number * 50).alias("start")).alias("pagination"))
    text = F.to_json(F.struct("data", meta.alias("meta")))
    text = (
        F.when((number == 0) & (store % 7 == 3), F.to_json(F.struct(F.lit("timed out").alias("error"))))
        .when((number == F.col("last")) & (store % 11 == 5), F.substring(text, 1, 40))
        .otherwise(text)
    )
    times = F.when((number == 0) & (store % 2 == 0), F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    landed = pages.filter(~((number == 1) & (store % 3 == 0))).withColumn("text", text)
    return landed.select(
        F.col("category").alias("term"), store.cast("string").alias("store"), F.explode(times).alias("copy"),
        F.col("text").alias("value"),
    ).drop("copy")


def store_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store search results as JSON text: one document per supplier."""
    supplier = table(spark, sf_dir, "supplier")
    places = (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    store = F.struct(
        F.col("s_suppkey").cast("string").alias("locationId"),
        F.col("n_name").alias("chain"),
        F.struct(F.col("s_name").alias("addressLine1"), F.col("r_name").alias("city")).alias("address"),
    )
    return supplier.join(places, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("position"),
        F.to_json(F.struct(F.array(store).alias("data"))).alias("value"),
    )
