"""Mixing sources to target weights by entropy balancing.

Among all document rates whose words add up to a source's target, and of which
none exceeds the cap, the one closest to "every document once" in relative
entropy is an exponential tilt, ``rate = min(cap, exp(tilt * size / mean size))``.
The tilts solve the convex dual, one equation a source; Newton's iterations find
them, each step one distributed aggregation over counts of equal sizes.  Rates
are then rounded into whole copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfgauge.llm.common import free_name, read_table, words, written
from shelfgauge.operators.ranking import running_total

SHARE = 1.5
WEIGHTS = (5, 2, 1)
MAX_COPIES = 2
MAX_STEPS = 80
# Rates are summed as whole multiples of this fraction, so sums don't depend on the order of rows.
UNIT = 2**30
# So many documents of a source, on average, may be rounded the other way to meet its target.
ADJUSTERS = 2_000


def exact(value: Column) -> Column:
    return F.floor(value * UNIT).cast("decimal(38,0)")


def uniform(salt: int) -> Column:
    """A fixed number in [0, 1) for each doc_id."""
    return F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(2**40)) / F.lit(2.0**40)


def sized_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, key, size), stored: words of each text; ``key`` sorts sources by code point, NULL last."""
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(
        F.concat(F.lit("0"), F.col("source").cast("string")))
    size = F.coalesce(F.size(words(F.col("text").cast("string"))), F.lit(0))
    size = F.when(F.col("text").isNull(), F.lit(0)).otherwise(size)
    return written(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), key.alias("key"),
                               size.cast("bigint").alias("size")), "sized")


def source_targets(sized: DataFrame, share: float, weights: tuple[int, ...], cap: int) -> DataFrame:
    """(key, n_docs, source_size, weight, target), stored.

    The target is ``least(cap * source_size, level * weight)``; the level rises
    until all words are shared out, each step one aggregation to a single row.
    """
    sources = sized.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    sources = written(sources.withColumn("one", F.lit(1)), "sources")
    place = F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), place + 1)
    weighted = running_total(sources, (), "key", "one", "place").withColumn("weight", weight)
    weighted = written(weighted.drop("one", "place"), "weighted")
    limit = F.col("source_size") * cap
    level = 0.0
    while True:
        full = limit <= F.lit(level) * F.col("weight")
        row = weighted.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, limit).otherwise(F.lit(0))).alias("held"),
            F.sum(F.when(~full, F.col("weight")).otherwise(F.lit(0))).alias("open")).first()
        if not row["open"]:
            break
        risen = (share * row["all"] - row["held"]) / row["open"]
        if risen <= level:
            break
        level = risen
    target = F.least(limit.cast("double"), F.lit(level) * F.col("weight"))
    return written(weighted.withColumn("target", target), "targets")


def rate(cap: int) -> Column:
    """The tilted rate of a document; a NULL tilt is infinite."""
    return F.when(F.col("tilt").isNull() & (F.col("target") > 0), F.lit(float(cap))).otherwise(
        F.least(F.lit(float(cap)), F.exp(F.col("tilt") * F.col("size") * F.col("n_docs") / F.col("source_size"))))


def tilts(sized: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """Add each source's tilt to ``targets``, stored.

    Newton's step where it stays between the tilts known as too low and too
    high, else the middle between them, or twice as far where one is unknown.
    """
    counts = written(sized.where("size > 0").groupBy("key", "size").agg(
        F.count(F.lit(1)).alias("n")), "sizes")
    unknown = F.lit(None).cast("double")
    # At the cap all documents are taken as often as allowed; no finite tilt does that.
    full = (F.col("target") >= F.col("source_size") * cap) | (F.col("source_size") == 0)
    state = targets.select("*", F.when(~full, F.lit(0.0)).alias("tilt"), unknown.alias("low"),
                           unknown.alias("high"), (~full).alias("open"))
    state = written(state, "tilts")
    for _ in range(MAX_STEPS):
        if state.where("open").isEmpty():
            break
        mass = F.col("size") * F.col("n")
        relative = F.col("size") * F.col("n_docs") / F.col("source_size")
        sums = counts.join(state.where("open"), "key").withColumn("rate", rate(cap)).groupBy("key").agg(
            (F.sum(exact(F.col("rate")) * mass).cast("double") / UNIT).alias("words"),
            (F.sum(F.when(F.col("rate") < cap, exact(F.col("rate") * relative) * mass)).cast("double")
             / UNIT).alias("slope"))
        gap = F.col("words") - F.col("target")
        done = F.abs(gap) <= F.col("target") * 1e-7 + 0.01
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap >= 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - gap / F.nullif(F.col("slope"), F.lit(0.0))
        inside = step.isNotNull() & (F.coalesce(F.col("low"), step - 1) < step) & (
            step < F.coalesce(F.col("high"), step + 1))
        other = F.when(F.col("low").isNull(), F.col("high") * 2 - 1).when(
            F.col("high").isNull(), F.col("low") * 2 + 1).otherwise((F.col("low") + F.col("high")) / 2)
        moved = state.join(sums, "key", "left").withColumn("low", low).withColumn("high", high)
        next_tilt = F.when(F.col("open") & ~done, F.when(inside, step).otherwise(other)).otherwise(F.col("tilt"))
        moved = moved.withColumn("tilt", next_tilt).withColumn("open", F.col("open") & ~done)
        state = written(moved.drop("words", "slope"), "tilts")
    return state


def rounded(sized: DataFrame, state: DataFrame, cap: int) -> DataFrame:
    """Whole copies: (doc_id, key, size, source_size, target, copies).

    The fraction of a rate becomes a copy by a fixed random number of the
    document.  What a source's words then lack, or have too much, is met by
    rounding some of its documents the other way: about ADJUSTERS of them,
    chosen by hash, so an array of bounded length per source, longest first,
    each changed if that brings the source closer to its target.
    """
    whole = F.floor("rate")
    drawn = sized.join(state.select("key", "n_docs", "source_size", "target", "tilt"), "key").withColumn(
        "rate", F.coalesce(rate(cap), F.lit(0.0))).withColumn(
        "copies", whole + F.when(uniform(1) < F.col("rate") - whole, 1).otherwise(0))
    drawn = written(drawn.drop("rate", "tilt"), "drawn")
    lacking = drawn.groupBy("key").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
    movable = drawn.where("size > 0 and doc_id is not null").where(uniform(2) * F.col("n_docs") < ADJUSTERS)
    movable = movable.groupBy("key", "doc_id").agg(
        F.max("size").alias("size"), F.max("copies").alias("copies"), F.count(F.lit(1)).alias("rows")
    ).where("rows = 1")
    item = F.struct((-F.col("size")).alias("size"), "doc_id", "copies")
    per_source = movable.groupBy("key").agg(F.sort_array(F.collect_list(item)).alias("items"))

    def move(state: Column, item: Column) -> Column:
        gap, size = state["gap"], -item["size"]
        more = (gap > 0) & (item["copies"] < cap) & (F.abs(gap - size) < F.abs(gap))
        less = (gap < 0) & (item["copies"] > 0) & (F.abs(gap + size) < F.abs(gap))
        change = F.when(more, 1).when(less, -1).otherwise(0)
        return F.struct((gap - size * change).alias("gap"), F.concat(state["changes"], F.array(change)).alias("changes"))

    start = F.struct(F.col("gap"), F.array().cast("array<int>").alias("changes"))
    changes = per_source.join(lacking, "key").select(
        "key", F.explode(F.arrays_zip("items", F.aggregate("items", start, move)["changes"].alias("change"))).alias("x"))
    changes = written(changes.select(
        F.col("key").alias("k"), F.col("x.items.doc_id").alias("id"), F.col("x.change").alias("change")
    ).where("change <> 0"), "changes")
    final = drawn.join(changes, (drawn["doc_id"] == changes["id"]) & (drawn["key"] == changes["k"]), "left")
    return final.withColumn("copies", (F.col("copies") + F.coalesce("change", F.lit(0))).cast("int")).select(
        "doc_id", "key", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS,
        cap: int = MAX_COPIES) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies.

    Sources in code point order, NULL last, weigh ``weights`` in turn and share
    ``share`` times all words; a target stops at ``cap`` times its source's
    words and the excess goes to the others by weight.  ``taken`` is copies
    times size and adds up, per source, to about its target.  NULL texts and
    texts without words have size 0 and are kept once, or ``cap`` times where
    the whole source is taken as often as allowed.  Rows that repeat a doc_id
    are documents of their own.  An empty table gives no rows.  Columns other
    than doc_id, source and text are not read.
    """
    sized = sized_documents(docs)
    state = tilts(sized, source_targets(sized, share, weights, cap), cap)
    return rounded(sized, state, cap).select(
        "doc_id", "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents themselves, each row as often as the mix takes it.

    Rows that repeat a doc_id, with whatever texts, are taken as often as the
    one of them that is taken most.
    """
    id_name, copies_name = free_name("taken_id", docs), free_name("copies", docs)
    taken = mix(docs).groupBy(F.col("doc_id").alias(id_name)).agg(F.max("copies").alias(copies_name))
    rows = docs.join(taken, docs["doc_id"].cast("bigint").eqNullSafe(taken[id_name]))
    repeated = F.explode(F.array_repeat(F.lit(1), F.col(copies_name)))
    return rows.withColumn(copies_name, repeated).drop(copies_name, id_name)


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))
