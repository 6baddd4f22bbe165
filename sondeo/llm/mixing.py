"""Mix sources to target weights by repeating documents.

Word totals are summed per source before any shuffle, targets are filled up to a multiple of what a source has, and
every document is taken floor(rate) times plus one more time with the probability of the remainder. The draws come from
a hash of a seed and the id, so reruns and lost executors give the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondeo.llm.store import numbered, stored
from sondeo.llm.words import column, text_or_empty, word_count

SEED = "mix"
CAP = 3
DRAWS = 8
# Sources up to which the table of rates is broadcast: below 100 bytes each. Above, the join shuffles.
BROADCAST_SOURCES = 100_000


def draws(seed: str, key: Column) -> Column:
    """``DRAWS`` uniform values in [0, 1) from one hash of seed and key."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*(F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) for k in range(DRAWS)))


def cycled_weights(sources: DataFrame, weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """source, size and weight: the sources by code point, null last, take ``weights`` in turn."""
    ranked = numbered(sources, "rank", F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    return ranked.select("source", "size", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")).alias("weight"))


def targets(weighted: DataFrame, cap: float = CAP) -> DataFrame:
    """``weighted`` (source, size, weight) with target and rate = target / size.

    Targets share all sizes by weight; one above ``cap`` times its source's size stops there and the excess is shared
    anew by weight, until none is above. All targets below their cap are then one level times the weight, so each round
    needs three sums; rounds end when no further source reaches its cap.
    """
    ceiling = F.col("size") * F.lit(float(cap))
    level = 0.0
    while True:
        full = ceiling <= F.lit(level) * F.col("weight")
        row = weighted.agg(
            F.sum(F.col("size").cast("double")).alias("total"), F.sum(F.when(full, ceiling).otherwise(0.0)).alias("spent"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        if not row["weight"]:  # every source is at its cap, or there is none
            break
        higher = (row["total"] - row["spent"]) / row["weight"]
        if higher <= level:
            break
        level = higher
    target = F.least(ceiling, F.lit(level) * F.col("weight"))
    return weighted.withColumns({"target": target, "rate": F.when(F.col("size") > 0, target / F.col("size")).otherwise(0.0)})


def rated(sized: DataFrame, weigh, cap: float) -> DataFrame:
    """source, source_size, target, rate and pick (0 to DRAWS - 1) from ``sized`` (source, size, draws).

    Documents differ in size by orders of magnitude, so one draw can miss a target by several percent. Every hash gives
    eight draws; a source uses the one whose total comes nearest to its target (the first of equals).
    """
    totals = stored(sized.groupBy("source").agg(F.sum("size").alias("size")), "source-sizes")
    rates = stored(targets(stored(weigh(totals), "source-weights"), cap).select("source", F.col("size").alias("source_size"), "target", "rate"), "source-targets")
    share = F.col("rate") - F.floor("rate")
    sums = joined(sized, rates).groupBy("source").agg(
        *(F.sum(F.when(F.col("draws")[k] < share, F.col("size")).otherwise(0)).alias(f"once{k}") for k in range(DRAWS)),
    )
    off = [F.abs(F.col("target") - F.floor("rate") * F.col("source_size") - F.col(f"once{k}")) for k in range(DRAWS)]
    pick = (F.array_position(F.array(*off), F.array_min(F.array(*off))) - 1).cast("int")
    both = rates.join(sums.withColumnRenamed("source", "same"), F.col("source").eqNullSafe(F.col("same")))
    return stored(both.select("source", "source_size", "target", "rate", pick.alias("pick")), "source-rates")


def joined(rows: DataFrame, rates: DataFrame) -> DataFrame:
    side = rates.withColumnRenamed("source", "rated_source")
    side = F.broadcast(side) if rates.count() <= BROADCAST_SOURCES else side
    return rows.join(side, F.col("source").eqNullSafe(F.col("rated_source"))).drop("rated_source")


def copies() -> Column:
    once = F.element_at("draws", F.col("pick") + 1) < F.col("rate") - F.floor("rate")
    return F.floor("rate").cast("long") + once.cast("long")


def sizes(docs: DataFrame, carry: list[str], id_column: str, text_column: str, source_column: str, seed: str) -> DataFrame:
    size = word_count(text_or_empty(column(docs, text_column)))
    return docs.select(F.struct(F.lit(0).alias("_"), *(column(docs, c) for c in carry)).alias("row"), column(docs, source_column).alias("source"), size.alias("size"), draws(seed, column(docs, id_column)).alias("draws"))


def annotated(docs: DataFrame, weigh=cycled_weights, cap: float = CAP, seed: str = SEED, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each row of ``docs``: ``row`` (struct of ``carry``), size, source_size, target, copies, taken.

    ``weigh`` turns (source, size) into (source, size, weight). Size is the number of words; a null text has none. A
    null source is a source of its own. Rows with the same id share one draw. An empty table gives no rows.
    """
    sized = stored(sizes(docs, list(carry), id_column, text_column, source_column, seed), "document-sizes")
    out = joined(sized, rated(sized, weigh, cap)).withColumn("copies", copies())
    return out.select("row", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, weigh=cycled_weights, cap: float = CAP, seed: str = SEED, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken. Texts are read once for sizes, once for output."""
    sized = stored(sizes(docs, [], id_column, text_column, source_column, seed), "document-sizes")
    whole = docs.select(F.struct(*(column(docs, c) for c in docs.columns)).alias("row"), column(docs, source_column).alias("source"), draws(seed, column(docs, id_column)).alias("draws"))
    many = joined(whole, rated(sized, weigh, cap)).withColumn("copies", copies()).filter("copies > 0")
    return many.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
