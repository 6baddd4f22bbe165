"""Exact duplicates by content sort, with DataFrame functions only.

Sampled splitters range-partition the texts, each partition is sorted externally so that equal texts stand next to
each other, and a window over neighbours compares whole texts and names the row that stays.

Splitters are drawn from the first characters of a text and its digest, not from whole texts: the order is the same for
equal texts, and what the driver samples stays small however long texts are. Groups so large that they would fill a
partition are found beforehand by a count of digests, which is pre-aggregated in every task. Only the winner of such a
group is sorted; its other members get their answer from a table with a bounded number of rows, without moving.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondeo.llm.store import partitions
from sondeo.llm.words import column, text_or_empty

# Characters of the text that lead the sort key.
LEAD_CHARS = 32
# A group is hot above 1/(HOT_SHARE * partitions) of the rows, so at most HOT_SHARE * MOST_PARTITIONS rows are broadcast.
HOT_SHARE = 4
MOST_PARTITIONS = 10_000


def annotated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest", normalise=None) -> DataFrame:
    """One row for each row of ``docs``: ``row`` (struct of its columns), keep_id, group_size, kept, text_sha256.

    ``keep``: "smallest" or "largest" id of a group stays. ``normalise``: a function of the text column, or None to
    compare texts as they are. A null text counts as empty. A null id loses against any other; among rows that share
    text and id one stays. An empty table gives no rows. Any other columns, whatever their names, stay in ``row``.
    """
    text = text_or_empty(column(docs, text_column))
    text = normalise(text) if normalise else text
    best = {"smallest": F.min, "largest": F.max}[keep]
    base = docs.select(
        F.struct(*(column(docs, c) for c in docs.columns if c != text_column)).alias("rest") if docs.columns != [text_column] else F.lit(None).alias("rest"),
        column(docs, id_column).alias("id"), text.alias("t"),
        *([column(docs, text_column).alias("raw")] if normalise else [column(docs, text_column).isNull().alias("gone")]),
    ).withColumn("sha", F.sha2(F.col("t").cast("binary"), 256))
    rows = docs.count()
    share = max(2, rows // (HOT_SHARE * min(MOST_PARTITIONS, partitions(docs))))
    hot = base.groupBy("sha").agg(F.count("*").alias("hot_n"), best("id").alias("hot_id")).filter((F.col("hot_n") > share) & F.col("hot_id").isNotNull())
    known = base.join(F.broadcast(hot), "sha", "left")
    loses = F.col("hot_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("hot_id"))

    def out(frame: DataFrame, keep_id: Column, size: Column, kept: Column) -> DataFrame:
        whole = F.col("raw") if normalise else F.when(~F.col("gone"), F.col("t"))
        fields = [whole.alias(c) if c == text_column else F.col("rest").getField(c).alias(c) for c in docs.columns]
        return frame.select(F.struct(*fields).alias("row"), keep_id.alias("keep_id"), size.cast("long").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))

    direct = out(known.filter(loses), F.col("hot_id"), F.col("hot_n"), F.lit(False))
    lead = F.substring("t", 1, LEAD_CHARS)
    contest = known.filter(~loses).withColumn("lead", lead).repartitionByRange("lead", "sha")
    order = F.col("id").asc_nulls_last() if keep == "smallest" else F.col("id").desc_nulls_last()
    group = Window.partitionBy("lead", "sha", "t")
    contest = contest.withColumns({
        "place": F.row_number().over(group.orderBy(order)), "best": F.first("id").over(group.orderBy(order)), "n": F.count("*").over(group),
    })
    rest = out(contest, F.col("best"), F.coalesce("hot_n", "n"), F.col("place") == 1)
    return direct.unionByName(rest)


def kept_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they came."""
    return annotated(docs, **options).filter("kept").select("row.*")
