"""Connected components of a table of links, and frames beside a small or large side table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeo.llm.store import stored

# Ids up to which a set of them is broadcast: below 40 bytes each in memory. Above, joins shuffle.
BROADCAST_IDS = 2_000_000


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``links`` (a, b) can reach. Nulls link nothing.

    Every round takes the smallest label among a node and its neighbours, pre-aggregated in every task, and then jumps
    to the label of that label, so the number of rounds follows the logarithm of the longest path. Each round is
    written to the shared folder; only the number of changes comes to the driver.
    """
    one = links.filter("a is not null and b is not null and a <> b").select("a", "b")
    both = stored(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("near")).agg(F.min("component").alias("lowest"))
        lower = labels.join(near, F.col("node") == F.col("near")).select("node", F.col("component").alias("was"), F.least("component", "lowest").alias("component"))
        jump = stored(lower, "labels")
        over = jump.select(F.col("node").alias("over"), F.col("component").alias("further"))
        after = stored(jump.join(over, F.col("component") == F.col("over"), "left").select("node", "was", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        labels = after.select("node", "component")
        if not after.filter("component <> was").limit(1).count():
            return labels


def beside(docs: DataFrame, side: DataFrame, key: str, whole: bool) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` joined with ``side`` on ``key``, and the other rows of ``docs`` if ``whole`` (else None).

    If the ids of ``side`` are few enough, they are broadcast first, so that only the texts they name are shuffled.
    Otherwise the first frame holds all rows (``whole``) or those that match, by one shuffle join.
    """
    if side.count() > BROADCAST_IDS:
        return docs.join(side, key, "left" if whole else "inner"), None
    ids = F.broadcast(side.select(key).distinct())
    rest = docs.join(ids, key, "left_anti") if whole else None
    return docs.join(ids, key, "left_semi").join(side, key), rest
