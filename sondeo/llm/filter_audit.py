"""What each filter of a corpus removes, alone, after others, and over all orders in which they may be applied.

Every part of the corpus keeps, for each filter, a posting list: the sorted places of the rows that fail it. Rows are
range-partitioned by part and id and then numbered along their partition, so a list covers one range of ids, a part with a
third of all rows is split over many tasks, and a task holds the lists of one range at a time. Unions of lists grow along
the lattice of filter sets, and all that an audit asks for is the size of a difference between a list and a union. Both are
k-way merges that gallop: a stretch of one list doubles its stride through the other until it is past, and only the bracket
found is searched. The sizes, 2 to the power of the number of filters at most for a part, are summed over ranges and parts,
and the orders are a join of those sums with a table of permutations.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sondeo.llm.arrow import schema_of
from sondeo.llm.quality_rules import let, word_array
from sondeo.llm.store import stored
from sondeo.llm.words import column, text_or_empty

# Rows of one range: the longest a posting list gets.
RANGE_ROWS = 1 << 16
# Entries of the shorter list that gallop together.
STRETCH = 256

#: Groups of labelled rows that are counted among the removed: name and condition on the labels.
LABELLED = {"good": "quality = 1", "toxic": "toxic = 1"}
SIZES = "part string, before int, filter int, removed long, redundant long, good long, toxic long, n long"


def bracketed(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Where each value of ``short`` stands or would stand in ``long``; both ascend strictly."""
    at, low, n = np.empty(len(short), np.int64), 0, len(long)
    for start in range(0, len(short), STRETCH):
        part = short[start : start + STRETCH]
        stride, high = STRETCH, min(low + STRETCH, n)
        while high < n and long[high - 1] < part[-1]:
            stride *= 2
            high = min(high + stride, n)
        at[start : start + len(part)] = low + np.searchsorted(long[low:high], part)
        low = int(at[start + len(part) - 1])
    return at


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Values of both lists; the shorter gallops through the longer."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not len(short):
        return short
    at = bracketed(short, long)
    inside = at < len(long)
    return short[inside][long[at[inside]] == short[inside]]


def united(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Values of either list, ascending: what the shorter has of its own goes between the entries of the longer."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not len(short):
        return long
    at = bracketed(short, long)
    own = np.ones(len(short), bool)
    inside = at < len(long)
    own[inside] = long[at[inside]] != short[inside]
    return np.insert(long, at[own], short[own])


def sizes(lists: list[np.ndarray], marked: list[np.ndarray]) -> list[tuple[int, ...]]:
    """(before, filter, removed, redundant, one count of removed for each list of ``marked``) for every set and filter.

    ``before`` has bit f set for each filter f applied before; removed are the rows of the filter's list outside the
    union of those lists.
    """
    k = len(lists)
    of_marked = [[common(x, m) for m in marked] for x in lists]
    unions = [np.empty(0, np.int64)] * (1 << k)
    for before in range(1, 1 << k):
        last = before.bit_length() - 1
        unions[before] = united(unions[before ^ (1 << last)], lists[last])
    out = []
    for before, f in itertools.product(range(1 << k), range(k)):
        if not before >> f & 1:
            redundant = len(common(lists[f], unions[before]))
            lost = [len(x) - len(common(x, unions[before])) for x in of_marked[f]]
            out.append((before, f, len(lists[f]) - redundant, redundant, *lost))
    return out


def posted(rows: DataFrame, names: list[str]) -> DataFrame:
    """The sizes of every part through posting lists: part, before, filter, removed, redundant, one count for each kind of label, n.

    ``n``, the rows of the part, stands on one row of each range and so sums up.
    """
    out, columns = schema_of(SIZES), [f"f{i}" for i in range(len(names))] + list(LABELLED)

    def of_range(part: str | None, batch: pa.RecordBatch) -> list[tuple]:
        lists = [np.flatnonzero(batch.column(c).to_numpy(zero_copy_only=False)) for c in columns]
        found = sizes(lists[: len(names)], lists[len(names) :])
        return [(part, *x, batch.num_rows if i == 0 else 0) for i, x in enumerate(found)]

    def run(batches):
        for batch in batches:
            ends = np.flatnonzero(np.diff(batch.column("part").dictionary_encode().indices.to_numpy())) + 1 if batch.num_rows else []
            for start, end in itertools.pairwise([0, *ends, batch.num_rows]):
                for at in range(start, end, RANGE_ROWS):
                    piece = batch.slice(at, min(RANGE_ROWS, end - at))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*of_range(piece.column("part")[0].as_py(), piece)), out)], schema=out)

    dealt = rows.repartitionByRange("part", "id", "salt").sortWithinPartitions("part", "id", "salt").select("part", *columns)
    return dealt.mapInArrow(run, SIZES).groupBy("part", "before", "filter").agg(*(F.sum(c).alias(c) for c in ("removed", "redundant", *LABELLED, "n")))


def orders(spark: SparkSession, names: list[str]) -> DataFrame:
    """filter_order, step from 1, filter and before (the set of filters applied earlier), for every order of ``names``."""
    every = F.array(*(F.lit(i) for i in range(len(names))))
    table = spark.range(1).select(F.slice(every, 1, 0).alias("o"))
    for _ in names:
        table = table.select("o", F.explode(F.array_except(every, "o")).alias("x")).select(F.concat("o", F.array("x")).alias("o"))
    label = F.array_join(F.transform("o", lambda i: F.get(F.array(*(F.lit(n) for n in names)), i)), "")
    steps = table.select(label.alias("filter_order"), "o", F.posexplode("o").alias("at", "filter"))
    before = F.aggregate(F.slice("o", F.lit(1), F.col("at")), F.lit(0), lambda a, i: a + F.get(F.array(*(F.lit(1 << j) for j in range(len(names)))), i))
    return steps.select("filter_order", (F.col("at") + 1).alias("step"), "filter", before.alias("before"))


def audited(rows: DataFrame, names: list[str]) -> DataFrame:
    """The audit of ``rows`` (part, id, salt, f0.. one boolean for each of ``names``, good, toxic): one row per part, order, step.

    ``salt`` tells rows of one part and id apart, so that many of them need not share a task.
    """
    k, spark = len(names), rows.sparkSession
    found = stored(posted(rows, names), "filter-sizes")
    totals = found.groupBy("part").agg(F.sum("n").alias("total"))
    # how many orders have exactly these filters before this one
    places = F.element_at(F.array(*(F.lit(math.factorial(i) * math.factorial(k - 1 - i)) for i in range(k))), F.bit_count("before") + 1)
    shapley = found.groupBy("part", "filter").agg(F.sum(F.col("removed") * places).alias("shapley"), F.max_by("removed", F.bit_count("before")).alias("unique_fails"))
    steps = found.drop("n").join(F.broadcast(orders(spark, names)), ["before", "filter"])
    gone = F.sum("removed").over(Window.partitionBy("part", "filter_order").orderBy("step"))
    return steps.join(shapley, ["part", "filter"]).join(totals, "part").select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), (F.col("total") - gone).alias("kept"), "removed", "redundant", "unique_fails",
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley",
    )


#: The five filters of the corpus, in their letters' order: condition on the text t, its words w and whether an earlier row has the same text.
FILTERS: dict[str, Callable[[], Column]] = {
    "A": lambda: F.col("n_words") < 50,
    "B": lambda: 100 * F.col("n_distinct") < 65 * F.col("n_words"),
    "C": lambda: 100 * F.col("n_capitals") > 5 * F.col("n_chars"),
    "D": lambda: F.col("has_symbol"),
    "E": lambda: F.col("copied"),
}


def measured(docs: DataFrame, id_column: str, text_column: str, part_column: str) -> DataFrame:
    """id, part, digest and the counts that the filters ask for, for each row of ``docs``."""
    raw = docs.select(
        column(docs, id_column).alias("id"), F.coalesce(column(docs, part_column).cast("string"), F.lit("")).alias("part"), text_or_empty(column(docs, text_column)).alias("t"),
    )
    return raw.select(
        "id", "part", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest"),
        let(word_array(F.col("t")), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d"))).alias("w"),
        F.regexp_count("t", F.lit("[A-Z]")).alias("n_capitals"), F.length("t").alias("n_chars"), F.col("t").rlike(r"[#$%&*|]").alias("has_symbol"),
    ).withColumns({"n_words": F.col("w.n").cast("long"), "n_distinct": F.col("w.d").cast("long")}).drop("w")


def failing(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """part, id, salt, f0.. (whether the row fails each of ``FILTERS``), good, toxic: the input of ``audited``.

    Equal texts are found by SHA-256 of the whole text. The smallest id of a digest is an aggregate of every task before
    anything moves, and rows meet it by id and digest together, so no group of copies lands in one task. A row without an
    id has no smaller id and copies nothing; equal rows of one id copy each other no more. Labels of one id that
    contradict each other count as good or toxic if any of them says so; ids without labels are neither.
    """
    table = stored(measured(docs, id_column, text_column, part_column).withColumn("salt", F.monotonically_increasing_id()), "filter-measures")
    named = table.filter("id is not null")
    first = named.groupBy("digest").agg(F.min("id").alias("id")).withColumn("is_first", F.lit(True))
    known = labels.select(column(labels, id_column).alias("id"), *(F.expr(when).alias(name) for name, when in LABELLED.items())).filter("id is not null")
    known = known.groupBy("id").agg(*(F.bool_or(name).alias(name) for name in LABELLED))
    marked = named.join(first, ["id", "digest"], "left").withColumn("copied", F.col("is_first").isNull()).join(known, "id", "left")
    nameless = table.filter("id is null").withColumns({"copied": F.lit(False)} | {name: F.lit(False) for name in LABELLED})
    flags = [condition().alias(f"f{i}") for i, condition in enumerate(FILTERS.values())]
    return marked.unionByName(nameless, allowMissingColumns=True).select("part", "id", "salt", *flags, *(F.coalesce(F.col(name), F.lit(False)).alias(name) for name in LABELLED))


def audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """One row for each part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null parts and empty ones are one part. A null text counts as empty: it has no words and fails A. Repeated rows count as
    often as they stand. Very long texts are read whole. No rows give no parts. Columns beyond the named ones are ignored,
    whatever they are called.
    """
    return audited(failing(docs, labels, **columns), list(FILTERS))
