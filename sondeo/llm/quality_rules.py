"""Quality rules with a robust multivariate test, with DataFrame functions only.

Every document gets a vector of transformed statistics. For each language and source, each language and all documents
together the centre and covariance of the least scattered three quarters of the documents are estimated (minimum
covariance determinant by concentration steps). The estimate of a language and source is mixed with that of its language, and that
with the one of all documents, in proportion to its number of documents, so a group may be of any size and no verdict turns on
a count. A document far from its mixed centre by Mahalanobis distance is rejected.

Statistics are whole numbers of 1/1024, so their sums and products are exact in 64 bits and do not depend on task
order. A concentration step is one aggregation by (group, distance bin): rows are summed in every task before they move,
whatever a group holds, and the bins up to the wanted share give the next centre and covariance. Covariances are arrays of
arrays, inverted by elimination steps in array functions, so plans stay short; nothing is collected.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondeo.llm.store import stored
from sondeo.llm.words import BLANK, WORD, column, text_or_empty

# Base rules.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
SYMBOL = "[#*$%&|<>]"
WINDOW_WORDS = 3

UNIT = 1024
#: Statistic and the standard deviation added to its spread, in its own units: differences below it mean nothing.
STATISTICS = {"symbols": 0.08, "repeats": 0.08, "capitals": 0.06, "word_length": 0.12, "marks": 0.15, "copied_lines": 0.08}
# Share of a group that the estimate rests on, its concentration steps, and the documents that the estimate of the group above counts for.
SHARE = 0.75
STEPS = 4
PRIOR_ROWS = 200
# Rejected above this squared distance. Text statistics have heavier tails than a normal distribution, so it is far out.
FAR = 80.0
# Groups up to which the estimates are broadcast: about 1 KB each. Above, only those of more than 1/HOT_SHARE of the rows are.
BROADCAST_GROUPS = 10_000
HOT_SHARE = 64
BIN_PER_LOG = 64


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def word_array(text: Column) -> Column:
    return F.filter(F.split(text, BLANK + "+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words inside windows of three words that stand in the text twice or more, each word once.

    Windows are compared by a 64-bit hash of their words; positions of equal windows meet in one sort.
    """
    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.least(F.lit(WINDOW_WORDS), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW_WORDS))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def places(pairs: Column) -> Column:
        twice = F.filter(pairs, lambda p, k: (F.get(pairs, k - 1)["g"] == p["g"]) | (F.get(pairs, k + 1)["g"] == p["g"]))
        return F.sort_array(F.transform(twice, lambda p: p["i"]))

    def of(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        found = let(let(pairs, places), covered)
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(found)

    grams = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW_WORDS), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(WINDOW_WORDS))))
    return F.when(F.size(words) < WINDOW_WORDS, F.lit(0)).otherwise(let(grams, of)).cast("long")


def measured(docs: DataFrame, text_column: str, lang_column: str, source_column: str, carry: list[str]) -> DataFrame:
    """row (struct of ``carry``), lang, source, the base counts, base_failed and z0.. in units of 1/1024."""
    raw = docs.select(
        F.struct(*(column(docs, c) for c in carry)).alias("row"), column(docs, lang_column).alias("lang"), column(docs, source_column).alias("source"),
        text_or_empty(column(docs, text_column)).alias("t"),
    )
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD))
    counted = raw.select(
        "row", "lang", "source",
        F.regexp_count("t", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit("[!?]")).alias("marks"), F.regexp_count("t", F.lit(r"\p{Lu}")).alias("capitals"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("again"))).alias("lines"),
        let(word_array(F.col("t")), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeated_words(w).alias("again"))).alias("words"),
    ).withColumn("word_chars", F.col("words.chars"))
    n, chars = F.greatest(F.col("words.n"), F.lit(1)), F.greatest("word_chars", F.lit(1))
    values = {
        "symbols": F.log1p(4 * F.col("n_symbols") / n), "repeats": F.col("words.again") / n, "capitals": F.col("capitals") / chars,
        "word_length": F.log(chars / n), "marks": F.log1p(4 * F.col("marks") / n),
        "copied_lines": F.col("lines.again") / F.greatest(F.col("lines.n"), F.lit(1)),
    }
    return counted.select(
        "row", "lang", "source", F.col("words.n").alias("n_words"), "word_chars", "n_symbols", F.col("lines.again").cast("long").alias("n_dup_lines"),
        F.col("words.again").alias("n_repeat_words"),
        ((F.col("words.n") < LEAST_WORDS) | (100 * F.col("words.again") > MOST_REPEATED_PERCENT * F.col("words.n"))).alias("base_failed"),
        *(F.round(values[s] * UNIT).cast("long").alias(f"z{i}") for i, s in enumerate(STATISTICS)),
    )


def inner_share(dims: int, share: float) -> float:
    """What the variance of the inner ``share`` of a normal cloud must be multiplied by."""
    def below(x: float, k: int) -> float:  # chi-square distribution function by its series
        term = total = math.exp((k / 2) * math.log(x / 2) - x / 2 - math.lgamma(k / 2 + 1))
        for j in range(1, 200):
            term *= x / (k + 2 * j)
            total += term
        return total
    low, high = 1e-9, 200.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle, dims) < share else (low, middle)
    return share / below(low, dims + 2)


def inverse(matrix: Column, p: int) -> Column:
    """The inverse of a positive definite matrix, an array of rows, by elimination without row exchanges; its rows end to end."""
    def step(m: Column, k: Column) -> Column:
        def cleared(pivot: Column) -> Column:
            return F.transform(m, lambda row, i: F.when(i == k, pivot).otherwise(F.zip_with(row, pivot, lambda x, y: x - F.get(row, k) * y)))

        return let(F.transform(F.get(m, k), lambda x: x / F.get(F.get(m, k), k)), cleared)

    units = F.array(*(F.array(*(F.lit(float(i == j)) for j in range(p))) for i in range(p)))
    both = F.zip_with(matrix, units, lambda row, unit: F.concat(row, unit))
    return F.flatten(F.transform(F.aggregate(F.sequence(F.lit(0), F.lit(p - 1)), both, step), lambda row: F.slice(row, p + 1, p)))


def with_distance(rows: DataFrame, p: int) -> DataFrame:
    """``rows`` with ``distance``, the squared Mahalanobis distance of z0.. from the centre m under the inverse covariance v; null without one.

    Elements are added one by one in compiled code: every row passes here once for each level and step.
    """
    off = rows.withColumns({f"_d{i}": F.col(f"z{i}") / float(UNIT) - F.get("m", F.lit(i)) for i in range(p)})
    d = [F.col(f"_d{i}") for i in range(p)]
    terms = (d[i] * reduce(add, ((1.0 if i == j else 2.0) * F.get("v", F.lit(p * i + j)) * d[j] for j in range(i + 1))) for i in range(p))
    square = reduce(add, terms)
    return off.withColumn("distance", F.when(square < 0, 0.0).otherwise(square)).drop(*(f"_d{i}" for i in range(p)))


def joined(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Rows with the estimate of their group (column ``group``), those without one too."""
    if estimates.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(estimates), "group", "left")
    every = estimates.agg(F.max("n")).first()[0]
    hot = F.broadcast(estimates.filter(F.col("n") > every / HOT_SHARE))  # at most HOT_SHARE groups of each of three levels
    return rows.join(hot, "group").unionByName(rows.join(hot.select("group"), "group", "left_anti").join(estimates, "group", "left"))


def concentrated(rows: DataFrame, p: int) -> DataFrame:
    """group, n, m (centre), c (covariance): the minimum covariance determinant estimate of every group of ``rows``."""
    floor, widen = [s * s for s in STATISTICS.values()], inner_share(p, SHARE)
    middle = rows.groupBy("group").agg(F.count("*").alias("n"), *(F.percentile(f"z{i}", F.lit(0.5)).alias(f"m{i}") for i in range(p)))
    off = joined(rows, stored(middle, "mcd-median")).groupBy("group").agg(
        F.first("n").alias("n"), *(F.first(f"m{i}").alias(f"m{i}") for i in range(p)),
        *(F.percentile(F.abs(F.col(f"z{i}") - F.col(f"m{i}")), F.lit(0.5)).alias(f"s{i}") for i in range(p)),
    )

    def estimated(table: DataFrame, centre: list[Column], covariance: list[list[Column]]) -> DataFrame:
        c = F.array(*(F.array(*row) for row in covariance))
        whole = table.select("group", "n", F.array(*centre).alias("m"), c.alias("c"))
        return stored(whole.withColumn("v", inverse(F.col("c"), p)), "mcd")

    spread = [F.pow(F.col(f"s{i}") * 1.4826 / float(UNIT), F.lit(2.0)) + floor[i] for i in range(p)]
    estimate = estimated(off, [F.col(f"m{i}") / float(UNIT) for i in range(p)], [[spread[i] if i == j else F.lit(0.0) for j in range(p)] for i in range(p)])
    for _ in range(STEPS):
        near = with_distance(joined(rows, estimate.drop("c")), p).withColumn("bin", F.floor(BIN_PER_LOG * F.log1p("distance")))
        sums = near.groupBy("group", "bin").agg(
            F.count("*").alias("k"), F.first("n").alias("n"), *(F.sum(f"z{i}").alias(f"a{i}") for i in range(p)),
            *(F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"b{i}_{j}") for i in range(p) for j in range(i + 1)),
        )
        inner = sums.withColumn("before", F.sum("k").over(Window.partitionBy("group").orderBy("bin")) - F.col("k")).filter(F.col("before") < F.col("n") * SHARE)
        # whole numbers beyond 64 bits add up as decimals
        exact = inner.groupBy("group").agg(
            F.first("n").alias("n"), F.sum("k").cast("double").alias("k"),
            *(F.sum(F.col(c).cast("decimal(38,0)")).cast("double").alias(c) for c in sums.columns if c[0] in "ab" and c != "bin"),
        )
        mean = [F.col(f"a{i}") / F.col("k") / float(UNIT) for i in range(p)]
        square = lambda i, j: F.col(f"b{max(i, j)}_{min(i, j)}") / F.col("k") / float(UNIT * UNIT)
        estimate = estimated(exact, mean, [[widen * (square(i, j) - mean[i] * mean[j]) + (floor[i] if i == j else 0.0) for j in range(p)] for i in range(p)])
    return estimate.drop("v")


def mixed(groups: DataFrame, above: DataFrame, p: int, prior: int) -> DataFrame:
    """``groups`` (group, parent, n, m, c), each mixed with its parent's row in ``above`` as if that stood for ``prior`` more documents."""
    side = above.select(F.col("group").alias("parent"), F.col("m").alias("pm"), F.col("c").alias("pc"))
    both = groups.join(side, "parent").withColumn("w", F.col("n") / (F.col("n") + prior))
    own, other = F.col("w"), 1 - F.col("w")
    m = F.zip_with("m", "pm", lambda x, y: own * x + other * y)
    # the covariance of a mixture: those of both, and the distance of their centres
    off = F.zip_with("m", "pm", lambda x, y: x - y)
    between = F.transform(off, lambda x: F.transform(off, lambda y: x * y * own * other))
    within = F.zip_with("c", "pc", lambda a, b: F.zip_with(a, b, lambda x, y: own * x + other * y))
    c = F.zip_with(within, between, lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    # under new names first: within one projection, "m" inside a lambda could be taken for the column made beside it
    return both.withColumns({"mixed_m": m, "mixed_c": c}).select("group", "n", F.col("mixed_m").alias("m"), F.col("mixed_c").alias("c"))


def annotated(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", source_column: str = "source", carry: list[str] | None = None, prior: int = PRIOR_ROWS, far: float = FAR) -> DataFrame:
    """One row for each row of ``docs``: ``row`` (struct of ``carry``, all columns by default), the base counts, distance, kept.

    base_failed: fewer than 50 words, or over half of them in repeated three-word windows. Only documents that pass the
    base rules are used for estimates. The estimate of a language and source (null is a value of its own) with n of them has weight
    n / (n + ``prior``) against that of its language, and that one likewise against the one of all documents. Where no
    document of a language and source passes, the distance is null. A null text counts as empty and fails. Repeated rows
    count as often as they stand. Very long texts are read whole. An empty table gives no rows. Columns of ``docs`` come
    back inside ``row`` only, so their names clash with none.
    """
    p = len(STATISTICS)
    keyed = measured(docs, text_column, lang_column, source_column, docs.columns if carry is None else carry)
    keyed = keyed.withColumns({"language": F.concat(F.lit("1"), F.to_json(F.struct("lang"))), "group": F.concat(F.lit("2"), F.to_json(F.struct("lang", "source")))})
    table = stored(keyed, "quality-statistics")
    passed = table.filter(~F.col("base_failed"))
    levels = F.array(F.lit("0"), "language", "group")
    found = concentrated(passed.select(F.explode(levels).alias("group"), *(f"z{i}" for i in range(p))), p)
    parents = passed.select("language", "group").distinct()
    languages = found.join(parents.select(F.col("language").alias("group")).distinct(), "group").withColumn("parent", F.lit("0"))
    sources = found.join(parents.withColumnRenamed("language", "parent"), "group")
    estimate = mixed(sources, mixed(languages, found.filter("group = '0'"), p, prior), p, prior)
    estimate = stored(estimate.withColumn("v", inverse(F.col("c"), p)).drop("c"), "mcd-mixed")
    judged = with_distance(joined(table, estimate), p)
    return judged.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
        (~F.col("base_failed") & ~F.coalesce(F.col("distance") > far, F.lit(False))).alias("kept"),
    )


def kept_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they came."""
    return annotated(docs, **options).filter("kept").select("row.*")
