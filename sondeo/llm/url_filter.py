"""URL verdicts from rules and from a tree of path templates per host.

Rules decide the pages they fit. The pages they decide, and pages with a label of their own, are the labels of the tree.
Paths are counted per host after runs of digits have become ``#``; from there on only distinct paths are worked on, which
are few where pages are many.
From the root down, a segment stays in its template if it is frequent under its node and its branch is labelled unlike
its siblings (a two-proportion test) or not labelled at all; all other segments become ``*``, so rare values are
generalised and branches that are statistically alike are merged. A template is rejected if its smoothed share of blocked
labels is high even at the lower end of its confidence interval: the number of labels counts, not how many of the
template's pages have one. Every level is an aggregation and a join by (host, template); hot hosts are pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondeo.llm.store import stored
from sondeo.llm.words import column

#: Verdict and host with path prefix.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

# Segments that a template spells out; all further ones are one ``**``.
LEVELS = 4
# A segment is frequent with so many pages and this share of its node.
LEAST_PAGES = 8
LEAST_SHARE = 0.01
# Two branches differ above this many standard errors, and a purity is trusted up to so many.
ERRORS = 2.576
# Weight of the overall share of blocked labels in the purity of a template, and the lower bound of purity that rejects it.
SMOOTHING = 4.0
REJECT = 0.8
# A host and shape with over one in this many pages is frequent; there are at most so many, and they are broadcast.
FREQUENT = 1024
# Page labels up to which they are broadcast.
BROADCAST_LABELS = 1_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    after = F.coalesce(after, F.lit(""))
    return F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path; of equally long ones the first named."""
    rule = verdict = None
    for action, text in sorted(rules, key=lambda r: -len(r[1])):
        at = text.index("/")
        host, path = text[:at], text[at:]
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, action) if verdict is None else verdict.when(fits, action)
    none = F.lit(None).cast("string")
    return (none if rule is None else rule), (none if verdict is None else verdict)


def branch_kept() -> Column:
    """Whether a child with n, labelled, blocked stays spelled out under a node with the same sums named node_*."""
    n1, n2 = F.col("labelled").cast("double"), (F.col("node_labelled") - F.col("labelled")).cast("double")
    b1, b2 = F.col("blocked").cast("double"), (F.col("node_blocked") - F.col("blocked")).cast("double")
    share = (b1 + b2) / (n1 + n2)
    # |b1 / n1 - b2 / n2| > ERRORS * standard error, squared and without division by n1 or n2
    unlike = F.pow(b1 * n2 - b2 * n1, F.lit(2.0)) > ERRORS * ERRORS * share * (1 - share) * (n1 + n2) * n1 * n2
    frequent = (F.col("n") >= LEAST_PAGES) & (F.col("n") >= LEAST_SHARE * F.col("node_n"))
    return frequent & F.when(n1 == 0, F.lit(True)).otherwise((n2 > 0) & unlike)


def templates(paths: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``paths`` (host, path, segments, n, labelled, blocked) with the template each path belongs to."""
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    table = paths.withColumn("template", F.lit(""))
    for level in range(levels):
        table = table.withColumn("segment", F.get("segments", F.lit(level)))
        children = table.filter(F.col("segment").isNotNull()).groupBy("host", "template", "segment").agg(*sums)
        nodes = children.groupBy("host", "template").agg(*(F.sum(c).alias(f"node_{c}") for c in ("n", "labelled", "blocked")))
        kept = children.join(nodes, ["host", "template"]).filter(branch_kept()).select("host", "template", "segment", F.lit(True).alias("spelled"))
        table = table.join(kept, ["host", "template", "segment"], "left")
        step = F.when(F.col("segment").isNull(), "").when(F.col("spelled"), F.concat(F.lit("/"), "segment")).otherwise("/*")
        table = stored(table.withColumn("template", F.concat("template", step)).drop("segment", "spelled"), "url-level")
    return table.withColumn("template", F.concat("template", F.when(F.size("segments") > levels, "/**").otherwise("")))


def least_purity(purity: Column, n: Column) -> Column:
    """The lower end of the Wilson interval of a share among ``n``, ERRORS standard errors wide to each side."""
    z2 = ERRORS * ERRORS
    spread = F.sqrt(purity * (1 - purity) / n + z2 / (4 * n * n))
    return (purity + z2 / (2 * n) - ERRORS * spread) / (1 + z2 / n)


def with_labels(parsed: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``parsed`` with ``label``, block or allow, of the pages whose id has one and not both; ``page_id`` may be null or repeat."""
    if labels is None:
        return parsed.withColumn("label", F.lit(None).cast("string"))
    found = labels.select(column(labels, "page_id").alias("_id"), column(labels, "verdict").alias("label")).filter(F.col("_id").isNotNull() & F.col("label").isin("block", "allow"))
    found = stored(found.groupBy("_id").agg(F.min("label").alias("label"), F.max("label").alias("last")).filter("label = last").drop("last"), "url-labels")
    if found.count() <= BROADCAST_LABELS:
        joined = parsed.join(F.broadcast(found), F.col("page_id") == F.col("_id"), "left")
    else:
        # pages without an id stay where they are
        joined = parsed.filter("page_id is not null").join(found, F.col("page_id") == F.col("_id"), "left").unionByName(parsed.filter("page_id is null"), allowMissingColumns=True)
    return stored(joined.drop("_id"), "url-labelled")


def judged(pages: DataFrame, rules=RULES, levels: int = LEVELS, id_column: str = "page_id", url_column: str = "url", labels: DataFrame | None = None) -> DataFrame:
    """One row for each row of ``pages``: page_id, host, path, rule, template, purity, verdict.

    ``labels`` (page_id, verdict: block or allow) are known verdicts of pages besides the rules. A rule that fits goes
    before the page's own label, and both before the template. Null ids, other verdicts and ids with both verdicts give none.

    A null url, or one without ``://``, has an empty host and path and belongs to the root template of the empty host.
    A template of which no page is labelled has the overall share of blocked labels as purity (0 without any label).
    Rows that repeat count as often as they stand; ids may be null or repeat. An empty table gives no rows. Segments after
    the first ``levels`` of a very long path are one ``**``.
    """
    host, path = host_and_path(column(pages, url_column))
    rule, verdict = fitting_rule(rules)
    parsed = pages.select(column(pages, id_column).alias("page_id"), host.alias("host"), path.alias("path")).withColumns({"rule": rule, "ruled": verdict})
    parsed = with_labels(parsed, labels).withColumn("ruled", F.coalesce("ruled", "label")).drop("label")
    shaped = parsed.withColumn("shape", F.regexp_replace("path", "[0-9]+", "#"))
    flag = F.col("ruled").isNotNull().cast("long")
    paths = shaped.groupBy("host", "shape").agg(F.count("*").alias("n"), F.sum(flag).alias("labelled"), F.sum(F.when(F.col("ruled") == "block", 1).otherwise(0)).alias("blocked"))
    segments = F.filter(F.split("shape", "/"), lambda s: s != "")
    table = stored(templates(stored(paths.withColumn("segments", segments), "url-paths"), levels), "url-templates")
    total = table.agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "blocked"))).first()
    overall = total["blocked"] / total["labelled"] if total["labelled"] else 0.0
    purity = (F.col("blocked") + F.lit(SMOOTHING * overall)) / (F.col("labelled") + F.lit(SMOOTHING))
    sums = table.groupBy("host", "template").agg(*(F.sum(c).alias(c) for c in ("labelled", "blocked"))).withColumn("purity", purity)
    bad = least_purity(F.col("purity"), F.col("labelled") + F.lit(SMOOTHING)) >= REJECT
    known = table.select("host", "template", "shape", "n").join(sums.select("host", "template", "purity", bad.alias("bad")), ["host", "template"])
    known = stored(known, "url-verdicts")
    frequent = F.broadcast(known.filter(F.col("n") * FREQUENT > total["n"]).drop("n")) if total["n"] else known.limit(0).drop("n")
    # the pages of a front page, or without a host, stay where they are; only the others are shuffled
    rest = shaped.join(frequent.select("host", "shape"), ["host", "shape"], "left_anti").join(known.drop("n"), ["host", "shape"])
    out = shaped.join(frequent, ["host", "shape"]).unionByName(rest)
    return out.select("page_id", "host", "path", "rule", "template", "purity", F.coalesce("ruled", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))
