"""Near duplicates: similarity self-join on sets of word n-grams by prefix filtering, and the components of its links.

Two sets with Jaccard similarity of at least 3/4 share a member among the first quarter (and one) of either, in any order
that all sets keep. The order here is rare first: frequent members come last, by the number of documents that have them,
all others first, by hash. Steps:

1. One pass over all documents counts set sizes and, in every task, the members that repeat there (lossy counting: a
   count may miss one document for each task). The most frequent ones, a bounded number, make the order. Documents with
   equal sets are linked to the smallest id among them. A second pass emits the prefix of all others; members of a
   single document drop out.
2. The rest is small. Per member, the document in whose order it comes first leads, which is the one with the fewest rare
   members; every other document is paired with its leaders, filtered by length, position and class counts (suffix
   filter), and verified once by its whole set.
3. Links make components. Members of two documents, or whose documents are now all in one component, are done; for the others, leaders are
   compared and set aside until the pairs left between components are few for the size of the table, and these are
   compared as well, in cells of bounded size: the documents outside the largest component of a member with all of
   them. So every link between components is found, while a group of copies costs a few pairs for each.

Members so frequent that a third of the documents may share them are salted before they are shuffled.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondeo.llm.arrow import mapped
from sondeo.llm.components import BROADCAST_IDS, beside, components
from sondeo.llm.store import stored
from sondeo.llm.words import WordHashes, column, text_or_empty, window_hashes

WORDS = 5
LEAST = Fraction(3, 4)
# Frequent members that the order tells apart, 16 bytes each in every task, and members counted at a time in a task.
FREQUENT = 1 << 20
COUNTED = 1 << 22
# Members of a set for each class of its suffix filter, about: what two unrelated sets share by class falls well below the limit.
CLASS_MEMBERS = 2
# A member of more than 1/HOT_SHARE of the documents is spread over so many salts.
HOT_SHARE = 32
SALTS = 64
# Pairs between components, for each prefix row, that are compared without another round of leaders.
PAIRS_PER_ROW = 500
ROUNDS = 8
# Rows of either side of a cell of the closing comparison, on average.
CELL_ROWS = 1024


def shingles(hashes: WordHashes, data: bytes, words: int) -> np.ndarray:
    """The sorted hashes of the distinct n-grams of a lower-cased text; with fewer words, of the whole sequence."""
    found = data.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(hashes.of(found), min(words, len(found))))


def least_part(size: Column, least: Fraction = LEAST) -> Column:
    """ceil(least * size)"""
    return F.ceil(size * least.numerator / F.lit(least.denominator))


def needed(a: Column, b: Column, least: Fraction = LEAST) -> Column:
    """The smallest intersection of sets of these sizes that are similar enough."""
    return F.ceil((a + b) * least.numerator / F.lit(least.numerator + least.denominator))


def counted(source: DataFrame, id_type: str, words: int) -> DataFrame:
    """id, n_shingles, a 128-bit hash of the set and class counts of each row; in rows of their own, members that repeat in a task and how often."""
    def make():
        hashes, held = WordHashes(), []

        def repeated() -> dict:
            values, n = np.unique(np.concatenate([np.empty(0, np.uint64), *held]), return_counts=True)
            held.clear()
            return {"members": values[n > 1].view(np.int64), "documents": n[n > 1]}

        def work(batch: pa.RecordBatch) -> dict:
            found = [shingles(hashes, data, words) for data in batch.column("t").to_pylist()]
            held.append(np.concatenate([np.empty(0, np.uint64), *found]))
            more = [repeated()] if sum(map(len, held)) >= COUNTED else []
            suffix = [class_counts(grams) for grams in found]
            none = [None] * len(more)
            return {
                "id": pa.concat_arrays([batch.column("id"), pa.nulls(len(more), batch.schema.field("id").type)]),
                "n_shingles": [len(grams) for grams in found] + none, "set_hash": [hash_of(grams) if len(grams) else None for grams in found] + none,
                "suffix": suffix + none, "often": [None] * len(found) + more,
            }

        work.last = lambda: {"id": [None], "n_shingles": [None], "set_hash": [None], "suffix": [None], "often": [repeated()]}
        return work

    return mapped(source, make, f"id {id_type}, n_shingles long, set_hash binary, suffix array<int>, often struct<members:array<long>,documents:array<long>>")


def class_counts(grams: np.ndarray) -> np.ndarray:
    """Members by their first bits, in a power of two of classes that grows with the set."""
    bits = (len(grams) // CLASS_MEMBERS).bit_length()
    return np.bincount((grams >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams), np.int64), minlength=1 << bits)


def most_common(x: Column, y: Column) -> Column:
    """The most members that sets with these class counts can share; null if one has over twice the classes of the other."""
    halved = lambda c: F.transform(F.sequence(F.lit(0), (F.size(c) / 2).cast("int") - 1), lambda i: F.get(c, 2 * i) + F.get(c, 2 * i + 1))
    least = lambda a, b: F.aggregate(F.zip_with(a, b, lambda m, n: F.least(m, n)), F.lit(0), lambda s, n: s + n)
    return F.when(F.size(x) == F.size(y), least(x, y)).when(F.size(x) == 2 * F.size(y), least(halved(x), y)).when(2 * F.size(x) == F.size(y), least(x, halved(y)))


def frequent(first: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The hashes, sorted, of at most FREQUENT of the most frequent members, and the documents counted for each."""
    pairs = first.filter("often is not null").select(F.explode(F.arrays_zip("often.members", "often.documents")).alias("x"))
    sums = stored(pairs.groupBy(F.col("x.members").alias("member")).agg(F.sum("x.documents").alias("n")), "frequent-members")
    # how many members there are of each count below a bound, to find the least count that keeps the table small
    heights = sorted(((r["k"], r["c"]) for r in sums.groupBy(F.floor(F.log2("n") * 64).alias("k")).agg(F.count("*").alias("c")).collect()), reverse=True)
    least, total = None, 0
    for k, c in heights:
        total += c
        if total > FREQUENT:
            break
        least = k
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    table = sums.filter(F.floor(F.log2("n") * 64) >= least).toArrow()
    members = np.asarray(table.column("member").to_numpy(), np.int64).view(np.uint64)
    order = np.argsort(members)
    return members[order], np.asarray(table.column("n").to_numpy(), np.int64)[order]


def equal_sets(sizes: DataFrame, hot: int) -> DataFrame:
    """(a, b): ids and the smallest id with an equal set. An id that stands with several sets is left to the join.

    The heads of groups of more than ``hot`` rows are few and go to the rows; only the others' rows are shuffled.
    """
    known = sizes.filter("id is not null and set_hash is not null").select("id", "set_hash")
    heads = known.groupBy("set_hash").agg(F.min("id").alias("head"), F.max("id").alias("last"), F.count("*").alias("rows")).filter("head < last").drop("last")
    heads = stored(heads, "equal-heads")
    large = F.broadcast(heads.filter(F.col("rows") > hot))
    headed = known.join(large, "set_hash").unionByName(known.join(large.select("set_hash"), "set_hash", "left_anti").join(heads, "set_hash"))
    several = known.groupBy("id").agg(F.min("set_hash").alias("low"), F.max("set_hash").alias("high")).filter("low <> high").select("id")
    copies = headed.filter("id <> head").join(several, "id", "left_anti")
    return stored(copies.select(F.col("id").alias("a"), F.col("head").alias("b")).distinct(), "equal-sets")


def looked_up(values: np.ndarray, often: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The documents counted for each of ``values``, 0 for those that are not frequent."""
    members, documents = often
    if not len(members):
        return np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(members, values), len(members) - 1)
    return np.where(members[at] == values, documents[at], 0)


def prefixes(source: DataFrame, id_type: str, words: int, often, hot: int, least: Fraction) -> DataFrame:
    """member, salt, id, size, place of every prefix member; or copy_of, the id of an equal set in the same task."""
    def make():
        hashes, seen = WordHashes(), {}

        def work(batch: pa.RecordBatch) -> dict:
            member, salt, row, size, place, copies, copy_of = [], [], [], [], [], [], []
            ids = batch.column("id").to_pylist()
            for i, data in enumerate(batch.column("t").to_pylist()):
                if ids[i] is None:
                    continue
                grams = shingles(hashes, data, words)
                n = len(grams)
                if not n:
                    continue
                first = seen.setdefault(hash_of(grams), ids[i])
                if first != ids[i]:
                    copies.append(i), copy_of.append(first)
                    continue
                documents = looked_up(grams, often.value)
                length = n - -(-n * least.numerator // least.denominator) + 1
                order = np.lexsort((grams, documents))[:length]
                member.append(grams[order]), size.append(np.full(length, n)), place.append(np.arange(length)), row.append(np.full(length, i))
                salt.append(np.where(documents[order] > hot, spread(ids[i]) % SALTS, -1))
            def joined(parts, kind):
                return np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
            rows = np.concatenate([joined(row, np.int64), np.array(copies, np.int64)])
            none = [None] * len(copies)
            own = np.array([spread(ids[i]) for i in copies], np.int64)  # rows of copies go anywhere, not to one task
            return {
                "member": pa.concat_arrays([pa.array(joined(member, np.uint64).view(np.int64)), pa.array(own)]),
                "salt": pa.concat_arrays([pa.array(joined(salt, np.int32)), pa.array(none, pa.int32())]),
                "id": batch.column("id").take(pa.array(rows)),
                "size": pa.concat_arrays([pa.array(joined(size, np.int64)), pa.array(none, pa.int64())]),
                "place": pa.concat_arrays([pa.array(joined(place, np.int32)), pa.array(none, pa.int32())]),
                "copy_of": pa.concat_arrays([pa.nulls(len(rows) - len(copies), batch.schema.field("id").type), pa.array(copy_of, batch.schema.field("id").type)]),
            }

        return work

    return mapped(source, make, f"member long, salt int, id {id_type}, size long, place int, copy_of {id_type}")


def hash_of(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def spread(key) -> int:
    return xxhash.xxh3_64_intdigest(str(key)) >> 1


def sets(source: DataFrame, id_type: str, words: int) -> DataFrame:
    """id and members, the whole set as an array of 64-bit hashes."""
    def make():
        hashes = WordHashes()

        def work(batch: pa.RecordBatch) -> dict:
            found = [shingles(hashes, data, words).view(np.int64) for data in batch.column("t").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])])
            values = pa.array(np.concatenate([np.empty(0, np.int64), *found]))
            return {"id": batch.column("id"), "members": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)}

        return work

    return mapped(source.select("id", "t"), make, f"id {id_type}, members array<long>")


def candidates(rows: DataFrame, others: DataFrame, shared, least: Fraction) -> DataFrame:
    """Distinct (a, b) of ``rows`` and ``others`` (columns with a leading o_) that share a member and pass the filters.

    Length: neither set is too small for the other. Position: nothing in common stands before the first shared member,
    so it must come early enough in both orders for the rest to suffice, at sizes closer than the limit much earlier
    than in the prefix of either alone.
    """
    need = needed(F.col("size"), F.col("o_size"), least)
    fits = (
        (F.least("size", "o_size") >= least_part(F.greatest("size", "o_size"), least))
        & (F.col("size") - F.col("place") >= need) & (F.col("o_size") - F.col("o_place") >= need)
    )
    pairs = rows.join(others, shared & fits).select(F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b"))
    return pairs.distinct()


def verified(pairs: DataFrame, sizes: DataFrame, source: DataFrame, id_type: str, words: int, least: Fraction) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough; the suffix filter spares most others the comparison."""
    pairs = stored(pairs, "candidate-pairs")
    met = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sizes = sizes.join(F.broadcast(met) if met.count() <= BROADCAST_IDS else met, "id", "left_semi")
    left = sizes.select(F.col("id").alias("a"), F.col("n_shingles").alias("a_size"), F.col("suffix").alias("a_suffix"))
    right = sizes.select(F.col("id").alias("b"), F.col("n_shingles").alias("b_size"), F.col("suffix").alias("b_suffix"))
    most = F.coalesce(most_common(F.col("a_suffix"), F.col("b_suffix")), F.greatest("a_size", "b_size"))
    likely = pairs.join(left, "a").join(right, "b").filter(most >= needed(F.col("a_size"), F.col("b_size"), least)).select("a", "b").distinct()
    likely = stored(likely, "likely-pairs")
    ids = stored(likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))).distinct(), "likely-ids")
    texts, _ = beside(source, ids, "id", whole=False)
    found = stored(sets(texts, id_type, words), "shingle-sets")
    one = likely.join(found.select(F.col("id").alias("a"), F.col("members").alias("x")), "a")
    two = one.join(found.select(F.col("id").alias("b"), F.col("members").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return stored(two.withColumn("common", common).filter(F.col("common") >= needed(F.size("x"), F.size("y"), least)).select("a", "b"), "verified-links")


def spots_of(active: DataFrame) -> DataFrame:
    """member, n, pairs between components, big (its largest component) and out (rows outside of that) of ``active``."""
    sums = active.groupBy("member", "label").agg(F.count("*").alias("n")).groupBy("member").agg(
        F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("same"), F.max(F.struct("n", "label")).alias("most"),
    )
    pairs = (F.col("n").cast("double") * F.col("n") - F.col("same")) / 2
    return stored(sums.select("member", "n", pairs.alias("pairs"), F.col("most.label").alias("big"), (F.col("n") - F.col("most.n")).alias("out")), "open-members")


def cells(active: DataFrame, spots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows of ``active``, and those outside the largest component of their member with a leading o_, by (member, block, slice).

    The rows outside are dealt into blocks, all rows into slices, and each block meets each slice in one cell. Rows
    outside against all are at most three times the pairs between components.
    """
    side = F.broadcast(spots) if spots.count() <= BROADCAST_IDS // 4 else spots
    parts = lambda n: F.ceil(F.col(n) / CELL_ROWS)
    dealt = active.join(side, "member").withColumns({"blocks": parts("out"), "slices": parts("n"), "at": F.xxhash64(F.monotonically_increasing_id())})
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    names = ("member", "id", "size", "place", "label")
    rows = dealt.withColumn("slice", F.pmod("at", "slices")).select(*names, "big", "slice", every("blocks").alias("block"))
    outside = dealt.filter(F.col("label") != F.col("big")).withColumn("block", F.pmod("at", "blocks")).select(*names, "block", every("slices").alias("slice"))
    return rows, outside.select(*(F.col(c).alias(f"o_{c}") for c in (*names, "block", "slice")))


def linked(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, least: Fraction = LEAST) -> tuple[DataFrame, DataFrame]:
    """(id, n_shingles) of every row of ``docs``, and (node, component) of every id that is linked to another.

    A text with fewer than ``words`` words has its whole sequence as one n-gram; without words or null, its set is empty
    and linked with nothing. Rows with the same id are one node; a null id links nothing. n-grams are compared by a
    64-bit hash. An empty table gives two empty tables.
    """
    id_type = docs.schema[id_column].dataType.simpleString()
    source = docs.select(column(docs, id_column).alias("id"), text_or_empty(column(docs, text_column)).cast("binary").alias("t"))
    first = stored(counted(source, id_type, words), "shingle-counts")
    sizes = first.filter("n_shingles is not null")
    often = docs.sparkSession.sparkContext.broadcast(frequent(first))  # at most FREQUENT entries
    hot = max(100, sizes.count() // HOT_SHARE)

    equal = equal_sets(sizes, hot)
    gone = equal.select(F.col("a").alias("id"))
    # if they are too many to be broadcast, copies take part in the join like any other documents
    single = source.join(F.broadcast(gone), "id", "left_anti") if gone.count() <= BROADCAST_IDS else source
    emitted = prefixes(single, id_type, words, often, hot, least)
    whole = Window.partitionBy("member", "salt")
    spread = emitted.repartition("member", "salt").withColumns({"lowest": F.min("id").over(whole), "highest": F.max("id").over(whole), "n": F.count("*").over(whole)})
    spread = spread.filter((F.col("lowest") < F.col("highest")) | (F.col("salt") >= 0) | F.col("copy_of").isNotNull())
    kept = stored(spread.withColumn("many", (F.col("salt") >= 0) | (F.col("n") > 2)).drop("lowest", "highest", "salt", "n"), "prefix-rows")
    often.destroy()
    links = equal.unionByName(kept.filter("copy_of is not null").select(F.col("id").alias("a"), F.col("copy_of").alias("b")))
    rows = kept.filter("copy_of is null").drop("copy_of")
    total = rows.count()

    def led(active: DataFrame) -> DataFrame:
        lead = active.groupBy(F.col("member").alias("o_member")).agg(F.min(F.struct("place", "id", "size", "label")).alias("lead"))
        return stored(lead.select("o_member", *(F.col(f"lead.{c}").alias(f"o_{c}") for c in ("id", "size", "place", "label"))), "leaders")

    shared = (F.col("member") == F.col("o_member")) & (F.col("label") != F.col("o_label"))
    active = rows.withColumn("label", F.col("id"))
    lead = led(active)
    links = links.unionByName(verified(candidates(active, lead, shared, least), sizes, source, id_type, words, least))
    # of a member's two rows, one led the other: no pair is left to compare
    rows = rows.filter("many").drop("many")
    for turn in range(1, ROUNDS + 1):
        labels = components(links)
        active = rows.join(labels, F.col("id") == F.col("node"), "left").withColumn("label", F.coalesce("component", "id")).drop("node", "component")
        unsettled = active.groupBy("member").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("member")
        # a leader has met all documents of its member
        past = lead.select("o_member", "o_id")
        active = active.join(unsettled, "member", "left_semi").join(past, (F.col("member") == F.col("o_member")) & (F.col("id") == F.col("o_id")), "left_anti")
        active = stored(active, "prefix-open")
        spots = spots_of(active)
        open_pairs = spots.agg(F.sum("pairs")).first()[0] or 0
        if not open_pairs:
            return sizes.select("id", "n_shingles"), labels
        if turn == ROUNDS or open_pairs <= PAIRS_PER_ROW * total:
            every, outside = cells(active, spots.filter("pairs > 0"))
            cell = (F.col("block") == F.col("o_block")) & (F.col("slice") == F.col("o_slice"))
            # two rows outside meet in both roles
            pairs = candidates(every, outside, shared & cell & ((F.col("label") == F.col("big")) | (F.col("id") < F.col("o_id"))), least)
            links = links.unionByName(verified(pairs, sizes, source, id_type, words, least))
            break
        lead = led(active)
        links = links.unionByName(verified(candidates(active, lead, shared, least), sizes, source, id_type, words, least))
        rows = active.drop("label")
    return sizes.select("id", "n_shingles"), components(links)


def annotated(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id (the smallest id reachable by links)."""
    sizes, labels = linked(docs, **options)
    out = sizes.join(labels, F.col("id") == F.col("node"), "left")
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component", "id").alias("component_id"))


def kept_rows(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component; rows without a link stay. Columns as they came."""
    _, labels = linked(docs, id_column=id_column, **options)
    gone = labels.filter("node <> component").select(F.col("node").alias("_gone"))
    side = F.broadcast(gone) if gone.count() <= 2_000_000 else gone
    return docs.join(side, column(docs, id_column) == gone["_gone"], "left_anti")
