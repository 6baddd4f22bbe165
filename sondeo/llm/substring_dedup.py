"""Repeated passages: fixed-block anchors, and removal of every later copy of a window of words.

A document is a reference by its blocks, non-overlapping runs of ``block`` words from its first word on; it is probed by
the rolling windows of the same length at every word. A passage of ``window`` words holds at least k whole blocks of the
reference, whatever its place there, and the probe at the same words is equal to each of them. Of any k consecutive
blocks only the one with the smallest hash is indexed, and of any k rolling windows one block apart only that one is
probed: both sides choose the same words, so no passage is missed, and far fewer rows are shuffled.

Hits only say where to look. Around them, hits are extended: every whole window that contains a hit is compared by its
own hash with the windows of all other documents found this way, and consecutive equal windows make up the maximal
repeat. A window that also starts in a document with a smaller id is covered and removed.

Passages that very many documents hold are recognised in a bounded sample. They are never shuffled: their anchors count
as hits at once, and the smallest document of their windows is gathered in pre-aggregated rows, at most one for each
listed window and task. The sample decides the route only, never the answer.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondeo.llm.arrow import mapped
from sondeo.llm.components import beside
from sondeo.llm.store import stored
from sondeo.llm.words import WordHashes, column, text_or_empty, window_hashes

WINDOW = 50
BLOCK = 6
# Documents looked at for very frequent passages, the share of them that makes one, and the most that are listed.
SAMPLE = 2_000
HOT_SHARE = 256
MOST_HOT = 50_000

_REFERENCE, _SURE, _LOWEST = 1, 2, 4


def blocks_held(window: int, block: int) -> int:
    """Whole blocks that any ``window`` words of a reference hold."""
    return (window + 1) // block - 1


def anchors(hashes: np.ndarray, window: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, indexed) of the chosen rolling windows of a document; ``indexed``: it is a chosen block as well."""
    k, rolled = blocks_held(window, block), window_hashes(hashes, block)
    starts = len(rolled) - (k - 1) * block
    if len(hashes) < window or starts <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool)
    runs = np.stack([rolled[j * block : j * block + starts] for j in range(k)])
    chosen = np.arange(starts) + block * runs.argmin(axis=0)
    places = np.unique(chosen)
    indexed = np.zeros(len(rolled), bool)
    indexed[chosen[::block]] = True
    return rolled[places], places, indexed[places]


def listed(values: np.ndarray, names: np.ndarray) -> np.ndarray:
    if not len(names):
        return np.zeros(len(values), bool)
    return names[np.minimum(np.searchsorted(names, values), len(names) - 1)] == values


def around(places: np.ndarray, n: int, window: int, block: int) -> np.ndarray:
    """Starts of the windows of a text of ``n`` words that contain one of the blocks at ``places``."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, np.maximum(places - (window - block), 0), 1)
    np.add.at(cover, np.minimum(places + 1, n), -1)
    return np.flatnonzero(np.cumsum(cover)[: n - window + 1])


def key_for(seed: str, value) -> int:
    return xxhash.xxh3_64_intdigest(f"{seed}:{value}")


def hot_passages(source: DataFrame, window: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent anchor hashes and window hashes, from at most about ``SAMPLE`` documents."""
    total = source.count()
    sampled = source.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, total // SAMPLE))) == 0)

    def make():
        words = WordHashes()

        def work(batch: pa.RecordBatch) -> dict:
            a, w = [], []
            for data in batch.column("t").to_pylist():
                h = words.of(data.split())
                a.append(np.unique(anchors(h, window, block)[0])), w.append(np.unique(window_hashes(h, window)))
            one, two = ((np.unique(np.concatenate([np.empty(0, np.uint64), *parts]), return_counts=True)) for parts in (a, w))
            return {"kind": [0] * len(one[0]) + [1] * len(two[0]), "hash": np.concatenate([one[0], two[0]]).view(np.int64), "n": np.concatenate([one[1], two[1]])}

        return work

    least = max(8, min(total, SAMPLE) // HOT_SHARE)
    found = mapped(sampled, make, "kind int, hash long, n long").groupBy("kind", "hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    rows = found.orderBy(F.col("n").desc(), "hash").limit(2 * MOST_HOT).collect()
    pick = lambda kind: np.sort(np.array([r["hash"] for r in rows if r["kind"] == kind], np.int64).view(np.uint64))
    return pick(0), pick(1)


def occurrences(source: DataFrame, id_type: str, hot: tuple[np.ndarray, np.ndarray], window: int, block: int) -> DataFrame:
    """hash, id, place, flags: the chosen anchors, a row for a document with a frequent one, and lowest ids of frequent windows."""
    hot_anchors, hot_windows = hot

    def make():
        words = WordHashes()

        def work(batch: pa.RecordBatch) -> dict:
            ids = batch.column("id").to_pylist()
            hashes, rows, places, flags = [], [], [], []
            lowest: dict[int, int] = {}
            for i, data in enumerate(batch.column("t").to_pylist()):
                if ids[i] is None:
                    continue
                h = words.of(data.split())
                values, at, indexed = anchors(h, window, block)
                if not len(values):
                    continue
                often = listed(values, hot_anchors)
                if often.any():
                    values, at, indexed = values[~often], at[~often], indexed[~often]
                    hashes.append(np.array([key_for("sure", ids[i])], np.uint64)), places.append(np.array([-1])), flags.append(np.array([_SURE])), rows.append(np.array([i]))
                if len(hot_windows):
                    whole = window_hashes(h, window)
                    for v in np.unique(whole[listed(whole, hot_windows)]).tolist():
                        if v not in lowest or ids[i] < ids[lowest[v]]:
                            lowest[v] = i
                hashes.append(values), places.append(at), flags.append(indexed * _REFERENCE), rows.append(np.full(len(at), i))
            if lowest:
                hashes.append(np.array(list(lowest), np.uint64)), rows.append(np.array(list(lowest.values())))
                places.append(np.full(len(lowest), -1)), flags.append(np.full(len(lowest), _LOWEST))
            join = lambda parts, kind: np.concatenate([np.empty(0, kind), *parts]).astype(kind)
            return {"hash": join(hashes, np.uint64).view(np.int64), "id": batch.column("id").take(pa.array(join(rows, np.int64))), "place": join(places, np.int32), "flags": join(flags, np.int32)}

        return work

    return mapped(source, make, f"hash long, id {id_type}, place int, flags int")


def windows_near(source: DataFrame, id_type: str, hot: tuple[np.ndarray, np.ndarray], lowest: dict[int, object], window: int, block: int) -> DataFrame:
    """hash, id, place, sure: the windows around hits; ``sure``: a frequent one that also starts in a smaller document."""
    hot_anchors, hot_windows = hot

    def make():
        words = WordHashes()

        def work(batch: pa.RecordBatch) -> dict:
            hashes, rows, places, sure = [], [], [], []
            hits = batch.column("places").to_pylist()
            ids = batch.column("id").to_pylist()
            for i, data in enumerate(batch.column("t").to_pylist()):
                h = words.of(data.split())
                if len(h) < window:
                    continue
                values, at, _ = anchors(h, window, block)
                spots = np.array([p for p in hits[i] if 0 <= p <= len(h) - block], np.int64)
                near = around(np.concatenate([spots, at[listed(values, hot_anchors)]]), len(h), window, block)
                whole = window_hashes(h, window)[near]
                often = listed(whole, hot_windows)
                later = np.zeros(len(near), bool)
                if often.any():
                    later[often] = [lowest[v] < ids[i] for v in whole[often].tolist()]
                # an answered window is spread by its own key, the others meet their equals
                whole = np.where(often, whole ^ np.uint64(key_for("spread", ids[i])) ^ near.astype(np.uint64), whole)
                take = ~often | later
                hashes.append(whole[take]), places.append(near[take]), sure.append(later[take]), rows.append(np.full(int(take.sum()), i))
            join = lambda parts, kind: np.concatenate([np.empty(0, kind), *parts]).astype(kind)
            return {"hash": join(hashes, np.uint64).view(np.int64), "id": batch.column("id").take(pa.array(join(rows, np.int64))), "place": join(places, np.int32), "sure": join(sure, bool)}

        return work

    return mapped(source, make, f"hash long, id {id_type}, place int, sure boolean")


def removed(rows: DataFrame, window: int, carry_type: str) -> DataFrame:
    """row, n_words, n_removed, kept_text, removed (spans of words) from ``rows`` (row, t, starts)."""
    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out: dict = {k: [] for k in ("n_words", "n_removed", "kept_text", "removed")}
            for data, starts in zip(batch.column("t").to_pylist(), batch.column("starts").to_pylist()):
                found, spans = data.split(), []
                for s in sorted(starts or []):
                    if s + window > len(found):
                        continue
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], s + window)
                    else:
                        spans.append([s, s + window])
                kept, at = [], 0
                for a, b in spans:
                    kept += found[at:a]
                    at = b
                kept += found[at:] if spans else found
                out["n_words"].append(len(found)), out["n_removed"].append(len(found) - len(kept))
                out["kept_text"].append(b" ".join(kept)), out["removed"].append([{"start": a, "end": b} for a, b in spans])
            return out | {"row": batch.column("row")}

        return work

    return mapped(rows, make, f"row {carry_type}, n_words long, n_removed long, kept_text binary, removed array<struct<start:long,end:long>>")


def deduplicated(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept_text, removed (spans of word numbers).

    ``kept_text`` has the kept words joined by one space. Words are runs of other than white space, unchanged. Windows
    are compared by a 64-bit hash of their words. A null text has no words. A row with a null id is neither a reference
    nor cut; rows that share an id are no smaller than each other, so they do not cut each other, and what is repeated in
    one of them is looked for in all of them. An empty table gives no rows.
    """
    if blocks_held(window, block) < 1:
        raise ValueError("a window must hold a whole block at any offset: block <= (window + 1) / 2")
    id_type = docs.schema[id_column].dataType.simpleString()
    source = docs.select(column(docs, id_column).alias("id"), text_or_empty(column(docs, text_column)).cast("binary").alias("t"))
    hot = hot_passages(source, window, block)

    group = Window.partitionBy("hash")
    met = occurrences(source, id_type, hot, window, block).repartition("hash").withColumns({
        "first": F.min(F.when(F.col("flags") == _REFERENCE, F.col("id"))).over(group), "last": F.max(F.when(F.col("flags") < _SURE, F.col("id"))).over(group),
    })
    shared = (F.col("first") < F.col("id")) | ((F.col("flags") == _REFERENCE) & (F.col("id") < F.col("last")))
    hits = stored(met.filter((F.col("flags") >= _SURE) | shared).select("hash", "id", "place", "flags"), "anchor-hits")
    # one row for each listed window
    lowest = {r["hash"] & (2**64 - 1): r["id"] for r in hits.filter(F.col("flags") == _LOWEST).groupBy("hash").agg(F.min("id").alias("id")).collect()}

    places = stored(hits.filter(F.col("flags") < _LOWEST).groupBy("id").agg(F.collect_set("place").alias("places")), "hit-places")
    near, _ = beside(source, places, "id", whole=False)
    found = windows_near(near, id_type, hot, lowest, window, block).repartition("hash").withColumn("lowest", F.min("id").over(group))
    later = found.filter(F.col("sure") | (F.col("lowest") < F.col("id"))).groupBy("id").agg(F.collect_set("place").alias("starts"))
    later = stored(later, "repeated-windows")

    cut, rest = beside(source, later, "id", whole=True)
    if rest is not None:
        cut = cut.unionByName(rest.withColumn("starts", F.lit(None).cast("array<int>")))
    done = removed(cut.select(F.struct("id").alias("row"), "t", "starts"), window, f"struct<id:{id_type}>")
    return done.select(F.col("row.id").alias("doc_id"), "n_words", "n_removed", F.col("kept_text").cast("string").alias("kept_text"), "removed")
