"""Maximal periodic runs of words, found by internal pattern matching.

The words of a chunk of documents are numbered so that no word of one document equals one of another, and prefix doubling
gives a suffix array and, for every power of two, the rank of each position by its next so many words. A block of 2^k words
at a multiple of 2^k owns an interval of the suffix array, and the next occurrences of the block within a neighbouring
window are range successors in that interval, answered by a wavelet matrix over the suffix array for all blocks at once.
Occurrences that overlap by half form a progression, which is jumped over as one. The distance from a block to an
occurrence is a candidate period: a run of period q and length L has L - q words that recur q words on, and these hold a
whole block of 2^k words as soon as L - q reaches 2^(k+1) - 1. Each candidate is extended both ways by comparing ranks, so a
run is exact and maximal; of several periods of one stretch the smallest stays.

Documents never meet, so there is no shuffle: one map over whole texts. A chunk holds so many words or one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondeo.llm.arrow import mapped
from sondeo.llm.quality_rules import let, word_array
from sondeo.llm.words import column, text_or_empty

LEAST_LENGTH = 12
# Words of the documents that are searched together; a longer document is searched alone.
CHUNK_WORDS = 150_000

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class Successors:
    """A wavelet matrix over whole numbers below ``2 ** bits``: the smallest value of a range that reaches a bound."""

    def __init__(self, values: np.ndarray):
        self.n, self.bits = len(values), max(1, int(len(values)).bit_length())
        self.ones, self.zeros = [], []
        for bit in range(self.bits - 1, -1, -1):
            up = (values >> bit & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(up, dtype=np.int32)]))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate([values[~up], values[up]])

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of each range ``low:high`` are below ``bound``."""
        low, high, count = low.copy(), high.copy(), np.zeros(len(low), np.int64)
        bound = np.minimum(bound, (1 << self.bits) - 1)  # above all values
        for bit, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros):
            left, right = ones[low], ones[high]
            up = (bound >> bit & 1).astype(bool)
            count += np.where(up, high - low - (right - left), 0)
            low, high = np.where(up, zeros + left, low - left), np.where(up, zeros + right, high - right)
        return count

    def ranked(self, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value of each range that has ``rank`` smaller ones in it."""
        low, high, rank, value = low.copy(), high.copy(), rank.copy(), np.zeros(len(low), np.int64)
        for bit, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros):
            left, right = ones[low], ones[high]
            small = high - low - (right - left)
            up = rank >= small
            rank -= np.where(up, small, 0)
            value |= up.astype(np.int64) << bit
            low, high = np.where(up, zeros + left, low - left), np.where(up, zeros + right, high - right)
        return value

    def next(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The smallest value from ``bound`` on of each range, or ``n`` if there is none."""
        rank, out = self.below(low, high, bound), np.full(len(low), self.n, np.int64)
        some = rank < high - low
        out[some] = self.ranked(low[some], high[some], rank[some])
        return out


class Ranks:
    """Ranks of all positions by their next 2^k words, for every k until all differ; and the suffix array."""

    def __init__(self, words: np.ndarray):
        # the end is a word of its own, smaller than all others
        words = np.append(words + 1, 0)
        self.n, self.levels = len(words), []
        order = np.argsort(words, kind="stable")
        rank = self._ranked(order, words)
        self.levels.append(rank)
        width = 1
        while self._classes < self.n:
            further = np.zeros(self.n, np.int64)
            further[: self.n - width] = rank[width:] + 1
            keys = rank * (self.n + 1) + further
            order = np.argsort(keys, kind="stable")
            rank = self._ranked(order, keys)
            self.levels.append(rank)
            width *= 2
        self.suffixes = order

    def _ranked(self, order: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """For each position the number of positions with smaller keys: where its class begins in the sorted order."""
        sorted_keys = keys[order]
        new = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])
        starts = np.flatnonzero(new)
        self._classes = len(starts)
        rank = np.empty(self.n, np.int64)
        rank[order] = np.repeat(starts, np.diff(np.append(starts, self.n)))
        return rank

    def level(self, k: int) -> np.ndarray:
        return self.levels[min(k, len(self.levels) - 1)]

    def interval(self, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of the suffix array that starts with the 2^k words at each position."""
        rank = self.level(k)
        size = np.bincount(rank, minlength=self.n)
        return rank[at], rank[at] + size[rank[at]]

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from ``a`` and ``b`` on are equal; the positions differ."""
        a, b, length = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank, width = self.levels[k], 1 << k
            same = np.flatnonzero((np.maximum(a, b) < self.n) & (rank[np.minimum(a, self.n - 1)] == rank[np.minimum(b, self.n - 1)]))
            a[same] += width
            b[same] += width
            length[same] += width
        return length

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words right before ``a`` and ``b`` are equal."""
        a, b, length = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank, width = self.levels[k], 1 << k
            room = np.minimum(a, b) >= width
            same = np.flatnonzero(room & (rank[np.maximum(a - width, 0)] == rank[np.maximum(b - width, 0)]))
            a[same] -= width
            b[same] -= width
            length[same] += width
        return length


def candidates(ranks: Ranks, successors: Successors, k: int, first: int, last: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(block, distance) pairs: every block of 2^k words and its occurrences ``first`` to ``last`` words on.

    Of occurrences that overlap the block itself periodically only the nearest is given, for their distances are
    multiples of a smaller period of the same stretch.
    """
    width = 1 << k
    blocks = np.arange(0, ranks.n - 1, width, dtype=np.int64)
    low, high = ranks.interval(k, blocks)
    some = high - low > 1
    blocks, low, high = blocks[some], low[some], high[some]
    bound = blocks + first
    while len(blocks):
        at = successors.next(low, high, bound)
        some = at <= np.minimum(blocks + last, ranks.n - 1)
        blocks, low, high, at = blocks[some], low[some], high[some], at[some]
        if not len(blocks):
            return
        count, step = np.ones(len(blocks), np.int64), np.ones(len(blocks), np.int64)
        second = successors.next(low, high, at + 1)
        # two occurrences half a block apart or nearer: the block has that period, and so the progression's end is known
        close = np.flatnonzero((second < ranks.n) & (2 * (second - at) <= width))
        if len(close):
            step[close] = second[close] - at[close]
            stretch = step[close] + ranks.forward(at[close], second[close])
            count[close] = np.minimum(1 + (stretch - width) // step[close], 1 + (blocks[close] + last - at[close]) // step[close])
            own = ranks.forward(blocks[close], blocks[close] + step[close]) + step[close] >= at[close] - blocks[close] + width
            alone = close[own & (blocks[close] + step[close] < at[close])]
            # the progression goes on from the block itself: its period belongs to a smaller distance
            keep = np.ones(len(blocks), bool)
            keep[alone] = False
        else:
            keep = np.ones(len(blocks), bool)
        many = np.where(keep, count, 0)
        each = np.repeat(np.arange(len(blocks)), many)
        nth = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
        if len(each):
            yield blocks[each], at[each] + nth * step[each] - blocks[each]
        bound = at + (count - 1) * step + 1


def found(words: np.ndarray, least: int = LEAST_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every maximal run of ``words`` of length ``max(least, 2 * period)`` at least, by start, then period.

    ``words`` are numbers from 0. Periods below about half of ``least`` use blocks of a size that ``least`` allows.
    """
    none = np.empty(0, np.int64)
    if len(words) < max(least, 2):
        return none, none, none
    ranks = Ranks(words.astype(np.int64))
    successors = Successors(ranks.suffixes)
    # the words that recur q words on are at least this many, and hold a block of 2^k words if there are 2^(k+1) - 1 of them
    size = lambda q: (max(least - q, q) + 1).bit_length() - 2
    q, starts, ends, periods = 1, [none], [none], [none]
    while 2 * q <= len(words):
        k, last = size(q), q
        if 2 * q >= least:
            last = (1 << k + 2) - 2
        else:
            while 2 * (last + 1) <= least and size(last + 1) == k:
                last += 1
        for block, distance in candidates(ranks, successors, k, q, last):
            right = ranks.forward(block, block + distance)
            left = ranks.backward(block, block + distance)
            length = left + right + distance
            long = length >= np.maximum(least, 2 * distance)
            starts.append((block - left)[long])
            ends.append((block + distance + right)[long])
            periods.append(distance[long])
        q = last + 1
    start, end, period = map(np.concatenate, (starts, ends, periods))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], (end - start)[order], period[order]


class Searcher:
    """Texts in, runs and collapsed texts out, for as many documents together as a chunk holds."""

    def __init__(self, least: int):
        self.least = least

    def chunk(self, documents: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The runs of each document, as starts within it, lengths and periods."""
        offsets = np.cumsum([0] + [len(d) for d in documents])
        codes, base = np.empty(offsets[-1], np.int64), 0
        for words, at in zip(documents, offsets):
            # words of different documents get different numbers, so runs and ranks stay inside one
            known: dict[bytes, int] = {}
            codes[at : at + len(words)] = [known.setdefault(w, base + len(known)) for w in words]
            base += len(known)
        start, length, period = found(codes, self.least)
        cut = np.searchsorted(start, offsets)
        return [(start[a:b] - at, length[a:b], period[a:b]) for a, b, at in zip(cut, cut[1:], offsets)]

    def __call__(self, batch: pa.RecordBatch) -> dict:
        texts = [t.as_py().split() if t.is_valid else [] for t in batch.column("t")]
        runs: list[tuple] = []
        i = 0
        while i < len(texts):
            j, held = i, 0
            while j < len(texts) and (j == i or held + len(texts[j]) <= CHUNK_WORDS):
                held += len(texts[j])
                j += 1
            runs += self.chunk(texts[i:j])
            i = j
        best = [self.longest(*r) for r in runs]
        return {
            "doc_id": batch.column("doc_id"), "n_runs": [len(r[0]) for r in runs],
            **{name: [b and b[i] for b in best] for i, name in enumerate(("start", "length", "period"))},
            "runs": self.listed(runs), "collapsed": [self.collapsed(words, *r) for words, r in zip(texts, runs)],
        }

    @staticmethod
    def listed(runs: list[tuple]) -> pa.ListArray:
        start, length, period = (np.concatenate([r[i] for r in runs]) for i in range(3))
        kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        flat = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(kind))
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(r[0]) for r in runs]), pa.int32()), flat)

    @staticmethod
    def longest(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple[int, int, int] | None:
        """The run of greatest length; of equal ones the first, then that of the smallest period."""
        if not len(start):
            return None
        i = int(np.argmax(length))
        return int(start[i]), int(length[i]), int(period[i])

    @staticmethod
    def collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> str:
        """The words outside of what the runs repeat, joined by single spaces."""
        if len(start):
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, start + period, 1)
            np.add.at(edge, start + length, -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
        return b" ".join(words).decode()


def detected(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """doc_id, n_runs, start, length and period of the longest run, all runs, and the text with each run cut to one period.

    A run is a stretch of words that repeats with its smallest period at least twice, is ``least`` words long or more and
    cannot be extended. One row for each row of ``docs``, repeated and null ids included; a null text counts as empty and,
    like one without runs, has null for start, length and period. Texts are read whole, whatever their length. An empty table gives no
    rows, and other columns of ``docs`` are ignored, whatever they are called.
    """
    rows = docs.select(column(docs, id_column).alias("doc_id"), text_or_empty(column(docs, text_column)).cast("binary").alias("t"))
    return mapped(rows, lambda: Searcher(least), SCHEMA)


def planted(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with runs planted in about a tenth of the texts, by a rule on the id: known repetitions to measure with.

    With h the crc32 of the id as text and g = h / 10: if h ends in 0, each word from a = g mod n on is replaced by the word
    a + (i - a) mod p, where p = 1 + (n - a) / (3 + g mod 8). Other texts, and those of null ids, stay as they are.
    """
    h = F.crc32(column(docs, id_column).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")

        def from_place(place: Column) -> Column:
            a, p = place["a"], place["p"]
            return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")

        a = g % n
        return F.when(n > 0, let(F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).alias("p")), from_place)).otherwise("")

    text = text_or_empty(column(docs, text_column))
    return docs.withColumn(text_column, F.when(F.coalesce(h % 10 == 0, F.lit(False)), let(word_array(text), repeated)).otherwise(text))


def digest(runs: Column) -> Column:
    """SHA-256 of the lines ``start,length,period`` of all runs."""
    lines = F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return F.sha2(F.array_join(lines, "").cast("binary"), 256)
