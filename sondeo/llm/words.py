"""Words of whole texts, as Spark expressions and as numpy hashes inside Arrow tasks."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words: space and the control characters 9 to 13. ``bytes.split()`` uses the same six.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

# Words a task remembers the hash of; beyond, it forgets all and starts anew.
REMEMBERED = 300_000


def column(frame: DataFrame, name: str) -> Column:
    """The column of that very name, dots and quotes included."""
    return frame["`" + name.replace("`", "``") + "`"]


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


class WordHashes(dict):
    """64-bit hashes of words, remembered while they repeat."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of a public hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """One hash for each run of ``length`` consecutive words; empty if there are fewer.

    Runs of 1, 2, 4, ... words are combined pairwise, so a run of any length costs a few array operations.
    """
    if len(hashes) < length:
        return np.empty(0, np.uint64)
    size, runs, done, out = 1, hashes, 0, None
    while True:
        if length & size:
            n = len(hashes) - length + 1
            part = runs[done : done + n]
            out = part.copy() if out is None else mixed(out + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15) + part
            done += size
        if done == length:
            return mixed(out)
        runs = mixed(runs[:-size]) * np.uint64(0xD6E8FEB86659FD93) + runs[size:]
        size *= 2
