"""Pack documents into token windows of fixed length by best-fit decreasing.

Documents are tokenised and cut where they stand: a document longer than a window is first cut into full windows, and
what is left is one piece shorter than a window. Pieces are numbered in the order of a hash and dealt by ranges of
their numbers into blocks of a fixed size at most, whatever ids they have, and each block is packed on its own: a segment tree over remaining capacities finds the tightest open window in
logarithmic time. A block leaves a few windows partly empty, a share that does not grow with the corpus. No token
moves through a shuffle unless the ids themselves are asked for.
"""

from __future__ import annotations

import array
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeo.llm.arrow import mapped, schema_of
from sondeo.llm.store import numbered, partitions, stored
from sondeo.llm.words import column, text_or_empty

WINDOW = 2048
END_ID = 1
# Pieces of a block, at most.
BLOCK_PIECES = 16_384
# Word pieces whose ids a task remembers.
REMEMBERED = 300_000


def little_endian(ids: list[int]) -> bytes:
    values = array.array("I", ids)
    if sys.byteorder == "big":
        values.byteswap()
    return values.tobytes()


class Uneven(Exception):
    """A word piece that begins or ends with white space, or is empty: its tokens may depend on its neighbours."""


class ByteTokens(dict):
    """Ids of whole texts by the byte-level BPE vocabulary in a ``tokenizers`` file, as little-endian 32-bit bytes.

    The vocabulary splits a text before every single space, so the ids of " word" do not depend on what stands around
    it and are remembered. Texts beyond Latin-1, with runs of white space or with the string of a special token are
    tokenised whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = self.ranked(path)

    @staticmethod
    def ranked(path: str):
        """The same merges in the form another library encodes faster: bytes by rank, and the pattern of words."""
        import json

        import tiktoken

        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        # byte-level vocabularies print a byte as itself if it is a visible Latin-1 character, else as the next
        # character from 256 on
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {b: chr(b) for b in visible}
        letter |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letter)}
        byte = {c: b for b, c in letter.items()}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if all(c in byte for c in token)}
        ranks = {token: i for token, i in ranks.items() if i < 50_256}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise Uneven
        ids = little_endian(self.fast.encode_ordinary(" " + word))
        if len(word) <= 40:
            self[word] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return little_endian(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def of(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        try:
            text.encode("latin-1")
            first, *rest = text.split(" ")
            if first and first[-1].isspace() and rest:
                raise Uneven
            if len(self) > REMEMBERED:
                self.clear()
            head = little_endian(self.fast.encode_ordinary(first))
            return head + b"".join(map(self.__getitem__, rest))
        except (UnicodeEncodeError, Uneven):
            return self.whole(text)


def cut(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of at most ``window`` tokens: doc_id, start, length, ids_crc32, doc_tokens, and ids (binary) if asked for.

    ``tokenizer`` is the path of a vocabulary file that every executor can open. Each document ends with ``end_id``, so
    an empty or null text is one piece of one token. The type of the id is kept; it may be null or repeat.
    """
    id_type = docs.schema[id_column].dataType.simpleString()
    source = docs.select(column(docs, id_column).alias("doc_id"), text_or_empty(column(docs, text_column)).cast("binary").alias("t"))

    def make():
        tokens, end = ByteTokens(tokenizer), little_endian([end_id])

        def work(batch: pa.RecordBatch) -> dict:
            row, start, length, crc, total, kept = [], [], [], [], [], []
            for i, data in enumerate(batch.column("t").to_pylist()):
                ids = tokens.of(data.decode("utf-8", "replace")) + end
                for at in range(0, len(ids), 4 * window):
                    part = ids[at : at + 4 * window]
                    row.append(i), start.append(at // 4), length.append(len(part) // 4)
                    crc.append(zlib.crc32(part)), total.append(len(ids) // 4), kept.append(part if with_ids else None)
            return {"doc_id": batch.column("doc_id").take(pa.array(row, pa.int64())), "start": start, "length": length, "ids_crc32": crc, "doc_tokens": total, "ids": kept}

        return work

    pieces = mapped(source, make, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
    return pieces if with_ids else pieces.drop("ids")


class Capacities:
    """Open windows by remaining capacity, under a segment tree that tells which capacities have any."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, name: int) -> None:
        self.open[capacity].append(name)
        at = capacity + self.leaves
        while at and not self.any[at]:
            self.any[at] = 1
            at >>= 1

    def tightest(self, length: int) -> int:
        """The smallest capacity of at least ``length`` that has an open window, or -1."""
        at = length + self.leaves
        if self.any[at]:
            return length
        while at > 1:  # up to the first right sibling with an open window, then down to its leftmost one
            if not at & 1 and self.any[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return -1

    def take(self, capacity: int) -> int:
        name = self.open[capacity].pop()
        if not self.open[capacity]:
            at = capacity + self.leaves
            self.any[at] = 0
            while at > 1 and not (self.any[at] or self.any[at ^ 1]):
                at >>= 1
                self.any[at] = 0
        return name


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; ``lengths`` come longest first."""
    windows, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    tree, used = Capacities(window), 0
    for i, length in enumerate(lengths.tolist()):
        room = tree.tightest(length) if length < window else -1
        if room < 0:
            name, room, used = used, window, used + 1
        else:
            name = tree.take(room)
        windows[i], offsets[i] = name, window - room
        if room > length:
            tree.put(room - length, name)
    return windows, offsets


def packed(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False, block_pieces: int = BLOCK_PIECES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The pieces of ``docs`` (see ``cut``) with sequence_id and offset: their window and their place in it, gapless from 0.

    A window that is not full is padded by whoever reads it. Pieces are dealt, and those of equal length placed, in the
    order of a hash of all they hold, so reruns agree; rows that repeat are placed as often as they stand. An empty table gives no rows.
    """
    pieces = stored(cut(docs, tokenizer, window, end_id, with_ids, id_column, text_column), "token-pieces")
    total = pieces.count()
    blocks = max(1, -(-total // block_pieces))
    # equal pieces are told apart by where they stand, so that they do not make one range
    marked = pieces.withColumns({"tie": F.xxhash64("doc_id", "start", "ids_crc32", "length", "doc_tokens"), "at": F.monotonically_increasing_id()})
    dealt = numbered(marked, "number", "tie", "at").withColumn("block", F.expr(f"number * {blocks} div {max(1, total)}")).drop("number", "at")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    out = schema_of(fields)

    def pack(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        order = np.lexsort((table.column("tie").to_numpy(), -lengths))
        windows, offsets = best_fit(lengths[order], window)
        base = table.column("block")[0].as_py() << 32
        table = table.take(pa.array(order)).drop_columns(["tie", "block"])
        table = table.append_column("sequence_id", pa.array(base + windows)).append_column("offset", pa.array(offsets))
        return table.cast(out)

    if blocks > partitions(docs):
        dealt = dealt.repartition(min(blocks, 100_000), "block")
    return dealt.groupBy("block").applyInArrow(pack, fields)
