"""Fuzzy search for short licence notices in whole texts.

A notice that may differ in k characters is split into k + 1 seeds; if it stands in a text with at most k edits, at
least one seed stands there unchanged (pigeonhole). One automaton finds the seeds of all notices in a single pass, and
only around a hit does the ``regex`` library match the notice with bounded errors and report span and edits. Each
document is judged alone, so the work is one map over the table without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sondeo.llm.arrow import mapped
from sondeo.llm.words import column, text_or_empty

#: Phrases that name a licence, and the label of each.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices searched with errors, by label; words in lower case, joined by one space.
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "under the terms of the gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc", "licensed under cc by nc 4 0"),
    ("cc", "creative commons attribution"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("reserved", "all rights reserved"),
)
# One error is allowed for so many characters of a notice, at least one.
CHARS_PER_ERROR = 14

_TABLE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


@dataclass(frozen=True)
class Notice:
    label: str
    text: str

    @property
    def errors(self) -> int:
        return max(1, len(self.text) // CHARS_PER_ERROR)

    def seeds(self) -> list[tuple[int, str]]:
        """(offset, seed) of errors + 1 consecutive parts of nearly equal length."""
        parts = self.errors + 1
        cuts = [len(self.text) * i // parts for i in range(parts + 1)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    def __init__(self, notices: tuple[tuple[str, str], ...] = NOTICES, phrases: dict[str, str] = PHRASES):
        self.notices, self.phrases = [Notice(*n) for n in notices], phrases
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(self.notices):
            for offset, seed in notice.seeds():
                seeds.setdefault(seed, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for seed, places in seeds.items():
            self.automaton.add_word(seed, (len(seed), places))
        self.automaton.make_automaton()
        self.patterns = [regex.compile(f"(?b)(?:{regex.escape(n.text)}){{e<={n.errors}}}") for n in self.notices]

    @staticmethod
    def normalised(data: bytes) -> bytes:
        """Lower-case words joined by one space."""
        return b" ".join(data.translate(_TABLE).split())

    def exact(self, text: bytes) -> list[tuple[int, str]]:
        """(first word, label) of every place where a phrase stands word for word."""
        padded, found = b" " + text + b" ", []
        for phrase, label in self.phrases.items():
            inner = b" " + phrase.encode() + b" "
            at = padded.find(inner)
            while at >= 0:
                found.append((padded.count(b" ", 0, at), label))
                at = padded.find(inner, at + 1)
        return found

    def matches(self, i: int, text: str, a: int, b: int):
        """The matches of notice ``i`` in a stretch: the best one, then likewise in what is left on both sides of it."""
        shortest, rest = len(self.notices[i].text) - self.notices[i].errors, [(a, b)]
        while rest:
            a, b = rest.pop()
            if b - a >= shortest and (match := self.patterns[i].search(text, a, b)):
                yield match
                rest += [(a, match.start()), (match.end(), b)]

    def fuzzy(self, text: str) -> list[tuple[str, int, int, int]]:
        """(label, start, end, edits) of the notices that stand in ``text`` with few enough edits.

        Candidate stretches of a notice that overlap are searched as one, and a stretch may hold several matches. Spans
        of one notice do not overlap.
        """
        stretches: dict[int, list[list[int]]] = {}
        for last, (length, places) in self.automaton.iter(text):
            for i, offset in places:
                notice, begin = self.notices[i], last + 1 - length - offset
                a, b = max(0, begin - notice.errors), min(len(text), begin + len(notice.text) + 2 * notice.errors)
                stretches.setdefault(i, []).append([a, b])
        found = []
        for i, parts in stretches.items():
            parts.sort()
            merged = [parts[0]]
            for a, b in parts[1:]:
                if a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            for a, b in merged:
                for match in self.matches(i, text, a, b):
                    found.append((self.notices[i].label, match.start(), match.end(), sum(match.fuzzy_counts)))
        return sorted(found)


def scanned(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", notices=NOTICES, phrases=PHRASES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    base_labels and labels are sorted and comma-joined, empty if there are none. ``spans`` holds (label, start, end,
    edits) of fuzzy matches in the normalised text: lower-case words of ASCII letters, digits and all characters beyond
    ASCII, joined by one space. The score is 1 for an exact phrase, else the best share of a notice matched without
    edits, else 0. A null text counts as empty and has no words; ids may be null or repeat.
    """
    id_type = docs.schema[id_column].dataType.simpleString()

    def make():
        scanner = Scanner(notices, phrases)

        def work(batch: pa.RecordBatch) -> dict:
            out: dict = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
            for data in batch.column("t").to_pylist():
                text = scanner.normalised(data)
                places = scanner.exact(text)
                spans = scanner.fuzzy(text.decode("utf-8", "replace"))
                starts, base = [p for p, _ in places], {x for _, x in places}
                out["n_words"].append(text.count(b" ") + 1 if text else 0)
                out["n_base"].append(len(places))
                out["first_word"].append(min(starts, default=None))
                out["last_word"].append(max(starts, default=None))
                out["base_labels"].append(",".join(sorted(base)))
                out["labels"].append(",".join(sorted(base | {s[0] for s in spans})))
                out["score"].append(1.0 if base else max((1 - s[3] / max(s[2] - s[1], 1) for s in spans), default=0.0))
                out["spans"].append([{"label": s[0], "start": s[1], "end": s[2], "edits": s[3]} for s in spans])
            return out | {"doc_id": batch.column("doc_id")}

        return work

    source = docs.select(column(docs, id_column).alias("doc_id"), text_or_empty(column(docs, text_column)).cast("binary").alias("t"))
    return mapped(source, make, f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,edits:long>>")
