"""The filter audit and the run detection against plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import connect, difference
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from messy_tables import empty, frame, messy, messy_rows, prose  # noqa: F401

from sondeo.llm import filter_audit, runs
from sondeo.llm.oracles import ORACLES
from sondeo.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MARKS = [(4, 1, 0), (9, 1, 1), (9, 0, 0), (11, 0, 1), (None, 1, 1), (777, 1, 1), (12, None, 1)]


# filter audit

@given(st.sets(st.integers(0, 5000)), st.sets(st.integers(0, 5000)), st.integers(1, 40))
@settings(max_examples=150, deadline=None)
def test_galloping_merges(a, b, spread):
    a, b = (np.array(sorted({x * k for x in s}), dtype=np.int64) for s, k in ((a, 1), (b, spread)))
    assert filter_audit.common(a, b).tolist() == sorted(set(a.tolist()) & set(b.tolist()))
    assert filter_audit.united(a, b).tolist() == sorted(set(a.tolist()) | set(b.tolist()))


def test_long_lists_gallop_past_stretches():
    a, b = np.arange(0, 60_000, 7), np.concatenate([np.arange(3), np.arange(40_000, 90_000)])
    assert filter_audit.common(a, b).tolist() == sorted(set(a.tolist()) & set(b.tolist()))
    assert filter_audit.united(b, a).tolist() == sorted(set(a.tolist()) | set(b.tolist()))


def plain_audit(rows, marks):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = ({i for i, *m in marks if i is not None and m[k] == 1} for k in (0, 1))
    parts = defaultdict(list)
    for i, t, _, source in rows:
        words, t = WORD.findall(t or ""), t or ""
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        parts[source or ""].append(({k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part, held in parts.items():
        total = Counter()
        for order in itertools.permutations("ABCDE"):
            left = held
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [f, len(left), len(gone), sum(f in x[0] for x in held) - len(gone), sum(x[0] == {f} for x in held), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for key in [k for k in out if k[0] == part]:
            out[key].append(total[out[key][0]])
    return {k: v[1:] for k, v in out.items()}


def test_audit_of_messy_rows(spark, messy, empty):
    labels = spark.createDataFrame([(*m, "clash") for m in MARKS], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.audit(messy, labels).collect()
    wanted = plain_audit(messy_rows(), MARKS)
    assert len(got) == len(wanted) == 120 * 5 * 4
    for r in got:
        assert [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] == wanted[r.part, r.filter_order, r.step]
    assert filter_audit.audit(empty, labels).count() == 0
    assert filter_audit.audit(messy, labels.limit(0)).groupBy().sum("good_lost", "toxic_lost").first()[:] == (0, 0)


def test_audit_of_a_hot_part_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "RANGE_ROWS", 16)
    rng = random.Random(2)
    texts = [prose(1, 60), prose(2, 20), "A " + prose(3, 55).upper(), "same again " * 40, prose(4, 70) + " #"]
    rows = [(i % 250 if i % 3 else i, rng.choice(texts) if i % 2 else prose(i, rng.choice([10, 60])), "en", "hot" if i % 4 else f"s{i % 5}") for i in range(900)]
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(0, 900, 5)], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(frame(spark, rows).repartition(5), labels).collect()
    wanted = plain_audit(rows, [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(0, 900, 5)])
    assert len(got) == len(wanted)
    assert all([r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] == wanted[r.part, r.filter_order, r.step] for r in got)


def test_audit_query_equals_sql(spark):
    assert difference(QUERIES["op12_filter_audit"](spark, DATA), connect(DATA), ORACLES["op12_filter_audit"]) is None


# periodic runs

def plain_runs(words, least=12):
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, q, e - s) for (s, e), q in out.items())


@given(st.lists(st.integers(0, 3), max_size=90), st.integers(1, 30), st.integers(1, 4), st.sampled_from([12, 12, 2, 5, 40]))
@settings(max_examples=300, deadline=None)
def test_runs_equal_brute_force(words, unit, times, least):
    words = words + words[:unit] * times
    start, length, period = runs.found(np.array(words, dtype=np.int64), least)
    assert list(zip(start.tolist(), period.tolist(), length.tolist())) == plain_runs(words, least)


@pytest.mark.parametrize("words", [[0] * 700, ([0] * 9 + [1]) * 40, list(range(300)) * 3, [0, 1] * 50 + [2] + [0, 1] * 50, [0, 0, 1] * 30 + [0, 0, 1, 1] * 30])
def test_runs_of_highly_periodic_words(words):
    start, length, period = runs.found(np.array(words, dtype=np.int64))
    assert list(zip(start.tolist(), period.tolist(), length.tolist())) == plain_runs(words)


def test_fibonacci_words():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    start, length, period = runs.found(np.array(b, dtype=np.int64))
    assert list(zip(start.tolist(), period.tolist(), length.tolist())) == plain_runs(b)


def replanted(i, words):
    h = None if i is None else zlib.crc32(str(i).encode())
    if h is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]


def wanted_row(i, text):
    words = replanted(i, WORD.findall(text or ""))
    found = plain_runs(words)
    gone = {k for s, q, n in found for k in range(s + q, s + n)}
    best = min(((-n, s, q) for s, q, n in found), default=None)
    longest = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{n},{q}\n" for s, q, n in found)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(found), *longest, sha(lines), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_run_query_on_messy_rows(spark, empty, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "CHUNK_WORDS", 500)
    rows = [(i, None if t is None else " ".join(t.split()[:3000]) if i == 6 else t, g, s) for i, t, g, s in messy_rows()]
    rows += [(100 + i, prose(i, 200), "en", "a") for i in range(60)] + [(200, "a b c " * 30 + "d e f g h i " * 9 + prose(3, 40), "en", "a")]
    folder = str(tmp_path)
    frame(spark, rows).repartition(3).write.parquet(f"{folder}/documents.parquet")
    got = defaultdict(list)
    for r in QUERIES["op13_run_detection"](spark, folder).collect():
        got[r.doc_id].append((r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256))
    wanted = defaultdict(list)
    for i, t, *_ in rows:
        wanted[i].append(wanted_row(i, t))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in wanted.items()}
    assert any(x[0] for v in wanted.values() for x in v)
    assert runs.detected(empty).count() == 0


def test_long_texts_are_searched_whole(spark):
    rows = [(1, prose(6, 30_000), "en", "a"), (2, " ".join(f"w{i % 9000}" for i in range(30_000)), "en", "a"), (3, "x " * 60_000, "en", "a")]
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period) for r in runs.detected(frame(spark, rows)).collect()}
    assert got == {1: (0, None, None, None), 2: (1, 0, 30_000, 9000), 3: (1, 0, 60_000, 1)}
