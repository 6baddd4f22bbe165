"""Exact duplicates, mixing and quality rules against plain Python."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from messy_tables import empty, frame, messy, messy_rows, prose  # noqa: F401
from pyspark.sql import functions as F

from sondeo.llm import exact_dedup, mixing, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("share", [4, 1 << 20])
def test_exact_groups(messy, keep, share, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", share)  # with a large share every group counts as hot
    got = exact_dedup.annotated(messy, keep=keep).select("row.doc_id", "row.text", "keep_id", "group_size", "kept", "text_sha256").collect()
    groups = defaultdict(list)
    for i, t, *_ in messy_rows():
        groups[t or ""].append(i)
    assert len(got) == len(messy_rows())
    for r in got:
        ids = groups[r.text or ""]
        best = (min if keep == "smallest" else max)((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size) == (best, len(ids))
        assert r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    kept = Counter(r.text or "" for r in got if r.kept)
    assert set(kept) == set(groups) and set(kept.values()) == {1}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_rows_come_back_whole(messy, empty):
    kept = exact_dedup.kept_rows(messy)
    assert kept.columns == messy.columns and kept.count() == len({t or "" for _, t, *_ in messy_rows()})
    assert kept.filter("doc_id = 1").first()["text"] is None
    assert exact_dedup.kept_rows(empty).count() == 0


def test_exact_normalised(messy):
    got = exact_dedup.annotated(messy, normalise=F.lower).filter("row.doc_id = 11").first()
    assert got.keep_id == 9 and got.row.text.isupper()


def test_mix_meets_targets(spark):
    rows = [(i, prose(i, 20 + i % 40), "en", "abcd"[min(i % 7, 3)] if i % 50 else None) for i in range(3000)]
    docs = frame(spark, rows)
    got = mixing.annotated(docs, carry=("doc_id", "source")).select("row.*", "size", "source_size", "target", "copies", "taken").collect()
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(t.split())
    order = sorted((s for s in sizes if s), key=lambda s: s.encode()) + [None]
    weight, total = {s: 1 + i % 3 for i, s in enumerate(order)}, sum(sizes.values())
    full, target = set(), {}
    while True:  # fill up, cap, share the excess anew
        left, w = total - sum(3 * sizes[s] for s in full), sum(weight[s] for s in order if s not in full)
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / w for s in order}
        over = {s for s in order if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source])
        assert r.taken == r.size * r.copies <= 3 * r.size
        assert r.copies in (math.floor(target[r.source] / sizes[r.source]), math.floor(target[r.source] / sizes[r.source]) + 1)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) < 0.02 * target[s] for s in order)
    again = mixing.annotated(docs.repartition(7), carry=("doc_id",)).select("row.doc_id", "taken").collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in got}


def test_mix_repeats_rows(messy, empty):
    counts = Counter((r.doc_id, r.text) for r in mixing.mixed(messy).collect())
    wanted = Counter()
    for r in mixing.annotated(messy, carry=("doc_id", "text")).collect():
        wanted[r.row.doc_id, r.row.text] += r.copies
    assert counts == +wanted
    assert mixing.mixed(empty).count() == 0 and mixing.annotated(empty).count() == 0


def base_counts(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, inside = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), n < 50 or 100 * len(inside) > 50 * n


def test_base_counts(messy, empty):
    got = quality_rules.annotated(messy, carry=["doc_id", "text"]).collect()
    assert len(got) == len(messy_rows())
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(r.row.text)
        assert not (r.base_failed and r.kept)
    assert quality_rules.annotated(empty).count() == 0
    assert quality_rules.kept_rows(messy).columns == messy.columns


def plain_estimate(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same estimate with numpy: medians, then concentration steps to whole bins of distance."""
    floor = np.square(list(quality_rules.STATISTICS.values()))
    widen = quality_rules.inner_share(len(floor), quality_rules.SHARE)
    mean = np.median(z, axis=0)
    cov = np.diag((np.median(np.abs(z - mean), axis=0) * 1.4826) ** 2 + floor)
    for _ in range(quality_rules.STEPS):
        bins = np.floor(quality_rules.BIN_PER_LOG * np.log1p(plain_squared(z, mean, cov)))
        rank = np.array([(bins < b).sum() for b in bins])
        inner = z[rank < quality_rules.SHARE * len(z)]
        mean = inner.mean(axis=0)
        cov = widen * (inner.T @ inner / len(inner) - np.outer(mean, mean)) + np.diag(floor)
    return mean, cov


def plain_squared(z, mean, cov):
    d = z - mean
    return np.einsum("ij,ij->i", d, np.linalg.solve(cov, d.T).T)


def plain_mixed(own, above, n, prior):
    w, off = n / (n + prior), own[0] - above[0]
    return w * own[0] + (1 - w) * above[0], w * own[1] + (1 - w) * above[1] + w * (1 - w) * np.outer(off, off)


def plain_distances(table, prior):
    """Distances of the passing rows of a table with lang, source and z0.., by group, language and all."""
    z = table[[f"z{i}" for i in range(len(quality_rules.STATISTICS))]].to_numpy() / quality_rules.UNIT
    keys = [("", "")] * len(z), [(str(g), "") for g in table["lang"]], [(str(g), str(s)) for g, s in zip(table["lang"], table["source"])]
    out = np.empty(len(z))
    for key in set(keys[2]):
        rows = {level: np.array([k == want for k in keys[level]]) for level, want in ((0, ("", "")), (1, (key[0], "")), (2, key))}
        estimate = plain_estimate(z)
        for level in (1, 2):
            estimate = plain_mixed(plain_estimate(z[rows[level]]), estimate, rows[level].sum(), prior)
        out[rows[2]] = plain_squared(z[rows[2]], *estimate)
    return out


@pytest.mark.parametrize("broadcast", [10_000, 2])
def test_robust_distances(spark, monkeypatch, broadcast):
    monkeypatch.setattr(quality_rules, "BROADCAST_GROUPS", broadcast)  # with few, only hot groups are broadcast
    rows = [(i, prose(i, 60 + i % 30), "en", "a") for i in range(240)]
    odd = [(1000 + i, prose(i, 80).upper().replace(" ", "!! "), "en", "a") for i in range(20)]
    few = [(2000 + i, prose(i, 80), "de" if i % 2 else None, f"b{i % 3}" if i % 5 else None) for i in range(14)]
    docs = frame(spark, rows + odd + few)
    got = quality_rules.annotated(docs, carry=["doc_id"], prior=50).collect()
    kept = {r.row.doc_id: r.kept for r in got}
    assert all(kept[i] for i, *_ in rows + few) and not any(kept[i] for i, *_ in odd)
    table = quality_rules.measured(docs, "text", "lang", "source", ["doc_id"]).filter("not base_failed").toPandas()
    wanted = dict(zip((r["doc_id"] for r in table["row"]), plain_distances(table, 50)))
    assert len(wanted) == len(rows + odd + few)
    for r in got:
        assert math.isclose(r.distance, wanted[r.row.doc_id], rel_tol=1e-6, abs_tol=1e-6)


def test_no_verdict_turns_on_the_size_of_a_group(spark):
    """A source grows from 190 to 210 documents: the distances of the documents that were there move by little."""
    base = [(i, prose(i, 60 + i % 30) + " #" * (i % 4), "en", "a" if i < 190 else "b") for i in range(600)]
    more = [(5000 + i, prose(7000 + i, 70) + " #" * (i % 4), "en", "a") for i in range(20)]
    before, after = ({r.row.doc_id: r.distance for r in quality_rules.annotated(frame(spark, rows), carry=["doc_id"]).collect()} for rows in (base, base + more))
    assert max(abs(after[i] - before[i]) / (1 + before[i]) for i in before) < 0.2
