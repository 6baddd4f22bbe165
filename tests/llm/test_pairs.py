"""Near duplicates and repeated passages against plain Python."""

import random
from collections import defaultdict

import pytest
from messy_tables import empty, frame, messy, messy_rows, prose, words  # noqa: F401
from pyspark.sql import functions as F

from sondeo.llm import ngram_join, substring_dedup
from sondeo.llm.components import components


def plain_sets(rows):
    out = []
    for i, t, *_ in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
        w = [x for x in w if x]
        out.append((i, {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}))
    return out


def plain_components(rows):
    sets = plain_sets(rows)
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if a is not None and b is not None and x and y:
                both = len(x & y)
                if 100 * both >= 75 * (len(x) + len(y) - both):
                    lo, hi = sorted((root(a), root(b)))
                    parent[hi] = lo
    return [(i, len(s), None if i is None else root(i)) for i, s in sets]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0))


def test_components_of_links(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, 7), (7, 6), (9, 9), (None, 3)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 100 for i in range(100, 161)} | {5: 5, 6: 5, 7: 5}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(messy, empty):
    got = [tuple(r) for r in ngram_join.annotated(messy).collect()]
    assert order(got) == order(plain_components(messy_rows()))
    kept = ngram_join.kept_rows(messy)
    heads = {c for _, _, c in plain_components(messy_rows())}
    assert kept.columns == messy.columns and {r.doc_id for r in kept.collect()} == heads
    assert ngram_join.annotated(empty).count() == 0 and ngram_join.kept_rows(empty).count() == 0


def families(seed: int) -> list[tuple]:
    """Copies of a few texts, edited more and less, cut and joined, so that links form chains."""
    rng, rows = random.Random(seed), []
    bases = [words(seed * 10 + k, 90) for k in range(3)]
    for i in range(120):
        w = list(bases[i % 3])
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = f"z{rng.randint(0, 30)}"
        if rng.random() < 0.3:
            w = w[: rng.randint(60, 90)]
        if rng.random() < 0.2:
            w = w + bases[(i + 1) % 3][: rng.randint(0, 40)]
        rows.append((i, " ".join(w), "en", "a"))
    return rows


@pytest.mark.parametrize("per_row, rounds", [(0, 2), (10**9, 8)])
def test_families_need_every_link(spark, per_row, rounds, monkeypatch):
    monkeypatch.setattr(ngram_join, "PAIRS_PER_ROW", per_row)  # only leaders until the last round, or all pairs in the second
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    monkeypatch.setattr(ngram_join, "HOT_SHARE", 1 << 20)
    rows = [(1000 * seed + i, *rest) for seed in range(3, 8) for i, *rest in families(seed)]
    got = [tuple(r) for r in ngram_join.annotated(frame(spark, rows).repartition(5)).collect()]
    assert order(got) == order(plain_components(rows))


def test_members_of_two_documents_need_no_round(spark, monkeypatch):
    """Texts in pairs that share members and no link: their leader has met the other, and no row is carried on."""
    text = lambda i, own: " ".join([f"s{i}x{k}" for k in range(20)] + [f"{own}{i}x{k}" for k in range(20)])
    rows = [(2 * i, text(i, "a")) for i in range(20)] + [(2 * i + 1, text(i, "b")) for i in range(20)]
    open_rows, stored = [], ngram_join.stored

    def watched(df, name):
        out = stored(df, name)
        if name == "prefix-open":
            open_rows.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "stored", watched)
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "doc_id long, text string")
    got = [tuple(r) for r in ngram_join.annotated(docs).collect()]
    assert order(got) == order(plain_components(rows)) and open_rows == [0]


def test_families_in_small_cells(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PAIRS_PER_ROW", 10**9)
    monkeypatch.setattr(ngram_join, "CELL_ROWS", 3)
    rows = [(1000 * seed + i, *rest) for seed in range(3, 6) for i, *rest in families(seed)]
    got = [tuple(r) for r in ngram_join.annotated(frame(spark, rows).repartition(5)).collect()]
    assert order(got) == order(plain_components(rows))


def test_closing_meets_no_component_with_itself(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELL_ROWS", 50)
    members = {1: {10: 600, 11: 1}, 2: {20: 300, 21: 280, 22: 40}, 3: {30: 5}}
    rows = [(m, 1000 * label + i, 90, 1, label) for m, labels in members.items() for label, n in labels.items() for i in range(n)]
    active = spark.createDataFrame(rows, "member long, id long, size long, place int, label long")
    spots = ngram_join.spots_of(active).filter("pairs > 0")
    assert {r.member: (r.n, r.pairs, r.big, r.out) for r in spots.collect()} == {1: (601, 600, 10, 1), 2: (620, 107_200, 20, 320)}
    every, outside = ngram_join.cells(active, spots)
    met = every.join(outside, (F.col("member") == F.col("o_member")) & (F.col("block") == F.col("o_block")) & (F.col("slice") == F.col("o_slice")))
    work = {r.member: (r.n, r.cells, r.most) for r in met.groupBy("member", "block", "slice").count().groupBy("member").agg(F.sum("count").alias("n"), F.count("*").alias("cells"), F.max("count").alias("most")).collect()}
    assert work[1][0] == 601 and work[2][0] == 320 * 620 < 3 * 107_200 and 3 not in work
    assert work[2][1] == 7 * 13 and work[2][2] < 4 * 50 * 50
    differ = met.filter("label <> o_label").select(F.least("id", "o_id"), F.greatest("id", "o_id")).distinct()
    assert differ.count() == 600 + 107_200


def plain_removal(rows):
    found = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    lowest = {}
    for i, w in found:
        for k in range(len(w) - 49):
            if i is not None:
                key = tuple(w[k : k + 50])
                lowest[key] = min(lowest.get(key, i), i)
    out = []
    for i, w in found:
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and lowest[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def removal(docs):
    return [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.deduplicated(docs).collect()]


def by_row(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[3]))


@pytest.mark.parametrize("share", [256, 1, 10**6])
def test_repeated_passages(messy, empty, share, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_SHARE", share)  # from nothing frequent to everything that stands in eight documents
    assert by_row(removal(messy)) == by_row(plain_removal(messy_rows()))
    assert removal(empty) == []


def test_passages_at_every_offset(spark):
    passage = words(77, 51)
    rows = [(1, prose(1, 33) + " " + " ".join(passage) + " " + prose(2, 20), "en", "a")]
    for k in range(14):
        w = passage[: 50 + k % 2] if k < 12 else passage[:49]
        rows.append((10 + k, " ".join(words(100 + k, k) + w + words(200 + k, 13 - k)), "en", "a"))
    assert by_row(removal(frame(spark, rows))) == by_row(plain_removal(rows))
    assert sum(r[2] > 0 for r in plain_removal(rows)) == 12


def test_spans_name_the_words_removed(messy):
    for r in substring_dedup.deduplicated(messy).filter(F.size("removed") > 0).collect():
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:]))


def test_anchors_are_a_part_of_the_windows():
    assert substring_dedup.blocks_held(50, 6) == 7 and substring_dedup.blocks_held(49, 25) == 1
    groups = defaultdict(int)
    for i in range(50):
        hashes = ngram_join.WordHashes().of(prose(i, 400).encode().split())
        values, places, indexed = substring_dedup.anchors(hashes, 50, 6)
        assert (places[indexed] % 6 == 0).all() and len(values) == len(places)
        groups["all"] += 395
        groups["chosen"] += len(places)
    assert groups["chosen"] < 0.35 * groups["all"]
