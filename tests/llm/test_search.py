"""Hard negatives, licence scans and ranked search against brute force, on the given tables and on edge rows."""

import random
from collections import Counter
from math import floor, inf, log, nan

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import EDGE, SMALL
from lexiloom.llm import hard_negatives, licences, ranked_search
from lexiloom.llm.common import table
from lexiloom.llm.queries import ORACLES, op11_hard_negatives, op12_licences, op13_ranked_search


def sql(name, sf_dir=SMALL):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(ORACLES[name])
    return rel.columns, Counter(rel.fetchall())


def against_sql(df, name):
    columns, want = sql(name)
    assert sorted(df.columns) == sorted(columns)
    assert Counter(tuple(r) for r in df.select(*columns).collect()) == want
    return want


# Hard negatives

def test_hard_negatives_against_sql(spark, monkeypatch):
    assert against_sql(op11_hard_negatives(spark, SMALL), "op11_hard_negatives")
    # Many small blocks of rows and of anchors give the same rows.
    monkeypatch.setattr(hard_negatives, "ROWS", 37)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 2)
    against_sql(op11_hard_negatives(spark, SMALL), "op11_hard_negatives")


def mined(rows, is_anchor, positives, negatives, least, most):
    """(anchor, positive, rank, negative, positive score, negative score) of rows (id, vector, label)."""
    q = [(i, [floor(256 * x) for x in v], label) for i, v, label in rows]
    out = []
    chosen = {}
    for i, v, label in q:
        if is_anchor(i):
            chosen[i] = min(chosen.get(i, (label, v)), (label, v))
    for a, (label, v) in chosen.items():
        scored = [(-sum(x * y for x, y in zip(v, w)), i, other == label) for i, w, other in q if len(w) == len(v)]
        for s, i, _ in sorted(x for x in scored if x[2] and x[1] != a)[:positives]:
            near = sorted(x for x in scored if not x[2] and least * -s <= 100 * -x[0] <= most * -s)[:negatives]
            out += [(a, i, r, j, -s, -t) for r, (t, j, _) in enumerate(near, 1)]
    return Counter(out)


def test_hard_negative_edges(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, -0.25, 0.0, 0.1, 0.5, 1.0]) for _ in range(rng.choice([3, 9, 9, 9]))], rng.randrange(3))
            for i in range(-60, 240)]
    rows += rows[40:60] + rows[40:60]  # repeated rows, ties
    rows += [(0, [0.5] * 9, 2), (300, [], 1), (301, [], 1), (302, [], 2)]
    bad = [(None, [1.0] * 9, 1), (1000, None, 1), (1010, [1.0] * 9, None), (1020, [1.0, None] + [1.0] * 7, 1),
           (1030, [nan] * 9, 1), (1040, [inf] * 9, 1), (1050, [-inf] * 9, 1)]
    schema = "vec_id long, embedding array<float>, label int, rank string, score double"
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows + bad], schema)
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    for size in (8192, 50):
        monkeypatch.setattr(hard_negatives, "ROWS", size)
        for positives, negatives, least, most in ((5, 10, 30, 90), (2, 1, 0, 100)):
            got = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, positives, negatives, least, most).collect()
            assert Counter(map(tuple, got)) == mined(rows, lambda i: i % 10 == 0, positives, negatives, least, most)
    assert hard_negatives.hard_negatives(df.filter("false"), F.col("vec_id") % 10 == 0).count() == 0


def test_scan_thins_and_is_exact():
    rng = np.random.default_rng(3)
    values = rng.integers(-300, 300, (64, 5000))
    values[:, :40] = values[:, :1] + rng.integers(-5, 5, (64, 40))
    anchor, reads = values[:, 0], []

    def thinned(low, high):
        reads.append(len(low))
        return hard_negatives._reaching(low, high, 5)

    rows, scores = hard_negatives.scan(values, values.min(1), values.max(1), anchor, np.arange(5000), thinned)
    assert reads[-1] < 1000  # most candidates go before the last dimensions
    whole = anchor @ values
    assert (scores == whole[rows]).all() and set(np.argsort(-whole, kind="stable")[:5]) <= set(rows.tolist())


# Ranked search

def test_ranked_search_against_sql(spark, monkeypatch):
    assert against_sql(op13_ranked_search(spark, SMALL), "op13_ranked_search")
    # Small shards and several blocks of items give the same rows.
    monkeypatch.setattr(ranked_search, "POSTINGS", 500)
    monkeypatch.setattr(ranked_search, "TERMS_AT_ONCE", 400)
    against_sql(op13_ranked_search(spark, SMALL), "op13_ranked_search")


def ranked(docs, items, k):
    terms = {i: ranked_search.terms_of((t or "").encode()) for i, (_, t) in enumerate(docs)}
    n_docs, n_all = sum(bool(t) for t in terms.values()), sum(map(len, terms.values()))
    df = Counter(w for t in terms.values() for w in set(t))
    out = []
    for item_id, text in items.items():
        scored = []
        for i, own in terms.items():
            tf, score = Counter(own), 0
            for w in ranked_search.terms_of((text or "").encode()):
                if tf[w]:
                    m = 75 + 25 * len(own) * n_docs // n_all
                    score += floor(1000 * log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10 ** 9 * tf[w] // (1000 * tf[w] + 12 * m))
            if score > 0:
                scored.append((-score, docs[i][0] is not None, docs[i][0] or 0))
        out += [(item_id, r, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def test_ranked_search_edges(spark, edge, nothing, monkeypatch):
    items = [(1, "One two three SAID twice"), (2, None), (3, "word word été"), (4, "missing"), (None, "id no Repeated"), (5, ""),
             (6, "x" * 50_000), (7, "one"), (7, "three"), (7, None)]
    df = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, rank int")
    texts = {i: min((t for j, t in items if j == i and t is not None), default=None) for i, _ in items}
    for k in (1, 3, 20):
        want = ranked(EDGE, texts, k)
        assert want and Counter(map(tuple, ranked_search.search(edge, df, k).collect())) == want
    assert ranked_search.search(nothing, df).count() == 0 and ranked_search.search(edge, df.filter("false")).count() == 0


def test_best_positions_stop_early():
    """Lists that agree stop long before their ends, and ties at the k-th place are all found."""
    rng = np.random.default_rng(1)
    n, lists = 20_000, 6
    base = rng.zipf(1.6, n).clip(max=10 ** 5)
    docs, terms = np.tile(np.arange(n), lists), np.repeat(np.arange(lists), n)
    impacts = np.concatenate([base + rng.integers(0, 3, n) for _ in range(lists)])
    shard = ranked_search.Shard(docs, terms, impacts, lists)
    met = []
    plain, np.unique = np.unique, lambda x, *a, **b: met.append(len(x)) or plain(x, *a, **b)
    try:
        got, scores = shard.top(np.arange(lists), np.full(lists, 2), 10)
    finally:
        np.unique = plain
    whole = 2 * impacts.reshape(lists, n).sum(axis=0)
    kth = np.sort(whole)[-10]
    assert sorted(got) == np.flatnonzero(whole >= kth).tolist() and (whole[got] == scores).all()
    assert sum(met) < n  # of 6 n postings


# Licence scans

def by_hand(text):
    words = ranked_search.terms_of((text or "").encode())
    places = [(i, label) for phrase, label in licences.PHRASES for p in [phrase.encode().split()]
              for i in range(len(words)) if words[i:i + len(p)] == p]
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), \
        ",".join(sorted({x for _, x in places}))


def test_licence_base_columns(spark, edge, nothing):
    rows = op12_licences(spark, SMALL).collect()
    texts = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == by_hand(texts[r.doc_id])
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    got = licences.digests(licences.scan(edge)).collect()
    assert Counter((r.doc_id, r.n_words, r.labels) for r in got) == Counter((i, by_hand(t)[0], "") for i, t in EDGE)
    assert licences.scan(nothing).count() == 0


def test_phrases_in_odd_places(spark):
    texts = ["mit license MIT-License mit\nlicense mitlicense mit licenses apache apache license", "Apache License" * 3,
             "the GNU lesser general public license, general public general public license", "été mit\tlicense\x00mit license é",
             "mit " * 1000 + "license", "mit license " * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licences.digests(licences.scan(df)).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == by_hand(texts[r.doc_id])


def test_matching_statistics_by_brute_force():
    rng = random.Random(11)
    for _ in range(60):
        letters = [bytes([c]) for c in b"abcd"[:rng.randrange(1, 5)]]
        sequences = [[rng.choice(letters) for _ in range(rng.randrange(1, 12))] for _ in range(rng.randrange(1, 5))]
        automaton = licences.Automaton(sequences)
        words = [rng.choice([*letters, b"z"]) for _ in range(60)]
        runs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        for i, (state, length) in enumerate(automaton.statistics(words)):
            want = max((n for n in range(i + 2) if n == 0 or tuple(words[i - n + 1:i + 1]) in runs))
            assert length == want
            if length:
                run = words[i - length + 1:i + 1]
                assert automaton.ends[state] == {(n, e) for n, s in enumerate(sequences) for e in range(length - 1, len(s))
                                                 if s[e - length + 1:e + 1] == run}


def best_cover(scanner, matches, template):
    """Most words of a chain of one template, over all chains."""
    own = [(f, l, e - (l - f), e) for f, l, s in matches for t, e in scanner.places[s] if t == template]
    best = 0

    def follow(i, covered):
        nonlocal best
        best = max(best, covered)
        for j in range(i + 1, len(own)):
            shared = max(own[i][1] - own[j][0] + 1, own[i][3] - own[j][2] + 1, 0)
            if own[j][0] - own[i][1] <= licences.GAP and own[j][2] - own[i][3] <= licences.GAP \
                    and own[i][1] < own[j][1] and own[i][3] < own[j][3]:
                follow(j, covered + own[j][1] - own[j][0] + 1 - shared)

    for i in range(len(own)):
        follow(i, own[i][1] - own[i][0] + 1)
    return best


def test_edited_templates_are_chained(spark):
    scanner = licences.scanner(licences.PHRASES, licences.TEMPLATES)
    rng = random.Random(2)
    for label, text in licences.TEMPLATES:
        words = ranked_search.terms_of(text.encode())
        whole = scanner.spans([b"some", b"prose", *words, b"and", b"more"])
        assert any(s[0] == label and s[4] == 1.0 and s[1] == 2 for s in whole)
        if len(words) < 30:
            continue
        cut = list(words)
        for i in sorted(rng.sample(range(len(words)), 3), reverse=True):
            cut[i:i + 1] = rng.choice([[], [b"changed"], [b"two", b"more"]])
        assert any(s[0] == label and s[4] > 0.6 for s in scanner.spans(cut))
        assert not [s for s in scanner.spans(words[:len(words) // 4]) if s[0] == label and not s[5] and s[4] >= 1]
        for template in range(scanner.phrases, len(scanner.labels)):
            matches = scanner.hits(cut)[1]
            chained = max((c for t, _, _, c in scanner.chains(matches) if t == template), default=0)
            assert chained <= best_cover(scanner, matches, template) and (chained > 0) == (best_cover(scanner, matches, template) > 0)
    # Clean prose and stray licence words give nothing.
    assert scanner.spans(b"permission to copy the license of this software was the public domain of apache".split()) == []


def test_templates_must_have_words():
    with pytest.raises(ValueError):
        licences.Scanner((("...", "x"),), ())
