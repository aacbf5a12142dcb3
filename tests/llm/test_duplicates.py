"""Suffix deduplication and near-duplicates of texts and vectors against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from conftest import EDGE
from lexiloom.llm import cap_filters, near_duplicates, suffixes
from lexiloom.llm.components import components


def sha(data):
    return hashlib.sha256(bytes(data)).hexdigest()


def brute_suffixes(docs):
    seen, out = set(), {}
    for doc_id, text in sorted(dict(docs).items(), key=lambda d: (d[0] is not None, d[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            window = data[i:i + 100]
            if window in seen:
                gone[i:i + 100] = b"\1" * 100
            seen.add(window)
        runs = sum(1 for i in range(len(data)) if gone[i] and not (i and gone[i - 1]))
        out[doc_id] = (len(data), sum(gone), runs, sha(x for x, g in zip(data, gone) if not g))
    return out


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def repeating_docs(seed=5, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefé ") for _ in range(rng.randrange(2, 9))) for _ in range(60)]
    passages = [prose(rng, words, 40) for _ in range(8)]
    line = "This common line stands in a third of all texts, so that its places must be spread over many ranges of the sort."
    docs = []
    for i in range(n):
        text = prose(rng, words, rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 3)):
            passage = rng.choice(passages)
            text += passage[rng.randrange(len(passage)):] + prose(rng, words, 10)
        docs.append((i * 7, text + (line + text[:5]) * (i % 3 == 0)))
    docs += [(5000 + i, docs[i % 9][1]) for i in range(20)]
    return docs + [(9001, "ab" * 300), (9002, "x" * 100), (9003, "x" * 100), (9004, "y" * 99)]


def suffix_rows(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, sha(r.kept)) for r in suffixes.without_repeats(df).collect())


@pytest.mark.parametrize("ranges", ["few", "many"])
def test_suffixes(spark, monkeypatch, ranges):
    if ranges == "many":
        monkeypatch.setattr(suffixes, "SAMPLE_BYTES", 3000)
        monkeypatch.setattr(suffixes, "ROWS_PER_RANGE", 100)
    docs = repeating_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert suffix_rows(df) == Counter((k, *v) for k, v in brute_suffixes(docs).items())


def test_suffix_edges(edge, nothing):
    want = brute_suffixes(EDGE)
    assert suffix_rows(edge) == Counter((d, *want[d]) for d, _ in EDGE)
    assert suffixes.without_repeats(nothing).count() == 0
    clean = suffixes.cleaned(edge)
    assert clean.columns == edge.columns
    rows = {r.doc_id: r for r in clean.collect()}
    assert rows[1].text is None and rows[2].text == "" and rows[5].text == "One two three." and rows[5].row == "r"


def test_multikey_order():
    rng = np.random.default_rng(2)
    keys = [rng.integers(0, 4, 500).astype(np.uint64) for _ in range(4)]
    order, fresh = suffixes.multikey_order(keys)
    rows = list(zip(*(k.tolist() for k in keys)))
    got = [rows[i] for i in order]
    assert got == sorted(rows)
    for k in range(4):
        assert fresh[k].tolist() == [i == 0 or got[i][:k + 1] != got[i - 1][:k + 1] for i in range(500)]


def test_range_of():
    rng = np.random.default_rng(3)
    columns = {c: rng.integers(0, 5, 300).astype(np.int64) for c in "abc"}
    cuts = sorted(zip(*(rng.integers(0, 5, 40).tolist() for _ in "abc")))
    got = suffixes.range_of(columns, ["a", "b", "c"], [np.array(x, np.int64) for x in zip(*cuts)])
    rows = list(zip(*(columns[c].tolist() for c in "abc")))
    assert got.tolist() == [sum(cut <= row for cut in cuts) for row in rows]


def brute_groups(links, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingle_sets(docs, words):
    pattern, out = re.compile(rb"[^\x20\x09-\x0D]+"), {}
    for doc_id, text in docs:
        found = pattern.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
        out[doc_id] = {tuple(found[i:i + words]) for i in range(max(len(found) - words + 1, 1))} if found else set()
    return out


def brute_near(docs, words, percent=80):
    sets, places, links = shingle_sets(docs, words), {}, []
    for d, s in sets.items():
        for x in s:
            places.setdefault(x, []).append(d)
    for d, s in sets.items():
        for e, k in Counter(e for x in s for e in places[x] if e < d).items():
            if 100 * k >= percent * (len(s) + len(sets[e]) - k):
                links.append((d, e))
    root = brute_groups(links, sets)
    return {d: (len(sets[d]), root[d], root[d] == d) for d in sets}


def near_copies(n=300):
    """Copies at all distances around one text: chains, stars and pairs just under the threshold."""
    rng = random.Random(3)
    base = [str(rng.randrange(10**6)) for _ in range(120)]
    docs = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 3, 4, 5, 6])):
            words[rng.randrange(120)] = str(rng.randrange(10**6))
        docs.append((i, " ".join(words)))
    return docs + [(2000 + i, docs[i % 7][1].upper()) for i in range(30)]


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates(spark, words):
    docs = near_copies() + [(-(1 << 40) if d is None else d + 10_000, t) for d, t in EDGE if d != 12]
    got = near_duplicates.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), words)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute_near(docs, words)


def test_near_duplicates_without_pivots(spark, monkeypatch):
    """The comparison of blocks alone finds all links too."""
    monkeypatch.setattr(near_duplicates, "PIVOT_ROUNDS", 0)
    monkeypatch.setattr(near_duplicates, "BLOCK", 16)
    docs = near_copies(120)
    got = near_duplicates.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 4)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute_near(docs, 4)


def test_near_duplicate_edges(edge, nothing):
    rows = near_duplicates.near_duplicates(edge, 4).collect()
    assert len(rows) == len(EDGE)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[6].component_id == 5 and not by_id[6].kept and by_id[11].component_id == 10
    assert all(by_id[i].n_shingles == 0 and by_id[i].kept for i in (1, 2, 3))
    assert by_id[None].component_id is None and by_id[12].kept
    assert near_duplicates.near_duplicates(nothing, 4).count() == 0


def test_signatures_estimate_similarity():
    rng, errors = np.random.default_rng(1), []
    for n in (3, 40, 600):
        for _ in range(40):
            common = rng.integers(0, 2**63, int(n * 0.9), dtype=np.uint64)
            x, y = (np.unique(np.append(common, rng.integers(0, 2**63, n - len(common), dtype=np.uint64))) for _ in "xy")
            marks = near_duplicates.signatures_of(np.append(x, y), np.array([0, len(x), len(x) + len(y)]))
            assert (marks >> np.uint64(32)).max() < near_duplicates.SLOTS  # every place is filled
            errors.append((marks[0] == marks[1]).mean() - len(np.intersect1d(x, y)) / len(np.union1d(x, y)))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    links += [(2000, 2001 + i) for i in range(200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == brute_groups(links, nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors():
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=32).tolist()) for i in range(200)]
    centre = rng.normal(size=32)
    rows += [(500 + i, (centre + 0.2 * rng.normal(size=32)).tolist()) for i in range(60)]
    rows += [(700 + i, centre.tolist()) for i in range(20)] + [(800, (centre * 7).tolist()), (801, (-centre).tolist())]
    return rows + [(900, None), (901, [0.0] * 32), (902, [None] + [1.0] * 31), (903, [float("nan")] * 32),
                   (904, [float("inf")] * 32), (905, []), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [1e200] * 32)]


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(cap_filters, "MEMBERS", 16)
    rows = vectors()
    good = {i: np.array(v, float) for i, v in rows
            if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = []
    for a, x in good.items():
        for b, y in good.items():
            if a < b and len(x) == len(y):
                x1, y1 = x / np.abs(x).max(), y / np.abs(y).max()
                if x1 @ y1 / np.sqrt((x1 @ x1) * (y1 @ y1)) >= 0.9:
                    links.append((a, b))
    root, degree = brute_groups(links, [i for i, _ in rows]), Counter(n for link in links for n in link)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS n_links", "'x' AS component")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cap_filters.near_vectors(df).collect()}
    want = {i: (degree[i], root[i], root[i] == i) for i, _ in rows}
    found = sum(got[i][0] for i in got) / max(1, sum(degree.values()))
    assert set(got) == set(want) and 0.98 <= found <= 1
    assert sum(got[i] != want[i] for i in want) <= 0.1 * len(want)
    assert cap_filters.near_vectors(df.filter("false")).count() == 0


def test_filters_find_near_pairs():
    rng, hits = np.random.default_rng(5), 0
    code = cap_filters.code_for(64, 24)
    for _ in range(300):
        x, y = rng.normal(size=(2, 64))
        x /= np.linalg.norm(x)
        y -= (x @ y) * x
        y = 0.9 * x + np.sqrt(1 - 0.81) * y / np.linalg.norm(y)
        first, second = code.decode(np.stack([x, y]))
        sets = [set(zip(a.tolist(), b.tolist())) for a, b in zip(first, second)]
        hits += not sets[0].isdisjoint(sets[1])
    assert hits / 300 >= 0.95


@pytest.mark.parametrize("length, vectors", [(64, 20_000), (64, 1_000_000), (64, 10_000_000), (64, 60_000_000),
                                             (3, 1_000_000), (8, 10_000_000)])
def test_filters_keep_their_recall_at_every_size(length, vectors):
    words = cap_filters.code_words(vectors)
    code = cap_filters.code_for(length, words, cap_filters.filters_for(length, words, 0.9))
    found = cap_filters.ranks_shared(code, *cap_filters.pairs_at(0.9, length, 1000, seed=4)) > 0
    assert found.mean() >= 0.995


def test_short_vectors(spark):
    x, y = cap_filters.pairs_at(0.901, 4, 300, seed=6)
    rows = np.concatenate([x, y])
    want = (rows @ rows.T >= 0.9).sum() - len(rows)
    df = spark.createDataFrame(list(enumerate(rows.tolist())), "vec_id long, embedding array<double>")
    got = sum(r.n_links for r in cap_filters.near_vectors(df).collect())
    assert 0.995 * want <= got <= want


def test_vectors_travel_as_sketches_of_their_groups(spark):
    """A task deals one row of bytes to a group; before, each vector was written whole for every first half it passes."""
    rows = np.random.default_rng(9).normal(size=(3000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "id long, vector array<double>").coalesce(1)
    classes = df.mapInArrow(cap_filters.coded, "id long, vector binary").selectExpr("id AS class", "id AS rep", "64 AS length", "vector")
    shapes = cap_filters.shapes_for(classes, 0.9)
    dealt = cap_filters.filtered(classes, shapes, {}).collect()
    assert len(dealt) <= shapes[64].words
    assert sum(len(r["sketch"]) for r in dealt) <= 12 * rows.size  # a quarter of a copy of the doubles, twelve times
    assert sum(np.frombuffer(r["sizes"], "<u4").sum() for r in dealt) == 3000 * shapes[64].filters


def test_sketches_bound_cosines():
    rng = np.random.default_rng(10)
    for length in (1, 2, 7, 64, 1000):
        x = rng.normal(size=(400, length)) * rng.choice([1e-9, 1e-3, 1.0, 50.0], (400, length))
        unit = cap_filters._unit(x)
        bytes_, scale, missed = cap_filters.sketches(unit)
        near = bytes_ * scale[:, None].astype(float)
        off = missed[:, None].astype(float) + missed + missed[:, None].astype(float) * missed
        assert (np.abs(unit @ unit.T - near @ near.T) <= off + 1e-12).all()


def test_crowds_and_cosines_at_the_edge(spark, monkeypatch):
    """More vectors of one filter than are compared at once, and pairs whose sketches cannot tell."""
    rng = np.random.default_rng(12)
    centre = rng.normal(size=64)
    crowd = centre + 0.02 * rng.normal(size=(400, 64))
    x, _ = cap_filters.pairs_at(0.5, 64, 60, seed=1)
    y = np.concatenate([cap_filters.pairs_at(c, 64, 60, seed=1)[1][i:i + 1] for i, c in enumerate([0.9 + 1e-9, 0.9 - 1e-9] * 30)])
    rows = np.concatenate([crowd, x, y])
    unit = cap_filters._unit(rows)
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    for members in (1 << 18, 100):
        monkeypatch.setattr(cap_filters, "MEMBERS", members)
        got = np.array([r.n_links for r in cap_filters.near_vectors(df).orderBy("vec_id").collect()])
        assert (got[:400] == want[:400]).all() and (got <= want).all() and (got[400:] != want[400:]).sum() <= 2


def test_vectors_with_the_same_id(spark):
    """An id may stand for several vectors and rows; components and single precision tell vectors apart."""
    x = np.random.default_rng(4).normal(size=(3, 8))
    rows = [(1, x[0]), (1, x[0]), (1, -x[0]), (2, x[0] * (1 + 1e-12)), (3, x[1].astype(np.float32)), (None, x[2]), (None, x[2])]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in cap_filters.near_vectors(df).collect())
    assert got[(3, 0, 3)] == 1 and got[(None, 1, None)] == 2 and sum(got.values()) == 7
    assert {i: n for i, n, _ in got if i == 2} == {2: 3}


def test_long_words_of_two_letters_differ(spark):
    """A word over two letters and its letter-swapped twin, in the order that cancels sums of powers modulo 2^64."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    twin = word.translate(str.maketrans("ab", "ba"))
    rows = [(i, f"one two three {w} four five") for i, w in enumerate((word, twin, word[:64], twin[:64]))]
    found = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()
    assert all(r.kept and r.component_id == r.doc_id for r in found)


@pytest.mark.parametrize("places", [1 << 26, 1 << 10])
def test_only_wanted_texts_are_cut(spark, monkeypatch, places):
    """Marks let all wanted documents pass and few others; with too many for their places the result is the same."""
    monkeypatch.setattr(near_duplicates, "MARK_BITS", places)
    docs = spark.createDataFrame([(7 * i - 500, f"one two three {i}") for i in range(2000)] * 2, "doc_id long, text string")
    wanted = docs.filter("doc_id % 5 = 0").select(docs.doc_id.alias("rep")).distinct()
    want = {r.rep for r in wanted.collect()}
    rows = near_duplicates._likely(near_duplicates._rows_of(docs), wanted).collect()
    assert want <= {r.doc for r in rows} and len(rows) <= (4000 if places < 1 << 20 else 1100)
    got = near_duplicates.shingle_sets(docs, wanted, 4).collect()
    assert sorted(r.rep for r in got) == sorted(want)
    assert near_duplicates.shingle_sets(docs, wanted.filter("false"), 4).count() == 0


def test_texts_meet_their_spans_in_a_stage_of_their_own(spark):
    """However small the other side is: a Python step on either side of a broadcast would take two workers a task."""
    texts = suffixes._squeezed(suffixes._keyed(spark.createDataFrame([(1, "a b")], "doc_id long, text string")))
    spans = spark.range(1).selectExpr("id doc", "id twin", "array(1) starts")
    plan = texts.join(suffixes._dealt(spans), ["doc", "twin"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
