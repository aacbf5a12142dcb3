"""Fingerprints and URL rules against plain Python, on their own plans and on edge rows."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from conftest import EDGE, SMALL
from lexiloom.llm import fingerprints, url_rules
from lexiloom.llm.queries import RULES, op3_fingerprints, op4_url_rules


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_plans_hold_no_python(spark):
    assert no_python(op3_fingerprints(spark, SMALL)) and no_python(op4_url_rules(spark, SMALL))


@pytest.mark.parametrize("per_range", [512, 2])
def test_fingerprint_edges(edge, nothing, monkeypatch, per_range):
    monkeypatch.setattr(fingerprints, "ROWS_PER_RANGE", per_range)
    rows = fingerprints.edited_fingerprints(edge).collect()
    ordered = sorted(((d, t or "") for d, t in EDGE), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = {}
    for (doc_id, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        want.setdefault(doc_id, []).append((len(text), sha256(edited.encode()).hexdigest(), text))
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.n_chars, r.edited_sha256))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(x[:2] for x in v) for k, v in want.items()}
    prints = {r.doc_id: r.fingerprint for r in rows}
    assert prints[10] == prints[11] and prints[1] == prints[2] != prints[3]
    assert {r.near_next for r in rows if r.doc_id == 10} == {1.0}
    assert fingerprints.edited_fingerprints(nothing).count() == 0


def test_edits_are_located(spark):
    a = "One, two.\nThree four.\n\nFive.\nSix, seven. Eight."
    b = "One, two.\nThree 4.\n\nFive.\nSix, seven. Nine."
    df = spark.createDataFrame([(a, b), (a, a), (a, "")], "a string, b string").select(
        fingerprints.edits(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))).alias("e"),
        fingerprints.likeness(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))).alias("l"))
    rows = df.collect()
    assert [(x.section, x.paragraph) for x in rows[0].e] == [(0, 1), (1, 1)] and 0 < rows[0].l < 1
    assert rows[1].e == [] and rows[1].l == 1.0
    assert rows[2].l == 0.0


def judged(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    end = min([i for i in (rest.find(c, cut) for c in "?#") if i >= 0], default=len(rest))
    path = rest[cut:end]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, default, None))
    return host, path, best[3], best[2]


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x?y#z", "http://example.org/en/1", "http://example.org/en/12/3",
        "http://badexample.org/es/", "https://x.com/fr/a", "https://x.com/fr", "https://x.com?a=/fr/", "ftp://x.y.com/de/#q",
        "http://org/", "http://org", "http://a.b://c.org/de/", "http://É.com/fr/ü", "x://com/de/\nline", "http://example.org/.*",
        "http://x.com/fr/a", "http://x.com/fr/a"]


def test_urls(spark):
    more = [*RULES, ("Example.org", "/.*", "block"), ("net", "", "block"), ("x.com", "/fr/a", "block"), ("com", "/fr/a", "allow")]
    lowered = [(h.lower(), p, v) for h, p, v in more]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)], "page_id long, url string, host string, tokens string")
    rules = spark.createDataFrame(more, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, rules).collect()}
    assert got == {i: judged(u, lowered) for i, u in enumerate(URLS)}
    assert url_rules.judge_urls(pages.filter("false"), rules).count() == 0
    assert {r.verdict for r in url_rules.judge_urls(pages, rules.filter("false"), "block").collect()} == {"block"}


def test_rules_are_filed_under_their_rarest_token(spark):
    rules = url_rules.compiled(spark.createDataFrame(RULES, "host string, path string, verdict string"))
    tokens = spark.createDataFrame([("h org",)] * 9 + [("h example",)] * 5 + [("p es",), ("",)], "token string")
    index = {r.rule: r.token for r in url_rules.indexed(rules, tokens).collect()}
    assert index["example.org/es/"] == "p es" and index["example.org/en/1"] == "p en" and index["org/"] == "h org"
