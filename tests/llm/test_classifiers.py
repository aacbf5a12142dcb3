"""Classifiers by held-out accuracy and on edge rows."""

import numpy as np
import pytest

from conftest import EDGE
from lexiloom.llm import language, quality

LARGER = "/root/testdata/sf0.01"


def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    ranked = np.mean([[g > b for b in bad] for g in good])
    assert ranked > 0.97 and np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)


def test_quality_edges(spark, edge, nothing):
    labels = spark.createDataFrame([(5, 1, 0), (8, 0, 0), (9, 0, 0), (10, 1, 0), (10, 1, 0), (4, None, 0), (None, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    rows = quality.classify(edge, labels).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert quality.classify(nothing, labels).count() == 0
    assert {r.score for r in quality.classify(edge, labels.filter("false")).collect()} == {0.5}


def test_quality_ignores_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - quality ELSE quality END "
                                "AS quality", "toxic")
    score = lambda marks: {r.doc_id: r.score for r in quality.classify(docs, marks).collect()}
    assert score(labels) == score(flipped)


def test_dual_descent_separates():
    rows = [np.array([0, 1]), np.array([0, 2]), np.array([3, 1]), np.array([3, 2])]
    values = [np.full(2, 2**-0.5)] * 4
    w = quality.dual_descent(rows, values, np.array([1, 1, -1, -1.0]), 4, cost=10.0)
    assert [np.sign(w[r] @ v + w[-1]) for r, v in zip(rows, values)] == [1, 1, -1, -1]


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows if r.held_out]) > 0.98
    assert np.mean([r.rejected for r in rows]) < 0.01


def test_language_edges(spark, edge, nothing):
    rows = {r.doc_id: r for r in language.identify(edge).collect()}
    assert len(rows) == len({d for d, _ in EDGE})
    for doc_id in (1, 2, 3):
        assert (rows[doc_id].lang_pred, rows[doc_id].score, rows[doc_id].rejected) == ("und", 0.0, True)
    assert rows[5].lang_pred == "en" and 0 <= rows[5].score <= 1
    assert language.identify(nothing).count() == 0
    unlabelled = edge.withColumn("lang", edge["lang"].substr(99, 1).cast("string")).selectExpr("doc_id", "text", "nullif(lang, '') AS lang")
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}


def test_language_rejects_other_scripts(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    model = language.fit(language.training_rows(docs))
    cyrillic = "все люди рождаются свободными и равными в своём достоинстве и правах " * 20
    assert model.nearest([cyrillic.encode()])[0][2]


@pytest.mark.parametrize("unlearned", ["de", "en", "es", "fr"])
def test_language_rejects_a_language_left_out(spark, unlearned):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    model = language.fit(language.training_rows(docs.filter(docs["lang"] != unlearned)))
    rows = [r for r in docs.select("text", "lang").collect() if r.text and language.LETTER.search(r.text)]
    gone = {own: np.mean([x[2] for x in model.nearest([r.text.encode() for r in rows if (r.lang == unlearned) == own])])
            for own in (True, False)}
    assert gone[True] > 0.95 and gone[False] < 0.01


def test_signs_that_are_no_letters(spark):
    """Superscripts, fractions and letter numbers are no letters; letters of any script are."""
    rows = [(i, t, "en") for i, t in enumerate(["½ ²", "Ⅷ ⅷ", "٣ 12 _ -", "日", "ß", "some text of words", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred == "und" for r in language.identify(docs).collect()} == \
        {0: True, 1: True, 2: True, 3: False, 4: False, 5: False, 6: True}
