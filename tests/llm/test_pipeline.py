"""Each stage of the pipeline against its brute-force version on its own input."""

from collections import Counter

import corpus_pipeline
from test_duplicates import brute_near, brute_suffixes, sha

from conftest import SMALL
from lexiloom.llm import language, quality
from lexiloom.llm.common import table, written


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    labels = table(spark, SMALL, "labels")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = written(stage(spark, docs, SMALL), name)
        if name == "quality":
            scores = {r.doc_id: r.predicted for r in quality.classify(table(spark, SMALL, "documents"), labels).collect()}
            assert rows_of(docs) == Counter(tuple(r) for r in before if scores[r.doc_id])
        elif name == "language":
            assert all(r.text and any(map(str.isalpha, r.text)) for r in docs.collect())
            assert docs.count() > 0.97 * sum(any(map(str.isalpha, r.text or "")) for r in before)
        elif name == "near_duplicates":
            kept = brute_near([(r.doc_id, r.text) for r in before], 5)
            assert rows_of(docs) == Counter(tuple(r) for r in before if kept[r.doc_id][2])
        elif name == "suffixes":
            want = brute_suffixes([(r.doc_id, r.text) for r in before])
            after = {r.doc_id: r for r in docs.collect()}
            assert len(after) == len(before)
            for r in before:
                if not want[r.doc_id][1]:
                    assert after[r.doc_id] == r
                elif sum(map(len, (after[r.doc_id].text.encode(),))) == want[r.doc_id][0] - want[r.doc_id][1]:
                    assert sha(after[r.doc_id].text.encode()) == want[r.doc_id][3]
                assert after[r.doc_id].n_chars == len(after[r.doc_id].text)
        else:
            total = sum(r.length for r in docs.collect())
            assert {r.doc_id for r in docs.select("doc_id").collect()} == {r.doc_id for r in before}
            assert total == sum(r.doc_tokens for r in docs.dropDuplicates(["doc_id"]).collect())


def test_edges(spark, edge, nothing):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, edge, SMALL)
        assert out.columns == edge.columns and {f.dataType for f in out.schema} <= {f.dataType for f in edge.schema}
        assert out.count() <= edge.count()
        assert stage(spark, nothing, SMALL).count() == 0
    assert sum(r.doc_id == 12 for r in corpus_pipeline.near_duplicates_stage(spark, edge, SMALL).collect()) == 1
    texts = {r.doc_id for r in corpus_pipeline.language_stage(spark, edge.withColumn("lang", edge["lang"]), SMALL).collect()}
    assert not texts & {1, 2, 3}


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    assert language.UNKNOWN == "und"
