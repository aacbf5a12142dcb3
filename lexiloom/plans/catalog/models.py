"""Feature pipelines, learners, folds and the benchmark; random by nature, so rows only."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.arrays import cells
from lexiloom.operators import models
from lexiloom.operators.lookup import TargetMeanEncoder
from lexiloom.operators.models import Nystroem
from lexiloom.operators.ridge import RidgeCV
from lexiloom.operators.splits import shuffle_folds, stratified_folds
from lexiloom.plans.benchmark import Settings, run_benchmark
from lexiloom.plans.catalog.common import rounded, table
from lexiloom.plans.features import column_transformer, fit_predict_fold
from lexiloom.roles import ColumnRoles
from lexiloom.session import checkpointed, portions, scratch_path

PART_ROLES = ColumnRoles({"p_type": "OneHotEncoderDense", "p_size": "Numerical", "p_brand": "TargetEncoder",
                          "p_retailprice": "y"}, "regression")
TEXT_ROLES = ColumnRoles({"lang": "OneHotEncoderDense-1", "n_chars": "Numerical", "source": "Special", "y": "y"}, "binary")


def _documents(spark, sf_dir):
    """Labelled documents: the target is quality."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").withColumn("y", F.col("quality")).select(
        "doc_id", "lang", "source", "n_chars", "toxic", "y")


# Bytes of points a partition holds where many fits pass over them.
POINT_BYTES = 8 << 20


def _dealt(points):
    """Points for many fits: those of a large table in bounded partitions, so that a pass uses all cores."""
    kept = checkpointed(points)
    parts = portions(kept, F.lit(8) * F.size(F.coalesce(vector_to_array("features"), F.array())), POINT_BYTES)
    return checkpointed(kept.repartition(parts)) if parts else kept


def _points(spark, sf_dir, target, dims=None):
    e = table(spark, sf_dir, "embeddings")
    from pyspark.ml.functions import array_to_vector

    return e.select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"),
                    target.alias("label"))


def column_transformer_query(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    coded = column_transformer(PART_ROLES, "MinHashEncoder").fit(part).transform(part)
    return cells(coded, [], vector_to_array("_raw")).groupBy("component").agg(rounded(F.sum("value"), 3).alias("total"))


def _predictions(model, points):
    return model.transform(points).select("vec_id", "label", F.col("prediction").alias("prediction"))


def linear_classifier(spark, sf_dir):
    points = checkpointed(_points(spark, sf_dir, F.col("label").cast("double")))
    return _predictions(models.linear_model("multiclass", "features", "label", None, 0).fit(points), points)


def linear_classifier_balanced(spark, sf_dir):
    points = _points(spark, sf_dir, (F.col("label") == 0).cast("double"))
    weighted = checkpointed(models.balanced_weights(points, "label"))
    return _predictions(models.linear_model("binary", "features", "label", "weight", 0).fit(weighted), weighted)


def ridge(spark, sf_dir):
    """Ridge regression of the price, its penalty chosen over three folds that follow from the line's key."""
    digest = F.md5(F.concat_ws("|", "l_orderkey", "l_linenumber"))
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("vec_id"), "l_quantity", "l_discount", F.col("l_extendedprice").alias("label"),
        (F.conv(F.substring(digest, 1, 6), 16, 10).cast("long") % 3).alias("fold"))
    points = VectorAssembler(inputCols=["l_quantity", "l_discount"], outputCol="features").transform(lines)
    predicted = _predictions(RidgeCV(foldCol="fold").fit(points), points)
    return predicted.withColumn("label", rounded("label", 2)).withColumn("prediction", rounded("prediction", 4))


def ridge_coefficients(spark, sf_dir):
    """Coefficients, penalty and scores of a wider ridge: an embedding's label from its other numbers."""
    points = _points(spark, sf_dir, F.col("label").cast("double"))
    model = RidgeCV(penalties=[0.01, 0.1, 1.0, 10.0, 100.0]).fit(points)
    rows = [(i, float(w)) for i, w in enumerate([*model.coefficients, model.intercept, model.penalty])]
    return spark.createDataFrame(rows, "component bigint, value double").withColumn("value", rounded("value", 6))


def gradient_boosting(spark, sf_dir):
    points = checkpointed(_points(spark, sf_dir, (F.col("label") < 3).cast("double")))
    return _predictions(models.boosting("binary", "features", "label", 0)[0].fit(points), points)


def gradient_boosting_multiclass(spark, sf_dir):
    points = checkpointed(_points(spark, sf_dir, F.least(F.col("label"), F.lit(2)).cast("double")))
    return _predictions(models.boosting("multiclass", "features", "label", 0, 5)[0].fit(points), points)


def boosting_grid(spark, sf_dir):
    points = checkpointed(_points(spark, sf_dir, (F.col("label") < 3).cast("double")))
    grid = models.boosting_grid("binary", "features", "label", 0, (0.1, 0.3), (2, 3), trees=3)
    return _predictions(grid.fit(points), points)


def mlp_classifier(spark, sf_dir):
    points = checkpointed(_points(spark, sf_dir, F.col("label").cast("double")))
    return _predictions(models.mlp("features", "label", 64, points.select("label").distinct().count()).fit(points), points)


def grid_search(spark, sf_dir):
    points = checkpointed(_points(spark, sf_dir, F.col("label").cast("double")))
    classes = points.select("label").distinct().count()
    grid = models.mlp_grid("multiclass", "features", "label", 64, classes, 0, rates=(0.001,), shapes=((30,), (30, 30)))
    return _predictions(grid.fit(points), points)


def nystroem(spark, sf_dir):
    points = _points(spark, sf_dir, F.col("label").cast("double"))
    approx = Nystroem(inputCol="features", outputCol="kernel", nComponents=40, degree=2, seed=3).fit(points)
    coded = approx.transform(points)
    return cells(coded, ["vec_id"], vector_to_array("kernel")).withColumn("value", rounded("value", 4))


def nystroem_linear(spark, sf_dir):
    points = _dealt(_points(spark, sf_dir, F.col("label").cast("double")))
    return _predictions(models.nystroem_linear("multiclass", "features", "label", None, 0, (20,), (2,)).fit(points), points)


def _fold_rows(spark, rows):
    return spark.createDataFrame([(int(r[0]), int(r[1]), int(r[2]), float(r[3])) for r in rows],
                                 "fold bigint, n_train_samples bigint, n_train_features bigint, score double")


def fit_predict_fold_query(spark, sf_dir):
    """Two folds of the labelled documents with the tuned linear classifier."""
    folds = checkpointed(stratified_folds(_documents(spark, sf_dir), ["doc_id"], "y", 2, 1 / 3, 1))
    learner = lambda task, features, label, width, weight: models.build_estimator(
        "L2RegularizedLinearModel", task, features, label, width, 2, weight)
    results = []
    for fold in range(2):
        tested = F.array_contains("test_folds", fold)
        results.append(fit_predict_fold(folds.filter(~tested), folds.filter(tested), TEXT_ROLES, "MinHashEncoder", None, 10, learner, fold))
    return _fold_rows(spark, results)


def fold_target_means(spark, sf_dir):
    """Target-mean codes of 20 folds' training rows, all from one aggregation by string and fold."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.col("p_retailprice").alias("y"))
    folds = checkpointed(shuffle_folds(part, ["p_partkey"], 20, 1 / 3, 3))
    encoder = TargetMeanEncoder(inputCol="p_type", outputCol="code", labelCol="y")
    codes = [m.tables["codes"].select(F.lit(f).cast("bigint").alias("fold"), "key", F.col("code")[0].alias("value"))
             for f, m in enumerate(encoder.fit_folds(folds, 20))]
    return reduce(DataFrame.unionAll, codes).withColumn("value", rounded("value", 4))


def benchmark_matrix(spark, sf_dir):
    """Twenty folds of the parts with two encoders and the tuned ridge, each run stored once."""
    path = scratch_path(spark, "benchmark")
    source = {"part": lambda s: (table(s, sf_dir, "part").select("p_partkey", *PART_ROLES.roles), PART_ROLES, ["p_partkey"], -1)}
    for _ in range(2):  # the second call finds every run stored
        done = run_benchmark(spark, source, ["TargetEncoder", "MinHashEncoder"], [None], ["L2RegularizedLinearModel"], path,
                             Settings(n_components=30))
    return done.select("config_key", "fold", "n_train_samples", "n_train_features", "score")


QUERIES = {
    "column_transformer": column_transformer_query, "fit_predict_fold": fit_predict_fold_query, "fold_target_means": fold_target_means,
    **{f.__name__: f for f in (
        linear_classifier, linear_classifier_balanced, ridge, ridge_coefficients, gradient_boosting, gradient_boosting_multiclass,
        boosting_grid, mlp_classifier, grid_search, nystroem, nystroem_linear, benchmark_matrix)}}

ORACLES = {
    "fold_target_means": """
        WITH ranked AS (SELECT f, p_type AS key, p_retailprice AS y, row_number() OVER (PARTITION BY f
                            ORDER BY md5(p_partkey || '|' || f || '|3'), p_partkey) AS r, count(*) OVER (PARTITION BY f) AS n
                        FROM part, range(20) AS folds(f)),
        train AS (SELECT f, key, y FROM ranked WHERE r > ceil(n * (1e0 / 3))),
        t AS (SELECT f, key, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS s FROM train GROUP BY 1, 2),
        a AS (SELECT f, sum(n) / count(*) AS prior, sum(s) / sum(n) AS mean FROM t GROUP BY 1)
        SELECT f::BIGINT AS fold, key, round(n / (n + prior) * s / n + (1 - n / (n + prior)) * mean, 4) + 0.0e0 AS value FROM t JOIN a USING (f)""",
    "ridge": """
        WITH l AS (SELECT l_orderkey AS vec_id, l_quantity::DOUBLE AS p, l_discount::DOUBLE AS q, l_extendedprice::DOUBLE AS y,
                          ('0x' || substr(md5(l_orderkey || '|' || l_linenumber), 1, 6))::BIGINT % 3 AS f FROM lineitem),
        part AS (SELECT f, count(*)::DOUBLE AS n, sum(p) AS p, sum(q) AS q, sum(y) AS y, sum(p * p) AS pp, sum(p * q) AS pq, sum(q * q) AS qq,
                        sum(p * y) AS py, sum(q * y) AS qy, sum(y * y) AS yy FROM l GROUP BY 1),
        total AS (SELECT sum(n) AS n, sum(p) AS p, sum(q) AS q, sum(y) AS y, sum(pp) AS pp, sum(pq) AS pq, sum(qq) AS qq, sum(py) AS py,
                         sum(qy) AS qy FROM part),
        train AS (SELECT f, t.n - a.n AS n, t.p - a.p AS p, t.q - a.q AS q, t.y - a.y AS y, t.pp - a.pp AS pp, t.pq - a.pq AS pq,
                         t.qq - a.qq AS qq, t.py - a.py AS py, t.qy - a.qy AS qy FROM part a, total t
                  UNION ALL SELECT -1, * FROM total),
        system AS (SELECT f, c, n, p, q, y, pp - p * p / n + c AS a, pq - p * q / n AS b, qq - q * q / n + c AS d, py - p * y / n AS u,
                          qy - q * y / n AS v FROM train, (VALUES (0.1e0), (1e0), (10e0)) AS penalties(c)),
        fitted AS (SELECT f, c, (u * d - v * b) / (a * d - b * b) AS wp, (a * v - b * u) / (a * d - b * b) AS wq, n, p, q, y FROM system),
        model AS (SELECT f, c, wp, wq, (y - p * wp - q * wq) / n AS w0 FROM fitted),
        scores AS (SELECT c, avg(1 - (yy + wp * wp * pp + wq * wq * qq + w0 * w0 * n + 2 * (wp * wq * pq + wp * w0 * p + wq * w0 * q
                                      - wp * py - wq * qy - w0 * y)) / (yy - y * y / n)) AS r2
                   FROM model JOIN part USING (f) GROUP BY 1),
        best AS (SELECT wp, wq, w0 FROM model WHERE f = -1 AND c = (SELECT c FROM scores ORDER BY r2 DESC, c LIMIT 1))
        SELECT vec_id, round(y, 2) + 0.0e0 AS label, round(w0 + wp * p + wq * q, 4) + 0.0e0 AS prediction FROM l, best""",
    "column_transformer": """
        WITH t AS (SELECT p_brand, count(*) AS n, sum(p_retailprice) AS s FROM part GROUP BY 1),
             a AS (SELECT sum(n)::DOUBLE AS n, count(*)::DOUBLE AS k, sum(s) / sum(n) AS mean FROM t),
             c AS (SELECT row_number() OVER (ORDER BY p_type) - 1 AS component, count(*)::DOUBLE AS total FROM part GROUP BY p_type),
             every AS (
                SELECT component, total FROM c
                UNION ALL SELECT (SELECT count(*) FROM c), sum(p_size)::DOUBLE FROM part
                UNION ALL SELECT (SELECT count(*) FROM c) + 1,
                       sum(t.n * (t.n / (t.n + a.n / a.k) * s / t.n + (1 - t.n / (t.n + a.n / a.k)) * mean)) FROM t, a)
        SELECT component, round(total, 3) + 0.0e0 AS total FROM every""",
}
