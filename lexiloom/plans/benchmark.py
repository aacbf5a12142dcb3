"""The benchmark matrix: datasets x encoders x reductions x classifiers x folds."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators.models import build_estimator
from lexiloom.operators.prep import multi_encode_columns, multi_encode_roles, preprocess
from lexiloom.operators.splits import rare_category_folds, shuffle_folds, stratified_folds
from lexiloom.plans.features import FoldStatistics, feature_pipeline, fit_predict_fold
from lexiloom.roles import ColumnRoles
from lexiloom.session import checkpointed
from lexiloom.sources.ledger import config_text, pending, read_results, record_run


@dataclass(frozen=True)
class Settings:
    """What one call of :func:`run_benchmark` holds fixed."""

    n_splits: int = 20
    test_size: float = 1 / 3
    n_components: int = 100
    lower_special: bool = True
    rare_categories: bool = False
    concurrent_folds: int = 4
    sample_seed: int = 0
    split_seed: int = 0
    model_seed: int = 0


Source = Callable[[SparkSession], tuple[DataFrame, ColumnRoles, list[str], int]]


def split(df: DataFrame, roles: ColumnRoles, ids: list[str], s: Settings) -> DataFrame:
    """The table, each row once, with its ``test_folds`` by the task's splitter."""
    if s.rare_categories:
        return rare_category_folds(df, roles.special[0], s.n_splits, s.test_size, s.split_seed)
    if roles.task == "regression":
        return shuffle_folds(df, ids, s.n_splits, s.test_size, s.split_seed)
    return stratified_folds(df, ids, roles.target, s.n_splits, s.test_size, s.split_seed)


def plan_runs(spark: SparkSession, runs: list[dict], results_path: str) -> list[str]:
    """Configurations that have no stored record, as text."""
    planned = spark.createDataFrame([(config_text(r),) for r in runs], "config string").select(
        F.sha2("config", 256).alias("config_key"), "config")
    left = pending(planned, read_results(spark, results_path))
    return [r["config"] for r in left.collect()]


def run_benchmark(spark: SparkSession, sources: dict[str, Source], encoders: Iterable[str | list[str]],
                  reductions: Iterable[str | None], classifiers: Iterable[str], results_path: str,
                  settings: Settings = Settings(), build: Callable = build_estimator,
                  vectors: DataFrame | None = None) -> DataFrame:
    """Run every configuration not stored yet; folds are concurrent Spark jobs."""
    for name, source in sources.items():
        table, roles, ids, n_rows = source(spark)
        runs = [{"dataset": name, "encoder": e, "reduction": r, "classifier": c, "n_rows": n_rows,
                 "roles": dict(roles.roles), "task": roles.task, **settings.__dict__}
                for e in encoders for r in reductions for c in classifiers]
        todo = set(plan_runs(spark, runs, results_path))
        if not todo:
            continue
        prepared = checkpointed(preprocess(table, roles, ids, n_rows, settings.lower_special, settings.sample_seed))
        folds = checkpointed(split(prepared, roles, ids, settings))
        classes = prepared.select(roles.target).distinct().count() if roles.task != "regression" else 0
        for run in runs:
            if config_text(run) in todo:
                scores = _run_folds(folds, roles, run, classes, settings, build, vectors)
                record_run(spark, results_path, run, scores)
    return read_results(spark, results_path)


def _run_folds(folds: DataFrame, roles: ColumnRoles, run: dict, classes: int, s: Settings, build: Callable,
               vectors: DataFrame | None) -> list[tuple]:
    encoder = run["encoder"]
    if isinstance(encoder, list):
        roles = multi_encode_roles(roles, roles.special[0], encoder)
        folds = multi_encode_columns(folds, roles.special[0], encoder)
        encoder = encoder[0]

    def classifier(task, features, label, width, weight):
        return build(run["classifier"], task, features, label, width, classes, weight, s.model_seed)

    stages = feature_pipeline(roles, encoder, run["reduction"], s.n_components, vectors).getStages()
    statistics = FoldStatistics(folds, roles, s.n_splits, stages)

    def one(fold: int) -> tuple:
        tested = F.array_contains("test_folds", fold)
        return fit_predict_fold(folds.filter(~tested), folds.filter(tested), roles, encoder,
                                run["reduction"], s.n_components, classifier, fold, vectors, statistics)

    with ThreadPoolExecutor(s.concurrent_folds) as pool:
        return list(pool.map(inheritable_thread_target(folds.sparkSession)(one), range(s.n_splits)))
