"""Seeded train/test splits as row flags, without a global sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.operators.ranking import cuts, flag_lowest
from lexiloom.session import checkpointed, settled


def fold_order(ids: Sequence[str], seed: int, fold: Column | str = "fold") -> Column:
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ids],
                             F.col(fold).cast("string") if isinstance(fold, str) else fold.cast("string"),
                             F.lit(str(seed))))


def with_folds(df: DataFrame, n_splits: int) -> DataFrame:
    folds = F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("fold")
    return df.select("*", folds)


def unfolded(df: DataFrame, n_splits: int) -> DataFrame:
    """(…, fold, is_test) from rows that hold their ``test_folds``."""
    every = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("fold"))
    return every.withColumn("is_test", F.array_contains("test_folds", F.col("fold"))).drop("test_folds")


def _with_test_folds(df: DataFrame, ids: Sequence[str], group: list[str], quota: Column, n_splits: int, seed: int,
                     more: tuple[str, ...] = ()) -> DataFrame:
    """Each row once, with the folds it is tested in: those in whose seeded order it is among its group's first.

    Rows are only multiplied by folds to be counted, as ids, and are added up before they are shuffled. Rows with
    equal ids are told apart by number if, and only if, they stand where a fold is cut.
    """
    tie = [*ids, *more]
    counted = with_folds(df.select(*group, *tie), n_splits).withColumn("_order", fold_order(ids, seed))
    found = checkpointed(cuts(counted, ["fold", *group], tie, quota))
    if not more and not found.filter("_ties > _take").isEmpty():
        everything = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
        copy = F.row_number().over(Window.partitionBy(*group, *ids).orderBy(everything))
        return _with_test_folds(df.withColumn("_copy", copy), ids, group, quota, n_splits, seed, ("_copy",)).drop("_copy")
    if group:
        maps = found.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("fold", "_cut"))).alias("_cuts"))
        placed = df.join(settled(maps), group, "left")
    else:
        rows = found.collect()  # one for each fold
        if not rows:
            return df.withColumn("test_folds", F.array().cast("array<int>"))
        kinds = dict(counted.dtypes)
        place = lambda cut: F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(("_order", *tie), cut)])
        placed = df.withColumn("_cuts", F.create_map(*[x for r in rows for x in (F.lit(r["fold"]), place(r["_cut"]))]))

    def tested(fold: Column) -> Column:
        own = F.struct(fold_order(ids, seed, fold).alias("_order"), *[F.col(c) for c in tie])
        return F.coalesce(own <= F.try_element_at("_cuts", fold), F.lit(False))

    return placed.withColumn("test_folds", F.filter(F.sequence(F.lit(0), F.lit(n_splits - 1)), tested)).drop("_cuts")


def shuffle_folds(df: DataFrame, ids: Sequence[str], n_splits: int, test_size: float, seed: int) -> DataFrame:
    """(…, test_folds): ceil(n * test_size) test rows in each fold."""
    return _with_test_folds(df, ids, [], F.ceil(F.col("n_group") * F.lit(test_size)), n_splits, seed)


def stratified_folds(df: DataFrame, ids: Sequence[str], target: str, n_splits: int, test_size: float, seed: int) -> DataFrame:
    """The same within each class: round(n_class * test_size) test rows."""
    return _with_test_folds(df, ids, [target], F.round(F.col("n_group") * F.lit(test_size)), n_splits, seed)


def shuffle_split(df: DataFrame, ids: Sequence[str], n_splits: int, test_size: float, seed: int) -> DataFrame:
    """(…, fold, is_test) of :func:`shuffle_folds`."""
    return unfolded(shuffle_folds(df, ids, n_splits, test_size, seed), n_splits)


def stratified_split(df: DataFrame, ids: Sequence[str], target: str, n_splits: int, test_size: float,
                     seed: int) -> DataFrame:
    """(…, fold, is_test) of :func:`stratified_folds`."""
    return unfolded(stratified_folds(df, ids, target, n_splits, test_size, seed), n_splits)


def rare_category_split(df: DataFrame, column: str, n_splits: int, test_size: float, seed: int) -> DataFrame:
    """(…, fold, is_test) of :func:`rare_category_folds`."""
    return unfolded(rare_category_folds(df, column, n_splits, test_size, seed), n_splits)


def rare_category_folds(df: DataFrame, column: str, n_splits: int, test_size: float, seed: int) -> DataFrame:
    """Hold out whole categories, the rarest first, up to ``test_size`` of the rows.

    Categories of equal size are ordered by a digest per fold. All categories of one
    size that fit are taken at once, so only the sizes, not the categories, are summed
    in order; the size at the limit is cut by :func:`flag_lowest`.
    """
    cats = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    sizes = cats.groupBy("_n").agg((F.count(F.lit(1)) * F.col("_n")).alias("_rows"))
    total = sizes.agg(F.sum("_rows")).scalar()
    upto = F.sum("_rows").over(Window.orderBy("_n").rowsBetween(Window.unboundedPreceding, 0))
    limit = F.floor(total * F.lit(test_size))
    room = sizes.select("_n", F.floor((limit - upto + F.col("_rows")) / F.col("_n")).alias("_room"))
    placed = with_folds(cats.join(settled(room), "_n"), n_splits).withColumn("_room", F.greatest("_room", F.lit(0)))
    order = fold_order([column], seed)
    inside = flag_lowest(placed, ["fold", "_n", "_room"], order, [column], F.col("_room"), "is_test")
    held = inside.filter("is_test").groupBy(column).agg(F.sort_array(F.collect_list("fold")).alias("test_folds"))
    return df.join(held, column, "left").withColumn("test_folds", F.coalesce("test_folds", F.array().cast("array<int>")))
