"""Table preparation: every step maps a DataFrame to a DataFrame."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.ranking import dense_ordinals, lowest
from lexiloom.roles import ColumnRoles
from lexiloom.session import settled

# The missing share that triggers a warning, and the smallest class kept.
MISSING_WARNING = 0.15
RARE_CLASS = 20
MISSING_TOKEN = "nan"


def null_profile(df: DataFrame, columns: Iterable[str], threshold: float = MISSING_WARNING) -> DataFrame:
    """(column, missing_fraction, flagged), all columns in one pass."""
    columns = list(columns)
    one_pass = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    long = one_pass.unpivot([], columns, "column", "missing_fraction")
    return long.withColumn("flagged", F.col("missing_fraction") > threshold)


def warn_missing(df: DataFrame, columns: Iterable[str], threshold: float = MISSING_WARNING) -> None:
    for row in null_profile(df, columns, threshold).filter("flagged").collect():
        warnings.warn(
            f"column {row['column']!r} lacks {row['missing_fraction']:.1%} of its values, "
            f"more than the {threshold:.1%} that go without a warning"
        )


def distinct_profile(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(column, value): the distinct values, pre-aggregated before the shuffle."""
    columns = list(columns)
    as_text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return as_text.unpivot([], columns, "column", "value").distinct()


def distinct_counts(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(column, n_distinct); a null counts as one value."""
    return distinct_profile(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))


def stringify(col: Column, missing: str = MISSING_TOKEN) -> Column:
    return F.coalesce(col.cast("string"), F.lit(missing))


def stringify_fill(df: DataFrame, columns: Iterable[str], missing: str = MISSING_TOKEN) -> DataFrame:
    return df.withColumns({c: stringify(F.col(c), missing) for c in columns})


def normalize_strings(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.lower(F.col(c).cast("string")) for c in columns})


def drop_incomplete(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def keyed_order(ids: Iterable[str], seed: int) -> Column:
    """A seeded order both reproducible and independent of partitioning."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ids], F.lit(str(seed))))


def sample_exact(df: DataFrame, ids: Iterable[str], n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows without replacement (all rows when there are fewer)."""
    ids = list(ids)
    return lowest(df, [], keyed_order(ids, seed), ids, F.lit(n))


def shuffled(df: DataFrame, ids: Iterable[str], seed: int) -> DataFrame:
    """All rows in seeded order."""
    ids = list(ids)
    return df.orderBy(keyed_order(ids, seed), *ids)


def label_table(df: DataFrame, target: str, min_count: int | None = None) -> DataFrame:
    """(class, n, label): labels 0..C-1 in sorted class order."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    if min_count is not None:
        counts = counts.filter(F.col("n") > min_count)
    return dense_ordinals(counts, target, name="label", keep=["n"])


def label_encode(df: DataFrame, target: str, min_count: int | None = None, label: str = "label") -> DataFrame:
    """Add the label; with ``min_count`` rows of classes at or below it are dropped."""
    labels = settled(label_table(df, target, min_count).select(target, F.col("label").alias(label)))
    return df.join(labels, target, "inner")


def derive_boolean(df: DataFrame, column: str, positive, name: str | None = None) -> DataFrame:
    return df.withColumn(name or column, F.col(column) == F.lit(positive))


def recode(df: DataFrame, column: str, labels: Mapping, name: str | None = None) -> DataFrame:
    """Replace known codes by their label and keep the others as text."""
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    known = F.try_element_at(F.create_map(*pairs), F.col(column))
    return df.withColumn(name or column, F.coalesce(known, F.col(column).cast("string")))


def composite_key(*parts: str) -> Column:
    """Concatenated text key; use the separate columns where collisions matter."""
    return F.concat(*[F.col(p).cast("string") for p in parts])


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[str(c).strip() for c in df.columns])


def left_join_suffix(left: DataFrame, right: DataFrame, key: str | list[str], left_suffix: str,
                     right_suffix: str, how: str = "left") -> DataFrame:
    """Equi-join in which columns present on both sides get their suffix."""
    keys = [key] if isinstance(key, str) else list(key)
    shared = set(left.columns) & set(right.columns) - set(keys)
    rename = lambda df, suffix: df.withColumnsRenamed({c: c + suffix for c in shared})
    return rename(left, left_suffix).join(rename(right, right_suffix), keys, how)


def join_required(left: DataFrame, right: DataFrame, key: str | list[str], required: str,
                  left_suffix: str, right_suffix: str) -> DataFrame:
    """Left join whose rows need a value of ``required``: an inner join."""
    return left_join_suffix(
        left, right.filter(F.col(required).isNotNull()), key, left_suffix, right_suffix, "inner"
    )


def union_dedupe(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out.dropDuplicates()


def multi_encode_roles(roles: ColumnRoles, column: str, encoders: list[str]) -> ColumnRoles:
    """Roles in which one column feeds several encoders through named copies."""
    extra = {f"{column}_{i}": name for i, name in enumerate(encoders) if i > 0}
    return ColumnRoles({**roles.roles, **extra}, roles.task, roles.dirtiness)


def multi_encode_columns(df: DataFrame, column: str, encoders: list[str]) -> DataFrame:
    return df.withColumns({f"{column}_{i}": F.col(column) for i in range(1, len(encoders))})


def preprocess(df: DataFrame, roles: ColumnRoles, ids: list[str], n_rows: int = -1,
               lower_special: bool = True, seed: int = 0) -> DataFrame:
    """The whole preparation of a learning table, row ids kept."""
    roles.check(df)
    warn_missing(df, roles.features)
    table = stringify_fill(df.select(*ids, *roles.features, roles.target), roles.categorical)
    table = drop_incomplete(table, [*roles.features, roles.target])
    if n_rows != -1:
        table = sample_exact(table, ids, n_rows, seed)
    if lower_special:
        table = normalize_strings(table, roles.special)
    if roles.task in ("binary", "multiclass"):
        table = label_encode(table, roles.target, RARE_CLASS, "label").drop(roles.target)
        table = table.withColumnRenamed("label", roles.target)
    return table
