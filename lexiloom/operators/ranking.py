"""Order-dependent work without a single-task sort or a hot window group.

A plain window over a group (or over the whole table) sends that group to one task.
These helpers first count the group in fine buckets of the order, find by a running
sum over those few counts where the cut falls, and rank only inside one bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.session import checkpointed, settled

# Hex digits of the order key used as bucket: 16**4 buckets per group.
BUCKET_DIGITS = 4
ROWS_PER_RANGE = 50_000


def cuts(df: DataFrame, group: Sequence[str], tie: Sequence[str], quota: Column) -> DataFrame:
    """Per group the (order, tie) of the last row inside its quota, how many rows of that place are inside, and how
    many there are.

    One bucket per group holds the cut; the table is reduced to those buckets by a
    broadcast join before anything is shuffled or ranked.
    """
    group = list(group)
    bucket = F.substring("_order", 1, BUCKET_DIGITS)
    counts = df.groupBy(*group, bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_c"))
    running = Window.partitionBy(*group).orderBy("_bucket")
    placed = (
        counts.withColumn("_upto", F.sum("_c").over(running))
        .withColumn("n_group", F.sum("_c").over(Window.partitionBy(*group)))
        .withColumn("_quota", F.least(quota.cast("bigint"), F.col("n_group")))
    )
    edge = placed.filter(
        (F.col("_upto") >= F.col("_quota")) & (F.col("_upto") - F.col("_c") < F.col("_quota"))
    ).select(*group, "_bucket", (F.col("_quota") - F.col("_upto") + F.col("_c")).alias("_rest"))
    inside = (
        df.select(*group, "_order", *tie).withColumn("_bucket", bucket)
        .join(settled(edge), [*group, "_bucket"])
        .withColumn("_rank", F.row_number().over(
            Window.partitionBy(*group, "_bucket").orderBy("_order", *tie)))
    )
    last = F.struct("_order", *tie).alias("_cut")
    place = Window.partitionBy(*group, "_bucket", "_order", *tie)
    within = inside.withColumn("_ties", F.count(F.lit(1)).over(place)).withColumn(
        "_before", F.min("_rank").over(place) - 1)
    return within.filter(F.col("_rank") == F.col("_rest")).select(
        *group, last, (F.col("_rest") - F.col("_before")).alias("_take"), "_ties")


def flag_lowest(df: DataFrame, group: Sequence[str], order: Column, tie: Sequence[str],
                quota: Column, flag: str) -> DataFrame:
    """Mark the ``quota`` first rows of each group by (order, tie).

    ``order`` is a hex digest; ``quota`` may use ``n_group``, the size of the group. The
    cut table has one row per group and is settled first, so with few groups (folds,
    classes) the last join does not move the table. Where rows of equal (order, tie) stand
    at a cut, only those are ranked, by a digest of all their columns.
    """
    group, tie = list(group), list(tie)
    keyed = df.withColumn("_order", order)
    found = checkpointed(cuts(keyed, group, tie, quota))
    tied = not found.filter("_ties > _take").isEmpty()
    place, helpers = F.struct("_order", *tie), ["_order", "_cut", "_take", "_ties"]
    if group:
        placed = keyed.join(settled(found), group, "left")
    else:
        row = found.first()
        placed = keyed.withColumns({c: F.lit(row[c]) if row else F.lit(None) for c in ("_take", "_ties")}).withColumn(
            "_cut", F.struct(*[F.lit(x).cast(keyed.schema[c].dataType).alias(c) for c, x in zip(("_order", *tie), row["_cut"])])
            if row else F.lit(None).cast("struct<_order:string>"))
    below = place <= F.col("_cut") if group or row else F.lit(False)
    inside = F.coalesce(below, F.lit(False))
    if not tied:
        return placed.withColumn(flag, inside).drop(*helpers)
    at_cut = F.coalesce((place == F.col("_cut")) & (F.col("_ties") > F.col("_take")), F.lit(False))
    everything = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    rank = F.row_number().over(Window.partitionBy(*group, "_order", *tie).orderBy(everything))
    clear = placed.filter(~at_cut).withColumn(flag, inside)
    ranked = placed.filter(at_cut).withColumn(flag, rank <= F.col("_take"))
    return clear.unionByName(ranked).drop(*helpers)


def lowest(df: DataFrame, group: Sequence[str], order: Column, tie: Sequence[str],
           quota: Column) -> DataFrame:
    return flag_lowest(df, group, order, tie, quota, "_keep").filter("_keep").drop("_keep")


def running_sums(df: DataFrame, order: str, values: Sequence[str], descending: bool = False) -> DataFrame:
    """Add ``cum_<value>`` over the whole table in order of the numeric column.

    ``order`` must be unique. Buckets come from approximate quantiles, so each holds
    about ROWS_PER_RANGE rows whatever the size and the distribution.
    """
    df = checkpointed(df)
    ranges = max(1, -(-df.count() // ROWS_PER_RANGE))
    edges = df.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.25 / ranges) if ranges > 1 else []
    splits = [float("-inf"), *(sorted(set(edges)) or [0.0]), float("inf")]
    placed = Bucketizer(splits=splits, inputCol=order, outputCol="_range").transform(df)
    totals = placed.groupBy("_range").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    direction = F.col("_range").desc() if descending else F.col("_range")
    before = Window.orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_range", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values]
    )
    within = Window.partitionBy("_range").orderBy(
        F.col(order).desc() if descending else F.col(order)
    ).rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.join(F.broadcast(offsets), "_range")
        .withColumns({f"cum_{v}": F.sum(v).over(within) + F.col(f"_o_{v}") for v in values})
        .drop("_range", *[f"_o_{v}" for v in values])
    )


def dense_ordinals(df: DataFrame, key: str, name: str = "ordinal", start: int = 0,
                   keep: Sequence[str] = ()) -> DataFrame:
    """Position of each (distinct) key in sorted order, from a distributed sort.

    The sort is checkpointed so that partition numbers and positions stay put; the
    position is then the row's place in its partition plus the sizes before it.
    """
    place = F.monotonically_increasing_id().alias("_place")
    ordered = checkpointed(df.select(key, *keep).orderBy(key).select("*", place))
    part = F.shiftright("_place", 33)
    inside = F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    return (
        ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part")
        .select(key, *keep, (inside + F.col("_offset") + F.lit(start)).cast("bigint").alias(name))
    )
