"""String kernels against a set of fitted categories, through an inverted n-gram index.

The index holds the categories' n-grams. Its n-gram counts join with those of each
distinct string, so no strings x categories or strings x vocabulary matrix is built.
Similarities are sparse. Kernels whose every entry differs from zero are kept as what
strings share with categories (sparse), plus one number for the string, plus another one
times a row that is the same for all strings; nothing of their width is built per string.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import TypeConverters
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.arrays import cells
from lexiloom.functions.text import char_ngrams
from lexiloom.operators.base import EncoderEstimator, EncoderModel, HasCategories, PIVOT_WIDTH, categories_table, dense, param
from lexiloom.operators.counts import term_counts
from lexiloom.operators.ranking import dense_ordinals
from lexiloom.session import checkpointed, settled, small


class _KernelModel(EncoderModel):
    def matched(self, keys: DataFrame) -> DataFrame:
        """(_id, size, term, count) left-joined with the index; unmatched strings remain, named by a digest."""
        grams = char_ngrams(F.col("key"), self.meta["lo"], self.meta["hi"])
        sized = keys.select(_digest(), F.size(grams).alias("size"), F.explode_outer(grams).alias("term"))
        counts = sized.groupBy("_id", "size", "term").agg(F.count("term").alias("count"))
        return counts.join(small(self.tables["index"], self.meta["rows"], 5), "term", "left")

    def feature_names(self):
        return [r["key"] for r in self.tables["categories"].orderBy("component").toLocalIterator()]


def _digest() -> Column:
    return F.unhex(F.md5("key")).alias("_id")


def _listed(component: Column, value: Column) -> Column:
    """A string's (component, value) pairs in order; rows whose value is null only keep the string."""
    pairs = F.collect_list(F.when(value.isNotNull(), F.struct(component.cast("int").alias("i"), value.alias("v"))))
    return F.sort_array(pairs).alias("_c")


def _code(*more: Column) -> Column:
    return F.struct(F.transform("_c", lambda c: c["i"]).alias("indices"), F.transform("_c", lambda c: c["v"]).alias("values"),
                    *more).alias("features")


class SimilarityModel(_KernelModel):
    """Multiset Jaccard of n-grams: shared / (all of both - shared), for the categories that share one."""

    def encode(self, keys: DataFrame) -> DataFrame:
        shared = self.matched(keys).groupBy("_id", "size", "component", "m").agg(F.sum(F.least("count", "n")).alias("s"))
        value = F.col("s") / (F.col("size") + F.col("m") - F.col("s"))
        found = shared.groupBy("_id").agg(_listed(F.col("component"), value)).select("_id", _code())
        return keys.select("key", _digest()).join(found, "_id").select("key", "features")


    def encode_dense(self, keys: DataFrame) -> DataFrame:
        """The same with every category, zeros where no n-gram is shared; up to ``PIVOT_WIDTH`` categories."""
        shared = dense(self.matched(keys), self.width, F.least("count", "n").cast("double"), ("_id", "size"))
        own = {r["component"]: r["m"] for r in self.tables["index"].select("component", "m").distinct().collect()}
        m = F.array(*[F.lit(int(own.get(j, 0))) for j in range(self.width)])
        jaccard = F.zip_with("features", m, lambda s, n: F.coalesce(F.try_divide(s, F.col("size") + n - s), F.lit(0.0)))
        return keys.select("key", _digest()).join(shared.select("_id", jaccard.alias("features")), "_id").select("key", "features")


class StructuredModel(_KernelModel):
    """Codes ``values`` at ``indices`` + ``offset`` + ``scale`` * the model's constant row, for any number of categories.

    Up to ``PIVOT_WIDTH`` categories they can be written out; reductions multiply them at any width.
    """

    def constants(self) -> np.ndarray:
        if self.width > PIVOT_WIDTH:
            raise ValueError(f"a code of {self.width} categories is not written out, reduce it or restrict it to prototypes")
        if not hasattr(self, "_constants"):
            rows = self.tables["constants"].orderBy("component").toArrow()
            self._constants = rows["constant"].to_numpy()
        return self._constants

    def written_out(self, features: Column, spark) -> Column:
        sent = spark.sparkContext.broadcast(self.constants())

        @F.arrow_udf("array<double>")
        def dense(codes: pa.Array) -> pa.Array:
            constant = sent.value
            offset, scale = (codes.field(f).to_numpy(zero_copy_only=False)[:, None] for f in ("offset", "scale"))
            out = offset + scale * constant
            lists = codes.field("values")
            rows = np.repeat(np.arange(len(codes)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            out[rows, codes.field("indices").flatten().to_numpy(zero_copy_only=False)] += lists.flatten().to_numpy(zero_copy_only=False)
            offsets = pa.array(np.arange(len(out) + 1, dtype=np.int32) * len(constant))
            return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))

        return dense(features)

    def term_products(self, directions: DataFrame, k: int) -> DataFrame:
        """(term, base, levels): what a string's n-gram adds to its code times (component, w), summed over all categories.

        ``base`` holds k numbers for any count of the n-gram and one more for the string itself, ``levels`` those that only
        a certain count adds. A string then meets its own n-grams instead of all categories that share one with it.
        """
        joined = self.tables["index"].join(small(directions.select("component", F.col("w").alias("w_")), self.width, k), "component", "left")
        return settled(self._summed(joined, [F.coalesce(F.col("w_")[j], F.lit(0.0)) for j in range(k)]))

    def _summed(self, joined: DataFrame, row: list[Column]) -> DataFrame:
        """:meth:`term_products` from the index and each category's row of the directions."""
        raise NotImplementedError

    def _met(self, keys: DataFrame, terms: DataFrame, k: int, added: Callable[[int], Column]) -> DataFrame:
        """(key, p0 .. pk): sums over a string's n-grams. Strings are dealt by digest before their n-grams are exploded."""
        parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        named = keys.select("key", _digest()).repartition(parts, "_id")
        grams = char_ngrams(F.col("key"), self.meta["lo"], self.meta["hi"])
        counts = named.select("_id", F.explode_outer(grams).alias("term")).groupBy("_id", "term").agg(F.count("term").alias("count"))
        sums = [F.coalesce(F.sum(added(j)), F.lit(0.0)).alias(f"p{j}") for j in range(k + 1)]
        return named.join(counts.join(terms, "term", "left").groupBy("_id").agg(*sums), "_id")

    def products(self, keys: DataFrame, terms: DataFrame, k: int) -> DataFrame:
        """(key, features, offset, scale): the sparse part of codes times directions, by their :meth:`term_products`."""
        raise NotImplementedError

    def encode_long(self, keys: DataFrame) -> DataFrame:
        encoded = self.encode(keys)
        return cells(encoded.select("key", self.written_out(F.col("features"), keys.sparkSession).alias("features")), ["key"], "features")

    def as_vector(self, encoded: DataFrame) -> Column:
        return array_to_vector(self.written_out(F.col("features"), encoded.sparkSession))


class FisherModel(StructuredModel):
    """K(i, j): sum over n-grams with equal counts in i and j of 1 / P(that count).

    With q_m the inverse share of categories lacking m, this is
    sum_m q_m - Q_i - Q_j + sum over shared m of (q_m + [equal counts] / P).
    Component -1 of the index carries q_m alone, which adds up to Q_i.
    """

    def encode(self, keys: DataFrame) -> DataFrame:
        count = F.least("count", F.lit(1)) if self.meta["compare"] == "presence" else F.col("count")
        value = F.col("q") + F.when(count == F.col("n"), F.col("w")).otherwise(0.0)
        sums = self.matched(keys).groupBy("_id", "component").agg(F.sum(value).alias("s"))
        pair, own = F.when(F.col("component") >= 0, F.col("s")), F.sum(F.when(F.col("component") < 0, F.col("s")))
        found = sums.groupBy("_id").agg(_listed(F.col("component"), pair), F.coalesce(own, F.lit(0.0)).alias("own"))
        found = found.select("_id", _code((-F.col("own")).alias("offset"), F.lit(1.0).alias("scale")))
        return keys.select("key", _digest()).join(found, "_id").select("key", "features")


    def _summed(self, joined, row):
        sums = [F.sum(w) for w in row]
        levels = joined.groupBy("term", "n").agg(F.first("w").alias("w"), F.first("q").alias("q"), F.array(*sums).alias("s"))
        base = [F.sum(F.col("q") * F.col("s")[j]) for j in range(len(row))]
        held = F.when(F.col("n") > 0, F.struct(F.col("n").cast("long"), F.transform("s", lambda x: x * F.col("w"))))
        return levels.groupBy("term").agg(F.array(*base, F.first("q")).alias("base"), F.map_from_entries(F.collect_list(held)).alias("levels"))

    def products(self, keys, terms, k):
        count = F.least("count", F.lit(1)) if self.meta["compare"] == "presence" else F.col("count")
        level = F.try_element_at("levels", count.cast("long"))
        added = lambda j: F.col("base")[j] + (F.coalesce(level[j], F.lit(0.0)) if j < k else F.lit(0.0))
        found = self._met(keys, terms, k, added)
        return found.select("key", F.array(*[f"p{j}" for j in range(k)]).alias("features"),
                            (-F.col(f"p{k}")).alias("offset"), F.lit(1.0).alias("scale"))


class _Kernel(EncoderEstimator, HasCategories):
    ngramMin = param("ngramMin", "smallest n-gram", TypeConverters.toInt)
    ngramMax = param("ngramMax", "largest n-gram", TypeConverters.toInt)
    defaults = {"categories": "auto", "nPrototypes": 0, "seed": 10, "ngramMin": 2, "ngramMax": 4}

    def categories_with_terms(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        lo, hi = self.get("ngramMin"), self.get("ngramMax")
        cats = checkpointed(dense_ordinals(categories_table(self, df), "key", "component", keep=["count"]))
        terms = term_counts(cats.select("key"), "char", lo, hi).withColumnRenamed("count", "n")
        return cats, terms.join(cats, "key")

    def kernel_model(self, cls, cats: DataFrame, index: DataFrame, constants: DataFrame | None = None, **meta) -> EncoderModel:
        index = checkpointed(index)
        meta |= {"rows": index.count(), "width": cats.count(), "lo": self.get("ngramMin"), "hi": self.get("ngramMax")}
        tables = {"index": index, "categories": cats.select("key", "component")}
        if constants is not None:
            tables["constants"] = checkpointed(constants)
        return self.build(cls(tables, meta))


class SimilarityEncoder(_Kernel):
    def _fit(self, df):
        cats, terms = self.categories_with_terms(df)
        sizes = terms.groupBy("component").agg(F.sum("n").alias("m"))
        return self.kernel_model(SimilarityModel, cats, terms.join(sizes, "component").select("term", "component", "n", "m"))


class FisherKernelEncoder(_Kernel):
    """``compare`` counts or presence; ``theta`` uniform or by category frequency."""

    compare = param("compare", "'count' or 'presence'", TypeConverters.toString)
    theta = param("theta", "'uniform' or 'frequency'", TypeConverters.toString)
    defaults = {**_Kernel.defaults, "compare": "count", "theta": "uniform"}

    def _fit(self, df):
        if self.get("compare") not in ("count", "presence") or self.get("theta") not in ("uniform", "frequency"):
            raise ValueError("compare is count or presence, theta is uniform or frequency")
        cats, terms = self.categories_with_terms(df)
        presence, uniform = self.get("compare") == "presence", self.get("theta") == "uniform"
        held = terms.select("term", "component", (F.lit(1) if presence else F.col("n")).alias("n"),
                            (F.lit(1) if uniform else F.col("count")).cast("bigint").alias("mass"))
        total = cats.agg((F.count(F.lit(1)) if uniform else F.sum("count")).cast("bigint")).first()[0]
        lacking = F.lit(total) - F.sum("mass")
        q = held.groupBy("term").agg(
            F.when(lacking > 0, F.lit(float(total)) / lacking).otherwise(0.0).alias("q"))
        level = held.groupBy("term", "n").agg((F.lit(float(total)) / F.sum("mass")).alias("w"))
        index = held.join(level, ["term", "n"]).join(q, "term").select("term", "component", "n", "w", "q")
        index = checkpointed(index.unionByName(q.select(
            "term", F.lit(-1).cast("bigint").alias("component"), F.lit(0).cast(index.schema["n"].dataType).alias("n"),
            F.lit(0.0).alias("w"), "q")))
        own = index.groupBy("component").agg(F.sum("q").alias("s"))
        everything = index.filter("component = -1").agg(F.coalesce(F.sum("q"), F.lit(0.0))).first()[0]
        constants = cats.select("component").join(own, "component", "left").select(
            "component", (F.lit(everything) - F.coalesce("s", F.lit(0.0))).alias("constant"))
        return self.kernel_model(FisherModel, cats, index, constants, compare=self.get("compare"))


class LinearMixtureModel(StructuredModel):
    """One topic per category with the linear score counts . beta - 1."""

    def encode(self, keys: DataFrame) -> DataFrame:
        sums = self.matched(keys).groupBy("_id", "component").agg(
            F.sum(F.col("count") * F.col("n")).alias("s"), F.sum(F.col("count") * F.col("t")).alias("t"))
        fisher = self.meta["fisher"]
        listed = _listed(F.col("component"), F.col("s") if fisher else F.col("t"))
        # The scores' sum over all topics, each as probable as its category: the shares add up to one.
        total = (F.coalesce(F.sum("t"), F.lit(0.0)) - 1).alias("total")
        less = F.try_divide(F.lit(-1.0), F.col("total"))
        found = sums.groupBy("_id").agg(listed, total).withColumn(
            "_c", F.transform("_c", lambda c: F.struct(c["i"].alias("i"), F.try_divide(c["v"], F.col("total")).alias("v"))))
        found = found.select("_id", _code(less.alias("offset") if fisher else F.lit(0.0).alias("offset"),
                                          F.lit(0.0).alias("scale") if fisher else less.alias("scale")))
        return keys.select("key", _digest()).join(found, "_id").select("key", "features")


    def _summed(self, joined, row):
        weight = F.col("n" if self.meta["fisher"] else "t")
        sums = [F.sum(weight * w) for w in row]
        return joined.groupBy("term").agg(F.array(*sums, F.sum("t")).alias("base"))

    def products(self, keys, terms, k):
        found = self._met(keys, terms, k, lambda j: F.col("count") * F.col("base")[j])
        total = F.col(f"p{k}") - 1
        less, none = F.try_divide(F.lit(-1.0), total), F.lit(0.0)
        offset, scale = (less, none) if self.meta["fisher"] else (none, less)
        return found.select("key", F.array(*[F.try_divide(F.col(f"p{j}"), total) for j in range(k)]).alias("features"),
                            offset.alias("offset"), scale.alias("scale"))


class LinearMixtureEncoder(_Kernel):
    """The mixture with every category as a topic and no refinement rounds."""

    fisher = param("fisher", "emit score / sum instead of score * theta / sum", TypeConverters.toBoolean)
    defaults = {**_Kernel.defaults, "fisher": True}

    def _fit(self, df):
        cats, terms = self.categories_with_terms(df)
        rows = cats.agg(F.sum("count")).first()[0] or 1
        size = terms.groupBy("key").agg(F.sum("n").alias("size"))
        beta = F.col("n") / F.col("size")
        index = terms.join(size, "key").select("term", "component", beta.alias("n"), (beta * F.col("count") / F.lit(rows)).alias("t"))
        constants = cats.select("component", (F.col("count") / F.lit(rows)).alias("constant"))
        return self.kernel_model(LinearMixtureModel, cats, index, constants, fisher=self.get("fisher"))
