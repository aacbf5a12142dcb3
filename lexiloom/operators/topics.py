"""Topic models over distinct strings: gamma-Poisson, non-negative and mixture factorizations.

Each distinct string is one sparse row of term counts with its multiplicity. A pass
brings the weights to the rows, updates each row's topic activations there, and sums the
per-term statistics with a shuffle on the term. Weights of a checked size are broadcast
and their sums reach the driver; larger ones stay a table by term (topic_tables.py).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.param import TypeConverters
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.arrays import cells, exploded, sparse_cells
from lexiloom.functions.sparse import gram_counts, gram_struct, side_by_side
from lexiloom.functions.text import collapsed
from lexiloom.operators import topic_blocks, topic_tables
from lexiloom.operators.base import EncoderEstimator, EncoderModel, param, sparse
from lexiloom.operators.grams import Terms, digest_counts, digest_of, fitted_vocabulary
from lexiloom.operators.topic_blocks import RowBlocks, starting_rows
from lexiloom.session import checkpointed, portions, spread

# K x V up to which the weights are broadcast (64 MB of doubles); beyond it they are joined by term. Either way
# gives the same numbers.
BROADCAST_WEIGHTS = 8_000_000
# Entries x topics a task works on at once.
CHUNK_CELLS = 2_000_000
TINY = 1e-10


# --- sparse rows -----------------------------------------------------------------------


def blocks_of(meta: dict, tables: dict) -> list[Terms]:
    """The blocks of columns a model counts, in order."""
    return [Terms(block, tables.get(block["terms"])) for block in meta["blocks"]]


def block_vector(text: Column, blocks: list[Terms]) -> Column:
    starts = np.concatenate(([0], np.cumsum([b.width for b in blocks])))
    return side_by_side([b.vector(text, int(start)) for b, start in zip(blocks, starts)])


def term_rows(keys: DataFrame, blocks: list[Terms]) -> DataFrame:
    """(key, count, features): the blocks' counts side by side, indices offset by block.

    Vocabularies that are too large to be sent are joined by term, strings being known by a digest meanwhile.
    """
    count = F.col("count") if "count" in keys.columns else F.lit(1).cast("bigint")
    if all(b.local for b in blocks):
        return keys.select("key", count.alias("count"), block_vector(F.col("key"), blocks).alias("features"))
    named = keys.select("key", count.alias("count"), digest_of())
    strings, start, parts = named.select("_id", "key").dropDuplicates(["_id"]), 0, []
    for b in blocks:
        if b.local:
            counted = sparse_cells(strings.select("_id", b.vector(F.col("key")).alias("features")), ["_id"])
        else:
            counted = digest_counts(strings, b.table, b.analyzer, b.lo, b.hi)
        parts.append(counted.select("_id", (F.col("component") + F.lit(start)).alias("component"), "value"))
        start += b.width
    features = sparse(reduce(DataFrame.unionByName, parts), ("_id",))
    nothing = F.struct(F.array().cast("array<int>").alias("indices"), F.array().cast("array<double>").alias("values"))
    return named.join(features, "_id", "left").select("key", "count", F.coalesce("features", nothing).alias("features"))


def hashed_grams(blocks: list[Terms]) -> tuple[int, int, int] | None:
    """Width and sizes where the only block is hashed n-grams, which are counted where they are used."""
    (block,) = blocks if len(blocks) == 1 else (None,)
    return (block.width, block.lo, block.hi) if block and block.table is None and block.analyzer == "char" else None


def row_blocks(keys: DataFrame, rows: DataFrame, blocks: list[Terms], batches: int = 1, seed: int = 0) -> RowBlocks:
    """The ``term_rows`` of keys in blocks."""
    hashed = hashed_grams(blocks)
    return RowBlocks(rows if hashed is None else keys, batches, seed, hashed)


class Rows:
    """One chunk of sparse rows as flat arrays."""

    def __init__(self, weight, starts, sizes, idx, val):
        self.weight, self.sizes, self.idx, self.val = weight, sizes, idx, val
        self.n = len(weight)
        self._full = np.flatnonzero(sizes)
        self._starts = (starts - (starts[0] if len(starts) else 0))[self._full]

    def by_row(self, entries: np.ndarray) -> np.ndarray:
        """Sum entries (..., nnz) of each row; topics lead, so sums run along memory."""
        out = np.zeros((*entries.shape[:-1], self.n))
        if len(self._full):
            out[..., self._full] = np.add.reduceat(entries, self._starts, axis=-1)
        return out

    def take(self, which: np.ndarray) -> "Rows":
        """The rows a mask selects."""
        sizes, inside = self.sizes[which], np.repeat(which, self.sizes)
        return Rows(self.weight[which], np.cumsum(sizes) - sizes, sizes, self.idx[inside], self.val[inside])

    def spread(self, by_row: np.ndarray) -> np.ndarray:
        """Repeat values (..., n) of the rows for their entries."""
        return np.repeat(by_row, self.sizes, axis=-1)

    def by_term(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum entries (k, nnz) of each term that occurs."""
        if not len(self.idx):
            return self.idx, entries
        order = np.argsort(self.idx, kind="stable")
        terms, first = np.unique(self.idx[order], return_index=True)
        return terms, np.add.reduceat(entries[:, order], first, axis=1)


def chunks(features: pa.StructArray, weight: np.ndarray, k: int):
    """Yield Rows with a bounded number of entries."""
    lists = features.field("indices")
    idx = lists.flatten().to_numpy(zero_copy_only=False)
    val = features.field("values").flatten().to_numpy(zero_copy_only=False)
    sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    for _, rows in parts(weight, sizes, idx, val, k):
        yield rows


def parts(weight: np.ndarray, sizes: np.ndarray, idx: np.ndarray, val: np.ndarray, k: int):
    """Yield (which rows, Rows) with a bounded number of entries."""
    starts = np.concatenate(([0], np.cumsum(sizes)))
    first, budget = 0, max(1, CHUNK_CELLS // k)
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + budget, side="right")) - 1)
        last = min(last, len(sizes), first + budget)
        span = slice(starts[first], starts[last])
        yield slice(first, last), Rows(weight[first:last], starts[first:last], sizes[first:last], idx[span], val[span])
        first = last


def accumulate(rows: DataFrame, k: int, width: int, n_extra: int, state: dict,
               step: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Sum a step's statistics: (K x V per term, K x n_extra beside them).

    Tasks add up their own rows first and emit only the terms they met.
    """
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(state)

    def partial(batches):
        sums = np.zeros((k, width + n_extra))
        for batch in batches:
            weight = batch.column("count").to_numpy(zero_copy_only=False).astype(float)
            for part in chunks(batch.column("features"), weight, k):
                (index, by_term), beside = step(part, sent.value)
                sums[:, index] += by_term
                sums[:, width:] += beside
        met = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(met), *[pa.array(sums[j, met]) for j in range(k)]], names=["term", *[f"s{j}" for j in range(k)]])

    schema = "term bigint, " + ", ".join(f"s{j} double" for j in range(k))
    summed = rows.select("count", "features").mapInArrow(partial, schema).groupBy("term").agg(
        *[F.sum(f"s{j}").alias(f"s{j}") for j in range(k)])
    table = summed.toArrow()
    sent.unpersist()
    out = np.zeros((k, width + n_extra))
    if table.num_rows:
        out[:, table["term"].to_numpy()] = np.stack([table[f"s{j}"].to_numpy() for j in range(k)])
    return out[:, :width], out[:, width:]


def topic_codes(vector: Column, spark: SparkSession, k: int, state: dict, step: Callable) -> Column:
    """Dense code that ``step`` gives each sparse row, as a column."""
    sent = spark.sparkContext.broadcast(state)

    @F.arrow_udf("array<double>")
    def encode(features: pa.Array) -> pa.Array:
        parts = [step(part, sent.value) for part in chunks(features, np.ones(len(features)), k)]
        codes = np.concatenate(parts, axis=1).T if parts else np.zeros((0, k))
        offsets = pa.array(np.arange(len(codes) + 1, dtype=np.int32) * k, type=pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(codes).ravel()))

    return encode(vector)


def text_codes(text: Column, hashed: tuple[int, int, int], spark: SparkSession, k: int, state: dict, step: Callable) -> Column:
    """:func:`topic_codes` of hashed n-grams, which are counted here for some texts at a time."""
    sent = spark.sparkContext.broadcast(state)

    @F.arrow_udf("array<double>")
    def encode(texts: pa.Array) -> pa.Array:
        codes = [np.zeros((k, 0))]
        for first, last, *counts in gram_counts(texts, *hashed):
            codes += [step(part, sent.value) for part in chunks(gram_struct([counts]), np.ones(last - first), k)]
        offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * k, type=pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(np.concatenate(codes, axis=1).T).ravel()))

    return encode(collapsed(text))


# --- gamma-Poisson ---------------------------------------------------------------------


def poisson_activations(rows: Rows, s: dict, max_iter: int, start: np.ndarray | None = None) -> np.ndarray:
    """Multiplicative updates of each row's activations, from given ones or afresh, until its relative change is small."""
    w = s["W"]
    inner = (1 + 1 / s["scale"]) if s["rescale"] else sums_over_terms(s)[:, None] + 1 / s["scale"]
    bias = (s["shape"] - 1) / inner
    out = np.tile(np.maximum(TINY, rows.by_row(rows.val)) / len(w), (len(w), 1)) if start is None else start.copy()
    h, place, gathered = out, np.arange(rows.n), w[:, rows.idx]
    for _ in range(max_iter):
        ratio = rows.val / (rows.spread(h) * gathered).sum(axis=0)
        new = h * rows.by_row(gathered * ratio) / inner + bias
        moving = ((new - h) ** 2).sum(axis=0) > s["eps"] ** 2 * (h ** 2).sum(axis=0)
        out[:, place] = h = new
        if not moving.all():
            rows, h, place = rows.take(moving), h[:, moving], place[moving]
            gathered = w[:, rows.idx]
        if not len(place):
            break
    return out


def sums_over_terms(s: dict) -> np.ndarray:
    """Each topic's sum of weights; given along where W is a slice."""
    return s["sums"] if "sums" in s else s["W"].sum(axis=1)


def fitted_counts(rows: Rows, h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Expected count of each entry."""
    return (rows.spread(h) * w[:, rows.idx]).sum(axis=0)


def poisson_statistics(rows: Rows, s: dict, h: np.ndarray | None = None):
    h = poisson_activations(rows, s, s["e_steps"]) if h is None else h
    ratio = rows.val / fitted_counts(rows, h, s["W"])
    weighted = h * rows.weight
    return rows.by_term(rows.spread(weighted) * ratio), weighted.sum(axis=1, keepdims=True)


def poisson_pass(rows: DataFrame, state: dict, a: np.ndarray, b: np.ndarray, rho: float):
    """One update of (W, A, B) from a set of rows; returns new arrays."""
    k, width = state["W"].shape
    terms, activations = accumulate(rows, k, width, 1, state, poisson_statistics)
    a = rho * a + state["W"] * terms
    b = rho * b + activations
    w = a / b
    if state["rescale"]:
        size = w.sum(axis=1, keepdims=True)
        w, a = w / size, a / size
    return w, a, b


def carried_activations(blocks: RowBlocks, batch: int, carried: DataFrame | None, state: dict, weights, k: int) -> DataFrame:
    """(block, carried): the activations of a batch's rows, updated from those carried along or afresh."""
    def update(block: dict, held: np.ndarray | None, w: np.ndarray):
        s = {**state, "W": w}
        held = None if held is None else held.reshape(k, -1)
        out = np.zeros((k, len(block["sizes"])))
        for span, rows in parts(block["weights"], block["sizes"].astype(np.int64), block["places"], block["values"], k):
            out[:, span] = poisson_activations(rows, s, s["e_steps"], None if held is None else held[:, span])
        yield topic_blocks.carried_row(block, out)

    return topic_blocks.settled_blocks(blocks.run(batch, carried, update, topic_blocks.CARRIED, weights, k))


def carried_statistics(blocks: RowBlocks, batch: int, carried: DataFrame | None, state: dict, weights, k: int, settled: bool) -> DataFrame:
    """(term, s0, ...): a batch's sums by term, and its activations' sum as term -1.

    With ``settled`` the carried activations are the updated ones, else they are updated here and not kept.
    """
    def add(block: dict, held: np.ndarray | None, w: np.ndarray):
        s, sums, beside = {**state, "W": w}, np.zeros((k, len(block["terms"]))), np.zeros((k, 1))
        held = None if held is None else held.reshape(k, -1)
        for span, rows in parts(block["weights"], block["sizes"].astype(np.int64), block["places"], block["values"], k):
            h = None if held is None else held[:, span]
            if not settled:
                h = poisson_activations(rows, s, s["e_steps"], h)
            (index, by_term), activations = poisson_statistics(rows, s, h)
            sums[:, index] += by_term
            beside += activations
        out = np.concatenate((sums, beside), axis=1)
        terms = np.append(block["terms"].astype(np.int64), -1)
        yield pa.RecordBatch.from_arrays([pa.array(terms), *(pa.array(out[j]) for j in range(k))], ["term", *(f"s{j}" for j in range(k))])

    schema = "term long, " + ", ".join(f"s{j} double" for j in range(k))
    return blocks.run(batch, carried, add, schema, weights, k).groupBy("term").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(k)])


class PoissonFit:
    """Weights (W, A, B) of a fit over blocks of rows, with the rows' activations carried from pass to pass.

    Weights are arrays where they are of a checked size, and else a table (term, w, a, before).
    """

    def __init__(self, blocks: RowBlocks, prior: dict, weights, k: int):
        self.blocks, self.prior, self.k = blocks, prior, k
        self.wide = isinstance(weights, DataFrame)
        self.w = checkpointed(weights.withColumn("a", F.array_repeat(F.lit(TINY), k))) if self.wide else weights
        self.a = None if self.wide else np.full(weights.shape, TINY)
        self.b, self.carried, self.before = np.full((k, 1), TINY), {}, None

    def update(self, batch: int, rho: float, keep: bool) -> None:
        """One update of the weights from a batch; ``keep`` carries its activations to its next turn."""
        if batch not in self.blocks.blocks:
            return
        state, held = dict(self.prior), self.carried.get(batch)
        if self.wide:
            if not state["rescale"]:
                state["sums"] = topic_tables.sums_of(self.w, "w", self.k)
        else:
            state["sums"] = self.w.sum(axis=1)
        if keep:
            held = self.carried[batch] = carried_activations(self.blocks, batch, held, state, self.w, self.k)
        found = carried_statistics(self.blocks, batch, held, state, self.w, self.k, keep)
        (self._update_table if self.wide else self._update_arrays)(found, rho)

    def _update_arrays(self, found: DataFrame, rho: float) -> None:
        table = found.toArrow()
        terms, rows = table["term"].to_numpy(), np.stack([table[f"s{j}"].to_numpy() for j in range(self.k)])
        sums = np.zeros(self.w.shape)
        sums[:, terms[terms >= 0]] = rows[:, terms >= 0]
        self.before = self.w
        self.a = rho * self.a + self.w * sums
        self.b = rho * self.b + rows[:, terms < 0]
        self.w = self.a / self.b
        if self.prior["rescale"]:
            size = self.w.sum(axis=1, keepdims=True)
            self.w, self.a = self.w / size, self.a / size

    def _update_table(self, found: DataFrame, rho: float) -> None:
        found = checkpointed(found)
        (beside,) = found.filter("term < 0").collect()
        b = self.b = rho * self.b + np.array(beside[1:])[:, None]

        def change(w, a, s):
            a = rho * a + w * s
            return a / b, a

        sums = found.filter("term >= 0").select("term", F.array(*[f"s{j}" for j in range(self.k)]).alias("s"))
        self.w = topic_tables.updated(self.w, sums, self.k, change)
        if self.prior["rescale"]:
            self.w = topic_tables.scaled(self.w, topic_tables.sums_of(self.w, "w", self.k), ("w", "a"))

    def moved(self) -> float:
        """Relative change of the weights in the last update."""
        if self.wide:
            return topic_tables.moved(self.w)
        return np.linalg.norm(self.w - self.before) / np.linalg.norm(self.before)


class TopicModel(EncoderModel):
    """Weights per topic and term, kept as a table and sent to tasks when encoding."""

    def weights(self) -> np.ndarray:
        if not hasattr(self, "_weights"):
            table = self.tables["weights"].toArrow()
            out = np.empty((self.width, self.meta["terms"]))
            columns = table["term"].to_numpy()
            out[:, columns] = np.array(table["w"].combine_chunks().flatten()).reshape(len(columns), self.width).T
            self._weights = out
        return self._weights

    @property
    def broadcast(self) -> bool:
        return self.width * self.meta["terms"] <= BROADCAST_WEIGHTS

    @property
    def local(self) -> bool:
        return all(b.local for b in self.blocks())

    def state(self) -> dict:
        if self.broadcast:
            return {**self.meta["state"], "W": self.weights()}
        return {**self.meta["state"], "sums": topic_tables.sums_of(self.tables["weights"], "w", self.width)}

    def step(self) -> Callable:
        """The function from (Rows, state) to codes (K x n)."""
        raise NotImplementedError

    def blocks(self) -> list[Terms]:
        if not hasattr(self, "_blocks"):
            self._blocks = blocks_of(self.meta, self.tables)
        return self._blocks

    def encode(self, keys: DataFrame) -> DataFrame:
        if self.broadcast and self.local:
            return self._coded(keys, "key").select("key", "features")
        if self.broadcast:
            rows = term_rows(keys, self.blocks())
            return rows.select("key", topic_codes(F.col("features"), keys.sparkSession, self.width, self.state(), self.step()).alias("features"))
        rows = topic_tables.blocked(term_rows(keys, self.blocks()))
        return topic_tables.codes(rows, self.tables["weights"], self.width, self.state(), self.step())

    def in_place(self, rows: DataFrame) -> DataFrame | None:
        """Rows coded without a shuffle where the weights can be broadcast; tables are coded by a join otherwise."""
        return self._coded(rows, "_key") if self.broadcast and self.local else None

    def encode_rows(self, rows: DataFrame) -> DataFrame:
        if self.broadcast and self.local or rows.isStreaming or self.meta.get("dedupe", True):
            return super().encode_rows(rows)
        encoded = self.encode(rows.select(F.col("_key").alias("key")).distinct())
        return rows.join(encoded.withColumnRenamed("key", "_key"), "_key", "left")

    def _coded(self, df: DataFrame, key: str) -> DataFrame:
        if hashed := hashed_grams(self.blocks()):
            return df.withColumn("features", text_codes(F.col(key), hashed, df.sparkSession, self.width, self.state(), self.step()))
        vector = block_vector(F.col(key), self.blocks())
        return df.withColumn("features", topic_codes(vector, df.sparkSession, self.width, self.state(), self.step()))


class GammaPoissonModel(TopicModel):
    def step(self) -> Callable:
        steps = self.meta["transform_steps"]
        return lambda rows, s: poisson_activations(rows, s, steps)

    def score(self, df: DataFrame) -> float:
        """Generalised Kullback-Leibler divergence, every row counted."""
        keys = df.groupBy(F.coalesce(F.col(self.getInputCol()).cast("string"), F.lit("nan")).alias("key")).agg(
            F.count(F.lit(1)).alias("count"))
        steps = self.meta["state"]["e_steps"]

        def divergence(rows: Rows, s: dict):
            h = poisson_activations(rows, s, steps)
            inside = rows.by_row(rows.val * np.log(rows.val / fitted_counts(rows, h, s["W"])) - rows.val)
            total = inside + sums_over_terms(s) @ h
            nothing = (np.zeros(0, np.int64), np.zeros((len(s["W"]), 0)))
            return nothing, np.full((len(s["W"]), 1), (rows.weight * total).sum())

        rows = term_rows(keys, self.blocks())
        if self.broadcast:
            _, extra = accumulate(rows, self.width, self.meta["terms"], 1, self.state(), divergence)
            return float(extra[0, 0])

        # The divergence has no statistics by term, and sums them as an empty list.
        _, extra = topic_tables.accumulate(topic_tables.blocked(rows), self.tables["weights"], self.width, 1, self.state(), divergence)
        return float(extra[0, 0])

    def topic_labels(self, n_top: int = 3) -> DataFrame:
        """(topic, label): strongest words of the fitted strings by their own encoding."""
        from lexiloom.operators.counts import topic_top_words

        words = self.tables["words"].select(F.col("word").alias("key"))
        encoded = self.encode(words)
        share = F.col("weight") / F.aggregate("features", F.lit(0.0), lambda s, x: s + F.abs(x))
        long = cells(encoded, [F.col("key").alias("word"), "features"], "features", "topic", "weight")
        return topic_top_words(long.select("topic", "word", share.alias("weight")), n_top)


def dense_rows(picks: list, width: int) -> np.ndarray:
    """Starting rows as an array."""
    out = np.zeros((len(picks), width))
    for i, features in enumerate(picks):
        out[i, features["indices"]] = features["values"]
    return out


def frequent_rows(rows: DataFrame, k: int) -> list:
    """The k most frequent strings as starting rows."""
    found = rows.orderBy(F.desc("count"), "key").limit(k).collect()
    return [r["features"] for r in sorted(found, key=lambda r: (-r["count"], r["key"]))]


class _TopicEncoder(EncoderEstimator):
    nTopics = param("nTopics", "number of topics", TypeConverters.toInt)
    analyzer = param("analyzer", "'char' or 'word'", TypeConverters.toString)
    ngramMin = param("ngramMin", "smallest n-gram", TypeConverters.toInt)
    ngramMax = param("ngramMax", "largest n-gram", TypeConverters.toInt)
    seed = param("seed", "seed of the starting point", TypeConverters.toInt)
    maxIter = param("maxIter", "passes over the table", TypeConverters.toInt)
    tol = param("tol", "stop when the weights change less", TypeConverters.toFloat)
    shared = {"nTopics": 10, "analyzer": "char", "ngramMin": 2, "ngramMax": 4, "seed": 18, "maxIter": 5, "tol": 1e-4}

    def kept_keys(self, df: DataFrame) -> DataFrame:
        """Distinct strings aggregated once, kept reliably, on at least as many partitions as cores."""
        return spread(checkpointed(self.keys(df)))

    def columns(self, keys: DataFrame, hashed: int = 0, add_words: bool = False) -> tuple[dict, dict]:
        """Blocks of term columns and the vocabularies behind them."""
        shapes = [(self.get("analyzer"), self.get("ngramMin"), self.get("ngramMax"))]
        if add_words:
            shapes.append(("word", 1, 1))
        blocks, tables = [], {}
        for i, (analyzer, lo, hi) in enumerate(shapes):
            block = {"analyzer": analyzer, "lo": lo, "hi": hi, "terms": f"terms{i}", "width": hashed}
            if not hashed:
                tables[f"terms{i}"], block["width"] = fitted_vocabulary(keys, analyzer, lo, hi)
            blocks.append(block)
        return {"blocks": blocks, "terms": sum(b["width"] for b in blocks)}, tables

    def wide(self, meta: dict) -> bool:
        """Whether the weights stay a table."""
        return meta["terms"] * self.get("nTopics") > BROADCAST_WEIGHTS

    def weights_table(self, df: DataFrame, w: np.ndarray) -> DataFrame:
        table = pa.table({"term": pa.array(np.arange(w.shape[1], dtype=np.int64)), "w": pa.array(list(w.T))})
        return df.sparkSession.createDataFrame(table)


class GammaPoissonEncoder(_TopicEncoder):
    """Gamma-Poisson factorization of term counts, fitted in macro-batches.

    ``r`` is the memory kept over one pass, ``rho`` the memory kept over ``batchSize``
    rows; ``r`` wins when both are given.
    """

    r = param("r", "share of the statistics kept over a pass", TypeConverters.toFloat)
    rho = param("rho", "share of the statistics kept over batchSize rows", TypeConverters.toFloat)
    batchSize = param("batchSize", "rows rho refers to", TypeConverters.toInt)
    macroBatches = param("macroBatches", "weight updates per pass", TypeConverters.toInt)
    init = param("init", "k-means++, k-means, frequent (the most frequent strings) or random", TypeConverters.toString)
    shape = param("shape", "shape of the gamma prior", TypeConverters.toFloat)
    scale = param("scale", "scale of the gamma prior", TypeConverters.toFloat)
    rescale = param("rescale", "keep each topic's weights summing to one", TypeConverters.toBoolean)
    eSteps = param("eSteps", "activation updates per row in fit", TypeConverters.toInt)
    transformSteps = param("transformSteps", "activation updates per row when encoding", TypeConverters.toInt)
    minIter = param("minIter", "passes before stopping", TypeConverters.toInt)
    hashing = param("hashing", "hash terms instead of fitting a vocabulary", TypeConverters.toBoolean)
    nFeatures = param("nFeatures", "hash width", TypeConverters.toInt)
    addWords = param("addWords", "add a block of word counts", TypeConverters.toBoolean)
    defaults = {**_TopicEncoder.shared, "batchSize": 512, "macroBatches": 8, "init": "k-means++", "shape": 1.1,
                "scale": 1.0, "rescale": True, "eSteps": 20, "transformSteps": 100, "minIter": 2,
                "hashing": False, "nFeatures": 4096, "addWords": False}

    def prior(self) -> dict:
        return {"shape": self.get("shape"), "scale": self.get("scale"), "rescale": self.get("rescale"),
                "eps": 1e-3, "e_steps": self.get("eSteps")}

    def picks(self, keys: DataFrame, rows: DataFrame, blocks: RowBlocks, meta: dict, tables: dict) -> list:
        """Rows the topics start from."""
        k, seed, init = self.get("nTopics"), self.get("seed"), self.get("init")
        if init == "frequent":
            return frequent_rows(rows, k)
        if init == "k-means++":
            return starting_rows(blocks, k, seed)
        if init == "k-means":
            from lexiloom.operators.prototypes import kmeans_prototypes

            near = term_rows(kmeans_prototypes(keys, k, seed), blocks_of(meta, tables)).collect()
            found = [r["features"] for r in sorted(near, key=lambda r: r["key"])]
            return found + (starting_rows(blocks, k - len(found), seed) if len(found) < k else [])
        raise ValueError(f"unknown start {init!r}")

    def start(self, keys: DataFrame, rows: DataFrame, blocks: RowBlocks, meta: dict, tables: dict):
        """Starting weights: an array, or a table (term, w) where they are too many."""
        k, width, seed = self.get("nTopics"), meta["terms"], self.get("seed")
        wide = self.wide(meta)
        if self.get("init") == "random":
            shape, scale = self.get("shape"), self.get("scale")
            draw = lambda r: r.gamma(shape, scale, k)
            if wide:
                table = checkpointed(topic_tables.drawn_table(keys.sparkSession, width, seed, draw))
                return topic_tables.scaled(table, topic_tables.sums_of(table, "w", k), ("w",))
            w = topic_tables.drawn(seed, range(width), draw).T
        else:
            picks = self.picks(keys, rows, blocks, meta, tables)
            if wide:
                entries = [(i, int(t), float(v)) for i, p in enumerate(picks) for t, v in zip(p["indices"], p["values"])]
                return topic_tables.from_sparse(keys.sparkSession, entries, k, width, 0.1)
            w = dense_rows(picks, width) + 0.1
        return w / w.sum(axis=1, keepdims=True)

    def schedule(self, n_rows: int) -> tuple[int, float]:
        """Weight updates per pass, and the memory each keeps.

        A small table gets the updates its batches of ``batchSize`` rows would give; a
        large one stops at ``macroBatches``, with the memory of a pass unchanged.
        """
        batches = min(self.get("macroBatches"), -(-n_rows // self.get("batchSize")))
        if self.isSet("r") or not self.isSet("rho"):
            return batches, (self.get("r") if self.isSet("r") else 0.7) ** (1 / batches)
        return batches, self.get("rho") ** (n_rows / (self.get("batchSize") * batches))

    def begin(self, df: DataFrame, keys: DataFrame):
        hashed = self.get("nFeatures") if self.get("hashing") else 0
        meta, tables = self.columns(keys, hashed, self.get("addWords"))
        rows = term_rows(keys, blocks_of(meta, tables)).persist()
        blocks = row_blocks(keys, rows, blocks_of(meta, tables), seed=self.get("seed"))
        w = self.start(keys, rows, blocks, meta, tables)
        blocks.close()
        return meta, tables, rows, w

    def finish(self, df: DataFrame, keys: DataFrame, meta: dict, tables: dict, k: int, weights: DataFrame) -> GammaPoissonModel:
        from lexiloom.functions.text import word_tokens

        words = exploded(keys, [], word_tokens(F.col("key")), "word").distinct()
        meta = {**meta, "width": k, "state": self.prior(), "transform_steps": self.get("transformSteps")}
        return self.build(GammaPoissonModel({**tables, "weights": weights, "words": words}, meta))

    def _fit(self, df):
        keys = self.kept_keys(df)
        hashed = self.get("nFeatures") if self.get("hashing") else 0
        meta, tables = self.columns(keys, hashed, self.get("addWords"))
        rows = term_rows(keys, blocks_of(meta, tables))
        batches, rho = self.schedule(keys.agg(F.sum("count")).first()[0])
        blocks = row_blocks(keys, rows, blocks_of(meta, tables), batches, self.get("seed"))
        weights = self.start(keys, rows, blocks, meta, tables)
        k = self.get("nTopics") if isinstance(weights, DataFrame) else len(weights)
        fit, last = PoissonFit(blocks, self.prior(), weights, k), self.get("maxIter")
        for done in range(1, last + 1):
            for batch in range(batches):
                fit.update(batch, rho, keep=done < last)
            if done >= self.get("minIter") and done < last and fit.moved() < self.get("tol"):
                break
        blocks.close()
        return self.finish(df, keys, meta, tables, k, fit.w.select("term", "w") if fit.wide else self.weights_table(df, fit.w))


# --- Frobenius factorization -----------------------------------------------------------


def frobenius_activations(rows: Rows, s: dict) -> np.ndarray:
    w = s["W"]
    gram = s["gram"] if "gram" in s else w @ w.T
    target = rows.by_row(w[:, rows.idx] * rows.val)
    h = np.tile(np.maximum(TINY, rows.by_row(rows.val)) / len(w), (len(w), 1))
    for _ in range(s["e_steps"]):
        h = h * target / np.maximum(gram @ h, TINY)
    return h


def frobenius_statistics(rows: Rows, s: dict):
    h = frobenius_activations(rows, s)
    weighted = h * rows.weight
    return rows.by_term(rows.spread(weighted) * rows.val), weighted @ h.T


class NmfModel(TopicModel):
    def state(self) -> dict:
        if self.broadcast:
            return super().state()
        return {**self.meta["state"], "gram": topic_tables.gram_of(self.tables["weights"], self.width)}

    def step(self) -> Callable:
        return frobenius_activations


class NmfEncoder(_TopicEncoder):
    """Non-negative factorization of term counts under squared error."""

    eSteps = param("eSteps", "activation updates per row", TypeConverters.toInt)
    defaults = {**_TopicEncoder.shared, "maxIter": 20, "eSteps": 30}

    def _fit(self, df):
        keys = self.kept_keys(df)
        meta, tables = self.columns(keys)
        if self.wide(meta):
            return self._fit_wide(keys, meta, tables)
        rows = term_rows(keys, blocks_of(meta, tables)).persist()
        w = dense_rows(starting_rows(RowBlocks(rows, seed=self.get("seed")), self.get("nTopics"), self.get("seed")), meta["terms"]) + 0.1
        state = {"e_steps": self.get("eSteps")}
        for _ in range(self.get("maxIter")):
            hv, hh = accumulate(rows, len(w), meta["terms"], len(w), {**state, "W": w}, frobenius_statistics)
            new = w * hv / np.maximum(hh @ w, TINY)
            change = np.linalg.norm(new - w) / np.linalg.norm(w)
            w = new
            if change < self.get("tol"):
                break
        rows.unpersist()
        meta = {**meta, "width": len(w), "state": state}
        return self.build(NmfModel({**tables, "weights": self.weights_table(df, w)}, meta))

    def _fit_wide(self, keys: DataFrame, meta: dict, tables: dict) -> NmfModel:
        """The same with the weights as a table."""
        k, state = self.get("nTopics"), {"e_steps": self.get("eSteps")}
        rows = topic_tables.blocked(term_rows(keys, blocks_of(meta, tables))).persist()
        picks = starting_rows(RowBlocks(rows, seed=self.get("seed")), k, self.get("seed"))
        entries = [(i, int(t), float(v)) for i, p in enumerate(picks) for t, v in zip(p["indices"], p["values"])]
        weights = checkpointed(topic_tables.from_sparse(keys.sparkSession, entries, k, meta["terms"], 0.1, unit=False)
                               .withColumn("a", F.array_repeat(F.lit(0.0), k)))
        for _ in range(self.get("maxIter")):
            gram = topic_tables.gram_of(weights, k)
            hv, hh = topic_tables.accumulate(rows, weights, k, k, {**state, "gram": gram}, frobenius_statistics)
            weights = topic_tables.updated(weights, hv, k, lambda w, a, s, hh=hh: (w * s / np.maximum(hh @ w, TINY), a))
            if topic_tables.moved(weights) < self.get("tol"):
                break
        rows.unpersist()
        return self.build(NmfModel({**tables, "weights": weights.select("term", "w")}, {**meta, "width": k, "state": state}))


# --- mixture of unigrams ---------------------------------------------------------------


def mixture_scores(rows: Rows, s: dict) -> tuple[np.ndarray, np.ndarray]:
    """log P(string | topic), and with the topic's own probability added."""
    log_likelihood = rows.by_row(np.log(s["W"])[:, rows.idx] * rows.val) - 1
    return log_likelihood, log_likelihood + np.log(s["theta"])[:, None]


def log_total(scores: np.ndarray) -> np.ndarray:
    top = scores.max(axis=0)
    return top + np.log(np.exp(scores - top).sum(axis=0))


def mixture_statistics(rows: Rows, s: dict):
    _, joint = mixture_scores(rows, s)
    posterior = np.exp(joint - log_total(joint)) * rows.weight
    return rows.by_term(rows.spread(posterior) * rows.val), posterior.sum(axis=1, keepdims=True)


def mixture_codes(rows: Rows, s: dict) -> np.ndarray:
    alone, joint = mixture_scores(rows, s)
    return np.exp((alone if s["fisher"] else joint) - log_total(joint))


def mixture_pass(rows: DataFrame, beta: np.ndarray, theta: np.ndarray, n_rows: int):
    """One round of expectation and smoothed maximisation."""
    k, width = beta.shape
    terms, mass = accumulate(rows, k, width, 1, {"W": beta, "theta": np.asarray(theta)}, mixture_statistics)
    beta = (1 + terms) / (width + terms.sum(axis=1, keepdims=True))
    return beta, (1 + mass[:, 0]) / (k + n_rows)


class MixtureModel(TopicModel):
    def step(self) -> Callable:
        return mixture_codes

    def state(self) -> dict:
        return {**super().state(), "theta": np.array(self.meta["theta"])}


class MixtureEncoder(_TopicEncoder):
    """Mixture of unigrams: topic posteriors, or the Fisher vector when ``fisher``."""

    fisher = param("fisher", "emit P(string | topic) / P(string) instead of posteriors", TypeConverters.toBoolean)
    init = param("init", "most-frequent-categories, constant or random", TypeConverters.toString)
    defaults = {**_TopicEncoder.shared, "seed": 42, "maxIter": 100, "tol": 1e-5, "fisher": True,
                "init": "most-frequent-categories"}

    def start(self, keys: DataFrame, meta: dict, tables: dict) -> tuple[np.ndarray, np.ndarray]:
        k, init = self.get("nTopics"), self.get("init")
        frequent = keys.orderBy(F.desc("count"), "key").limit(k)
        rows = term_rows(frequent, blocks_of(meta, tables)).collect()
        rows.sort(key=lambda r: (-r["count"], r["key"]))
        counts = np.full((len(rows), meta["terms"]), 1e-5)
        for i, row in enumerate(rows):
            counts[i, row["features"]["indices"]] += row["features"]["values"]
        size = counts.sum(axis=1, keepdims=True)
        if init == "constant":
            counts = np.ones_like(counts)
        elif init == "random":
            counts = topic_tables.drawn(self.get("seed"), range(meta["terms"]), lambda r: r.uniform(0, 1, len(rows)) + 1e-5).T
        elif init != "most-frequent-categories":
            raise ValueError(f"unknown start {init!r}")
        return counts / size, np.array([row["count"] for row in rows]) / k

    def _fit(self, df):
        keys = self.kept_keys(df)
        meta, tables = self.columns(keys)
        if self.wide(meta):
            return self._fit_wide(keys, meta, tables)
        rows = term_rows(keys, blocks_of(meta, tables)).persist()
        beta, theta = self.start(keys, meta, tables)
        n_rows = rows.agg(F.sum("count")).first()[0]
        for _ in range(self.get("maxIter")):
            last = beta
            beta, theta = mixture_pass(rows, beta, theta, n_rows)
            if np.abs(last - beta).sum(axis=1).max() < self.get("tol"):
                break
        rows.unpersist()
        meta = {**meta, "width": len(beta), "theta": [float(t) for t in theta], "state": {"fisher": self.get("fisher")}}
        return self.build(MixtureModel({**tables, "weights": self.weights_table(df, beta)}, meta))

    def _fit_wide(self, keys: DataFrame, meta: dict, tables: dict) -> MixtureModel:
        """The same with the weights as a table."""
        width, init = meta["terms"], self.get("init")
        frequent = term_rows(keys.orderBy(F.desc("count"), "key").limit(self.get("nTopics")), blocks_of(meta, tables)).collect()
        frequent.sort(key=lambda r: (-r["count"], r["key"]))
        k, spark = len(frequent), keys.sparkSession
        entries = [(i, int(t), float(v)) for i, r in enumerate(frequent) for t, v in zip(r["features"]["indices"], r["features"]["values"])]
        weights = topic_tables.from_sparse(spark, entries, k, width, 1e-5)
        if init != "most-frequent-categories":
            size = np.array([1e-5 * width + sum(r["features"]["values"]) for r in frequent])
            if init not in ("constant", "random"):
                raise ValueError(f"unknown start {init!r}")
            draw = (lambda r: np.ones(k)) if init == "constant" else (lambda r: r.uniform(0, 1, k) + 1e-5)
            weights = topic_tables.scaled(topic_tables.drawn_table(spark, width, self.get("seed"), draw), size, ("w",))
        weights = checkpointed(weights.withColumn("a", F.array_repeat(F.lit(0.0), k)))
        theta = np.array([r["count"] for r in frequent]) / self.get("nTopics")
        rows = topic_tables.blocked(term_rows(keys, blocks_of(meta, tables))).persist()
        n_rows = rows.agg(F.sum("count")).first()[0]
        for _ in range(self.get("maxIter")):
            terms, mass = topic_tables.accumulate(rows, weights, k, 1, {"theta": theta}, mixture_statistics)
            total = topic_tables.sums_of(terms, "s", k)[:, None]
            weights = topic_tables.updated(weights, terms, k, lambda w, a, s, total=total: ((1 + s) / (width + total), a))
            theta = (1 + mass[:, 0]) / (k + n_rows)
            apart = weights.agg(*[F.sum(F.abs(F.col("w")[j] - F.col("before")[j])) for j in range(k)]).first()
            if max(apart) < self.get("tol"):
                break
        rows.unpersist()
        meta = {**meta, "width": k, "theta": [float(t) for t in theta], "state": {"fisher": self.get("fisher")}}
        return self.build(MixtureModel({**tables, "weights": weights.select("term", "w")}, meta))


# --- latent Dirichlet allocation -------------------------------------------------------


# Bytes of a row of counts, and for each character, that a fit keeps.
ROW_BYTES, CHAR_BYTES = 100, 40


class LdaEncoderModel(EncoderModel):
    """Topic mixture of a built-in LDA model over term counts."""

    def __init__(self, tables=None, meta=None, counts=None, lda=None):
        super().__init__(tables, meta)
        self.counts, self.lda = counts, lda

    def parts(self) -> dict:
        return {"counts": self.counts, "lda": self.lda}

    def encode(self, keys: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        rows = self.counts.encode(keys)
        vectors = rows.select("key", self.counts.as_vector(rows).alias("_counts"))
        return self.lda.transform(vectors).select("key", vector_to_array("topicDistribution").alias("features"))


class LdaEncoder(_TopicEncoder):
    optimizer = param("optimizer", "'em' or 'online'", TypeConverters.toString)
    defaults = {**_TopicEncoder.shared, "maxIter": 10, "optimizer": "online"}

    def _fit(self, df):
        from pyspark.ml.clustering import LDA

        from lexiloom.operators.grams import TermCountEncoder

        counts = TermCountEncoder(inputCol=self.getInputCol(), outputCol="_counts", analyzer=self.get("analyzer"),
                                  ngramMin=self.get("ngramMin"), ngramMax=self.get("ngramMax")).fit(df)
        # Every pass reads all rows: large tables are dealt into bounded partitions, before they are coded and, as codes
        # may come from a join, after it.
        rows = df.select(self.getInputCol())
        length = F.char_length(F.coalesce(F.col(self.getInputCol()).cast("string"), F.lit("")))
        parts = portions(rows, F.lit(ROW_BYTES) + F.lit(CHAR_BYTES) * length)
        vectors = counts.transform(rows.repartition(parts) if parts else rows).select("_counts")
        vectors = (vectors.repartition(parts) if parts else vectors).persist()
        lda = LDA(k=self.get("nTopics"), maxIter=self.get("maxIter"), seed=self.get("seed"),
                  optimizer=self.get("optimizer"), featuresCol="_counts").fit(vectors)
        vectors.unpersist()
        return self.build(LdaEncoderModel(meta={"width": self.get("nTopics")}, counts=counts, lda=lda))
