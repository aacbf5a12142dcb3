"""Categorical encoders, each fitted and applied on whole columns."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lexiloom.functions.arrays import exploded
from lexiloom.functions.text import char_ngrams
from lexiloom.operators.grams import MinHashEncoder, WordVectorEncoder
from lexiloom.operators.kernels import FisherKernelEncoder, SimilarityEncoder
from lexiloom.operators.lookup import (
    BaseNEncoder, ClassFrequencyEncoder, ContrastEncoder, HashCodeEncoder, LeaveOneOutEncoder, OneHotEncoder,
    PassthroughEncoder, TargetMeanEncoder, leave_one_out_train,
)
from lexiloom.plans import encoders
from lexiloom.plans.catalog.common import (
    codes_of, grams_sql, long_codes, murmur_sql, padded_grams_sql, rounded, table, texts,
)
from lexiloom.session import scratch_path


def columns(column: str) -> dict:
    return {"inputCol": column, "outputCol": "code"}


def on_part(estimator_of, column: str, places: int = 6):
    """Query: fit on ``part`` and list the code of each distinct string."""
    def query(spark, sf_dir):
        part = table(spark, sf_dir, "part")
        return codes_of(estimator_of(column).fit(part), part, column, places)
    return query


def one_hot_query(drop_last: bool):
    def query(spark, sf_dir):
        part = table(spark, sf_dir, "part")
        model = OneHotEncoder(dropLast=drop_last, **columns("p_type")).fit(part)
        coded = model.transform(part).groupBy(F.col("p_type").alias("key")).agg(
            F.first(vector_to_array("code")).alias("features"))
        return long_codes(coded)
    return query


TEN = {"categories": "most_frequent", "nPrototypes": 10}


def similarity(column: str = "p_name", name: str = "part", **categories):
    """Similarities to the categories that share an n-gram."""
    def query(spark, sf_dir):
        rows = table(spark, sf_dir, name)
        model = SimilarityEncoder(**categories, **columns(column)).fit(rows)
        keys = rows.select(F.col(column).alias("key")).distinct()
        return model.encode_long(keys).withColumn("value", rounded("value"))
    return query


def similarity_ten(spark, sf_dir):
    """Similarities of part names to each of the ten most frequent, zeros included; without an n-gram there is none."""
    part = table(spark, sf_dir, "part")
    model = SimilarityEncoder(**TEN, **columns("p_name")).fit(part)
    keys = part.select(F.col("p_name").alias("key")).distinct().filter(F.size(char_ngrams(F.col("key"))) > 0)
    held = model.tables["index"].select("component").distinct()
    return long_codes(model.encode_dense(keys)).join(F.broadcast(held), "component", "left_semi").select("key", "component", "value")


def fisher(compare: str, theta: str, column: str = "p_name", name: str = "part", **categories):
    def query(spark, sf_dir):
        rows = table(spark, sf_dir, name)
        model = FisherKernelEncoder(compare=compare, theta=theta, **categories, **columns(column)).fit(rows)
        return codes_of(model, rows, column, 4)
    return query


def fisher_names_reduced(spark, sf_dir):
    """Kernels of all customer names with each other, projected without being written out."""
    customers = table(spark, sf_dir, "customer")
    model = encoders.column_encoder("NgramNaiveFisherKernel", "c_name", "code", "GaussianRandomProjection", 4).fit(customers)
    return codes_of(model, customers, "c_name", 2)


def minhash(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    model = MinHashEncoder(nComponents=10, **columns("c_name")).fit(customers)
    return codes_of(model, customers, "c_name", 9)


def minhash_rows(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    coded = MinHashEncoder(nComponents=30, **columns("p_name")).fit(part).transform(part)
    code = F.transform(vector_to_array("code"), lambda x: F.round(x, 9) + F.lit(0.0))
    return coded.select("p_partkey", "p_name", F.array_join(F.transform(code, lambda x: F.format_number(x, 9)), ",").alias("code"))


def minhash_texts(spark, sf_dir):
    """Whole texts, coded in place by document; checked against brute force in the tests."""
    docs = texts(spark, sf_dir, "documents").select("doc_id", "text")
    coded = MinHashEncoder(nComponents=8, dedupe=False, **columns("text")).fit(docs).transform(docs)
    return coded.select("doc_id", F.posexplode(vector_to_array("code")).alias("component", "value")).withColumn(
        "value", rounded("value", 9))


def target_mean_classes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    model = TargetMeanEncoder(labelCol="p_type", task="multiclass", **columns("p_brand")).fit(part)
    return codes_of(model, part, "p_brand")


def class_frequency(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    model = ClassFrequencyEncoder(labelCol="l_linestatus", task="binary", **columns("l_returnflag")).fit(items)
    return codes_of(model, items, "l_returnflag", 9)


def loo_target_train(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    out = leave_one_out_train(part, "p_brand", "p_retailprice", "code")
    return out.select("p_partkey", rounded("code").alias("code"))


def pretrained_vectors(spark, sf_dir):
    """Word vectors: the distinct words in order take the embeddings in order."""
    from lexiloom.operators.ranking import dense_ordinals

    part = table(spark, sf_dir, "part")
    words = exploded(part, [], F.split("p_name", " "), "word").distinct()
    vectors = dense_ordinals(words, "word", "vec_id").join(table(spark, sf_dir, "embeddings"), "vec_id").select(
        "word", F.col("embedding").alias("vector"))
    model = WordVectorEncoder(vectors=vectors, **columns("p_name")).fit(part)
    return codes_of(model, part, "p_name")


def passthrough(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    coded = PassthroughEncoder(**columns("p_size")).fit(part).transform(part)
    return coded.select("p_partkey", vector_to_array("code")[0].alias("value"))


def column_encoder(spark, sf_dir):
    """The wrapper: encoder by name, fitted and applied through a pipeline stage."""
    part = table(spark, sf_dir, "part")
    stage = encoders.column_encoder("TargetEncoder", "p_name", "code", task="regression", label="p_retailprice")
    coded = stage.fit(part).transform(part)
    return coded.select("p_partkey", rounded(vector_to_array("code")[0]).alias("code"))


def encoder_protocol(spark, sf_dir):
    """A fitted pipeline saved, loaded and applied."""
    part = table(spark, sf_dir, "part")
    path = scratch_path(spark, "model")
    fitted = PipelineModel([BaseNEncoder(base=3, **columns("p_brand")).fit(part)])
    fitted.write().overwrite().save(path)
    coded = PipelineModel.load(path).transform(part)
    digits = F.transform(vector_to_array("code"), lambda x: x.cast("int").cast("string"))
    return coded.select("p_partkey", F.array_join(digits, "").alias("digits"))


def encoder_registry(spark, sf_dir):
    """A newly registered encoder used by name."""
    encoders.register("Base16", lambda column, options: BaseNEncoder(base=16, **column))
    part = table(spark, sf_dir, "part")
    model = encoders.column_encoder("Base16", "p_brand", "code").fit(part)
    return codes_of(model, part, "p_brand")


def contrast(kind: str, **more):
    return lambda column: ContrastEncoder(kind=kind, **columns(column), **more)


QUERIES = {
    "one_hot": one_hot_query(False),
    "one_hot_drop_last": one_hot_query(True),
    "similarity": similarity_ten,
    "similarity_all": similarity(),
    "similarity_names": similarity("c_name", "customer", **TEN),
    "fisher_kernel_count_uniform": fisher("count", "uniform", **TEN),
    "fisher_kernel_presence_frequency": fisher("presence", "frequency", **TEN),
    "fisher_kernel_presence_uniform": fisher("presence", "uniform", **TEN),
    "fisher_kernel_all": fisher("count", "uniform"),
    "fisher_kernel_all_presence": fisher("presence", "frequency"),
    "fisher_kernel_names": fisher("count", "uniform", "c_name", "customer", **TEN),
    "fisher_names_reduced": fisher_names_reduced,
    "minhash": minhash,
    "minhash_rows": minhash_rows,
    "minhash_texts": minhash_texts,
    "target_mean": on_part(lambda c: TargetMeanEncoder(labelCol="p_retailprice", **columns(c)), "p_brand"),
    "target_mean_multiclass": target_mean_classes,
    "class_frequency": class_frequency,
    "loo_target": on_part(lambda c: LeaveOneOutEncoder(labelCol="p_retailprice", **columns(c)), "p_brand"),
    "loo_target_train": loo_target_train,
    "binary_code": on_part(lambda c: BaseNEncoder(base=2, **columns(c)), "p_name"),
    "base_n_code": on_part(lambda c: BaseNEncoder(base=5, **columns(c)), "p_name"),
    "hash_code": on_part(lambda c: HashCodeEncoder(nComponents=8, **columns(c)), "p_name"),
    "hash_code_eleven": on_part(lambda c: HashCodeEncoder(nComponents=11, **columns(c)), "p_name"),
    "contrast_sum": on_part(contrast("sum"), "p_brand"),
    "contrast_helmert": on_part(contrast("helmert", intercept=True), "p_brand"),
    "contrast_backward": on_part(contrast("backward"), "p_brand"),
    "contrast_poly": on_part(contrast("polynomial"), "p_brand"),
    **{f.__name__: f for f in (pretrained_vectors, passthrough, column_encoder, encoder_protocol, encoder_registry)},
}

# --- SQL -------------------------------------------------------------------------------


def _ordinals(column: str) -> str:
    return f"""o AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS i, count(*) OVER () AS k
                     FROM (SELECT DISTINCT {column} AS key FROM part))"""


def _cells(column: str, value: str, width: str, places: int = 6) -> str:
    """One value per category and component j, from ordinal i of k."""
    return f"""
        WITH {_ordinals(column)}, j AS (SELECT unnest(range(0, (SELECT ({width})::BIGINT FROM o LIMIT 1))) AS j)
        SELECT key, j AS component, round(({value})::DOUBLE, {places}) + 0.0e0 AS value FROM o, j"""


def _digits(column: str, base: int) -> str:
    width = f"(SELECT min(d) FROM range(1, 64) AS r(d) WHERE {base} ** d > k)"
    return f"""
        WITH {_ordinals(column)}, w AS (SELECT min(d) AS w FROM range(1, 20) AS r(d), o WHERE {base}::DOUBLE ** d > k),
             j AS (SELECT unnest(range(0, (SELECT w FROM w))) AS j)
        SELECT key, j AS component, ((i + 1) // ({base}::DOUBLE ** (w - 1 - j))::BIGINT % {base})::DOUBLE AS value
        FROM o, j, w"""


def _kernel_keys(column: str, name: str, limit: int | None) -> str:
    """Distinct strings, and the categories: all of them, or the most frequent."""
    most = f"ORDER BY 2 DESC, 1 LIMIT {limit}" if limit else ""
    return f"""keys AS (SELECT DISTINCT {column} AS key FROM {name}),
             top AS (SELECT {column} AS key, count(*) AS n FROM {name} GROUP BY 1 {most}),
             cats AS (SELECT key, n, row_number() OVER (ORDER BY key) - 1 AS j FROM top)"""


def _similarity_sql(column: str = "p_name", name: str = "part", limit: int | None = 10) -> str:
    return f"""
    WITH {_kernel_keys(column, name, limit)}, g AS ({grams_sql('keys')}),
         c AS (SELECT key, term, count(*) AS c FROM g GROUP BY 1, 2), s AS (SELECT key, sum(c) AS s FROM c GROUP BY 1),
         shared AS (SELECT a.key, cats.j, sum(least(a.c, b.c)) AS m, cats.key AS cat
                    FROM c AS a JOIN c AS b USING (term) JOIN cats ON cats.key = b.key GROUP BY ALL)
    SELECT s.key, shared.j AS component, round(m::DOUBLE / (s.s + t.s - m)::DOUBLE, 6) + 0.0e0 AS value
    FROM shared JOIN s ON s.key = shared.key JOIN s AS t ON t.key = shared.cat"""


SIMILARITY_SQL = f"""
    WITH {_kernel_keys("p_name", "part", 10)}, g AS ({grams_sql('keys')}),
         c AS (SELECT key, term, count(*) AS c FROM g GROUP BY 1, 2), s AS (SELECT key, sum(c) AS s FROM c GROUP BY 1),
         shared AS (SELECT a.key, cats.j, sum(least(a.c, b.c)) AS m
                    FROM c AS a JOIN c AS b USING (term) JOIN cats ON cats.key = b.key GROUP BY 1, 2)
    SELECT s.key, cats.j AS component,
           round(coalesce(m, 0)::DOUBLE / (s.s + t.s - coalesce(m, 0))::DOUBLE, 6) + 0.0e0 AS value
    FROM s CROSS JOIN cats JOIN s AS t ON t.key = cats.key LEFT JOIN shared ON shared.key = s.key AND shared.j = cats.j"""


def _fisher_sql(compare: str, theta: str, column: str = "p_name", name: str = "part", limit: int | None = 10) -> str:
    """The definition itself: every string, category and fitted n-gram."""
    count = "least(count(*), 1)" if compare == "presence" else "count(*)"
    mass = "1.0e0 / (SELECT count(*) FROM cats)" if theta == "uniform" else "n / (SELECT sum(n) FROM cats)::DOUBLE"
    return f"""
        WITH {_kernel_keys(column, name, limit)}, g AS ({grams_sql('keys')}),
             c AS (SELECT key, term, {count} AS c FROM g GROUP BY 1, 2),
             vocabulary AS (SELECT DISTINCT term FROM c WHERE key IN (SELECT key FROM cats)),
             cat AS (SELECT j, vocabulary.term, {mass} AS theta, coalesce(c, 0) AS c
                     FROM cats CROSS JOIN vocabulary LEFT JOIN c ON c.key = cats.key AND c.term = vocabulary.term),
             gamma AS (SELECT term, c, sum(theta) AS gamma FROM cat GROUP BY 1, 2),
             str AS (SELECT keys.key, vocabulary.term, coalesce(c, 0) AS c
                     FROM keys CROSS JOIN vocabulary LEFT JOIN c ON c.key = keys.key AND c.term = vocabulary.term),
             hit AS (SELECT str.key, cat.j, sum(1 / gamma) AS v
                     FROM str JOIN cat USING (term, c) JOIN gamma USING (term, c) GROUP BY 1, 2)
        SELECT keys.key, cats.j AS component, round(coalesce(v, 0), 4) + 0.0e0 AS value
        FROM keys CROSS JOIN cats LEFT JOIN hit ON hit.key = keys.key AND hit.j = cats.j"""


def _minhash_sql(table_name: str, column: str, k: int) -> str:
    return f"""
        WITH keys AS (SELECT DISTINCT {column} AS key FROM {table_name}), g AS ({padded_grams_sql('keys')}),
             {murmur_sql('g', f'(SELECT unnest(range(0, {k})) AS seed)')},
             codes AS (SELECT key, seed AS component, min(h)::DOUBLE / 4294967295 AS value
                       FROM g JOIN hashed USING (term) GROUP BY 1, 2)"""


TARGET_SQL = """
    WITH t AS (SELECT {0} AS key, count(*) AS n, sum(p_retailprice) AS s FROM part GROUP BY 1),
         a AS (SELECT sum(n)::DOUBLE AS n, count(*)::DOUBLE AS k, sum(s) / sum(n) AS mean FROM t),
         w AS (SELECT key, t.n / (t.n + a.n / a.k) AS share, s / t.n AS own, mean FROM t, a)"""

LOO_SQL = """
    WITH t AS (SELECT p_brand AS key, count(*) AS n, sum(p_retailprice) AS s FROM part GROUP BY 1),
         a AS (SELECT sum(s) / sum(n) AS mean FROM t)"""

POLY_SQL = f"""
    WITH RECURSIVE {_ordinals('p_brand')},
    t AS (SELECT key, k::DOUBLE AS k, 2e0 * i - k + 1 AS x, 0 AS n, 0e0 AS prev, 1e0 / sqrt(k) AS last,
                 (k::DOUBLE * k - 1) / 3 AS up, 1e0 AS before FROM o
          UNION ALL
          SELECT key, k, x, n + 1, last,
                 (2e0 * n + 1) / (n + 1) / sqrt(up) * x * last
                 - CASE WHEN n = 0 THEN 0e0 ELSE n * (k * k - n * n) / (n + 1) / sqrt(up) / sqrt(before) * prev END,
                 (k * k - (n + 2) * (n + 2)) * (2e0 * n + 3) / (2e0 * n + 5), up
          FROM t WHERE n + 1 < k)
    SELECT key, (n - 1)::BIGINT AS component, round(last, 6) + 0.0e0 AS value FROM t WHERE n > 0"""

ORACLES = {
    "one_hot": _cells("p_type", "CASE WHEN i = j THEN 1 ELSE 0 END", "k"),
    "one_hot_drop_last": _cells("p_type", "CASE WHEN i = j THEN 1 ELSE 0 END", "k - 1"),
    "similarity": SIMILARITY_SQL,
    "similarity_all": _similarity_sql(limit=None),
    "similarity_names": _similarity_sql("c_name", "customer"),
    "fisher_kernel_all": _fisher_sql("count", "uniform", limit=None),
    "fisher_kernel_all_presence": _fisher_sql("presence", "frequency", limit=None),
    "fisher_kernel_names": _fisher_sql("count", "uniform", "c_name", "customer"),
    "fisher_kernel_count_uniform": _fisher_sql("count", "uniform"),
    "fisher_kernel_presence_frequency": _fisher_sql("presence", "frequency"),
    "fisher_kernel_presence_uniform": _fisher_sql("presence", "uniform"),
    "minhash": _minhash_sql("customer", "c_name", 10)
    + " SELECT key, component, round(value, 9) + 0.0e0 AS value FROM codes",
    "minhash_rows": _minhash_sql("part", "p_name", 30) + """
        SELECT p_partkey, p_name, code FROM part JOIN (
            SELECT key, string_agg(format('{:.9f}', round(value, 9)), ',' ORDER BY component) AS code
            FROM codes GROUP BY 1) ON key = p_name""",
    "target_mean": TARGET_SQL.format("p_brand") + """
        SELECT key, 0::BIGINT AS component, round(share * own + (1 - share) * mean, 6) + 0.0e0 AS value FROM w""",
    "target_mean_multiclass": """
        WITH c AS (SELECT p_type AS class, row_number() OVER (ORDER BY p_type) - 1 AS j, count(*) AS n FROM part GROUP BY 1),
             t AS (SELECT p_brand AS key, count(*) AS n FROM part GROUP BY 1),
             h AS (SELECT p_brand AS key, p_type AS class, count(*) AS h FROM part GROUP BY 1, 2),
             a AS (SELECT sum(n)::DOUBLE AS n, count(*)::DOUBLE AS k FROM t)
        SELECT t.key, j AS component,
               round(t.n / (t.n + a.n / a.k) * coalesce(h, 0) / t.n
                     + (1 - t.n / (t.n + a.n / a.k)) * c.n / a.n, 6) + 0.0e0 AS value
        FROM t CROSS JOIN c CROSS JOIN a LEFT JOIN h ON h.key = t.key AND h.class = c.class""",
    "class_frequency": """
        WITH c AS (SELECT l_linestatus AS class, row_number() OVER (ORDER BY l_linestatus) - 1 AS j, count(*)::DOUBLE AS n
                   FROM lineitem GROUP BY 1),
             k AS (SELECT DISTINCT l_returnflag AS key FROM lineitem),
             h AS (SELECT l_returnflag AS key, l_linestatus AS class, count(*) AS h FROM lineitem GROUP BY 1, 2)
        SELECT k.key, j AS component, round(coalesce(h, 0) / n, 9) + 0.0e0 AS value
        FROM k CROSS JOIN c LEFT JOIN h ON h.key = k.key AND h.class = c.class""",
    "loo_target": LOO_SQL + """
        SELECT key, 0::BIGINT AS component, round(CASE WHEN n > 1 THEN s / n ELSE mean END, 6) + 0.0e0 AS value FROM t, a""",
    "loo_target_train": LOO_SQL + """
        SELECT p_partkey, round(CASE WHEN n > 1 THEN (s - p_retailprice) / (n - 1) ELSE mean END, 6) + 0.0e0 AS code
        FROM part JOIN t ON key = p_brand, a""",
    "binary_code": _digits("p_name", 2),
    "base_n_code": _digits("p_name", 5),
    "hash_code": _cells("p_name", "CASE WHEN ('0x' || right(md5(key), 1))::BIGINT % 8 = j THEN 1 ELSE 0 END", "8"),
    "hash_code_eleven": _cells(
        "p_name", "CASE WHEN (" + " + ".join(
            f"('0x' || substr(md5(key), {32 - 7 - 8 * w}, 8))::BIGINT % 11 * {pow(2, 32 * w, 11)}" for w in range(4)
        ) + ") % 11 = j THEN 1 ELSE 0 END", "11"),
    "contrast_sum": _cells("p_brand", "CASE WHEN i = k - 1 THEN -1 WHEN i = j THEN 1 ELSE 0 END", "k - 1"),
    "contrast_helmert": _cells(
        "p_brand", "CASE WHEN j = 0 THEN 1 WHEN i < j THEN -1 WHEN i = j THEN j ELSE 0 END", "k"),
    "contrast_backward": _cells(
        "p_brand", "CASE WHEN i <= j THEN -(k - (j + 1))::DOUBLE / k ELSE (j + 1)::DOUBLE / k END", "k - 1"),
    "contrast_poly": POLY_SQL,
    "pretrained_vectors": """
        WITH w AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS vec_id
                   FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part)),
             x AS (SELECT word, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i
                   FROM w JOIN embeddings USING (vec_id)),
             u AS (SELECT word, i, x / sqrt(sum(x * x) OVER (PARTITION BY word)) AS u FROM x),
             k AS (SELECT key, unnest(string_split(key, ' ')) AS word FROM (SELECT DISTINCT p_name AS key FROM part))
        SELECT key, i AS component, round(avg(u), 6) + 0.0e0 AS value FROM k JOIN u USING (word) GROUP BY 1, 2""",
    "passthrough": "SELECT p_partkey, p_size::DOUBLE AS value FROM part",
    "column_encoder": TARGET_SQL.format("p_name") + """
        SELECT p_partkey, round(share * own + (1 - share) * mean, 6) + 0.0e0 AS code FROM part JOIN w ON key = p_name""",
    "encoder_protocol": f"""
        WITH {_ordinals('p_brand')}
        SELECT p_partkey, ((i + 1) // 9 % 3)::VARCHAR || ((i + 1) // 3 % 3)::VARCHAR || ((i + 1) % 3)::VARCHAR AS digits
        FROM part JOIN o ON key = p_brand""",
    "encoder_registry": _digits("p_brand", 16),
}
