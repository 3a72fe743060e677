"""Queries: chunk vectors -> documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from textprep.operators import features as E
from textprep.operators import labels as L
from textprep.plans import sqltext as S
from textprep.plans.catalog import register, rounded, vector_md5
from textprep.plans.q_prep import _chunks_sql, prepared_corpus
from textprep.operators.chunks import explode_chunks
from textprep.sources.tables import CHUNK_VECTORS_SQL, chunk_vectors

CV = CHUNK_VECTORS_SQL


def docs(spark, sf_dir):
    return E.collect_chunks(chunk_vectors(spark, sf_dir), "index", "subix", "hs", first_cols=("label",))


def centroid_model(spark, sf_dir):
    return E.collect_model(E.class_means(chunk_vectors(spark, sf_dir), "hs", "label"))


MEANS_SQL = f"""(SELECT cls, list(mu ORDER BY pos) AS w FROM
    (SELECT label AS cls, pos, avg(x) AS mu FROM
       (SELECT label, unnest(hs) AS x, generate_subscripts(hs, 1) AS pos FROM {CV} a) b GROUP BY label, pos) c GROUP BY cls)"""


def _pool_sql(agg: str) -> str:
    return f"""SELECT CAST("index" AS BIGINT) AS "index", CAST(pos - 1 AS BIGINT) AS dim, round({agg}(x), 6) AS value
      FROM (SELECT "index", unnest(hs) AS x, generate_subscripts(hs, 1) AS pos FROM {CV} a) b GROUP BY "index", pos"""


def _exploded(d, col):
    return d.select(F.col("index").cast("long"), F.posexplode(col).alias("dim", "value")).select(
        "index", F.col("dim").cast("long"), rounded("value", "value")
    )


@register("g7_first_label", f"""SELECT CAST("index" AS BIGINT) AS "index", CAST(arg_min(label, subix) FILTER (WHERE label IS NOT NULL) AS BIGINT) AS label
    FROM {CV} a GROUP BY "index\"""")
def q_g7(spark, sf_dir):
    return docs(spark, sf_dir).select(F.col("index").cast("long"), F.col("label").cast("long"))


_HS_MD5 = S.vector_md5("flatten(list(hs ORDER BY subix))")


@register("g8_collect_vectors", f"""SELECT CAST("index" AS BIGINT) AS "index", CAST(count(*) AS BIGINT) AS seq_len,
      string_agg(CAST(subix AS VARCHAR), ',' ORDER BY subix) AS chunk_order, {_HS_MD5} AS hs_md5
    FROM {CV} a GROUP BY "index\"""")
def q_g8(spark, sf_dir):
    c = chunk_vectors(spark, sf_dir)
    # the chunk number rides along as the first component, to show the order of the list
    d = E.collect_chunks(c.withColumn("hs", F.concat(F.array(F.col("subix").cast("double")), "hs")), "index", "subix", "hs", first_cols=())
    return d.select(
        F.col("index").cast("long"),
        F.col("seq_len").cast("long"),
        F.array_join(F.transform("hs", lambda v: v[0].cast("int").cast("string")), ",").alias("chunk_order"),
        vector_md5(F.flatten(F.transform("hs", lambda v: F.slice(v, F.lit(2), F.size(v)))), "hs_md5"),
    )


@register("g9_max_seq_len", """SELECT CAST(max(n) AS BIGINT) AS max_seq_len FROM (SELECT vec_id // 5 AS d, count(*) AS n FROM embeddings GROUP BY 1)""")
def q_g9(spark, sf_dir):
    return E.longest_sequence(chunk_vectors(spark, sf_dir)).select(F.col("max_seq_len").cast("long"))


_DOC_FEATURES_SQL = f"""SELECT CAST("index" AS BIGINT) AS "index", CAST(arg_min(label, subix) FILTER (WHERE label IS NOT NULL) AS BIGINT) AS label,
      CAST(count(*) AS BIGINT) AS seq_len, CAST(max(len(hs)) AS BIGINT) AS dim, {_HS_MD5} AS hs_md5 FROM {CV} a GROUP BY "index\""""


def _doc_features(d):
    return d.select(
        F.col("index").cast("long"), F.col("label").cast("long"), F.col("seq_len").cast("long"),
        F.size(F.element_at("hs", 1)).cast("long").alias("dim"), vector_md5(F.flatten("hs"), "hs_md5"),
    )


@register("e5_doc_features", _DOC_FEATURES_SQL)
def q_e5(spark, sf_dir):
    return _doc_features(docs(spark, sf_dir))


@register("e2_mean_pool", _pool_sql("avg"))
def q_e2(spark, sf_dir):
    return _exploded(E.pool_by_key(chunk_vectors(spark, sf_dir), "index", "hs", ("mean",)), "mean")


@register("e3_max_pool", _pool_sql("max"))
def q_e3(spark, sf_dir):
    return _exploded(E.pool_by_key(chunk_vectors(spark, sf_dir), "index", "hs", ("max",)), "max")


@register("e6_sum_pool", _pool_sql("sum"))
def q_e6(spark, sf_dir):
    return _exploded(E.pool_by_key(chunk_vectors(spark, sf_dir), "index", "hs", ("sum",)), "sum")


@register("e2_mean_pool_collected", _pool_sql("avg"))
def q_e2_collected(spark, sf_dir):
    """E2 on the per-document vector list of E5 (pooling as a projection)."""
    return _exploded(docs(spark, sf_dir).withColumn("v", E.pool("hs", "mean")), "v")


@register("e4_mean_max_concat", f"""SELECT CAST("index" AS BIGINT) AS "index", CAST(2 * count(*) AS BIGINT) AS dim,
      {S.vector_md5("list_concat(list(mean ORDER BY pos), list(most ORDER BY pos))")} AS v_md5
    FROM (SELECT "index", pos, avg(x) AS mean, max(x) AS most
            FROM (SELECT "index", unnest(hs) AS x, generate_subscripts(hs, 1) AS pos FROM {CV} a) b GROUP BY "index", pos) c
    GROUP BY "index\"""")
def q_e4(spark, sf_dir):
    d = E.pool_by_key(chunk_vectors(spark, sf_dir), "index", "hs", ("mean", "max")).withColumn("v", F.concat("mean", "max"))
    return d.select(F.col("index").cast("long"), F.size("v").cast("long").alias("dim"), vector_md5("v", "v_md5"))


@register("e7_linear_head", f"""SELECT CAST(d."index" AS BIGINT) AS "index", CAST(m.cls AS BIGINT) AS cls,
      round(round(list_dot_product(list_transform(d.v, lambda a: greatest(a, 0.0)), m.w), 8), 6) AS logit
    FROM (SELECT "index", list(mu ORDER BY pos) AS v FROM
            (SELECT "index", pos, avg(x) AS mu FROM (SELECT "index", unnest(hs) AS x, generate_subscripts(hs, 1) AS pos FROM {CV} a) b
              GROUP BY "index", pos) c GROUP BY "index") d, {MEANS_SQL} m""")
def q_e7(spark, sf_dir):
    model = centroid_model(spark, sf_dir)
    d = E.pool_by_key(chunk_vectors(spark, sf_dir), "index", "hs", ("mean",))
    d = d.select(F.col("index").cast("long"), E.dot_scores("mean", [w for _, w in model], relu=True).alias("z"))
    classes = F.array(*[F.lit(c) for c, _ in model])
    return d.select("index", F.explode(F.arrays_zip(classes.alias("cls"), F.col("z").alias("logit"))).alias("s")).select(
        "index", F.col("s.cls").cast("long").alias("cls"), rounded("s.logit", "logit")
    )


# --- E1 and T19 over real text chunks ---------------------------------------------------------

def text_chunk_vectors(spark, sf_dir, dim: int = 16, size: int = 250):
    ch = explode_chunks(prepared_corpus(spark, sf_dir), size, key_col="doc_id", cleaned=True)
    return E.extract_features(ch, E.hashed_bow(dim), "data", "hs")


def _bow_sql(dim: int = 16, size: int = 250) -> str:
    chunks = f"(SELECT doc_id, subix, data FROM ({_chunks_sql(size)}) z)"
    words = f"(SELECT doc_id, subix, unnest(string_split(data, ' ')) AS w FROM {chunks} a)"
    counts = f"""(SELECT doc_id, subix, ('0x' || substr(md5(w), 1, 8))::BIGINT % {dim} AS b, count(*) AS n
                   FROM {words} b WHERE w <> '' GROUP BY ALL)"""
    grid = f"(SELECT doc_id, subix, unnest(generate_series(0, {dim - 1})) AS b FROM {chunks} c)"
    return f"""(SELECT g.doc_id, g.subix, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY g.b) AS vec
                 FROM {grid} g LEFT JOIN {counts} k ON g.doc_id = k.doc_id AND g.subix = k.subix AND g.b = k.b
                GROUP BY g.doc_id, g.subix)"""


@register("e1_hashed_features", f"SELECT doc_id, CAST(subix AS BIGINT) AS subix, vec FROM {_bow_sql()} q")
def q_e1(spark, sf_dir):
    v = text_chunk_vectors(spark, sf_dir)
    return v.select("doc_id", F.col("subix").cast("long"), F.array_join(F.transform("hs", lambda x: x.cast("long").cast("string")), ",").alias("vec"))


@register("e1_model_features", f"""SELECT doc_id, CAST(subix AS BIGINT) AS subix, CAST(count(*) FILTER (WHERE w <> '') AS BIGINT) AS n_words,
      CAST(sum(length(w)) AS BIGINT) AS n_letters, CAST(count(*) FILTER (WHERE w = 'the') AS BIGINT) AS n_the
    FROM (SELECT doc_id, subix, unnest(string_split(data, ' ')) AS w FROM ({_chunks_sql(250)}) z) q GROUP BY doc_id, subix""")
def q_e1_model(spark, sf_dir):
    """E1 with an encoder that each worker loads once: words, letters and occurrences of a word of each chunk."""

    def load():
        import numpy as np

        return lambda texts: np.array([[len([w for w in t.split(" ") if w]), sum(map(len, t.split(" "))), t.split(" ").count("the")] for t in texts])

    ch = explode_chunks(prepared_corpus(spark, sf_dir), 250, key_col="doc_id", cleaned=True)
    v = E.extract_with_model(ch, "word-counts", load, "data", "hs")
    names = ("n_words", "n_letters", "n_the")
    return v.select("doc_id", F.col("subix").cast("long"), *[F.col("hs")[i].cast("long").alias(n) for i, n in enumerate(names)])


@register("t19_pad_sequences", f"""SELECT doc_id, CAST(n AS BIGINT) AS seq_len, CAST(longest AS BIGINT) AS padded_len,
      md5(vecs || repeat(',' || array_to_string(list_transform(range(16), lambda x: 0), ','), longest - n)) AS hs_md5
    FROM (SELECT doc_id, count(*) AS n, max(count(*)) OVER () AS longest, string_agg(vec, ',' ORDER BY subix) AS vecs
            FROM {_bow_sql()} z GROUP BY doc_id) q""")
def q_t19(spark, sf_dir):
    d = E.collect_chunks(text_chunk_vectors(spark, sf_dir), "doc_id", "subix", "hs", first_cols=("label", "cv"))
    p = E.pad_sequences(d, 16)
    flat = F.array_join(F.transform(F.flatten("hs"), lambda x: x.cast("long").cast("string")), ",")
    return p.select("doc_id", F.col("seq_len").cast("long"), F.size("hs").cast("long").alias("padded_len"), F.md5(flat).alias("hs_md5"))


@register("e8_fit_weighted_head", f"""SELECT CAST(cls AS BIGINT) AS cls, CAST(total AS DOUBLE) AS mass FROM
    (SELECT label AS cls, sum(count(*)) OVER () AS total FROM
       (SELECT arg_min(label, subix) FILTER (WHERE label IS NOT NULL) AS label FROM {CV} a GROUP BY "index") b
      WHERE label IS NOT NULL GROUP BY label) c""")
def q_e8(spark, sf_dir):
    """Weighted multinomial logistic regression on mean-pooled document vectors, class weights N / n_c from
    G1.  At the optimum the unpenalised intercept of a class makes the weighted sum of its fitted
    probabilities equal to the weight of its documents, which is N for every class: that sum is returned."""
    from pyspark.ml.functions import vector_to_array

    label = E.first_non_null("label", "subix").alias("label")
    d = E.pool_by_key(chunk_vectors(spark, sf_dir), "index", "hs", ("mean",), [label]).withColumnRenamed("mean", "x")
    d = L.sample_weights(d.filter("label IS NOT NULL"), "label")
    model = E.fit_linear_head(d, "x", "label", "w", max_iter=300)
    fitted = model.transform(d.select("w", E.as_features("x").alias("_features")))
    p = fitted.select("w", F.posexplode(vector_to_array("probability")).alias("cls", "p"))
    return p.groupBy("cls").agg(F.round(F.sum(F.col("w") * F.col("p")), 1).alias("mass")).select(F.col("cls").cast("long"), "mass").filter("mass > 0")


@register("j2_doc_features_join", _DOC_FEATURES_SQL)
def q_j2(spark, sf_dir):
    """J2 in the reference's form: per-document first values joined (inner, on the document key)
    to the collected vectors; equal to ``e5_doc_features``' single aggregation."""
    c = chunk_vectors(spark, sf_dir)
    firsts = c.groupBy("index").agg(E.first_non_null("label", "subix").alias("label"))
    vecs = E.collect_chunks(c, "index", "subix", "hs", first_cols=())
    return _doc_features(firsts.join(vecs, "index"))
