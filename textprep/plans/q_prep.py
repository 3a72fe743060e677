"""Queries: the prep path (P12, P13, C1, C2, F1-F4) and the flagship summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from textprep.functions.text import clean_text_basic, clean_text_full
from textprep.operators.chunks import explode_chunks
from textprep.operators.folds import cv_split, shuffled_folds, stratified_folds, tail_holdout
from textprep.plans import sqltext as S
from textprep.plans.catalog import register
from textprep.sources.tables import LABELLED_SQL, labelled_corpus, read_table


def prepared_corpus(spark, sf_dir, k: int = 5, seed: int = 42):
    """Labelled corpus, cleaned (P12) and given stratified folds (F1): folds come from ids and labels,
    and the text meets them in one join."""
    folds = stratified_folds(labelled_corpus(spark, sf_dir).select("doc_id", "label"), "label", "doc_id", k=k, seed=seed)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.join(folds, "doc_id").withColumn("data_cleaned", clean_text_full("text"))


def _folds_sql(src: str = LABELLED_SQL, k: int = 5, seed: int = 42) -> str:
    return f"""
    WITH c AS (SELECT * FROM {src} t),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {S.hash_hex(seed, 'doc_id')}, doc_id) AS rn FROM c),
    k AS (SELECT label, sum(n) OVER (ORDER BY label) - n AS before
          FROM (SELECT label, count(*) AS n FROM c GROUP BY label))
    SELECT r.*, CAST((k.before + r.rn - 1) % {k} AS INTEGER) AS cv FROM r JOIN k USING (label)"""


FOLDED_SQL = f"""(SELECT * EXCLUDE (rn), {S.clean_full('text')} AS data_cleaned FROM ({_folds_sql()}))"""


def fold_chunk_summary(spark, sf_dir, size: int = 50):
    """Flagship: documents ⨝ labels -> clean -> stratified folds -> chunks -> counts by (label, cv)."""
    ch = explode_chunks(prepared_corpus(spark, sf_dir), size, key_col="doc_id", cleaned=True)
    words = F.when(F.col("data") == "", 0).otherwise(F.size(F.split("data", " ")))
    return ch.groupBy("label", "cv").agg(
        F.sum((F.col("subix") == 0).cast("long")).alias("n_docs"),
        F.count(F.lit(1)).alias("n_chunks"),
        F.sum(words).cast("long").alias("n_words"),
    ).select(F.col("label").cast("long"), F.col("cv").cast("long"), "n_docs", "n_chunks", "n_words")


def _chunks_sql(size: int, src: str = FOLDED_SQL) -> str:
    return f"""
    SELECT doc_id, label, cv, unnest(ch) AS data, generate_subscripts(ch, 1) - 1 AS subix
    FROM (SELECT doc_id, label, cv, {S.word_windows(S.split_words('data_cleaned'), size)} AS ch FROM {src} s)"""


register(
    "prep_fold_chunk_summary",
    f"""SELECT CAST(label AS BIGINT) AS label, CAST(cv AS BIGINT) AS cv,
           CAST(sum(CASE WHEN subix = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_docs,
           CAST(count(*) AS BIGINT) AS n_chunks,
           CAST(sum({S.words_in('data')}) AS BIGINT) AS n_words
      FROM ({_chunks_sql(50)}) GROUP BY label, cv""",
)(fold_chunk_summary)


@register(
    "p12_clean_text_full",
    f"SELECT doc_id, {S.clean_full('text')} AS cleaned FROM documents",
)
def q_p12(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", clean_text_full("text").alias("cleaned"))


@register(
    "p12_clean_html_pages",
    f"SELECT page_id, {S.clean_full('html')} AS cleaned FROM pages",
)
def q_p12_pages(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages")
    return p.select("page_id", clean_text_full("html").alias("cleaned"))


@register(
    "p13_clean_text_basic",
    f"SELECT doc_id, {S.clean_basic('text')} AS cleaned FROM documents",
)
def q_p13(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", clean_text_basic("text").alias("cleaned"))


@register(
    "c1_word_windows",
    f"""SELECT doc_id, CAST(generate_subscripts(ch, 1) - 1 AS BIGINT) AS subix, unnest(ch) AS chunk
          FROM (SELECT doc_id, {S.word_windows(S.split_words('text'), 250)} AS ch FROM documents)""",
)
def q_c1(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    ch = explode_chunks(d, 250, text_col="text", key_col="doc_id", carry=(), out_col="chunk")
    return ch.select("doc_id", F.col("subix").cast("long"), "chunk")


@register(
    "c2_explode_chunks",
    f"""SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(subix AS BIGINT) AS subix, data,
               CAST(label AS BIGINT) AS label, CAST(cv AS BIGINT) AS cv FROM ({_chunks_sql(250)})""",
)
def q_c2(spark, sf_dir):
    ch = explode_chunks(prepared_corpus(spark, sf_dir), 250, key_col="doc_id", cleaned=True)
    return ch.select("doc_id", F.col("subix").cast("long"), "data", F.col("label").cast("long"), F.col("cv").cast("long"))


@register(
    "f1_stratified_folds",
    f"SELECT doc_id, CAST(label AS BIGINT) AS label, CAST(cv AS BIGINT) AS cv FROM ({_folds_sql()})",
)
def q_f1(spark, sf_dir):
    f = stratified_folds(labelled_corpus(spark, sf_dir), "label", "doc_id", k=5, seed=42)
    return f.select("doc_id", F.col("label").cast("long"), F.col("cv").cast("long"))


@register(
    "f1_fold_sizes",
    f"""SELECT CAST(label AS BIGINT) AS label, CAST(cv AS BIGINT) AS cv, CAST(count(*) AS BIGINT) AS n
          FROM ({_folds_sql()}) GROUP BY label, cv""",
)
def q_f1_sizes(spark, sf_dir):
    f = stratified_folds(labelled_corpus(spark, sf_dir), "label", "doc_id", k=5, seed=42)
    return f.groupBy("label", "cv").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("label").cast("long"), F.col("cv").cast("long"), "n"
    )


@register(
    "f2_shuffled_folds",
    f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {S.hash_hex(42, 'doc_id')}, doc_id) - 1 AS r,
                          count(*) OVER () AS n FROM documents)
        SELECT doc_id, CAST(CASE WHEN n // 5 = 0 THEN 4 ELSE least(r // (n // 5), 4) END AS BIGINT) AS cv FROM r""",
)
def q_f2(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id")
    return shuffled_folds(d, "doc_id", k=5, seed=42).select("doc_id", F.col("cv").cast("long"))


@register(
    "f3_cv_split",
    f"""SELECT doc_id, CAST(cv AS BIGINT) AS cv, CASE WHEN cv = 0 THEN 'valid' ELSE 'train' END AS split
          FROM ({_folds_sql()})""",
)
def q_f3(spark, sf_dir):
    f = stratified_folds(labelled_corpus(spark, sf_dir), "label", "doc_id", k=5, seed=42)
    tr, va = cv_split(f, 0)
    return tr.select("doc_id", F.col("cv").cast("long"), F.lit("train").alias("split")).unionByName(
        va.select("doc_id", F.col("cv").cast("long"), F.lit("valid").alias("split"))
    )


@register(
    "f4_tail_holdout",
    """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id DESC) <= 200 THEN 'valid' ELSE 'train' END AS split
         FROM documents""",
)
def q_f4(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id")
    return tail_holdout(d, "doc_id", 200)
