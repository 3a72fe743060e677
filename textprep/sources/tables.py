"""Readers for the driver's Parquet tables and the fixture views built from them
(recipes in FIXTURES.md §3).  Every view is a lazy projection / join of the given tables, so
Catalyst prunes columns and pushes filters into the Parquet scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


PARTITIONS_CONF = "spark.textprep.read.partitions"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the given tables as its files and row groups are split.  A caller whose files are
    too few for the cores asks for a round-robin spread by setting ``spark.textprep.read.partitions``."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    n = spark.conf.get(PARTITIONS_CONF, None)
    return df.repartition(int(n)) if n else df


def labelled_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents ⨝ labels``: key ``doc_id``, ``text``, ``label = 2*quality + toxic`` (4 classes).

    Both sides grow with the data, so this is a plain equi-join (AQE picks broadcast at run
    time only if the labels side turns out small)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select(
        "doc_id", (F.col("quality") * 2 + F.col("toxic")).cast("int").alias("label")
    )
    return docs.join(labels, "doc_id")


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record table of the cleaning path: ``title, goal, content`` are lines 1..3 of the text,
    ``effect`` all lines from the fourth on (null when missing); keywords and ministry come from ``lang``."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    lines = F.split(F.col("text"), "\n")
    return d.select(
        F.col("doc_id").alias("index"),
        F.try_element_at(lines, F.lit(1)).alias("title"),
        F.try_element_at(lines, F.lit(2)).alias("goal"),
        F.try_element_at(lines, F.lit(3)).alias("content"),
        F.when(F.size(lines) > 3, F.array_join(F.slice(lines, F.lit(4), F.size(lines)), "\n")).alias("effect"),
        F.col("lang").alias("keywords_ko"),
        F.col("lang").alias("keywords_en"),
        (F.lit(2019) + F.col("doc_id") % 3).cast("int").alias("year"),
        (F.col("doc_id") % 2).cast("int").alias("continuing"),
        F.col("lang").alias("ministry"),
    )


PROJECTS_SQL = """(SELECT doc_id AS "index",
        string_split(text, chr(10))[1] AS title,
        string_split(text, chr(10))[2] AS goal,
        string_split(text, chr(10))[3] AS content,
        CASE WHEN len(string_split(text, chr(10))) > 3 THEN array_to_string(string_split(text, chr(10))[4:], chr(10)) END AS effect,
        lang AS keywords_ko, lang AS keywords_en,
        CAST(2019 + doc_id % 3 AS INTEGER) AS year,
        CAST(doc_id % 2 AS INTEGER) AS continuing,
        lang AS ministry
   FROM documents)"""

LABELLED_SQL = """(SELECT d.doc_id, d.text, CAST(l.quality * 2 + l.toxic AS INTEGER) AS label
   FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk-vector table: document ``vec_id div 5``, chunk ``vec_id % 5``, vector as doubles."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(
        F.call_function("div", F.col("vec_id"), F.lit(5)).alias("index"),
        (F.col("vec_id") % 5).cast("int").alias("subix"),
        F.col("vec_id"),
        F.transform("embedding", lambda x: x.cast("double")).alias("hs"),
        F.col("label").cast("int").alias("label"),
    )


CHUNK_VECTORS_SQL = """(SELECT vec_id // 5 AS "index", CAST(vec_id % 5 AS INTEGER) AS subix, vec_id,
        CAST(embedding AS DOUBLE[]) AS hs, label
   FROM embeddings)"""
