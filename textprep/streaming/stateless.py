"""Structured Streaming use of the stateless operators.

Cleaning (P12, P13), text joining (P1), placeholder nulling in field mode (P8), label remaps
(P15, P16), chunking (C1, C2), normalisation and piece helpers (T3, T4, T7-T10) and the masked-LM
projections (T11-T14) have no global step, so they apply unchanged to a streaming DataFrame.
Operators with a global step (dedup, folds, vocabulary ids, sampling, metrics) need the whole
table and run in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from textprep.functions.text import clean_text_full
from textprep.operators.chunks import explode_chunks

DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def document_stream(spark: SparkSession, path: str, schema: T.StructType = DOCUMENT_SCHEMA, max_files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of documents arriving under ``path`` (a folder or glob)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)


def chunk_stream(docs: DataFrame, size: int = 250, overlap: float = 0.25, key_col: str = "doc_id") -> DataFrame:
    """Clean and cut every arriving document into overlapping chunks (append-only output)."""
    d = docs.withColumn("data_cleaned", clean_text_full("text"))
    return explode_chunks(d, size, "data_cleaned", key_col, carry=("lang",), overlap=overlap, cleaned=True)


def start_chunk_sink(chunks: DataFrame, out_path: str, checkpoint_path: str, available_now: bool = True):
    """Write the chunk stream as Parquet with a checkpoint (exactly-once file sink).  Both paths
    must be in shared storage on a cluster."""
    w = chunks.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint_path).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
