"""Sources and sinks (S1-S4, S7): record CSV reader, materialise-once cache keyed by all
parameters, prediction file writer, model-input projection."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names of the record table (English names for the reference's Korean headers).
RECORD_SCHEMA = T.StructType(
    [
        T.StructField("index", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("goal", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("effect", T.StringType()),
        T.StructField("keywords_ko", T.StringType()),
        T.StructField("keywords_en", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("continuing", T.StringType()),
        T.StructField("ministry", T.StringType()),
        T.StructField("label", T.IntegerType()),
    ]
)


def read_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None, is_test: bool = False) -> DataFrame:
    """Read a labelled (or, with ``is_test``, unlabelled) record CSV.  Cells may hold
    newlines, so the reader runs in multi-line mode; the schema is declared, never inferred."""
    s = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema or RECORD_SCHEMA
    if is_test and "label" in s.fieldNames():
        s = T.StructType([f for f in s.fields if f.name != "label"])
    return (
        spark.read.schema(s)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .csv(path)
    )


def cache_key(params: dict) -> str:
    """S3: a stable key over *all* parameters that change the output (the reference's key left
    the fold count out): readable ``k=v`` pairs in sorted order plus a digest."""
    items = sorted((str(k), json.dumps(v, sort_keys=True, default=str)) for k, v in params.items())
    readable = "&".join(f"{k}={v.strip(chr(34))}" for k, v in items)
    digest = hashlib.sha256(json.dumps(items).encode("utf-8")).hexdigest()[:16]
    safe = "".join(ch if ch.isalnum() or ch in "=&._-" else "_" for ch in readable)[:150]
    return f"{safe}-{digest}"


def with_cache(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """Read the table at ``path`` if a complete copy is published there; otherwise compute it, store it as
    Parquet, publish it and read it back, so later steps start from the stored copy instead of the lineage.  Of several
    applications that compute it at the same time one publishes, and all read its copy."""
    from textprep.sources.cache import materialise_once

    return materialise_once(spark, path, compute)


def cached_path(root: str, params: dict, name: str = "prep") -> str:
    return os.path.join(root, name, cache_key(params))


def write_submission(df: DataFrame, path: str, key_col: str = "index", label_col: str = "label", single_file: bool = False) -> None:
    """Prediction file ``index,label`` with a header.  One file only on request (that pulls
    all rows through one task)."""
    out = df.select(F.col(key_col).alias("index"), F.col(label_col).alias("label"))
    if single_file:
        out = out.coalesce(1)
    out.write.mode("overwrite").option("header", True).csv(path)


def model_inputs(df: DataFrame, is_test: bool = False, label_col: str = "label") -> DataFrame:
    """The model inputs ``input_ids, attention_mask`` and, unless test, the label."""
    cols = ["input_ids", "attention_mask"] + ([] if is_test else [label_col])
    return df.select(*cols)


def input_signature(spark: SparkSession, path: str) -> dict:
    """Names, lengths and times of the files of an input, as one digest, so a cache key changes when any file does."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    one = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    n, total = files.agg(F.count(F.lit(1)), F.sum(one)).first()
    return {"path": path, "files": n, "digest": str(total)}


def cache_root(spark: SparkSession, root: str | None = None) -> str:
    """The folder of cached tables: ``root`` if given, else ``spark.textprep.cache.dir`` of the session, which
    outlive an application; else a folder next to the checkpoints, which lasts as long as this session."""
    from textprep.session import ensure_checkpoint_dir

    named = root or spark.conf.get("spark.textprep.cache.dir", None)
    return named.rstrip("/") if named else f"{ensure_checkpoint_dir(spark).rstrip('/')}/textprep-cache"
