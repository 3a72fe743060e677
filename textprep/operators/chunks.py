"""Chunking (C1, C2): overlapping word windows, one row per chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textprep.functions.text import split_words, word_windows


def explode_chunks(
    df: DataFrame,
    size: int,
    text_col: str = "data_cleaned",
    key_col: str = "index",
    carry: tuple[str, ...] = ("label", "cv"),
    overlap: float = 0.25,
    out_col: str = "data",
    cleaned: bool = False,
) -> DataFrame:
    """One row per chunk: ``key, subix, data`` plus the carried columns that exist
    (``label, cv`` for training data, nothing for test data).  A narrow ``posexplode``; no shuffle.
    ``cleaned`` text (P12) holds single spaces only and is split on them."""
    keep = [c for c in carry if c in df.columns]
    words = df.select(key_col, *keep, split_words(F.col(text_col), cleaned).alias("_words"))
    return words.select(
        key_col, *keep, F.posexplode(word_windows(F.col("_words"), size, overlap)).alias("subix", out_col)
    ).select(key_col, F.col("subix").cast("int").alias("subix"), out_col, *keep)


def longest_chunk(texts: DataFrame, size: int, text_col: str = "data_cleaned", cleaned: bool = False) -> int:
    """Words of the longest chunk of the texts, from their word counts: ``size`` as soon as one text has that many (the search stops
    there), else the longest text's."""
    n = F.size(split_words(F.col(text_col), cleaned))
    if texts.where(n >= size).select(F.lit(1)).head(1):
        return size
    return texts.agg(F.max(n)).first()[0] or 0
