"""Record cleaning (P1-P11, P18, P19): column choice, null fill, text joining, drop lists,
placeholder nulling, duplicate removal and the survivor filter.

Duplicate removal keeps the first row (smallest key) of every group of equal rows.  It works on
128-bit hashes of the key columns: an aggregation finds the first row of each group, a join the
rows to drop, and the data is anti-joined with their ids.  Rows with a null in the key are never
duplicates (pandas drops null group keys).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textprep.functions.text import clean_text_full, concat_text
from textprep.session import checkpointed

# ---------------------------------------------------------------------------------------------
# The reference's drop lists and placeholders (Korean R&D project records).
REFERENCE_DROP_MINISTRIES = ["기획재정부", "문화재청", "소방청", "특허청", "행정자치부", "경찰청"]
REFERENCE_DROP_TITLES = [
    "테스트", "인건비", "연구장비 공동활용 지원사업", "연구장비", "전문교육기관 지원",
    "연구장비공동활용지원사업", "시설비", "시설보수 및 장비교체", "시설비", "시설보수 및 장비교체", "보안과제정보",
]
REFERENCE_DROP_TITLE_PATTERN = "평가관리비"
REFERENCE_PLACEHOLDERS = {"goal": ["0", "재조사"], "content": ["0", "재조사", "·"], "effect": ["0"]}
# ---------------------------------------------------------------------------------------------

SUMMARY_COLS = ["goal", "content", "effect"]
TEXT_COLS = ["title", "goal", "content", "effect", "keywords_ko", "keywords_en"]
BASE_TEXT_COLS = ["title", "goal", "content", "effect"]
KEYWORD_COLS = ["keywords_ko", "keywords_en"]


@dataclass
class CleanRules:
    """Drop lists and placeholders of :func:`clean_records` (column names are the English ones)."""

    drop_ministries: list = field(default_factory=lambda: list(REFERENCE_DROP_MINISTRIES))
    drop_titles: list = field(default_factory=lambda: list(REFERENCE_DROP_TITLES))
    drop_title_pattern: str | None = REFERENCE_DROP_TITLE_PATTERN
    placeholders: dict = field(default_factory=lambda: {k: list(v) for k, v in REFERENCE_PLACEHOLDERS.items()})


def _any(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def _all(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


# --- P4-P7: filters (pandas keeps null rows; Spark's three-valued NOT would drop them) --------

def _listed(col: str, values: Sequence | None) -> Column:
    return F.coalesce(F.col(col).isin(*values), F.lit(False)) if values else F.lit(False)


def _matches(col: str, pattern: str | None) -> Column:
    return F.coalesce(F.col(col).rlike(pattern), F.lit(False)) if pattern else F.lit(False)


def drop_values(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Drop rows whose ``col`` is in ``values``; null is kept."""
    return df.filter(~_listed(col, values)) if values else df


def drop_matching(df: DataFrame, col: str, pattern: str | None) -> DataFrame:
    """Drop rows whose ``col`` contains a match of the regex ``pattern``; null is kept."""
    return df.filter(~_matches(col, pattern)) if pattern else df


def drop_all_null(df: DataFrame, cols: Sequence[str] = SUMMARY_COLS) -> DataFrame:
    """Drop rows whose given fields are all null."""
    return df.filter(~_all([F.col(c).isNull() for c in cols]))


# --- P8: placeholders ---------------------------------------------------------------------

def null_placeholders(
    df: DataFrame, placeholders: dict, key_col: str = "index", mode: str = "field", flag_col: str = "is_placeholder"
) -> DataFrame:
    """P8.  ``mode='field'`` nulls only the field holding a placeholder.  ``mode='compat'``
    reproduces the reference: a row holding any placeholder is nulled as a whole (all columns
    but the key) and flagged; flagged rows are exempt from the later text dedup (P11)."""
    if mode == "field":
        out = df
        for c, vals in placeholders.items():
            if vals:
                out = out.withColumn(c, F.when(F.coalesce(F.col(c).isin(*vals), F.lit(False)), None).otherwise(F.col(c)))
        return out
    hit = _any([F.coalesce(F.col(c).isin(*v), F.lit(False)) for c, v in placeholders.items() if v])
    d = df.withColumn(flag_col, hit)
    cols = [
        F.col(c)
        if c in (key_col, flag_col)
        else F.when(F.col(flag_col), F.lit(None).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c)
        for c in d.columns
    ]
    return d.select(*cols)


# --- P9-P11: keep-first dedup ----------------------------------------------------------------

def duplicate_ids(
    df: DataFrame, key_cols: Sequence[str], order_col: str = "index", exempt_col: str | None = None
) -> DataFrame:
    """``(_id)``: rows to drop, those that are not the first of their group of equal keys.  The key
    columns are reduced to 128 bits before any shuffle, so the text itself never moves: one hash
    aggregation (combined in each task first) finds the first row per key, and one equi-join of
    (hash, id) pairs finds the others; AQE splits the partition of a hot key."""
    keys = [F.col(c) for c in key_cols]
    exempt = F.coalesce(F.col(exempt_col), F.lit(False)) if exempt_col else F.lit(False)
    hashed = df.filter(~_any([c.isNull() for c in keys])).select(
        F.col(order_col).alias("_id"), exempt.alias("_exempt"), F.xxhash64(*keys).alias("_h1"), F.xxhash64(F.lit("second"), *keys).alias("_h2")
    )
    return _later(checkpointed(hashed), "_h1", "_h2")  # stored: groups and members both read it, the keys are computed once


def _later(hashed: DataFrame, h1: str, h2: str) -> DataFrame:
    """``(_id)`` of the rows ``(_id, _exempt, h1, h2)`` that are not the first of their hashes."""
    hashed = hashed.select("_id", "_exempt", F.col(h1).alias("_h1"), F.col(h2).alias("_h2"))
    first = hashed.groupBy("_h1", "_h2").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return hashed.join(first, ["_h1", "_h2"]).filter("_id > _first AND NOT _exempt").select("_id")


def dedup_keep_first(
    df: DataFrame, key_cols: Sequence[str], order_col: str = "index", exempt_col: str | None = None
) -> DataFrame:
    """Of every group of rows equal on ``key_cols`` keep the one with the
    smallest ``order_col`` (a unique key).  Rows with a null key column are kept.  Rows flagged
    by ``exempt_col`` are always kept, yet still count as group members, so a flagged first row
    removes the rest of its group.  The rows are only anti-joined with the ids to drop, which are
    broadcast at run time when they are few."""
    dropped = duplicate_ids(df, key_cols, order_col, exempt_col)
    return df.join(dropped, F.col(order_col) == F.col("_id"), "left_anti")


# --- P18: the composition ----------------------------------------------------------------

def clean_records(
    df: DataFrame,
    rules: CleanRules | None = None,
    key_col: str = "index",
    year_col: str = "year",
    continuing_col: str = "continuing",
    ministry_col: str = "ministry",
    title_col: str = "title",
    text_cols: Sequence[str] = TEXT_COLS,
    summary_cols: Sequence[str] = SUMMARY_COLS,
    placeholder_mode: str = "compat",
    entity_mode: str = "compat",
) -> DataFrame:
    """P18 = P9 -> P10 -> P4 -> P7 -> P5 -> P6 -> P8 -> null fill -> P12 per text column
    (``<col>_cleaned``) -> P11.

    P9 (full-row key) is subsumed by P10 (its key is a subset of P9's): the first row of a
    P10 group is also first in its P9 sub-group, so running P10 alone keeps the same rows and
    saves a step.  Every step between the two dedups works on single rows, so both are decided on one narrow
    table of hashes and flags; the texts are read once more, without the rows to drop."""
    rules = rules or CleanRules()
    near = [F.col(c) for c in df.columns if c not in (key_col, year_col, continuing_col)]
    hit = _any([_listed(c, v) for c, v in rules.placeholders.items()])
    compat = placeholder_mode == "compat"
    gone = _listed(ministry_col, rules.drop_ministries) | _all([F.col(c).isNull() for c in summary_cols])
    gone = gone | _listed(title_col, rules.drop_titles) | _matches(title_col, rules.drop_title_pattern)

    def cleaned(c: str) -> Column:
        """What the text pass below makes of a column."""
        empty = hit if compat else _listed(c, rules.placeholders.get(c))
        return F.when(gone | empty, F.lit("")).otherwise(clean_text_full(F.coalesce(F.col(c), F.lit("")), entity_mode))

    # One narrow pass decides: hashes of every row's near key, and of the cleaned text of those that the filters leave.
    known = ~_any([c.isNull() for c in near])
    exempt = hit if compat else F.lit(False)
    flags = (F.col(key_col).alias("_id"), known.alias("_known"), (~gone).alias("_left"), exempt.alias("_exempt"))
    hashes = (F.xxhash64(*near).alias("_n1"), F.xxhash64(F.lit("second"), *near).alias("_n2"))
    texts = [f"_t{i}" for i in range(len(text_cols))]
    narrow = df.select(*flags, *hashes, *[cleaned(c).alias(t) for c, t in zip(text_cols, texts)])
    narrow = checkpointed(narrow.select(
        "_id", "_known", "_left", "_exempt", "_n1", "_n2", F.xxhash64(*texts).alias("_c1"), F.xxhash64(F.lit("second"), *texts).alias("_c2")
    ))
    later = _later(narrow.filter("_known").withColumn("_exempt", F.lit(False)), "_n1", "_n2")
    left = narrow.filter("_left").join(later, "_id", "left_anti")
    dropped = later.unionByName(_later(left, "_c1", "_c2"))

    d = df.join(dropped, F.col(key_col) == F.col("_id"), "left_anti")
    d = null_placeholders(d.filter(~gone), rules.placeholders, key_col, mode=placeholder_mode)
    d = d.na.fill("", subset=list(text_cols))
    return d.select("*", *[clean_text_full(c, entity_mode).alias(f"{c}_cleaned") for c in text_cols])


def survivors(original: DataFrame, cleaned: DataFrame, key_col: str = "index") -> DataFrame:
    """The original (uncleaned) rows whose key survived cleaning (semi-join on the key)."""
    return original.join(cleaned.select(key_col), key_col, "left_semi")


# --- P1-P3: text preparation ------------------------------------------------------------------

def prep_text(
    df: DataFrame,
    include_keywords: bool = True,
    is_test: bool = False,
    key_col: str = "index",
    label_col: str = "label",
    base_cols: Sequence[str] = BASE_TEXT_COLS,
    keyword_cols: Sequence[str] = KEYWORD_COLS,
    fill: str = " ",
    entity_mode: str = "compat",
) -> DataFrame:
    """P1-P3 (+P12): choose the text columns (keywords optional), key and label (unless test),
    fill nulls of the text columns with ``fill``, join them with one space into ``data`` and
    clean that into ``data_cleaned``."""
    cols = list(base_cols) + (list(keyword_cols) if include_keywords else [])
    keep = [key_col] + ([] if is_test else [label_col])
    d = df.select(*cols, *keep).na.fill(fill, subset=cols)
    d = d.withColumn("data", concat_text(cols, fill))
    return d.withColumn("data_cleaned", clean_text_full("data", entity_mode))
