"""The registered queries: one per operator of the inventory, each with the DuckDB SQL that
checks it.  Every query reads the driver's tables (or data Spark derives from them) in full.

Output conventions, so that two engines can be compared value by value: integers as BIGINT,
doubles rounded to 6 digits, arrays as joined strings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def rounded(c, name: str, digits: int = 6):
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), digits).alias(name)


def vector_md5(c, name: str):
    """Digest of a vector's numbers, each rounded to 6 digits and written as an integer of millionths."""
    col = F.col(c) if isinstance(c, str) else c
    return F.md5(F.array_join(F.transform(col, lambda x: F.round(x * 1000000).cast("long").cast("string")), ",")).alias(name)


def load_all() -> None:
    """Import the modules that register queries."""
    import importlib

    for mod in MODULES:
        importlib.import_module(f"textprep.plans.{mod}")


MODULES = ["q_prep", "q_clean", "q_sampling", "q_features", "q_eval", "q_tokens", "q_subwords"]
