"""Session helpers: building a session for tests / bench, the shared checkpoint folder, and
size-checked broadcasting of small derived tables."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes a derived side table may hold to be broadcast; beyond that joins on it shuffle.
BROADCAST_BYTES = 8 << 20


def build_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "textprep") -> SparkSession:
    """Session for tests and the bench (local mode).  On a cluster, use the cluster's session."""
    master = master or os.environ.get("TEXTPREP_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.textprep.read.partitions", str(shuffle_partitions))  # the local tables are single files
        .config("spark.driver.memory", os.environ.get("TEXTPREP_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it on a cluster and is used as is, else the folder already set on the
    context.  Where neither is set, a local session (tests, the bench) gets a fresh folder of its
    own; any other master falls back to the warehouse folder, never to a machine-local path."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    named = named or sc.getCheckpointDir()
    if named:
        return named
    if sc.master.startswith("local[") or sc.master == "local":
        return tempfile.mkdtemp(prefix="textprep-shared-")
    warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
    if not warehouse:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse.rstrip('/')}/_textprep"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Point reliable checkpoints at :func:`shared_dir` unless the context has a folder already."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(spark))
    return sc.getCheckpointDir()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (never a local one): cuts lineage and survives
    the loss of the executors that computed it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table_bytes(df: DataFrame) -> int:
    """Bytes of a small table's values: strings and arrays by their length, other types 16 each."""
    size = F.lit(0)
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        own = F.octet_length(c) if kind in ("string", "binary") else 16 * F.size(c) if kind == "array" else F.lit(16)
        size = size + F.coalesce(own, F.lit(0)) + 8
    return df.agg(F.sum(size.cast("long"))).first()[0] or 0


def small_side(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Materialise a derived side table once and broadcast it only if its bytes are within
    ``max_bytes``; beyond that it is returned as is and joins on it shuffle."""
    df = checkpointed(df)
    return F.broadcast(df) if table_bytes(df) <= max_bytes else df
