"""S1 for large files: a record CSV whose cells hold newlines, read by many tasks per file.

Spark's multi-line mode gives a whole file to one task, as a newline may stand in a quoted cell and a task that starts in
the middle can't know.  Here tasks read byte ranges of the file line by line and find for both cases (the range starts outside
or inside a quoted cell) where each line stands.  Each range is thus a map from its state at the start to that at
its end; the maps of a file, one small row for each range, are followed from its start and tell every range its case.  A record within one line is
parsed where it is; only lines of longer records are shuffled, by their record.

The lines are stored once, since a second scan might cut a file differently.  Quotes in a cell are doubled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textprep.sources.io import RECORD_SCHEMA

_LINES = (
    "file string, start long, no long, line string, open0 boolean, open1 boolean, after0 boolean, after1 boolean, first0 long, first1 long"
)
BATCH = 10_000


def ends_open(line: str, is_open: bool, sep: str = ",") -> bool:
    """Whether a quoted cell is open after a line that starts in one, or not.  A quote opens a cell only at its start; elsewhere in an
    unquoted cell it is text."""
    if '"' not in line:
        return is_open
    at = 0
    if not is_open:
        is_open = line.startswith('"')
        at = int(is_open)
    while True:
        while is_open:
            quote = line.find('"', at)
            if quote < 0:
                return True
            is_open = line.startswith('""', quote)
            at = quote + 1 + is_open
        cell_end = line.find(sep, at)
        if cell_end < 0:
            return False
        at = cell_end + len(sep)
        is_open = line.startswith('"', at)
        at += is_open


def _states(sep: str):
    """Lines of byte ranges with their state before and after, and the line that began their record, in both cases."""

    def run(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.bool_()] * 4, *[pa.int64()] * 2]
        names = [c.split()[0] for c in _LINES.split(", ")]
        key, no, state, first = None, 0, [False, True], [None, None]
        for batch in batches:
            rows = []
            for line, file, start in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (file, start):
                    key, no, state, first = (file, start), 0, [False, True], [None, None]
                before = list(state)
                for case in (0, 1):
                    if not before[case]:
                        first[case] = no
                    state[case] = ends_open(line, before[case], sep)
                rows.append((file, start, no, line, *before, *state, *first))
                no += 1
            for a in range(0, len(rows), BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[a : a + BATCH]), kinds)], names=names)

    return run


def _followed(ranges):
    """Of one file's ranges: their true state at the start, and where the record that is open there began."""
    import pyarrow as pa

    out, is_open, began = [], False, (None, None)
    for x in ranges.sort_by("start").to_pylist():
        out.append((x["file"], x["start"], is_open, *began))
        case = int(is_open)
        if x[f"first{case}"] is not None:
            began = (x["start"], x[f"first{case}"])
        is_open = x[f"after{case}"]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
    names = ["file", "start", "is_open", "from_start", "from_no"]
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, zip(*out), kinds)})


def record_texts(spark: SparkSession, path: str, store: str, sep: str = ",") -> DataFrame:
    """``(file, start, no, text)``: every record of the files under ``path`` as one text, with the byte range and line that it
    begins at.  ``store`` is a new folder, shared by all executors, for the lines."""
    lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))
    lines.mapInArrow(_states(sep), _LINES).write.parquet(store)
    lines = spark.read.parquet(store)
    last = lines.groupBy("file", "start").agg(F.max_by(F.struct("after0", "after1", "first0", "first1"), "no").alias("x")).select("file", "start", "x.*")
    states = last.groupBy("file").applyInArrow(_followed, "file string, start long, is_open boolean, from_start long, from_no long")

    def case(name: str):
        return F.when(F.col("is_open"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))

    placed = lines.join(states, ["file", "start"]).select(
        "file", "start", "no", "line", "from_start", "from_no", case("open").alias("inside"), case("after").alias("open"), case("first").alias("first")
    )
    whole = placed.where(~F.col("inside") & ~F.col("open")).select("file", "start", "no", F.col("line").alias("text"))
    parts = placed.where(F.col("inside") | F.col("open")).select(
        "file",
        F.when(F.col("first").isNull(), F.col("from_start")).otherwise(F.col("start")).alias("s"),
        F.coalesce("first", "from_no").alias("n"),
        F.struct("start", "no", "line").alias("part"),
    )
    joined = parts.groupBy("file", "s", "n").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    joined = joined.select("file", F.col("s").alias("start"), F.col("n").alias("no"), F.array_join("parts.line", "\n").alias("text"))
    return whole.unionByName(joined).withColumn("text", F.regexp_replace("text", "\r$", ""))


def read_records_split(spark: SparkSession, path: str, schema: T.StructType | str | None = None, is_test: bool = False, sep: str = ",",
                       store: str | None = None) -> DataFrame:
    """S1 as :func:`textprep.sources.io.read_records`, in as many tasks as the files have byte ranges.  Every file has a header; empty
    lines between records are skipped; a record that doesn't fit the schema is an error."""
    import uuid

    from textprep.session import shared_dir

    s = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema or RECORD_SCHEMA
    if is_test and "label" in s.fieldNames():
        s = T.StructType([f for f in s.fields if f.name != "label"])
    texts = record_texts(spark, path, store or f"{shared_dir(spark).rstrip('/')}/csv-lines-{uuid.uuid4().hex}", sep)
    texts = texts.where((F.col("text") != "") & ~((F.col("start") == 0) & (F.col("no") == 0)))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in s.fields)
    options = {"escape": '"', "sep": sep, "mode": "FAILFAST", "multiLine": "true"}
    return texts.select(F.from_csv("text", ddl, options).alias("r")).select("r.*")
