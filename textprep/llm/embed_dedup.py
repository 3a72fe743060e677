"""Exact range join of embeddings by cosine.

Vectors of one direction are compared as points of the unit sphere, whose distances are a metric:
cosine >= c means distance <= r = sqrt(2 - 2c).  Vectors of unequal length have no cosine, so each length is
joined on its own, with its share of the pivots.  Pivots (rows drawn by a hash) split the points into
cells; a cell is one pivot and one ring of distances to it, with the least and greatest found.  By the triangle inequality a point y of
a cell that has x within r lies at a distance to the pivot between d(x, pivot) - r and d(x, pivot) + r,
and d(x, pivot) <= d(x, x's own pivot) + 2r; x is replicated to the other cells that pass both tests,
for each pair of cells in one direction only.  Cells then join on their own, in blocks; a block
returns one row per vector that has links: how many, and the smallest vector it is connected with.

Pairs with a rounded distance near r pass the tests by a margin; the cosine in double precision decides.
Equal vectors are compared once and counted by their number, so copies cost nothing.

Defined cases: null and zero vectors and vectors with null or non-finite components link with
nothing, and vectors of unequal length not with each other; a null vec_id never is a component's smallest unless
it stands alone (its component is null then); rows that repeat a vec_id with equal vectors count as links of each
other; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textprep.llm.common import broadcast_if_small, stored
from textprep.llm.graph import components

COSINE = 0.9
BLOCK = 2048
MAX_PIVOTS = 64  # the pivots go to every task: 64 vectors at most, of all lengths together
RINGS = (0.6, 1.1)  # bounds between the rings, distances from 0 to 2
_SLACK = 1e-6


def _unit(column) -> np.ndarray:
    import pyarrow as pa

    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(a.flatten(), np.float64).reshape(len(a), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distances(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    far = np.sqrt(np.maximum(0, 2 - 2 * (x @ pivots.T)))
    home = far.argmin(axis=1)
    own = far[np.arange(len(far)), home]
    return far, own, home * (len(RINGS) + 1) + np.searchsorted(RINGS, own, side="right")


def _by_size(batch):
    """The vector lengths of a batch, and the rows of each."""
    sizes = np.asarray(batch.column("size"))
    for size in np.unique(sizes):
        yield int(size), batch.take(np.flatnonzero(sizes == size))


def _place(pivots: dict[int, np.ndarray]):
    """Adds the own cell and the distance to its pivot; a length without pivots is one cell, -1."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for size, part in _by_size(batch):
                own, cell = np.zeros(part.num_rows), np.full(part.num_rows, -1)
                if size in pivots:
                    _, own, cell = _distances(_unit(part.column("vector")), pivots[size])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(own)], [*part.schema.names, "cell", "own"])

    return run


def _replicate(pivots: dict[int, np.ndarray], bounds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], radius: float):
    """Adds the other cells to which a vector goes; ``bounds`` has the cells of each length, their least and greatest distance."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for size, part in _by_size(batch):
                if size in pivots:
                    cells, low, high = bounds[size]
                    far, own, here = _distances(_unit(part.column("vector")), pivots[size])
                    here, there, r = here[:, None], cells[None, :], radius + _SLACK
                    d = far[:, cells // (len(RINGS) + 1)]
                    near = (d <= high + r) & (d >= low - r) & (d <= own[:, None] + 2 * r)
                    # of two cells, the lower sends to the higher if their sum is even, else the other way round
                    near &= np.where((here + there) % 2 == 0, here < there, here > there)
                else:
                    cells, near = np.zeros(0, np.int64), np.zeros((part.num_rows, 0), bool)
                n = np.concatenate([[0], near.sum(axis=1).cumsum()])
                to = pa.ListArray.from_arrays(pa.array(n, pa.int32()), pa.array(cells[np.nonzero(near)[1]], pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, to], [*part.schema.names, "to"])

    return run


def _join_blocks(cosine: float):
    """All pairs of block i with block j: links per vector, and the smallest vector of its component here."""

    def run(key, rows):
        import pyarrow as pa

        i, j = key[2].as_py(), key[3].as_py()
        block = np.asarray(rows.column("block"))
        name, copies, x = np.asarray(rows.column("class")), np.asarray(rows.column("copies")), _unit(rows.column("vector"))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = np.nonzero(x[left] @ x[right].T >= cosine)
        a, b = left[a], right[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        n = np.bincount(a, copies[b], len(name)) + np.bincount(b, copies[a], len(name))
        low = name.copy()
        while len(a):  # the smaller label wins until both ends of all links agree
            least = np.minimum(low[a], low[b])
            if (least == low[a]).all() and (least == low[b]).all():
                break
            np.minimum.at(low, a, least)
            np.minimum.at(low, b, least)
        hit = np.flatnonzero(n)
        return pa.table({"class": name[hit], "n": n[hit].astype(np.int64), "low": low[hit]})

    return run


def valid_vectors(table: DataFrame) -> DataFrame:
    """``(vec_id, class, vector)``: class is a hash of the vector, null where it can't link."""
    v = F.col("embedding")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    good = F.coalesce(good, F.lit(False))
    return table.select("vec_id", F.when(good, F.xxhash64(v)).alias("class"), F.when(good, v).alias("vector"))


def links(points: DataFrame, cosine: float = COSINE, block: int = BLOCK, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """``(class, n, low)`` from stored ``points(class, copies, size, vector)``, size being the vector's length:
    partial link counts, and links (class, low) that connect what the links connect."""
    kind = points.schema["vector"].dataType.simpleString()
    keys = f"class long, copies long, size int, vector {kind}"
    rows = points.count()
    if not rows:
        return points.select("class", F.col("copies").alias("n"), F.col("class").alias("low"))
    radius = float(np.sqrt(2 - 2 * cosine))
    import pyarrow as pa

    # a length gets its share of the pivots; those without any, all rare ones among them, are one cell each
    shares = points.groupBy("size").agg(F.count("*").alias("n")).where(F.col("n") * max_pivots >= rows).orderBy("size").collect()
    pivots = {}
    for size, n in shares:  # max_pivots lengths at most
        own = points.where(F.col("size") == size).orderBy(F.xxhash64("class", F.lit(7)), "class")
        seeds = own.limit(min(n * max_pivots // rows, max(1, n // block))).select("vector").collect()
        pivots[size] = _unit(pa.array([list(r[0]) for r in seeds]))
    placed = stored(points.mapInArrow(_place(pivots), f"{keys}, cell int, own double"), "cells")
    # one row per cell, and cells are bounded by the pivots
    cells = placed.where("cell >= 0").groupBy("size", "cell").agg(F.min("own").alias("low"), F.max("own").alias("high")).orderBy("size", "cell").collect()
    bounds = {s: tuple(np.array([c[k] for c in cells if c["size"] == s]) for k in ("cell", "low", "high")) for s in pivots}
    sent = stored(placed.drop("own").mapInArrow(_replicate(pivots, bounds, radius), f"{keys}, cell int, to array<int>"), "replicas")
    guests = sent.select("size", F.explode("to").alias("cell")).groupBy("size", "cell").agg(F.count("*").alias("guests"))
    homes = sent.groupBy("size", "cell").agg(F.count("*").alias("homes"))
    sizes = homes.join(guests, ["size", "cell"], "left").select(
        "size", "cell", F.ceil(F.col("homes") / block).cast("int").alias("hb"), F.ceil(F.coalesce("guests", F.lit(0)) / block).cast("int").alias("gb")
    )
    sizes = broadcast_if_small(stored(sizes, "cell-sizes"), F.lit(16))  # one row per cell
    own = sent.join(sizes, ["size", "cell"]).withColumn("block", F.pmod(F.xxhash64("class"), "hb").cast("int"))
    own = own.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("hb") + F.col("gb") - 1)))
    own = own.select("size", "cell", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"), "block", "class", "copies", "vector")
    other = sent.select("size", F.explode("to").alias("cell"), "class", "copies", "vector").join(sizes, ["size", "cell"])
    other = other.withColumn("block", F.col("hb") + F.pmod(F.xxhash64("class"), "gb").cast("int"))
    other = other.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("hb") - 1)))
    other = other.select("size", "cell", "i", F.col("block").alias("j"), "block", "class", "copies", "vector")
    found = own.unionByName(other).groupBy("size", "cell", "i", "j").applyInArrow(_join_blocks(cosine), "class long, n long, low long")
    return stored(found, "links")


def cosine_links(table: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of ``table(vec_id, embedding)``: vec_id, n_links, component_id, kept."""
    rows = stored(valid_vectors(table), "vectors")
    linkable = rows.where("class IS NOT NULL")
    points = linkable.groupBy("class").agg(F.count("*").alias("copies"), F.first("vector").alias("vector"), F.min("vec_id").alias("least_id"))
    points = stored(points.withColumn("size", F.size("vector")), "points")
    found = links(points.select("class", "copies", "size", "vector"), cosine)
    counts = found.groupBy("class").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("class").alias("a"), F.col("low").alias("b")))
    per = points.select("class", "copies", "least_id").join(counts, "class", "left")
    per = per.join(roots, per["class"] == roots["node"], "left").withColumn("root", F.coalesce("root", "class"))
    low = per.groupBy("root").agg(F.min("least_id").alias("component_id"))
    per = per.join(low, "root").select(
        F.col("class").alias("_class"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    out = rows.join(per, rows["class"] == per["_class"], "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
