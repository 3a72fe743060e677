"""Hard negatives by inner product, over an R-tree packed by sort-tile-recursive (STR).

Rows are range-partitioned by (length, label, first coordinate) into slabs; a task sorts its slab into
tiles and leaves by the coordinates that vary most there.  Each node has the bounding box of its vectors and
the range of its labels.  A box gives an interval for each coordinate's product with an anchor's, and their
sums bound the inner product.  Anchors travel in blocks.  A block first visits the slab with the highest bound,
then those that its k-th best scores so far and its score windows leave open; in a slab a queue yields
nodes in order of their bounds, and a node is passed over by the anchors whose windows it misses or whose k-th
best lies above it.  Nodes that could tie are visited, so results are exact.

Positives are the best rows of the anchor's label; the negatives of a positive are the best rows of other labels
whose score lies in that positive's window.  Ties rank by vec_id.

Defined cases: rows with a null id, label or vector, or a null component, take no part; vectors of different lengths have no
score; rows that repeat an id are separate rows (a row is no positive of itself, but its repeats are, and a repeated anchor returns
its rows again); components beyond +-2**25 count as that limit, so that scores fit a long; an empty
vector's score is 0; a label, or its complement, without rows gives no positives, or negatives; empty tables give no rows;
other columns are not read."""

from __future__ import annotations

import heapq
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textprep.llm.common import stored
from textprep.session import shuffle_partitions

SLAB, TILE, LEAF = 8192, 1024, 64  # rows of a node at each level
BLOCK = 256  # anchors that travel together
CHUNK = 64  # slabs whose boxes are compared with a block at a time
SALTS = 4  # copies of a slab, each for its share of the blocks
LIMIT = 1 << 25  # of a component
NONE = -(1 << 62)  # below every score
ENDLESS = 1 << 62

_SLABS = (
    "slab long, dim int, n int, ids binary, labels binary, anchors binary, vectors binary, "
    "leaves binary, tiles binary, low binary, high binary, label_low long, label_high long"
)
_BLOCKS = "block long, dim int, rows binary, ids binary, labels binary, vectors binary, windows int, low binary, high binary, seconds binary"


def _array(value: bytes, dtype, *shape) -> np.ndarray:
    out = np.frombuffer(value, dtype)
    return out.reshape(shape) if shape else out


# --- the tree -------------------------------------------------------------------------------------

def _str_order(vectors: np.ndarray) -> np.ndarray:
    """Rows of a slab in the order of its leaves: tiles by one coordinate, strips of a tile by a second, leaves by a third."""
    n, dim = vectors.shape
    axes = np.argsort(-vectors.std(axis=0), kind="stable") if n and dim else np.zeros(0, int)
    if not len(axes):
        return np.arange(n)

    def by(rows, k):
        return rows[np.argsort(vectors[rows, axes[k % len(axes)]], kind="stable")]

    def cut(rows, size):
        return [rows[a : a + size] for a in range(0, len(rows), size)]

    strip = LEAF * max(1, round((TILE // LEAF) ** 0.5))
    return np.concatenate([by(s, 2) for t in cut(by(np.arange(n), 0), TILE) for s in cut(by(t, 1), strip)])


def _boxes(vectors: np.ndarray, size: int) -> np.ndarray:
    """Bounding boxes (lowest, highest) of each run of ``size`` rows."""
    at = np.arange(0, len(vectors), size)
    return np.stack([np.minimum.reduceat(vectors, at, axis=0), np.maximum.reduceat(vectors, at, axis=0)])


def _pack(batches):
    """One row for each slab of a range partition and vector length."""
    import pyarrow as pa
    from pyspark import TaskContext

    names = [f.split()[0] for f in _SLABS.split(", ")]
    first = TaskContext.get().partitionId() << 32
    held, count = [], 0

    def slabs():
        nonlocal first
        rows = pa.Table.from_batches(held)
        sizes = rows.column("size").to_numpy()
        for dim in np.unique(sizes).tolist():
            mine = rows.filter(pa.array(sizes == dim))
            n = mine.num_rows
            flat = pa.concat_arrays([c.flatten() for c in mine.column("vector").chunks]).to_numpy(zero_copy_only=False)
            vectors = np.clip(flat, -LIMIT, LIMIT).astype(np.int32).reshape(n, dim)
            order = _str_order(vectors)
            vectors = np.ascontiguousarray(vectors[order])
            ids, labels, anchors = (mine.column(c).to_numpy()[order] for c in ("vec_id", "label", "anchor"))
            whole = _boxes(vectors, n)
            values = [
                first, dim, n, ids.astype(np.int64).tobytes(), labels.astype(np.int64).tobytes(), anchors.astype(bool).tobytes(), vectors.tobytes(),
                _boxes(vectors, LEAF).tobytes(), _boxes(vectors, TILE).tobytes(), whole[0].tobytes(), whole[1].tobytes(), int(labels.min()), int(labels.max()),
            ]
            yield pa.RecordBatch.from_pylist([dict(zip(names, values))], schema=arrow)
            first += n
        held.clear()

    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, _SLABS.split(", "))])
    for batch in batches:
        for a in range(0, batch.num_rows, SLAB):
            part = batch.slice(a, SLAB)
            held.append(part)
            count += part.num_rows
            if count >= 2 * SLAB:
                yield from slabs()
                count = 0
    if held:
        yield from slabs()


def _anchor_blocks(batches):
    """Blocks of anchors of each slab, without windows yet."""
    import pyarrow as pa

    for batch in batches:
        for row in batch.to_pylist():
            chosen = np.flatnonzero(_array(row["anchors"], bool))
            ids, labels = _array(row["ids"], np.int64), _array(row["labels"], np.int64)
            vectors = _array(row["vectors"], np.int32, row["n"], row["dim"])
            for a in range(0, len(chosen), BLOCK):
                at = chosen[a : a + BLOCK]
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array([row["slab"] + int(at[0])], pa.int64()),
                        "dim": pa.array([row["dim"]], pa.int32()),
                        "rows": pa.array([(row["slab"] + at).astype(np.int64).tobytes()], pa.binary()),
                        "ids": pa.array([ids[at].tobytes()], pa.binary()),
                        "labels": pa.array([labels[at].tobytes()], pa.binary()),
                        "vectors": pa.array([vectors[at].tobytes()], pa.binary()),
                        "windows": pa.array([1], pa.int32()),
                        "low": pa.array([np.full(len(at), NONE).tobytes()], pa.binary()),
                        "high": pa.array([np.full(len(at), ENDLESS).tobytes()], pa.binary()),
                        "seconds": pa.array([b""], pa.binary()),
                    }
                )


# --- searching ------------------------------------------------------------------------------------

class _Search:
    """A block's anchors, their windows, and the best ``k`` (score, id) of each window so far."""

    def __init__(self, row: dict, k: int, same: bool):
        self.rows, self.ids, self.labels = (_array(row[c], np.int64) for c in ("rows", "ids", "labels"))
        n, w = len(self.rows), row["windows"]
        vectors = _array(row["vectors"], np.int32, n, row["dim"])
        self.most = int(np.abs(vectors).max(initial=0)) * max(1, row["dim"])
        self.exact = np.float64
        self.vectors, self.k, self.same = vectors, k, same
        self.low, self.high = _array(row["low"], np.int64, n, w), _array(row["high"], np.int64, n, w)
        self.score = np.full((n, w, k), NONE)
        self.id = np.full((n, w, k), np.iinfo(np.int64).max)
        for q, v, score, vec_id in (tuple(x.values()) for x in row.get("found") or []):
            free = np.flatnonzero(self.score[q, v] == NONE)[0]
            self.score[q, v, free], self.id[q, v, free] = score, vec_id

    def use(self, largest: int) -> None:
        """Floats where they hold every product's sum exactly, else integers."""
        self.exact = np.float64 if self.most * largest < 1 << 53 else np.int64
        self.positive, self.negative = (np.ascontiguousarray(f(self.vectors, 0).astype(self.exact)) for f in (np.maximum, np.minimum))

    def bounds(self, boxes: np.ndarray, label_low: np.ndarray, label_high: np.ndarray) -> np.ndarray:
        """For each node the highest score that some open window may still find there (NONE: nobody needs it), and
        which anchors need it."""
        low, high = boxes.astype(self.exact)
        most = (self.positive @ high.T + self.negative @ low.T).astype(np.int64)
        least = (self.positive @ low.T + self.negative @ high.T).astype(np.int64)
        labels = self.labels[:, None]
        fits = (label_low <= labels) & (labels <= label_high) if self.same else (label_low != labels) | (label_high != labels)
        kth = np.maximum(self.low, self.score[:, :, -1])
        best = np.full(most.shape, NONE)
        for w in range(self.low.shape[1]):
            open_ = fits & (self.low[:, w, None] <= self.high[:, w, None]) & (most >= kth[:, w, None]) & (least <= self.high[:, w, None])
            best = np.where(open_, np.maximum(best, np.minimum(most, self.high[:, w, None])), best)
        return best

    def visit(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, who: np.ndarray) -> None:
        """Compare the anchors ``who`` with the vectors of a leaf."""
        scores = ((self.positive[who] + self.negative[who]) @ vectors.astype(self.exact).T).astype(np.int64)
        fits = (self.labels[who, None] == labels) == self.same
        fits &= self.rows[who, None] != rows
        scores_, low, high = scores[:, None, :], self.low[who, :, None], self.high[who, :, None]
        last, last_id = self.score[who, :, -1:], self.id[who, :, -1:]
        fits = fits[:, None, :] & (scores_ >= low) & (scores_ <= high) & ((scores_ > last) | ((scores_ == last) & (ids < last_id)))
        q, w, at = np.nonzero(fits)
        if not len(q):
            return
        width, k = self.low.shape[1], self.k
        cell = who[q] * width + w
        cells = np.unique(cell)
        score = np.concatenate([self.score.reshape(-1, k)[cells].reshape(-1), scores[q, at]])
        found = np.concatenate([self.id.reshape(-1, k)[cells].reshape(-1), ids[at]])
        cell = np.concatenate([np.repeat(cells, k), cell])
        order = np.lexsort((found, -score, cell))
        first = np.searchsorted(cell[order], cells)
        top = order[first[:, None] + np.arange(k)]
        self.score.reshape(-1, k)[cells] = score[top]
        self.id.reshape(-1, k)[cells] = found[top]

    def run(self, slab: dict) -> None:
        """Visit the slab's nodes in order of their bounds."""
        n, dim = slab["n"], slab["dim"]
        ids, labels = _array(slab["ids"], np.int64), _array(slab["labels"], np.int64)
        vectors, rows = _array(slab["vectors"], np.int32, n, dim), slab["slab"] + np.arange(n)
        leaves, tiles = _array(slab["leaves"], np.int32, 2, -(-n // LEAF), dim), _array(slab["tiles"], np.int32, 2, -(-n // TILE), dim)
        self.use(int(np.abs(tiles).max(initial=0)))

        def ranges(size):
            at = np.arange(0, n, size)
            return np.minimum.reduceat(labels, at), np.maximum.reduceat(labels, at)

        def push(size, boxes, nodes):
            for node, bound in zip(nodes.tolist(), self.bounds(boxes[:, nodes], *(x[nodes] for x in label_ranges[size])).max(axis=0).tolist()):
                if bound > NONE:
                    heapq.heappush(queue, (-bound, size, node))

        label_ranges = {size: ranges(size) for size in (TILE, LEAF)}
        queue: list[tuple[int, int, int]] = []
        push(TILE, tiles, np.arange(tiles.shape[1]))
        while queue:
            _, size, node = heapq.heappop(queue)
            if size == TILE:
                push(LEAF, leaves, np.arange(node * TILE // LEAF, min((node + 1) * TILE // LEAF, leaves.shape[1])))
                continue
            who = np.flatnonzero(self.bounds(leaves[:, [node]], *(x[[node]] for x in label_ranges[LEAF]))[:, 0] > NONE)
            if len(who):
                part = slice(node * LEAF, min((node + 1) * LEAF, n))
                self.visit(rows[part], ids[part], labels[part], vectors[part], who)


def _routes(k: int, same: bool):
    """Slabs that a block has to visit, with their bounds."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                search, nodes = _Search(row, k, same), [x for x in row["nodes"] if x["dim"] == row["dim"]]
                if not nodes:
                    continue
                dim = row["dim"]
                boxes = np.stack([np.stack([_array(x[c], np.int32, dim) for x in nodes]) for c in ("low", "high")])
                search.use(int(np.abs(boxes).max(initial=0)))
                ranges = (np.array([x[c] for x in nodes]) for c in ("label_low", "label_high"))
                bounds = search.bounds(boxes, *ranges).max(axis=0)
                open_ = np.flatnonzero(bounds > NONE)
                slabs = [nodes[i]["slab"] for i in open_]
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array([row["block"]] * len(slabs), pa.int64()),
                        "slab": pa.array(slabs, pa.int64()),
                        "bound": pa.array(bounds[open_], pa.int64()),
                    }
                )

    return run


def _visits(k: int, same: bool):
    """The best of each window that a block finds in a slab, where they beat what it brought."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                search = _Search(row["asked"], k, same)
                brought = {(q, v, s, i) for q, v, s, i in (tuple(x.values()) for x in row["asked"].get("found") or [])}
                search.run(row["tree"])
                found = [
                    (q, w, s, i)
                    for q, w, j in np.argwhere(search.score > NONE).tolist()
                    if (q, w, s := int(search.score[q, w, j]), i := int(search.id[q, w, j])) not in brought
                ]
                columns = list(zip(*found)) or [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["asked"]["block"]] * len(found), pa.int64())] + [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64()))],
                    names=["block", "q", "w", "score", "vec_id"],
                )

    return run


def _search(slabs: DataFrame, blocks: DataFrame, k: int, same: bool) -> DataFrame:
    """``(block, q, w, score, vec_id, rank)``: the best ``k`` rows of window ``w`` of a block's ``q``-th anchor."""
    spark = slabs.sparkSession
    tasks = shuffle_partitions(spark)
    directory = slabs.select("slab", "dim", "low", "high", "label_low", "label_high")
    n_chunks = -(-slabs.count() // CHUNK) or 1
    chunk = F.pmod(F.xxhash64("slab"), F.lit(n_chunks)).cast("int")
    directory = directory.groupBy(chunk.alias("chunk")).agg(F.collect_list(F.struct("slab", "dim", "low", "high", "label_low", "label_high")).alias("nodes"))
    found_type = "array<struct<q:int,w:int,score:bigint,vec_id:bigint>>"

    def route(asked: DataFrame) -> DataFrame:
        spread = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1)))).repartition(tasks, "block", "chunk")
        return stored(spread.join(directory, "chunk").mapInArrow(_routes(k, same), "block long, slab long, bound long"), "routes")

    def visit(asked: DataFrame, routes: DataFrame) -> DataFrame:
        salt = F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int").alias("salt")
        asked = asked.select("block", F.struct(*asked.columns).alias("asked"))
        pairs = routes.select("block", "slab", salt).join(asked, "block").repartition(tasks, "slab", "salt")
        copies = slabs.select("slab", F.struct(*slabs.columns).alias("tree"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
        both = pairs.join(copies.repartition(tasks, "slab", "salt"), ["slab", "salt"]).select("asked", "tree")
        return stored(both.mapInArrow(_visits(k, same), "block long, q int, w int, score long, vec_id long"), "visits")

    asked = blocks.withColumn("found", F.lit(None).cast(found_type))
    routes = route(asked)
    place = F.row_number().over(Window.partitionBy("block").orderBy(F.col("bound").desc(), "slab"))
    first = stored(routes.withColumn("place", place).where("place = 1").select("block", "slab"), "first")
    best = visit(asked, first)
    # at most k rows for each window of a block's anchors
    known = best.groupBy("block").agg(F.collect_list(F.struct("q", "w", "score", "vec_id")).alias("found"))
    asked = stored(blocks.join(known, "block", "left"), "asked")
    rest = route(asked).join(first, ["block", "slab"], "left_anti")
    every = best.unionByName(visit(asked, rest))
    rank = F.row_number().over(Window.partitionBy("block", "q", "w").orderBy(F.col("score").desc(), "vec_id"))
    return stored(every.withColumn("rank", rank).where(F.col("rank") <= k), "best")


def _windows(low: Fraction, high: Fraction, k: int):
    """Blocks again, each positive of an anchor being a window from ``low`` to ``high`` times its score."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                n = len(row["rows"]) // 8
                bounds, seconds = np.empty((2, n, k), np.int64), np.zeros((n, k, 2), np.int64)
                bounds[0], bounds[1] = 1, 0  # closed where there is no positive
                for x in row.pop("positives"):
                    q, j, score = x["q"], x["rank"] - 1, x["score"]
                    bounds[0, q, j] = -((-score * low.numerator) // low.denominator)
                    bounds[1, q, j] = score * high.numerator // high.denominator
                    seconds[q, j] = x["vec_id"], score
                row |= {"windows": k, "low": bounds[0].tobytes(), "high": bounds[1].tobytes(), "seconds": seconds.tobytes()}
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([batch.schema.field(n) for n in batch.schema.names if n != "positives"]))

    return run


def _named(positives: int):
    """Ids of anchors and positives beside the negatives found."""

    def run(batches):
        import pyarrow as pa

        names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                ids = _array(row["ids"], np.int64).tolist()
                seconds = _array(row["seconds"], np.int64, len(ids), positives, 2).tolist()
                for x in row["negatives"]:
                    second, score = seconds[x["q"]][x["w"]]
                    out.append((ids[x["q"]], second, x["rank"], x["vec_id"], score, x["score"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 6, kinds)], names=names)

    return run


def mine(
    rows: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low: Fraction = Fraction(1, 2),
    high: Fraction = Fraction(19, 20),
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for the rows ``(vec_id, label, vector)`` of whole
    numbers for which ``anchor`` holds: the best ``positives`` rows of the label, and for each the best ``negatives`` rows of other labels
    with a score from ``low`` to ``high`` times the positive's."""
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("vector").cast("array<bigint>"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull())
    rows = rows.where(whole).withColumn("size", F.size("vector"))
    n = rows.count()
    dealt = rows.repartitionByRange(max(1, -(-n // SLAB)), "size", "label", F.get("vector", 0), "vec_id")
    slabs = stored(dealt.mapInArrow(_pack, _SLABS), "slabs")
    blocks = stored(slabs.mapInArrow(_anchor_blocks, _BLOCKS), "anchors")

    best = _search(slabs, blocks, positives, same=True)
    # BLOCK * positives entries at most
    seconds = best.groupBy("block").agg(F.collect_list(F.struct("q", "rank", "score", "vec_id")).alias("positives"))
    asked = stored(blocks.join(seconds, "block").mapInArrow(_windows(low, high, positives), _BLOCKS), "asked")
    found = _search(slabs, asked, negatives, same=False)
    found = found.groupBy("block").agg(F.collect_list(F.struct("q", "w", "rank", "score", "vec_id")).alias("negatives"))
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return asked.join(found, "block").select("ids", "seconds", "negatives").mapInArrow(_named(positives), names)
