"""Near-duplicates by an inverted join on the coordinates of MinHash signatures.

1. Each text's set of word shingles becomes a signature of ``coordinates`` minima; texts with equal
   sets form one class, and only classes go on.
2. A class is posted under each coordinate-value pair that other classes have too.  Fewer than
   ``matches`` such pairs: no partner.  Prefix: sorted by the length of their lists, the rarest
   (shared pairs - matches + 1) are enough to meet every partner with at least ``matches`` common pairs;
   the long lists are skipped.
3. In a list, texts of fitting sizes with at least ``matches`` collisions belong together (lists carry four bits
   of each coordinate for that, so a pair with enough common coordinates always passes); a task returns a spanning
   forest of them, no pairs.  The components of the forests are clusters: a pair that may link is inside one.
4. Small clusters are compared whole, many in one task.  In a large one a class first meets the heads, its parents
   in the forests with most collisions; confirmed links make teams.  Then the classes outside the cluster's largest
   team meet all the others, block by block.  A block returns the links that connect its teams.  So a group of thousands
   of near copies makes about as many rows as it has members, times the blocks that it fills; not their square.
   Many texts that only share some lines can make a cluster of any size, with few links and so as many teams as classes.
   In a cluster of many blocks the full sets are therefore posted under their rarest shingles as in 2., as many as two sets
   must share one of to reach the limit (exact, no chance involved).  If the lists make fewer rows than
   the blocks, the classes meet in them instead.
5. Links are confirmed on the full shingle sets: 100 * intersection >= percent * union.

With 32 coordinates and 13 matches, a pair at the limit of 0.8 has 25.6 expected collisions; the
chance of fewer than 13 is 2e-7, and falls steeply above the limit.

Defined cases: null and empty texts have empty sets, link with nothing and form their own
components; a null doc_id counts only where its component has no other id; rows that repeat a doc_id
share a component only if their texts link; an empty table gives no rows; other columns are ignored or, by
:func:`keep_first`, kept."""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textprep.llm.common import blank_words, broadcast_if_small, mix, null_safe, stored, text_chunks, word_hashes
from textprep.llm.graph import components

COORDINATES = 32
MATCHES = 13
PERCENT = 80
BLOCK = 512  # members of one cluster, and probes, that meet in one task
HEADS = 2  # parents with most collisions that a class of a large cluster is compared with at first
LARGE = 512  # classes of a cluster from which it is not compared whole
SPAN = 4096  # classes of a list that meet in one task
FEW = 8  # classes of a list up to which its pairs are listed
WIDE = 8  # blocks of a cluster from which lists of shingles are tried
GRAMS = 1 << 20  # shingles in an Arrow batch
_SIGNED = "doc_id long, class long, n_shingles long, signature array<long>, sketch array<long>"
_NIBBLES = 16  # coordinates in a 64-bit part of a sketch


def _shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int):
    """For each text the sorted distinct hashes of its shingles (all words as one if there are fewer)."""
    begin, end, first = blank_words(data, offsets)
    words = word_hashes(data, begin, end, lower=True)
    for lo, hi in zip(first[:-1], first[1:]):
        n = hi - lo
        w = words[lo:hi]
        if n >= size:
            grams = w[: n - size + 1].copy()
            for i in range(1, size):
                grams = mix(grams * np.uint64(0xD6E8FEB86659FD93) + w[i : n - size + 1 + i], i)
            yield np.unique(grams)
        elif n:
            one = np.zeros(1, np.uint64)
            for x in w:
                one = mix(one * np.uint64(0xD6E8FEB86659FD93) + x, 7919 + int(n))
            yield one
        else:
            yield w


def _class(grams: np.ndarray, cut: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hashes of whole sets, which start at ``cut`` and hold ``n`` shingles."""
    return mix(np.add.reduceat(mix(grams, 99), cut) + n.astype(np.uint64))


def _signatures(size: int, coordinates: int):
    rng = np.random.default_rng(20)
    salts = rng.integers(1, 1 << 63, coordinates, dtype=np.uint64)
    odd = rng.integers(1, 1 << 63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            classes, counts, signatures, sketches = [], [], [], []
            for _, _, data, offsets in text_chunks(batch.column(1)):
                sets = list(_shingle_sets(data, offsets, size))
                n = np.array([len(s) for s in sets])
                counts.append(n)
                full = np.flatnonzero(n)
                sig = np.zeros((len(sets), coordinates), np.uint64)
                own = np.zeros(len(sets), np.uint64)
                if len(full):
                    grams = np.concatenate([sets[i] for i in full])
                    cut = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                    for j in range(coordinates):
                        x = (grams ^ salts[j]) * odd[j]
                        sig[full, j] = np.minimum.reduceat(x ^ (x >> np.uint64(29)), cut)
                    # the order of the coordinates is part of the value: equal values mean equal pairs
                    sig[full] = mix(sig[full] + salts)
                    own[full] = _class(grams, cut, n[full])
                classes.append(own.view(np.int64))
                signatures.append(sig.view(np.int64))
                low = (sig & np.uint64(15)).reshape(len(sets), -1, _NIBBLES) << (4 * np.arange(_NIBBLES, dtype=np.uint64))
                sketches.append(low.sum(axis=2, dtype=np.uint64).view(np.int64))
            if not counts:
                continue
            n = np.concatenate(counts)
            own = pa.array(np.concatenate(classes), pa.int64(), mask=n == 0)
            columns = [batch.column(0), own, pa.array(n, pa.int64()), _lists(np.concatenate(signatures)), _lists(np.concatenate(sketches))]
            names = ["doc_id", "class", "n_shingles", "signature", "sketch"]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[2:]], [*names, *batch.schema.names[2:]])

    return run


def _lists(rows: np.ndarray):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def _collisions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Coordinates whose four bits are equal in two sketches, for each row."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    differ = np.bitwise_count(x & np.uint64(0x1111111111111111))
    return a.shape[-1] * _NIBBLES - differ.sum(axis=-1, dtype=np.int64)


def _fit(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Sizes of sets that can have the overlap."""
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _sketches(column, parts: int) -> np.ndarray:
    import pyarrow as pa

    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, parts)


def signatures(docs: DataFrame, size: int = 2, coordinates: int = COORDINATES, key: Column | None = None) -> DataFrame:
    """``(doc_id, class, n_shingles, signature, sketch)``; class is a hash of the shingle set, null if it is empty;
    ``coordinates`` is a multiple of 16; a long ``key`` of the rows is added if given."""
    keys = [] if key is None else [key.alias("key")]
    schema = _SIGNED + ", key long" * len(keys)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keys).mapInArrow(_signatures(size, coordinates), schema)


def postings(classes: DataFrame, matches: int = MATCHES) -> DataFrame:
    """``(pair, class, sketch, n_shingles)``: the rarest coordinate-value pairs of each class that can have partners."""
    shared = _shared(classes.select("class", F.explode("signature").alias("pair")))
    prefix = _rarest(shared, F.lit(matches)).join(classes.select("class", "sketch", "n_shingles"), "class")
    return prefix.select("class", "sketch", "n_shingles", F.explode("pairs").alias("pair"))


def _shared(pairs: DataFrame, *more: Column) -> DataFrame:
    """``(class, pairs)``: those of ``pairs(class, pair)`` that other classes have too, by the length of their lists; ``more`` aggregates."""
    lengths = pairs.groupBy("pair").agg(F.count("*").alias("length")).where("length > 1")
    return pairs.join(lengths, "pair").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("length", "pair"))).alias("pairs"), *more)


def _rarest(shared: DataFrame, least: Column) -> DataFrame:
    """``(class, pairs)``: the first of the pairs, enough to meet every class with ``least`` common ones."""
    # not below 0, as Spark may take the slice before the filter
    prefix = F.slice("pairs", F.lit(1), F.greatest(F.size("pairs") - least + F.lit(1), F.lit(0)))
    return shared.where(F.size("pairs") >= least).select("class", F.transform(prefix, lambda p: p["pair"]).alias("pairs"))


def _sets(size: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            classes, out = [], []
            for _, _, data, offsets in text_chunks(batch.column(0)):
                for s in _shingle_sets(data, offsets, size):
                    if len(s):
                        classes.append(_class(s, np.array([0]), np.array([len(s)])).view(np.int64)[0])
                        out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(out, pa.binary())], ["class", "shingles"])

    return run


def _grams(percent: int):
    """Rows ``(cluster, class, shingles)`` as (class, pair, least): a pair for each shingle in its cluster, and how many two linked sets share at least."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            cluster, names = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            sizes = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64) // 8
            ends, least = np.cumsum(sizes), -(-percent * sizes // 100)
            lo = 0
            while lo < len(sizes):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + GRAMS, side="right")))
                grams = np.frombuffer(b"".join(batch.column(2).slice(lo, hi - lo).to_pylist()), np.uint64)
                each = np.repeat(np.arange(lo, hi), sizes[lo:hi])
                pair = mix(grams ^ mix(cluster.view(np.uint64))[each]).view(np.int64)
                columns = [pa.array(names[each]), pa.array(pair), pa.array(least[each], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["class", "pair", "least"])
                lo = hi

    return run


def _forest(parts: int, matches: int, percent: int, few: int):
    """Rows ``(list, class, n_shingles, sketch)``, a list's together: a spanning forest of each list's candidates, as (a, b, equal)."""

    def pairs(sizes, starts):
        """Row numbers of all pairs in lists of up to ``few`` classes."""
        for n in range(2, few + 1):
            at = starts[sizes == n]
            if len(at):
                x, y = np.triu_indices(n, 1)
                yield (at[:, None] + x).ravel(), (at[:, None] + y).ravel()

    def search(n, sketch):
        """Parent, child and collisions, breadth first."""
        todo = np.arange(len(n))
        while len(todo) > 1:
            queue, todo = deque(todo[:1]), todo[1:]
            while queue and len(todo):
                x = queue.popleft()
                equal = _collisions(sketch[todo], sketch[x])
                near = (equal >= matches) & _fit(n[todo], n[x], percent)
                if near.any():
                    found = todo[near]
                    yield np.full(len(found), x), found, equal[near]
                    queue.extend(found)
                    todo = todo[~near]

    def edges(key, names, n, sketch):
        order = np.lexsort((names, key))
        key, names, n, sketch = key[order], names[order], n[order], sketch[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        out = []
        for x, y in pairs(sizes, starts):
            equal = _collisions(sketch[x], sketch[y])
            near = (equal >= matches) & _fit(n[x], n[y], percent)
            out.append((x[near], y[near], equal[near]))
        for lo, size in zip(starts[sizes > few], sizes[sizes > few]):
            out += [(lo + x, lo + y, equal) for x, y, equal in search(n[lo : lo + size], sketch[lo : lo + size])]
        if not out:
            return None
        x, y, equal = (np.concatenate(c) for c in zip(*out))
        # children are not always the larger ones; a pair is the same in all its lists
        links = np.unique(np.stack([names[x], names[y], equal]), axis=1)
        return links[:, links[0] != links[1]]

    def run(batches):
        import pyarrow as pa

        def rows(c):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c], ["a", "b", "equal"])

        held = None
        for batch in batches:
            part = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)] + [_sketches(batch.column(3), parts)]
            held = part if held is None else [np.concatenate(c) for c in zip(held, part)]
            ready = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if ready:
                if (found := edges(*[c[:ready] for c in held])) is not None:
                    yield rows(found)
                held = [c[ready:] for c in held]
        if held is not None and len(held[0]) and (found := edges(*held)) is not None:
            yield rows(found)

    return run


def candidates(lists: DataFrame, parts: int, matches: int, percent: int) -> DataFrame:
    """``(a, b, equal)``: links that connect all classes that are candidates of each other in some list.  A list of more than ``SPAN``
    classes is cut into blocks, each pair of blocks a list of its own."""
    long = lists.groupBy("pair").agg(F.count("*").alias("n")).where(F.col("n") > SPAN)
    long = stored(long.select(F.col("pair").alias("_pair"), F.ceil(F.col("n") / SPAN).cast("int").alias("k")), "long")
    rows = lists.join(broadcast_if_small(long, F.lit(12)), F.col("pair") == F.col("_pair"), "left")
    own = F.pmod(F.xxhash64("class"), F.col("k")).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.xxhash64("pair", F.least(own, j), F.greatest(own, j)))
    rows = rows.select(F.explode(F.when(F.col("k").isNull(), F.array("pair")).otherwise(blocks)).alias("list"), "class", "n_shingles", "sketch")
    rows = rows.repartition("list").sortWithinPartitions("list")
    return rows.mapInArrow(_forest(parts, matches, percent, FEW), "a long, b long, equal long").groupBy("a", "b").agg(F.max("equal").alias("equal"))


def _confirm(parts: int, matches: int, percent: int):
    """Probes (side 1 or 3) against members (side 2 or 3) of other teams: links that connect all teams that any link connects."""

    def run(table):
        import pyarrow as pa

        names = table.column("class").to_numpy()
        side = table.column("side").to_numpy()
        _, label = np.unique(table.column("team").to_numpy(), return_inverse=True)
        sketch = _sketches(table.column("sketch"), parts)
        sets = [np.frombuffer(b, np.uint64) for b in table.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        codes, cuts = np.unique(np.concatenate(sets), return_inverse=True)[1], np.concatenate([[0], np.cumsum(sizes)])
        codes = [codes[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        held = np.zeros(cuts[-1] + 1, np.int32)
        members = np.flatnonzero(side & 2)
        member_sizes, member_sketch, both_sides = sizes[members], sketch[members], side[members] == 3
        found = []
        for p in np.flatnonzero(side & 1):
            near = (label[members] != label[p]) & (_collisions(member_sketch, sketch[p]) >= matches) & _fit(member_sizes, sizes[p], percent)
            if side[p] == 3:
                near &= ~both_sides | (members > p)
            todo = members[near]
            if not len(todo):
                continue
            held[codes[p]] = 1
            starts = np.concatenate([[0], np.cumsum(sizes[todo])[:-1]])
            common = np.add.reduceat(held[np.concatenate([codes[m] for m in todo])], starts)
            held[codes[p]] = 0
            for m in todo[100 * common >= percent * (sizes[p] + sizes[todo] - common)]:
                if label[m] != label[p]:
                    label[label == label[m]] = label[p]
                    found.append((names[p], names[m]))
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _meet(rows: DataFrame, texts: DataFrame, parts: int, matches: int, percent: int) -> DataFrame:
    """Links (a, b) inside the groups of ``rows(key, class, team, side)``."""
    rows = broadcast_if_small(stored(rows, "rows"), F.lit(32))  # else all sets are shuffled once more
    rows = texts.join(rows, "class").select("key", "class", "team", "side", "sketch", "shingles")
    return rows.groupBy("key").applyInArrow(_confirm(parts, matches, percent), "a long, b long")


def _side(rows: DataFrame, key: Column, team: Column, side: int) -> DataFrame:
    return rows.select(key.alias("key"), "class", team.alias("team"), F.lit(side).alias("side"))


def _by_shingles(teams: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Stored ``(cluster, pair, class, team, n, k)``: the classes of ``teams(cluster, class, team)`` under the rarest of their shingles, as
    many as two sets that may link share one of; lists of one team are left out.  ``n`` classes of a list fill ``k`` blocks."""
    classes = broadcast_if_small(teams.select("cluster", "class"), F.lit(16))  # else the sets of all clusters are shuffled
    pairs = texts.join(classes, "class").select("cluster", "class", "shingles").mapInArrow(_grams(percent), "class long, pair long, least int")
    prefix = _rarest(_shared(pairs, F.max("least").alias("least")), F.col("least"))
    lists = stored(teams.join(prefix.select("class", F.explode("pairs").alias("pair")), "class"), "lists")
    met = lists.groupBy("pair").agg(F.count("*").alias("n"), F.min("team").alias("low"), F.max("team").alias("high")).where("low < high")
    met = met.select("pair", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("k"))
    return stored(lists.join(met, "pair").select("cluster", "pair", "class", "team", "n", "k"), "met")


def _texts(docs: DataFrame, signed: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """Stored ``(class, sketch, shingles)`` of the ``wanted(class)``, made again from one text of each."""
    holder = signed.join(wanted, "class").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch"))
    holder = stored(holder, "holders")
    ids = broadcast_if_small(holder.select(F.col("doc_id").alias("_id")).distinct(), F.lit(16))
    text = null_safe(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ids, {"doc_id": "_id"}, "left_semi").select("text")
    sets = text.mapInArrow(_sets(size), "class long, shingles binary")
    # by class once more: of several rows with a holder's id, only those with its text count
    return stored(sets.join(holder.select("class", "sketch"), "class"), "sets")


def links(docs: DataFrame, signed: DataFrame, size: int, coordinates: int, matches: int, percent: int) -> DataFrame:
    """Links between classes that connect all classes connected by any link."""
    parts = coordinates // _NIBBLES
    first = signed.where("class IS NOT NULL").groupBy("class")
    first = first.agg(*[F.first(c).alias(c) for c in ("signature", "sketch", "n_shingles")])
    lists = stored(postings(first, matches), "postings")
    edges = stored(candidates(lists, parts, matches, percent), "candidates")
    clusters = components(edges).toDF("class", "cluster")
    clusters = stored(clusters.join(clusters.groupBy("cluster").agg(F.count("*").alias("n")), "cluster"), "clusters")
    texts = _texts(docs, signed, clusters.select("class"), size)
    small, large = clusters.where(F.col("n") <= LARGE), clusters.where(F.col("n") > LARGE)
    # small clusters share tasks; what meets there beyond its cluster is only compared for nothing
    whole = _side(small, F.pmod(F.xxhash64("cluster"), F.lit(small.count() // BLOCK + 1)), F.col("class"), 3)
    heads = edges.select(F.col("b").alias("class"), F.struct((-F.col("equal")).alias("less"), F.col("a").alias("team")).alias("head"))
    heads = heads.join(large.select("class"), "class").groupBy("class").agg(F.slice(F.sort_array(F.collect_list("head")), 1, HEADS).alias("heads"))
    heads = stored(heads.select("class", F.explode("heads.team").alias("head")), "heads")
    tasks = F.lit(heads.count() // BLOCK + 1)
    blocks = stored(heads.groupBy("head").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k")), "blocks")
    one = F.col("k") == 1
    task = lambda i: F.when(one, F.pmod(F.xxhash64("head"), tasks)).otherwise(F.xxhash64("head", i))
    probes = _side(heads.join(blocks, "head"), task(F.pmod(F.xxhash64("class"), F.col("k")).cast("int")), F.col("class"), 1)
    head_rows = blocks.select(F.col("head").alias("class"), "head", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"))
    head_rows = _side(head_rows, task(F.col("i")), F.col("class"), 2)
    # keys of the two kinds may be equal, too
    rows = whole.select(F.xxhash64(F.lit("whole"), "key").alias("key"), "class", "team", "side").unionByName(probes).unionByName(head_rows)
    near = stored(_meet(rows, texts, parts, matches, percent), "near")

    teams = components(near)
    teams = large.join(teams, large["class"] == teams["node"], "left").select("cluster", "class", F.coalesce("root", "class").alias("team"))
    teams = stored(teams, "teams")
    counts = teams.groupBy("cluster", "team").agg(F.count("*").alias("n")).groupBy("cluster")
    counts = counts.agg(F.max_by("team", F.struct("n", "team")).alias("largest"), F.sum("n").alias("m"), F.max("n").alias("most"))
    counts = counts.where("m > most").select(
        "cluster", "largest", "m", "most", F.ceil(F.col("m") / BLOCK).cast("int").alias("mb"), F.ceil((F.col("m") - F.col("most")) / BLOCK).cast("int").alias("pb")
    )
    counts = stored(counts.withColumn("met", F.col("m") * F.col("pb") + (F.col("m") - F.col("most")) * F.col("mb")), "counts")
    lists = _by_shingles(teams.join(counts.where(F.col("pb") > WIDE).select("cluster"), "cluster").select("cluster", "class", "team"), texts, percent)
    cost = lists.groupBy("cluster").agg(F.sum("k").alias("listed"))
    wide = counts.where(F.col("pb") > WIDE).join(cost, "cluster", "left").where(F.coalesce("listed", F.lit(0)) < F.col("met"))
    wide = stored(wide.select("cluster"), "wide")
    lists = lists.join(wide, "cluster", "left_semi")
    # short lists share tasks, long ones are cut into blocks
    tasks = F.lit(lists.where("k = 1").count() // BLOCK + 1)
    own = F.pmod(F.xxhash64("class"), F.col("k")).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.xxhash64("pair", F.least(own, j), F.greatest(own, j)))
    met = lists.select(F.explode(F.when(one, F.array(F.pmod(F.xxhash64("pair"), tasks))).otherwise(pieces)).alias("key"), "class", "team")
    met = met.select(F.xxhash64(F.lit("lists"), "key").alias("key"), "class", "team", F.lit(3).alias("side")).distinct()
    open_ = teams.join(counts, "cluster").join(wide, "cluster", "left_anti")
    place = lambda k: F.pmod(F.xxhash64("class"), F.col(k)).cast("int")
    others = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1)).alias("other")
    members = _side(open_.select("*", others("pb")), F.xxhash64("cluster", place("mb"), "other"), F.col("team"), 2)
    guests = open_.where("team <> largest").select("*", others("mb"))
    guests = _side(guests, F.xxhash64("cluster", "other", place("pb")), F.col("team"), 1)
    rows = members.unionByName(guests).unionByName(met)
    return stored(near.unionByName(_meet(rows, texts, parts, matches, percent)), "links")


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = PERCENT, coordinates: int = COORDINATES, matches: int = MATCHES
) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id (smallest doc_id
    reachable by links, its own included), kept (doc_id = component_id)."""
    signed = stored(signatures(docs, size, coordinates), "signatures")
    groups = components(links(docs, signed, size, coordinates, matches, percent))
    rows = signed.select("doc_id", "class", "n_shingles")
    low = rows.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("low"))
    low = low.join(groups, low["class"] == groups["node"], "left").select("class", "low", F.coalesce("root", "class").alias("root"))
    by_root = low.groupBy("root").agg(F.min("low").alias("component_id"))
    best = low.join(by_root, "root").select(F.col("class").alias("_class"), "component_id")
    out = rows.join(best, rows["class"] == best["_class"], "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _row_key(docs: DataFrame) -> Column:
    """A hash of the whole row, but for maps, which have none."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))])


def keep_first(docs: DataFrame, size: int = 5, percent: int = PERCENT, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """One row of ``docs`` for each component, all columns kept: that of the smallest doc_id (nulls last), of
    several rows with it the one with the least hash, and of equal rows one.  Texts without words all stay."""
    signed = stored(signatures(docs, size, coordinates, _row_key(docs)), "signatures")
    groups = components(links(docs, signed, size, coordinates, matches, percent))
    rows = signed.groupBy("class", "doc_id", "key").agg(F.count("*").alias("n"))
    least = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "n")
    low = rows.where("class IS NOT NULL").groupBy("class").agg(F.min(least).alias("low"))
    low = low.join(groups, low["class"] == groups["node"], "left").groupBy(F.coalesce("root", "class").alias("root")).agg(F.min("low").alias("low"))
    best = low.select(F.col("low.doc_id").alias("_id"), F.col("low.key").alias("_key"), F.col("low.n").alias("_n"))
    blank = rows.where("class IS NULL").select("doc_id", "key", F.lit(1).cast("long"))
    best = stored(best.union(blank), "firsts")
    # the row travels as one column, so none of its names can clash
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), _row_key(docs).alias("key")
    )
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    out = whole.join(best.where("_n = 1"), same, "left_semi").select("row.*")
    repeated = best.where("_n > 1")
    if not repeated.isEmpty():
        once = whole.join(repeated, same, "left_semi").groupBy("id", "key").agg(F.first("row").alias("row"))
        out = out.unionByName(once.select("row.*"))
    return out
