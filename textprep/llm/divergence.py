"""Source divergence audit: how far the sources of a language differ in their words, and by which words.

Of a language's kept terms each (language, source) has a count level, and a level alone decides a term's share.
So two sources are compared by the joint table of their levels: how many terms have level a in one and level
b in the other.  Indicator columns for (source, level), one row for each term, multiplied by their
transpose give all joint tables of the sources at once; the products run in blocks of terms (dealt by hash, in
a block from the most frequent term, so that few levels meet) and of sources, count exactly, and each
entry is priced once for all its terms.  All arithmetic is on integers; products count at most a
block's rows, which 32-bit floats hold exactly.

Defined cases: null text, language and source count as empty; every row is a document, also one that repeats;
a language without kept terms has pairs of value 0 and no term rows; a language of one source has no pairs;
equal values rank by the bytes of the item; other columns are not read; an empty table gives no rows; very
long texts are counted like others.  Values and counts are longs (the shares' numerators pass through
Python integers where they would not fit)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textprep.llm.common import _TO_LOWER, stored, text_chunks

MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
ENTRIES = 2_000_000  # counts that a task holds before it sends them
BLOCK_ROWS = 200_000  # counts of a block of terms
SOURCES = 64  # of a block of sources
MAX_COLUMNS = 2048  # indicator columns at which the next product takes fewer terms

_LETTER = np.ones(256, bool)
_LETTER[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False


# --- counting -------------------------------------------------------------------------------------

def _terms(data: np.ndarray, offsets: np.ndarray):
    """Lower-cased terms of texts as a dictionary, with the term of every occurrence and its text."""
    import pyarrow as pa

    letter = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, ends = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1] | edge[1:-1]
    ends[:-1] &= ~letter[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(stops - starts, out=at[1:])
    buffers = [None, pa.py_buffer(at), pa.py_buffer(_TO_LOWER[data[letter]])]
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
    return found.dictionary, found.indices.to_numpy().astype(np.int64), np.searchsorted(offsets, starts, side="right") - 1


def _sums(keys: np.ndarray, *values: np.ndarray):
    """Distinct keys and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values)


def _count(batches):
    """(language, source, term, occurrences, documents) of a task's rows, summed as far as memory allows."""
    import pyarrow as pa

    groups: dict[tuple[str, str], int] = {}
    words, parts, held = [], [], 0

    def flush():
        codes = pa.concat_arrays(words).dictionary_encode()
        to, shift = codes.indices.to_numpy().astype(np.int64), np.cumsum([0, *(len(w) for w in words)])
        size = len(codes.dictionary)
        keys = np.concatenate([g * size + to[shift[i] + t] for i, (g, t, _, _) in enumerate(parts)])
        keys, n, docs = _sums(keys, *(np.concatenate([p[k] for p in parts]) for k in (2, 3)))
        names = list(groups)
        of, term = keys // max(size, 1), codes.dictionary.cast(pa.large_string()).cast(pa.string())
        for a in range(0, len(keys), 100_000):
            b = min(a + 100_000, len(keys))
            lang, source = (pa.array([x[k] for x in names], pa.string()).take(pa.array(of[a:b])) for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [lang, source, term.take(pa.array(keys[a:b] % size)), pa.array(n[a:b]), pa.array(docs[a:b])],
                names=["lang", "source", "term", "n", "docs"],
            )
        words.clear(), parts.clear(), groups.clear()

    for batch in batches:
        pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for lo, hi, data, offsets in text_chunks(batch.column(2), 4 << 20):
            dictionary, term, row = _terms(data, offsets)
            if not len(term):
                continue
            size = len(dictionary)
            cells, n = _sums(row * size + term, np.ones(len(term), np.int64))
            code = np.array([groups.setdefault(p, len(groups)) for p in pairs[lo:hi]])
            keys, n, docs = _sums(code[cells // size] * size + cells % size, n, np.ones(len(cells), np.int64))
            words.append(dictionary)
            parts.append((keys // size, keys % size, n, docs))
            held += len(keys)
            if held >= ENTRIES:
                yield from flush()
                held = 0
    if parts:
        yield from flush()


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(lang, source, term, n, first)`` of the terms in at least ``min_docs`` documents of a language; ``first``
    is 1 on one row of each (lang, term).  One shuffle, by language and term, serves sums, document counts and marks."""
    counts = docs.mapInArrow(_count, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    counts = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    counts = counts.withColumn("docs", F.sum("docs").over(term)).withColumn("place", F.row_number().over(term.orderBy("source")))
    return counts.where(F.col("docs") >= min_docs).select("lang", "source", "term", "n", (F.col("place") == 1).cast("long").alias("first"))


# --- pricing --------------------------------------------------------------------------------------

def _share(count: np.ndarray, whole) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / whole), exactly."""
    if len(count) and int(count.max()) + 2 > (1 << 63) // SCALE - 1:
        wholes = np.broadcast_to(whole, count.shape).tolist()
        return np.array([1 + SCALE * (c + 2) // w for c, w in zip(count.tolist(), wholes)], np.int64)
    return 1 + SCALE * (count + 2) // whole


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _indicators(levels: np.ndarray, whole: np.ndarray, first: int):
    """One column for each level of each source: the matrix, the columns' sources and shares."""
    columns, source, share = [], [], []
    for s in range(levels.shape[1]):
        found, code = np.unique(levels[:, s], return_inverse=True)
        columns.append(code.reshape(-1) + sum(map(len, share)))
        source.append(np.full(len(found), first + s))
        share.append(_share(found, whole[s]))
    source, share = np.concatenate(source), np.concatenate(share)
    matrix = np.zeros((len(levels), len(source)), np.float32)
    matrix[np.arange(len(levels))[:, None], np.stack(columns, axis=1)] = 1
    return matrix, source, share


def _price_block(counts, sides):
    """Of a block of terms of one language: its part of every pair's value, and each source's leading terms."""
    import pyarrow as pa

    out = {"lang": [], "source": [], "part": [], "item": [], "value": []}
    if counts.num_rows and sides.num_rows:
        lang = sides.column("lang")[0].as_py()
        sides = sides.take(pa.array(np.argsort([s.encode() for s in sides.column("source").to_pylist()], kind="stable")))
        names = sides.column("source").to_pylist()
        size, kept, total = (sides.column(c).to_numpy() for c in ("size", "kept", "lang_size"))
        whole, lang_whole = size + 2 * kept, total[0] + 2 * kept[0]
        index = {s: i for i, s in enumerate(names)}
        source = np.array([index[s] for s in counts.column("source").to_pylist()])
        terms = counts.column("term").combine_chunks().dictionary_encode()
        n, term, terms = counts.column("n").to_numpy(), terms.indices.to_numpy().astype(np.int64), terms.dictionary.to_pylist()
        in_lang = np.zeros(len(terms), np.int64)
        np.add.at(in_lang, term, n)

        # part term: of each source the terms that lead its part of this block
        p, q = _share(n, whole[source]), _share(in_lang, lang_whole)[term]
        over = np.flatnonzero(p > q)
        by_bytes = np.empty(len(terms), np.int64)
        by_bytes[np.argsort([t.encode() for t in terms], kind="stable")] = np.arange(len(terms))
        value = _gap(p[over], q[over])
        order = over[np.lexsort((by_bytes[term[over]], -value, source[over]))]
        value = _gap(p[order], q[order])
        begin = np.searchsorted(source[order], np.arange(len(names)))
        lead = np.arange(len(order)) - begin[source[order]] < TOP_TERMS
        for s, t, v in zip(source[order][lead].tolist(), term[order][lead].tolist(), value[lead].tolist()):
            out["source"].append(names[s]), out["item"].append(terms[t]), out["part"].append("term"), out["value"].append(v)

        # part pair: joint tables by products of indicators, from the most frequent term
        row_of = np.empty(len(terms), np.int64)
        row_of[np.argsort(-in_lang, kind="stable")] = np.arange(len(terms))
        order = np.argsort(row_of[term], kind="stable")
        row, source, n = row_of[term][order], source[order], n[order]
        sums = np.zeros((len(names), len(names)), np.int64)
        blocks = [slice(a, min(a + SOURCES, len(names))) for a in range(0, len(names), SOURCES)]
        most = max(1, min(4096, 4_000_000 // len(names)))
        at, rows = 0, min(64, most)
        while at < len(terms):
            a, b = np.searchsorted(row, [at, at + rows])
            levels = np.zeros((min(rows, len(terms) - at), len(names)), np.int64)
            levels[row[a:b] - at, source[a:b]] = n[a:b]
            widest = 0
            for i, left in enumerate(blocks):
                x, x_source, x_share = _indicators(levels[:, left], whole[left], left.start)
                widest = max(widest, len(x_source))
                for right in blocks[i:]:
                    y, y_source, y_share = (x, x_source, x_share) if right == left else _indicators(levels[:, right], whole[right], right.start)
                    joint = x.T @ y
                    e, f = np.nonzero(joint)
                    value = _gap(x_share[e], y_share[f]) * joint[e, f].astype(np.int64)
                    np.add.at(sums, (x_source[e], y_source[f]), value)
            at += rows
            rows = max(1, rows // 2) if widest > MAX_COLUMNS else min(rows * 2, most) if widest < MAX_COLUMNS // 2 else rows
        for s, t in zip(*np.nonzero(np.triu(sums, 1))):
            out["source"].append(names[s]), out["item"].append(names[t]), out["part"].append("pair"), out["value"].append(int(sums[s, t]))
        out["lang"] = [lang] * len(out["value"])
    kinds = [pa.string()] * 4 + [pa.int64()]
    return pa.table({name: pa.array(values, kind) for (name, values), kind in zip(out.items(), kinds)})


def audit(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: of every source its distance to each other source of the language
    (part ``pair``), and the terms in which it exceeds the language most (part ``term``)."""
    docs = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = stored(term_counts(docs, min_docs), "audit-counts")
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.sum("first").alias("firsts"))
    sides = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").na.fill(0, ["size", "firsts"])
    by_lang = Window.partitionBy("lang")
    sides = sides.withColumn("kept", F.sum("firsts").over(by_lang)).withColumn("lang_size", F.sum("size").over(by_lang))
    sides = stored(sides.select("lang", "source", "size", "kept", "lang_size"), "audit-sides")

    n_blocks = max(1, -(-counts.count() // BLOCK_ROWS))
    block = F.pmod(F.xxhash64("term"), F.lit(n_blocks)).cast("int")
    dealt = counts.select("lang", block.alias("block"), "source", "term", "n").groupBy("lang", "block")
    beside = sides.where("kept > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")).groupBy("lang", "block")
    parts = stored(dealt.cogroup(beside).applyInArrow(_price_block, "lang string, source string, part string, item string, value long"), "audit-parts")

    first, second = F.col("source"), F.col("item")
    values = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = sides.select("lang", "source").join(sides.select("lang", F.col("source").alias("item")), "lang").where(first != second)
    low, high = F.least(first, second).alias("a"), F.greatest(first, second).alias("b")
    pairs = pairs.select("lang", "source", "item", low, high).join(values.toDF("lang", "a", "b", "value"), ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))

    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(best))
    leading = parts.where("part = 'term'").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TOP_TERMS)
    return pairs.unionByName(leading.select(pairs.columns))
