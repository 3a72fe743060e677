"""Removal of repeated word windows.

Every window of ``width`` consecutive words gets a Rabin-Karp hash (64 bits over 64-bit word hashes).
A task first settles the repeats among the documents it has read itself, then sends one entry per
distinct window, packed into one binary row per bucket of the hash range; so a passage that a third
of all documents share reaches its bucket once per task, not once per document.  A bucket compares
its entries, and sends the repeats on, packed by groups of documents; each group merges the positions
of a document into maximal intervals, one row per document.

Entry order is (doc_id, first word).  Defined cases: a null text has no words; null ids count as one
id after all others; rows that repeat a doc_id are told apart by a hash of their text, and of two
windows with equal id and equal start neither counts as earlier; documents shorter than a window are
left as they are; an empty table gives no rows; other columns are kept."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textprep.llm.common import blank_words, mix, null_safe, release, rolling, text_chunks, word_hashes
from textprep.session import shuffle_partitions

WIDTH = 20
FLUSH_WINDOWS = 1_000_000  # windows a task holds before it sends them
BUCKET_BYTES = 24 << 20  # text per bucket of the hash range
_NULL_ID = np.iinfo(np.int64).max

MADE = ("n_words", "n_removed", "kept_sha256", "removed")
_ENTRIES = "bucket int, hashes binary, places binary, ids binary, marks binary, counts binary, repeats binary"
_REPEATS = "target int, ids binary, marks binary, n binary, starts binary"
_REMOVED = "array<struct<first: long, end: long>>"


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: the high ones are mostly zero, and shuffle files compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplane(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _slices(width: int, buckets: int):
    """Arrow batches of (id, mark, text) to packed window entries, one row per bucket and flush."""

    def settle(held):
        import pyarrow as pa

        ids = np.concatenate([h[0] for h in held])
        marks = np.concatenate([h[1] for h in held])
        counts = np.concatenate([h[2] for h in held])  # words of each document
        hashes = np.concatenate([h[3] for h in held])
        docs = np.concatenate([h[4] + b for h, b in zip(held, np.cumsum([0] + [len(h[0]) for h in held[:-1]]))])
        starts = np.concatenate([h[5] for h in held])
        by_id = np.lexsort((marks, ids))
        rank = np.empty(len(ids), np.int64)
        rank[by_id] = np.arange(len(ids))
        ids, marks, counts = ids[by_id], marks[by_id], counts[by_id]
        firsts = np.concatenate([[0], np.cumsum(counts)])
        place = firsts[rank[docs]] + starts  # in the order (id, mark, first word)
        order = np.lexsort((place, hashes))
        hashes, place = hashes[order], place[order]
        doc = np.searchsorted(firsts, place, side="right") - 1
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        start = place - firsts[doc]
        first = (ids[doc] == ids[doc[head]]) & (start == start[head])  # the earliest, and its equals
        again = np.unique(place[~first])
        rows = []
        cut = np.searchsorted(hashes[first], np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64))
        parts_h, parts_p = np.split(hashes[first], cut), np.split(place[first], cut)
        share = np.searchsorted(again, firsts[(np.arange(1, buckets) * len(ids)) // buckets])
        for b, (h, p, r) in enumerate(zip(parts_h, parts_p, np.split(again, share))):
            if len(h) or len(r):
                # a row names the documents it has entries of, and places count within those
                both = np.concatenate([p, r])
                of = np.searchsorted(firsts, both, side="right") - 1
                own, code = np.unique(of, return_inverse=True)
                at = (np.cumsum(counts[own]) - counts[own])[code] + both - firsts[of]
                tables = _planes(np.diff(ids[own], prepend=0)), _planes(marks[own]), _planes(counts[own].astype(np.uint32))
                rows.append((b, _planes(np.diff(h, prepend=np.uint64(0))), _planes(at[: len(p)].astype(np.uint32)), *tables, _planes(at[len(p) :].astype(np.uint32))))
        names = [x.split()[0] for x in _ENTRIES.split(", ")]
        kinds = [pa.int32()] + [pa.binary()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names) if rows else None

    def run(batches):
        held, n, batch = [], 0, None
        for batch in batches:
            all_ids = np.array(batch.column(0).fill_null(_NULL_ID), np.int64)
            all_marks = np.array(batch.column(1), np.int32)
            for lo, hi, data, offsets in text_chunks(batch.column(2)):
                begin, end, first = blank_words(data, offsets)
                counts = np.diff(first)
                if counts.max(initial=0) < width:
                    continue
                words = word_hashes(data, begin, end)
                at = np.arange(len(words) - width + 1)
                doc = np.repeat(np.arange(hi - lo), counts)
                at = at[doc[at] == doc[at + width - 1]]
                keep = np.flatnonzero(counts >= width)
                new = np.cumsum(counts >= width) - 1
                held.append((all_ids[lo:hi][keep], all_marks[lo:hi][keep], counts[keep], rolling(words, at, at + width), new[doc[at]], at - first[doc[at]]))
                n += len(at)
                if n >= FLUSH_WINDOWS:
                    out = settle(held)
                    held, n = [], 0
                    if out is not None:
                        yield out
        if n and (out := settle(held)) is not None:
            yield out
        del held, batch
        release()

    return run


def _compare(groups: int):
    """One bucket: of equal hashes all entries but the earliest are repeats.  They leave in one row for
    each group of documents."""

    def run(table):
        import pyarrow as pa

        ids, marks, doc, at = _repeats(table)
        to = (mix(ids.view(np.uint64), 3) % np.uint64(groups)).astype(np.int64)[doc]
        order = np.lexsort((at, doc, to))
        to, doc, at = to[order], doc[order], at[order]
        rows = []
        for part in np.split(np.arange(len(to)), np.flatnonzero(np.diff(to)) + 1):
            if len(part):
                own, n = np.unique(doc[part], return_counts=True)
                rows.append((int(to[part[0]]), _planes(ids[own]), _planes(marks[own]), _planes(n.astype(np.int32)), _planes(at[part])))
        kinds = [pa.int32()] + [pa.binary()] * 4
        columns = list(zip(*rows)) or [()] * 5
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in _REPEATS.split(", ")])

    return run


def _merge(width: int):
    """One group of documents: a row per document with the maximal intervals of its repeated windows."""

    def run(table):
        import pyarrow as pa

        ids, marks, at = [], [], []
        for row in table.to_pylist():
            n = _unplane(row["n"], np.int32)
            ids.append(np.repeat(_unplane(row["ids"], np.int64), n))
            marks.append(np.repeat(_unplane(row["marks"], np.int32), n))
            at.append(_unplane(row["starts"], np.int32))
        ids, marks, at = map(np.concatenate, (ids, marks, at))
        order = np.lexsort((at, marks, ids))
        ids, marks, at = ids[order], marks[order], at[order]
        other = np.ones(len(ids), bool)
        other[1:] = (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])
        new = other.copy()
        new[1:] |= at[1:] > at[:-1] + width
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        doc = np.flatnonzero(other)
        cut = np.append(np.searchsorted(first, doc), len(first)).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(at[first], pa.int64()), pa.array(at[last] + width, pa.int64())], ["first", "end"])
        found = pa.array(ids[doc], pa.int64(), mask=ids[doc] == _NULL_ID)
        return pa.table({"_id": found, "_mark": pa.array(marks[doc], pa.int32()), "removed": pa.ListArray.from_arrays(pa.array(cut), pairs)})

    return run


def _repeats(table):
    hashes, docs, starts, ids, marks, again_doc, again_at, base = [], [], [], [], [], [], [], 0
    for row in table.to_pylist():
        firsts = np.concatenate([[0], np.cumsum(_unplane(row["counts"], np.uint32), dtype=np.int64)])
        own = np.cumsum(_unplane(row["ids"], np.int64))
        ids.append(own)
        marks.append(_unplane(row["marks"], np.int32))
        for blob, to_doc, to_at in ((row["places"], docs, starts), (row["repeats"], again_doc, again_at)):
            p = _unplane(blob, np.uint32).astype(np.int64)
            d = np.searchsorted(firsts, p, side="right") - 1
            to_doc.append((d + base).astype(np.int32))
            to_at.append((p - firsts[d]).astype(np.int32))
        hashes.append(np.cumsum(_unplane(row["hashes"], np.uint64), dtype=np.uint64))
        base += len(own)
    hashes, docs, starts, ids, marks = map(np.concatenate, (hashes, docs, starts, ids, marks))
    order = np.argsort(hashes, kind="stable")
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = hashes[order[1:]] == hashes[order[:-1]]
    order = order[same[1:] | same[:-1]]  # entries whose hash another task has too
    order = order[np.lexsort((starts[order], ids[docs[order]], hashes[order]))]
    h, d, s = hashes[order], docs[order], starts[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    repeat = (ids[d] != ids[d[head]]) | (s != s[head])
    return ids, marks, np.concatenate([d[repeat], *again_doc]), np.concatenate([s[repeat], *again_at])


def repeated_windows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(_id, _mark, removed)``: for each document with repeats the maximal intervals of words covered by
    windows whose word sequence also starts earlier."""
    # a bucket is compared by one task: their number follows the size of the text
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(shuffle_partitions(docs.sparkSession), size // BUCKET_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.hash("text").alias("mark"), "text")
    entries = rows.mapInArrow(_slices(width, buckets), _ENTRIES)
    repeats = entries.groupBy("bucket").applyInArrow(_compare(buckets), _REPEATS)
    return repeats.groupBy("target").applyInArrow(_merge(width), f"_id long, _mark int, removed {_REMOVED}")


def _apply(kept_text: bool):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rest, text, removed = batch.columns
            total, gone, digests, kept, spans = [], [], [], [], []
            for t, cuts in zip(text.cast(pa.binary()), removed.to_pylist()):
                raw = t.as_py()
                words = raw.split() if raw is not None else []
                left, n = [], 0
                for c in cuts or ():
                    left += words[n : c["first"]]
                    n = c["end"]
                left += words[n:]
                total.append(len(words))
                gone.append(len(words) - len(left))
                digests.append(hashlib.sha256(b" ".join(left)).hexdigest())
                spans.append(cuts or [])
                if kept_text:
                    kept.append(_cut(raw, cuts) if cuts else raw)
            out = [rest, pa.array(kept, pa.binary()).cast(text.type)] if kept_text else [rest]
            out += [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())]
            out.append(pa.array(spans, removed.type))
            yield pa.RecordBatch.from_arrays(out, ["rest", *["text"] * kept_text, *MADE])
        release()

    return run


def _cut(raw: bytes, cuts: list[dict]) -> bytes:
    """``raw`` without the words of the intervals; the blanks after a removed word go with it, all
    other characters stay."""
    begin, _, _ = blank_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    begin = np.append(begin, len(raw))
    parts, at = [], 0
    for c in cuts:
        parts.append(raw[at : begin[c["first"]]])
        at = begin[c["end"]]
    return b"".join([*parts, raw[at:]])


def remove_repeats(docs: DataFrame, width: int = WIDTH, kept_text: bool = True) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_sha256 (of the kept words joined by one space) and
    removed (the maximal word intervals); with ``kept_text`` the text is what remains, else there is
    no text.  Columns of ``docs`` with these names are replaced."""
    names = [c for c in docs.columns if c not in MADE and c != "text"]
    found = repeated_windows(docs, width)
    # all other columns travel as one, so none of their names can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("rest"), "text", F.col("doc_id").alias("_own"), F.hash("text").alias("_own_mark"))
    joined = null_safe(rows, found, {"_own": "_id", "_own_mark": "_mark"}, "left").select("rest", "text", "removed")
    made = f"n_words long, n_removed long, kept_sha256 string, removed {_REMOVED}"
    schema = f"rest {rows.schema['rest'].dataType.simpleString()}, {'text string, ' if kept_text else ''}{made}"
    done = joined.mapInArrow(_apply(kept_text), schema)
    order = [F.col("text") if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns if c in names or c == "text" and kept_text]
    return done.select(*order, *MADE)


def strip_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with repeated windows cut out of the text and n_chars, where there is one, set to what is
    left; documents that had words and keep none go.  All columns stay, names that
    :func:`remove_repeats` makes included."""
    kept = [F.col(f"`{c}`") for c in docs.columns]
    # what the caller has under those names would be replaced: it travels under others
    hidden = {c: f"{c}_own" for c in docs.columns if c in MADE}
    for old, new in hidden.items():
        docs = docs.withColumnRenamed(old, new)
    done = remove_repeats(docs, width).where("n_removed = 0 OR n_removed < n_words")
    if "n_chars" in done.columns:
        done = done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(done.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    done = done.drop(*MADE)
    for old, new in hidden.items():
        done = done.withColumnRenamed(new, old)
    return done.select(*kept)
