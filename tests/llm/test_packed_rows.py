"""Packed rows of repeated windows: their bytes follow the entries, not buckets times documents."""

import numpy as np
import pyarrow as pa

from textprep.llm import substring_dedup as SD


def rows(buckets, texts):
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(len(texts)), pa.int64()), "mark": pa.array([7] * len(texts), pa.int32()), "text": texts})
    return [r for b in SD._slices(20, buckets)(iter([batch])) for r in b.to_pylist()]


def size(found, names):
    return sum(len(r[n]) for r in found for n in names)


def test_bytes_do_not_grow_with_the_buckets():
    g = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in g.integers(0, 5000, 80)) for _ in range(400)] + ["the same passage " * 20] * 50
    few, many = rows(32, texts), rows(4000, texts)
    entries = ("hashes", "places", "repeats")
    assert size(few, entries) == size(many, entries)
    tables = ("ids", "marks", "counts")
    assert size(many, tables) <= 2 * size(many, entries)  # a document's 16 bytes once for each of its entries at most
    assert size(few, tables) <= 32 * 450 * 16
    for r in many:  # a row names its own documents only
        n = len(r["counts"]) // 4
        places = np.concatenate([SD._unplane(r[c], np.uint32) for c in ("places", "repeats")])
        ends = np.cumsum(SD._unplane(r["counts"], np.uint32))
        assert len(np.unique(np.searchsorted(ends, places, side="right"))) == n


def test_buckets_find_the_same_repeats():
    texts = ["a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3, "z " + "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 2, "short text"] * 3

    def repeats(buckets):
        by = {}
        for r in rows(buckets, texts):
            by.setdefault(r["bucket"], []).append(r)
        out = set()
        for mine in by.values():
            ids, _, doc, at = SD._repeats(pa.Table.from_pylist(mine))
            out |= set(zip(ids[doc].tolist(), at.tolist()))
        return out

    assert repeats(1) == repeats(7) == repeats(500) != set()
