"""Embeddings, archives and chat formatting against plain versions and odd rows."""

import gzip
import glob
import math
import os
import random
import sys
import tempfile

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute
from pyspark.sql import functions as F

from textprep.llm import chat, embed_dedup, warc

rng = np.random.default_rng(4)


def clusters(n, dim, groups):
    out = [rng.normal(size=dim) for _ in range(n)]
    for g in range(groups):
        c = rng.normal(size=dim)
        out += [c + rng.normal(size=dim) * s for s in rng.uniform(0, 0.6, 12)]
    return [[float(x) for x in v] for v in out]


def check_links(spark, vectors, ids=None, **options):
    ids = ids or list(range(len(vectors)))
    df = spark.createDataFrame(list(zip(ids, vectors)), "vec_id long, embedding array<float>").withColumn("class", F.lit(1))
    got = {r["vec_id"]: r for r in embed_dedup.cosine_links(df.repartition(3)).collect()}
    exact = {}
    for i, v in zip(ids, vectors):
        x = None if v is None or any(e is None or not math.isfinite(e) for e in v) or not any(v) else np.array(v, np.float32).astype(float)
        if x is not None:
            exact[i] = x / np.linalg.norm(x)
    links = [(a, b) for a in exact for b in exact if a < b and len(exact[a]) == len(exact[b]) and exact[a] @ exact[b] >= 0.9]
    root = brute.components(ids, links)
    for i in ids:
        n = sum(i in e for e in links)
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n, root[i], root[i] == i), i
    return links


def test_embeddings(spark, monkeypatch):
    odd = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [1.0] * 3, [1e-30] * 8, [1e30] * 8]
    vectors = clusters(60, 8, 6)
    vectors += vectors[:5] + [vectors[3]] * 20 + odd[:6] + odd[7:]
    ids = list(range(len(vectors)))
    random.Random(1).shuffle(ids)
    assert check_links(spark, vectors, ids)
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    embed_dedup.links.__defaults__ = (embed_dedup.COSINE, 16, embed_dedup.MAX_PIVOTS)
    try:  # many pivots, rings and blocks
        assert check_links(spark, vectors, ids)
        assert check_links(spark, clusters(200, 3, 5))
    finally:
        embed_dedup.links.__defaults__ = (embed_dedup.COSINE, 2048, embed_dedup.MAX_PIVOTS)


def test_embeddings_of_several_lengths(spark):
    """Vectors of each length link with each other, also of those that few vectors have."""
    most, fewer, rare = clusters(60, 8, 6), clusters(20, 12, 3), clusters(0, 3, 1)
    vectors = most + fewer + fewer[:4] + rare + [rare[0], [1.0] * 9, [2.0] * 9, None, [0.0] * 12]
    ids = list(range(len(vectors)))
    random.Random(2).shuffle(ids)
    length = dict(zip(ids, (len(v or []) for v in vectors)))
    assert {length[a] for a, _ in check_links(spark, vectors, ids)} == {3, 8, 9, 12}
    usual = embed_dedup.links.__defaults__
    try:  # many pivots and blocks; then pivots for the two frequent lengths only
        for pivots in (embed_dedup.MAX_PIVOTS, 4):
            embed_dedup.links.__defaults__ = (embed_dedup.COSINE, 16, pivots)
            check_links(spark, vectors, ids)
    finally:
        embed_dedup.links.__defaults__ = usual


def test_embeddings_edges(spark):
    schema = "vec_id long, embedding array<double>"
    assert embed_dedup.cosine_links(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, [1.0, 0.0]), (4, [1.0, 0.01]), (4, [1.0, 0.01]), (7, [1.0, 0.0, 0.0]), (8, None)]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in embed_dedup.cosine_links(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(None, 2, 4), (4, 2, 4), (4, 2, 4), (7, 0, 7), (8, 0, 8)], key=str)


LONG = "<p>" + "long line\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n" * 3000
PAGES = [
    (5, "http://a/5", "x" * 100), (3, "http://a/3", "x" * 100), (9, None, "x" * 100), (1, "u", "x" * 99), (2, "u", "x" * 99), (4, "u", None), (6, "u\r\nX: y", ""),
    (7, "http://a/é", LONG), (8, "v", LONG), (10, "v", "é" * 50), (11, "v", "é" * 50), (12, "v", "ends in CR\r" * 20), (13, "v", "ends in CRLF\r\n" * 20),
    (5, "http://a/5", "x" * 100), (None, "n", "x" * 100), (14, "v", "\r\n" * 60), (15, "v", "\n" * 120),
]


def test_archives(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, payload string").withColumn("digest", F.lit("clash"))
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/warc"
    back = warc.archive(df.repartition(3), path).collect()
    assert len(back) == len(PAGES) and all(r["block_ok"] for r in back)
    kept = {(r["page_id"], r["record_type"], r["refers_to"]) for r in back}
    assert {(3, "response", None), (5, "revisit", 3), (9, "revisit", 3), (1, "response", None), (2, "response", None), (8, "revisit", 7), (11, "revisit", 10)} <= kept
    assert (None, "response", None) in kept and (7, "response", None) in kept
    for page, _, payload in PAGES:
        own = [r for r in back if r["page_id"] == page and r["record_type"] == "response"]
        assert all(bytes(r["payload"]) == (payload or "").encode() for r in own)
    files = b"".join(gzip.open(f).read() for f in glob.glob(f"{path}/*.gz"))
    assert files.count(b"WARC-Type: revisit\r\n") == 5 and b"WARC-Target-URI: uX: y\r\n" in files
    empty = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/warc"
    assert warc.archive(df.where("false"), empty).count() == 0


SCHEMA = "pair_id long, turn long, role string, text string"


def test_preferences_by_hand(spark):
    chosen = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "more"), (1, 3, "assistant", "good"), (2, 0, "user", "x"), (3, 0, "user", "same"), (4, 0, None, None)]
    rejected = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "other"), (1, 3, "assistant", "bad"), (3, 0, "user", "same"), (5, None, "assistant", "late")]
    got = chat.format_pairs(spark.createDataFrame(chosen, SCHEMA).withColumn("c", F.lit(9)), spark.createDataFrame(rejected, SCHEMA)).collect()
    seen = {(r["pair_id"], r["part"], r["turn"], r["mask"]) for r in got}
    assert seen == {
        (1, "prompt", 0, 0), (1, "prompt", 1, 0), (1, "chosen", 2, 0), (1, "chosen", 3, 1), (1, "rejected", 2, 0), (1, "rejected", 3, 1),
        (2, "chosen", 0, 0), (3, "prompt", 0, 0), (4, "chosen", 0, 0), (5, "rejected", None, 1),
    }
    assert [r["rendered"] for r in got if r["pair_id"] == 4] == ["<|im_start|>\n<|im_end|>\n"]
    assert all(r["copies"] == 1 for r in got)


def test_preferences_repeated_turns(spark):
    chosen = [(1, 0, "user", "q"), (1, 0, "user", "q"), (1, 1, "assistant", "a")]
    rejected = [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    got = {(r["part"], r["turn"]): r["copies"] for r in chat.format_pairs(spark.createDataFrame(chosen, SCHEMA), spark.createDataFrame(rejected, SCHEMA)).collect()}
    assert got == {("chosen", 0): 2, ("rejected", 0): 1, ("chosen", 1): 1, ("rejected", 1): 1}


def test_negatives(spark):
    turns = spark.createDataFrame(
        [(0, 0, "user", "a"), (0, 1, "assistant", "b"), (1, 0, "user", "c"), (1, 1, "assistant", "d"), (1, 2, "user", "e"), (6, 0, "user", "f"), (None, 0, "user", "g"), (8, None, "assistant", "h")],
        "conv_id long, turn long, role string, text string",
    ).withColumn("last", F.lit(3))
    chosen, rejected = chat.with_negatives(turns)
    assert chosen.count() == 8
    got = sorted(((r["pair_id"], r["turn"], r["text"]) for r in rejected.collect()), key=str)
    assert got == sorted([(0, 0, "a"), (0, 1, "d"), (1, 0, "c"), (1, 1, "b"), (6, 0, "f"), (None, 0, "g"), (8, None, "h")], key=str)
    none = turns.where("false")
    assert chat.format_pairs(*chat.with_negatives(none)).count() == 0
