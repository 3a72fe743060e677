"""Byte-level BPE, source divergence and hard negatives against plain versions and odd rows."""

import base64
import hashlib
import os
import random
import re
import sys
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from brute import lower
from pyspark.sql import functions as F

from textprep.llm import bpe, divergence, hard_negatives, queries

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")
RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")


# --- byte-level BPE -------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def plain():
    with open(RANK_FILE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pattern():
    assert bpe.PATTERN == public_tokenizers.PATTERN


def test_merge(plain):
    ranks, r = bpe.read_ranks(RANK_FILE), random.Random(1)
    words = [b"a" * 5000, b"ab" * 700, b"\xff\xfe" * 40, b"=" * 333, "가나다라".encode() * 30, b"\x00"]
    words += [bytes(r.choice(b"abcdetnos \xc3\xa9") for _ in range(r.randrange(1, 40))) for _ in range(2000)]
    for word in words:
        assert bpe.merge(word, ranks) == plain._core_bpe.encode_single_piece(word)


def test_rank_file_lacks_bytes(tmp_path):
    (tmp_path / "x").write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError, match="single bytes"):
        bpe.read_ranks(str(tmp_path / "x"))


def random_text(r):
    kinds = [lambda: chr(r.randrange(32, 127)), lambda: chr(r.randrange(0x80, 0x2FFF)), lambda: chr(r.choice([0x20, 0x20, 0xA, 0xD, 0x85, 0xA0, 0x3000, 0x1C])),
             lambda: r.choice(["'s", "'ll", " it", "The", "123", "١٢", "가나", "é", "🙂", "‍", "\x00"]), lambda: chr(r.randrange(0x10000, 0x1F900))]
    return "".join(r.choice(kinds)() for _ in range(r.randrange(0, 120)))


def check_bpe(spark, plain, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    found = bpe.decode(bpe.encode(df, RANK_FILE, **options), RANK_FILE).collect()
    expected = [(i, plain.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((x["doc_id"], x["ids"], bytes(x["decoded"])) for x in found), key=key) == sorted(expected, key=key)
    assert all(bytes(x["packed"]) == np.array(x["ids"], "<u4").tobytes() for x in found)


def test_encode_decode(spark, plain):
    r = random.Random(2)
    rows = [(i, random_text(r), "x") for i in range(300)]
    rows += [(300, None, None), (301, "", "x"), (302, " ", "x"), (303, "a" * 30_000, "x"), (304, "word " * 60_000, "x"), (None, "no id", "x"), (None, "no id", "x")]
    rows += [(5, "repeated id", "x"), (305, "<|endoftext|>", "x")] + [(306 + i, "the same text again", "x") for i in range(50)]
    check_bpe(spark, plain, rows)
    check_bpe(spark, plain, rows, block_bytes=500)  # many blocks, long texts as blocks of their own


def test_all_code_points_split_alike(plain):
    """Every code point beside letters, digits, signs and blanks: ids of the pieces are those of the whole text."""
    for c in (chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000):
        for text in (f"{c}'ll", f"!{c}!'ll a{c}b 1{c}2 {c}{c} "):
            pieces = [i for p in bpe.split(text) for i in plain._core_bpe.encode_single_piece(p.encode())]
            assert pieces == plain.encode_ordinary(text), hex(ord(c))


def test_empty_table_and_no_words(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert bpe.decode(bpe.encode(empty, RANK_FILE), RANK_FILE).collect() == []
    blank = spark.createDataFrame([("a", None), ("b", "")], "doc_id string, text string")
    found = bpe.decode(bpe.encode(blank, RANK_FILE), RANK_FILE).collect()
    assert sorted((x["doc_id"], x["ids"], bytes(x["decoded"]), bytes(x["packed"])) for x in found) == [("a", [], b"", b""), ("b", [], b"", b"")]


def test_unknown_id(spark):
    with pytest.raises(Exception, match="token table lacks"):
        bpe.decode(spark.createDataFrame([(1, [60_000])], "doc_id long, ids array<int>"), RANK_FILE).collect()
    nulls = bpe.decode(spark.createDataFrame([(1, None), (2, [0, 1])], "doc_id long, ids array<int>"), RANK_FILE).orderBy("doc_id").collect()
    assert [bytes(x["decoded"]) for x in nulls] == [b"", b'!"']


def test_query_against_library(spark, plain):
    sf = "/root/testdata/sf0.001"
    found = {x["doc_id"]: tuple(x)[1:] for x in queries.op13(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs)
    for doc_id, text in docs:
        ids = plain.encode_ordinary(text or "")
        digests = (hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        assert found[doc_id] == (len(ids), *digests)


# --- source divergence ----------------------------------------------------------------------------

def audit_plain(rows, min_docs):
    words = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(text or ""))) for lang, source, text in rows]
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in words:
        groups[lang].add(source)
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
        counts[lang, None].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        share = {}
        for s in [*sources, None]:
            total = sum(counts[lang, s][t] for t in kept) + 2 * len(kept)
            share[s] = {t: 1 + 10**9 * (counts[lang, s][t] + 2) // total for t in kept}
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pair = [(sum(gap(share[s][t], share[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(gap(share[s][t], share[None][t]), t) for t in kept if counts[lang, s][t] and share[s][t] > share[None][t]]
            for part, items, most in (("pair", pair, None), ("term", term, 10)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def check_audit(spark, rows, min_docs):
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("n", F.lit(1)).withColumn("term", F.lit("t"))
    got = divergence.audit(df.repartition(4), min_docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == audit_plain(rows, min_docs)


def test_audit(spark):
    r = random.Random(3)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["été", "ÉTÉ", "𝔘", "￿", "Straße"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]

    def text(n):
        return " ".join(w.upper() if r.random() < 0.1 else w for w in r.choices(vocabulary, weights, k=n))

    rows = [(r.choice(["en", "en", "de", None, ""]), r.choice(["a", "b", "c", None, "", "é", "\U0001f642"]), text(r.randrange(0, 60))) for _ in range(400)]
    rows += [("en", "hot", text(20_000))] + [("en", "hot", "same words here")] * 300  # a very long text, repeated rows
    rows += [("few", "a", "one two"), ("few", "b", None), ("few", "c", ""), ("alone", "a", "x " * 30), (None, None, None)]
    check_audit(spark, rows, 10)
    check_audit(spark, rows, 1)


def test_audit_many_sources(spark):
    r = random.Random(4)
    rows = [("en", f"s{i % 140}", " ".join(f"t{chr(97 + r.randrange(26))}" * r.randrange(1, 3) for _ in range(r.randrange(0, 40)))) for i in range(500)]
    check_audit(spark, rows, 3)  # more sources than a block of them


def test_audit_empty(spark):
    check_audit(spark, [], 10)
    check_audit(spark, [("en", "a", "x y"), ("en", "b", "")], 10)  # no kept terms: pairs of value 0


def test_shares_beyond_64_bits():
    counts = np.array([0, 10**12, 123_456_789_012_345])
    assert divergence._share(counts, np.int64(10**15 + 7)).tolist() == [1 + 10**9 * (c + 2) // (10**15 + 7) for c in counts.tolist()]


def test_counts_do_not_depend_on_flushes(monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": ["a", "a", "b"] * 9, "source": ["x", "y", "x"] * 9, "text": ["One two two", None, "two three"] * 9})

    def summed():
        total = Counter()
        for b in divergence._count(iter([batch, batch.slice(3, 5)])):
            for x in b.to_pylist():
                total[x["lang"], x["source"], x["term"]] += complex(x["n"], x["docs"])
        return total

    whole = summed()
    monkeypatch.setattr(divergence, "ENTRIES", 1)
    assert whole == summed() and whole["a", "x", "two"] == complex(22, 11)


# --- hard negatives -------------------------------------------------------------------------------

def negatives_plain(rows, anchors, positives=5, negatives=3, low=Fraction(1, 2), high=Fraction(19, 20)):
    rows = [(i, label, v) for i, label, v in rows if i is not None and label is not None and v is not None and None not in v]
    sizes = defaultdict(list)
    for row in rows:
        sizes[len(row[2])].append(row)
    out = []
    for mine in sizes.values():
        ids, labels = np.array([x[0] for x in mine]), np.array([x[1] for x in mine])
        vectors = np.array([x[2] for x in mine], np.int64).reshape(len(mine), -1).clip(-(2**25), 2**25)
        for a in [k for k, x in enumerate(mine) if anchors(x[0])]:
            score = vectors @ vectors[a]
            order = np.lexsort((ids, -score))
            for p in [k for k in order if labels[k] == labels[a] and k != a][:positives]:
                fit = [k for k in order if labels[k] != labels[a] and low * int(score[p]) <= int(score[k]) <= high * int(score[p])][:negatives]
                out += [(ids[a], ids[p], i, ids[k], score[p], score[k]) for i, k in enumerate(fit, 1)]
    return sorted(tuple(map(int, x)) for x in out)


def check_negatives(spark, rows, every=50):
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<long>").withColumn("rows", F.lit(1)).withColumn("size", F.lit(2))
    got = hard_negatives.mine(df.repartition(3), F.col("vec_id") % every == 0)
    expected = negatives_plain(rows, lambda i: i % every == 0)
    assert sorted(map(tuple, got.collect())) == expected
    return expected


def clustered(n, dim, groups, seed=5, spread=20):
    g = np.random.default_rng(seed)
    centre = g.normal(size=(groups, dim)) * 100
    return (centre[g.integers(0, groups, n)] + g.normal(size=(n, dim)) * spread).astype(np.int64).tolist()


def test_negatives_small(spark):
    r = random.Random(6)
    rows = [(i, r.randrange(4), v) for i, v in enumerate(clustered(700, 6, 8))]
    rows += [(None, 1, [1] * 6), (800, None, [1] * 6), (850, 1, None), (900, 1, [1, None, 1, 1, 1, 1]), (950, 1, []), (951, 2, []), (1000, 2, [5, 5]), (1001, 2, [4, 4]), (1002, 3, [3, 3])]
    rows += [(2000 + i, i % 3, [7, 7, 7, 7, 7, 7]) for i in range(120)]  # one large group of copies
    rows += [(2050, 1, [7, 7, 7, 7, 7, 7])] * 2 + [(2100, 0, [0] * 6), (3000, 9, [1] * 6), (3050, 1, [2**40, -(2**33), 3, 2, 1, 0])]
    assert check_negatives(spark, rows)
    assert check_negatives(spark, rows, every=1)


def test_negatives_ties(spark):
    r = random.Random(7)
    assert check_negatives(spark, [(i, r.randrange(3), [r.randrange(0, 3) for _ in range(4)]) for i in range(500)], every=10)


@pytest.mark.parametrize("spread", [5, 200])
def test_negatives_many_slabs(spark, spread):
    """Several slabs; one label has half of the rows."""
    r = random.Random(8)
    rows = [(i, r.choice([0, 0, 0, r.randrange(6)]), v) for i, v in enumerate(clustered(20_000, 5, 30, spread=spread))]
    assert check_negatives(spark, rows, every=200)


def test_negatives_without_partners(spark):
    check_negatives(spark, [])
    check_negatives(spark, [(0, 1, [1, 2]), (50, 1, [2, 1])])  # no other label
    check_negatives(spark, [(0, 1, [1, 2]), (50, 2, [2, 1])])  # no positive
    check_negatives(spark, [(1, 1, [1, 2]), (2, 2, [2, 1])])  # no anchor


def test_nodes_are_pruned():
    """Far boxes are passed over: of tight clusters a search compares few leaves."""
    import pyarrow as pa

    vectors = np.array(clustered(4096, 4, 64, spread=1))
    n = len(vectors)
    batch = pa.RecordBatch.from_pydict(
        {"vec_id": np.arange(n), "label": np.zeros(n, np.int64), "vector": pa.array(vectors.tolist(), pa.list_(pa.int64())), "anchor": np.arange(n) % 100 == 0, "size": np.full(n, 4)}
    )
    from unittest import mock

    class Here:
        partitionId = staticmethod(lambda: 0)

    with mock.patch("pyspark.TaskContext.get", lambda: Here):
        (slab,) = [b.to_pylist()[0] for b in hard_negatives._pack(iter([batch]))]
    (block,) = [b.to_pylist()[0] for b in hard_negatives._anchor_blocks([pa.RecordBatch.from_pylist([slab])])]
    search, compared = hard_negatives._Search(block, 5, True), []
    visit = search.visit
    search.visit = lambda rows, ids, labels, vectors, who: (compared.append(len(who) * len(rows)), visit(rows, ids, labels, vectors, who))
    search.run(slab)
    assert sum(compared) < 0.35 * n * len(search.rows)
    ids = np.frombuffer(slab["ids"], np.int64)
    for q in (0, 7):
        score = vectors @ vectors[search.ids[q]]
        order = [k for k in np.lexsort((np.arange(n), -score)) if k != search.ids[q]][:5]
        assert search.id[q, 0].tolist() == order and len(ids) == n
