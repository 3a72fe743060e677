"""The corpus pipeline against a plain version of every stage."""

import hashlib
import os
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from textprep.llm.common import stored

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_cut(text, gone):
    """``text`` without the words in ``gone``, each with the blanks after it."""
    out, i, n = [], 0, -1
    while i < len(text):
        j = i
        while j < len(text) and text[j] not in " \t\n\v\f\r":
            j += 1
        if j > i:
            n += 1
        k = j
        while k < len(text) and text[k] in " \t\n\v\f\r":
            k += 1
        if n < 0 or n not in gone:
            out.append(text[i:k])
        i = k
    return "".join(out)


def plain_mix(docs):
    size = {k: len(brute.blank_words(d["text"])) for k, d in docs.items()}
    sources = sorted({d["source"] for d in docs.values()}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(size[k] for k, d in docs.items() if d["source"] == s) for s in sources}
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    stopped = set()
    while True:
        free = [s for s in sources if s not in stopped]
        level = (sum(total.values()) - sum(3 * total[s] for s in stopped)) / sum(weight[s] for s in free)
        more = {s for s in free if 3 * total[s] < level * weight[s]}
        if not more:
            break
        stopped |= more
    out = Counter()
    for k, d in docs.items():
        target = 3 * total[d["source"]] if d["source"] in stopped else level * weight[d["source"]]
        rate = min(3.0, target / total[d["source"]]) if total[d["source"]] else 0.0
        u = int(hashlib.md5(f"mix-1|{k}".encode()).hexdigest()[:13], 16) / (1 << 52)
        out[k] = int(rate) + (u < rate - int(rate))
    return Counter({k: n for k, n in out.items() if n})


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's rows by doc_id, each stage on the stored result of its predecessor."""
    docs, found = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        found.append(docs.collect())
        assert docs.columns == COLUMNS
    return found


def test_stages(spark, stages):
    docs = {r["doc_id"]: r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    docs = {k: d for k, d in docs.items() if any(c.isalpha() for c in d["text"] or "")}
    assert {r["doc_id"]: r.asDict() for r in stages[0]} == docs

    root, _ = brute.near_duplicates({k: d["text"] for k, d in docs.items()}, size=5)
    docs = {k: d for k, d in docs.items() if root[k] == k}
    assert {r["doc_id"]: r.asDict() for r in stages[1]} == docs

    first, kept = {}, {}
    for k in sorted(docs):
        w = brute.blank_words(docs[k]["text"])
        gone = set()
        for i in range(len(w) - 19):
            if first.setdefault(tuple(w[i : i + 20]), (k, i)) != (k, i):
                gone.update(range(i, i + 20))
        if gone and len(gone) < len(w):
            text = plain_cut(docs[k]["text"], gone)
            kept[k] = docs[k] | {"text": text, "n_chars": len(text)}
        elif not gone:
            kept[k] = docs[k]
    assert len(kept) > 50 and kept != docs
    docs = kept
    assert {r["doc_id"]: r.asDict() for r in stages[2]} == docs

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = {k: d for k, d in docs.items() if not brute.contamination(d["text"], items)[1]}
    assert {r["doc_id"]: r.asDict() for r in stages[3]} == docs

    assert Counter(r["doc_id"] for r in stages[4]) == plain_mix(docs)
    assert all(r.asDict() == docs[r["doc_id"]] for r in stages[4])


def test_run_is_its_stages(spark, stages):
    rows = lambda found: Counter(tuple(r) for r in found)
    assert rows(corpus_pipeline.run(spark, SF).collect()) == rows(stages[-1])


def test_odd_rows(spark):
    """Nulls, empty texts, repeated rows, extra columns of clashing names, and an empty table."""
    text = " ".join(f"word{i % 17} other{i}" for i in range(40))
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (None, text + " x", None, None, None), (2, None, "en", "a", 0), (3, "", "fr", None, 0), (4, "... 12", "en", "b", 6), (5, "short one", "en", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("rest", "doc", "class", "copies", "size", "removed", "n_words", "_bad", "team"):
        docs = docs.withColumn(c, F.lit("own"))
    for start in (docs, docs.where("false")):
        df = start
        for name, stage in corpus_pipeline.STAGES:
            df = stored(stage(spark, df, SF), f"odd-{name}")
            assert name == "mixing" or df.columns == docs.columns, name
        assert {r["doc_id"] for r in df.collect()} <= {1, 5, None}
        if start is docs:
            assert df.count() and all(r[c] == "own" for r in df.collect() for c in ("n_words", "copies", "_bad", "rest"))
