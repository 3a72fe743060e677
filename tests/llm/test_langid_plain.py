"""Language identification against plain profiles and out-of-place sums."""

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from textprep.llm import langid, queries

SF = "/root/testdata/sf0.001"


def plain_profile(counts, top):
    return sorted(counts, key=lambda g: (-counts[g], len(g), g))[:top]


def plain_grams(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    points = [0] + [p for w in words for p in [*map(ord, w), 0]]
    found = Counter((p,) for p in points if p)
    found.update(zip(points, points[1:]))
    found.update(t for t in zip(points, points[1:], points[2:]) if t[1])
    return found if words else Counter()


def plain_predictions(rows, top=300):
    """rows: (doc_id, text, lang)."""
    counts = defaultdict(Counter)
    for doc_id, text, lang in rows:
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 and lang is not None and text is not None and plain_grams(text):
            counts[lang].update(plain_grams(text))
    profiles = {lang: {g: i for i, g in enumerate(plain_profile(c, top))} for lang, c in counts.items()}
    out = []
    for doc_id, text, _ in rows:
        own = plain_profile(plain_grams(text), top)
        far = {lang: sum(abs(p[g] - i) if g in p else top for i, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get) if far and own else None
        held = doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 0
        out.append((doc_id, held, best or "und", 1 - far[best] / (top * len(own)) if best else 0.0))
    return out


def check(got, rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3])
    got, expected = sorted(map(tuple, got), key=key), sorted(plain_predictions(rows), key=key)
    assert [r[:3] for r in got] == [r[:3] for r in expected]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in expected], abs=1e-12)


def test_query_against_plain_profiles(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    check(queries.op4(spark, SF).collect(), rows)


def test_odd_rows(spark):
    texts = [("the cat sat on the mat", "en"), ("der Hund und die Katze", "de"), ("le chat et le chien", "fr"), ("a", "en"), ("ÀÉ ß 漢字 kana", "xx"), (None, "en"), ("", "de"), ("123 !", "fr")]
    rows = [(i, *texts[i % len(texts)]) for i in range(40)] + [(7, "the the the", "en"), (7, "und und", None), (None, "the cat", "en"), (99, "the quick " * 30_000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("rank", F.lit(1)).withColumn("score", F.lit(2)).repartition(3)
    check(langid.identify(df).collect(), rows)
