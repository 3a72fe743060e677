"""Subword encoding against the model's own library, T4's repair on a vocabulary that needs it, odd rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textprep.functions.text import sentences, split_words
from textprep.operators import subwords as SW
from textprep.plans import q_subwords

spm = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return spm.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def vocab(spark):
    return SW.read_pieces(spark, PATH).cache()


@pytest.fixture(scope="module")
def cutter(vocab):
    return SW.Segmenter([tuple(r) for r in vocab.select("token", "id", "score", "kind").collect()])


def hangul(r):
    return "".join(chr(r.randrange(0xAC00, 0xD7A4)) for _ in range(r.randrange(1, 8)))


def test_words_against_library(library, cutter):
    r = random.Random(1)
    words = ["a", "", "x" * 3000, "ab" * 900, "1,234,", "don't", "Straße", "🙂🙂", "é", "é", "1" * 50] + [hangul(r) for _ in range(500)]
    words += ["".join(r.choice("abcdeinorst,.0123456789éß한국어") for _ in range(r.randrange(1, 25))) for _ in range(3000)]
    for w in words:
        assert cutter.ids(w) == (library.encode(w) if w else [library.piece_to_id("▁")]), w


def test_texts_against_library(spark, vocab, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    r = random.Random(2)
    own = [(-1, None), (-2, ""), (-3, "  \n "), (-4, "same same  same\tsame"), (-4, "repeated id"), (-5, "long " * 50_000)] + [(-10 - i, " ".join(hangul(r) for _ in range(9))) for i in range(50)]
    docs = docs.unionByName(spark.createDataFrame(own, docs.schema)).withColumn("input", F.lit(1))
    rows = SW.encode_subwords(docs, vocab).select("doc_id", split_words(F.coalesce("text", F.lit(""))).alias("w"), "input_ids").collect()
    assert len(rows) == docs.count()
    for x in rows:
        assert x["input_ids"] == library.encode(" ".join(x["w"]))
    cut = SW.encode_subwords(docs, vocab, max_len=7).select(F.max(F.size("input_ids"))).first()[0]
    assert cut == 7
    assert SW.encode_subwords(docs.limit(0), vocab).collect() == []


def test_counts_against_library(spark, vocab, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    expected = Counter(i for (t,) in docs.select("text").collect() for i in library.encode(" ".join((t or "").split())))
    found = {x["id"]: x["n"] for x in q_subwords.q_t20_subwords(spark, SF).collect()}
    assert len(found) == 32_000 and {i: n for i, n in found.items() if n} == dict(expected)


def test_sentences(spark, vocab, library):
    df = spark.createDataFrame([(1, "one two\n\nthree"), (2, None), (3, "\n \n")], "k int, text string").select("k", sentences(["text"], clean=False).alias("sents"))
    rows = {x["k"]: x for x in SW.encode_subword_sentences(df, vocab).collect()}
    assert rows[1]["toks"] == [library.encode("one two"), library.encode("three")]
    assert rows[1]["tok_lens"] == [len(t) for t in rows[1]["toks"]] and rows[1]["tot_len"] == sum(rows[1]["tok_lens"])
    assert rows[2]["toks"] == [] and rows[3]["toks"] == [] and rows[3]["tot_len"] == 0


def small(spark):
    tokens = ["▁", "1", "2", ",", "12", "12,", "▁12", "▁12,", "2,", "x", "▁x", "²", "²,"]
    rows = [("<unk>", 0, 0.0, "unknown")] + [(t, i + 1, -float(i), "normal") for i, t in enumerate(tokens)]
    return rows, spark.createDataFrame(rows, "token string, id int, score double, kind string")


def test_digit_comma_stem_is_cut_again(spark):
    rows, vocab = small(spark)
    cut = SW.Segmenter(rows)
    assert cut.cut("▁12,") == ["▁12,"] and cut.tokens("12,") == ["▁12", ","]  # marked stem
    assert SW.Segmenter(rows, repair=False).tokens("12,") == ["▁12,"]
    assert cut.tokens("x2,") == ["▁x", "2", ","]  # the mark that the second cut adds goes
    assert cut.tokens("x²,") == ["▁x", "²", ","]  # superscripts are digits
    assert cut.tokens("x12,") == ["▁x", "12", ","]
    assert cut.tokens("x,") == ["▁x", ","] and cut.tokens("1") == ["▁", "1"]
    assert cut.ids("y") == [1, 0]  # no byte pieces: the unknown piece
    ids = SW.encode_subwords(spark.createDataFrame([(1, "x12, y")], "k int, text string"), vocab).first()["input_ids"]
    assert ids == [11, 5, 4, 1, 0]


def test_limits(spark):
    rows, vocab = small(spark)
    with pytest.raises(ValueError, match="beyond"):
        SW.subword_ids(vocab, max_bytes=10)
    with pytest.raises(ValueError, match="cross"):
        SW.Segmenter([("a▁b", 0, 0.0, "normal")])


def test_decode_bytes(spark, vocab, library):
    texts = ["한국어 텍스트", "🙂 ok", "", "plain words"]
    df = spark.createDataFrame([(i, library.encode(t)) for i, t in enumerate(texts)] + [(9, None)], "k int, input_ids array<int>")
    found = {x["k"]: x["decoded"] for x in SW.decode_subwords(df, vocab).collect()}
    assert found == {**dict(enumerate(texts)), 9: None}


def test_plan_has_no_shuffle(spark, vocab):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    plan = SW.encode_subwords(docs, vocab)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" in plan
