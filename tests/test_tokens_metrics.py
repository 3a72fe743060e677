"""Token operators, masking rates, and metrics against direct computations."""

import math

import numpy as np
from pyspark.sql import functions as F

from textprep.operators import features as E
from textprep.operators import metrics as M
from textprep.operators import mlm as LM
from textprep.operators import tokens as TK


def corpus(spark):
    texts = ["the cat sat", "the dog sat down", "a cat and the dog", ""]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_build_vocab_order(spark):
    v = {r["token"]: r["id"] for r in TK.build_vocab(corpus(spark), "text").collect()}
    assert [v[s] for s in TK.SPECIALS] == [0, 1, 2, 3, 4]
    # the (3), cat/dog/sat (2, by word), a/and/down (1, by word)
    assert v["the"] == 5 and (v["cat"], v["dog"], v["sat"]) == (6, 7, 8) and (v["a"], v["and"], v["down"]) == (9, 10, 11)


def test_lookup_unknown_and_hybrid_path(spark):
    v = TK.build_vocab(corpus(spark), "text")
    toks = spark.createDataFrame([(0, "the"), (1, "zebra"), (2, "down")], "p int, token string")
    small = {r["p"]: r["id"] for r in TK.lookup_ids(toks, v).collect()}
    hybrid = {r["p"]: r["id"] for r in TK.lookup_ids(toks, v, max_bytes=0).collect()}
    assert small == hybrid == {0: 5, 1: TK.UNK_ID, 2: 11}


def test_encode_pads_truncates_specials(spark):
    v = TK.build_vocab(corpus(spark), "text")
    enc = {r["doc_id"]: (r["input_ids"], r["attention_mask"]) for r in
           TK.encode_corpus(corpus(spark), v, ["doc_id"], "text", max_len=5, add_special_tokens=True).collect()}
    assert enc[0] == ([2, 5, 6, 8, 3], [1, 1, 1, 1, 1])
    assert enc[1] == ([2, 5, 7, 8, 3], [1, 1, 1, 1, 1])  # truncated to 3 words + specials
    assert enc[3] == ([2, 3, 0, 0, 0], [1, 1, 0, 0, 0])


def test_specials_masks_types(spark):
    d = spark.createDataFrame([([7, 8], [9])], "a array<int>, b array<int>")
    r = d.select(TK.with_specials("a", "b").alias("p"), TK.special_tokens_mask("a", "b").alias("m"),
                 TK.token_type_ids("a", "b").alias("t"),
                 TK.special_tokens_mask(TK.with_specials("a", "b"), already_has_special_tokens=True).alias("s")).first()
    assert r["p"] == [2, 7, 8, 3, 9, 3]
    assert r["m"] == [1, 0, 0, 1, 0, 1]
    assert r["t"] == [0, 0, 0, 0, 1, 1]
    assert r["s"] == [1, 0, 0, 1, 0, 1]


def test_bert_mask_rates(spark):
    n = 400
    d = spark.range(n).select(F.col("id").alias("k"), F.sequence(F.lit(5), F.lit(504)).alias("t"))
    ids, labels = LM.bert_mask("t", "k", vocab_size=1000)
    rows = d.select("t", ids.alias("m"), labels.alias("l")).collect()
    chosen = masked = rand = same = 0
    for r in rows:
        for x, m, lab in zip(r["t"], r["m"], r["l"]):
            if lab != -1:
                chosen += 1
                assert lab == x
                if m == TK.MASK_ID:
                    masked += 1
                elif m == x:
                    same += 1
                else:
                    rand += 1
                    assert 5 <= m < 1000
            else:
                assert m == x
    total = n * 500
    assert abs(chosen / total - 0.15) < 0.01
    assert abs(masked / chosen - 0.8) < 0.02 and abs(rand / chosen - 0.1) < 0.02 and abs(same / chosen - 0.1) < 0.02


def test_mlm_rows_shapes(spark):
    d = spark.createDataFrame([(1, 3, [[5, 6, 7], [8], [9, 10]])], "k long, label int, toks array<array<int>>")
    r = LM.mlm_rows(d, "k", "toks", "label", max_len=8).first()
    assert len(r["input_ids"]) == len(r["labels"]) == len(r["attention_mask"]) == 8
    assert r["attention_mask"] == [1] * 6 + [0, 0] and r["labels"][6:] == [-100, -100]
    flat = LM.shuffle_sentences("toks", "k")
    assert sorted(d.select(flat.alias("f")).first()["f"]) == [5, 6, 7, 8, 9, 10]


def _preds(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(size=(300, 4))
    y = rng.integers(0, 4, size=300)
    rows = [(i, int(y[i]), [float(x) for x in z[i]]) for i in range(300)]
    df = spark.createDataFrame(rows, "key long, label int, logits array<double>").withColumn("pred", M.argmax("logits"))
    return df, z, y


def test_report_and_losses_match_direct(spark):
    df, z, y = _preds(spark)
    p = z.argmax(1)
    rep = {r["row"]: r for r in M.classification_report(M.confusion(df)).collect()}
    f1s = []
    for c in range(4):
        tp = int(((p == c) & (y == c)).sum()); fp = int(((p == c) & (y != c)).sum()); fn = int(((p != c) & (y == c)).sum())
        prec = tp / (tp + fp) if tp + fp else 0.0
        rec = tp / (tp + fn) if tp + fn else 0.0
        f1 = 2 * prec * rec / (prec + rec) if prec + rec else 0.0
        f1s.append(f1)
        assert math.isclose(rep[str(c)]["precision"], prec) and math.isclose(rep[str(c)]["f1"], f1)
    assert math.isclose(rep["macro avg"]["f1"], sum(f1s) / 4)
    assert math.isclose(rep["accuracy"]["f1"], float((p == y).mean()))
    ce = np.log(np.exp(z).sum(1)) - z[np.arange(300), y]
    assert math.isclose(M.cross_entropy(df).first()["loss"], ce.mean(), rel_tol=1e-9)
    sm = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    oh = np.eye(4)[y]
    tp = (oh * sm).sum(0); fp = ((1 - oh) * sm).sum(0); fn = (oh * (1 - sm)).sum(0)
    pr = tp / (tp + fp + 1e-7); rc = tp / (tp + fn + 1e-7)
    f1 = np.clip(2 * pr * rc / (pr + rc + 1e-7), 1e-7, 1 - 1e-7)
    assert math.isclose(M.soft_f1_loss(df, 4).first()["loss"], 1 - f1.mean(), rel_tol=1e-9)


def test_pooling_and_padding(spark):
    d = spark.createDataFrame([(0, 1, [1.0, 4.0]), (0, 0, [3.0, 2.0]), (1, 0, [5.0, 5.0])], "index long, subix int, hs array<double>")
    docs = E.collect_chunks(d, "index", "subix", "hs", first_cols=())
    r = {x["index"]: x for x in docs.select("index", "hs", E.pool("hs", "mean").alias("m"), E.pool("hs", "max").alias("x")).collect()}
    assert r[0]["hs"] == [[3.0, 2.0], [1.0, 4.0]] and r[0]["m"] == [2.0, 3.0] and r[0]["x"] == [3.0, 4.0]
    p = {x["index"]: x["hs"] for x in E.pad_sequences(docs, 2).collect()}
    assert p[1] == [[5.0, 5.0], [0.0, 0.0]]


def test_pool_by_key_equals_collected(spark):
    d = spark.createDataFrame([(0, 1, [1.0, 4.0]), (0, 0, [3.0, 2.0]), (1, 0, [5.0, 5.0])], "index long, subix int, hs array<double>")
    agg = {r["index"]: (r["mean"], r["max"], r["sum"]) for r in E.pool_by_key(d, "index", "hs", ("mean", "max", "sum")).collect()}
    assert agg[0] == ([2.0, 3.0], [3.0, 4.0], [4.0, 6.0]) and agg[1] == ([5.0, 5.0], [5.0, 5.0], [5.0, 5.0])


def test_doc_features_join_form_equals_one_groupby(spark):
    """The reference joins per-document first values to the collected vectors; one groupBy
    gives the same rows."""
    d = spark.createDataFrame([(0, 1, 7, [1.0]), (0, 0, None, [3.0]), (1, 0, 2, [5.0])], "index long, subix int, label int, hs array<double>")
    one = {r["index"]: (r["label"], r["hs"]) for r in E.collect_chunks(d, "index", "subix", "hs", ("label",)).collect()}
    firsts = d.groupBy("index").agg(E.first_non_null("label", "subix").alias("label"))
    vecs = d.groupBy("index").agg(F.sort_array(F.collect_list(F.struct("subix", "hs"))).alias("v")).select("index", F.transform("v", lambda x: x["hs"]).alias("hs"))
    joined = {r["index"]: (r["label"], r["hs"]) for r in firsts.join(vecs, "index").collect()}
    assert one == joined == {0: (7, [[3.0], [1.0]]), 1: (2, [[5.0]])}


def test_masked_mean(spark):
    d = spark.createDataFrame([([[1.0, 1.0], [3.0, 5.0], [0.0, 0.0]], [1, 1, 0])], "hs array<array<double>>, m array<int>")
    assert d.select(E.masked_mean("hs", "m").alias("x")).first()["x"] == [2.0, 3.0]


def test_decode_out_of_range_is_null(spark):
    v = TK.build_vocab(corpus(spark), "text")
    ids = spark.createDataFrame([(0, 5), (1, 999)], "p int, id int")
    got = {r["p"]: r["token"] for r in TK.lookup_tokens(ids, v).collect()}
    assert got == {0: "the", 1: None}


def test_external_tokenizer_plugs_in(spark):
    """T1 with a user-supplied tokenizer (here a tiny word-level one built in the test)."""
    ids = {"the": 5, "cat": 6, "sat": 8}

    def tokenize(texts):
        return [[ids.get(w, TK.UNK_ID) for w in t.split()] for t in texts]

    enc = TK.encode_with(tokenize)
    out = {r["doc_id"]: r["ids"] for r in corpus(spark).select("doc_id", enc("text").alias("ids")).collect()}
    assert out[0] == [5, 6, 8] and out[3] == [] and out[1] == [5, TK.UNK_ID, 8, TK.UNK_ID]
