"""End-to-end compositions of the operators (the reference's three flows, §3 of the survey):

* :func:`prep_classifier_inputs` - records -> text -> folds -> chunks -> token ids (3.1);
* :func:`prep_mlm_inputs` - records -> cleaning -> survivors -> folds -> sentence tokens (3.3);
* :func:`evaluate_fold` - predictions of one fold -> report and macro metrics;
* :func:`submit` - document predictions -> prediction file (3.2).

Each returns lazy DataFrames; materialise with :func:`textprep.sources.io.with_cache` under a
key from :func:`textprep.sources.io.cache_key` over all parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textprep.functions.text import sentences
from textprep.operators import clean as C
from textprep.operators import metrics as M
from textprep.operators.chunks import explode_chunks
from textprep.operators.folds import cv_split, stratified_folds
from textprep.operators.tokens import encode_corpus, encode_sentences
from textprep.sources.io import write_submission


def prep_classifier_inputs(
    records: DataFrame, vocab: DataFrame, max_seq_len: int = 250, k: int = 5, seed: int = 42,
    include_keywords: bool = True, is_test: bool = False, max_tokens: int = 512,
) -> DataFrame:
    """P1-P3 + P12 -> F1 -> C2 -> T1: one row per chunk ``(index, subix, [label, cv,] input_ids,
    attention_mask)``."""
    d = C.prep_text(records, include_keywords=include_keywords, is_test=is_test)
    if not is_test:
        d = stratified_folds(d, "label", "index", k=k, seed=seed)
    ch = explode_chunks(d, max_seq_len, "data_cleaned", "index", cleaned=True)
    return encode_corpus(ch, vocab, ["index", "subix"], "data", max_len=max_tokens)


def prep_mlm_inputs(records: DataFrame, vocab: DataFrame, rules: C.CleanRules | None = None, k: int = 5, seed: int = 42) -> DataFrame:
    """P18 -> P19 -> F1 -> P14 -> T2: per record ``(index, label, cv, toks, tok_lens, tot_len, ixs)``."""
    cleaned = C.clean_records(records, rules)
    kept = C.survivors(records, cleaned)
    kept = stratified_folds(kept, "label", "index", k=k, seed=seed)
    s = kept.select("index", "label", "cv", sentences(C.TEXT_COLS).alias("sents"))
    return encode_sentences(s, vocab, "index", "sents")


def evaluate_fold(pred: DataFrame, fold: int | None = None, cv_col: str = "cv") -> tuple[DataFrame, DataFrame]:
    """(report, macro metrics) of the predictions, restricted to one validation fold."""
    if fold is not None:
        _, pred = cv_split(pred, fold, cv_col)
    conf = M.confusion(pred)
    return M.classification_report(conf), M.macro_metrics(conf)


def submit(doc_pred: DataFrame, path: str, key_col: str = "index") -> None:
    """Arg-max per document -> ``index,label`` file."""
    p = doc_pred
    if "pred" not in p.columns:
        p = p.withColumn("pred", M.argmax("logits"))
    write_submission(p.select(F.col(key_col).alias("index"), F.col("pred").alias("label")), path)
