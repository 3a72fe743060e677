"""Masked-LM rows (T11-T16): sentence shuffle, head-or-tail truncation, masking, padding.

Each step is a projection over array columns; every random choice is a hash of
``(seed, epoch, key, position)``, so an epoch is regenerated by changing ``epoch`` and any row
can be rebuilt alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textprep.functions.hashing import hash_hex, uniform
from textprep.operators.tokens import IGNORE_LABEL, MASK_ID, PAD_ID, pad_right


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def shuffle_sentences(toks, key, seed: int = 42, epoch: int = 0) -> Column:
    """The sentences of a row in a seeded order, flattened into one id list."""
    tagged = F.transform(
        _c(toks), lambda s, i: F.struct(hash_hex(seed, F.lit("shuf"), epoch, _c(key), i).alias("h"), i.alias("i"), s.alias("s"))
    )
    return F.flatten(F.transform(F.array_sort(tagged), lambda x: x["s"]))


def truncate_head_or_tail(ids, key, max_len: int, seed: int = 42, epoch: int = 0) -> Column:
    """Longer than ``max_len`` -> keep the head or the tail, each with probability 1/2."""
    t = _c(ids)
    head = uniform(seed, F.lit("trunc"), epoch, _c(key)) < 0.5
    return F.when(F.size(t) <= max_len, t).when(head, F.slice(t, 1, max_len)).otherwise(F.slice(t, -max_len, max_len))


def _with_draws(ids, name: str, key, seed: int, epoch: int) -> Column:
    """Each id with its position and its draw, a digest each; what reads the draw several times reads this value."""
    return F.transform(_c(ids), lambda x, i: F.struct(x.alias("x"), i.alias("i"), uniform(seed, F.lit(name), epoch, _c(key), i).alias("u")))


def uniform_mask(ids, key, p: float = 0.15, mask_id: int = MASK_ID, seed: int = 42, epoch: int = 0, ignore: int = IGNORE_LABEL):
    """Each position independently with probability ``p`` becomes ``mask_id``; the label is
    the original id there and ``ignore`` elsewhere.  Returns (ids, labels)."""
    drawn = _with_draws(ids, "mask", key, seed, epoch)
    both = F.transform(drawn, lambda d: F.when(d["u"] < p, F.struct(F.lit(mask_id).alias("id"), d["x"].alias("label"))).otherwise(
        F.struct(d["x"].alias("id"), F.lit(ignore).alias("label"))))
    return both["id"], both["label"]


def bert_mask(ids, key, vocab_size: int, n_special: int = 5, p: float = 0.15, mask_id: int = MASK_ID,
              seed: int = 42, epoch: int = 0, ignore: int = -1, inference_mode: bool = False):
    """BERT 80/10/10 masking.  A position is chosen with probability ``p``; of those 80 %
    become ``mask_id``, 10 % a random non-special id different from the current one, 10 % stay.
    The label is the original id at chosen positions and ``ignore`` elsewhere.

    The random id is drawn over the other eligible ids directly (no rejection loop): ``k`` over
    ``n - 1`` slots, shifted by one at or above the current id.  Every position has one draw; the few that
    take a random id have a second."""
    t = _c(ids)
    if inference_mode:
        return t, F.transform(t, lambda x: F.lit(ignore))
    n_elig = vocab_size - n_special

    def rand_id(x, i):
        # the draw is one element's list, so that it is made once however often it is read
        slot = F.transform(F.array(uniform(seed, F.lit("rand"), epoch, _c(key), i)), lambda u2: F.when(
            x >= n_special, F.floor(u2 * (n_elig - 1)).cast("int") + n_special + (F.floor(u2 * (n_elig - 1)).cast("int") + n_special >= x).cast("int")
        ).otherwise(F.floor(u2 * n_elig).cast("int") + n_special))
        return slot[0]

    def one(d):
        new = F.when(d["u"] / p < 0.8, F.lit(mask_id)).when(d["u"] / p < 0.9, rand_id(d["x"], d["i"])).otherwise(d["x"])
        return F.when(d["u"] >= p, F.struct(d["x"].alias("id"), F.lit(ignore).alias("label"))).otherwise(F.struct(new.alias("id"), d["x"].alias("label")))

    both = F.transform(_with_draws(t, "bert", key, seed, epoch), one)
    return both["id"], both["label"]


def mlm_rows(df: DataFrame, key_col: str, toks_col: str = "toks", label_col: str = "label", max_len: int = 64,
             seed: int = 42, epoch: int = 0, mask: bool = True, p: float = 0.15, mask_id: int = MASK_ID) -> DataFrame:
    """``(input_ids, attention_mask, cls_labels, labels)`` = T11 -> T12 -> T14 -> T13.
    ``mask=False`` leaves the ids and labels every token (the reference's non-training mode)."""
    flat = shuffle_sentences(toks_col, key_col, seed, epoch)
    d = df.select(key_col, F.col(label_col).alias("cls_labels"), truncate_head_or_tail(flat, key_col, max_len, seed, epoch).alias("input_ids"))
    if mask:
        ids, labels = uniform_mask("input_ids", key_col, p, mask_id, seed, epoch)
        d = d.select(key_col, "cls_labels", ids.alias("input_ids"), labels.alias("labels"))
    else:
        d = d.withColumn("labels", F.col("input_ids"))
    return pad_right(d, "input_ids", max_len, PAD_ID, "attention_mask", "labels", IGNORE_LABEL)
