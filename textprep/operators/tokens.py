"""Vocabulary and token operators.

The reference's per-string tokenizer is re-aimed as corpus jobs.  Where the vocabulary is small in
bytes (checked), every task gets a copy and maps whole word arrays through it in Arrow batches, so
no token is shuffled.  Of a larger one the frequent part is copied; each row asks a join once for each of its
distinct other words, and the answers return to their row by place.  An external tokenizer plugs in through ``pandas_udf`` (:func:`encode_with`).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textprep.functions.text import clean_words, split_words
from textprep.operators.ranking import global_offsets, global_rank
from textprep.session import checkpointed

VOCAB_BYTES = 64 << 20  # of a vocabulary that every task may hold a copy of
HEAD_BYTES = 16 << 20  # of the frequent part that the tasks copy of a larger vocabulary
RANGES = 4096  # runs of ids among which that part's end is looked for
SALTS = 16  # copies of a larger vocabulary in a join

# ---------------------------------------------------------------------------------------------
# Special tokens of our corpus vocabulary, in id order (ids 0..4).
SPECIALS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"]
PAD_ID, UNK_ID, CLS_ID, SEP_ID, MASK_ID = 0, 1, 2, 3, 4
IGNORE_LABEL = -100  # masked-LM label of positions that are not predicted
# ---------------------------------------------------------------------------------------------

def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- T20 / S5 / S6 / T18: vocabularies ----------------------------------------------------------

def build_vocab(texts: DataFrame, text_col: str = "text", clean: bool = True, specials: Sequence[str] = SPECIALS,
                min_count: int = 1) -> DataFrame:
    """Corpus vocabulary ``(token, id, count)``: specials first, then words by
    ``(-count, word)``.  Counting is a partial aggregation; ids come from a distributed global
    rank (no single-partition window)."""
    words = texts.select(F.explode(clean_words(text_col) if clean else split_words(text_col)).alias("token"))
    counts = words.groupBy("token").agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") >= min_count)
    ranked = global_rank(counts, [F.col("count").desc(), F.col("token")], rank_col="_r")
    spark = texts.sparkSession
    sp = spark.createDataFrame([(s, i) for i, s in enumerate(specials)], "token string, id long").withColumn("count", F.lit(None).cast("long"))
    words_v = ranked.select("token", (F.col("_r") - 1 + len(specials)).cast("long").alias("id"), F.col("count").cast("long"))
    return sp.unionByName(words_v)


def load_vocab_lines(lines: DataFrame, line_no_col: str = "line_no", line_col: str = "line") -> DataFrame:
    """Vocabulary from the lines of a text file: ``id`` = line number from 0, token = the
    stripped line; a repeated token keeps its last id."""
    from textprep.functions.text import py_strip

    d = lines.select(py_strip(F.col(line_col)).alias("token"), F.col(line_no_col).alias("id"))
    return d.groupBy("token").agg(F.max("id").cast("long").alias("id"))


def doc_line_vocab(docs: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """S5 over documents in key order, as if they were one file: ``(token, id)``.  A token's last line
    is its largest (key, line in the document); only these winners meet the documents' line offsets,
    so the text is never shuffled."""
    from textprep.functions.text import py_strip

    lines = docs.select(key_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    last = lines.groupBy(py_strip(F.col("line")).alias("token")).agg(F.max(F.struct(key_col, "pos")).alias("last"))
    counts = docs.select(F.col(key_col).alias("_key"), F.size(F.split(text_col, "\n")).alias("_nl"))
    offsets = global_offsets(counts, ["_key"], "_nl", "_off").select("_key", "_off")
    found = last.join(offsets, F.col(f"last.{key_col}") == F.col("_key"))
    return found.select("token", (F.col("_off") + F.col("last.pos")).cast("long").alias("id"))


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """A vocabulary file, or the folder that :func:`write_vocab` makes, one token per line; files count
    in the order of their names, a file's last newline starts no line."""
    files = spark.read.text(path, wholetext=True).filter("value <> ''")
    return doc_line_vocab(files.select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", r"\n\z", "").alias("text")), "file", "text")


def vocab_gaps(vocab: DataFrame, id_col: str = "id") -> DataFrame:
    """S6 check: ids that do not follow the previous id + 1 in id order (the first id must be 0).
    Uses a distributed rank and an equi-join on rank - 1 instead of a global ``lag``."""
    r = global_rank(vocab.select(id_col).distinct(), [id_col], rank_col="_r")
    prev = r.select((F.col("_r") + 1).alias("_r"), F.col(id_col).alias("prev_id"))
    j = r.join(prev, "_r", "left")
    expected = F.coalesce(F.col("prev_id") + 1, F.lit(0))
    return j.filter(F.col(id_col) != expected).select(F.col(id_col).alias(id_col), "prev_id", expected.alias("expected"))


def write_vocab(vocab: DataFrame, path: str, id_col: str = "id") -> None:
    """One token per line, ordered by id (range partitions written in order)."""
    n = int(vocab.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    vocab.repartitionByRange(n, id_col).sortWithinPartitions(id_col).select("token").write.mode("overwrite").text(path)


def special_id(vocab: DataFrame, token: str = "[MASK]") -> int:
    """The id of a special token (one-row lookup)."""
    row = vocab.filter(F.col("token") == token).agg(F.max("id")).first()
    if row is None or row[0] is None:
        raise KeyError(token)
    return int(row[0])


# --- T5 / T6: lookups ---------------------------------------------------------------------------

def _bytes(side: DataFrame, token: str) -> int:
    return side.agg(F.sum(F.octet_length(token) + F.lit(24))).first()[0] or 0


def _salted_join(rows: DataFrame, side: DataFrame, row_key: str, side_key: str, small: bool) -> DataFrame:
    """Left equi-join with a vocabulary: broadcast if it is small; else on (key, salt), with the
    vocabulary copied once per salt, so the rows of one hot key go to several tasks."""
    if small:
        return rows.join(F.broadcast(side), rows[row_key] == side[side_key], "left")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    copies = side.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = (salted[row_key] == copies[side_key]) & (F.col("_salt") == F.col("_copy"))
    return salted.join(copies, on, "left").drop("_salt", "_copy")


def lookup_ids(tokens: DataFrame, vocab: DataFrame, token_col: str = "token", out_col: str = "id", unk_id: int = UNK_ID,
               max_bytes: int = VOCAB_BYTES) -> DataFrame:
    """T5: token -> id, unknown -> ``unk_id`` (left equi-join)."""
    side = vocab.select(F.col("token").alias("_tok"), F.col("id").alias("_vid"))
    joined = _salted_join(tokens, side, token_col, "_tok", _bytes(side, "_tok") <= max_bytes)
    return joined.withColumn(out_col, F.coalesce(F.col("_vid"), F.lit(unk_id)).cast("int")).drop("_tok", "_vid")


def lookup_tokens(ids: DataFrame, vocab: DataFrame, id_col: str = "id", out_col: str = "token", max_bytes: int = VOCAB_BYTES) -> DataFrame:
    """Id -> token; an id outside the vocabulary gives null (count them with
    ``filter(token is null)``)."""
    side = vocab.select(F.col("id").alias("_vid"), F.col("token").alias(out_col))
    if _bytes(side, out_col) <= max_bytes:
        return _salted_join(ids, side, id_col, "_vid", True).drop("_vid")
    # most ids are frequent ones, and those need no shuffle
    cut = _cutoff(vocab, min(max_bytes, HEAD_BYTES))
    frequent = F.coalesce(F.col(id_col) < cut, F.lit(False))
    head = _salted_join(ids.where(frequent), side.where(F.col("_vid") < cut), id_col, "_vid", True)
    return head.unionByName(_salted_join(ids.where(~frequent), side.where(F.col("_vid") >= cut), id_col, "_vid", False)).drop("_vid")


def _mapper(vocab: DataFrame, depth: int, unk_id: int) -> Callable[[Column], Column]:
    """Arrays of words (depth 1), or of arrays of words (depth 2), to ids, by a copy of the vocabulary."""
    import pyarrow as pa

    rows = vocab.select("token", F.col("id").cast("int").alias("id")).toPandas()
    tokens, ids = pa.array(rows["token"], pa.string()), np.append(rows["id"].to_numpy(np.int32), np.int32(unk_id))

    def find(words):
        import pyarrow.compute as pc

        offsets = []
        for _ in range(depth):
            n = np.asarray(pc.fill_null(pc.list_value_length(words), 0))
            offsets.append(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()))
            words = words.flatten()
        at = np.asarray(pc.fill_null(pc.index_in(words.cast(pa.string()), value_set=tokens), len(ids) - 1))
        out = pa.array(ids[at])
        for o in reversed(offsets):
            out = pa.ListArray.from_arrays(o, out)
        return out

    find.__annotations__ = {"words": pa.Array, "return": pa.Array}  # as objects: this module's own are strings
    return F.arrow_udf(find, T.ArrayType(T.IntegerType()) if depth == 1 else T.ArrayType(T.ArrayType(T.IntegerType())))


def _cutoff(vocab: DataFrame, max_bytes: int) -> int:
    """Tokens with an id below this one hold ``max_bytes`` at most: ids of a corpus vocabulary follow the counts, so they are its
    frequent tokens.  At most ``RANGES`` sums reach the driver."""
    low, high = vocab.agg(F.min("id"), F.max("id")).first()
    if low is None or max_bytes <= 0:
        return low or 0
    step = (high - low) // RANGES + 1
    run = F.call_function("div", F.col("id") - F.lit(low), F.lit(step)).alias("r")
    size, at = 0, low
    for r in vocab.groupBy(run).agg(F.sum(F.octet_length("token") + F.lit(24)).alias("b")).where("r IS NOT NULL").orderBy("r").collect():
        size += r["b"] or 0
        if size > max_bytes:
            break
        at = low + (r["r"] + 1) * step
    return at


def _coder(head: DataFrame, depth: int) -> Callable[[Column], Column]:
    """As :func:`_mapper` by a part of the vocabulary: ``ids``, where -1, -2, ... stand for the first, second, ... of ``rare``, the
    row's distinct words outside that part."""
    import pyarrow as pa

    rows = head.select("token", F.col("id").cast("int").alias("id")).toPandas()
    tokens, ids = pa.array(rows["token"], pa.string()), np.append(rows["id"].to_numpy(np.int32), np.int32(UNK_ID))

    def find(words):
        import pyarrow.compute as pc

        offsets = []
        for _ in range(depth):
            n = np.asarray(pc.fill_null(pc.list_value_length(words), 0))
            offsets.append(np.concatenate([[0], np.cumsum(n)]))
            words = words.flatten()
        words = words.cast(pa.string())
        found = pc.index_in(words, value_set=tokens)
        out = ids[np.asarray(pc.fill_null(found, len(ids) - 1))]
        ends = offsets[0]  # of the rows, in words
        for o in offsets[1:]:
            ends = o[ends]
        at = np.flatnonzero(np.asarray(pc.and_(pc.is_null(found), pc.is_valid(words))))
        terms = pc.dictionary_encode(words.take(pa.array(at)))
        row = np.searchsorted(ends, at, side="right") - 1
        code = np.asarray(terms.indices).astype(np.int64)
        pair, place = np.unique(row * max(len(terms.dictionary), 1) + code, return_inverse=True)
        starts = np.searchsorted(pair, np.arange(len(ends)) * max(len(terms.dictionary), 1))
        out[at] = -1 - (place - starts[row])
        rare = terms.dictionary.take(pa.array(pair % max(len(terms.dictionary), 1)))
        rare = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), rare)
        out = pa.array(out)
        for o in reversed(offsets):
            out = pa.ListArray.from_arrays(pa.array(o, pa.int32()), out)
        return pa.StructArray.from_arrays([out, rare], ["ids", "rare"])

    find.__annotations__ = {"words": pa.Array, "return": pa.Array}
    ids_type = "array<int>" if depth == 1 else "array<array<int>>"
    return F.arrow_udf(find, f"struct<ids: {ids_type}, rare: array<string>>")


def _ids_of_large(df: DataFrame, vocab: DataFrame, others: Sequence[str], words: Column, out_col: str, max_bytes: int, depth: int = 1) -> DataFrame:
    """``others`` and the ids of the words by a vocabulary too large to copy.  Every task maps the frequent words through a copy of
    their part; each row asks for its few distinct rare words in one join, and takes the answers by their place.  The coded rows are
    stored once under row numbers, so keys may repeat or be null, and neither text nor words are shuffled."""
    cut = _cutoff(vocab, min(max_bytes, HEAD_BYTES))
    known = F.coalesce((F.col("id") >= 0) & (F.col("id") < cut), F.lit(False))
    head, tail = vocab.where(known), vocab.where(~known)
    coded = df.select(*others, _coder(head, depth)(words).alias("_w"))
    coded = checkpointed(coded.select(*others, "_w.ids", "_w.rare", F.monotonically_increasing_id().alias("_row")).toDF(*others, "_ids", "_rare", "_row"))
    asked = coded.select("_row", F.posexplode("_rare").alias("_place", "token"))
    side = tail.groupBy(F.col("token").alias("_tok")).agg(F.min("id").cast("int").alias("_vid"))
    answers = asked.hint("merge").join(side, asked["token"] == side["_tok"], "left")  # the asked words look as small as their rows
    answers = answers.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_place", "_vid"))).alias("_answers"))
    rows = coded.select(*others, "_ids", F.size("_rare").alias("_asks"), "_row").join(answers, "_row", "left")

    def filled(ids):
        return F.transform(ids, lambda x: F.when(x >= 0, x).otherwise(F.coalesce(F.get("_answers", -1 - x)["_vid"], F.lit(UNK_ID))))

    ids = filled(F.col("_ids")) if depth == 1 else F.transform("_ids", filled)
    return rows.select(*others, F.when(F.col("_asks") > 0, ids).otherwise(F.col("_ids")).alias(out_col))


# --- T1: corpus encoding ------------------------------------------------------------------------

def encode_corpus(
    df: DataFrame,
    vocab: DataFrame,
    key_cols: Sequence[str],
    text_col: str = "data",
    max_len: int = 512,
    padding: bool = True,
    add_special_tokens: bool = False,
    max_bytes: int = VOCAB_BYTES,
    longest: int | None = None,
) -> DataFrame:
    """Text, or its words as an array -> ``input_ids``, ``attention_mask``.  Truncated to ``max_len`` (specials included),
    padded to the longest row of the whole frame, which follows from the word counts alone; a caller who knows the
    words of the longest row (:func:`textprep.operators.chunks.longest_chunk`) says so, and the frame is made once."""
    keys = list(key_cols)
    body = max_len - (2 if add_special_tokens else 0)
    is_text = isinstance(df.schema[text_col].dataType, T.StringType)
    words = split_words(F.coalesce(F.col(text_col), F.lit(""))) if is_text else F.coalesce(F.col(text_col), F.array().cast("array<string>"))
    words = F.slice(words, 1, body)
    other = [c for c in df.columns if c not in keys and c != text_col]
    if _bytes(vocab, "token") <= max_bytes:
        enc = df.withColumn("_ids", _mapper(vocab, 1, UNK_ID)(words))
    else:
        enc = _ids_of_large(df, vocab, [*keys, *other], words, "_ids", max_bytes)
    ids = with_specials("_ids") if add_special_tokens else F.col("_ids")
    enc = enc.select(*keys, *other, ids.alias("input_ids"))
    if not padding:
        return enc.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
    longest = (df.agg(F.max(F.size(words))).first()[0] or 0) if longest is None else min(longest, body)
    return pad_right(enc, "input_ids", longest + (max_len - body), PAD_ID)


def pad_right(df: DataFrame, col: str, length: int | Column, pad_value: int = PAD_ID, mask_col: str = "attention_mask",
              label_col: str | None = None, label_pad: int = IGNORE_LABEL) -> DataFrame:
    """Right-pad ``col`` (and optionally labels with ``label_pad``) to ``length`` (a number, or a
    column with each row's own); the mask is ones over the real tokens and zeros over the pads.  Of ids that
    are written as text already, pads and mask are text too, so that no pad is turned into text one by one."""
    n = F.size(col)
    k = F.greatest((length if isinstance(length, Column) else F.lit(length)) - n, F.lit(0))

    def repeated(like: str, value: int, times: Column) -> Column:
        text = isinstance(df.schema[like].dataType.elementType, T.StringType)
        return F.array_repeat(F.lit(str(value) if text else value), times)

    out = df.withColumn(mask_col, F.concat(repeated(col, 1, n), repeated(col, 0, k)))
    if label_col:
        out = out.withColumn(label_col, F.concat(F.col(label_col), repeated(label_col, label_pad, k)))
    return out.withColumn(col, F.concat(F.col(col), repeated(col, pad_value, k)))


def encode_with(tokenize: Callable[[list[str]], list[list[int]]]) -> Callable:
    """T1 with an external tokenizer: a ``pandas_udf`` text -> ids (Arrow batches)."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def enc(s: pd.Series) -> pd.Series:
        return pd.Series(tokenize(s.fillna("").tolist()))

    return enc


# --- T2: per-sentence encoding -------------------------------------------------------------------

def encode_sentences(df: DataFrame, vocab: DataFrame, key_col: str, sentences_col: str = "sents", max_bytes: int = VOCAB_BYTES,
                     cleaned: bool = False) -> DataFrame:
    """A list of sentences per row -> ``toks`` (ids per sentence), ``tok_lens``, ``tot_len``
    and ``ixs = 0..n-1``; no padding, truncation or specials.  ``cleaned`` as for :func:`split_words`."""
    sents = F.coalesce(F.col(sentences_col), F.array().cast("array<string>"))
    other = [c for c in df.columns if c not in (key_col, sentences_col)]
    if _bytes(vocab, "token") <= max_bytes:
        out = df.select(key_col, *other, _mapper(vocab, 2, UNK_ID)(F.transform(sents, lambda s: split_words(s, cleaned))).alias("toks"))
    else:
        out = _ids_of_large(df, vocab, [key_col, *other], F.transform(sents, lambda s: split_words(s, cleaned)), "toks", max_bytes, depth=2)
    out = out.withColumn("tok_lens", F.transform("toks", lambda t: F.size(t)))
    out = out.withColumn("tot_len", F.aggregate("tok_lens", F.lit(0), lambda a, x: a + x))
    out = out.withColumn("ixs", F.when(F.size("toks") > 0, F.sequence(F.lit(0), F.size("toks") - 1)).otherwise(F.array().cast("array<int>")))
    return out


# --- T7-T10: special tokens and strings -----------------------------------------------------------

def pieces_to_text(tokens) -> Column:
    """T7 (alias of the piece helper)."""
    from textprep.functions.text import pieces_to_string

    return pieces_to_string(tokens)


def with_specials(a, b=None, cls_id: int = CLS_ID, sep_id: int = SEP_ID) -> Column:
    """``[CLS] A [SEP]`` or ``[CLS] A [SEP] B [SEP]``."""
    parts = [F.array(F.lit(cls_id)), _c(a), F.array(F.lit(sep_id))]
    if b is not None:
        parts += [_c(b), F.array(F.lit(sep_id))]
    return F.concat(*parts)


def special_tokens_mask(a, b=None, already_has_special_tokens: bool = False, cls_id: int = CLS_ID, sep_id: int = SEP_ID) -> Column:
    """1 at special positions.  With ``already_has_special_tokens`` the ids are scanned for
    CLS / SEP (a second sequence is then an error)."""
    if already_has_special_tokens:
        if b is not None:
            raise ValueError("a second sequence cannot be given when the ids already hold special tokens")
        return F.transform(_c(a), lambda x: F.when(x.isin(sep_id, cls_id), 1).otherwise(0))
    parts = [F.array(F.lit(1)), F.array_repeat(F.lit(0), F.size(_c(a))), F.array(F.lit(1))]
    if b is not None:
        parts += [F.array_repeat(F.lit(0), F.size(_c(b))), F.array(F.lit(1))]
    return F.concat(*parts)


def token_type_ids(a, b=None) -> Column:
    """0 over ``[CLS] A [SEP]``, 1 over ``B [SEP]``."""
    first = F.array_repeat(F.lit(0), F.size(_c(a)) + 2)
    if b is None:
        return first
    return F.concat(first, F.array_repeat(F.lit(1), F.size(_c(b)) + 1))


def ids_string(c) -> Column:
    return F.array_join(_c(c).cast("array<string>"), " ")

