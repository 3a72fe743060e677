"""Subword vocabulary and encoding (T20, T1, T2, T4, T7 on pieces of a given vocabulary).

Pieces and their scores come from a piece model file whose path is a parameter; it becomes a vocabulary table
``(token, id, score, kind)``.  Words are cut by the best-scored merges: a word, led by the word-start
mark, starts as characters; of all neighbours whose join is a piece those with the highest score (of equal ones the leftmost)
are joined until none is left.  What is no piece becomes its UTF-8 bytes, or the unknown piece.  No piece crosses a word's start, so
words are independent: of an Arrow batch each distinct word is cut once, what a worker has cut it keeps (up to a limit), and
the ids are laid back over the rows without a shuffle.  Counting pieces works on the table of distinct words instead.

The vocabulary is bounded by its file and its bytes are checked before every task gets a copy.  Tokenizers are not trained here."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textprep.functions.text import PIECE_MARK, by_rows, split_words

VOCAB_BYTES = 64 << 20  # of a vocabulary that every task may hold a copy of
KEPT_WORDS = 500_000  # words whose pieces a worker keeps
NORMAL, UNKNOWN, CONTROL, BYTE = "normal", "unknown", "control", "byte"


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """S5 of a piece model file: ``(token, id, score, kind)``; ids are the places in the file."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = ((m.is_unknown, UNKNOWN), (m.is_control, CONTROL), (m.is_byte, BYTE))
    rows = [(m.id_to_piece(i), i, float(m.get_score(i)), next((k for test, k in kinds if test(i)), NORMAL)) for i in range(m.get_piece_size())]
    return spark.createDataFrame(rows, "token string, id int, score double, kind string")


class Segmenter:
    """Cuts words into pieces of a vocabulary given as rows ``(token, id, score, kind)``."""

    def __init__(self, rows: Sequence[tuple[str, int, float, str]], repair: bool = True):
        self.pieces = {token: (-score, i) for token, i, score, kind in rows if kind == NORMAL}
        self.bytes = {int(token[3:-1], 16): i for token, i, _, kind in rows if kind == BYTE}
        self.unknown = next((i for _, i, _, kind in rows if kind == UNKNOWN), None)
        self.repair = repair
        self.kept: dict[str, list[int]] = {}
        crossing = [t for t in self.pieces if PIECE_MARK in t.lstrip(PIECE_MARK)]
        if crossing:
            raise ValueError(f"pieces cross a word's start: {crossing[:3]}")

    def cut(self, word: str) -> list[str]:
        """Pieces of a marked word.  Parts form a linked list, possible joins a heap: n log n for a word of n characters."""
        pieces, n = self.pieces, len(word)
        end, left = list(range(1, n + 1)), list(range(-1, n))
        joins = [(pieces[p][0], i, i + 2) for i in range(n - 1) if (p := word[i : i + 2]) in pieces]
        heapq.heapify(joins)
        while joins:
            _, i, stop = heapq.heappop(joins)
            mid = end[i]
            if mid <= 0 or mid >= n or end[mid] != stop:
                continue  # a part has been joined since
            end[i], end[mid] = stop, 0
            if stop < n:
                left[stop] = i
                if (p := word[i : end[stop]]) in pieces:
                    heapq.heappush(joins, (pieces[p][0], i, end[stop]))
            if (before := left[i]) >= 0 and (p := word[before:stop]) in pieces:
                heapq.heappush(joins, (pieces[p][0], before, stop))
        out, i = [], 0
        while i < n:
            out.append(word[i : end[i]])
            i = end[i]
        return out

    def repaired(self, pieces: list[str]) -> list[str]:
        """T4: a piece that ends in a comma after a digit is cut anew without it, as the start of a text; a mark that
        this adds goes again, and the comma becomes a piece of its own."""
        out = []
        for piece in pieces:
            if len(piece) > 1 and piece[-1] == "," and piece[-2].isdigit():
                stem = self.cut(PIECE_MARK + piece[:-1].replace(PIECE_MARK, ""))
                if piece[0] != PIECE_MARK:
                    stem = [stem[0][1:], *stem[1:]] if len(stem[0]) > 1 else stem[1:]
                out += [*stem, ","]
            else:
                out.append(piece)
        return out

    def tokens(self, word: str) -> list[str]:
        pieces = self.cut(PIECE_MARK + word)
        return self.repaired(pieces) if self.repair else pieces

    def ids(self, word: str) -> list[int]:
        """Ids of a word's pieces (kept)."""
        found = self.kept.get(word)
        if found is None:
            found = []
            for piece in self.tokens(word):
                if piece in self.pieces:
                    found.append(self.pieces[piece][1])
                elif self.bytes:
                    found += [self.bytes[b] for b in piece.encode()]
                else:
                    found.append(self.unknown)
            if len(self.kept) >= KEPT_WORDS:
                self.kept.clear()
            self.kept[word] = found
        return found


_OWN: dict[str, Segmenter] = {}  # of a worker process: one at a time


def _segmenter(shared, repair: bool) -> Segmenter:
    key, rows = shared.value
    key = f"{key}-{repair}"
    if key not in _OWN:
        _OWN.clear()
        _OWN[key] = Segmenter(rows, repair)
    return _OWN[key]


def _shared(vocab: DataFrame, max_bytes: int):
    """The vocabulary as a broadcast, after its bytes are counted."""
    import uuid

    vocab = vocab.select("token", F.col("id").cast("int"), F.col("score").cast("double"), "kind")
    size = vocab.agg(F.sum(F.octet_length("token") + F.lit(32))).first()[0] or 0
    if size > max_bytes:
        raise ValueError(f"a piece vocabulary of {size} bytes is beyond {max_bytes}")
    return vocab.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [tuple(r) for r in vocab.collect()]))


def subword_ids(vocab: DataFrame, repair: bool = True, max_bytes: int = VOCAB_BYTES):
    """A function from a column of words (an array of strings, or an array of such arrays) to ids."""
    import pyarrow as pa

    shared = _shared(vocab, max_bytes)

    def find(words):
        return by_rows(find_run, words)

    def find_run(words):
        import pyarrow.compute as pc

        def offsets(lists):
            n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            return np.concatenate([[0], np.cumsum(n)])

        outer = []
        while pa.types.is_list(words.type) or pa.types.is_large_list(words.type):
            outer.append(offsets(words))
            words = words.flatten()
        cutter, distinct = _segmenter(shared, repair), words.fill_null("").dictionary_encode()
        found = [cutter.ids(w) for w in distinct.dictionary.to_pylist()]
        size = np.array([len(x) for x in found], np.int64)
        flat, start = np.array([i for x in found for i in x], np.int32), np.concatenate([[0], np.cumsum(size)])
        code = distinct.indices.to_numpy()
        to = np.concatenate([[0], np.cumsum(size[code])])
        ids = flat[np.repeat(start[code] - to[:-1], size[code]) + np.arange(to[-1])]
        out = pa.ListArray.from_arrays(pa.array(to[outer[-1]], pa.int32()), pa.array(ids, pa.int32()))
        for o in reversed(outer[:-1]):
            out = pa.ListArray.from_arrays(pa.array(o, pa.int32()), out)
        return out

    find.__annotations__ = {"words": pa.Array, "return": pa.Array}  # as objects: this module's own are strings
    one = T.ArrayType(T.IntegerType())
    by_depth = {1: F.arrow_udf(find, one), 2: F.arrow_udf(find, T.ArrayType(one))}
    return lambda words, depth=1: by_depth[depth](words)


def encode_subwords(df: DataFrame, vocab: DataFrame, text_col: str = "text", out_col: str = "input_ids", max_len: int | None = None,
                    repair: bool = True, max_bytes: int = VOCAB_BYTES) -> DataFrame:
    """Text -> ids of its words' pieces, cut off after ``max_len``.  A null text has no words."""
    ids = subword_ids(vocab, repair, max_bytes)(split_words(F.coalesce(F.col(text_col), F.lit(""))))
    return df.withColumn(out_col, ids if max_len is None else F.slice(ids, 1, max_len))


def encode_subword_sentences(df: DataFrame, vocab: DataFrame, sentences_col: str = "sents", repair: bool = True, max_bytes: int = VOCAB_BYTES) -> DataFrame:
    """T2 on pieces: a list of sentences -> ``toks``, ``tok_lens``, ``tot_len``."""
    sents = F.coalesce(F.col(sentences_col), F.array().cast("array<string>"))
    out = df.withColumn("toks", subword_ids(vocab, repair, max_bytes)(F.transform(sents, lambda s: split_words(s)), 2))
    out = out.withColumn("tok_lens", F.transform("toks", lambda t: F.size(t)))
    return out.withColumn("tot_len", F.aggregate("tok_lens", F.lit(0), lambda a, x: a + x))


def piece_counts(texts: DataFrame, vocab: DataFrame, text_col: str = "text", repair: bool = True, max_bytes: int = VOCAB_BYTES) -> DataFrame:
    """T20 on pieces: the vocabulary with ``count``, how often each piece stands in the corpus (0: never).  Words are counted first,
    so every distinct word of the corpus is cut once, in one task; a frequent word is one row."""
    words = texts.select(F.explode(split_words(F.coalesce(F.col(text_col), F.lit("")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    ids = subword_ids(vocab, repair, max_bytes)(F.array("word"))
    counts = words.select(F.explode(ids).alias("id"), "n").groupBy("id").agg(F.sum("n").alias("count"))
    return vocab.join(counts, "id", "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))


def decode_subwords(df: DataFrame, vocab: DataFrame, ids_col: str = "input_ids", out_col: str = "decoded", max_bytes: int = VOCAB_BYTES) -> DataFrame:
    """T7 on ids: pieces one behind the other, byte pieces as UTF-8, marks as blanks, ends stripped.  Control pieces say nothing; an id
    outside the vocabulary is an error."""
    import pyarrow as pa

    shared = _shared(vocab, max_bytes)

    def text(ids):
        raw = {}
        for token, i, _, kind in shared.value[1]:
            raw[i] = bytes([int(token[3:-1], 16)]) if kind == BYTE else b"" if kind in (CONTROL, UNKNOWN) else token.replace(PIECE_MARK, " ").encode()
        one = lambda x: None if x is None else b"".join(map(raw.__getitem__, x)).decode("utf-8", "replace").strip(" ")
        return by_rows(lambda run: pa.array([one(x.as_py()) for x in run], pa.string()), ids)

    text.__annotations__ = {"ids": pa.Array, "return": pa.Array}
    return df.withColumn(out_col, F.arrow_udf(text, T.StringType())(F.col(ids_col)))
