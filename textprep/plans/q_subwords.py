"""Queries: subword vocabulary, encoding and decoding (T20, T1, T2, T4, T7) with the pieces of a public model file.  DuckDB has no
segmentation, so what SQL can check is the round trip; tests hold the rest against the model's own library."""

from __future__ import annotations

from pyspark.sql import functions as F

from textprep.functions.text import sentences
from textprep.operators import subwords as SW
from textprep.operators.tokens import ids_string
from textprep.plans import sqltext as S
from textprep.plans.catalog import register
from textprep.sources.tables import read_table

PIECE_FILE_CONF = "spark.textprep.piece.file"


def piece_vocab(spark):
    """The vocabulary of the model file that the session names, else of the public one of 32,000 pieces."""
    path = spark.conf.get(PIECE_FILE_CONF, None)
    if not path:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return SW.read_pieces(spark, path)


@register("t20_subword_vocab")
def q_t20_subwords(spark, sf_dir):
    """Every piece with its count over all documents."""
    found = SW.piece_counts(read_table(spark, sf_dir, "documents").select("text"), piece_vocab(spark))
    return found.select(F.col("id").cast("long"), "token", "kind", F.col("count").alias("n"))


@register("t1_subword_encode")
def q_t1_subwords(spark, sf_dir):
    """Ids of every whole text, digit-comma pieces cut anew (T4)."""
    d = SW.encode_subwords(read_table(spark, sf_dir, "documents").select("doc_id", "text"), piece_vocab(spark))
    return d.select("doc_id", F.size("input_ids").cast("long").alias("n_ids"), F.md5(ids_string("input_ids")).alias("ids_md5"))


@register("t2_subword_sentences")
def q_t2_subwords(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", sentences(["text"]).alias("sents"))
    d = SW.encode_subword_sentences(d, piece_vocab(spark))
    each = F.array_join(F.transform("toks", ids_string), "|")
    return d.select("doc_id", F.size("toks").cast("long").alias("n_sents"), F.col("tot_len").cast("long"), F.md5(each).alias("toks_md5"))


@register("t7_subword_roundtrip", f"""SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, md5(array_to_string(w, ' ')) AS text_md5
    FROM (SELECT doc_id, {S.split_words("replace(coalesce(text, ''), '▁', ' ')")} AS w FROM documents) d""")
def q_t7_subwords(spark, sf_dir):
    """Decoding gives back the words of every text (a mark in a text is a blank)."""
    vocab, words = piece_vocab(spark), F.replace(F.coalesce("text", F.lit("")), F.lit("▁"), F.lit(" "))
    d = SW.encode_subwords(read_table(spark, sf_dir, "documents").select("doc_id", words.alias("text")), vocab)
    d = SW.decode_subwords(d.select("doc_id", "input_ids"), vocab)
    n = F.when(F.col("decoded") == "", F.lit(0)).otherwise(F.size(F.split("decoded", " ")))
    return d.select("doc_id", n.cast("long").alias("n_words"), F.md5("decoded").alias("text_md5"))
