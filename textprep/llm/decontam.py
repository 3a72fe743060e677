"""Benchmark decontamination with a distributed positional inverted index.

:func:`build_index` stores a posting (term, document, position) for every word of the documents that is
a term of the benchmark; other words can't be part of a match.  :func:`phrase_matches` looks up the
windows of the items: for each window the two terms with the shortest posting lists are looked up
first, and their lists are intersected at the offset they have in the window.  What remains are
alignments (document, item, shift), and only for these are the lists of the item's other terms
intersected, again by shift.  Runs of matching item words of at least a window's length are exact
matches; alignments that reach no such run but share many words are proximity matches (of those passages
that keep the two rarest terms of some window).

DataFrame functions only.  Postings are joined on (document, position), which no frequent term or
passage makes hot; the tables of benchmark terms and windows are broadcast only if their stored size is
small, else AQE splits the hot terms.

Defined cases: null or empty texts have no words; an item of fewer words than a window is one window;
an item without words never matches; documents are told apart by id and text, so rows that repeat a
doc_id are judged each on its own text; items with equal text match alike, and rows that repeat an item_id count as one
item; a null item_id matches, but is not listed; empty tables give no rows, or no matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textprep.llm.common import BROADCAST_BYTES, CASED_WORD, NOT_ALNUM, broadcast_if_small, lower_ascii, null_safe, stored

WINDOW = 10
NEAR_SHARE = 0.8  # of an item's words at one alignment, for a proximity match


def words(text: Column) -> Column:
    """Words of the text, A-Z lower-cased; empty for null."""
    plain = F.trim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), NOT_ALNUM, " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(CASED_WORD)), F.lit(0)).cast("long")


def item_terms(items: DataFrame) -> DataFrame:
    """``(item, item_id, n, at, term_no)``: the words of each item; item is a hash of id and text, term_no one of
    the word."""
    key = F.xxhash64("item_id", "text")
    per = items.select(key.alias("item"), "item_id", words(F.col("text")).alias("w")).dropDuplicates(["item"])
    each = per.select("item", "item_id", F.size("w").alias("n"), F.posexplode("w").alias("at", "term"))
    return each.withColumn("term_no", F.xxhash64("term")).drop("term")


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Stored postings ``(term_no, doc, at)`` of the words of ``docs(doc_id, text)`` among ``terms(term_no)``;
    doc is a hash of id and text."""
    split = docs.select(F.xxhash64("doc_id", "text").alias("doc"), words(F.col("text")).alias("w"))
    tokens = split.select("doc", F.posexplode("w").alias("at", "term")).select(F.xxhash64("term").alias("term_no"), "doc", "at")
    return stored(tokens.join(broadcast_if_small(terms, F.lit(16)), "term_no", "left_semi"), "postings")


def alignments(index: DataFrame, terms: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc, item, shift)`` at which the two rarest terms of some window of the item stand in the document as they
    stand in the item; shift is the position of the item's first word, negative if the document starts inside the item."""
    lengths = stored(index.groupBy("term_no").agg(F.count("*").alias("length")), "lengths")
    each = terms.join(broadcast_if_small(lengths, F.lit(16)), "term_no", "left").select("item", "at", "term_no", "n", F.coalesce("length", F.lit(0)).alias("length"))
    # windows by the position of their first word; a short item is one window
    starts = each.withColumn("start", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - (window - 1)), F.least("at", F.greatest(F.lit(0), F.col("n") - window)))))
    rarest = starts.groupBy("item", "start").agg(
        F.min("length").alias("least"), F.slice(F.sort_array(F.collect_list(F.struct("length", "at", "term_no"))), 1, 2).alias("pair")
    )
    # a window with a term that no document has can't occur
    pairs = stored(
        rarest.where("least > 0").select(
            "item", F.col("pair")[0]["term_no"].alias("term_no"), F.col("pair")[0]["at"].alias("first"), F.try_element_at("pair", F.lit(2)).alias("second")
        ).distinct(),
        "window-terms",
    )
    heads = broadcast_if_small(pairs, F.lit(48))
    hits = index.join(heads, "term_no").withColumn("shift", F.col("at") - F.col("first"))
    single = hits.where("second IS NULL").select("doc", "item", "shift")
    double = hits.where("second IS NOT NULL").select(
        "doc", "item", "shift", F.col("second.term_no").alias("term_no"), (F.col("shift") + F.col("second.at")).alias("at")
    )
    seconds = pairs.where("second IS NOT NULL").select(F.col("second.term_no").alias("term_no")).distinct()
    lists = index.join(broadcast_if_small(stored(seconds, "second-terms"), F.lit(16)), "term_no", "left_semi")
    double = double.join(lists, ["doc", "at", "term_no"], "left_semi").select("doc", "item", "shift")
    return stored(single.unionByName(double).distinct(), "alignments")


def phrase_matches(index: DataFrame, terms: DataFrame, window: int = WINDOW, near_share: float = NEAR_SHARE) -> DataFrame:
    """``(doc, item, shift, exact, first, end)``: exact matches with their maximal run of document words [first, end), and
    proximity matches (exact is false) from the first to the last common word."""
    found = alignments(index, terms, window)
    small = broadcast_if_small(terms.select("item", "at", "term_no", "n"), F.lit(40))
    expected = found.join(small.withColumnRenamed("at", "item_at"), "item").withColumn("at", F.col("shift") + F.col("item_at"))
    # the lists of frequent terms are long: only documents with alignments are needed of them
    some = stored(found.select("doc").distinct(), "aligned")
    if some.count() * 16 <= BROADCAST_BYTES:
        index = index.join(F.broadcast(some), "doc", "left_semi")
    common = expected.join(index, ["doc", "at", "term_no"], "left_semi")
    # per alignment the runs of consecutive item words; a partition has an item's words at most
    one = Window.partitionBy("doc", "item", "shift").orderBy("item_at")
    runs = common.withColumn("run", F.col("item_at") - F.row_number().over(one))
    runs = runs.groupBy("doc", "item", "shift", "run").agg(F.min("at").alias("first"), (F.max("at") + 1).alias("end"), F.first("n").alias("n"))
    runs = runs.withColumn("exact", F.col("end") - F.col("first") >= F.least("n", F.lit(window)))
    exact = runs.where("exact").select("doc", "item", "shift", "exact", "first", "end")
    near = runs.groupBy("doc", "item", "shift").agg(
        F.max("exact").alias("some"), F.sum(F.col("end") - F.col("first")).alias("words"), F.first("n").alias("n"), F.min("first").alias("first"), F.max("end").alias("end")
    )
    near = near.where(~F.col("some") & (F.col("words") >= F.col("n") * near_share)).select("doc", "item", "shift", F.lit(False).alias("exact"), "first", "end")
    return stored(exact.unionByName(near), "matches")


def find_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Matches between ``docs(doc_id, text)`` and ``items(item_id, text)``, and ``(item, item_id)``."""
    terms = stored(item_terms(items), "item-terms")
    index = build_index(docs, stored(terms.select("term_no").distinct(), "terms"))
    return phrase_matches(index, terms, window), terms.select("item", "item_id").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit (words inside exact matches), n_items, item_ids
    (sorted as strings, comma-joined), contaminated, n_near (items with proximity matches only)."""
    matches, ids = find_matches(docs, items, window)
    exact = matches.where("exact")
    covered = exact.select("doc", "first", "end").distinct().select("doc", F.explode(F.sequence(F.col("first"), F.col("end") - 1)).alias("at"))
    hit = covered.distinct().groupBy("doc").agg(F.count("*").alias("n_hit"))
    named = matches.join(broadcast_if_small(stored(ids, "items"), F.lit(24)), "item")
    per = named.groupBy("doc", "item_id").agg(F.max("exact").alias("exact"))
    listed = per.groupBy("doc").agg(
        F.sum(F.col("exact").cast("long")).alias("n_items"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("exact"), F.col("item_id").cast("string")))), ",").alias("item_ids"),
        F.sum((~F.col("exact")).cast("long")).alias("n_near"),
    )
    found = listed.join(hit, "doc", "left").withColumnRenamed("doc", "_doc")
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("doc"), word_count(F.col("text")).alias("n_words"))
    zero = F.lit(0).cast("long")
    return null_safe(rows, found, {"doc": "_doc"}, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("item_ids", F.lit("")).alias("item_ids"),
        (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
        F.coalesce("n_near", zero).alias("n_near"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold an exact match, all columns kept."""
    matches, _ = find_matches(docs.select("doc_id", "text"), items, window)
    bad = matches.where("exact").select(F.col("doc").alias("_bad")).distinct()
    return docs.join(bad, F.xxhash64(docs["doc_id"], docs["text"]) == bad["_bad"], "left_anti")
