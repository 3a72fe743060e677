"""Licence scan with ordered signature rules.

Texts are reduced to their words, joined by one space.  A rule is a regular expression over such
words, gated by a keyword: it runs only on texts that hold the keyword, and texts that hold no stem of
any keyword are not even normalised.  Every match is an interval of words.  Of overlapping detections,
one that lies inside another of higher priority, or inside a longer one of equal priority, is
suppressed; the base phrases always stay.

DataFrame functions only.  Detections meet per document, so no phrase that many documents share makes a
hot group; a partition holds the detections of one text.

Defined cases: null and empty texts have no words and no labels, and score 0; rows that repeat a doc_id are
judged each on its own text; equal intervals of equal priority all stay; an empty table gives no rows;
other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textprep.llm.common import null_safe
from textprep.llm.decontam import word_count, words

# Phrases that count as base places, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

_L = "licen[sc]es?"
# (label, keyword, name as a pattern over lower-case words)
FAMILIES = (
    ("afl-3", "academic free", rf"academic free {_L}(?: version)?(?: 3(?: 0)?)?"),
    ("agpl-3", "affero", rf"(?:gnu )?affero general public {_L}(?: version)?(?: 3(?: 0)?)?"),
    ("apache-1.1", "apache", rf"apache(?: software)? {_L}(?: version)? 1(?: 1)?"),
    ("apache-2", "apache", rf"apache(?: software)? {_L}(?: version)? 2(?: 0)?"),
    ("artistic-2", "artistic", rf"artistic {_L}(?: version)?(?: 2(?: 0)?)?"),
    ("beerware", "beerware", rf"beerware(?: {_L})?"),
    ("bsd-2-clause", "bsd", rf"(?:simplified bsd|bsd 2 clause|2 clause bsd) {_L}"),
    ("bsd-3-clause", "bsd", rf"(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd) {_L}"),
    ("bsd-4-clause", "bsd", rf"(?:original bsd|bsd 4 clause|4 clause bsd) {_L}"),
    ("bsd", "bsd", rf"bsd(?: style)? {_L}"),
    ("boost-1", "boost", rf"boost software {_L}(?: version)?(?: 1(?: 0)?)?"),
    ("cc-by", "cc by", r"cc by(?! (?:nc|sa|nd))(?: [1-4] [05])?"),
    ("cc-by-nc", "cc by", r"cc by nc(?! (?:sa|nd))(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc by", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc by", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nd", "cc by", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "cc by", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by", "creative commons", rf"creative commons attribution(?! (?:non|share|no))(?: [1-4] [05])?(?: international)?(?: public)? {_L}"),
    ("cc-by-nc", "creative commons", rf"creative commons attribution non ?commercial(?! (?:share|no))(?: [1-4] [05])?(?: international)? {_L}"),
    ("cc-by-sa", "creative commons", rf"creative commons attribution share ?alike(?: [1-4] [05])?(?: international)? {_L}"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cddl-1", "common development", rf"common development and distribution {_L}(?: version)?(?: 1(?: 0)?)?"),
    ("cecill-2", "cecill", rf"cecill(?: free software)? {_L}"),
    ("epl-1", "eclipse", rf"eclipse public {_L}(?: version)? 1(?: 0)?"),
    ("epl-2", "eclipse", rf"eclipse public {_L}(?: version)? 2(?: 0)?"),
    ("eupl-1.2", "european union", rf"european union public {_L}(?: version)?(?: 1 2)?"),
    ("fdl-1.3", "free documentation", rf"(?:gnu )?free documentation {_L}(?: version)?(?: 1 [123])?"),
    ("gpl-2", "general public", rf"(?:gnu )?(?<!lesser )(?<!library )(?<!affero )general public {_L}(?: version| v)? 2(?: 0)?"),
    ("gpl-3", "general public", rf"(?:gnu )?(?<!lesser )(?<!library )(?<!affero )general public {_L}(?: version| v)? 3(?: 0)?"),
    ("gpl", "gpl", rf"gnu gpl(?: version| v)?(?: ?[123])?"),
    ("isc", "isc", rf"isc {_L}"),
    ("lgpl-2.1", "lesser general", rf"(?:gnu )?lesser general public {_L}(?: version)? 2(?: 1)?"),
    ("lgpl-3", "lesser general", rf"(?:gnu )?lesser general public {_L}(?: version)? 3(?: 0)?"),
    ("mit", "mit", rf"mit(?: x11)? {_L}"),
    ("mpl-1.1", "mozilla", rf"mozilla public {_L}(?: version)? 1 1"),
    ("mpl-2", "mozilla", rf"mozilla public {_L}(?: version)? 2(?: 0)?"),
    ("ms-pl", "microsoft", rf"microsoft public {_L}"),
    ("ncsa", "ncsa", rf"(?:university of illinois )?ncsa(?: open source)? {_L}"),
    ("odbl-1", "open database", rf"open database {_L}(?: version)?(?: 1(?: 0)?)?"),
    ("ofl-1.1", "open font", rf"(?:sil )?open font {_L}(?: version)?(?: 1(?: 1)?)?"),
    ("osl-3", "open software", rf"open software {_L}(?: version)?(?: 3(?: 0)?)?"),
    ("postgresql", "postgresql", rf"postgresql {_L}"),
    ("psf-2", "python", rf"python(?: software foundation)? {_L}(?: version)?(?: 2)?"),
    ("public-domain", "public domain", r"public domain"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("zlib", "zlib", rf"zlib(?: libpng)? {_L}"),
)
# (priority, pattern around the name)
SIGNATURES = (
    (4, r"(?:is |are |was |be )?(?:dual )?(?:licensed|released|distributed|published|provided|made available|available|offered|covered) (?:to you )?under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{name}"),
    (4, r"spdx license identifier {name}"),
    (3, r"(?:governed by|subject to|in accordance with|in compliance with|pursuant to) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{name}"),
    (3, r"under (?:the )?(?:terms (?:and conditions )?of (?:the )?|conditions of (?:the )?)?{name}"),
    (2, r"(?:see|copy of|text of|read|accompanying) (?:the )?{name}"),
    (2, r"licen[sc]e (?:is )?(?:the )?{name}"),
    (1, r"{name}"),
)
# Stems one of which any text has in which a rule can match.
STEMS = ("licen", "gpl", "public domain", "wtfpl", "cc0", "beerware")
PRIORITIES = 4


def rules() -> list[tuple[int, str, str, int, bool, str]]:
    """(number, label, keyword, priority, base, pattern); base phrases come first."""
    found = [(label, phrase, PRIORITIES + 1, True, phrase) for phrase, label in BASE]
    for label, keyword, name in FAMILIES:
        found += [(label, keyword, priority, False, around.format(name=f"(?:{name})")) for priority, around in SIGNATURES]
    return [(n, label, keyword, priority, base, f"(?<= )(?:{pattern})(?= )") for n, (label, keyword, priority, base, pattern) in enumerate(found)]


def _rule_table(spark: SparkSession) -> DataFrame:
    # a fixed list of a few hundred rows
    return F.broadcast(spark.createDataFrame(rules(), "rule int, label string, keyword string, priority int, base boolean, pattern string"))


def _blanks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def detections(docs: DataFrame) -> DataFrame:
    """``(doc, label, priority, base, first, end)``: the word intervals [first, end) of all rule matches; doc is a hash of
    doc_id and text."""
    low = F.lower("text")
    gate = low.contains(STEMS[0])
    for stem in STEMS[1:]:
        gate = gate | (low.contains(stem.split()[0]) if " " in stem else low.contains(stem))
    gate = gate | (low.contains("cc") & low.contains("by"))
    plain = F.concat(F.lit(" "), F.array_join(words(F.col("text")), " "), F.lit(" "))
    texts = docs.where(gate).select(F.xxhash64("doc_id", "text").alias("doc"), plain.alias("plain")).distinct()
    keywords = F.array(*[F.lit(k) for k in sorted({r[2] for r in rules()})])
    texts = texts.withColumn("keyword", F.explode(F.filter(keywords, lambda k: F.contains(F.col("plain"), k))))
    hits = texts.join(_rule_table(docs.sparkSession), "keyword").where(F.expr("plain RLIKE pattern"))
    # the text between the matches, and the matches, in turn
    parts = F.arrays_zip(F.split("plain", F.col("pattern"), -1).alias("between"), F.expr("regexp_extract_all(plain, pattern, 0)").alias("match"))
    hits = hits.select("doc", "rule", "label", "priority", "base", parts.alias("parts"))
    each = hits.select("doc", "rule", "label", "priority", "base", F.posexplode("parts").alias("n", "part"))
    before = Window.partitionBy("doc", "rule").orderBy("n")
    each = each.select(
        "doc", "label", "priority", "base", F.col("part.match").alias("match"), _blanks(F.coalesce("part.match", F.lit(""))).alias("inside"),
        F.sum(_blanks(F.col("part.between")) + _blanks(F.coalesce("part.match", F.lit("")))).over(before).alias("blanks"),
    )
    each = each.where("match IS NOT NULL").withColumn("first", F.col("blanks") - F.col("inside") - 1)
    return each.select("doc", "label", "priority", "base", "first", (F.col("first") + F.col("inside") + 1).alias("end"))


def resolve(found: DataFrame) -> DataFrame:
    """``found`` with kept: false for detections inside one of higher priority or a longer one of equal priority."""
    in_order = Window.partitionBy("doc").orderBy("first", F.desc("end"), F.desc("priority")).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("doc", "priority").orderBy("first").rangeBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy("doc", "priority", "first")
    higher = F.lit(None).cast("long")
    for p in range(1, PRIORITIES + 1):
        reach = F.max(F.when(F.col("priority") > p, F.col("end"))).over(in_order)
        higher = F.when(F.col("priority") == p, reach).otherwise(higher)
    inside = (higher >= F.col("end")) | (F.max("end").over(earlier) >= F.col("end")) | (F.max("end").over(here) > F.col("end"))
    return found.withColumn("kept", F.col("base") | ~F.coalesce(inside, F.lit(False)))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and
    score, the highest priority among the kept detections as a share of all."""
    found = resolve(detections(docs))
    base = F.col("base")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    per = found.where("kept").groupBy("doc").agg(
        F.sum(base.cast("long")).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        (F.max(F.least("priority", F.lit(PRIORITIES))) / F.lit(float(PRIORITIES))).alias("score"),
    )
    per = per.withColumnRenamed("doc", "_doc")
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("doc"), word_count(F.col("text")).alias("n_words"))
    return null_safe(rows, per, {"doc": "_doc"}, "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
