"""Quality classifier from weak labels.

1. Heuristic labellers vote on each document: keep, drop or abstain.
2. Expectation-maximisation over the table of vote patterns (3 ** labellers rows at most, with the number of
   documents of each) estimates each labeller's vote rates among good and bad documents and the share
   of good ones.  The pattern table is counted over all documents; EM itself is a few aggregations of it.
3. The posterior of a document's pattern is its label: a linear scorer over hashed words learns from
   a bounded sample (each document with probability ``sample`` / all, by a hash, so about ``sample`` of
   them at any size), every document weighted as good and as bad.
4. The scorer judges every whole text.

Defined cases: null and empty texts are dropped with score 0; a table whose documents all vote alike has one
class, and scores are the posteriors; rows that repeat a doc_id are judged each on its own text; an empty
table gives no rows; other columns are ignored."""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textprep.llm.common import BLANK_WORD, stored

KEEP, DROP, ABSTAIN = 1, -1, 0
FEATURES = 1 << 16
SAMPLE = 20_000
ROUNDS = 50
REGULARISATION = 0.002

# English insults, and the stems of those in the other languages of the corpus (which clean
# words share now and then, so their share counts).
INSULTS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
STEMS = ("achkeit", "achlich", "boco", "boment", "réeux", "réê")


def _hits(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _single(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def oddness(text: Column) -> dict[str, Column]:
    """Counts of words and of odd things in a text."""
    return {
        "words": F.greatest(_hits(text, BLANK_WORD), F.lit(1)),
        "insults": _hits(F.lower(text), r"\b(?:" + "|".join(INSULTS) + r")\b"),
        "stems": _hits(F.lower(text), r"(?<!\p{L})(?:" + "|".join(STEMS) + r")\p{L}*"),
        "repeats": _hits(text, r"(?<!\S)(\S++)(?:\s+\1(?!\S)){2}"),
        "marks": _hits(text, r"[%*$#&]{2,}"),
        "bars": _single(text, "|"),
        "shouts": _hits(text, r"\p{Lu}{3,}"),
        "calls": _single(text, "!"),
    }


def labellers(n: Column) -> dict[str, Column]:
    """Votes by name, from a struct of :func:`oddness`.  They overlap: shouted texts also have many
    exclamation marks, and so on."""

    def vote(drop: Column, keep: Column) -> Column:
        return F.when(drop, DROP).when(keep, KEEP).otherwise(ABSTAIN)

    return {
        "insults": vote(n["insults"] > 0, n["insults"] == 0),
        "stems": vote((n["stems"] > 1) & (n["stems"] * 100 >= n["words"]), n["stems"] * 200 <= n["words"]),
        "insult_share": vote((n["insults"] + n["stems"]) * 80 >= n["words"], F.lit(False)),
        "repeats": vote(n["repeats"] * 30 > n["words"], n["repeats"] * 300 <= n["words"]),
        "symbols": vote(n["marks"] * 20 > n["words"], n["marks"] * 100 <= n["words"]),
        "bars": vote(n["bars"] * 20 > n["words"], n["bars"] * 100 <= n["words"]),
        "shouting": vote(n["shouts"] * 20 > n["words"], n["shouts"] * 100 <= n["words"]),
        "exclamations": vote(n["calls"] * 20 > n["words"], n["calls"] * 100 <= n["words"]),
        "odd": vote((n["marks"] + n["bars"] + n["shouts"] + n["calls"] + 3 * n["repeats"]) * 10 > n["words"], F.lit(False)),
    }


def em(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> list[float]:
    """Posterior of being good for each vote pattern, by EM on a two-class model in which the labellers
    vote independently given the class.  Starts from labellers that are mostly right; a pseudo-count
    keeps rates off 0 and 1."""
    if not patterns:
        return []
    votes = (KEEP, ABSTAIN, DROP)
    m = len(patterns[0][0])
    start = {True: {KEEP: 0.7, ABSTAIN: 0.28, DROP: 0.02}, False: {KEEP: 0.4, ABSTAIN: 0.2, DROP: 0.4}}
    rates = {c: [dict(start[c]) for _ in range(m)] for c in start}
    good = 0.8
    total = sum(n for _, n in patterns)
    posterior: list[float] = []
    for _ in range(rounds):
        posterior = []
        for p, _n in patterns:
            a = math.log(good) + sum(math.log(rates[True][j][v]) for j, v in enumerate(p))
            b = math.log(1 - good) + sum(math.log(rates[False][j][v]) for j, v in enumerate(p))
            posterior.append(1 / (1 + math.exp(max(-700, min(700, b - a)))))
        mass = sum(q * n for q, (_, n) in zip(posterior, patterns))
        good = (mass + 1) / (total + 2)
        for c in (True, False):
            share = [(q if c else 1 - q) * n for q, (_, n) in zip(posterior, patterns)]
            whole = sum(share)
            for j in range(m):
                for v in votes:
                    hit = sum(s for s, (p, _) in zip(share, patterns) if p[j] == v)
                    rates[c][j][v] = (hit + start[c][v]) / (whole + 1)
    return posterior


def _tokens(text: Column, n: Column) -> Column:
    """Features: lower-case words of letters, and for each kind of oddness its share in steps."""
    bare = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), " ")
    steps = [
        F.concat(F.lit(f"<{k} "), F.least(F.lit(6), F.floor(F.log2(1 + 200 * n[k] / n["words"]))).cast("string"), F.lit(">"))
        for k in ("insults", "stems", "repeats", "marks", "bars", "shouts", "calls")
    ]
    return F.concat(bare, F.array(*steps))


def classify(docs: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, votes, p_good (posterior of the votes), score (of the
    linear scorer, 0 to 1), kept (score of 0.5 or more)."""
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    # the counts are a column of their own: each is computed once, however many votes use it
    counted = rows.select("doc_id", "doc", "text", F.struct(*[c.cast("long").alias(k) for k, c in oddness(F.col("text")).items()]).alias("n"))
    blank = ~F.col("text").rlike(r"[^\x20\x09\x0A\x0B\x0C\x0D]")
    votes = F.array(*[F.when(F.col("blank"), DROP).otherwise(c).cast("int") for c in labellers(F.col("n")).values()])
    tf = HashingTF(numFeatures=features, inputCol="tokens", outputCol="features", binary=True)
    hashed = tf.transform(counted.select("doc_id", "doc", "n", blank.alias("blank"), _tokens(F.col("text"), F.col("n")).alias("tokens")))
    # one pass over the texts: all that follows reads hashed words and votes
    rows = stored(hashed.select("doc_id", "doc", "blank", votes.alias("votes"), "features"), "features")
    # at most 3 ** labellers rows
    patterns = [(tuple(r["votes"]), r["n"]) for r in rows.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()]
    pairs = [(list(p), float(q)) for (p, _), q in zip(patterns, em(patterns))]
    posterior = F.broadcast(docs.sparkSession.createDataFrame(pairs, "votes array<int>, p_good double"))
    rows = rows.join(posterior, "votes")
    share = min(1.0, sample / max(1, sum(n for _, n in patterns)))
    drawn = rows.where(F.pmod(F.xxhash64("doc", F.lit("train")), F.lit(1 << 30)) < int(share * (1 << 30)))
    sides = F.array(*[F.struct(F.lit(y).alias("label"), w.alias("w")) for y, w in ((1.0, F.col("p_good")), (0.0, 1 - F.col("p_good")))])
    train = drawn.select("features", F.explode(sides).alias("s")).select("features", "s.label", "s.w").where("w > 0.001")
    train = stored(train, "train")
    if train.select("label").distinct().count() == 2:
        model = LogisticRegression(weightCol="w", regParam=REGULARISATION, maxIter=30).fit(train)
        rows = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    else:
        rows = rows.withColumn("score", F.col("p_good"))
    score = F.when(F.col("blank"), 0.0).otherwise(F.col("score"))
    return rows.select("doc_id", "votes", "p_good", score.alias("score")).withColumn("kept", F.col("score") >= 0.5)


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns kept; rows of one doc_id go if one of them goes."""
    bad = classify(docs.select("doc_id", "text"), **options).where(~F.col("kept")).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]), "left_anti")
