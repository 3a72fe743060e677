"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent character n-grams (1 to 3 letters, words padded
with a blank); a text's profile is made in the same way, and the language with the smallest sum of
out-of-place distances wins: the difference of ranks, or the profile's length for an n-gram that the
language's profile lacks.  The n-grams of all labelled texts are counted: each task sums its own,
Spark adds the sums, and only the profiles (300 rows per language) reach the driver.

Defined cases: texts that are null or have no letter are ``und`` with score 0, and so are all texts when
no labelled text has a letter; rows with a null label don't teach; of languages at equal distance the
first by code point wins, and n-grams of equal count rank by code point; an empty table gives no rows; rows that
repeat an id are judged and teach one by one; texts are read whole, however long; only doc_id, text and lang are read, so
other columns don't matter to :func:`identify`."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP = 300
UNKNOWN = "und"
MAX_SMALL = 64  # letters up to which n-grams are counted in a plain array
HELD = 32  # languages whose counts a task holds at once

_BITS = 21  # a code point
_ALPHA: list[np.ndarray] = []


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, each run of other characters as one 0, a 0 at both ends."""
    if not _ALPHA:
        _ALPHA.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    points = np.concatenate([[0], np.where(_ALPHA[0][points], points, 0), [0]]).astype(np.int64)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] > 0) | (points[:-1] > 0)
    return points[keep]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of a text, ascending, and their counts.  A code holds the letters' code
    points plus one, most significant first; 1 is the blank at a word's edge."""
    points = _letters(text) if text else np.zeros(0, np.int64)
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    alphabet, x = _compact(points)
    k = len(alphabet)
    one = x[x > 0]
    a, b, c = x[:-2], x[1:-1], x[2:]
    two = x[:-1] * k + x[1:]
    three = ((a * k + b) * k + c)[b > 0]
    parts = [(one, 1), (two, 2), (three, 3)]
    codes, counts = [], []
    shifted = alphabet + 1
    for y, n in parts:
        if k <= MAX_SMALL:
            all_counts = np.bincount(y, minlength=1)
            value = np.flatnonzero(all_counts)
            count = all_counts[value]
        else:
            value, count = np.unique(y, return_counts=True)
        code = np.zeros(len(value), np.int64)
        for p in range(n - 1, -1, -1):
            code = (code << _BITS) | shifted[(value // k**p) % k]
        codes.append(code)
        counts.append(count)
    return np.concatenate(codes), np.concatenate(counts).astype(np.int64)


def _compact(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    seen = np.zeros(int(points.max()) + 1, bool)
    seen[points] = True
    alphabet = np.flatnonzero(seen)
    place = np.zeros(len(seen), np.int64)
    place[alphabet] = np.arange(len(alphabet))
    return alphabet, place[points]


def _count(batches):
    """Sums of the n-grams of each language over the texts a task reads."""
    import pyarrow as pa

    def flush(held):
        for lang, parts in held.items():
            codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
            yield lang, codes, n

    def batch_of(sums):
        sums = list(sums)
        names = pa.array(np.repeat([s[0] for s in sums], [len(s[1]) for s in sums]).tolist(), pa.string())
        return pa.RecordBatch.from_arrays([names, pa.array(np.concatenate([s[1] for s in sums])), pa.array(np.concatenate([s[2] for s in sums]))], ["lang", "gram", "n"])

    held: dict[str, list] = {}
    n = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            codes, counts = grams(text.as_py())
            if not len(codes):
                continue
            held.setdefault(lang, []).append((codes, counts))
            n += len(codes)
            if n > 2_000_000 and len(held) <= HELD:  # sum up what is held, send it if that doesn't shrink it
                held = {k: [(c, s)] for k, c, s in flush(held)}
                n = sum(len(v[0][0]) for v in held.values())
            if n > 1_000_000 and len(held) > HELD or n > 1_500_000 and all(len(v) == 1 for v in held.values()):
                yield batch_of(flush(held))
                held, n = {}, 0
    if held:
        yield batch_of(flush(held))


def learn(labelled: DataFrame, top: int = TOP) -> pd.DataFrame:
    """Profiles ``(lang, gram, rank)`` of the languages of ``labelled(lang, text)``, rank from 0."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "text")
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # filtered on the row number itself, so Spark cuts each language to its first rows before and after the shuffle
    ranked = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    return ranked.select("lang", "gram", (F.col("place") - 1).alias("rank")).toPandas()  # top rows per language


class _Model:
    def __init__(self, profiles: pd.DataFrame, top: int):
        self.top = top
        self.langs = sorted(profiles["lang"].unique())
        self.codes = np.unique(profiles["gram"].to_numpy(np.int64))
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), -1, np.int64)
        for i, lang in enumerate(self.langs):
            own = profiles[profiles["lang"] == lang]
            self.ranks[i, np.searchsorted(self.codes, own["gram"])] = own["rank"]

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = grams(text)
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        best = np.lexsort((codes, -counts))[: self.top]
        at = np.minimum(np.searchsorted(self.codes, codes[best]), len(self.codes) - 1)
        known = self.codes[at] == codes[best]
        theirs = self.ranks[:, np.where(known, at, len(self.codes))]
        far = np.where(theirs < 0, self.top, np.abs(theirs - np.arange(len(best)))).sum(axis=1)
        i = int(far.argmin())
        return self.langs[i], float(1 - far[i] / (self.top * len(best)))


def predictor(profiles: pd.DataFrame, top: int = TOP):
    """A column function: text to ``struct<lang_pred, score>``, score from 0 (nothing in common with the
    nearest profile) to 1 (equal ranks)."""
    model = _Model(profiles, top)

    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in text], columns=["lang_pred", "score"])

    return predict


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents that teaches nothing, null ids included."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, lang)`` to doc_id, held_out, lang_pred, score; learns from the rows not held out."""
    predict = predictor(learn(docs.where(~held_out(F.col("doc_id"))).select("lang", "text")))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict("text").alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has a language, all columns kept; those without a letter go.  Where no row
    teaches a language, all texts with a letter stay."""
    profiles = learn(docs.where(~held_out(F.col("doc_id"))).select("lang", "text"))
    if profiles.empty:

        @F.pandas_udf("boolean")
        def has_letter(text: pd.Series) -> pd.Series:
            return pd.Series([len(grams(t)[0]) > 0 for t in text], dtype=bool)

        return docs.where(has_letter("text"))
    return docs.where(predictor(profiles)("text")["lang_pred"] != UNKNOWN)
