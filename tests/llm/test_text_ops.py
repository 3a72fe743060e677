"""Operators on texts against plain versions, on a fixture of odd rows and on the small tables."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute
from pyspark.sql import functions as F

from textprep.llm import decontam, langid, licenses, minhash_dedup, mixing, quality, substring_dedup
from textprep.llm.graph import components

SF = "/root/testdata/sf0.001"
rng = random.Random(5)
VOCAB = [f"w{i}" for i in range(300)]


def words(n, vocab=VOCAB):
    return " ".join(rng.choice(vocab) for _ in range(n))


PASSAGE, ITEM = words(30), words(25)
LONG = words(20_000)
EDITED = [words(120)]
for _ in range(12):  # a chain of copies with one more word changed each time
    w = EDITED[-1].split()
    w[rng.randrange(len(w))] = rng.choice(VOCAB)
    EDITED.append(" ".join(w))

TEXTS = [
    None, "", "  \n\t ", "one", "One two", "...!!! 12 ##", LONG, LONG, LONG + " tail",
    words(15) + "\n" + PASSAGE + "  " + words(5), PASSAGE, PASSAGE + " " + PASSAGE, words(40),
    words(7) + " " + ITEM + " " + words(7), " ".join(ITEM.split()[4:16]), ITEM.upper().replace(" ", "--"), " ".join(ITEM.split()[:9]),
    "Éa b Kelvin İ x", "Released under the MIT License. Licensed under the Apache License, Version 2.0; CC BY-NC 4.0",
    "under the mit license under the MIT license", "GNU General Public License, version 3", *EDITED,
]
DOCS = [(i, t) for i, t in enumerate(TEXTS)]
# names that the operators use themselves
CLASH = ["class", "doc", "size", "n_words", "removed", "places", "_id", "rest", "word", "source_size", "copies", "team", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, ["en", None, "fr"][i % 3], ["a", "b", None, ""][i % 4]) for i, t in DOCS], "doc_id long, text string, lang string, source string")
    for c in CLASH:
        df = df.withColumn(c, F.lit(7))
    return df.repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_substring_dedup(spark, docs, empty):
    got = rows(substring_dedup.remove_repeats(docs))
    for k, want in brute.removed(DOCS).items():
        assert (got[k]["n_words"], got[k]["n_removed"], got[k]["kept_sha256"]) == want, k
        assert " ".join(brute.blank_words(got[k]["text"])) == " ".join(
            w for i, w in enumerate(brute.blank_words(TEXTS[k])) if not any(s["first"] <= i < s["end"] for s in got[k]["removed"])
        )
        if not want[1]:
            assert got[k]["text"] == TEXTS[k]
        assert got[k]["class"] == 7
    assert got[6]["n_removed"] < got[7]["n_removed"] == 20_000
    assert substring_dedup.remove_repeats(empty).count() == 0
    left = substring_dedup.strip_repeats(docs)
    assert left.columns == docs.columns
    kept = rows(left)
    assert 7 not in kept and kept[0]["text"] is None and kept[8]["n_words"] == 7
    assert all(r["n_chars"] == (len(r["text"]) if got[k]["n_removed"] else 7) for k, r in kept.items())


def test_substring_dedup_equal_ids(spark):
    a, b = words(30), words(30)
    df = spark.createDataFrame([(1, a), (1, a), (1, b), (None, b), (None, b), (2, a)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 99, r["text"] is not None, r["n_removed"]) for r in substring_dedup.remove_repeats(df).collect())
    # equal id and start: neither is earlier; null ids are last and equal
    assert got == [(1, True, 0), (1, True, 0), (1, True, 0), (2, True, 30), (99, True, 30), (99, True, 30)]


def test_substring_dedup_in_many_flushes(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FLUSH_WINDOWS", 50)
    some = [(i, " ".join((VOCAB[: 3 + i % 4] * 30)[i % 5 : 60])) for i in range(30)] + [(30 + i, words(60)) for i in range(5)]
    df = spark.createDataFrame(some, "doc_id long, text string").repartition(4)
    got = rows(substring_dedup.remove_repeats(df, kept_text=False))
    want = brute.removed(some)
    assert {k: tuple(r)[1:4] for k, r in got.items()} == want
    assert any(n for _, n, _ in want.values())


def test_decontamination(spark, docs, empty):
    items = [(1, ITEM), (2, ITEM), (3, None), (4, ""), (5, "one two"), (6, " ".join(ITEM.split()[:9])), (10, LONG[:400]), (1, ITEM)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc", F.lit(1))
    got = rows(decontam.contamination(docs, bench))
    for k, t in DOCS:
        n, hit, found = brute.contamination(t, items)
        r = got[k]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["item_ids"], r["contaminated"]) == (n, hit, len(found), ",".join(sorted(map(str, found))), hit > 0), k
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert set(rows(kept)) == {k for k, r in got.items() if not r["contaminated"]}
    assert decontam.contamination(empty, bench).count() == 0
    assert not any(r["contaminated"] for r in decontam.contamination(docs, bench.where("false")).collect())


def test_decontamination_near_and_equal_ids(spark):
    w = ITEM.split()
    near = " ".join(x if i % 9 else "zzz" for i, x in enumerate(w))  # no ten words in a row
    df = spark.createDataFrame([(1, ITEM), (1, "nothing"), (None, ITEM), (2, near)], "doc_id long, text string")
    # the replaced words are frequent ones, so the rarest of some window are left
    df = df.unionByName(spark.createDataFrame([(7, " ".join(w[::9] * 5))], "doc_id long, text string"))
    got = [(r["doc_id"], r["n_hit"], r["n_near"]) for r in decontam.contamination(df, spark.createDataFrame([(9, ITEM)], "item_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(1, 25, 0), (1, 0, 0), (None, 25, 0), (2, 0, 1), (7, 0, 0)], key=str)


def test_minhash_dedup(spark, docs, empty):
    got = rows(minhash_dedup.near_duplicates(docs, size=2))
    root, sizes = brute.near_duplicates(dict(DOCS))
    for k, _ in DOCS:
        assert (got[k]["n_shingles"], got[k]["component_id"], got[k]["kept"]) == (sizes[k], root[k], root[k] == k), k
    assert len({root[k] for k in range(21, 34)}) == 1
    kept = minhash_dedup.keep_first(docs, size=2)
    assert kept.columns == docs.columns and set(rows(kept)) == {k for k in root if root[k] == k}
    assert minhash_dedup.near_duplicates(empty).count() == 0


def test_minhash_dedup_equal_and_null_ids(spark):
    a, b = words(50), words(50)
    df = spark.createDataFrame([(3, a), (3, a), (3, b), (None, a), (None, b), (5, b), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"] > 0, r["component_id"]) for r in minhash_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(3, True, 3), (3, True, 3), (3, True, 3), (None, True, 3), (None, True, 3), (5, True, 3), (None, False, None)], key=str)


def test_minhash_keep_first_by_row(spark):
    """One row for each component: null ids, repeated ids with different texts, repeated rows, texts without words."""
    a, b, c, d = words(50), words(50), words(50), words(50)
    table = [
        (1, a, "x"), (None, a, "x"), (None, a + " more", "y"),  # copies with null ids go
        (None, b, "x"), (None, b + " more", "x"), (None, b, "x"),  # only null ids: one of them
        (2, a + " end", "x"), (2, c, "x"),  # 2 stays with its own text only
        (3, d, "x"), (3, d, "x"), (3, d, "y"),  # one of the three
        (4, None, "x"), (None, "", "x"), (None, "", "y"),
    ]
    df = spark.createDataFrame(table, "doc_id long, text string, class string").withColumn("key", F.lit("own")).withColumn("m", F.create_map(F.lit(1), F.lit(2)))
    for docs in (df, df.repartition(5)):
        kept = minhash_dedup.keep_first(docs)
        assert kept.columns == df.columns
        got = [(r["doc_id"], r["text"]) for r in kept.collect()]
        assert {r["key"] for r in kept.collect()} == {"own"}
        assert [t in (b, b + " more") for k, t in got if k is None and t].count(True) == 1
        rest = [r for r in got if r[0] is not None or not r[1]]
        assert len(got) == len(rest) + 1 and sorted(rest, key=str) == sorted([(1, a), (2, c), (3, d), (4, None), (None, ""), (None, "")], key=str)


def test_minhash_dedup_large_families(spark, monkeypatch):
    """Teams above the limits, stragglers near them, and several blocks."""
    monkeypatch.setattr(minhash_dedup, "LARGE", 6)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 4)
    texts = []
    for _ in range(3):
        base = words(60).split()
        for _ in range(25):
            w = list(base)
            for _ in range(rng.choice([1, 2, 3, 4, 5, 7])):
                w[rng.randrange(len(w))] = rng.choice(VOCAB)
            texts.append(" ".join(w))
    pairs = list(enumerate(texts))
    rng.shuffle(pairs)
    got = rows(minhash_dedup.near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string"), size=2))
    root, _ = brute.near_duplicates(dict(pairs))
    assert {k: r["component_id"] for k, r in got.items()} == root


def test_minhash_dedup_rows_of_unlinked_families(spark, monkeypatch):
    """Texts just below the limit: no table grows with the square of their number, whole lists and clusters are cut, no link is lost."""
    for name, value in (("LARGE", 64), ("BLOCK", 64), ("SPAN", 100), ("FEW", 3)):
        monkeypatch.setattr(minhash_dedup, name, value, raising=False)
    counts, store = {}, minhash_dedup.stored

    def counted(df, name):
        out = store(df, name)
        counts[name] = max(counts.get(name, 0), out.count())
        return out

    monkeypatch.setattr(minhash_dedup, "stored", counted)
    base, texts = [f"base{i}" for i in range(60)], []
    for k in range(300):
        w = list(base)
        for i in rng.sample(range(60), 4):
            w[i] = f"own{k}x{i}"
        texts.append(" ".join(w))
        if k % 10 == 0:
            texts.append(" ".join([*w, "end"]))
    got = rows(minhash_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=2))
    root, _ = brute.near_duplicates(dict(enumerate(texts)))
    assert len(set(root.values())) > 250
    assert {k: r["component_id"] for k, r in got.items()} == root
    assert max(counts.values()) <= 40 * len(texts), counts


@pytest.mark.parametrize("own", [24, 4])
def test_minhash_dedup_rows_of_texts_with_a_common_line(spark, monkeypatch, own):
    """Texts that share a line but few of which link make one cluster: their rows are not its size times its blocks.  Where
    lists of shingles make more rows than blocks (4 words of their own), blocks remain.  No link is lost either way."""
    for name, value in (("LARGE", 64), ("BLOCK", 16), ("WIDE", 2)):
        monkeypatch.setattr(minhash_dedup, name, value, raising=False)
    counts, meet = [], minhash_dedup._meet

    def counted(table, *more):
        counts.append(table.count())
        return meet(table, *more)

    monkeypatch.setattr(minhash_dedup, "_meet", counted)
    base, texts = [f"base{i}" for i in range(60 - own)], []
    for k in range(330):
        w = [f"own{k}x{i}" for i in range(own)]
        texts.append(" ".join(base + w if own > 9 else base[: k % 50] + w + base[k % 50 :]))
        if k % 10 == 0:
            texts += [texts[-1] + " end", "start " + texts[-1]]
    got = rows(minhash_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), size=2))
    root, _ = brute.near_duplicates(dict(enumerate(texts)))
    assert {k: r["component_id"] for k, r in got.items()} == root
    if own == 24:
        assert len(set(root.values())) == 330 and counts[-1] <= 6 * len(texts), counts


def test_components(spark):
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, 500 + i) for i in range(50)]
    want = brute.components({x for e in links for x in e}, links)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_license_scan(spark, docs, empty):
    more = [(100 + i, t) for i, t in enumerate([
        "SPDX-License-Identifier: Apache License 2.0", "This is dual licensed under the terms of the GNU Lesser General Public License version 2.1 and the BSD 3-clause license",
        "cc by nc cc by nc sa cc by", "see the mozilla public license 2.0 " * 300, "copyright\nApache\n\nLicense, (version) 2", "the unlicense; public domain", "gnu gpl v3",
    ])]
    df = docs.select("doc_id", "text", "doc").unionByName(spark.createDataFrame(more, "doc_id long, text string").withColumn("doc", F.lit(1)))
    got = rows(licenses.scan(df))
    found = licenses.rules()
    assert len(found) > 200
    for k, t in DOCS + more:
        if k not in (6, 7, 8):
            assert tuple(got[k])[1:] == brute.licences(t, found), (k, t)
    assert got[19]["n_base"] == 2 and got[19]["last_word"] == 4 and got[18]["base_labels"] == "apache-2,cc-by-nc,mit"
    assert licenses.scan(empty).count() == 0


def test_rules_hold_their_keyword():
    """Each pattern can only match where a stem of the first gate is."""
    for _, _, _, _, _, pattern in licenses.rules():
        assert any(s in pattern.replace("licen[sc]e", "license") for s in (*licenses.STEMS, "cc by", "public domain"))


def test_language_id(spark, docs, empty):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    got = langid.identify(table).join(table.withColumnRenamed("lang", "true"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == table.count() and 0.1 < len(held) / len(got) < 0.3
    assert sum(r["lang_pred"] == r["true"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = rows(langid.identify(docs))
    assert [odd[k]["lang_pred"] for k in (0, 1, 2, 5)] == ["und"] * 4 and all(odd[k]["score"] == 0 for k in (0, 1, 2, 5))
    assert set(r["lang_pred"] for r in odd.values()) <= {"en", "fr", "und"}
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and set(rows(kept)) == set(range(len(TEXTS))) - {0, 1, 2, 5}
    assert langid.identify(empty).count() == 0


def test_language_stage_without_teachers(spark, docs):
    """No label, or labels of held-out rows only: the texts with a letter stay."""
    held = langid.held_out(F.col("doc_id"))
    for lang in (F.lit(None).cast("string"), F.when(held, F.col("lang"))):
        kept = langid.keep_identified(docs.withColumn("lang", lang))
        assert kept.columns == docs.columns and set(rows(kept)) == set(range(len(TEXTS))) - {0, 1, 2, 5}


def test_language_profiles_by_hand():
    codes, counts = langid.grams("Ab, ab!")
    a, b, edge = ord("a") + 1, ord("b") + 1, 1
    code = lambda *x: sum(c << 21 * i for i, c in enumerate(reversed(x)))
    want = {(a,): 2, (b,): 2, (edge, a): 2, (a, b): 2, (b, edge): 2, (edge, a, b): 2, (a, b, edge): 2}
    assert dict(zip(codes.tolist(), counts.tolist())) == {code(*k): v for k, v in want.items()}
    many = "".join(chr(0x4E00 + i) for i in range(200))  # more letters than the small alphabet
    assert langid.grams(many)[1].sum() == 200 + 201 + 200


def test_mixing(spark, docs, empty):
    got = mixing.mix(docs)
    per = {r["doc_id"]: r for r in got.collect()}
    assert all(per[k]["size"] == len(brute.blank_words(t)) for k, t in DOCS)
    assert all(r["taken"] <= 3 * r["size"] for r in per.values())
    sources = {}
    for r in per.values():
        sources.setdefault(r["source"], []).append(r)
    assert set(sources) == {None, "", "a", "b"}
    total = sum(r["size"] for r in per.values())
    assert sum(v[0]["target"] for v in sources.values()) == pytest.approx(total)
    for s, v in sources.items():
        assert v[0]["source_size"] == sum(r["size"] for r in v) and v[0]["target"] <= 3 * v[0]["source_size"] + 1e-6
    assert sorted(r["taken"] for r in mixing.mix(docs.repartition(5)).collect()) == sorted(r["taken"] for r in per.values())
    emitted = mixing.emit(docs)
    assert emitted.columns == docs.columns and {r["copies"] for r in emitted.collect()} == {7}
    assert emitted.count() == sum(r["copies"] for r in per.values())
    assert mixing.mix(empty).count() == 0 and mixing.emit(empty).count() == 0
    assert [r["taken"] for r in mixing.mix(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).collect()] == [0]


def test_mixing_targets_by_hand(spark):
    # weights 1, 2, 3: "a" may give 30 words at most and gets its share, "b" stops at 3 x 1, "c" takes the rest
    sizes = spark.createDataFrame([("a", 10), ("b", 1), ("c", 49)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    assert got["b"] == 3 and got["a"] == pytest.approx(57 / 4) and got["c"] == pytest.approx(57 * 3 / 4)


def test_quality(spark, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = rows(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    got = rows(quality.classify(table))
    clean = [k for k, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0]
    bad = [k for k in labels if k not in set(clean)]
    assert sum(got[k]["kept"] for k in clean) >= 0.98 * len(clean)
    assert sum(not got[k]["kept"] for k in bad) >= 0.95 * len(bad)
    odd = rows(quality.classify(docs))
    assert all(odd[k]["score"] == 0 and not odd[k]["kept"] for k in (0, 1, 2)) and len(odd) == len(TEXTS)
    assert quality.classify(empty).count() == 0
    assert quality.keep_good(docs).columns == docs.columns
    # one class only: the posterior is the score
    same = spark.createDataFrame([(i, "a plain text") for i in range(3)], "doc_id long, text string")
    assert all(r["kept"] for r in quality.classify(same).collect())


def test_em_prefers_agreeing_labellers():
    patterns = [((1, 1, 1), 700), ((-1, -1, 1), 90), ((-1, -1, -1), 10), ((1, 1, -1), 100), ((-1, 1, 1), 5)]
    good = dict(zip((p for p, _ in patterns), quality.em(patterns)))
    assert good[(1, 1, 1)] > 0.9 and good[(-1, -1, 1)] < 0.1 and good[(-1, -1, -1)] < 0.1 and good[(1, 1, -1)] > 0.5
