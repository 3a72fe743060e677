"""The ranked store: exact counts, permutations, hot and tiny classes, and plans that leave the rows where they are."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from textprep.operators import ranked_store as RS
from textprep.operators import sampling as B


@pytest.fixture(scope="module")
def rows(spark):
    n = {0: 700, 1: 90, 2: 7, 3: 1}  # one class has most rows
    data = [(c, 1000 * c + i) for c, k in n.items() for i in range(k)] + [(None, 9000 + i) for i in range(5)]
    return spark.createDataFrame(data, "label int, index long").repartition(5)


@pytest.fixture(scope="module")
def store(spark, rows):
    return spark.table(RS.write_ranked(rows, seed=3))


def test_ranks(rows, store):
    got = defaultdict(list)
    for r in store.collect():
        got[r["label"]].append((r["rn"], r["n"], r["index"]))
    assert {c: sorted(x[0] for x in v) for c, v in got.items()} == {c: list(range(1, len(v) + 1)) for c, v in got.items()}
    assert {c: {x[1] for x in v} for c, v in got.items()} == {0: {700}, 1: {90}, 2: {7}, 3: {1}}


@pytest.mark.parametrize("mode", ["downsampling", "upsampling", 5])
def test_epochs(store, mode):
    epochs = [0, 1, 2, 7]
    found = RS.draw_epochs(store, RS.epoch_targets(store, epochs, mode), seed=3).collect()
    want = {"downsampling": 1, "upsampling": 700}.get(mode, mode)
    sizes = {0: 700, 1: 90, 2: 7, 3: 1}
    by = defaultdict(list)
    for r in found:
        by[r["epoch"], r["label"]].append((r["j"], r["index"]))
    assert set(by) == {(e, c) for e in epochs for c in sizes}
    for (_, c), draws in by.items():
        assert sorted(j for j, _ in draws) == list(range(1, want + 1))
        if want <= sizes[c]:
            assert len({k for _, k in draws}) == want  # without replacement
        assert all(k // 1000 == c for _, k in draws)


def test_epochs_differ_and_repeat(store):
    t = RS.epoch_targets(store, [0, 1], 50)
    draw = lambda: {(r["epoch"], r["label"], r["j"]): r["index"] for r in RS.draw_epochs(store, t, seed=3).collect()}
    first = draw()
    assert first == draw()
    order = lambda e: [first[e, 0, j] for j in range(1, 51)]
    assert order(0) != order(1) and sorted(order(0)) != sorted(order(1))


def test_rows_are_drawn_evenly(store):
    found = RS.draw_epochs(store, RS.epoch_targets(store, list(range(200)), 30), seed=3).where("label = 1").collect()
    times = Counter(r["index"] for r in found)
    assert len(times) == 90 and min(times.values()) > 35 and max(times.values()) < 100  # 66.7 expected


def test_dynamic_schedule(store):
    t = B.dynamic_targets(store, 5, ignore_warning=True)
    want = {(r["epoch"], r["label"]): r["target"] for r in t.collect()}
    got = Counter((r["epoch"], r["label"]) for r in RS.draw_epochs(store, t.select("epoch", "label", "target")).collect())
    assert got == {k: v for k, v in want.items() if v}


def test_rows_are_not_shuffled_by_any_epoch(spark, store):
    """All 60 epochs: the only exchanges are of draws."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    old = {n: spark.conf.get(n, None) for n in names}
    for n, v in zip(names, ("-1", "-1", "false")):
        spark.conf.set(n, v)
    try:
        t = B.dynamic_targets(store, 60, ignore_warning=True).select("epoch", "label", "target")
        plan = RS.draw_epochs(store, t)._jdf.queryExecution().executedPlan().toString()
    finally:
        for n, v in old.items():
            spark.conf.set(n, v) if v is not None else spark.conf.unset(n)
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    above, indent = [], depth(lines[at])
    for line in reversed(lines[:at]):  # from the scan to its ancestors
        if depth(line) < indent:
            above.append(line)
            indent = depth(line)
    to_join = above[: next(i for i, line in enumerate(above) if "SortMergeJoin" in line)]
    assert to_join and not any("Exchange" in line for line in to_join)


def test_opened_by_another_application(spark, rows, tmpdir_run):
    path = f"{tmpdir_run}/store"
    name = RS.write_ranked(rows, seed=3, path=path, buckets=8)
    t = RS.epoch_targets(spark.table(name), [0], 5)
    before = {tuple(r) for r in RS.draw_epochs(spark.table(name), t, seed=3).collect()}
    again = RS.open_ranked(spark, f"{name}_again", path, "label int, rn bigint, n bigint, index bigint", 8)
    assert {tuple(r) for r in RS.draw_epochs(again, t, seed=3).collect()} == before


def test_without_rows(spark):
    empty = spark.table(RS.write_ranked(spark.createDataFrame([], "label int, index long")))
    assert RS.draw_epochs(empty, RS.epoch_targets(empty, [0])).collect() == []
