"""Plan shape checks: pruning reaches the scan, dedup is one shuffle, folds rank inside
(label, hash bucket) partitions, small vocabularies are broadcast."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_CHECK
from textprep.operators import tokens as TK


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def static_plans(spark):
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", old)


def test_scan_reads_only_needed_columns(spark, static_plans):
    plan = plan_of(E.queries()["p12_clean_text_full"](spark, SF_CHECK))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_dedup_moves_hashes_not_text(spark, static_plans):
    plan = plan_of(E.queries()["p10_dedup_near"](spark, SF_CHECK))
    assert "SortAggregate" not in plan
    keys = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert keys and not any(c in line.split("ENSURE")[0] for line in keys for c in ("title", "goal", "content", "effect"))
    assert any("_h1" in line for line in keys)


def test_pooling_is_one_shuffle_without_explode(spark, static_plans):
    plan = plan_of(E.queries()["e4_mean_max_concat"](spark, SF_CHECK))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "Generate" not in plan


def test_fold_rank_window_is_bucketed(spark, static_plans):
    plan = plan_of(E.queries()["f1_stratified_folds"](spark, SF_CHECK))
    windows = [l for l in plan.splitlines() if "Window [" in l and "row_number()" in l]
    assert windows and all("_hb" in l.split("row_number()")[1] for l in windows)


def test_small_vocab_lookup_is_broadcast(spark, static_plans):
    v = TK.build_vocab(spark.createDataFrame([("a b c",)], "text string"), "text")
    toks = spark.createDataFrame([(0, "a")], "p int, token string")
    plan = plan_of(TK.lookup_ids(toks, v))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_draw_lists_are_not_broadcast(spark):
    """Draws with replacement are made of few rows and look as small to Spark, whatever their number."""
    from textprep.operators import ranked_store as RS
    from textprep.operators import sampling as B

    rows = spark.createDataFrame([(c, 10 * i + c) for c, n in ((0, 40), (1, 3)) for i in range(n)], "label int, index long")
    store = spark.table(RS.write_ranked(rows))
    epochs = RS.draw_epochs(store, RS.epoch_targets(store, [0], "upsampling"))
    for sample in (B.balanced_sample(rows, mode="upsampling"), epochs):
        assert len(sample.collect()) == 80
        joins = [line for line in plan_of(sample).splitlines() if re.search(r"Join \[label#\d+, _?rn#", line)]
        assert joins and all("SortMergeJoin" in line for line in joins), joins
