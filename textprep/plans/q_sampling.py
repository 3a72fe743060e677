"""Queries: class statistics (G1-G6, G10, J1) and sampling / sharding / batching."""

from __future__ import annotations

from pyspark.sql import functions as F

from textprep.operators import labels as L
from textprep.operators import sampling as B
from textprep.plans import sqltext as S
from textprep.plans.catalog import register, rounded
from textprep.sources.tables import LABELLED_SQL, labelled_corpus, read_table

C_SQL = f"(SELECT doc_id, label FROM {LABELLED_SQL} x)"
SIZES_SQL = f"(SELECT label, count(*) AS n FROM {C_SQL} c GROUP BY label)"


def _ranked_sql(src: str = C_SQL, key: str = "doc_id", seed: int = 42, epoch: int = 0) -> str:
    return f"""(SELECT label, {key}, row_number() OVER (PARTITION BY label ORDER BY {S.hash_hex(seed, "'row'", epoch, key)}, {key}) AS rn,
                count(*) OVER (PARTITION BY label) AS n FROM {src} c)"""


def _draw_sql(targets: str, src: str = C_SQL, key: str = "doc_id", seed: int = 42, epoch: int = 0) -> str:
    """targets: (label, target)."""
    r = _ranked_sql(src, key, seed, epoch)
    sizes = f"(SELECT label, count(*) AS n FROM {src} c GROUP BY label)"
    return f"""(
      SELECT r.label, r.rn AS j, r.{key} FROM {r} r JOIN {targets} t ON r.label = t.label
       WHERE t.target <= r.n AND r.rn <= t.target
      UNION ALL
      SELECT d.label, d.j, r.{key}
        FROM (SELECT s.label, s.n, unnest(generate_series(1, t.target)) AS j
                FROM {sizes} s JOIN {targets} t ON s.label = t.label WHERE t.target > s.n) d
        JOIN {r} r ON r.label = d.label
         AND r.rn = CAST(floor({S.uniform(seed, "'draw'", epoch, 'd.label', 'd.j')} * d.n) AS BIGINT) + 1)"""


def _sample_out(df, key="doc_id"):
    return df.select(F.col("label").cast("long"), F.col("j").cast("long"), F.col(key).cast("long"))


SAMPLE_OUT_SQL = "CAST(label AS BIGINT) AS label, CAST(j AS BIGINT) AS j, CAST(doc_id AS BIGINT) AS doc_id"


# --- class statistics ---------------------------------------------------------------------------

@register("g1_class_weights", f"""SELECT CAST(label AS BIGINT) AS label, CAST(n AS BIGINT) AS n,
    round(sum(n) OVER () / n, 6) AS w FROM {SIZES_SQL} s""")
def q_g1(spark, sf_dir):
    w = L.class_weights(labelled_corpus(spark, sf_dir))
    return w.select(F.col("label").cast("long"), F.col("n").cast("long"), rounded("w", "w"))


@register("g2_sample_weights", f"""SELECT c.doc_id, CAST(c.label AS BIGINT) AS label, round(w.w, 6) AS w
    FROM {C_SQL} c LEFT JOIN (SELECT label, sum(n) OVER () / n AS w FROM {SIZES_SQL} s) w ON c.label = w.label""")
def q_g2(spark, sf_dir):
    d = L.sample_weights(labelled_corpus(spark, sf_dir).select("doc_id", "label"))
    return d.select("doc_id", F.col("label").cast("long"), rounded("w", "w"))


@register("g3_inverse_weights", f"""SELECT CAST(label AS BIGINT) AS label, round(1.0 / n, 6) AS w FROM {SIZES_SQL} s""")
def q_g3(spark, sf_dir):
    w = L.class_weights(labelled_corpus(spark, sf_dir), scheme="inverse")
    return w.select(F.col("label").cast("long"), rounded("w", "w"))


@register("g4_class_proportions", """SELECT l_returnflag AS label, CAST(count(*) AS BIGINT) AS n,
    round(count(*) / sum(count(*)) OVER (), 6) AS prop FROM lineitem GROUP BY l_returnflag""")
def q_g4(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label"))
    p = L.class_proportions(li)
    return p.select("label", F.col("n").cast("long"), rounded("prop", "prop"))


@register("g6_class_size_range", f"""SELECT CAST(min(n) AS BIGINT) AS min_n, CAST(max(n) AS BIGINT) AS max_n,
    CAST(count(*) AS BIGINT) AS n_classes FROM {SIZES_SQL} s""")
def q_g6(spark, sf_dir):
    r = L.class_size_range(labelled_corpus(spark, sf_dir))
    return r.select(*[F.col(c).cast("long") for c in ("min_n", "max_n", "n_classes")])


@register("g10_distinct_labels", """SELECT DISTINCT l_returnflag || l_linestatus AS label,
    CAST((SELECT count(DISTINCT l_returnflag || l_linestatus) FROM lineitem) AS BIGINT) AS n_distinct FROM lineitem""")
def q_g10(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("label"))
    labels = li.distinct()
    return labels.select("label", F.lit(labels.count()).cast("long").alias("n_distinct"))


# --- sampling -------------------------------------------------------------------------------

@register("b1_downsample", f"""SELECT {SAMPLE_OUT_SQL} FROM {_draw_sql(f"(SELECT label, min(n) OVER () AS target FROM {SIZES_SQL} s)")} q""")
def q_b1(spark, sf_dir):
    return _sample_out(B.balanced_sample(labelled_corpus(spark, sf_dir), "label", "doc_id", "downsampling"))


@register("b2_upsample", f"""SELECT {SAMPLE_OUT_SQL} FROM {_draw_sql(f"(SELECT label, max(n) OVER () AS target FROM {SIZES_SQL} s)")} q""")
def q_b2(spark, sf_dir):
    return _sample_out(B.balanced_sample(labelled_corpus(spark, sf_dir), "label", "doc_id", "upsampling"))


@register("b3_fixed_per_class", f"""SELECT {SAMPLE_OUT_SQL} FROM {_draw_sql(f"(SELECT label, 100 AS target FROM {SIZES_SQL} s)")} q""")
def q_b3(spark, sf_dir):
    return _sample_out(B.balanced_sample(labelled_corpus(spark, sf_dir), "label", "doc_id", 100))


_LI_SRC = "(SELECT l_returnflag AS label, l_orderkey * 8 + l_linenumber AS lkey FROM lineitem)"


@register("b2_upsample_lineitem", f"""SELECT label, CAST(j AS BIGINT) AS j, CAST(lkey AS BIGINT) AS lkey FROM
    {_draw_sql(f"(SELECT label, max(n) OVER () AS target FROM (SELECT label, count(*) n FROM {_LI_SRC} a GROUP BY label) s)", _LI_SRC, 'lkey')} q""")
def q_b2_li(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("label"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("lkey")
    )
    s = B.balanced_sample(li, "label", "lkey", "upsampling")
    return s.select("label", F.col("j").cast("long"), F.col("lkey").cast("long"))


_DYN_SQL = f"""(SELECT CAST(e AS BIGINT) AS epoch, s.label, s.n,
      CAST(floor(pow(s.n / m.mn, pow(0.9::DOUBLE, e::DOUBLE)) * m.mn) AS BIGINT) AS target
    FROM {SIZES_SQL} s, (SELECT min(n) AS mn FROM {SIZES_SQL} z) m, (SELECT unnest(generate_series(0, 59)) AS e) t)"""


@register("b4_dynamic_schedule", f"""SELECT epoch, CAST(label AS BIGINT) AS label, CAST(n AS BIGINT) AS n, target FROM {_DYN_SQL} q""")
def q_b4_sched(spark, sf_dir):
    t = B.dynamic_targets(labelled_corpus(spark, sf_dir), 60)
    return t.select(F.col("epoch").cast("long"), F.col("label").cast("long"), F.col("n").cast("long"), "target")


@register("b4_dynamic_draw", f"""SELECT {SAMPLE_OUT_SQL} FROM
    {_draw_sql(f"(SELECT label, target FROM {_DYN_SQL} q WHERE epoch = 3)", epoch=3)} z""")
def q_b4_draw(spark, sf_dir):
    return _sample_out(B.dynamic_sample(labelled_corpus(spark, sf_dir), 3, "label", "doc_id"))


def _weighted_sql(n: int = 1000, seed: int = 42, epoch: int = 0) -> str:
    cls = f"""(SELECT label, n, coalesce(sum(m) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(m) OVER () AS lo,
                 CASE WHEN row_number() OVER (ORDER BY label DESC) = 1 THEN 2.0
                      ELSE sum(m) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(m) OVER () END AS hi
          FROM (SELECT label, n, (sum(n) OVER ()::DOUBLE / n) * n AS m FROM {SIZES_SQL} s))"""
    draws = f"""(SELECT j, {S.uniform(seed, "'class'", epoch, 'j - 1')} AS u, {S.uniform(seed, "'row'", epoch, 'j - 1')} AS u2
          FROM (SELECT unnest(generate_series(1, {n})) AS j))"""
    return f"""(SELECT c.label, d.j, r.doc_id FROM {draws} d JOIN {cls} c ON d.u >= c.lo AND d.u < c.hi
        JOIN {_ranked_sql()} r ON r.label = c.label AND r.rn = CAST(floor(d.u2 * c.n) AS BIGINT) + 1)"""


def weighted(spark, sf_dir, n: int = 1000):
    c = labelled_corpus(spark, sf_dir)
    return B.weighted_sample(c, n, L.class_weights(c), "label", "doc_id")


@register("b5_weighted_sample", f"SELECT {SAMPLE_OUT_SQL} FROM {_weighted_sql()} q")
def q_b5(spark, sf_dir):
    return _sample_out(weighted(spark, sf_dir))


def _shard_sql(sample: str, R: int, seed: int = 42, epoch: int = 0) -> str:
    p = f"""(SELECT *, row_number() OVER (ORDER BY {S.hash_hex(seed, "'perm'", epoch, 'label', 'j')}, label, j) - 1 AS p0,
                    count(*) OVER () AS L FROM {sample} s)"""
    pad = f"(CAST(ceil(L / {R}) AS BIGINT) * {R} - L)"
    allpos = f"""(SELECT label, j, doc_id, p0 AS pos FROM {p} a
        UNION ALL
        SELECT label, j, doc_id, L + p0 + m * L AS pos
          FROM (SELECT *, unnest(generate_series(0, CAST(ceil(({pad} - p0) / L) AS BIGINT) - 1)) AS m FROM {p} b WHERE p0 < {pad}) c)"""
    return f"(SELECT *, CAST(pos % {R} AS INTEGER) AS shard, pos // {R} AS local_pos FROM {allpos} d)"


_B1_SQL = _draw_sql(f"(SELECT label, min(n) OVER () AS target FROM {SIZES_SQL} s)")


@register("b6_shard", f"""SELECT {SAMPLE_OUT_SQL}, CAST(pos AS BIGINT) AS pos, CAST(shard AS BIGINT) AS shard,
    CAST(local_pos AS BIGINT) AS local_pos FROM {_shard_sql(_B1_SQL, 5)} q""")
def q_b6(spark, sf_dir):
    s = B.shard(B.balanced_sample(labelled_corpus(spark, sf_dir), "label", "doc_id", "downsampling"), 5)
    return s.select(
        F.col("label").cast("long"), F.col("j").cast("long"), F.col("doc_id").cast("long"),
        F.col("pos").cast("long"), F.col("shard").cast("long"), F.col("local_pos").cast("long"),
    )


@register("b7_batches_drop_last", f"""SELECT CAST(shard AS BIGINT) AS shard, CAST(local_pos AS BIGINT) AS local_pos,
    CAST(local_pos // 3 AS BIGINT) AS batch_id, CAST(local_pos % 3 AS BIGINT) AS in_batch, CAST(doc_id AS BIGINT) AS doc_id
    FROM (SELECT *, count(*) OVER (PARTITION BY shard) AS gn FROM {_shard_sql(_B1_SQL, 5)} q) z
    WHERE local_pos // 3 < gn // 3""")
def q_b7(spark, sf_dir):
    s = B.shard(B.balanced_sample(labelled_corpus(spark, sf_dir), "label", "doc_id", "downsampling"), 5)
    b = B.batches(s, 3, drop_last=True)
    return b.select(*[F.col(c).cast("long") for c in ("shard", "local_pos", "batch_id", "in_batch", "doc_id")])


@register("b7_batches_shuffled", f"""SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(p // 32 AS BIGINT) AS batch_id, CAST(p % 32 AS BIGINT) AS in_batch
    FROM (SELECT doc_id, row_number() OVER (ORDER BY {S.hash_hex(42, "'batch'", 0, 'doc_id')}, doc_id) - 1 AS p FROM {C_SQL} c)""")
def q_b7_shuffled(spark, sf_dir):
    c = labelled_corpus(spark, sf_dir).select("doc_id", "label")
    b = B.batches(c, 32, group_col=None, shuffle=True, id_cols=("doc_id",))
    return b.select(F.col("doc_id").cast("long"), F.col("batch_id").cast("long"), F.col("in_batch").cast("long"))


@register("g5_balance_report", f"""SELECT CAST(shard AS BIGINT) AS shard, CAST(sum(n) AS BIGINT) AS size, CAST(count(*) AS BIGINT) AS n_classes,
      round(avg(prop), 6) AS mean_prop, round(stddev_samp(prop), 6) AS std_prop
    FROM (SELECT shard, label, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY shard) AS prop
            FROM {_shard_sql(_weighted_sql(), 2)} q GROUP BY shard, label) z GROUP BY shard""")
def q_g5(spark, sf_dir):
    s = B.shard(weighted(spark, sf_dir), 2)
    r = L.balance_report(s, "shard")
    return r.select(
        F.col("shard").cast("long"), F.col("size").cast("long"), F.col("n_classes").cast("long"),
        rounded("mean_prop", "mean_prop"), rounded("std_prop", "std_prop"),
    )


@register("b5_weighted_rows_sample", f"""WITH r AS (
      SELECT lkey, w, coalesce(sum(w) OVER (ORDER BY h, lkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo
        FROM (SELECT l_orderkey * 8 + l_linenumber AS lkey, CAST(l_quantity AS DOUBLE) AS w,
                     {S.hash_hex(42, "'wrow'", 'l_orderkey * 8 + l_linenumber')} AS h FROM lineitem WHERE l_quantity > 0) a),
    t AS (SELECT sum(w) AS total FROM r),
    d AS (SELECT j, {S.uniform(42, "'wdraw'", 0, 'j - 1')} * t.total AS x FROM (SELECT unnest(generate_series(1, 2000)) AS j) g, t)
    SELECT CAST(d.j AS BIGINT) AS j, CAST(r.lkey AS BIGINT) AS lkey FROM d ASOF JOIN r ON d.x >= r.lo""")
def q_b5_rows(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("lkey"), F.col("l_quantity").alias("w")
    )
    s = B.weighted_rows_sample(li, 2000, "w", "lkey")
    return s.select(F.col("j").cast("long"), F.col("lkey").cast("long"))


# --- ranked store: one ranking for all epochs ---------------------------------------------------------

def _store_sql(targets: str, rounds: int = 6, seed: int = 42) -> str:
    """targets: (epoch, label, target).  Ranks once, then each draw's rank by the rounds of the permutation."""
    ranked = f"""(SELECT label, doc_id, row_number() OVER (PARTITION BY label ORDER BY {S.hash_hex(seed, "'row'", 'doc_id')}, doc_id) AS rn FROM {C_SQL} c)"""
    step = f"""(SELECT t.epoch, t.label, t.target, s.n, unnest(generate_series(1, t.target)) AS j FROM {targets} t JOIN {SIZES_SQL} s ON s.label = t.label)"""
    step = f"(SELECT *, j - 1 AS x FROM {step} d)"
    for r in range(1, rounds + 1):
        key = f"CAST(floor({S.uniform(seed, "'key'", 'epoch', 'label', r)} * n) AS BIGINT)"
        step = f"(SELECT *, ({key} - x + n) % n AS y{r} FROM {step} a{r})"
        swap = f"substr({S.hash_hex(seed, "'swap'", 'epoch', 'label', r, f'greatest(x, y{r})')}, 1, 1) < '8'"
        step = f"(SELECT * EXCLUDE (x), CASE WHEN {swap} THEN y{r} ELSE x END AS x FROM {step} b{r})"
    again = f"CAST(floor({S.uniform(seed, "'draw'", 'epoch', 'label', 'j')} * n) AS BIGINT)"
    return f"""(SELECT p.epoch, p.label, p.j, r.doc_id FROM (SELECT *, CASE WHEN target <= n THEN x ELSE {again} END + 1 AS rn FROM {step} z) p
        JOIN {ranked} r ON r.label = p.label AND r.rn = p.rn)"""


def ranked_corpus(spark, sf_dir):
    from textprep.operators import ranked_store as RS

    return spark.table(RS.write_ranked(labelled_corpus(spark, sf_dir), "label", "doc_id"))


@register("b1_ranked_epochs", f"""SELECT CAST(epoch AS BIGINT) AS epoch, {SAMPLE_OUT_SQL} FROM
    {_store_sql(f"(SELECT e AS epoch, label, min(n) OVER (PARTITION BY e) AS target FROM {SIZES_SQL} s, (SELECT unnest([0, 1, 2]) AS e) g)")} q""")
def q_b1_ranked(spark, sf_dir):
    """B1 of three epochs from one ranked store."""
    from textprep.operators import ranked_store as RS

    store = ranked_corpus(spark, sf_dir)
    found = RS.draw_epochs(store, RS.epoch_targets(store, [0, 1, 2]), "label", "doc_id")
    return found.select(F.col("epoch").cast("long"), F.col("label").cast("long"), "j", F.col("doc_id").cast("long"))


@register("b4_ranked_epochs", f"""SELECT CAST(epoch AS BIGINT) AS epoch, CAST(label AS BIGINT) AS label, count(*) AS n_draws, count(DISTINCT doc_id) AS n_keys,
    CAST(sum((j * 31 + doc_id) % 1000003) AS BIGINT) AS mixed FROM {_store_sql(f"(SELECT epoch, label, target FROM {_DYN_SQL} y)")} q GROUP BY epoch, label""")
def q_b4_ranked(spark, sf_dir):
    """All 60 epochs of the dynamic schedule from one ranked store."""
    from textprep.operators import ranked_store as RS

    store = ranked_corpus(spark, sf_dir)
    targets = B.dynamic_targets(store, 60, ignore_warning=True).select("epoch", "label", "target")
    found = RS.draw_epochs(store, targets, "label", "doc_id")
    mixed = F.sum((F.col("j") * 31 + F.col("doc_id")) % 1000003)
    g = found.groupBy("epoch", "label").agg(F.count(F.lit(1)).alias("n_draws"), F.countDistinct("doc_id").alias("n_keys"), mixed.alias("mixed"))
    return g.select(*[F.col(c).cast("long") for c in ("epoch", "label", "n_draws", "n_keys", "mixed")])


# --- shard files: written once, read from the middle ---------------------------------------------------

@register("b7_shard_files_resume", f"""SELECT CAST(shard AS BIGINT) AS shard, CAST(local_pos // 3 AS BIGINT) AS batch_id, CAST(local_pos % 3 AS BIGINT) AS in_batch,
    CAST(doc_id AS BIGINT) AS doc_id FROM {_shard_sql(_B1_SQL, 5)} q WHERE local_pos // 3 >= 2""")
def q_b7_files(spark, sf_dir):
    """Batches of five shards as files; every shard is then read from its third batch on."""
    from functools import reduce

    from textprep.plans.q_tokens import _scratch
    from textprep.sources import shard_files as SF

    path = _scratch(spark, "shards")
    s = B.shard(B.balanced_sample(labelled_corpus(spark, sf_dir), "label", "doc_id", "downsampling"), 5)
    SF.write_shards(B.batches(s, 3).select("shard", "batch_id", "in_batch", "doc_id"), path, batches_per_part=4)
    rows = reduce(lambda a, b: a.unionByName(b), [SF.read_from(spark, path, k, 2) for k in range(5)])
    return rows.select(*[F.col(c).cast("long") for c in ("shard", "batch_id", "in_batch", "doc_id")])


@register("b7_shard_manifest", f"""SELECT shard, batch_id // 4 AS part, min(batch_id) AS first_batch, max(batch_id) AS last_batch, count(*) AS rows,
    count(DISTINCT batch_id) AS batches, CAST(coalesce(sum(count(*)) OVER (PARTITION BY shard ORDER BY batch_id // 4 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_row
    FROM (SELECT CAST(shard AS BIGINT) AS shard, CAST(local_pos // 3 AS BIGINT) AS batch_id FROM {_shard_sql(_B1_SQL, 5)} q) z GROUP BY shard, batch_id // 4""")
def q_b7_manifest(spark, sf_dir):
    """The manifest of such files."""
    from textprep.plans.q_tokens import _scratch
    from textprep.sources import shard_files as SF

    path = _scratch(spark, "shards")
    s = B.shard(B.balanced_sample(labelled_corpus(spark, sf_dir), "label", "doc_id", "downsampling"), 5)
    SF.write_shards(B.batches(s, 3).select("shard", "batch_id", "in_batch", "doc_id"), path, batches_per_part=4)
    return SF.read_manifest(spark, path).select(*[F.col(c).cast("long") for c in ("shard", "part", "first_batch", "last_batch", "rows", "batches", "first_row")])
