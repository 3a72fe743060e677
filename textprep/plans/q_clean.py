"""Queries: record cleaning on the ``projects`` view (P1-P11, P14, P18, P19) and label
operators (P15-P17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textprep.functions.text import clean_text_full, sentences
from textprep.operators import clean as C
from textprep.operators import labels as L
from textprep.operators.folds import stratified_folds
from textprep.plans import sqltext as S
from textprep.plans.catalog import register
from textprep.plans.q_prep import _folds_sql
from textprep.sources.tables import PROJECTS_SQL, labelled_corpus, projects, read_table

# ---------------------------------------------------------------------------------------------
# Drop lists and placeholder of the fixture (FIXTURES.md §3), in place of the
# reference's Korean lists.
FIXTURE_RULES = C.CleanRules(
    drop_ministries=["de", "es"],
    drop_titles=["And therhean is the is esndha reedes ha.", "In in oredble ea."],
    drop_title_pattern="En laleen",
    placeholders={
        "goal": ["Of.", "The and attion to thanedble the, anea. Eriner thanea."],
        "content": ["The and attion to thanedble the, anea. Eriner thanea.", "Ascirr para osóciónta cióngañ no.", "Atble."],
        "effect": ["The and attion to thanedble the, anea. Eriner thanea."],
    },
)
# ---------------------------------------------------------------------------------------------



def _in(col: str, values: list[str]) -> str:
    return f"coalesce({col} IN ({', '.join(chr(39) + v + chr(39) for v in values)}), false)"


_MINISTRY_SQL = _in("ministry", FIXTURE_RULES.drop_ministries)
_TITLE_SQL = _in("title", FIXTURE_RULES.drop_titles)
_FIELD_SQL = {c: _in(c, v) for c, v in FIXTURE_RULES.placeholders.items()}

ALL_COLS = ["title", "goal", "content", "effect", "keywords_ko", "keywords_en", "year", "continuing", "ministry"]
NEAR_COLS = ["title", "goal", "content", "effect", "keywords_ko", "keywords_en", "ministry"]
TXT = C.TEXT_COLS


def _keep_first_sql(src: str, keys: list[str], extra: str = "") -> str:
    nulls = " OR ".join(f"{k} IS NULL" for k in keys)
    return f"""(SELECT * FROM {src} q QUALIFY row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY "index") = 1
               OR {nulls} {extra})"""


def _out_cols(extra: list[str] | None = None) -> str:
    cols = ['CAST("index" AS BIGINT) AS "index"'] + [c for c in ["title", "goal", "content", "effect", "keywords_ko", "keywords_en", "ministry"]]
    cols += ["CAST(year AS BIGINT) AS year", "CAST(continuing AS BIGINT) AS continuing"]
    return ", ".join(cols + (extra or []))


def _spark_out(df, extra: list[str] | None = None):
    return df.select(
        F.col("index").cast("long"), *[c for c in ["title", "goal", "content", "effect", "keywords_ko", "keywords_en", "ministry"]],
        F.col("year").cast("long"), F.col("continuing").cast("long"), *(extra or []),
    )


@register("p1_concat_text", f"""SELECT CAST("index" AS BIGINT) AS "index",
    concat_ws(' ', {', '.join(f"coalesce({c}, ' ')" for c in TXT)}) AS data,
    {S.clean_full("concat_ws(' ', " + ', '.join(f"coalesce({c}, ' ')" for c in TXT) + ")")} AS data_cleaned
    FROM {PROJECTS_SQL} p""")
def q_p1(spark, sf_dir):
    d = C.prep_text(projects(spark, sf_dir), include_keywords=True, is_test=True)
    return d.select(F.col("index").cast("long"), "data", "data_cleaned")


@register("p2_text_columns_no_keywords", f"""SELECT CAST("index" AS BIGINT) AS "index",
    concat_ws(' ', {', '.join(f"coalesce({c}, ' ')" for c in C.BASE_TEXT_COLS)}) AS data
    FROM {PROJECTS_SQL} p""")
def q_p2(spark, sf_dir):
    d = C.prep_text(projects(spark, sf_dir), include_keywords=False, is_test=True)
    return d.select(F.col("index").cast("long"), "data")


@register("p3_null_fill_empty", f"""SELECT CAST("index" AS BIGINT) AS "index",
    {', '.join(f"coalesce({c}, '') AS {c}" for c in TXT)} FROM {PROJECTS_SQL} p""")
def q_p3(spark, sf_dir):
    d = projects(spark, sf_dir).na.fill("", subset=TXT)
    return d.select(F.col("index").cast("long"), *TXT)


@register("p4_drop_ministries", f"SELECT {_out_cols()} FROM {PROJECTS_SQL} p WHERE NOT {_MINISTRY_SQL}")
def q_p4(spark, sf_dir):
    return _spark_out(C.drop_values(projects(spark, sf_dir), "ministry", FIXTURE_RULES.drop_ministries))


@register("p5_drop_titles", f"""SELECT {_out_cols()} FROM {PROJECTS_SQL} p
    WHERE NOT {_TITLE_SQL}""")
def q_p5(spark, sf_dir):
    return _spark_out(C.drop_values(projects(spark, sf_dir), "title", FIXTURE_RULES.drop_titles))


@register("p6_drop_title_pattern", f"""SELECT {_out_cols()} FROM {PROJECTS_SQL} p
    WHERE NOT coalesce(regexp_matches(title, 'En laleen'), false)""")
def q_p6(spark, sf_dir):
    return _spark_out(C.drop_matching(projects(spark, sf_dir), "title", FIXTURE_RULES.drop_title_pattern))


@register("p7_drop_all_null", f"""SELECT {_out_cols()} FROM {PROJECTS_SQL} p
    WHERE NOT (goal IS NULL AND content IS NULL AND effect IS NULL)""")
def q_p7(spark, sf_dir):
    return _spark_out(C.drop_all_null(projects(spark, sf_dir)))


@register("p8_placeholders_field", f"""SELECT CAST("index" AS BIGINT) AS "index", title,
    {', '.join(f"CASE WHEN {cond} THEN NULL ELSE {c} END AS {c}" for c, cond in _FIELD_SQL.items())}
    FROM {PROJECTS_SQL} p""")
def q_p8_field(spark, sf_dir):
    d = C.null_placeholders(projects(spark, sf_dir), FIXTURE_RULES.placeholders, mode="field")
    return d.select(F.col("index").cast("long"), "title", "goal", "content", "effect")


_PH = "(" + " OR ".join(_FIELD_SQL.values()) + ")"
_P8_COMPAT_SQL = f"""(SELECT "index", {_PH} AS is_placeholder,
    {', '.join(f"CASE WHEN {_PH} THEN NULL ELSE {c} END AS {c}" for c in ALL_COLS)} FROM {PROJECTS_SQL} p)"""


@register("p8_placeholders_compat", f"SELECT {_out_cols(['is_placeholder'])} FROM {_P8_COMPAT_SQL} q")
def q_p8_compat(spark, sf_dir):
    d = C.null_placeholders(projects(spark, sf_dir), FIXTURE_RULES.placeholders, mode="compat")
    return _spark_out(d, ["is_placeholder"])


@register("p9_dedup_full_row", f"SELECT {_out_cols()} FROM {_keep_first_sql(PROJECTS_SQL, ALL_COLS)} x")
def q_p9(spark, sf_dir):
    return _spark_out(C.dedup_keep_first(projects(spark, sf_dir), ALL_COLS, "index"))


@register("p10_dedup_near", f"SELECT {_out_cols()} FROM {_keep_first_sql(PROJECTS_SQL, NEAR_COLS)} x")
def q_p10(spark, sf_dir):
    return _spark_out(C.dedup_keep_first(projects(spark, sf_dir), NEAR_COLS, "index"))


_CLEANED_COLS = [f"{c}_cleaned" for c in TXT]
_P11_SRC = f"""(SELECT "index", {', '.join(f"{S.clean_full(f'coalesce({c}, {chr(39)}{chr(39)})')} AS {c}_cleaned" for c in TXT)}
    FROM {PROJECTS_SQL} p)"""


@register("p11_dedup_cleaned_text", f"""SELECT CAST("index" AS BIGINT) AS "index", {', '.join(_CLEANED_COLS)}
    FROM {_keep_first_sql(_P11_SRC, _CLEANED_COLS)} x""")
def q_p11(spark, sf_dir):
    d = projects(spark, sf_dir).na.fill("", subset=TXT)
    d = d.select("index", *[clean_text_full(c).alias(f"{c}_cleaned") for c in TXT])
    d = C.dedup_keep_first(d, _CLEANED_COLS, "index")
    return d.select(F.col("index").cast("long"), *_CLEANED_COLS)


def _p18_sql() -> str:
    p9_then_p10 = _keep_first_sql(_keep_first_sql(PROJECTS_SQL, ALL_COLS), NEAR_COLS)
    filt = f"""(SELECT * FROM {p9_then_p10} a
        WHERE NOT {_MINISTRY_SQL}
          AND NOT (goal IS NULL AND content IS NULL AND effect IS NULL)
          AND NOT {_TITLE_SQL}
          AND NOT coalesce(regexp_matches(title, 'En laleen'), false))"""
    ph = f"""(SELECT "index", {_PH} AS is_placeholder,
        {', '.join(f"CASE WHEN {_PH} THEN NULL ELSE {c} END AS {c}" for c in ALL_COLS)} FROM {filt} b)"""
    filled = f"""(SELECT "index", is_placeholder, {', '.join(f"coalesce({c}, '') AS {c}" for c in TXT)},
        year, continuing, ministry FROM {ph} c)"""
    cleaned = f"""(SELECT *, {', '.join(f"{S.clean_full(c)} AS {c}_cleaned" for c in TXT)} FROM {filled} d)"""
    keys = ", ".join(_CLEANED_COLS)
    final = f"""(SELECT * FROM {cleaned} e QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY "index") = 1 OR is_placeholder)"""
    return f"""SELECT CAST("index" AS BIGINT) AS "index", is_placeholder, {keys}, ministry,
        CAST(year AS BIGINT) AS year, CAST(continuing AS BIGINT) AS continuing FROM {final} f"""


def cleaned_projects(spark, sf_dir):
    return C.clean_records(projects(spark, sf_dir), FIXTURE_RULES)


@register("p18_clean_records", _p18_sql())
def q_p18(spark, sf_dir):
    d = cleaned_projects(spark, sf_dir)
    return d.select(
        F.col("index").cast("long"), "is_placeholder", *_CLEANED_COLS, "ministry",
        F.col("year").cast("long"), F.col("continuing").cast("long"),
    )


@register("p19_survivors", f"""SELECT {_out_cols()} FROM {PROJECTS_SQL} p
    WHERE "index" IN (SELECT "index" FROM ({_p18_sql()}) s)""")
def q_p19(spark, sf_dir):
    return _spark_out(C.survivors(projects(spark, sf_dir), cleaned_projects(spark, sf_dir)))


def _sentences_sql(cols: list[str]) -> str:
    parts = ", ".join(f"coalesce(string_split({c}, chr(10)), []::VARCHAR[])" for c in cols)
    arr = f"flatten([{parts}])"
    arr = f"list_filter(list_transform({arr}, lambda s: {S.py_strip('s')}), lambda s: length(s) > 0)"
    arr = f"list_filter(list_transform({arr}, lambda s: {S.clean_full('s')}), lambda s: length(s) > 0)"
    return arr


@register("p14_sentences", f"""SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sent, array_to_string(s, '|') AS sents
    FROM (SELECT doc_id, {_sentences_sql(['text', 'lang'])} AS s FROM documents)""")
def q_p14(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    s = sentences(["text", "lang"])
    return d.select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("long").alias("n_sent"), F.array_join("s", "|").alias("sents"))


@register("p15_label_binary", """SELECT d.doc_id, CAST(CASE WHEN l.quality * 2 + l.toxic > 0 THEN 1 ELSE 0 END AS BIGINT) AS label
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def q_p15(spark, sf_dir):
    return L.to_binary(labelled_corpus(spark, sf_dir)).select("doc_id", F.col("label").cast("long"))


@register("p16_label_shift", """SELECT d.doc_id, CAST(l.quality * 2 + l.toxic - 1 AS BIGINT) AS label
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality * 2 + l.toxic > 0""")
def q_p16(spark, sf_dir):
    return L.drop_negative_shift(labelled_corpus(spark, sf_dir)).select("doc_id", F.col("label").cast("long"))


@register("p17_label_domain", f"""SELECT split, CAST(min(label) AS BIGINT) AS min_label, CAST(max(label) AS BIGINT) AS max_label,
      CAST(count(DISTINCT label) AS BIGINT) AS n_distinct,
      CAST(count(DISTINCT label) FILTER (WHERE label < 0 OR label >= 4) AS BIGINT) AS n_wrong,
      (min(label) = 0 AND max(label) = 3 AND count(DISTINCT label) = 4) AS ok
    FROM (SELECT label, CASE WHEN cv = 0 THEN 'valid' ELSE 'train' END AS split FROM ({_folds_sql()})) GROUP BY split""")
def q_p17(spark, sf_dir):
    f = stratified_folds(labelled_corpus(spark, sf_dir), "label", "doc_id", k=5, seed=42)
    f = f.withColumn("split", F.when(F.col("cv") == 0, "valid").otherwise("train"))
    r = L.label_domain_report(f, 4, "split", n_weights=len(L.class_weight_list(f)))
    return r.select("split", *[F.col(c).cast("long") for c in ("min_label", "max_label", "n_distinct", "n_wrong")], "ok")
