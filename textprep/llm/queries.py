"""The registered queries of the corpus operators: each applies one operator with production
parameters to its whole table.  DuckDB SQL is given where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textprep.llm import bpe, chat, decontam, divergence, embed_dedup, hard_negatives, langid, licenses, minhash_dedup, mixing, quality, substring_dedup, warc
from textprep.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return keep


OP6_SQL = r"""
WITH docs AS (
    SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
    FROM documents
), windows AS (
    SELECT doc_id, unnest(range(1, len(words) - 18)) AS start, words FROM docs WHERE len(words) >= 20
), keyed AS (
    SELECT doc_id, start, md5(array_to_string(words[start:start + 19], ' ')) AS key FROM windows
), ranked AS (
    SELECT doc_id, start, row_number() OVER (PARTITION BY key ORDER BY doc_id, start) AS n FROM keyed
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS place FROM ranked WHERE n > 1
), removed AS (
    SELECT doc_id, count(*) AS n_removed, list(place) AS places FROM gone GROUP BY doc_id
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(r.n_removed, 0)::BIGINT AS n_removed,
       sha256(CASE WHEN r.doc_id IS NULL THEN array_to_string(d.words, ' ')
              ELSE coalesce(array_to_string(list_filter(d.words, lambda x, i: NOT list_contains(r.places, i)), ' '), '') END) AS kept_sha256
FROM docs d LEFT JOIN removed r ON d.doc_id = r.doc_id
"""


@_query("op6_substring_dedup", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs, kept_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP9_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
    FROM sized GROUP BY source
), ordered AS (
    SELECT *, 3.0 * source_size AS most,
           sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
           coalesce(sum(3.0 * source_size) OVER w, 0) AS held, coalesce(sum(weight) OVER w, 0) AS gone
    FROM sources
    WINDOW w AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
    SELECT arg_min((total - held) / (weights - gone), most / weight) AS level FROM ordered WHERE most / weight >= (total - held) / (weights - gone)
), targets AS (
    SELECT source, source_size, least(most::DOUBLE, level * weight) AS target FROM ordered, level
), rated AS (
    SELECT d.doc_id, d.size, t.source_size, t.target,
           CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0) ELSE 0.0 END AS rate,
           ('0x' || substr(md5(concat_ws('|', 'mix-1', d.doc_id::VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0 AS u
    FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, round(target::DOUBLE, 6) AS target,
       (size * (floor(rate) + (u < rate - floor(rate))::INT))::BIGINT AS taken
FROM rated
"""


@_query("op9_mix_sources", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


@_query("op10_minhash_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash_dedup.near_duplicates(docs, size=2).select("doc_id", "n_shingles", "component_id", "kept")


OP3_SQL = r"""
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, min(r.b) AS component_id,
       e.vec_id = min(r.b) AS kept
FROM embeddings e JOIN reach r ON r.a = e.vec_id GROUP BY e.vec_id
"""


@_query("op3_embedding_dedup", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.cosine_links(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


# words of a text as the contract has them: A-Z lower-cased, all non-ASCII characters kept
_WORDS_SQL = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = f"""
WITH docs AS (SELECT doc_id, {_WORDS_SQL.format("text")} AS words FROM documents),
items AS (SELECT item_id, words, least(len(words), 10) AS size FROM (SELECT item_id, {_WORDS_SQL.format("text")} AS words FROM benchmark)),
starts AS (SELECT item_id, words, size, unnest(range(1, len(words) - size + 2)) AS start FROM items WHERE size > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(words[start:start + size - 1], ' ') AS gram FROM starts),
places AS (
    SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS start
    FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(words) >= size
), grams AS (SELECT doc_id, start, size, array_to_string(words[start:start + size - 1], ' ') AS gram FROM places),
found AS (SELECT g.doc_id, g.start, g.size, w.item_id FROM grams g JOIN windows w ON g.gram = w.gram AND g.size = w.size),
hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(start, start + size)) AS place FROM found) GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS ids
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits h ON d.doc_id = h.doc_id LEFT JOIN named n ON d.doc_id = n.doc_id
"""


@_query("op1_decontamination", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("item_ids", 256).alias("items_sha256"), "contaminated")


@_query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@_query("op5_license_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP2_SQL = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM f
"""


@_query("op2_warc_revisits", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive(table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("payload")))
    # a response's digest and length are those of the block as read, a revisit's those of its original
    whole = F.col("record_type") == "response"
    return back.select(
        "page_id",
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


@_query("op7_quality_classifier")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.array_join("votes", ",").alias("votes"), "p_good", "score", "kept")


OP8_SQL = """
WITH last AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
chosen AS (SELECT conv_id AS pair_id, turn, role, text FROM conversations),
rejected AS (
    SELECT c.pair_id, c.turn, c.role, c.text FROM chosen c LEFT JOIN last l ON c.pair_id = l.conv_id WHERE l.last IS NULL OR c.turn < l.last
    UNION ALL
    SELECT mine.conv_id, mine.last, t.role, t.text
    FROM conversations t JOIN last other ON t.conv_id = other.conv_id AND t.turn = other.last AND t.role = 'assistant'
    JOIN last mine ON mine.conv_id = xor(t.conv_id, 1)
), turns AS (
    SELECT pair_id, turn, role, text, sum(c)::BIGINT AS c, sum(r)::BIGINT AS r
    FROM (SELECT *, 1 AS c, 0 AS r FROM chosen UNION ALL SELECT *, 0, 1 FROM rejected) GROUP BY ALL
), differ AS (SELECT pair_id, min(turn) AS start FROM turns WHERE c <> r GROUP BY pair_id),
placed AS (SELECT t.*, d.start IS NULL OR t.turn < d.start AS shared FROM turns t LEFT JOIN differ d ON t.pair_id = d.pair_id),
parts AS (
    SELECT *, 'prompt' AS part, c AS copies FROM placed WHERE shared
    UNION ALL SELECT *, 'chosen', c FROM placed WHERE NOT shared AND c > 0
    UNION ALL SELECT *, 'rejected', r FROM placed WHERE NOT shared AND r > 0
)
SELECT pair_id, part, turn, role, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered,
       CASE WHEN part <> 'prompt' AND role = 'assistant' THEN 1 ELSE 0 END AS mask, copies
FROM parts
"""


@_query("op8_chat_preferences", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = chat.format_pairs(*chat.with_negatives(turns))
    return found.select("pair_id", "part", "turn", "role", "rendered", "mask", "copies")


OP11_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label,
           list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE own = label
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN s ON s.anchor_id = p.anchor_id AND s.own <> s.label
     AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""


@_query("op11_hard_negatives", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    rows = rows.where(finite).select("vec_id", label.alias("label"), vector.alias("vector"))
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)


OP12_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
    FROM documents
), w AS (SELECT id, lang, source, unnest(words) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY w.lang, w.source, w.term),
grid AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k ON g.lang = k.lang
         LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER s + 2 * count(*) OVER s) AS p
      FROM grid WINDOW s AS (PARTITION BY lang, source)),
whole AS (SELECT lang, term, sum(n) AS n FROM grid GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER s + 2 * count(*) OVER s) AS q
      FROM whole WINDOW s AS (PARTITION BY lang)),
gaps AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v.value, 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN gaps v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
    UNION ALL
    SELECT p.lang, p.source, 'term', p.term, ((p.p - q.q) * (p.p - q.q) // (p.p + q.q))::BIGINT
    FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


@_query("op12_source_divergence", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


@_query("op13_byte_bpe")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rank_file = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = bpe.decode(bpe.encode(docs, rank_file), rank_file)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
