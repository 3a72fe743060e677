"""Queries: vocabularies and token operators (S5, S6, T1-T20) and masked-LM rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from textprep.functions.text import DIGIT_CLASS, clean_text_full, clean_words, normalise_text, repair_digit_comma, sentences, word_pieces
from textprep.operators import mlm as LM
from textprep.operators import tokens as TK
from textprep.operators.chunks import explode_chunks, longest_chunk
from textprep.plans import sqltext as S
from textprep.plans.catalog import register
from textprep.plans.q_prep import _chunks_sql, prepared_corpus
from textprep.sources.tables import LABELLED_SQL, labelled_corpus, read_table

# --- vocabularies ---------------------------------------------------------------------------------

_SPECIALS_SQL = "(VALUES ('[PAD]', 0), ('[UNK]', 1), ('[CLS]', 2), ('[SEP]', 3), ('[MASK]', 4)) s(token, id)"
VOCAB_SQL = f"""(SELECT token, id, NULL::BIGINT AS n FROM {_SPECIALS_SQL}
    UNION ALL
    SELECT w AS token, 4 + row_number() OVER (ORDER BY n DESC, w) AS id, n FROM
      (SELECT w, count(*) AS n FROM (SELECT unnest({S.split_words(S.clean_full('text'))}) AS w FROM documents) a GROUP BY w) b)"""


def corpus_vocab(spark, sf_dir):
    """T20 over ``documents``, materialised once per input (S2/S3): later token queries read
    the stored vocabulary instead of re-counting the corpus."""
    from textprep.sources.io import cache_key, cache_root, input_signature, with_cache

    src = f"{sf_dir.rstrip('/')}/documents.parquet"
    key = cache_key({"op": "corpus_vocab", "clean": "compat", "specials": TK.SPECIALS, **input_signature(spark, src)})
    return with_cache(spark, f"{cache_root(spark)}/vocab/{key}",
                      lambda: TK.build_vocab(read_table(spark, sf_dir, "documents").select("text"), "text"))


@register("t20_corpus_vocab", f"SELECT token, CAST(id AS BIGINT) AS id, CAST(n AS BIGINT) AS n FROM {VOCAB_SQL} v")
def q_t20(spark, sf_dir):
    v = corpus_vocab(spark, sf_dir)
    return v.select("token", F.col("id").cast("long"), F.col("count").cast("long").alias("n"))


@register("t18_mask_id", f"SELECT token, CAST(id AS BIGINT) AS id FROM {VOCAB_SQL} v WHERE token = '[MASK]'")
def q_t18(spark, sf_dir):
    v = corpus_vocab(spark, sf_dir)
    mid = TK.special_id(v, "[MASK]")
    return v.filter(F.col("id") == mid).select("token", F.col("id").cast("long"))


LINES_SQL = """(SELECT doc_id, pos, line, row_number() OVER (ORDER BY doc_id, pos) - 1 AS line_no FROM
    (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) a)"""
LINE_VOCAB_SQL = f"(SELECT {S.py_strip('line')} AS token, max(line_no) AS id FROM {LINES_SQL} l GROUP BY 1)"


def line_vocab(spark, sf_dir):
    return TK.doc_line_vocab(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


@register("s5_vocab_from_lines", f"SELECT token, CAST(id AS BIGINT) AS id FROM {LINE_VOCAB_SQL} v")
def q_s5(spark, sf_dir):
    return line_vocab(spark, sf_dir).select("token", F.col("id").cast("long"))


@register("s6_vocab_gaps", f"""SELECT CAST(id AS BIGINT) AS id, CAST(prev_id AS BIGINT) AS prev_id, CAST(coalesce(prev_id + 1, 0) AS BIGINT) AS expected
    FROM (SELECT id, lag(id) OVER (ORDER BY id) AS prev_id FROM (SELECT DISTINCT id FROM {LINE_VOCAB_SQL} v) a) b
    WHERE id <> coalesce(prev_id + 1, 0)""")
def q_s6(spark, sf_dir):
    g = TK.vocab_gaps(line_vocab(spark, sf_dir))
    return g.select(*[F.col(c).cast("long") for c in ("id", "prev_id", "expected")])


# --- T5: lookups on benchmark passages -----------------------------------------------------------

@register("t5_token_to_id", f"""SELECT item_id, array_to_string(list(coalesce(v.id, 1) ORDER BY pos), ' ') AS ids, CAST(count(*) AS BIGINT) AS n FROM
    (SELECT item_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM
       (SELECT item_id, {S.split_words(S.clean_full('text'))} AS w FROM benchmark) a) t
    LEFT JOIN {VOCAB_SQL} v ON v.token = t.token GROUP BY item_id""")
def q_t5(spark, sf_dir):
    b = read_table(spark, sf_dir, "benchmark")
    toks = b.select("item_id", F.posexplode(F.split(clean_text_full("text"), " ")).alias("pos", "token")).filter(F.col("token") != "")
    ids = TK.lookup_ids(toks, corpus_vocab(spark, sf_dir))
    g = ids.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("_t"), F.count(F.lit(1)).alias("n"))
    return g.select("item_id", TK.ids_string(F.transform("_t", lambda x: x["id"])).alias("ids"), F.col("n").cast("long"))


# --- T1: encoding chunks -------------------------------------------------------------------------

def _encode_sql(size: int, max_len: int, specials: bool) -> str:
    ch = f"(SELECT doc_id, subix, data FROM ({_chunks_sql(size)}) z)"
    tk = f"""(SELECT doc_id, subix, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM
              (SELECT doc_id, subix, {S.split_words('data')} AS w FROM {ch} a) b)"""
    ids = f"""(SELECT tk.doc_id, tk.subix, list(coalesce(v.id, 1) ORDER BY pos) AS ids FROM {tk} tk
               LEFT JOIN {VOCAB_SQL} v ON v.token = tk.token GROUP BY tk.doc_id, tk.subix)"""
    body = max_len - (2 if specials else 0)
    full = f"""(SELECT c.doc_id, c.subix, coalesce(i.ids, []::BIGINT[])[1:{body}] AS ids FROM {ch} c
                LEFT JOIN {ids} i ON i.doc_id = c.doc_id AND i.subix = c.subix)"""
    if specials:
        full = f"(SELECT doc_id, subix, list_concat([2], ids, [3]) AS ids FROM {full} f)"
    pad = "list_transform(range(L - len(ids)), lambda x: 0)"
    ones = "list_transform(range(len(ids)), lambda x: 1)"
    return f"""SELECT doc_id, CAST(subix AS BIGINT) AS subix,
          array_to_string(list_concat(ids, {pad}), ' ') AS input_ids,
          array_to_string(list_concat({ones}, {pad}), ' ') AS attention_mask
        FROM {full} f, (SELECT max(len(ids)) AS L FROM {full} g) m"""


def _encode_spark(spark, sf_dir, size: int, max_len: int, specials: bool):
    ch = explode_chunks(prepared_corpus(spark, sf_dir), size, key_col="doc_id", cleaned=True).select("doc_id", "subix", "data")
    texts = labelled_corpus(spark, sf_dir).select(clean_text_full("text").alias("data_cleaned"))
    longest = longest_chunk(texts, size, cleaned=True)
    enc = TK.encode_corpus(ch, corpus_vocab(spark, sf_dir), ["doc_id", "subix"], "data", max_len=max_len, add_special_tokens=specials, longest=longest)
    return enc.select("doc_id", F.col("subix").cast("long"), TK.ids_string("input_ids").alias("input_ids"),
                      TK.ids_string("attention_mask").alias("attention_mask"))


@register("t1_encode_chunks", _encode_sql(250, 512, False))
def q_t1(spark, sf_dir):
    return _encode_spark(spark, sf_dir, 250, 512, False)


@register("t1_encode_chunks_truncated", _encode_sql(250, 128, False))
def q_t1_cut(spark, sf_dir):
    """T1's own truncation, at 128 ids."""
    return _encode_spark(spark, sf_dir, 250, 128, False)


@register("t8_encode_chunks_specials", _encode_sql(50, 64, True))
def q_t1s(spark, sf_dir):
    return _encode_spark(spark, sf_dir, 50, 64, True)


@register("t7_decode_roundtrip", f"""SELECT doc_id, CAST(subix AS BIGINT) AS subix,
      trim(replace(array_to_string(list('▁' || coalesce(tok, '') ORDER BY pos), ''), '▁', ' ')) AS decoded FROM
    (SELECT tk.doc_id, tk.subix, tk.pos, v2.token AS tok FROM
       (SELECT doc_id, subix, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM
          (SELECT doc_id, subix, {S.split_words('data')} AS w FROM ({_chunks_sql(250)}) z WHERE data <> '') a) tk
       LEFT JOIN {VOCAB_SQL} v ON v.token = tk.token
       LEFT JOIN {VOCAB_SQL} v2 ON v2.id = coalesce(v.id, 1)) q
    GROUP BY doc_id, subix""")
def q_t7(spark, sf_dir):
    ch = explode_chunks(prepared_corpus(spark, sf_dir), 250, key_col="doc_id", cleaned=True).select("doc_id", "subix", "data").filter(F.col("data") != "")
    vocab = corpus_vocab(spark, sf_dir)
    enc = TK.encode_corpus(ch, vocab, ["doc_id", "subix"], "data", max_len=1 << 30, padding=False)
    ids = enc.select("doc_id", "subix", F.posexplode("input_ids").alias("pos", "id"))
    toks = TK.lookup_tokens(ids, vocab, "id", "token")
    g = toks.groupBy("doc_id", "subix").agg(F.sort_array(F.collect_list(F.struct("pos", F.concat(F.lit("▁"), F.coalesce("token", F.lit(""))).alias("t")))).alias("_p"))
    return g.select("doc_id", F.col("subix").cast("long"), TK.pieces_to_text(F.transform("_p", lambda x: x["t"])).alias("decoded"))


# --- T2: sentence tokens ---------------------------------------------------------------------------

def _sentences_sql(c: str) -> str:
    arr = f"coalesce(string_split({c}, chr(10)), []::VARCHAR[])"
    arr = f"list_filter(list_transform({arr}, lambda s: {S.py_strip('s')}), lambda s: length(s) > 0)"
    return f"list_filter(list_transform({arr}, lambda s: {S.clean_full('s')}), lambda s: length(s) > 0)"


T2_SQL = f"""(SELECT d.doc_id, coalesce(t.toks, []::BIGINT[][]) AS toks FROM documents d LEFT JOIN
    (SELECT doc_id, list(ids ORDER BY si) AS toks FROM
       (SELECT w.doc_id, w.si, list(coalesce(v.id, 1) ORDER BY w.wi) AS ids FROM
          (SELECT doc_id, si, unnest(ws) AS token, generate_subscripts(ws, 1) AS wi FROM
             (SELECT doc_id, si, {S.split_words('sent')} AS ws FROM
                (SELECT doc_id, unnest(ss) AS sent, generate_subscripts(ss, 1) AS si FROM
                   (SELECT doc_id, {_sentences_sql('text')} AS ss FROM documents) a) b) c) w
          LEFT JOIN {VOCAB_SQL} v ON v.token = w.token GROUP BY w.doc_id, w.si) e
       GROUP BY doc_id) t ON d.doc_id = t.doc_id)"""


def sentence_tokens(spark, sf_dir):
    """T2 over ``documents``, materialised once per input like the reference's cached
    sentence-token table: the masked-LM queries (T11-T16) start from the stored copy."""
    from textprep.sources.io import cache_key, cache_root, input_signature, with_cache

    src = f"{sf_dir.rstrip('/')}/documents.parquet"
    key = cache_key({"op": "sentence_tokens", "clean": "compat", "specials": TK.SPECIALS, **input_signature(spark, src)})

    def compute():
        d = read_table(spark, sf_dir, "documents").select("doc_id", sentences(["text"]).alias("sents"))
        return TK.encode_sentences(d, corpus_vocab(spark, sf_dir), "doc_id", "sents", cleaned=True)

    return with_cache(spark, f"{cache_root(spark)}/sentence_tokens/{key}", compute)


def _toks_str_sql(c: str) -> str:
    return f"array_to_string(list_transform({c}, lambda s: array_to_string(s, ' ')), '|')"


def _toks_str(c):
    return F.array_join(F.transform(c, lambda s: TK.ids_string(s)), "|")


@register("t2_sentence_tokens", f"""SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_sent,
      CAST(coalesce(list_sum(list_transform(toks, lambda s: len(s))), 0) AS BIGINT) AS tot_len,
      array_to_string(list_transform(toks, lambda s: len(s)), ' ') AS tok_lens,
      array_to_string(range(len(toks)), ' ') AS ixs,
      md5({_toks_str_sql('toks')}) AS toks_md5 FROM {T2_SQL} t""")
def q_t2(spark, sf_dir):
    t = sentence_tokens(spark, sf_dir)
    return t.select(
        "doc_id", F.size("toks").cast("long").alias("n_sent"), F.col("tot_len").cast("long"),
        TK.ids_string("tok_lens").alias("tok_lens"), TK.ids_string("ixs").alias("ixs"), F.md5(_toks_str("toks")).alias("toks_md5"),
    )


# --- T3 / T4: normalisation and pieces --------------------------------------------------------------

def _norm_sql(c: str, accents: bool) -> str:
    s = S.py_strip(f"regexp_replace({c}, '{S.WS}+', ' ', 'g')")
    s = f"replace(replace({s}, '``', '\"'), '''''', '\"')"
    return s if accents else f"strip_accents({s})"


# --- T13 by length buckets: the fewest pads that four buckets can have --------------------------------

_LENS_SQL = f"(SELECT len({S.split_words(S.clean_full('text'))}) AS x, count(*) AS n FROM documents GROUP BY 1)"


def _least_pads_sql(buckets: int) -> str:
    """Fewest pads by buckets: best(b) of one more bucket is the least best(a) plus the pads of the lengths after a up to b."""
    sums = f"(SELECT x, sum(n) OVER w AS r, sum(n * x) OVER w AS t FROM {_LENS_SQL} h WINDOW w AS (ORDER BY x))"
    best = f"(SELECT x, r, t, x * r - t AS pads FROM {sums} s)"
    for i in range(buckets - 1):
        best = f"""(SELECT b.x, b.r, b.t, least(min(b.pads), coalesce(min(a.pads + b.x * (b.r - a.r) - (b.t - a.t)), min(b.pads))) AS pads
            FROM {best} b LEFT JOIN {best} a ON a.x < b.x GROUP BY b.x, b.r, b.t)""" if i == 0 else f"""(SELECT s.x, s.r, s.t,
            least(min(a.pads + s.x * (s.r - a.r) - (s.t - a.t)), min(CASE WHEN a.x = s.x THEN a.pads END)) AS pads
            FROM {sums} s JOIN {best} a ON a.x <= s.x GROUP BY s.x, s.r, s.t)"""
    return best


@register("t13_length_buckets", f"""SELECT CAST(max(r) AS BIGINT) AS n_rows, CAST(max(t) AS BIGINT) AS n_ids, CAST(max_by(pads, x) AS BIGINT) AS n_pads,
    CAST(max(x) * max(r) - max(t) AS BIGINT) AS n_pads_to_longest FROM {_least_pads_sql(4)} z""")
def q_t13_buckets(spark, sf_dir):
    """Documents padded inside four length buckets; what is counted are the pads of the padded rows."""
    from textprep.operators import padding as P

    d = read_table(spark, sf_dir, "documents").select("doc_id", clean_words("text").alias("words"))
    d = TK.encode_corpus(d, corpus_vocab(spark, sf_dir), ["doc_id"], "words", max_len=1 << 30, padding=False).drop("attention_mask")
    b = P.bucketed_batches(d, "input_ids", 32, ["doc_id"], buckets=4)
    real = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    sums = b.select(F.size("input_ids").cast("long").alias("p"), real.cast("long").alias("x"))
    return sums.agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("x").alias("n_ids"), F.sum(F.col("p") - F.col("x")).alias("n_pads"),
        (F.max("x") * F.count(F.lit(1)) - F.sum("x")).alias("n_pads_to_longest"),
    )


@register("t3_normalise_text", f"SELECT doc_id, {_norm_sql('text', False)} AS normalised FROM documents")
def q_t3(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", normalise_text("text").alias("normalised"))


def _re2_class() -> str:
    out, i, s = [], 0, DIGIT_CLASS
    while i < len(s):
        if s.startswith("\\u", i):
            out.append("\\x{" + s[i + 2:i + 6] + "}")
            i += 6
        else:
            out.append(s[i])
            i += 1
    return "".join(out)


@register("t4_digit_comma_pieces", f"""SELECT doc_id, CAST(len(p) AS BIGINT) AS n_pieces, md5(array_to_string(p, ' ')) AS pieces_md5 FROM
    (SELECT doc_id, flatten(list_transform(list_transform({S.split_words(_norm_sql('text', True))}, lambda w: '▁' || w),
        lambda x: CASE WHEN length(x) > 1 AND regexp_matches(x, '{_re2_class()},$') THEN [regexp_replace(x, ',$', ''), ','] ELSE [x] END)) AS p
     FROM documents) q""")
def q_t4(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    p = repair_digit_comma(word_pieces(normalise_text("text", keep_accents=True), cleaned=True))
    return d.select("doc_id", p.alias("p")).select(
        "doc_id", F.size("p").cast("long").alias("n_pieces"), F.md5(F.array_join("p", " ")).alias("pieces_md5")
    )


# --- T8-T10: pairs with special tokens ----------------------------------------------------------------

_PAIRS_SQL = f"""(SELECT doc_id, i, coalesce(toks[i], []::BIGINT[]) AS a, coalesce(toks[i + 1], []::BIGINT[]) AS b
    FROM (SELECT doc_id, toks, unnest(range(1, greatest(len(toks), 2))) AS i FROM {T2_SQL} t) u)"""


@register("t9_t10_pair_inputs", f"""SELECT doc_id, CAST(i - 1 AS BIGINT) AS pair,
      array_to_string(list_concat([2], a, [3], b, [3]), ' ') AS pair_ids,
      array_to_string(list_concat([1], list_transform(a, lambda x: 0), [1], list_transform(b, lambda x: 0), [1]), ' ') AS pair_special_mask,
      array_to_string(list_transform(list_concat([2], a, [3], b, [3]), lambda x: CASE WHEN x IN (3, 2) THEN 1 ELSE 0 END), ' ') AS scanned_mask,
      array_to_string(list_concat(list_transform(range(len(a) + 2), lambda x: 0), list_transform(range(len(b) + 1), lambda x: 1)), ' ') AS token_types,
      array_to_string(list_concat([2], a, [3]), ' ') AS single_ids
    FROM {_PAIRS_SQL} q""")
def q_t9(spark, sf_dir):
    """All pairs of adjacent sentences of each document (one pair with an empty second, or two empty, sentences
    where there are fewer than two)."""
    t = sentence_tokens(spark, sf_dir)
    empty = F.array().cast("array<int>")
    t = t.select("doc_id", "toks", F.explode(F.sequence(F.lit(0), F.greatest(F.size("toks"), F.lit(2)) - 2)).alias("pair"))
    t = t.select("doc_id", "pair", *[F.coalesce(F.get("toks", F.col("pair") + k), empty).alias(c) for k, c in enumerate("ab")])
    pair = TK.with_specials("a", "b")
    return t.select(
        "doc_id", F.col("pair").cast("long"),
        TK.ids_string(pair).alias("pair_ids"),
        TK.ids_string(TK.special_tokens_mask("a", "b")).alias("pair_special_mask"),
        TK.ids_string(TK.special_tokens_mask(pair, already_has_special_tokens=True)).alias("scanned_mask"),
        TK.ids_string(TK.token_type_ids("a", "b")).alias("token_types"),
        TK.ids_string(TK.with_specials("a")).alias("single_ids"),
    )


# --- T11-T16: masked-LM rows ------------------------------------------------------------------------

def _u(tag: str, *parts: str, seed: int = 42, epoch: int = 0) -> str:
    return S.uniform(seed, f"'{tag}'", epoch, *parts)


_FLAT_SQL = f"""(SELECT doc_id, flatten(list_transform(list_sort(list_transform(toks, lambda s, i: {{'h': {S.hash_hex(42, "'shuf'", 0, 'doc_id', 'i - 1')}, 'i': i - 1, 's': s}})), lambda x: x.s)) AS flat
    FROM {T2_SQL} t)"""
_FLAT_T_SQL = f"(SELECT doc_id, flat AS t FROM {_FLAT_SQL} f)"
_TRUNC_SQL = f"""(SELECT doc_id, CASE WHEN len(flat) <= 64 THEN flat WHEN {_u('trunc', 'doc_id')} < 0.5 THEN flat[1:64] ELSE flat[-64:] END AS t
    FROM {_FLAT_SQL} f)"""


@register("t11_shuffle_sentences", f"SELECT doc_id, CAST(len(flat) AS BIGINT) AS n, md5(array_to_string(flat, ' ')) AS flat_md5 FROM {_FLAT_SQL} f")
def q_t11(spark, sf_dir):
    t = sentence_tokens(spark, sf_dir)
    f = t.select("doc_id", LM.shuffle_sentences("toks", "doc_id").alias("flat"))
    return f.select("doc_id", F.size("flat").cast("long").alias("n"), F.md5(TK.ids_string("flat")).alias("flat_md5"))


@register("t12_truncate_head_or_tail", f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, md5(array_to_string(t, ' ')) AS t_md5 FROM {_TRUNC_SQL} q")
def q_t12(spark, sf_dir):
    t = sentence_tokens(spark, sf_dir)
    f = t.select("doc_id", LM.truncate_head_or_tail(LM.shuffle_sentences("toks", "doc_id"), "doc_id", 64).alias("t"))
    return f.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(TK.ids_string("t")).alias("t_md5"))


@register("t14_uniform_mask", f"""SELECT doc_id, md5(array_to_string(m, ' ')) AS ids_md5, md5(array_to_string(l, ' ')) AS labels_md5,
      CAST(len(list_filter(l, lambda x: x <> -100)) AS BIGINT) AS n_masked FROM
    (SELECT doc_id, list_transform(t, lambda x, i: CASE WHEN {_u('mask', 'doc_id', 'i - 1')} < 0.15 THEN 4 ELSE x END) AS m,
            list_transform(t, lambda x, i: CASE WHEN {_u('mask', 'doc_id', 'i - 1')} < 0.15 THEN x ELSE -100 END) AS l FROM {_FLAT_T_SQL} q) z""")
def q_t14(spark, sf_dir):
    t = sentence_tokens(spark, sf_dir)
    t = t.select("doc_id", LM.shuffle_sentences("toks", "doc_id").alias("t"))
    ids, labels = LM.uniform_mask("t", "doc_id")
    z = t.select("doc_id", ids.alias("m"), labels.alias("l"))
    return z.select("doc_id", F.md5(TK.ids_string("m")).alias("ids_md5"), F.md5(TK.ids_string("l")).alias("labels_md5"),
                    F.size(F.filter("l", lambda x: x != -100)).cast("long").alias("n_masked"))


def _bert_sql(vsize: str) -> str:
    u = _u("bert", "doc_id", "i - 1")
    u2 = _u("rand", "doc_id", "i - 1")
    rand = f"""CASE WHEN x >= 5 THEN (CASE WHEN CAST(floor({u2} * ({vsize} - 5 - 1)) AS BIGINT) + 5 >= x
                                          THEN CAST(floor({u2} * ({vsize} - 5 - 1)) AS BIGINT) + 6
                                          ELSE CAST(floor({u2} * ({vsize} - 5 - 1)) AS BIGINT) + 5 END)
                    ELSE CAST(floor({u2} * ({vsize} - 5)) AS BIGINT) + 5 END"""
    one = f"""CASE WHEN {u} >= 0.15 THEN x WHEN {u} / 0.15 < 0.8 THEN 4 WHEN {u} / 0.15 < 0.9 THEN {rand} ELSE x END"""
    lab = f"CASE WHEN {u} < 0.15 THEN x ELSE -1 END"
    return f"""(SELECT doc_id, t, list_transform(t, lambda x, i: {one}) AS m, list_transform(t, lambda x, i: {lab}) AS l
               FROM {_FLAT_T_SQL} q, (SELECT count(*) AS vs FROM {VOCAB_SQL} v) vv)"""


@register("t15_bert_mask", f"""SELECT doc_id, md5(array_to_string(m, ' ')) AS ids_md5, md5(array_to_string(l, ' ')) AS labels_md5,
      CAST(len(list_filter(l, lambda x: x <> -1)) AS BIGINT) AS n_chosen,
      CAST(len(list_filter(m, lambda x: x = 4)) AS BIGINT) AS n_mask_id FROM {_bert_sql('vs')} z""")
def q_t15(spark, sf_dir):
    vocab = corpus_vocab(spark, sf_dir)
    vsize = vocab.count()
    t = sentence_tokens(spark, sf_dir)
    t = t.select("doc_id", LM.shuffle_sentences("toks", "doc_id").alias("t"))
    ids, labels = LM.bert_mask("t", "doc_id", vsize)
    z = t.select("doc_id", ids.alias("m"), labels.alias("l"))
    return z.select("doc_id", F.md5(TK.ids_string("m")).alias("ids_md5"), F.md5(TK.ids_string("l")).alias("labels_md5"),
                    F.size(F.filter("l", lambda x: x != -1)).cast("long").alias("n_chosen"),
                    F.size(F.filter("m", lambda x: x == 4)).cast("long").alias("n_mask_id"))


@register("t16_mlm_rows", f"""SELECT z.doc_id, CAST(lc.label AS BIGINT) AS cls_labels,
      md5(array_to_string(list_concat(m, list_transform(range(64 - len(m)), lambda x: 0)), ' ')) AS input_ids_md5,
      md5(array_to_string(list_concat(list_transform(range(len(m)), lambda x: 1), list_transform(range(64 - len(m)), lambda x: 0)), ' ')) AS attention_md5,
      md5(array_to_string(list_concat(l, list_transform(range(64 - len(m)), lambda x: -100)), ' ')) AS labels_md5 FROM
    (SELECT doc_id, list_transform(t, lambda x, i: CASE WHEN {_u('mask', 'doc_id', 'i - 1')} < 0.15 THEN 4 ELSE x END) AS m,
            list_transform(t, lambda x, i: CASE WHEN {_u('mask', 'doc_id', 'i - 1')} < 0.15 THEN x ELSE -100 END) AS l FROM {_TRUNC_SQL} q) z
    JOIN {LABELLED_SQL} lc ON lc.doc_id = z.doc_id""")
def q_t16(spark, sf_dir):
    from textprep.sources.tables import labelled_corpus

    t = sentence_tokens(spark, sf_dir)
    t = t.join(labelled_corpus(spark, sf_dir).select("doc_id", "label"), "doc_id")
    r = LM.mlm_rows(t, "doc_id", "toks", "label", max_len=64)
    return r.select("doc_id", F.col("cls_labels").cast("long"), F.md5(TK.ids_string("input_ids")).alias("input_ids_md5"),
                    F.md5(TK.ids_string("attention_mask")).alias("attention_md5"), F.md5(TK.ids_string("labels")).alias("labels_md5"))


@register("t6_id_to_token", f"""SELECT item_id, array_to_string(list(coalesce(v2.token, '') ORDER BY pos), ' ') AS decoded,
      CAST(count(*) FILTER (WHERE v2.token IS NULL) AS BIGINT) AS n_unknown FROM
    (SELECT item_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM
       (SELECT item_id, {S.split_words(S.clean_full('text'))} AS w FROM benchmark) a) t
    LEFT JOIN {VOCAB_SQL} v ON v.token = t.token
    LEFT JOIN {VOCAB_SQL} v2 ON v2.id = coalesce(v.id, 1)
    GROUP BY item_id""")
def q_t6(spark, sf_dir):
    """T5 then T6 on the benchmark passages: ids back to tokens (an id outside the vocabulary
    would decode to null and be counted)."""
    b = read_table(spark, sf_dir, "benchmark")
    toks = b.select("item_id", F.posexplode(F.split(clean_text_full("text"), " ")).alias("pos", "token")).filter(F.col("token") != "")
    vocab = corpus_vocab(spark, sf_dir)
    ids = TK.lookup_ids(toks, vocab).select("item_id", "pos", "id")
    back = TK.lookup_tokens(ids, vocab, "id", "tok")
    g = back.groupBy("item_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", F.coalesce("tok", F.lit("")).alias("t")))).alias("_t"),
        F.count(F.when(F.col("tok").isNull(), 1)).alias("n_unknown"),
    )
    return g.select("item_id", F.array_join(F.transform("_t", lambda x: x["t"]), " ").alias("decoded"), F.col("n_unknown").cast("long"))


def _padded_sql(value: str, pad: str) -> str:
    return f"md5(array_to_string(list_concat({value}, list_transform(range(longest - len(t)), lambda x: {pad})), ' '))"


@register("t13_pad_right", f"""SELECT doc_id, CAST(longest AS BIGINT) AS padded_len, {_padded_sql('t', '0')} AS ids_md5, {_padded_sql('t', '-100')} AS labels_md5,
      {_padded_sql('list_transform(t, lambda x: 1)', '0')} AS mask_md5
    FROM (SELECT doc_id, t, max(len(t)) OVER () AS longest FROM {_FLAT_T_SQL} q) z""")
def q_t13(spark, sf_dir):
    """T13 alone: right-pad all ids of a document to the longest list of the frame (pad id 0), labels with -100,
    mask 1s then 0s."""
    t = sentence_tokens(spark, sf_dir)
    longest = t.agg(F.max("tot_len")).first()[0] or 0
    # pads outnumber the ids many times: ids are written as text before they are padded, and the pads are text from the start
    t = t.select("doc_id", LM.shuffle_sentences("toks", "doc_id").cast("array<string>").alias("ids"))
    p = TK.pad_right(t.withColumn("labels", F.col("ids")), "ids", longest, TK.PAD_ID, "mask", "labels", TK.IGNORE_LABEL)
    return p.select("doc_id", F.size("ids").cast("long").alias("padded_len"), F.md5(TK.ids_string("ids")).alias("ids_md5"),
                    F.md5(TK.ids_string("labels")).alias("labels_md5"), F.md5(TK.ids_string("mask")).alias("mask_md5"))


def _scratch(spark, name: str) -> str:
    """A new folder below the shared one."""
    import uuid

    from textprep.session import shared_dir

    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("s6_vocab_file", f"SELECT token, CAST(id AS BIGINT) AS id FROM {VOCAB_SQL} v")
def q_s6_file(spark, sf_dir):
    """S6 then S5 through files: the corpus vocabulary written in id order and read back by line number."""
    path = _scratch(spark, "vocab")
    TK.write_vocab(corpus_vocab(spark, sf_dir), path)
    return TK.read_vocab(spark, path).select("token", F.col("id").cast("long"))


@register("s7_model_inputs", f"""SELECT md5(input_ids) AS ids_md5, md5(attention_mask) AS mask_md5, CAST(label AS BIGINT) AS label
    FROM ({_encode_sql(250, 512, False)}) e JOIN (SELECT doc_id AS d, label FROM {LABELLED_SQL} l) l ON e.doc_id = l.d""")
def q_s7(spark, sf_dir):
    from textprep.sources.io import model_inputs

    ch = explode_chunks(prepared_corpus(spark, sf_dir), 250, key_col="doc_id", cleaned=True)
    rows = model_inputs(TK.encode_corpus(ch, corpus_vocab(spark, sf_dir), ["doc_id", "subix"], "data"))
    return rows.select(F.md5(TK.ids_string("input_ids")).alias("ids_md5"), F.md5(TK.ids_string("attention_mask")).alias("mask_md5"),
                       F.col("label").cast("long"))


@register("s1_read_csv", "SELECT doc_id AS \"index\", text AS title, CAST(length(text) AS BIGINT) AS n FROM documents")
def q_s1(spark, sf_dir):
    """Documents written as CSV (cells with newlines and quotes) and read back by the record reader."""
    from textprep.sources.io import read_records

    path = _scratch(spark, "records")
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("index"), F.col("text").alias("title"), F.lit("").alias("goal"))
    d.write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)
    r = read_records(spark, path, schema="index long, title string, goal string")
    return r.select("index", "title", F.length("title").cast("long").alias("n"))


@register("s1_read_csv_split", "SELECT doc_id AS \"index\", text AS title, CAST(length(text) AS BIGINT) AS n FROM documents")
def q_s1_split(spark, sf_dir):
    """S1 by byte ranges: the same file, read by many tasks."""
    from textprep.sources.csv_split import read_records_split

    path = _scratch(spark, "records")
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("index"), F.col("text").alias("title"), F.lit("").alias("goal"))
    d.write.option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)
    r = read_records_split(spark, path, schema="index long, title string, goal string")
    return r.select("index", "title", F.length("title").cast("long").alias("n"))


@register("s2_cached_table", "SELECT lang, count(*) AS n, CAST(1 AS BIGINT) AS computed FROM documents GROUP BY lang")
def q_s2(spark, sf_dir):
    """Asked for twice, computed once; the second answer is read from the published copy."""
    from textprep.sources.io import with_cache

    path, computed = _scratch(spark, "cached"), []

    def compute():
        computed.append(1)
        return read_table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))

    with_cache(spark, path, compute)
    again = with_cache(spark, path, compute)
    return again.withColumn("computed", F.lit(len(computed)).cast("long"))


@register("s3_cache_keys", """SELECT CAST(k AS BIGINT) AS k, CAST(doc_id % k AS BIGINT) AS part, count(*) AS n, CAST(3 AS BIGINT) AS n_keys
    FROM documents, (VALUES (2), (3), (5)) p(k) GROUP BY k, doc_id % k""")
def q_s3(spark, sf_dir):
    """S3: tables of one input under different parameters, each stored under its own key."""
    from functools import reduce

    from textprep.sources.io import cache_key, input_signature, with_cache

    root, d = _scratch(spark, "keys"), read_table(spark, sf_dir, "documents")
    source = input_signature(spark, f"{sf_dir.rstrip('/')}/documents.parquet")
    keys = {k: cache_key({"op": "parts", "k": k, **source}) for k in (2, 3, 5)}
    tables = [
        with_cache(spark, f"{root}/{key}", lambda k=k: d.groupBy((F.col("doc_id") % k).alias("part")).agg(F.count(F.lit(1)).alias("n")))
        .select(F.lit(k).cast("long").alias("k"), F.col("part").cast("long"), "n")
        for k, key in keys.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), tables).withColumn("n_keys", F.lit(len(set(keys.values()))).cast("long"))


@register("s4_submission_file", f"SELECT CAST(doc_id AS BIGINT) AS \"index\", CAST(label AS BIGINT) AS label FROM {LABELLED_SQL} l")
def q_s4(spark, sf_dir):
    """A prediction file written and read back."""
    from textprep.sources.io import write_submission
    from textprep.sources.tables import labelled_corpus

    path = _scratch(spark, "submission")
    write_submission(labelled_corpus(spark, sf_dir), path, "doc_id", "label")
    return spark.read.schema("index long, label long").option("header", True).csv(path)
