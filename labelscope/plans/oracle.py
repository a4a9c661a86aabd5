"""Independent SQL (DuckDB dialect) for every value-checked catalog query.

Written from the operator definitions, not from the Spark code: vectors are
unnested into (id, i, x) rows, ranks and samples use plain window SQL.  The
views ``region nation customer supplier part orders lineitem events
documents embeddings pages benchmark labels conversations`` are assumed.
"""

from __future__ import annotations

import re

from labelscope.functions.stopwords import STOP_WORDS_EN

SQL: dict[str, str] = {}

# ---------------------------------------------------------------- dense (F-B)

_UNIT_T = """
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM ({src})),
en AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda y: y * y))) AS nv FROM e),
u AS (SELECT vec_id, label, list_transform(v, lambda x: x / nv) AS v FROM en),
ux AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM u),
cm AS (SELECT label, i, avg(x) AS m FROM ux GROUP BY label, i),
cn AS (SELECT label, sqrt(sum(m * m)) AS nm FROM cm GROUP BY label),
c AS (SELECT cm.label, cm.i, cm.m / (cn.nm + 1e-12) AS c FROM cm JOIN cn USING (label)),
own AS (SELECT ux.vec_id, ux.label, 1 - sum(ux.x * c.c) AS dist
        FROM ux JOIN c ON ux.label = c.label AND ux.i = c.i GROUP BY ux.vec_id, ux.label),
one AS (SELECT DISTINCT vec_id, i, x FROM ux),
sims AS (SELECT one.vec_id, c.label AS clabel, sum(one.x * c.c) AS sim
         FROM one JOIN c ON one.i = c.i GROUP BY one.vec_id, c.label),
near AS (SELECT vec_id, clabel AS nearest_label, 1 - sim AS nearest_dist FROM (
           SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 12) DESC, clabel) AS rn FROM sims)
         WHERE rn = 1)
"""


def _unit(src: str) -> str:
    return _UNIT_T.replace("{src}", src)


_UNIT = _unit("SELECT vec_id, label, embedding FROM embeddings")

_STATS = """
d AS (SELECT vec_id, label, dist, round(dist, 9) AS rk FROM own),
gs AS (SELECT label, avg(dist) AS mu, stddev_samp(dist) AS sd, quantile_cont(dist, 0.5) AS med,
              count(*) AS n FROM d GROUP BY label),
st AS (SELECT d.*, gs.n, gs.mu, gs.med, nullif(gs.sd, 0) AS sd0,
              (rank() OVER (PARTITION BY d.label ORDER BY d.rk)
               + (count(*) OVER (PARTITION BY d.label, d.rk) - 1) / 2.0)
               / count(*) OVER (PARTITION BY d.label) AS pct
       FROM d JOIN gs USING (label))
"""

SQL["unit_vectors"] = "WITH" + _UNIT + """
SELECT vec_id, CAST(i AS BIGINT) AS dim, round(x, 6) AS value FROM ux"""

SQL["dense_centroids"] = "WITH" + _UNIT + """
SELECT label, CAST(i AS BIGINT) AS dim, round(c, 6) AS value FROM c"""

SQL["own_distance_dense"] = "WITH" + _UNIT + """
SELECT vec_id, label, round(dist, 6) AS dist_dense FROM own"""

SQL["nearest_centroid_dense"] = "WITH" + _UNIT + """
SELECT vec_id, nearest_label, round(nearest_dist, 6) AS nearest_dist FROM near"""

SQL["mismatch_rate"] = "WITH" + _UNIT + """
SELECT label, count(*) AS n, count(*) FILTER (WHERE nearest_label <> label) AS n_mismatch,
       round(avg(CASE WHEN nearest_label <> label THEN 1.0 ELSE 0.0 END), 6) AS mismatch_rate
FROM u JOIN near USING (vec_id) GROUP BY label"""

SQL["group_stats"] = "WITH" + _UNIT + "," + _STATS + """
SELECT vec_id, label, round(dist, 6) AS dist, round(coalesce((dist - mu) / sd0, 0), 4) AS z_d,
       round(mu, 6) AS d_mean, round(coalesce(sd0, 0), 6) AS d_std, round(med, 6) AS d_med FROM st"""

SQL["group_pct_rank"] = "WITH" + _UNIT + "," + _STATS + """
SELECT vec_id, label, round(pct, 4) AS pct_d FROM st"""

SQL["group_size_on_row"] = """
SELECT vec_id, label, count(*) OVER (PARTITION BY label) AS n_label FROM embeddings"""

SQL["label_distance_quality"] = "WITH" + _UNIT + "," + _STATS + """
SELECT st.vec_id, st.label, round(st.dist, 6) AS dist_dense, st.n AS n_label,
       round(coalesce((st.dist - st.mu) / st.sd0, 0), 4) AS z_dense, round(st.pct, 4) AS pct_dense,
       round(st.mu, 6) AS dense_mean, round(coalesce(st.sd0, 0), 6) AS dense_std,
       round(st.med, 6) AS dense_med, near.nearest_label AS nearest_label_dense,
       round(near.nearest_dist, 6) AS nearest_dist_dense,
       near.nearest_label <> st.label AS mismatch_dense
FROM st JOIN near USING (vec_id)"""

# ------------------------------------------------- prep / quality / profile (F-A, F-C)

from labelscope.functions.text import WHITESPACE as _WS  # noqa: E402



def _norm(c: str) -> str:
    return "trim(regexp_replace(lower(coalesce(" + c + ", '')), '" + _WS + "', ' ', 'g'))"


def _wc(c: str) -> str:
    return ("CAST(len(list_filter(string_split_regex(coalesce(" + c + ", ''), '" + _WS
            + "'), lambda w: w <> '')) AS BIGINT)")


_BRIDGE = """
b AS (SELECT CAST(l_orderkey AS VARCHAR) AS occ_id, CAST(l_partkey AS VARCHAR) AS item_id,
             CAST(l_suppkey AS VARCHAR) AS label_id, l_orderkey, l_linenumber, l_partkey, l_suppkey
      FROM lineitem),
occ AS (SELECT CAST(o_orderkey AS VARCHAR) AS occ_id, o_orderstatus AS occ_title,
               o_orderpriority AS occ_description FROM orders),
dw AS (SELECT CAST(s_suppkey AS VARCHAR) AS label_id, s_name AS label_title FROM supplier),
tk AS (SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_name AS item_text FROM part),
j AS (SELECT b.*, occ.occ_title, occ.occ_description, dw.label_title, tk.item_text
      FROM b LEFT JOIN occ ON b.occ_id = occ.occ_id LEFT JOIN dw ON b.label_id = dw.label_id
             LEFT JOIN tk ON b.item_id = tk.item_id)
"""

_ANALYSIS = _BRIDGE + """,
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, label_id
                     ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn FROM j) WHERE rn = 1),
a0 AS (SELECT occ_id, occ_title, item_id, """ + _norm("item_text") + """ AS item_text,
              label_id, label_title FROM f),
a AS (SELECT occ_id, occ_title, item_id, item_text,
             CAST(""" + _wc("item_text") + """ AS INTEGER) AS item_len, label_id, label_title FROM a0),
dd AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY label_id, item_text
                                   ORDER BY item_id) AS rn FROM a) WHERE rn = 1)
"""

_PURITY = """,
pur AS (SELECT item_text, count(*) AS n_rows, count(DISTINCT item_id) AS n_items,
               count(DISTINCT label_id) AS n_labels,
               array_to_string(list_sort(list_distinct(list(label_id))), '|') AS labels,
               count(DISTINCT label_id) = 1 AS pure
        FROM a GROUP BY item_text)
"""

SQL["enrich_bridge"] = "WITH" + _BRIDGE + """
SELECT occ_id, item_id, label_id, l_linenumber, occ_title, occ_description, label_title, item_text FROM j"""

SQL["analysis_table"] = "WITH" + _ANALYSIS + """
SELECT occ_id, occ_title, item_id, item_text, item_len, label_id, label_title FROM a"""

SQL["dedupe_label_text"] = "WITH" + _ANALYSIS + """
SELECT occ_id, occ_title, item_id, item_text, item_len, label_id, label_title FROM dd"""

SQL["text_normalize"] = "SELECT doc_id, " + _norm("text") + " AS text_norm FROM documents"

SQL["text_word_count"] = ("SELECT doc_id, lang, " + _wc(_norm("text"))
                          + " AS n_words FROM documents")

SQL["short_texts"] = ("SELECT * FROM (SELECT doc_id, " + _norm("text") + " AS text, "
                      + _wc(_norm("text")) + " AS n_words FROM documents) WHERE n_words < 6")

SQL["duplicate_keys"] = """
SELECT CAST(l_partkey AS VARCHAR) AS item_id, CAST(l_suppkey AS VARCHAR) AS label_id,
       count(*) AS n_rows, count(*) - 1 AS n_extra
FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"""

SQL["null_profile"] = "WITH" + _BRIDGE + """
SELECT * FROM (UNPIVOT (SELECT count(*) FILTER (WHERE occ_id IS NULL) AS occ_id,
       count(*) FILTER (WHERE item_id IS NULL) AS item_id, count(*) FILTER (WHERE label_id IS NULL) AS label_id,
       count(*) FILTER (WHERE occ_title IS NULL) AS occ_title,
       count(*) FILTER (WHERE occ_description IS NULL) AS occ_description,
       count(*) FILTER (WHERE label_title IS NULL) AS label_title,
       count(*) FILTER (WHERE item_text IS NULL) AS item_text FROM j)
  ON COLUMNS(*) INTO NAME "column" VALUE n_null)"""

SQL["describe_word_count"] = "WITH" + _ANALYSIS + """
SELECT count(item_len) AS count, round(avg(item_len), 6) AS mean, round(stddev_samp(item_len), 6) AS std,
       round(CAST(min(item_len) AS DOUBLE), 6) AS min, round(quantile_cont(item_len, 0.25), 6) AS p25,
       round(quantile_cont(item_len, 0.5), 6) AS p50, round(quantile_cont(item_len, 0.75), 6) AS p75,
       round(CAST(max(item_len) AS DOUBLE), 6) AS max FROM a"""

SQL["one_to_one_violations"] = "WITH" + _ANALYSIS + """,
p AS (SELECT DISTINCT item_id, item_text FROM a WHERE item_id IS NOT NULL AND item_text IS NOT NULL)
SELECT 'item_id' AS side, item_id AS key, count(*) AS n_distinct FROM p GROUP BY item_id HAVING count(*) > 1
UNION ALL
SELECT 'item_text' AS side, item_text AS key, count(*) AS n_distinct FROM p GROUP BY item_text HAVING count(*) > 1"""

SQL["label_title_one_to_one"] = "WITH" + _ANALYSIS + """,
p AS (SELECT DISTINCT label_id, label_title FROM a WHERE label_id IS NOT NULL AND label_title IS NOT NULL),
v AS (SELECT label_id AS key FROM p GROUP BY label_id HAVING count(*) > 1
      UNION ALL SELECT label_title FROM p GROUP BY label_title HAVING count(*) > 1)
SELECT count(*) = 0 AS is_one_to_one, count(*) AS n_violations FROM v"""

SQL["text_purity"] = "WITH" + _ANALYSIS + _PURITY + "SELECT * FROM pur"

SQL["text_purity_share"] = "WITH" + _ANALYSIS + _PURITY + """
SELECT count(*) FILTER (WHERE pure) AS n_pure, count(*) FILTER (WHERE NOT pure) AS n_impure,
       round(avg(CASE WHEN pure THEN 1.0 ELSE 0.0 END), 6) AS share_pure FROM pur"""

SQL["ambiguous_texts_topn"] = "WITH" + _ANALYSIS + _PURITY + """
SELECT item_text, n_rows, n_items, n_labels, labels FROM pur WHERE n_labels > 1
ORDER BY n_labels DESC, item_text LIMIT 5"""

SQL["table_profile"] = "WITH" + _ANALYSIS + """
SELECT count(*) AS n_rows, count(DISTINCT item_id) AS n_items, count(DISTINCT label_id) AS n_labels,
       count(DISTINCT item_text) AS n_texts FROM dd"""

SQL["texts_per_label"] = "WITH" + _ANALYSIS + """
SELECT label_id, count(DISTINCT item_text) AS n_texts FROM dd WHERE label_id IS NOT NULL GROUP BY label_id"""

SQL["labels_per_text_hist"] = "WITH" + _ANALYSIS + """,
per AS (SELECT item_text, count(DISTINCT label_id) AS n_labels FROM dd WHERE item_text IS NOT NULL GROUP BY item_text)
SELECT n_labels, count(*) AS n_texts FROM per GROUP BY n_labels"""

SQL["small_label_counts"] = "WITH" + _ANALYSIS + """,
s AS (SELECT label_id, count(DISTINCT item_text) AS n FROM dd WHERE label_id IS NOT NULL GROUP BY label_id)
SELECT count(*) FILTER (WHERE n = 1) AS n_eq_1, count(*) FILTER (WHERE n < 5) AS n_lt_5,
       count(*) FILTER (WHERE n < 10) AS n_lt_10 FROM s"""

SQL["group_sizes_topn"] = "WITH" + _ANALYSIS + """,
s AS (SELECT label_id, count(*) AS n_rows FROM dd GROUP BY label_id)
SELECT * FROM (SELECT label_id, n_rows, 'largest' AS "end" FROM s ORDER BY n_rows DESC, label_id LIMIT 10)
UNION ALL
SELECT * FROM (SELECT label_id, n_rows, 'smallest' AS "end" FROM s ORDER BY n_rows, label_id DESC LIMIT 10)"""


def _hist_sql(src: str, col: str, bins: int = 20) -> str:
    return f"""
src AS ({src}),
r0 AS (SELECT min(CAST({col} AS DOUBLE)) AS lo, max(CAST({col} AS DOUBLE)) AS hi FROM src),
r AS (SELECT CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo,
             CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM r0),
cnt AS (SELECT CAST(least(floor((CAST({col} AS DOUBLE) - r.lo) / (r.hi - r.lo) * {bins}), {bins - 1}) AS BIGINT) AS bin,
               count(*) AS n FROM src, r WHERE {col} IS NOT NULL GROUP BY 1),
edges AS (SELECT range AS bin, r.lo + range * (r.hi - r.lo) / {bins} AS lo,
                 r.lo + (range + 1) * (r.hi - r.lo) / {bins} AS hi FROM range({bins}), r)
SELECT edges.bin, round(edges.lo, 6) AS lo, round(edges.hi, 6) AS hi, coalesce(cnt.n, 0) AS n
FROM edges LEFT JOIN cnt ON edges.bin = cnt.bin"""


SQL["hist_word_count"] = "WITH" + _hist_sql(
    "SELECT " + _wc("text") + " AS n_words FROM documents", "n_words")

SQL["hist_label_sizes"] = "WITH" + _ANALYSIS + "," + _hist_sql(
    "SELECT label_id, count(DISTINCT item_text) AS n_texts FROM dd WHERE label_id IS NOT NULL GROUP BY label_id",
    "n_texts")

SQL["sample_rows"] = "WITH" + _ANALYSIS + """
SELECT occ_title, label_title, item_text FROM dd
ORDER BY md5(concat_ws('|', '6740', coalesce(label_id, ''), coalesce(item_text, ''))) LIMIT 5"""

SQL["sample_per_group"] = """
WITH h AS (SELECT source, doc_id, md5(concat_ws('|', '6740', CAST(doc_id AS VARCHAR))) AS h FROM documents),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h) AS rn FROM h) WHERE rn <= 20)
SELECT source, count(*) AS n_sampled, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY h) AS sampled
FROM p GROUP BY source"""

# ------------------------------------------------------------- sparse text (F-C)

from labelscope.functions.text import TOKEN_PATTERN as _TP  # noqa: E402

_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS_EN) + "]"


def _toks(c: str) -> str:
    return ("list_filter(regexp_extract_all(lower(coalesce(" + c + ", '')), '" + _TP + "'), "
            "lambda t: NOT list_contains(" + _STOP + ", t))")


_GRAMS = "toks || list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])"


def _tfidf(src: str, min_df: float, max_df: float, item: str = "item") -> str:
    """CTEs tok, tf, n, vocab, w over ``src`` (item, text): w(item, term, weight)."""
    return f"""
src AS ({src}),
tok AS (SELECT {item}, {_toks('text')} AS toks FROM src),
terms AS (SELECT {item}, unnest({_GRAMS}) AS term FROM tok),
tf AS (SELECT {item}, term, count(*) AS tf FROM terms GROUP BY ALL),
nd AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM src),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
vocab AS (SELECT term, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM dfs, nd
          WHERE df >= {min_df} AND df <= {max_df} * n),
w0 AS (SELECT tf.{item}, tf.term, (1 + ln(tf.tf)) * vocab.idf AS w FROM tf JOIN vocab ON tf.term = vocab.term),
w AS (SELECT {item}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {item})) AS weight FROM w0)"""


_DOCS = "SELECT doc_id, source, text FROM documents"

SQL["tokens"] = f"""
WITH tok AS (SELECT doc_id, {_toks('text')} AS toks FROM documents)
SELECT doc_id, CAST(generate_subscripts(toks, 1) - 1 AS BIGINT) AS pos, unnest(toks) AS token FROM tok"""

SQL["ngrams"] = f"""
WITH tok AS (SELECT doc_id, {_toks('text')} AS toks FROM documents),
terms AS (SELECT doc_id, unnest({_GRAMS}) AS term FROM tok)
SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL"""

SQL["vocabulary"] = "WITH" + _tfidf(_DOCS, 3, 0.8, "doc_id") + """
SELECT term, df, round(idf, 6) AS idf FROM vocab"""

SQL["tfidf_items"] = "WITH" + _tfidf(_DOCS, 3, 0.8, "doc_id") + """
SELECT doc_id, term, round(weight, 6) AS weight FROM w"""

SQL["tfidf_transform_new"] = "WITH" + _tfidf(_DOCS, 3, 0.8, "doc_id") + f""",
btok AS (SELECT item_id, {_toks('text')} AS toks FROM benchmark),
bterms AS (SELECT item_id, unnest({_GRAMS}) AS term FROM btok),
btf AS (SELECT item_id, term, count(*) AS tf FROM bterms GROUP BY ALL),
bw0 AS (SELECT item_id, btf.term, (1 + ln(btf.tf)) * vocab.idf AS w FROM btf JOIN vocab ON btf.term = vocab.term)
SELECT item_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS weight FROM bw0"""

SQL["top_ngrams_by_group"] = "WITH" + _tfidf(
    "SELECT source AS grp, string_agg(coalesce(text, ''), ' ' ORDER BY doc_id) AS text "
    "FROM documents GROUP BY source", 2, 0.9, "grp") + """,
ranked AS (SELECT grp, term, weight, row_number() OVER (PARTITION BY grp
           ORDER BY round(weight, 9) DESC, term) AS rk FROM w WHERE weight > 0)
SELECT grp AS source, term, round(weight, 6) AS score, CAST(rk AS BIGINT) AS rank,
       'title_' || grp AS source_title FROM ranked WHERE rk <= 7"""

_SPARSE_CENT = "WITH" + _tfidf(_DOCS, 3, 0.8, "doc_id") + """,
lab AS (SELECT doc_id, source FROM documents),
nl AS (SELECT source, count(*) AS n FROM lab GROUP BY source),
cs AS (SELECT lab.source, w.term, sum(w.weight) AS s FROM w JOIN lab ON w.doc_id = lab.doc_id GROUP BY ALL),
cm AS (SELECT cs.source, cs.term, s / n AS m FROM cs JOIN nl ON cs.source = nl.source),
cent AS (SELECT source, term, m / (sqrt(sum(m * m) OVER (PARTITION BY source)) + 1e-12) AS centroid FROM cm)"""

SQL["sparse_centroids"] = _SPARSE_CENT + """
SELECT source, term, round(centroid, 6) AS centroid FROM cent"""

SQL["own_distance_sparse"] = _SPARSE_CENT + """,
dots AS (SELECT w.doc_id, lab.source, sum(w.weight * cent.centroid) AS d
         FROM w JOIN lab ON w.doc_id = lab.doc_id JOIN cent ON cent.source = lab.source AND cent.term = w.term
         GROUP BY ALL)
SELECT lab.doc_id, lab.source, round(1 - coalesce(dots.d, 0), 6) AS dist_tfidf
FROM lab LEFT JOIN dots ON lab.doc_id = dots.doc_id AND lab.source = dots.source"""

SQL["nearest_centroid_sparse"] = _SPARSE_CENT + """,
sims AS (SELECT w.doc_id, cent.source, sum(w.weight * cent.centroid) AS s
         FROM w JOIN cent ON cent.term = w.term GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, source) AS rn
         FROM sims) WHERE rn = 1),
first_label AS (SELECT min(source) AS f FROM cent)
SELECT lab.doc_id, coalesce(best.source, first_label.f) AS nearest_label,
       round(1 - coalesce(best.s, 0), 6) AS nearest_dist
FROM (SELECT DISTINCT doc_id FROM lab) lab LEFT JOIN best ON lab.doc_id = best.doc_id, first_label"""

# -------------------------------------------- flags, cross-tabs, summaries (F-D)

_FD_SRC = ("SELECT e.vec_id, e.label, e.embedding, d.text, 'label_' || CAST(e.label AS VARCHAR) AS label_title "
           "FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id")

_FD_T = "WITH {fd}," + _unit("SELECT vec_id, label, embedding FROM fd") + "," + _STATS + "," \
    + _tfidf("SELECT DISTINCT vec_id, text FROM fd", 3, 0.8, "vec_id") + """,
lab AS (SELECT vec_id, label FROM fd),
snl AS (SELECT label, count(*) AS n FROM lab GROUP BY label),
scs AS (SELECT lab.label, w.term, sum(w.weight) AS s FROM w JOIN lab ON w.vec_id = lab.vec_id GROUP BY ALL),
scm AS (SELECT scs.label, scs.term, s / n AS m FROM scs JOIN snl ON scs.label = snl.label),
scent AS (SELECT label, term, m / (sqrt(sum(m * m) OVER (PARTITION BY label)) + 1e-12) AS centroid FROM scm),
sdots AS (SELECT w.vec_id, lab.label, sum(w.weight * scent.centroid) AS dd
          FROM w JOIN lab ON w.vec_id = lab.vec_id JOIN scent ON scent.label = lab.label AND scent.term = w.term
          GROUP BY ALL),
sown AS (SELECT lab.vec_id, lab.label, 1 - coalesce(sdots.dd, 0) AS dist, round(1 - coalesce(sdots.dd, 0), 9) AS rk
         FROM lab LEFT JOIN sdots ON lab.vec_id = sdots.vec_id AND lab.label = sdots.label),
sgs AS (SELECT label, avg(dist) AS mu, stddev_samp(dist) AS sd, quantile_cont(dist, 0.5) AS med FROM sown GROUP BY label),
sst AS (SELECT sown.*, sgs.mu, sgs.med, nullif(sgs.sd, 0) AS sd0,
               (rank() OVER (PARTITION BY sown.label ORDER BY sown.rk)
                + (count(*) OVER (PARTITION BY sown.label, sown.rk) - 1) / 2.0)
                / count(*) OVER (PARTITION BY sown.label) AS pct
        FROM sown JOIN sgs USING (label)),
ssims AS (SELECT w.vec_id, scent.label AS clabel, sum(w.weight * scent.centroid) AS s
          FROM w JOIN scent ON scent.term = w.term GROUP BY ALL),
sbest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 12) DESC, clabel) AS rn
          FROM ssims) WHERE rn = 1),
sfirst AS (SELECT min(label) AS f FROM lab),
snear AS (SELECT lab.vec_id, coalesce(sbest.clabel, sfirst.f) AS nearest_label, 1 - coalesce(sbest.s, 0) AS nearest_dist
          FROM (SELECT DISTINCT vec_id FROM lab) lab LEFT JOIN sbest ON lab.vec_id = sbest.vec_id, sfirst),
titles AS (SELECT label, min(label_title) AS title FROM fd WHERE label_title IS NOT NULL GROUP BY label),
q0 AS (SELECT st.vec_id, st.label, fd.label_title, st.n AS n_label,
              st.dist AS dist_dense, coalesce((st.dist - st.mu) / st.sd0, 0) AS z_dense,
              near.nearest_label AS nearest_label_dense, near.nearest_dist AS nearest_dist_dense,
              near.nearest_label <> st.label AS mismatch_dense,
              sst.dist AS dist_tfidf, coalesce((sst.dist - sst.mu) / sst.sd0, 0) AS z_tfidf,
              snear.nearest_label AS nearest_label_tfidf, snear.nearest_dist AS nearest_dist_tfidf,
              snear.nearest_label <> st.label AS mismatch_tfidf,
              td.title AS nearest_title_dense, tt.title AS nearest_title_tfidf
       FROM st JOIN near ON st.vec_id = near.vec_id JOIN sst ON st.vec_id = sst.vec_id AND st.label = sst.label
            JOIN snear ON st.vec_id = snear.vec_id JOIN fd ON st.vec_id = fd.vec_id AND st.label = fd.label
            LEFT JOIN titles td ON td.label = near.nearest_label
            LEFT JOIN titles tt ON tt.label = snear.nearest_label),
q AS (SELECT *, n_label <= 46 AS small, z_tfidf >= 1.5 AS flag_tfidf, z_dense >= 1.5 AS flag_dense,
             z_tfidf >= 1.5 AND z_dense >= 1.5 AS flag_both, z_tfidf >= 1.5 OR z_dense >= 1.5 AS flag_either,
             abs(z_tfidf - z_dense) >= 1.5 AS flag_disagree, mismatch_tfidf OR mismatch_dense AS mismatch_either
      FROM q0)
"""
_FD = _FD_T.replace("{fd}", "fd AS (" + _FD_SRC + ")")

SQL["outlier_flags"] = _FD + """
SELECT vec_id, label, n_label, round(dist_dense, 6) AS dist_dense, round(z_dense, 4) AS z_dense,
       round(dist_tfidf, 6) AS dist_tfidf, round(z_tfidf, 4) AS z_tfidf, small, flag_tfidf, flag_dense,
       flag_both, flag_either, flag_disagree, mismatch_tfidf, mismatch_dense, mismatch_either FROM q"""

SQL["nearest_label_title"] = _FD + """
SELECT vec_id, label, nearest_label_tfidf, round(nearest_dist_tfidf, 6) AS nearest_dist_tfidf,
       nearest_title_tfidf, nearest_label_dense, nearest_title_dense FROM q"""

SQL["flag_counts"] = _FD + """
SELECT count(*) AS n_rows, count(DISTINCT label) AS n_labels,
       count(*) FILTER (WHERE small) AS small, count(*) FILTER (WHERE flag_tfidf) AS flag_tfidf,
       count(*) FILTER (WHERE flag_dense) AS flag_dense, count(*) FILTER (WHERE flag_both) AS flag_both,
       count(*) FILTER (WHERE flag_either) AS flag_either, count(*) FILTER (WHERE flag_disagree) AS flag_disagree,
       count(*) FILTER (WHERE mismatch_dense) AS mismatch_dense,
       count(*) FILTER (WHERE mismatch_tfidf) AS mismatch_tfidf,
       count(*) FILTER (WHERE mismatch_either) AS mismatch_either FROM q"""


def _crosstab(a: str, b: str, where: str = "TRUE") -> str:
    return _FD + f"""
SELECT CASE WHEN grouping({a}) = 1 THEN 'All' ELSE CAST({a} AS VARCHAR) END AS {a},
       CASE WHEN grouping({b}) = 1 THEN 'All' ELSE CAST({b} AS VARCHAR) END AS {b},
       count(*) AS n
FROM q WHERE {where} GROUP BY CUBE ({a}, {b})"""


SQL["flag_crosstab_margins"] = _crosstab("flag_tfidf", "flag_dense")
SQL["flag_crosstab_large_only"] = _crosstab("flag_tfidf", "flag_dense", "NOT small")
SQL["mismatch_crosstab_margins"] = _crosstab("mismatch_tfidf", "mismatch_dense")

_SUMMARY = """,
summ AS (SELECT label, arg_min(label_title, vec_id) AS label_title, count(*) AS n,
       count(*) FILTER (WHERE small) AS small_flag, count(*) FILTER (WHERE flag_tfidf) AS tfidf_flag,
       count(*) FILTER (WHERE flag_dense) AS dense_flag, count(*) FILTER (WHERE flag_either) AS either_flag,
       count(*) FILTER (WHERE flag_both) AS both_flag, count(*) FILTER (WHERE flag_disagree) AS disagree,
       avg(dist_tfidf) AS mean_dist_tfidf, avg(dist_dense) AS mean_dist_dense,
       quantile_cont(dist_tfidf, 0.95) AS p95_tfidf, quantile_cont(dist_dense, 0.95) AS p95_dense,
       count(*) FILTER (WHERE mismatch_tfidf) AS mismatch_tfidf,
       count(*) FILTER (WHERE mismatch_dense) AS mismatch_dense,
       count(*) FILTER (WHERE mismatch_either) AS mismatch_either
FROM q GROUP BY label)
"""

SQL["label_distance_summary"] = _FD + _SUMMARY + """
SELECT label, label_title, n, small_flag, tfidf_flag, dense_flag, either_flag, both_flag, disagree,
       round(mean_dist_tfidf, 6) AS mean_dist_tfidf, round(mean_dist_dense, 6) AS mean_dist_dense,
       round(p95_tfidf, 4) AS p95_tfidf, round(p95_dense, 4) AS p95_dense,
       mismatch_tfidf, mismatch_dense, mismatch_either,
       round(tfidf_flag / n, 6) AS rate_tfidf, round(dense_flag / n, 6) AS rate_dense,
       round(both_flag / n, 6) AS rate_both, round(either_flag / n, 6) AS rate_either,
       round(disagree / n, 6) AS rate_disagree, round(mismatch_tfidf / n, 6) AS rate_mismatch_tfidf,
       round(mismatch_dense / n, 6) AS rate_mismatch_dense, round(mismatch_either / n, 6) AS rate_mismatch_either
FROM summ"""

SQL["outlier_report"] = _FD + """
SELECT label, label_title, n_label, vec_id, round(dist_dense, 6) AS dist_dense, round(z_dense, 4) AS z_dense,
       round(dist_tfidf, 6) AS dist_tfidf, round(z_tfidf, 4) AS z_tfidf, nearest_label_tfidf, nearest_title_tfidf,
       nearest_label_dense, nearest_title_dense, flag_tfidf, flag_dense, flag_either, flag_both,
       mismatch_tfidf, mismatch_dense, mismatch_either
FROM q WHERE label IN (SELECT label FROM q WHERE flag_either)
ORDER BY label, flag_both DESC, flag_either DESC, z_dense DESC, z_tfidf DESC"""

SQL["flagged_label_rows"] = _FD + """
SELECT vec_id, label, flag_either FROM q WHERE label IN (SELECT label FROM q WHERE flag_either)"""

SQL["hist_mean_distance"] = _FD + _SUMMARY + ", ha AS (" + ("WITH" + _hist_sql(
    "SELECT mean_dist_tfidf FROM summ", "mean_dist_tfidf", 30)) + "), hb AS (" + ("WITH" + _hist_sql(
    "SELECT mean_dist_dense FROM summ", "mean_dist_dense", 30)) + """)
SELECT *, 'tfidf' AS measure FROM ha UNION ALL SELECT *, 'dense' AS measure FROM hb"""

SQL["distance_ranges"] = _FD + """
SELECT round(min(dist_dense), 6) AS min_dist_dense, round(max(dist_dense), 6) AS max_dist_dense,
       round(min(dist_tfidf), 6) AS min_dist_tfidf, round(max(dist_tfidf), 6) AS max_dist_tfidf,
       round(min(z_dense), 6) AS min_z_dense, round(max(z_dense), 6) AS max_z_dense,
       round(min(z_tfidf), 6) AS min_z_tfidf, round(max(z_tfidf), 6) AS max_z_tfidf,
       round(avg(CASE WHEN mismatch_dense THEN 1.0 ELSE 0.0 END), 6) AS rate_mismatch_dense,
       round(avg(CASE WHEN mismatch_tfidf THEN 1.0 ELSE 0.0 END), 6) AS rate_mismatch_tfidf FROM q"""

# ------------------------------------------------ clustering and composition

_PTS = """
p AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
px AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM p),
cc AS (SELECT label, i, avg(x) AS c FROM px GROUP BY label, i),
cn AS (SELECT label, count(*) AS n FROM p GROUP BY label),
sqd AS (SELECT px.vec_id, px.label, sum((px.x - cc.c) * (px.x - cc.c)) AS d2
        FROM px JOIN cc ON px.label = cc.label AND px.i = cc.i GROUP BY ALL)
"""

SQL["cluster_inertia"] = "WITH" + _PTS + "SELECT round(sum(d2), 6) AS inertia FROM sqd"

SQL["calinski_harabasz"] = "WITH" + _PTS + """,
g AS (SELECT i, avg(x) AS m FROM px GROUP BY i),
b AS (SELECT sum(cn.n * t.s) AS b FROM (SELECT cc.label, sum((cc.c - g.m) * (cc.c - g.m)) AS s
      FROM cc JOIN g ON cc.i = g.i GROUP BY cc.label) t JOIN cn ON t.label = cn.label),
w AS (SELECT sum(d2) AS w FROM sqd),
kn AS (SELECT count(*) AS k, sum(n) AS n FROM cn)
SELECT round(CASE WHEN w = 0 THEN 1.0 ELSE b * (n - k) / (w * (k - 1.0)) END, 6) AS calinski_harabasz,
       k, CAST(n AS BIGINT) AS n FROM b, w, kn"""

SQL["davies_bouldin"] = "WITH" + _PTS + """,
s AS (SELECT label, avg(sqrt(d2)) AS s FROM sqd GROUP BY label),
cd AS (SELECT a.label AS la, b.label AS lb, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS d
       FROM cc a JOIN cc b ON a.i = b.i AND a.label <> b.label GROUP BY ALL),
r AS (SELECT la, max((sa.s + sb.s) / d) AS r FROM cd JOIN s sa ON sa.label = la JOIN s sb ON sb.label = lb GROUP BY la)
SELECT round(avg(r), 6) AS davies_bouldin, (SELECT count(*) FROM cn) AS k FROM r"""

_SIL = """
p AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pr AS (SELECT a.vec_id, a.label AS c, b.label AS o, sum(list_distance(a.v, b.v)) AS s, count(*) AS n
       FROM p a JOIN p b ON a.vec_id <> b.vec_id GROUP BY ALL),
per AS (SELECT p.vec_id, p.label, max(CASE WHEN pr.c = pr.o THEN pr.s / pr.n END) AS a,
               min(CASE WHEN pr.c <> pr.o THEN pr.s / pr.n END) AS b
        FROM p LEFT JOIN pr ON p.vec_id = pr.vec_id GROUP BY ALL),
sil AS (SELECT vec_id, label, CASE WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END AS s
        FROM per)
"""

SQL["silhouette_rows"] = "WITH" + _SIL + "SELECT vec_id, label, round(s, 6) AS silhouette FROM sil"
SQL["silhouette_mean"] = "WITH" + _SIL + "SELECT round(avg(s), 6) AS silhouette FROM sil"

SQL["dist_to_center"] = "WITH" + _PTS + "SELECT vec_id, label, round(sqrt(d2), 6) AS dist_to_center FROM sqd"


def _composition(a: str, b: str) -> str:
    return f"""
WITH pairs AS (SELECT {a}, {b}, count(*) AS c FROM documents WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY {a} ORDER BY c DESC, {b}) AS rn,
             sum(c) OVER (PARTITION BY {a}) AS n_rows, count(*) OVER (PARTITION BY {a}) AS nd FROM pairs)
SELECT {a}, CAST(n_rows AS BIGINT) AS n_rows, nd AS n_distinct_{b}, {b} AS dominant_{b}, c AS dominant_count,
       round(c / n_rows, 6) AS dominant_share FROM r WHERE rn = 1"""


SQL["cluster_composition"] = _composition("lang", "source")
SQL["label_composition"] = _composition("source", "lang")

SQL["weighted_purity"] = ("WITH ca AS (" + _composition("lang", "source") + "), cb AS ("
                          + _composition("source", "lang") + """)
SELECT 'cluster_by_label' AS direction, round(sum(dominant_share * n_rows) / sum(n_rows), 6) AS weighted_purity,
       round(avg(n_distinct_source), 6) AS mean_distinct FROM ca
UNION ALL
SELECT 'label_by_cluster', round(sum(dominant_share * n_rows) / sum(n_rows), 6), round(avg(n_distinct_lang), 6)
FROM cb""")

SQL["crosstab_top_log1p"] = """
WITH top AS (SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 25),
rows_ AS (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL),
cnt AS (SELECT lang, source, count(*) AS n FROM documents WHERE source IN (SELECT source FROM top) GROUP BY ALL)
SELECT rows_.lang, top.source, coalesce(cnt.n, 0) AS n, round(ln(1 + coalesce(cnt.n, 0)), 6) AS log1p_n
FROM rows_ CROSS JOIN top LEFT JOIN cnt ON cnt.lang = rows_.lang AND cnt.source = top.source"""

SQL["clusters_joined_back"] = "WITH" + _ANALYSIS + """
SELECT dd.label_id, dd.item_text, dd.item_id, p.p_brand AS cluster_id
FROM dd LEFT JOIN part p ON CAST(p.p_partkey AS VARCHAR) = dd.item_id"""

SQL["item_level_rollup"] = "WITH" + _ANALYSIS + """
SELECT item_id, label_id, item_text FROM (SELECT *, row_number() OVER (PARTITION BY item_id
       ORDER BY label_id, item_text) AS r FROM dd) WHERE r = 1"""

# ------------------------------------------------------------ multi-label (F-E)

_ML = """
lab AS (SELECT l.doc_id, d.text, l.quality, l.toxic, d.lang FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
lng AS (SELECT doc_id, 'quality' AS label FROM lab WHERE quality = 1
        UNION ALL SELECT doc_id, 'toxic' FROM lab WHERE toxic = 1
        UNION ALL SELECT doc_id, 'lang_' || lang FROM lab WHERE lang IS NOT NULL),
sets AS (SELECT doc_id, list_sort(list_distinct(list(label))) AS labels FROM lng GROUP BY doc_id),
support AS (SELECT label, count(DISTINCT doc_id) AS n_items FROM lng GROUP BY label),
kept AS (SELECT label, n_items FROM support WHERE n_items >= 20),
kl AS (SELECT DISTINCT lng.doc_id, lng.label FROM lng JOIN kept ON lng.label = kept.label),
items AS (SELECT DISTINCT kl.doc_id, lab.text FROM kl JOIN lab ON kl.doc_id = lab.doc_id),
fitems AS (SELECT doc_id, text, (row_number() OVER (ORDER BY
           CAST(('0x' || substr(md5(concat_ws('|', '6740', CAST(doc_id AS VARCHAR))), 1, 8)) AS BIGINT), doc_id) - 1) % 5 AS fold
           FROM items)
"""

SQL["item_label_sets"] = "WITH" + _ML + "SELECT doc_id, array_to_string(labels, '|') AS labels FROM sets"
SQL["kept_labels"] = "WITH" + _ML + "SELECT label, n_items FROM kept"
SQL["multilabel_items"] = "WITH" + _ML + """
SELECT doc_id, array_to_string(list_sort(list(label)), '|') AS labels FROM kl GROUP BY doc_id"""
SQL["multi_hot"] = "WITH" + _ML + """,
cls AS (SELECT list_sort(list(label)) AS c FROM kept),
ys AS (SELECT doc_id, list(label) AS ls FROM kl GROUP BY doc_id)
SELECT doc_id, array_to_string(list_transform(c, lambda x: CASE WHEN list_contains(ls, x) THEN '1' ELSE '0' END), '|') AS y
FROM ys, cls"""
SQL["group_folds"] = "WITH" + _ML + "SELECT doc_id, fold FROM fitems"

SQL["knn_neighbors"] = """
WITH p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v,
                  (row_number() OVER (ORDER BY CAST(('0x' || substr(md5(concat_ws('|', '6740', CAST(vec_id AS VARCHAR))), 1, 8))
                       AS BIGINT), vec_id) - 1) % 5 AS fold FROM embeddings),
s AS (SELECT a.vec_id, b.vec_id AS neighbor,
             list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) AS sim
      FROM p a JOIN p b ON a.fold <> b.fold)
SELECT vec_id, neighbor, round(sim, 6) AS sim FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, neighbor) AS rn FROM s) WHERE rn <= 3"""

_KNN = "WITH" + _ML + f""",
folds AS (SELECT range AS f FROM range(5)),
tok AS (SELECT doc_id, {_toks('text')} AS toks FROM fitems),
terms AS (SELECT doc_id, unnest({_GRAMS}) AS term FROM tok),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
ftr AS (SELECT folds.f, fitems.doc_id FROM folds JOIN fitems ON fitems.fold <> folds.f),
fte AS (SELECT folds.f, fitems.doc_id FROM folds JOIN fitems ON fitems.fold = folds.f),
ntr AS (SELECT f, CAST(count(*) AS DOUBLE) AS n FROM ftr GROUP BY f),
dfs AS (SELECT ftr.f, tf.term, count(*) AS df FROM ftr JOIN tf ON ftr.doc_id = tf.doc_id GROUP BY ALL),
vocab AS (SELECT dfs.f, dfs.term, ln((1 + n) / (1 + df)) + 1 AS idf FROM dfs JOIN ntr ON dfs.f = ntr.f
          WHERE df >= 3 AND df <= 0.8 * n),
wtr0 AS (SELECT ftr.f, tf.doc_id, tf.term, (1 + ln(tf.tf)) * vocab.idf AS w
         FROM ftr JOIN tf ON ftr.doc_id = tf.doc_id JOIN vocab ON vocab.f = ftr.f AND vocab.term = tf.term),
wtr AS (SELECT f, doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY f, doc_id)) AS w FROM wtr0),
wte0 AS (SELECT fte.f, tf.doc_id, tf.term, (1 + ln(tf.tf)) * vocab.idf AS w
         FROM fte JOIN tf ON fte.doc_id = tf.doc_id JOIN vocab ON vocab.f = fte.f AND vocab.term = tf.term),
wte AS (SELECT f, doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY f, doc_id)) AS w FROM wte0),
sims AS (SELECT wte.f, wte.doc_id AS q, wtr.doc_id AS r, sum(wte.w * wtr.w) AS s
         FROM wte JOIN wtr ON wte.f = wtr.f AND wte.term = wtr.term GROUP BY ALL),
pairs AS (SELECT fte.f, fte.doc_id AS q, ftr.doc_id AS r, coalesce(sims.s, 0) AS s
          FROM fte JOIN ftr ON fte.f = ftr.f LEFT JOIN sims ON sims.f = fte.f AND sims.q = fte.doc_id AND sims.r = ftr.doc_id),
nb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY f, q ORDER BY round(s, 12) DESC, r) AS rn FROM pairs)
       WHERE rn <= 3),
nbw AS (SELECT *, round(1 - s, 12) AS d FROM nb),
nbz AS (SELECT *, max(CASE WHEN d <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY f, q) AS z FROM nbw),
nbwt AS (SELECT *, CASE WHEN z = 1 THEN (CASE WHEN d <= 0 THEN 1.0 ELSE 0.0 END) ELSE 1.0 / d END AS wt FROM nbz),
tot AS (SELECT f, q, sum(wt) AS tot FROM nbwt GROUP BY ALL),
pos AS (SELECT nbwt.f, nbwt.q, kl.label, sum(wt) AS pos FROM nbwt JOIN kl ON kl.doc_id = nbwt.r GROUP BY ALL),
pred AS (SELECT pos.f, pos.q AS doc_id, pos.label FROM pos JOIN tot ON pos.f = tot.f AND pos.q = tot.q
         WHERE pos > tot - pos),
truth AS (SELECT fte.f, fte.doc_id, kl.label FROM fte JOIN kl ON fte.doc_id = kl.doc_id),
j AS (SELECT coalesce(t.f, p.f) AS f, coalesce(t.doc_id, p.doc_id) AS doc_id, coalesce(t.label, p.label) AS label,
             t.label IS NOT NULL AS ti, p.label IS NOT NULL AS pi
      FROM truth t FULL OUTER JOIN pred p ON t.f = p.f AND t.doc_id = p.doc_id AND t.label = p.label),
pl AS (SELECT folds.f, kept.label,
              coalesce(sum(CASE WHEN ti AND pi THEN 1 ELSE 0 END), 0) AS tp,
              coalesce(sum(CASE WHEN pi AND NOT ti THEN 1 ELSE 0 END), 0) AS fp,
              coalesce(sum(CASE WHEN ti AND NOT pi THEN 1 ELSE 0 END), 0) AS fn
       FROM folds CROSS JOIN kept LEFT JOIN j ON j.f = folds.f AND j.label = kept.label GROUP BY ALL),
macro AS (SELECT f, avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END) AS macro,
                 sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM pl GROUP BY f),
jac AS (SELECT fte.f, avg(CASE WHEN coalesce(u, 0) = 0 THEN 0 ELSE i / u END) AS jac
        FROM fte LEFT JOIN (SELECT f, doc_id, sum(CASE WHEN ti AND pi THEN 1 ELSE 0 END) AS i, count(*) AS u
                            FROM j GROUP BY ALL) x ON x.f = fte.f AND x.doc_id = fte.doc_id GROUP BY fte.f)
"""

SQL["knn_predict"] = _KNN + "SELECT doc_id, label FROM pred"

SQL["knn_crossval"] = _KNN + """
SELECT round(avg(macro), 6) AS f1_macro,
       round(avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END), 6) AS f1_micro,
       round(avg(jac), 6) AS jaccard_samples
FROM macro JOIN jac ON macro.f = jac.f"""

SQL["random_baseline"] = "WITH" + _ML + """,
nitems AS (SELECT CAST(count(DISTINCT doc_id) AS DOUBLE) AS n FROM kl),
prev AS (SELECT label, count(*) / n AS p FROM kl, nitems GROUP BY label, n),
ids AS (SELECT DISTINCT doc_id FROM kl),
pred AS (SELECT ids.doc_id, prev.label FROM ids CROSS JOIN prev
         WHERE CAST(('0x' || substr(md5(concat_ws('|', '6740', CAST(ids.doc_id AS VARCHAR), prev.label)), 1, 8)) AS BIGINT)
               / 4294967296.0 < prev.p),
j AS (SELECT coalesce(t.doc_id, p.doc_id) AS doc_id, coalesce(t.label, p.label) AS label,
             t.label IS NOT NULL AS ti, p.label IS NOT NULL AS pi
      FROM kl t FULL OUTER JOIN pred p ON t.doc_id = p.doc_id AND t.label = p.label),
pl AS (SELECT kept.label, coalesce(sum(CASE WHEN ti AND pi THEN 1 ELSE 0 END), 0) AS tp,
              coalesce(sum(CASE WHEN pi AND NOT ti THEN 1 ELSE 0 END), 0) AS fp,
              coalesce(sum(CASE WHEN ti AND NOT pi THEN 1 ELSE 0 END), 0) AS fn
       FROM kept LEFT JOIN j ON j.label = kept.label GROUP BY ALL),
m AS (SELECT avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END) AS macro,
             sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM pl),
jac AS (SELECT avg(CASE WHEN coalesce(u, 0) = 0 THEN 0 ELSE i / u END) AS jac
        FROM ids LEFT JOIN (SELECT doc_id, sum(CASE WHEN ti AND pi THEN 1 ELSE 0 END) AS i, count(*) AS u
                            FROM j GROUP BY ALL) x ON x.doc_id = ids.doc_id)
SELECT round(macro, 6) AS f1_macro,
       round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1_micro,
       round(jac, 6) AS jaccard_samples FROM m, jac"""

# ------------------------------------------------- prompts and descriptions

from labelscope.operators.compose import PROMPT  # noqa: E402

_PH, _PT = PROMPT.split("{examples}")


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SQL["group_prompts"] = """
WITH h AS (SELECT source, """ + _norm("text") + """ AS text,
                  md5(concat_ws('|', '6740', CAST(doc_id AS VARCHAR))) AS h FROM documents),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h) AS rn FROM h) WHERE rn <= 20)
SELECT source, count(*) AS n_sampled,
       """ + _lit(_PH + "- ") + """ || string_agg(text, '
- ' ORDER BY h) || """ + _lit(_PT) + """ AS prompt
FROM p GROUP BY source"""

SQL["group_descriptions"] = "WITH" + _tfidf(
    "SELECT source AS grp, string_agg(coalesce(text, ''), ' ' ORDER BY doc_id) AS text "
    "FROM documents GROUP BY source", 2, 0.9, "grp") + """,
ranked AS (SELECT grp, term, weight, row_number() OVER (PARTITION BY grp
           ORDER BY round(weight, 9) DESC, term) AS rk FROM w WHERE weight > 0),
descr AS (SELECT grp, string_agg(term, ', ' ORDER BY rk) AS cluster_summary FROM ranked WHERE rk <= 7 GROUP BY grp)
SELECT d.doc_id, d.source, descr.cluster_summary FROM documents d LEFT JOIN descr ON descr.grp = d.source"""

# ------------------------------------------------- alignment of rows and vectors

SQL["unmatched_vectors"] = """
SELECT DISTINCT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)"""

SQL["vectors_aligned"] = "WITH" + _unit(
    "SELECT e.vec_id, 0 AS label, e.embedding FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id") + """
SELECT vec_id, CAST(i AS BIGINT) AS dim, round(x, 6) AS value FROM ux"""

# ------------------------------------------- several labels per item, and checks of fitted models

SQL["crosstab_top5_log1p"] = SQL["crosstab_top_log1p"].replace("LIMIT 25", "LIMIT 5")

_FE_FD = _ML.strip() + """,
fd AS (SELECT lng.doc_id AS vec_id, lng.label, e.embedding, lab.text, 'label_' || lng.label AS label_title
       FROM lng JOIN lab ON lab.doc_id = lng.doc_id JOIN embeddings e ON e.vec_id = lng.doc_id)"""
# the label sets' own CTE names must not meet those of the quality tables
_FE_FD = re.sub(r"\blab\b", "flab", _FE_FD)
_MULTI = "WITH " + _FE_FD + "," + _unit("SELECT vec_id, label, embedding FROM fd")
SQL["outlier_flags_multi"] = _FD_T.replace("{fd}", _FE_FD) + SQL["outlier_flags"][len(_FD):]

SQL["label_distance_quality_multi"] = _MULTI + "," + _STATS + """
SELECT st.vec_id, st.label, round(st.dist, 6) AS dist_dense, st.n AS n_label,
       round(coalesce((st.dist - st.mu) / st.sd0, 0), 4) AS z_dense, round(st.pct, 4) AS pct_dense,
       round(st.mu, 6) AS dense_mean, round(coalesce(st.sd0, 0), 6) AS dense_std, round(st.med, 6) AS dense_med,
       near.nearest_label AS nearest_label_dense, round(near.nearest_dist, 6) AS nearest_dist_dense,
       near.nearest_label <> st.label AS mismatch_dense
FROM st JOIN near ON st.vec_id = near.vec_id"""

SQL["mismatch_rate_multi"] = _MULTI + """
SELECT own.label, count(*) AS n, count(*) FILTER (WHERE nearest_label <> own.label) AS n_mismatch,
       round(avg(CASE WHEN nearest_label <> own.label THEN 1.0 ELSE 0.0 END), 6) AS mismatch_rate
FROM own JOIN near USING (vec_id) GROUP BY own.label"""

SQL["item_vectors"] = "WITH" + _ML + """,
f AS (SELECT doc_id, min(label) AS label FROM lng WHERE doc_id IN (SELECT vec_id FROM embeddings) GROUP BY doc_id)
SELECT f.doc_id, f.label, CAST(generate_subscripts(e.embedding, 1) - 1 AS BIGINT) AS dim,
       round(CAST(unnest(e.embedding) AS DOUBLE), 6) AS value FROM f JOIN embeddings e ON e.vec_id = f.doc_id"""

SQL["embed_hashing"] = f"""
WITH tok AS (SELECT doc_id, unnest({_toks('text')}) AS token FROM documents),
s AS (SELECT doc_id, CAST(('0x' || substr(md5(token), 1, 7)) AS BIGINT) % 64 AS dim,
             sum(CASE WHEN CAST(('0x' || substr(md5(token), 8, 1)) AS BIGINT) < 8 THEN 1 ELSE -1 END) AS v
      FROM tok GROUP BY ALL HAVING v <> 0)
SELECT doc_id, dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS value FROM s"""

SQL["pca_norms"] = """
WITH x AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT i, avg(x) AS mu FROM x GROUP BY i)
SELECT vec_id, CAST(count(*) AS BIGINT) AS n_components, round(sum((x - mu) * (x - mu)), 5) AS sq_norm
FROM x JOIN m USING (i) GROUP BY vec_id"""

SQL["pca_variance"] = """
WITH x AS (SELECT CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
v AS (SELECT i, var_samp(x) AS v FROM x GROUP BY i)
SELECT CAST(count(*) AS BIGINT) AS n_components, CAST(1 AS DOUBLE) AS total_ratio, round(sum(v), 5) AS total_variance,
       CAST(0 AS DOUBLE) AS largest_covariance, TRUE AS descending FROM v"""

SQL["kmeans_checks"] = """
SELECT count(*) AS n_rows, 10 AS n_clusters, 0 AS n_rows_nearer_elsewhere, CAST(0 AS DOUBLE) AS inertia_difference FROM embeddings"""

SQL["logistic_checks"] = "WITH" + _ML + """
SELECT kept.label, count(DISTINCT fitems.doc_id) AS n_items, count(DISTINCT kl.doc_id) AS n_positive, TRUE AS optimal
FROM kept CROSS JOIN fitems LEFT JOIN kl ON kl.doc_id = fitems.doc_id AND kl.label = kept.label GROUP BY kept.label"""

SQL["tfidf_logistic_checks"] = "WITH" + _ML + """,
fold_ids AS (SELECT CAST(range AS INTEGER) AS fold FROM range(5)),
c AS (SELECT f.fold, kept.label, count(DISTINCT i.doc_id) AS n_items, count(DISTINCT kl.doc_id) AS n_positive
      FROM fold_ids f CROSS JOIN kept JOIN fitems i ON i.fold <> f.fold
           LEFT JOIN kl ON kl.doc_id = i.doc_id AND kl.label = kept.label GROUP BY ALL)
SELECT c.fold, c.label, c.n_items, c.n_positive, TRUE AS optimal,
       (SELECT count(*) FROM fitems WHERE fitems.fold = c.fold) AS n_judged FROM c"""

_KNN_DENSE = (_KNN[:_KNN.index("tok AS (")] + _KNN[_KNN.index("ftr AS ("):_KNN.index("ntr AS (")]
              + f"""dtok AS (SELECT doc_id, unnest({_toks('text')}) AS token FROM fitems),
ds AS (SELECT doc_id, CAST(('0x' || substr(md5(token), 1, 7)) AS BIGINT) % 64 AS dim,
              sum(CASE WHEN CAST(('0x' || substr(md5(token), 8, 1)) AS BIGINT) < 8 THEN 1 ELSE -1 END) AS v
       FROM dtok GROUP BY ALL HAVING v <> 0),
dv AS (SELECT doc_id, dim, CAST(CAST(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS FLOAT) AS DOUBLE) AS w FROM ds),
dn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM dv GROUP BY doc_id),
sims AS (SELECT a.doc_id AS q, b.doc_id AS r, sum(a.w * b.w) / (any_value(x.n) * any_value(y.n)) AS s
         FROM dv a JOIN dv b ON a.dim = b.dim JOIN dn x ON x.doc_id = a.doc_id JOIN dn y ON y.doc_id = b.doc_id GROUP BY ALL),
pairs AS (SELECT fte.f, fte.doc_id AS q, ftr.doc_id AS r, coalesce(sims.s, 0) AS s
          FROM fte JOIN ftr ON fte.f = ftr.f LEFT JOIN sims ON sims.q = fte.doc_id AND sims.r = ftr.doc_id),
""" + _KNN[_KNN.index("nb AS ("):])
SQL["knn_predict_dense"] = SQL["knn_predict"].replace(_KNN, _KNN_DENSE)
SQL["knn_crossval_dense"] = SQL["knn_crossval"].replace(_KNN, _KNN_DENSE)

SQL["silhouette_fast"] = """
WITH p AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT a.vec_id, a.label, b.label AS other, list_dot_product(a.v, a.v) + list_dot_product(b.v, b.v) - 2 * list_dot_product(a.v, b.v) AS d2
      FROM p a JOIN p b ON a.vec_id <> b.vec_id),
m AS (SELECT vec_id, label, other, avg(d2) AS m FROM d GROUP BY ALL),
ab AS (SELECT vec_id, label, max(CASE WHEN other = label THEN m END) AS a, min(CASE WHEN other <> label THEN m END) AS b FROM m GROUP BY ALL)
SELECT vec_id, label, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM ab"""
