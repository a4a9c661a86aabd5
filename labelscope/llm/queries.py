"""One query per operator over the whole driver tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.sources.tables import read_table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from labelscope.llm.lm_scoring import perplexity_report
    return perplexity_report(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from labelscope.llm.token_output import tokenized
    return tokenized(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from labelscope.llm import quality_rules as q
    judged = q.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), keep=["doc_id"])
    return judged.select(F.col("doc.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", "kept", "score", "threshold")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from labelscope.llm.decontam import SHORT, leaks
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), **SHORT)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/doc_id.txt`` of a tree."""
    from labelscope.llm.licenses import scan
    docs = read_table(spark, sf_dir, "documents")
    path = F.concat(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), F.lit(".txt"))
    return scan(docs.select(path.alias("path"), "text")).withColumn(
        "doc_id", F.regexp_extract("path", "([0-9]+)[.]txt$", 1).cast("long")).select(
        "doc_id", "path", "license", "cosine", "origin", "licence_path")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from labelscope.llm.mixing import report
    return report(read_table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from labelscope.llm.secret_scan import report
    return report(read_table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from labelscope.llm.near_dups import near_duplicates
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from labelscope.llm import chat_format as c
    from labelscope.llm.scratch import parked
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    written = parked(c.format_conversations(turns), "chats")
    return c.digest(c.read_back(written))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from labelscope.llm.token_counts import count_tokens
    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from labelscope.llm.divergence import audit
    return audit(read_table(spark, sf_dir, "documents"))


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from labelscope.llm.bpe import round_trip
    return round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from labelscope.llm.whitening import whiten
    return whiten(read_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_token_output, op3_quality_rules, op4_decontamination, op5_license_scan,
                                  op6_mixing, op7_secret_scan, op8_near_duplicates, op9_chat_format, op10_token_counts, op11_source_divergence,
                                  op12_bpe_round_trip, op13_embedding_whitening)}

_MARKS = r"</?s>|\[/?(SYS|INST|OUT|ANON|ROLE|TEXT)\]"
_LENGTH = "(length({0}) + length({0}) - length(replace({0}, '\\', '')) + len(regexp_extract_all({0}, '" + _MARKS + "')))"

SQL: dict[str, str] = {"op9_chat_format": f"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
           UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (SELECT *, CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END AS c,
             {_LENGTH.format('text')} + CASE WHEN role IS NULL THEN 23 WHEN role IN ('system', 'assistant') THEN 21
                WHEN role = 'user' THEN 23 ELSE 38 + {_LENGTH.format('role')} END AS n_chars FROM t),
g AS (SELECT conv_id, count(*) AS n_turns,
             string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
             coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '') AS loss,
             string_agg(c, '' ORDER BY turn, role, text) AS roles, CAST(sum(n_chars) AS BIGINT) AS formatted_chars
      FROM m GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
       regexp_full_match(roles, 's?(ua)+') AS valid,
       CASE WHEN regexp_full_match(roles, 's?(ua)+') THEN 'answered' WHEN regexp_full_match(roles, 's?(ua)*u') THEN 'asked'
            WHEN roles = 's' THEN 'briefed' ELSE 'broken' END AS end_state
FROM g""", "op11_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
langs AS (SELECT lang, sum(lang_n) AS lang_total, CAST(count(*) AS HUGEINT) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * l.v) AS p,
             1 + (1000000000 * (k.lang_n + 5)) // (l.lang_total + 5 * l.v) AS q
      FROM g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
           LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
           LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q),
s AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM s WHERE part = 'pair' OR rank <= 50"""}
