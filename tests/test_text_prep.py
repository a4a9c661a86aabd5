"""Text expressions, keep-first de-duplication, enrichment and TSV reading
(traps T1-T5)."""

import pytest
from pyspark.sql import functions as F

from labelscope.functions.text import normalize_text, tokens, word_count, ngrams
from labelscope.operators import prep, quality
from labelscope.sources.tables import read_tsv


def test_normalize_and_count(spark):
    rows = [(1, ""), (2, None), (3, "a\tb  c"), (4, "  Été   LÀ "), (5, "x y")]
    df = spark.createDataFrame(rows, "id int, t string")
    out = {r.id: (r.n, r.c) for r in df.select("id", normalize_text("t").alias("n"),
                                              word_count("t").alias("c")).collect()}
    assert out[1] == ("", 0)
    assert out[2] == ("", 0)
    assert out[3] == ("a b c", 3)
    assert out[4] == ("été là", 2)
    assert out[5] == ("x y", 2)          # no-break space is whitespace (T5)


def test_tokens_unicode_and_stopwords(spark):
    df = spark.createDataFrame([("The été was a_b 12 x and THE end",)], "t string")
    toks = df.select(tokens("t").alias("k")).first().k
    assert toks == ["été", "a_b", "12", "end"]      # 'the', 'was', 'and' stop words; 'x' too short
    grams = df.select(ngrams(tokens("t")).alias("g")).first().g
    assert grams == ["été", "a_b", "12", "end", "été a_b", "a_b 12", "12 end"]   # bigrams after stop removal


def test_dedupe_keep_string_order(spark):
    rows = [("9", "d1", "x"), ("10", "d1", "x"), ("3", "d2", "x")]
    df = spark.createDataFrame(rows, "item_id string, label_id string, item_text string")
    out = prep.dedupe_label_text(df).orderBy("label_id").collect()
    assert [(r.label_id, r.item_id) for r in out] == [("d1", "10"), ("d2", "3")]   # '10' < '9' (T3)
    with pytest.raises(ValueError):
        prep.dedupe_keep(df, ["label_id"], [])


def test_enrich_validates_dimension(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2), ("z", 3)], "k string, v int")
    dim_ok = spark.createDataFrame([("a", "A"), ("b", "B")], "k string, title string")
    out = {r.k: r.title for r in prep.enrich(base, [(dim_ok, "k")]).collect()}
    assert out == {"a": "A", "b": "B", "z": None}          # left join keeps the missing key
    dim_dup = spark.createDataFrame([("a", "A"), ("a", "A2")], "k string, title string")
    with pytest.raises(prep.ValidationError):
        prep.enrich(base, [(dim_dup, "k")])


def test_tidy_columns(spark):
    df = spark.createDataFrame([(1, 2)], "`Shop*A-B Code` int, ` Row  ID ` int")
    assert prep.tidy_columns(df).columns == ["shop_a_b_code", "row_id"]
    assert prep.tidy_columns(df, "spaces").columns == ["shop*a-b_code", "row_id"]


def test_read_tsv_keeps_empty(spark, tmp_path):
    p = tmp_path / "t.tsv"
    p.write_text('id\ttext\tnote\n1\t\tx\n2\t"quoted word"\t\n', encoding="utf-8")
    rows = read_tsv(spark, str(p)).orderBy("id").collect()
    assert rows[0].text == "" and rows[0].note == "x"
    assert rows[1].text == "quoted word" and rows[1].note == ""


def test_require_columns_and_null_guard(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    with pytest.raises(prep.ValidationError):
        quality.require_columns(df, ["a", "c"])
    with pytest.raises(prep.ValidationError):
        quality.assert_no_null(df, "b")


def test_alignment_guard(spark):
    rows = spark.createDataFrame([(1,), (2,)], "id long")
    vecs = spark.createDataFrame([(1, [1.0])], "id long, v array<double>")
    assert [r.id for r in quality.unmatched_vectors(rows, vecs, "id", "id").collect()] == [2]
    with pytest.raises(prep.ValidationError):
        quality.assert_aligned(rows, vecs, "id", "id")


def test_parquet_and_csv_sinks_round_trip(spark, tmp_path):
    from labelscope.sources.tables import write_csv_report, write_parquet
    df = spark.createDataFrame([(1, ["a", "b"], 0.5), (2, [], None)], "id int, labels array<string>, x double")
    write_parquet(df, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p")).orderBy("id").collect()
    assert back[0].labels == ["a", "b"] and back[1].x is None
    write_csv_report(df, str(tmp_path / "c"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "c")).orderBy("id").collect()
    assert rows[0].labels == "a|b"


def test_dedupe_keep_with_map_column_and_desc_order(spark):
    df = spark.createDataFrame([("k", 1, {"a": 1}), ("k", 2, {"b": 2}), ("j", 5, {"c": 3})],
                               "key string, o int, m map<string,int>")
    got = {r.key: r.o for r in prep.dedupe_keep(df, ["key"], ["o"]).collect()}
    assert got == {"k": 1, "j": 5}
    got = {r.key: r.o for r in prep.dedupe_keep(df.drop("m"), ["key"], [F.col("o").desc()]).collect()}
    assert got == {"k": 2, "j": 5}
