import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = ["a's 'sfoo it're'll  I'M we've 'x \n\n foo\n bar  ", "", " ", "  \n", " <|endoftext|> a  <|endoftext|>b<|endoftext|>", "<|endoftext|", "x" * 5000,
        "don't''s '''s 'lla 'l 'r 're've", "'", "a'", "'s", " 's", "\t's", "1's!'s", "\r\n\r\n a", "ab" * 400 + " " + "é" * 300, "\x85 \x1c᠎​ a"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def tables():
    from labelscope.llm.bpe import Codec
    return Codec(PATH)


def same(tables, library, texts):
    ids, at = tables.encode(texts)
    for k, t in enumerate(texts):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids[at[k]:at[k + 1]].tolist() == want, t[:100]
        assert tables.decode(want) == library.decode(want, skip_special_tokens=False)


def test_hard_texts(tables, library):
    same(tables, library, HARD)
    same(tables, library, ["", ""])
    same(tables, library, [])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab sTt'rvelmd \n\t\r.,!?12é中😀́ 　\x85½\x1c​\x00Ⅷ")) | st.characters(codec="utf-8"),
                        max_size=40), max_size=5))
def test_any_text_as_the_library_encodes_it(tables, library, texts):
    same(tables, library, texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=30))
def test_any_ids_as_the_library_decodes_them(tables, library, ids):
    assert tables.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_long_words_merge_as_short_ones_do(tables):
    rnd = random.Random(3)
    for n in (1, 2, 3, 50, 256):
        word = "".join(rnd.choice("aeinrst") for _ in range(n)).encode()
        assert tables.merge_long(word) == tables.encode([word.decode()])[0].tolist()


def test_boundaries_close_the_parts(tables):
    import numpy as np
    word = b"unbelievable"
    part, edge = tables.merge_rows(np.frombuffer(word, np.uint8), np.zeros(1, np.int64), np.array([len(word)]), 16)
    n = int((part >= 0).sum())
    assert edge[0, 0] == 0 and edge[0, n] == len(word)
    spelled = [tables.spelled[int(i)].as_py() for i in part[0, :n]]
    assert spelled == [word[a:b] for a, b in zip(edge[0, :n], edge[0, 1:n + 1])]


def digest(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)))


@pytest.mark.parametrize("slab", [1 << 22, 500])
def test_round_trip_of_awkward_documents(docs, texts, library, slab):
    from labelscope.llm.bpe import decode, encode, round_trip
    got = round_trip(docs, PATH, slab).collect()
    key = lambda x: tuple(map(repr, x))
    assert sorted(map(tuple, got), key=key) == sorted(((d, *digest(library, t)) for d, t in texts), key=key)
    coded = encode(docs, PATH, slab)
    assert sorted((tuple(r) for r in coded.collect()), key=key) == sorted(
        ((d, library.encode(t or "", add_special_tokens=False).ids) for d, t in texts), key=key)
    assert sorted((tuple(r) for r in decode(coded, PATH).collect()), key=key) == sorted(((d, t or "") for d, t in texts), key=key)


def test_empty_table_and_null_ids(spark, no_docs):
    from labelscope.llm.bpe import decode, round_trip
    assert round_trip(no_docs, PATH).collect() == []
    rows = spark.createDataFrame([(1, None), (2, []), (3, [40, None, 60000])], "doc_id long, ids array<int>")
    assert sorted(map(tuple, decode(rows, PATH).collect())) == [(1, ""), (2, ""), (3, "I")]


def test_query_against_the_library(spark, library):
    from labelscope.llm.queries import op12_bpe_round_trip
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in op12_bpe_round_trip(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r["doc_id"]: digest(library, r["text"]) for r in rows}


def test_other_kinds_of_files_are_refused():
    from labelscope.llm.bpe import Codec
    with pytest.raises(ValueError):
        Codec(public_tokenizers.path("word_bpe_49k.json"))
