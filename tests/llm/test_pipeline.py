"""The pipeline's stages on the smallest tables, each against its own predecessor."""
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from labelscope.llm.scratch import parked
from labelscope.sources.tables import read_table
from tests.llm.conftest import words
from tests.llm.test_corpus import near_truth
from tests.llm.test_native import repeat_words

SF = "/root/testdata/sf0.001"


def folded(text):
    return re.sub(r"\s+", " ", (text or "").lower()).strip()


def test_every_stage(spark):
    docs = read_table(spark, SF, "documents")
    seen = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        seen.append((name, parked(stage(spark, seen[-1][1], SF), name)))
        if name != "tokens":
            assert seen[-1][1].columns == docs.columns
    rows = {name: df.collect() for name, df in seen}
    ids = {name: Counter(r.doc_id for r in x) for name, x in rows.items()}

    quality = {r.doc_id: r for r in rows["quality_rules"]}
    labels = {r.doc_id: r for r in read_table(spark, SF, "labels").collect()}
    for r in rows["documents"]:
        w = words(r.text)
        if len(w) < 50 or 100 * repeat_words(w) > 50 * len(w):
            assert r.doc_id not in quality
        elif r.doc_id in labels and labels[r.doc_id].quality == 1:
            assert r.doc_id in quality

    truth = near_truth([(r.doc_id, r.text) for r in rows["quality_rules"]])[0]
    assert set(ids["near_dups"]) == {d for d, _, c in truth if d == c}

    items = [folded(r.text) for r in read_table(spark, SF, "benchmark").collect()]
    gone = set(ids["near_dups"]) - set(ids["decontaminate"])
    for r in rows["near_dups"]:
        if any(i in folded(r.text) for i in items):
            assert r.doc_id in gone
    text = {r.doc_id: folded(r.text) for r in rows["near_dups"]}
    assert all(any(i[k:k + 12] in text[d] for i in items for k in range(0, len(i) - 11)) for d in gone)

    assert max(ids["mix"].values()) <= 3 and set(ids["mix"]) <= set(ids["decontaminate"])
    size = {r.doc_id: len(words(r.text)) for r in rows["decontaminate"]}
    total = sum(size.values())
    assert abs(sum(n * size[d] for d, n in ids["mix"].items()) - total) <= 0.02 * total

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in rows["mix"]:
        x = np.array(tokenizer.encode(r.text, add_special_tokens=False).ids + [2], "<u4")
        want[r.doc_id, len(x), zlib.crc32(x.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows["tokens"]) == want


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
