"""Decontamination with short windows, against an alignment of every window."""
import random

import pytest

from labelscope.llm import decontam
from tests.llm.test_corpus import edits, folded


def truth(rows, items, window, stride):
    """(doc_id, item_id, windows, least edits) of every row of documents, by aligning every window."""
    index, want = decontam.Index(items, 12, window, stride, 0.05), []
    for d, text in rows:
        for k, (i, item) in enumerate(items):
            found = [c for w in index.win[index.win_of[k]:index.win_of[k + 1]]
                     if (c := edits(folded(item.strip())[w[1]:w[1] + w[2]], folded(text))) <= w[3]]
            if found:
                want.append((d, i, len(found), min(found)))
    return sorted(want, key=str)


@pytest.fixture(scope="module")
def case():
    rnd = random.Random(8)
    prose = lambda n: "".join(rnd.choice("abcdefgh   éÉ") for _ in range(n)).strip()
    items = [(i, prose(n)) for i, n in enumerate([8, 30, 64, 66, 150, 240])] + [(6, "ab " * 30)]
    rows = [(0, None), (1, "")]
    for i, t in items:
        for n in (0, 1, 3, 6):
            s = list(t)
            for _ in range(n):
                k, o = rnd.randrange(len(s)), rnd.random()
                s[k:k + 1] = [] if o < 0.3 else [rnd.choice("xyz")] if o < 0.7 else [s[k], "q"]
            cut = rnd.choice([0, 0, 7, 31])
            rows.append((len(rows), prose(20) + "\t" + "".join(s)[cut:cut + 110] + "\n " + prose(20)))
    rows += [(rows[9][0], rows[9][1]), (None, rows[10][1]), (rows[-1][0] + 1, "ab " * 60)]
    return items, rows


@pytest.mark.parametrize("block_chars", [4_000_000, 100])
def test_leaks_in_short_windows(spark, case, block_chars):
    items, rows = case
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, block int, ids string")
    table = items + [items[4], (7, None), (8, ""), (None, items[4][1])]  # equal, null and empty benchmark rows
    bench = spark.createDataFrame([(*r, 1) for r in table], "item_id long, text string, block int")
    want = truth(rows, items, **decontam.SHORT)
    got = decontam.leaks(docs, bench, block_chars=block_chars, **decontam.SHORT).collect()
    assert sorted(map(tuple, got), key=str) == want and len(want) > 10
    kept = decontam.filter_documents(docs, bench, block_chars=block_chars, **decontam.SHORT)
    leaking = {w[0] for w in want}
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        str(d) for d, _ in rows if d not in leaking)


@pytest.mark.parametrize("hits", [1, 50])
def test_bands_verified_by_parts(case, hits, monkeypatch):
    import numpy as np
    items, rows = case
    index = decontam.Index(items, 12, rate=0.05, **decontam.SHORT)
    raw = [(t or "").encode() for _, t in rows]
    data, starts = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    x, ds = decontam.normalise(data, starts)
    h = decontam.gram_hashes(x, 12)
    whole = decontam.find_leaks(index, x, ds, h, 12)
    monkeypatch.setattr(decontam, "HITS", hits)
    assert decontam.find_leaks(index, x, ds, h, 12) == whole and whole


def test_a_passage_between_two_long_windows_is_found(spark):
    rnd = random.Random(3)
    item = " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(60))
    docs = spark.createDataFrame([(1, "before " + item[13:85] + " after")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert decontam.leaks(docs, bench).count() == 0
    assert decontam.leaks(docs, bench, **decontam.SHORT).count() == 1


def test_no_rows(spark, docs, no_docs):
    bench = spark.createDataFrame([(1, "x" * 100)], "item_id long, text string")
    assert decontam.leaks(no_docs, bench, **decontam.SHORT).count() == 0
    assert decontam.leaks(docs, bench.limit(0), **decontam.SHORT).count() == 0
    assert decontam.filter_documents(docs, bench.limit(0), **decontam.SHORT).count() == docs.count()
