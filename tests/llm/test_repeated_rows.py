"""Rows that repeat an id with another text, source or column; very long candidates."""
import hashlib
import random
from collections import Counter

import pytest

from labelscope.llm import mixing, near_dups, secret_scan
from tests.llm.test_native import secrets


def test_near_duplicates_of_each_text_of_a_document(spark):
    rnd = random.Random(1)
    a, b, c = ([f"w{rnd.randrange(10**6)}" for _ in range(60)] for _ in range(3))
    rows = [(1, " ".join(a)), (1, " ".join(b)), (3, " ".join([*b, "more"])), (2, " ".join([*a, "more"])), (7, " ".join(c)), (7, " ".join(c)),
            (8, " ".join([*c, "more"])), (9, "alone")]
    got = {(r.doc_id, r.component_id) for r in near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 9)}
    more = [(5, " ".join(a)), (4, " ".join(c)), (5, " ".join(c))]     # each text of 5 belongs to its own group
    got = Counter((r.doc_id, r.component_id) for r in near_dups.near_duplicates(spark.createDataFrame(rows + more, "doc_id long, text string")).collect())
    assert got == Counter([(1, 1), (1, 1), (2, 1), (3, 1), (5, 1), (4, 4), (5, 4), (7, 4), (7, 4), (8, 4), (9, 9)])


@pytest.mark.parametrize("bits", [2, 16])
def test_near_duplicates_when_symbols_collide(spark, monkeypatch, bits):
    """Two-bit symbols put most documents into common buckets: more is compared, the components stay."""
    monkeypatch.setattr(near_dups.signatures, "__defaults__", (11, bits))
    rnd = random.Random(6)
    rows = []
    for g in range(30):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(40)]
        rows += [(len(rows) + k, " ".join(base + ["x"] * (k % 2))) for k in range(3)]
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=16).collect()}
    assert got == {i: i - i % 3 for i, _ in rows}


def test_mixed_documents_keep_each_sources_words(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join("w" * rnd.randint(1, 3) for _ in range(rnd.randint(3, 30))), f"s{i % 2}", i) for i in range(40)]
    rows += [(i, t, f"s{1 - i % 2}", 100 + i) for i, t, _, _ in rows[:10]]                   # under the other source
    rows += [(i, t, s, 200 + k) for k in range(5) for i, t, s, _ in rows[:3]]                # again, with another column
    rows += [(None, "a b c", None, 1), (None, "a b c", None, 1), (None, None, "s0", 2)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int").repartition(3)
    plan = Counter()
    for r in mixing.mix(table, reserve=20).collect():
        plan[r.doc.source] += r.taken
    mixed = mixing.mix_documents(table, reserve=20).collect()
    got = Counter()
    for r in mixed:
        got[r.source] += len((r.text or "").split())
    assert got == plan and sum(got.values()) > 0
    again = mixing.mix_documents(table.repartition(7), reserve=20).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, mixed))
    assert set(map(tuple, mixed)) <= {tuple(r) for r in rows}


def test_secrets_in_long_candidates_and_many_matches(spark):
    rnd = random.Random(3)
    long = "".join(rnd.choice(secret_scan.ALPHABET) for _ in range(60_000))
    many = "token=abcdefg1 " * 3000
    got = {r.doc_id: r for r in secret_scan.report(spark.createDataFrame([(1, f"x {long} y"), (2, many)], "doc_id long, text string")).collect()}
    assert got[1].spans == secrets(f"x {long} y")[4] and got[2].n_assign == 3000
    spans = ",".join(f"assign:{15 * i}:{15 * i + 14}" for i in range(3000))
    assert got[2].spans == spans and got[2].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
