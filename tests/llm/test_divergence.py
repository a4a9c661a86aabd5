import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import lower
from hypothesis import given, settings
from hypothesis import strategies as st

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_audit(rows, least, top):
    """Plain Python over whole tables: {(lang, source, part, item): (value, rank)}."""
    held, count, groups = Counter(), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall(lower(text))
        groups.add((lang, source))
        count[lang, source].update(terms)
        held.update((lang, t) for t in set(terms))
    kept = defaultdict(list)
    for (lang, t), n in held.items():
        if n >= least:
            kept[lang].append(t)

    def use(counter, terms):
        total = sum(counter[t] for t in terms)
        return {t: 1 + 10**9 * (counter[t] + 5) // (total + 5 * len(terms)) for t in terms}
    out = {}
    for lang, source in groups:
        own = use(count[lang, source], kept[lang])
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update(count[g])
        q = use(whole, kept[lang])
        pairs = [(sum(abs(own[t] - other[t]) for t in own), b) for a, b in groups if a == lang and b != source
                 for other in [use(count[lang, b], kept[lang])]]
        terms = [(own[t] - q[t], t) for t in own if count[lang, source][t] and own[t] > q[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                if part == "pair" or rank <= top:
                    out[lang, source, part, item] = value, rank
    return out


def audited(docs, **kw):
    from labelscope.llm.divergence import audit
    rows = audit(docs, **kw).collect()
    out = {(r["lang"], r["source"], r["part"], r["item"]): (r["value"], r["rank"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("least,top,slice_terms,block", [(3, 5, 7, 2), (1, 50, 2048, 128), (10**6, 5, 7, 2)])
def test_audit_matches_brute_force(docs, least, top, slice_terms, block):
    rows = [(r["text"], None if i % 13 == 0 else r["lang"], r["source"]) for i, r in enumerate(docs.collect())]
    table = docs.sparkSession.createDataFrame([(*r, "x") for r in rows], "text string, lang string, source string, n string").repartition(3)
    assert audited(table, least=least, top=top, slice_terms=slice_terms, block=block) == brute_audit(rows, least, top)


def test_audit_of_an_empty_table(no_docs):
    assert audited(no_docs) == {}


def test_single_source_and_text_without_terms(spark):
    table = spark.createDataFrame([("1 2 3", "en", "a"), (None, "en", "b"), ("x", "de", None)], "text string, lang string, source string")
    assert audited(table, least=1) == {("en", "a", "pair", "b"): (0, 1), ("en", "b", "pair", "a"): (0, 1)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=60), st.integers(1, 4))
def test_skyband_is_what_fewer_than_top_dominate(points, top):
    from labelscope.llm import divergence as d
    n, lang_n = (np.array([p[i] for p in points], np.int64) for i in (0, 1))
    term = np.random.default_rng(len(points)).permutation(len(points))
    above = [sum(n[j] >= n[i] and lang_n[j] <= lang_n[i] and term[j] < term[i] for j in range(len(points))) for i in range(len(points))]
    was, d.CHUNK = d.CHUNK, 8
    try:
        assert sorted(d.skyband(n, lang_n, term, top)) == [i for i in range(len(points)) if above[i] < top]
    finally:
        d.CHUNK = was


def test_shares_beyond_a_long():
    from labelscope.llm.divergence import shares
    count, by = np.array([0, 7, 10**13, 10**15 - 6]), np.array([3, 10**15, 3 * 10**13 + 1, 10**15])
    assert shares(count, by).tolist() == [1 + 10**9 * (int(c) + 5) // int(b) for c, b in zip(count, by)]


def test_skybands_drop_terms_before_they_are_valued(spark):
    from labelscope.llm.divergence import retain
    rows = [("en", "a", f"t{i:04}", 1 + i % 50, 100 + i) for i in range(3000)]
    few = retain(spark.createDataFrame(rows, "lang string, source string, term string, n long, lang_n long").repartition(2), 3)
    assert few.count() < 1000
