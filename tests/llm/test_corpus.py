"""Near-duplicates, decontamination, mixing, LM scoring against brute force."""
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from labelscope.llm import decontam, lm_scoring, mixing, near_dups, text_kernel
from labelscope.llm.components import connected_components
from tests.llm.conftest import lower, words


def shingles(text):
    w = words(lower(text))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_word_hashes_match_words(texts):
    column, seen = pa.array([t for _, t in texts]), {}
    for row, data, starts in text_kernel.text_slabs(column, 3000):
        h, ds = text_kernel.word_hashes(data, starts)
        for k in range(len(starts) - 1):
            w = words(lower(texts[row + k][1]))
            assert len(w) == ds[k + 1] - ds[k]
            for a, b in zip(w, h[ds[k]:ds[k + 1]]):
                assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


def near_truth(rows):
    """component of every row, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    by_id = {}
    for i, (d, _) in enumerate(rows):
        for j in range(i):
            if d is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            n = len(sets[i] & sets[j])
            if 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return Counter((d, len(sets[i]), least[root(i)] if d is not None else None) for i, (d, _) in enumerate(rows)), by_id


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates_against_all_pairs(docs, texts, block):
    got = near_dups.near_duplicates(docs, block=block).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == near_truth(texts)[0]
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    kept = near_dups.filter_documents(docs, block=block)
    assert kept.columns == docs.columns


def test_near_duplicates_of_random_edits(spark):
    rnd = random.Random(9)
    rows = []
    for g in range(12):
        base = [f"w{rnd.randrange(10 ** 6)}" for _ in range(rnd.choice([6, 40, 150]))]
        for _ in range(25):
            w = list(base)
            for _ in range(rnd.randrange(0, max(1, len(w) // 30) + 1)):
                w[rnd.randrange(len(w))] = f"e{rnd.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(w)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dups.near_duplicates(table, block=16).collect())
    assert got == near_truth(rows)[0]
    assert near_dups.near_duplicates(table.limit(0)).count() == 0


def test_multi_index_buckets_hold_every_pair_in_the_bound(spark):
    from pyspark.sql import functions as F
    rnd = np.random.default_rng(4)
    base = rnd.integers(0, 256, (40, 50), dtype=np.uint8)
    rows, sigs = [], []
    for b in base:
        for errors in (0, 5, 19):
            s = b.copy()
            s[rnd.choice(50, errors, replace=False)] ^= 1
            sigs.append(s)
            rows.append((len(rows), bytearray(s.tobytes())))
    table = spark.createDataFrame(rows, "rep long, sig binary")
    keys = {r.rep: set(r.k) for r in table.select("rep", near_dups.bucket_keys(F.col("sig"), 10, 5).alias("k")).collect()}
    for i in range(len(sigs)):
        for j in range(i):
            if (sigs[i] != sigs[j]).sum() <= 19:
                assert keys[i] & keys[j]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (200, 200), (None, 3), (300, 50), (50, 300)]
    got = {r.u: r.v for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100, 300: 50}


def folded(text):
    return re.sub(r"\s+", " ", (text or "").lower())


def edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i] + [0] * len(text)
        for j, t in enumerate(text, 1):
            new[j] = min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1)
        row = new
    return min(row)


def test_leaks_against_alignment(spark):
    rnd = random.Random(1)
    prose = lambda n: "".join(rnd.choice("abcdefgh   éÉ") for _ in range(n)).strip()
    items = [(i, prose(rnd.choice([8, 13, 40, 90, 180]))) for i in range(12)] + [(12, None), (13, "")]
    rows = [(0, None), (1, ""), (2, prose(50))]
    for i, t in items[:12]:
        for n in (0, 2, 4, 9):
            s = list(t)
            for _ in range(n):
                k, o = rnd.randrange(len(s)), rnd.random()
                s[k:k + 1] = [] if o < 0.3 else [rnd.choice("xyz")] if o < 0.7 else [s[k], "q"]
            rows.append((len(rows), prose(30) + "\n" + "".join(s).upper()[rnd.choice([0, 0, 20]):] + "  " + prose(30)))
    docs = spark.createDataFrame([(*r, "item") for r in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id, r.n_windows, r.least_edits) for r in decontam.leaks(docs, bench).collect()}
    index, want = decontam.Index([x for x in items if x[1] is not None], 12, 100, 25, 0.05), set()
    for d, text in rows:
        for k, i in enumerate(index.ids):
            found = [c for w in index.win[index.win_of[k]:index.win_of[k + 1]]
                     if (c := edits(folded(items[i][1].strip())[w[1]:w[1] + w[2]], folded(text))) <= w[3]]
            if found:
                want.add((d, int(i), len(found), min(found)))
    assert got == want and want
    blocks = {(r.doc_id, r.item_id, r.n_windows, r.least_edits) for r in decontam.leaks(docs, bench, block_chars=200).collect()}
    assert blocks == want
    kept = decontam.filter_documents(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {w[0] for w in want}
    assert decontam.leaks(docs.limit(0), bench).count() == 0 and decontam.leaks(docs, bench.limit(0)).count() == 0


def test_knapsack_is_the_best_sum():
    rnd = random.Random(2)
    for _ in range(200):
        lengths = np.array(rnd.sample(range(1, 30), rnd.randint(1, 6)))
        counts = np.array([rnd.randint(0, 4) for _ in lengths])
        budget = rnd.randint(0, 60)
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + k * int(n) for s in sums for k in range(c + 1)}
        take = mixing.knapsack(lengths, counts, budget)
        assert (take <= counts).all() and int((take * lengths).sum()) == max(s for s in sums if s <= budget)


def test_targets_are_shared_by_weight_up_to_the_limit():
    got = mixing.targets([10, 1000, 0, 500], [1, 2, 3, 1], 1510, 3)
    assert got[0] == 30 and got[2] == 0 and sum(got) == pytest.approx(1510) and got[1] == pytest.approx(2 * got[3])


@pytest.mark.parametrize("reserve", [32768, 40])
def test_mixing_hits_its_targets(spark, docs, texts, reserve):
    hot = [(10 ** 6 + k, "x y z", "en", "hot", 1, "x", 1) for k in range(400)]
    table = docs.union(spark.createDataFrame(hot, docs.schema))
    got = mixing.report(table, reserve=reserve).collect()
    again = mixing.report(table.repartition(7), reserve=reserve).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == table.count()
    sizes = Counter((r.doc_id, len(words(r.text))) for r in table.collect())
    assert Counter((r.doc_id, r.size) for r in got) == sizes
    by = defaultdict(list)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        by[r.target, r.source_size].append(r)
    for (target, _), rows in by.items():
        taken = sum(r.taken for r in rows)
        assert taken <= target + 1e-6 and target - taken <= max(r.size for r in rows)
    total = sum(r.size for r in got)
    assert sum(t for t, _ in by) == pytest.approx(total)
    mixed = mixing.mix_documents(table, reserve=reserve)
    assert mixed.columns == table.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({d: n for d, n in (
        (d, sum(r.copies for r in got if r.doc_id == d)) for d in {r.doc_id for r in got}) if n})
    assert mixing.report(table.limit(0)).count() == 0


@pytest.mark.parametrize("order", [2, 3])
def test_lm_scores_against_plain_kneser_ney(docs, texts, order):
    got = Counter()
    for r in lm_scoring.perplexity_report(docs, order).collect():
        got[r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)] += 1
    rows = [(d, words(lower(t)) + ["\n"]) for d, t in texts]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    train = [w for d, w in rows if not held(d)]
    uni = Counter(x for w in train for x in w)
    total, distinct = sum(uni.values()), len(uni)
    pad = ["\t"] * (order - 1)
    n = {order: Counter(tuple((pad + w)[i:i + order]) for w in train for i in range(len(w)))}
    for k in range(order - 1, 0, -1):
        n[k] = Counter(g[1:] for g in n[k + 1])
    cont, d = {}, {}
    for k in n:
        cont[k] = defaultdict(lambda: [0, 0, 0, 0])
        for g, c in n[k].items():
            cont[k][g[:-1]][0] += c
            cont[k][g[:-1]][min(c, 3)] += 1
        cc = Counter(n[k].values())
        d[k] = [0, *lm_scoring.discounts(np.array([cc[i] for i in (1, 2, 3, 4)]))]

    def p(g):
        x = 1 / (distinct + 1)
        for k in range(1, order + 1):
            h = g[order - k:]
            t = cont[k].get(h[:-1])
            if t:
                c = n[k].get(h, 0)
                x = max(c - d[k][min(c, 3)], 0) / t[0] + sum(a * b for a, b in zip(d[k][1:], t[1:])) / t[0] * x
        return x
    want = Counter()
    for i, w in rows:
        score = sum(math.log10(p(tuple((pad + w)[j:j + order]))) for j in range(len(w)))
        base = sum(math.log10((uni[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
        want[i, held(i), len(w), sum(uni[x] > 0 for x in w), total, round(base, 6), round(score, 6)] += 1
    assert got == want


def test_lm_query_uses_trigrams(spark):
    from labelscope.llm.queries import op1_lm_scoring
    from labelscope.sources.tables import read_table
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    got = {r.doc_id: r.score for r in op1_lm_scoring(spark, "/root/testdata/sf0.001").collect()}
    scores = {n: {r.doc_id: r.score for r in lm_scoring.perplexity_report(docs, n).collect()} for n in (2, 3)}
    assert got == pytest.approx(scores[3]) and got != pytest.approx(scores[2])


@pytest.mark.parametrize("order,vocabulary", [(1, 50), (2, 300), (3, 3000), (4, 200_000)])
def test_lm_runs_are_small_and_read_back(order, vocabulary):
    rnd = np.random.default_rng(order)
    words = rnd.integers(0, 1 << 63, vocabulary).astype(np.uint64)
    columns = np.sort(rnd.choice(words, (order, 60_000)), axis=1)
    for c in columns[1:]:
        rnd.shuffle(c)
    counts = rnd.choice([1, 2, 254, 255, 70_000], 60_000, p=[0.9, 0.07, 0.01, 0.01, 0.01])
    run = lm_scoring.pack_run(columns, counts)
    again = lm_scoring.read_run(run, order)
    assert (again[0] == columns).all() and (again[1] == counts).all()
    assert vocabulary > 3000 or len(run) < (8 * order + 4) * 60_000 / 2
    assert all((x == y).all() for x, y in zip(lm_scoring.read_run(lm_scoring.pack_run(columns[:, :0], counts[:0]), order), (columns[:, :0], counts[:0])))


def test_lm_probabilities_sum_to_one(spark, docs, texts):
    model = lm_scoring.train(docs.select("text"), 2)
    scorer = lm_scoring.Scorer(model)
    vocabulary = sorted({x for _, t in texts for x in words(lower(t))})
    data = np.frombuffer(" ".join(vocabulary).encode(), np.uint8)
    h, _ = text_kernel.word_hashes(data, np.array([0, len(data)]))
    h = np.append(h, lm_scoring.END)
    unseen = np.append(h, np.uint64(12345))
    for context in (h[0], h[-2], lm_scoring.BEGIN, np.uint64(99)):
        p = 10 ** scorer.log10(np.stack([np.full(len(unseen), context), unseen]))
        assert p.sum() == pytest.approx(1.0, abs=1e-9)


def test_lm_of_no_rows(docs, no_docs):
    assert lm_scoring.perplexity_report(no_docs).count() == 0
    model = lm_scoring.train(no_docs.select("text"), 2)
    got = lm_scoring.score(docs, model).collect()
    assert all(r.score == 0.0 and r.n_known == 0 for r in got)
