"""Entropy candidates: parts before the allow list, letters without a digit, long ones."""
import random
import re
import time

import pytest

from labelscope.llm import secret_scan

KEY = "Zk3Jx9aQ7vB2nM5pL8rT"
LETTERS = "qWzRtYbKxLpVnGhSdFcJ"


def spans(spark, texts):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r.spans for r in secret_scan.report(table).orderBy("doc_id").collect()]


def test_what_follows_an_allowed_part_is_judged(spark):
    texts = [f"docs/examples/{KEY}", f"/sample_key={KEY}", f"a/example/dummy/{KEY} x", f"{KEY}/example", f"example_{KEY}", f"examples/{KEY[:19]}",
             f"x=========/{KEY}", "/path/to/sample/0123456789abcdefghij", f"EXAMPLE={KEY}=="]
    got = spans(spark, texts)
    at = lambda t: f"entropy_mixed:{t.index(KEY)}:{t.index(KEY) + len(KEY)}"
    assert got[:6] == [at(texts[0]), at(texts[1]), at(texts[2]), "", "", ""]
    assert KEY in texts[6][int(got[6].split(":")[1]):int(got[6].split(":")[2])] and got[7] == ""
    first, stop = map(int, got[8].split(":")[1:])
    assert first == 8 and KEY in texts[8][first:stop]


def test_letters_without_a_digit(spark):
    names = ["ThisIsAVeryLongCamelCaseName", "internationalizationofwords", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "getElementsByClassNameAndTagName",
             LETTERS[:19], f"{LETTERS}-x", f"pre_{LETTERS}"]
    assert spans(spark, names) == [""] * len(names)
    assert spans(spark, [f"a {LETTERS}, b", f"k={LETTERS}", f"dir/{LETTERS}/x", f"sample_1={LETTERS}", f"é😀 {LETTERS}\n"]) == [
        "entropy_letters:2:22", "entropy_letters:2:22", "entropy_letters:4:24", "entropy_letters:9:29", "entropy_letters:3:23"]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_letters_are_mostly_found(spark, seed):
    rnd = random.Random(seed)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    texts = ["".join(rnd.choice(alphabet) for _ in range(32)) for _ in range(200)]
    texts = [t for t in texts if not re.search(secret_scan.ALLOW, t)]
    assert sum(x != "" for x in spans(spark, texts)) >= 0.9 * len(texts)


def test_long_runs_take_time_in_proportion(spark):
    rnd = random.Random(4)
    run = "".join(rnd.choice("abcdefghijKLMNOPQRST") for _ in range(200_000))
    seconds = time.time()
    got = spans(spark, [run, "sample/" * 30_000 + KEY, "z" * 300_000, "=" * 300_000 + "1", "/" * 300_000])
    assert got[1].endswith(f":{7 * 30_000 + 20}") and got[2:] == ["", "", ""] and time.time() - seconds < 60
