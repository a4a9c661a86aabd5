import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="session")
def texts():
    """Small documents with every awkward case: (doc_id, text)."""
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdeéstn") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    out = [(i, prose(rnd.randint(60, 200)).capitalize() + rnd.choice([".", ",", "\n", ""])) for i in range(1, 60)]
    base = out[3][1]
    for k in range(60, 70):          # near copies
        w = base.split(" ")
        w[rnd.randrange(len(w))] = "changed"
        out.append((k, " ".join(w)))
    out += [(70, base), (71, base), (72, None), (73, ""), (74, " \t\n\x0b\x0c\r "), (75, "One two"), (76, "one  TWO"),
            (77, "a b c d e"), (78, prose(20000)), (79, "the the the the " * 40), (80, "x" * 5000),
            (81, "İ ß Σς é ́a     <|endoftext|> [INST] </s> 😀 don't I'll. AB, ab. 1.5"), (None, "no id " * 30),
            (None, None), (82, prose(100)), (82, out[5][1]), (83, out[6][1]), (83, out[6][1])]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The same as a table, with extra columns whose names the operators use themselves."""
    rows = [(d, t, ["en", None, "fr"][i % 3], None if i % 11 == 0 else f"s{i % 4}", i, "x", i) for i, (d, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, score long")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
