import random

import pytest

CLASH = (None, "r", True, 1, "s", 2, "i")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, fp string, length int, spans string, raw string, kept boolean, score int, shard string, w0 int, ids string"


@pytest.fixture(scope="session")
def texts():
    """Texts with every case: null, empty, blanks only, tiny, copies, near copies, very long, not ASCII."""
    r = random.Random(7)
    word = lambda: "".join(r.choice(["th", "er", "on", "é", "ß", "que", "ing", "A", "7"]) for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = text(300)
    near = base.split()
    near[7] = "zzz"
    shared = text(60)
    return [
        None, "", " \n\t", "one", "one two", "one two three", base, base, " ".join(near), base + " end", shared + "\n" + text(90), text(90) + "\n" + shared,
        "ab " * 400, text(9000), "😀 ünï\r\nx", "İstanbul ſecret K", *[text(r.randint(1, 120)) for _ in range(25)], "x", "x", "\x1c a\x0bb\x85c\xa0d",
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Those texts as documents, with repeated and null ids, nulls elsewhere and clashing extra columns."""
    rows = [(k, t, None if k % 5 else "en", f"s{k % 3}" if k % 7 else None, None, "id", "fp", k, *CLASH) for k, t in enumerate(texts)]
    rows += [(None, "one two", "en", "s1", 3, None, None, None, *CLASH), (3, "one", "en", "s1", 3, None, None, None, *CLASH), (3, "one", "en", "s1", 3, None, None, None, *CLASH)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
