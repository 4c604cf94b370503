import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, size int, shard string, label int"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with every oddity: nulls, empty, long, copies, near copies, repeated rows, clashing columns."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, prose(rng.randint(1, 120)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])) for i in range(60)]
    base = rows[5][1] + " " + prose(90)
    rows += [(100 + i, base, "en", "a") for i in range(5)]
    for i in range(8):
        words = base.split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((110 + i, " ".join(words), "en", "b"))
    passage = prose(60)
    rows += [(120 + i, prose(30) + "\n" + passage + "\t" + prose(20), "de", "c") for i in range(4)]
    rows += [(130, None, "en", "a"), (131, "", "en", None), (132, " \n\t ", None, None), (133, "12 34 !!", "en", "a"), (134, prose(9000), "en", "a"), (None, prose(40), "en", "b"), (None, prose(45), None, None), (None, None, None, None)]
    rows += [(140, rows[3][1] + " x", "en", "a")] * 3
    rows += [(141, "ha " * 200, "en", "b"), (142, "one two", "en", "b"), (143, "one\ttwo", "en", "b"), (144, "one two three four five", "en", "b"), (145, "über Übung ñandú 漢字 " * 20, "de", "c")]
    table = [(i, t, g, s, None if t is None else len(t), "k", 7, "s", 1) for i, t, g, s in rows]
    return spark.createDataFrame(table, DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def plain(docs):
    return [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
