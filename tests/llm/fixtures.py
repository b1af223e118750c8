"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeats, extra columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def words(n, seed=0):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))


def awkward(spark):
    long = words(4000, 1)
    near = words(60, 2)
    rows = [
        (1, None, "a"), (2, "", "a"), (3, "", None), (4, "Hello World", "a"), (5, "hello world", "b"), (5, "hello world", "b"),
        (6, long, "b"), (7, long.upper(), "b"), (None, "no id", "c"), (8, near, "a"), (9, near + " tail", "a"), (10, "one", "a"), (11, "Ünïcode ẞ text", "a"),
    ]
    return docs(spark, rows)
