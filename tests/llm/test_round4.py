"""Findings of round 4: each of these tests failed before."""

import random

import numpy as np
from pyspark.sql import functions as F

from loamkit.llm import quality_bayes

LETTERS = "abcdefghijklmnopqrst"


def word(i):
    return "".join(LETTERS[i // 20**k % 20] for k in range(4))


def test_classifier_learns_from_every_label(spark):
    """Toxic words that only labels after the first 16 000 show, 2 300 of them."""
    schema = "doc_id long, toxic int, quality int, h long"
    ids = spark.range(24_000).select(F.col("id").alias("doc_id"), (F.col("id") % 9 == 0).cast("int").alias("toxic"), F.lit(1).alias("quality"))
    late = ids.withColumn("h", F.xxhash64("doc_id", "toxic", F.lit(0))).orderBy("h").collect()[16_000:]
    bad = [r.doc_id for r in late if r.toxic and r.h % 3]
    r, texts = random.Random(4), {}
    each = {i: [] for i in bad}
    for w in range(2_300):
        for i in r.sample(bad, 12):
            each[i].append("z" + word(w))
    texts = [(i, " ".join(["plain", *each.get(i, ())])) for i in range(24_000)]
    labels = spark.createDataFrame([(*x, 0) for x in ids.collect()], schema).drop("h")
    model = quality_bayes.fit(spark.createDataFrame(texts, "doc_id long, text string"), labels)
    assert {"z" + word(w) for w in range(2_300)} <= model.lexicon.keys()


def test_heads_equal_newton_on_the_whole(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(900, quality_bayes.WIDTH)) * np.arange(1, quality_bayes.WIDTH + 1)
    toxic, low = (x[:, 0] + r.normal(size=900) > 0.5).astype(float), np.ones(900)
    rows = spark.createDataFrame([(float(a), float(b), v.tolist()) for a, b, v in zip(toxic, low, x)], "toxic double, low double, x array<double>").repartition(5)
    heads = quality_bayes.fit_heads(rows)
    z = np.hstack([np.ones((900, 1)), (x - x.mean(0)) / (x.std(0) + 1e-6)])
    p = 1 / (1 + np.exp(-z @ heads["toxic"].weights))
    assert np.abs(z.T @ (toxic - p) - np.array([1e-6] + [1.0] * quality_bayes.WIDTH) * heads["toxic"].weights).max() < 1e-6
    assert not len(heads["low"].weights) and abs(heads["toxic"].base - np.log(toxic.mean() / (1 - toxic.mean()))) < 1e-12


def test_repeated_ids_and_labels_count_once(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, None), (None, "d"), (5, "e"), (5, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1), (2, 1, 0), (3, 1, 0), (4, 1, 0), (None, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    got = sorted(((r.toxic, r.low, r.text) for r in quality_bayes.labelled(docs, labels).collect()), key=repr)
    first = docs.where("doc_id = 1").orderBy(F.xxhash64("text")).first().text
    assert got == sorted([(0, 0, first), (1, 1, "c"), (0, 0, "c"), (0, 0, None), (0, 1, "e")], key=repr)
