"""Retrieval evaluation (OP-13, EV-1 to EV-4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamkit.functions.text import nfc_title


def retrieval_metrics(cases: DataFrame, results: DataFrame, k: int = 10) -> DataFrame:
    """AGG-17: per case (query_id, expected key): recall@k, reciprocal rank, nDCG@k, zero results.

    ``cases`` has (query_id, key) per expected key, ``results`` (query_id, key, position), positions
    from one. A key counts once, at its first position."""
    if k < 1:
        raise ValueError("k is one at least")
    expected = cases.select("query_id", "key").distinct()
    top = results.where(F.col("position") <= k)
    first = top.groupBy("query_id", "key").agg(F.min("position").alias("position"))
    hits = expected.join(first, ["query_id", "key"])
    gain = 1 / F.log2(F.col("position") + 1)
    got = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.min("position").alias("first"), F.sum(gain).alias("dcg"))
    totals = expected.groupBy("query_id").agg(F.count(F.lit(1)).alias("expected"))
    found = top.select("query_id").distinct().withColumn("_any", F.lit(True))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("expected"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return totals.join(got, "query_id", "left").join(found, "query_id", "left").select(
        "query_id",
        F.round(F.coalesce(F.col("hits") / F.col("expected"), F.lit(0.0)), 9).alias("recall"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 9).alias("reciprocal_rank"),
        F.round(F.coalesce(F.col("dcg") / ideal, F.lit(0.0)), 9).alias("ndcg"),
        F.col("_any").isNull().alias("zero_results"),
    )


def retrieval_summary(metrics: DataFrame, min_recall: float = 0.8, min_mrr: float = 0.7) -> DataFrame:
    """AGG-18: one row."""
    out = metrics.agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg("recall"), 9).alias("recall"), F.round(F.avg("reciprocal_rank"), 9).alias("mrr"), F.round(F.avg("ndcg"), 9).alias("ndcg"), F.count_if("zero_results").alias("zero_results"))
    return out.withColumn("passes", F.coalesce((F.col("recall") >= min_recall) & (F.col("mrr") >= min_mrr), F.lit(False)))


def evaluate_retrieval(cases: DataFrame, search: Callable[[DataFrame], DataFrame], k: int = 10, limit: int = 10) -> DataFrame:
    """OP-13, JN-20: the metrics of every case (query_id, what the search asks for, expected_titles):
    the search is run for all cases in one plan, and its results are matched by normalised title.

    ``search`` gives (query_id, rank, title) with at most ``limit`` results a query, ranks from zero.
    Of results of one title the first counts; a title that is expected twice counts once."""
    if not 1 <= k <= limit:
        raise ValueError("k lies between one and the search's limit")
    title = nfc_title()
    expected = cases.select("query_id", F.explode("expected_titles").alias("key")).withColumn("key", title(F.col("key")))
    found = search(cases.drop("expected_titles")).select("query_id", title(F.col("title")).alias("key"), (F.col("rank") + 1).alias("position"))
    return retrieval_metrics(expected, found, k)
