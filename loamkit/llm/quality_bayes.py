"""Quality classifier with hierarchical empirical Bayes over sites.

Two heads, toxic and low quality, are logistic regressions on a few dense features of the text:
shares of symbols, capitals, separators, repeats, and how strongly its words and word beginnings
point to a lexicon. The lexicon comes from grouped document counts by label; it is sent to the tasks,
as it holds only what points to toxic texts. Both are fitted on all labelled rows, the heads by
Newton's method with one pass of sums a step. The classifier's
evidence, a log likelihood ratio free of any base rate, is then combined with the rate of the
document's site, the document itself left out: hosts shrink towards the global rate and paths
towards their host by grouped aggregation, the more the fewer documents they have, with strengths
from the spread of hosts around the global rate and of paths around their hosts (method of
moments).

Defined cases: null or empty texts are rejected as low quality; very long texts count whole, one
row at a time; sites may be null and are then one site; labels that are null or lack a document are
ignored, equal ones count once, labels that contradict each other all count, and without labels of both kinds a head gives
no evidence and rejects nothing; of rows that repeat a labelled id, the one with the least text hash is fitted on;
repeated rows are judged one by one and all count; a path's only document has its host's rate, a
host's only document the global one; extra columns are kept by ``keep_good`` and ignored else,
whatever their names; an empty table gives an empty result."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamkit.llm._shared import materialize, sized, small_batches

#: Features that a task counts before it sends them off.
COUNTED = 1 << 18
#: Beginnings of words that are features beside whole words.
PREFIXES = (3, 4, 5, 6, 7)
HEADS = ("toxic", "low")
WORD = re.compile(r"[^\W\d_]+")
#: A lexicon entry's toxic documents and log odds at least; its rate of toxic documents is shrunk
#: to the sample's as if by SHRINK further documents.
MIN_DOCS, MIN_ODDS, SHRINK = 4, 2.5, 4.0


def features_of(words: set[str]) -> set[str]:
    found = set(words)
    for n in PREFIXES:
        found.update(w[:n] + "*" for w in words if len(w) > n)
    return found


def dense(text: str, lexicon: dict[str, float]) -> list[float]:
    """The dense features of one text."""
    raw = text.encode()
    n = max(1, len(raw))
    codes = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digit = codes[65:91].sum(), codes[97:123].sum(), codes[48:58].sum()
    space = codes[32] + codes[9:14].sum()
    plain = codes[44] + codes[46]  # comma and full stop
    high = codes[128:].sum()
    symbols = n - upper - lower - digit - space - plain - high
    tokens = text.split()
    words = WORD.findall(text.lower())
    t = max(1, len(tokens))
    kinds = set(words)
    hits = [lexicon[f] for f in features_of(kinds) & lexicon.keys()] if lexicon else []
    return [
        symbols / n,
        upper / max(1, upper + lower),
        codes[124] / t,
        sum(map(eq, tokens, tokens[1:])) / t,
        math.log1p(len(words)) - math.log1p(len(kinds)),
        digit / n,
        math.log1p(len(words)),
        n / t / 10,
        min(12.0, max(hits, default=0.0)),
        min(8.0, math.log1p(sum(hits))),
        min(8.0, 20 * len(hits) / (1 + len(kinds))),
    ]


WIDTH = len(dense("", {}))


@dataclass
class Head:
    """A fitted logistic regression; ``base`` is the log odds of its sample."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    base: float

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log likelihood ratios."""
        if not len(self.weights):
            return np.zeros(len(x))
        z = (x - self.mean) / self.scale
        return np.clip(z @ self.weights[1:] + self.weights[0], -30, 30) - self.base


@dataclass
class Model:
    lexicon: dict[str, float]
    heads: dict[str, Head]


def _moments(rows: DataFrame, heads: dict[str, Head]) -> dict[str, np.ndarray]:
    """For each head the second derivatives of its loss over all of (toxic, low, x), and as a last row
    the first ones, summed by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(heads), WIDTH + 2, WIDTH + 1))
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(-1, WIDTH)
            for k, (name, head) in enumerate(heads.items()):
                y = batch.column(HEADS.index(name)).to_numpy()
                z = np.hstack([np.ones((len(x), 1)), (x - head.mean) / head.scale])
                p = 1 / (1 + np.exp(-np.clip(z @ head.weights, -30, 30)))
                total[k, :-1] += (z * (p * (1 - p) + 1e-9)[:, None]).T @ z
                total[k, -1] += z.T @ (y - p)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["s"])

    parts = sorted(tuple(r["s"]) for r in rows.select(*HEADS, "x").mapInArrow(run, "s array<double>").collect())
    return dict(zip(heads, np.sum(parts, axis=0).reshape(len(heads), WIDTH + 2, WIDTH + 1)))


def fit_heads(rows: DataFrame, ridge: float = 1.0, steps: int = 30) -> dict[str, Head]:
    """The heads from (toxic, low, x), a stored table, by Newton's method with a ridge on all but the
    intercept. Each step takes one pass over the rows, of which nothing but sums leaves the tasks."""
    at = [F.col("x")[i] for i in range(WIDTH)]
    found = rows.agg(*[F.avg(h).alias(h) for h in HEADS], F.array(*map(F.avg, at)).alias("mean"), F.array(*map(F.stddev_pop, at)).alias("scale")).first()
    heads = {h: Head(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(0), 0.0) for h in HEADS}
    moving = {}
    for h in HEADS:
        if found[h] is not None and 0 < found[h] < 1:
            moving[h] = heads[h] = Head(np.array(found["mean"]), np.array(found["scale"]) + 1e-6, np.zeros(WIDTH + 1), math.log(found[h] / (1 - found[h])))
    penalty = np.diag([1e-6] + [ridge] * WIDTH)
    for _ in range(steps):
        if not moving:
            break
        for h, sums in _moments(rows, moving).items():
            step = np.linalg.solve(sums[:-1] + penalty, sums[-1] - penalty @ heads[h].weights)
            heads[h].weights = heads[h].weights + step
            if np.abs(step).max() < 1e-6:
                del moving[h]
    return heads


def feature_counts(rows: DataFrame) -> DataFrame:
    """(f, bad, n) of (toxic, text): the documents that have a feature, and those of them that are toxic;
    a feature has a row for each time that a task has sent off what it has counted."""

    def sent(counts: dict[str, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1))], names=["f", "bad", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for f in features_of(set(WORD.findall((text.as_py() or "").lower()))):
                    c = counts.setdefault(f, [0, 0])
                    c[0] += toxic
                    c[1] += 1
                if len(counts) >= COUNTED:
                    yield sent(counts)
                    counts = {}
        yield sent(counts)

    return rows.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(run, "f string, bad long, n long")


def _dense_udf(lexicon: dict[str, float]) -> Callable[..., Column]:
    @F.pandas_udf("array<double>")
    def featured(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: dense(t or "", lexicon))

    return featured


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(h, toxic, low, text): every different label with one row of its document. Texts are shuffled only
    where an id is repeated, or where the labels are too many to be sent to the tasks."""
    wanted = labels.select(F.col("doc_id").alias("__qb_id"), F.col("toxic").cast("int").alias("toxic"), (F.col("quality") == 0).cast("int").alias("low"))
    wanted = sized(materialize(wanted.dropna().distinct(), "fit-labels"))
    ids = docs.select(F.col("doc_id").alias("__qb_id")).join(wanted.select("__qb_id"), "__qb_id", "left_semi")
    repeated = sized(materialize(ids.groupBy("__qb_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__qb_id"), "fit-repeated"))
    found = docs.select(F.col("doc_id").alias("__qb_id"), "text").join(wanted, "__qb_id").select("__qb_id", "toxic", "low", "text")
    one = found.join(repeated, "__qb_id", "left_semi").groupBy("__qb_id", "toxic", "low").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    every = found.join(repeated, "__qb_id", "left_anti").unionByName(one)
    return every.select(F.xxhash64("__qb_id", "toxic", "low").alias("h"), "toxic", "low", "text")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model, from all labels, each with one row of its document.

    Two thirds of them, by hash, make the lexicon; the heads are fitted on the other third, so that
    they learn how far the lexicon can be trusted."""
    small_batches(docs.sparkSession)
    sample = materialize(labelled(docs, labels), "fit-sample")
    totals = {r["toxic"]: r["n"] for r in sample.where("pmod(h, 3) > 0").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    lexicon: dict[str, float] = {}
    if totals.get(0) and totals.get(1):
        per = feature_counts(sample.where("pmod(h, 3) > 0")).groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).where(F.col("bad") >= MIN_DOCS)
        base = totals[1] / (totals[0] + totals[1])
        shrunk = (F.col("bad") + SHRINK * base) / (F.col("n") + SHRINK)
        odds = F.log(shrunk / (1 - shrunk)) - math.log(base / (1 - base))
        lexicon = {r["f"]: float(r["odds"]) for r in per.select("f", odds.alias("odds")).where(F.col("odds") >= MIN_ODDS).collect()}
    rest = sample.where("pmod(h, 3) = 0").select(*[F.col(h).cast("double").alias(h) for h in HEADS], _dense_udf(lexicon)("text").alias("x"))
    return Model(lexicon, fit_heads(materialize(rest, "fit-features")))


def evidence(model: Model) -> Callable[..., Column]:
    """Log likelihood ratios (toxic, low) of texts."""

    @F.pandas_udf("struct<toxic:double,low:double>")
    def scored(texts: pd.Series) -> pd.DataFrame:
        x = np.array([dense(t or "", model.lexicon) for t in texts]).reshape(-1, WIDTH)
        return pd.DataFrame({h: model.heads[h].evidence(x) for h in HEADS})

    return scored


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _strength(sites: DataFrame, rate: Column, n: str, total: str) -> float:
    """How many documents the prior weighs, 2 to 10000: from how far the sites' rates lie from
    ``rate`` beyond what chance would give."""
    rate = F.least(F.greatest(rate, F.lit(1e-9)), F.lit(1 - 1e-9))
    row = sites.select(
        F.avg(F.pow(F.col(total) / F.col(n) - rate, 2)).alias("v"), F.avg(rate * (1 - rate)).alias("noise"), F.avg(rate * (1 - rate) / F.col(n)).alias("chance")
    ).first()
    between = max((row["v"] or 0) - (row["chance"] or 0), 1e-9)
    return min(10_000.0, max(2.0, (row["noise"] or 0) / between - 1))


def _chances(model: Model) -> dict[str, Column]:
    return {h: _sigmoid(F.col(f"ev.{h}") + model.heads[h].base) for h in HEADS}


def site_sums(scored: DataFrame, model: Model) -> tuple[DataFrame, dict[str, tuple[float, float, float]]]:
    """(site_host, site_path, n, host_n, <head>_sum, <head>_host_sum), and per head the global
    rate and the strengths of host and path priors.

    ``scored`` has site_host, site_path (not null) and ``ev``. The sites' own tables are written,
    as several passes read them."""
    paths = materialize(scored.groupBy("site_host", "site_path").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"{h}_sum") for h, c in _chances(model).items()]), "paths")
    hosts = materialize(paths.groupBy("site_host").agg(F.sum("n").alias("host_n"), *[F.sum(f"{h}_sum").alias(f"{h}_host_sum") for h in HEADS]), "hosts")
    totals = hosts.agg(F.sum("host_n").alias("n"), *[F.sum(f"{h}_host_sum").alias(h) for h in HEADS]).first()
    both = paths.join(sized(hosts), "site_host")
    priors = {}
    for h in HEADS:
        rate = (totals[h] or 0.0) / totals["n"] if totals["n"] else 0.5
        kh = _strength(hosts, F.lit(rate), "host_n", f"{h}_host_sum")
        own_host = (F.col(f"{h}_host_sum") + kh * rate) / (F.col("host_n") + kh)
        priors[h] = (rate, kh, _strength(both, own_host, "n", f"{h}_sum"))
    return both, priors


def with_rates(scored: DataFrame, sites: DataFrame, model: Model, priors: dict[str, tuple[float, float, float]]) -> DataFrame:
    """scored with <head>_host and <head>_rate: the shrunk rates of a row's host and path, from all
    rows but this one."""
    out = scored.join(sites, ["site_host", "site_path"])
    for h, own in _chances(model).items():
        rate, kh, kp = priors[h]
        out = out.withColumn(f"{h}_host", (F.col(f"{h}_host_sum") - own + kh * rate) / (F.col("host_n") - 1 + kh))
        out = out.withColumn(f"{h}_rate", (F.col(f"{h}_sum") - own + kp * F.col(f"{h}_host")) / (F.col("n") - 1 + kp))
    return out.drop("n", "host_n", *[f"{h}_sum" for h in HEADS], *[f"{h}_host_sum" for h in HEADS])


def _judged(scored: DataFrame, model: Model) -> DataFrame:
    sites, priors = site_sums(scored, model)
    out = with_rates(scored, sized(materialize(sites, "sites")), model, priors)
    for h in HEADS:
        out = out.withColumn(f"p_{h}", _sigmoid(F.col(f"ev.{h}") + _logit(F.col(f"{h}_rate"))))
    good = F.col("__qb_some")
    for h in HEADS:
        if len(model.heads[h].weights):
            good = good & (F.col(f"p_{h}") < 0.5)
    return out.withColumn("keep", good)


def _keyed(docs: DataFrame, model: Model, host_col: str, path_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"site_host": F.coalesce(F.col(host_col), F.lit("")), "site_path": F.coalesce(F.col(path_col), F.lit("")), "ev": evidence(model)(text), "__qb_some": text.rlike(r"\S")})


def classify(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, site, shrunk site rates, p_toxic, p_low, keep."""
    model = fit(docs, labels)
    rows = docs.select("doc_id", "text", F.col(f"`{host_col}`").alias("h"), F.col(f"`{path_col}`").alias("p"))
    scored = materialize(_keyed(rows, model, "h", "p").drop("text", "h", "p"), "scored")
    return _judged(scored, model).select("doc_id", "site_host", "site_path", "toxic_host", "toxic_rate", "low_host", "low_rate", "p_toxic", "p_low", "keep")


def keep_good(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """docs without those that the classifier rejects; all columns kept.

    Scored rows are written once with their texts, since sites need every score before a text can
    be judged."""
    model = fit(docs, labels)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(own, F.col("text"), F.col(f"`{host_col}`").alias("h"), F.col(f"`{path_col}`").alias("p"))
    scored = materialize(_keyed(rows, model, "h", "p").drop("text", "h", "p"), "scored-rows")
    return _judged(scored, model).where("keep").select("row.*")
