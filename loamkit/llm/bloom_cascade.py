"""URL filtering by suffix rules and, beyond them, a Bloom filter cascade over the key universe.

A cascade stores a list exactly for a known universe of keys: level 0 is a Bloom filter of the
listed keys, level 1 one of the unlisted keys that level 0 lets through, level 2 one of the listed
keys that level 1 lets through, and so on until a level lets nothing false through. A key is
looked up by walking the levels; no join with the list is needed. Levels are built by a
distributed bit_or. A shard is the part of the keys whose filters fit MAX_FILTER_BYTES; with more
shards each is built and applied in turn.

Defined cases: a null url, or one without "://", has empty host and path; the empty host is a key
like any other; repeated rows are judged one by one; an empty list or universe gives an empty
cascade, which allows all; extra columns are ignored."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamkit.llm._shared import ascii_lower, materialize

#: (verdict, rule); a rule is host/path-prefix and fits the host and its subdomains.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
FALSE_RATE = 0.02
MAX_FILTER_BYTES = 16 << 20
MAX_LEVELS = 24


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    u = F.coalesce(url, F.lit(""))
    pattern = r"^(?s).*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(u, pattern, 1)), F.regexp_extract(u, pattern, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is put on last, outermost
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def positions(a: np.ndarray, b: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    """(keys, hashes) bit positions from two 64-bit hashes of each key."""
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    with np.errstate(over="ignore"):
        x, y = _mix(a.astype(np.int64).view(np.uint64) ^ salt), _mix(b.astype(np.int64).view(np.uint64) + salt) | np.uint64(1)
        steps = np.arange(hashes, dtype=np.uint64)
        return ((x[:, None] + steps[None, :] * y[:, None]) % np.uint64(bits)).astype(np.int64)


class Cascade:
    """The levels of one shard: (bits, hashes, words), and the keys of the last level, if any."""

    def __init__(self, shards: int, shard: int):
        self.shards, self.shard = shards, shard
        self.levels: list[tuple[int, int, np.ndarray]] = []
        self.rest: frozenset[str] = frozenset()

    def passes(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        bits, hashes, words = self.levels[level]
        at = positions(a, b, level, bits, hashes)
        return ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool).all(axis=1)

    def listed(self, a: np.ndarray, b: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out, live = np.zeros(len(a), bool), np.arange(len(a))
        for level in range(len(self.levels)):
            through = self.passes(level, a[live], b[live])
            out[live[~through]] = level % 2 == 1
            live = live[through]
        out[live] = len(self.levels) % 2 == 1
        if self.rest:  # the set says for those left whether they are as the level before took them
            out[live] ^= np.array([keys[i] in self.rest for i in live], bool)
        return out


def _spots(level: int, bits: int, hashes: int) -> Callable[..., Column]:
    @F.pandas_udf("array<long>")
    def spots(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(list(positions(a.to_numpy(), b.to_numpy(), level, bits, hashes)))

    return spots


def _passing(shared: Broadcast, level: int) -> Callable[..., Column]:
    @F.pandas_udf("boolean")
    def passing(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(shared.value.passes(level, a.to_numpy(), b.to_numpy()))

    return passing


def _asked(shared: Broadcast) -> Callable[..., Column]:
    @F.pandas_udf("boolean")
    def asked(a: pd.Series, b: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series(shared.value.listed(a.to_numpy(), b.to_numpy(), keys.to_numpy()))

    return asked


def _hashes(key: str) -> list[Column]:
    return [F.xxhash64(key).alias("a"), F.xxhash64(key, F.lit(1)).alias("b")]


def build(keys: DataFrame, false_rate: float = FALSE_RATE, max_bytes: int = MAX_FILTER_BYTES, max_levels: int = MAX_LEVELS) -> Iterator[Cascade]:
    """Cascades, one per shard and each built when it is asked for, of the universe ``keys``
    (key string, listed boolean)."""
    spark = keys.sparkSession
    per_key = -math.log(false_rate) / math.log(2) ** 2
    hashes = max(1, round(per_key * math.log(2)))
    hashed = materialize(keys.select("key", *_hashes("key"), "listed"), "cascade-keys")
    total = hashed.where("listed").count()
    shards = max(1, math.ceil(total * per_key / 8 / max_bytes))
    for shard in range(shards):
        cascade = Cascade(shards, shard)
        live = hashed.where(F.pmod("a", F.lit(shards)) == shard)
        for level in count():
            mine = live.where(F.col("listed") == (level % 2 == 0))
            n = mine.count()
            if not n:
                break
            if level >= max_levels:
                cascade.rest = frozenset(r["key"] for r in mine.select("key").collect())
                break
            bits = max(64, math.ceil(n * per_key / 64) * 64)

            spot = mine.select(F.explode(_spots(level, bits, hashes)("a", "b")).alias("at"))
            words = spot.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("v")).toPandas()
            table = np.zeros(bits // 64, np.uint64)
            table[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64).view(np.uint64)
            cascade.levels.append((bits, hashes, table))
            shared = spark.sparkContext.broadcast(cascade)
            # the encoded keys stay for the next level but one; the others stay if they got through
            others = live.where(F.col("listed") != (level % 2 == 0)).where(_passing(shared, level)("a", "b"))
            live = materialize(mine.unionByName(others), "cascade-live")
            shared.unpersist()
        yield cascade


def is_listed(df: DataFrame, key: str, cascades: Iterable[Cascade], name: str = "listed") -> DataFrame:
    """df with a boolean column: whether the key (one of the universe, not null) is listed.

    One cascade is asked lazily. With more, the rows are written once, parted by shard, and each
    shard's rows are asked and written before the next shard is built."""
    spark, columns = df.sparkSession, [f"`{c}`" for c in df.columns if c != name]
    keyed = df.withColumns({"__bc_a": _hashes(key)[0], "__bc_b": _hashes(key)[1]})
    parts: list[DataFrame] = []
    for cascade in cascades:
        shared = spark.sparkContext.broadcast(cascade)
        if cascade.shards > 1 and not parts:
            keyed = materialize(keyed.withColumn("__bc_shard", F.pmod("__bc_a", F.lit(cascade.shards)).cast("int")), "cascade-rows", "__bc_shard")
        mine = keyed if cascade.shards == 1 else keyed.where(F.col("__bc_shard") == cascade.shard)
        asked = mine.withColumn("__bc_hit", _asked(shared)("__bc_a", "__bc_b", key)).select(*columns, F.col("__bc_hit").alias(name))
        if cascade.shards > 1:
            asked = materialize(asked, "cascade-asked")
            shared.unpersist()
        parts.append(asked)
    return reduce(DataFrame.unionByName, parts)


def judge(pages: DataFrame, rules: list[tuple[str, str]] | None = None, listed: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, host_listed) of every url.

    ``listed`` has the column key: blocked hosts. By default a host is listed when over half of
    its pages that a rule fits are blocked; pages that no rule fits then follow their host."""
    host, path = parts(F.col(f"`{url_col}`"))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules)
    rows = rows.withColumns({"rule": rule, "said": said})
    if listed is None:
        blocked, allowed = F.sum(F.when(F.col("said") == "block", 1).otherwise(0)), F.sum(F.when(F.col("said") == "allow", 1).otherwise(0))
        keys = rows.groupBy(F.col("host").alias("key")).agg((blocked > allowed).alias("listed"))
    else:
        keys = rows.select(F.col("host").alias("key")).distinct().join(listed.select("key").distinct().withColumn("hit", F.lit(True)), "key", "left").select("key", F.coalesce("hit", F.lit(False)).alias("listed"))
    judged = is_listed(rows, "host", build(keys), "host_listed")
    verdict = F.coalesce("said", F.when(F.col("host_listed"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "host_listed")
