"""Mixing sources to target weights by Pfair scheduling.

Every source's documents are cut into blocks. With target weight w, the source's j-th block is
released at slot floor(j / w) and due at slot ceil((j + 1) / w); one block runs per slot, among
released blocks the one due first. On one processor with weights that sum to one this
earliest-deadline-first order meets every deadline, so that after any number of slots a source has
had its weight's share of blocks to within less than one block. Weights are integers that sum to
SCALE over the number of slots, so that over the whole schedule their rounding moves no source by
a thousandth of a block at up to 10^7 slots. A new phase starts where a source runs out, with the
weights of those left. The driver takes one step per block and writes
the schedule in parts of PART_ROWS blocks, the most that it holds; the documents are joined to it. Every document keeps a place:
nothing is dropped or repeated.

Defined cases: a null source is a source of its own; sources without a target weight, or with one
of zero, together get one part in RESOLUTION; repeated rows take places of their own, in any order
among themselves, and are spread over tasks however many they are; texts are hashed, not moved about, so their length does not matter beyond the
one shuffle of the rows; extra columns of any type are kept, but for those named like the mix's own
(OUTPUTS), which are replaced; an empty table gives an empty mix."""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from fractions import Fraction
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamkit.llm._shared import materialize, new_path, row_hash, sized

BLOCK_DOCS = 16
RESOLUTION = 1000
#: Weights times slots; products with block numbers stay within 64 bits.
SCALE = 1 << 61
#: Rows of the schedule written at a time.
PART_ROWS = 1_000_000
#: Rows numbered in one group.
BUCKET_ROWS = 1_000
#: Buckets whose sizes are summed in one group; their sums are summed in a second step.
SUM_BUCKETS = 4_096
#: A bucket of more than this many times BUCKET_ROWS holds repeated rows, and is split.
HOT_BUCKET = 8
BUCKET = ["__pf_source", "__pf_bucket", "__pf_salt"]
OUTPUTS = ("mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_position")
#: Without given targets a source's weight is its number of documents to this power.
FLATTEN = 0.5


def whole_weights(raw: list[float], total: int, resolution: int = RESOLUTION) -> list[int]:
    """Weights as integers that sum to ``total``, by largest remainders."""
    exact = [Fraction(max(w, 0.0)) for w in raw]
    given, absent = sum(exact), sum(not w for w in exact)
    if absent:
        least = (given / (resolution - 1) or Fraction(1)) / absent
        exact = [w or least for w in exact]
    scale = Fraction(total) / (sum(exact) or 1)
    out = [max(1, int(w * scale)) for w in exact]
    for s in sorted(range(len(out)), key=lambda s: out[s] - exact[s] * scale)[: max(0, total - sum(out))]:
        out[s] += 1
    return out


def _earliest(weights: list[int]) -> Iterator[tuple[int, int]]:
    """(source, block) of slots 0, 1 and so on: of the released blocks the one due first."""
    total, slot = sum(weights), 0
    coming = [(0, s, 0) for s, w in enumerate(weights) if w]
    heapq.heapify(coming)
    ready: list[tuple[int, int, int]] = []
    while True:
        while coming and coming[0][0] <= slot:
            _, s, j = heapq.heappop(coming)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[s]), s, j))
        due, s, j = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a deadline was missed")
        yield s, j
        heapq.heappush(coming, ((j + 1) * total // weights[s], s, j + 1))
        slot += 1


def period(weights: list[int]) -> list[np.ndarray]:
    """Slots of each source's blocks over one period of sum(weights) slots."""
    out = [np.zeros(w, np.int64) for w in weights]
    for slot, (s, j) in zip(range(sum(weights)), _earliest(weights)):
        out[s][j] = slot
    return out


class Piece(NamedTuple):
    """Consecutive slots of a phase: the phase's first slot, the piece's first slot from there, the
    phase's weights, the blocks done before the phase, and each slot's source and block, counted from
    the phase's start."""

    start: int
    at: int
    weights: list[int]
    done: list[int]
    source: np.ndarray
    block: np.ndarray

    def table(self) -> np.ndarray:
        """The rows source, block, slot, release, deadline."""
        s, j, total = self.source, self.block, sum(self.weights)
        w, slot = np.array(self.weights, np.int64)[s], self.start + self.at + np.arange(len(s))
        return np.stack([s, np.array(self.done, np.int64)[s] + j, slot, self.start + j * total // w, self.start - (-(j + 1) * total // w)])


def _pieces(weights: list[int], blocks: list[int], rows: int = PART_ROWS) -> Iterator[Piece]:
    """The schedule of ``blocks[s]`` blocks of every source s, in pieces of at most ``rows`` slots."""
    done, start = [0] * len(blocks), 0
    while any(d < b for d, b in zip(done, blocks)):
        live, took, at = [w if d < b else 0 for w, d, b in zip(weights, done, blocks)], [0] * len(blocks), 0
        sources, numbers = array("q"), array("q")
        for s, j in _earliest(live):
            sources.append(s)
            numbers.append(j)
            took[s] += 1
            over = done[s] + j + 1 == blocks[s]
            if over or len(sources) == rows:
                yield Piece(start, at, live, list(done), np.array(sources, np.int64), np.array(numbers, np.int64))
                at += len(sources)
                sources, numbers = array("q"), array("q")
            if over:
                break
        done, start = [d + t for d, t in zip(done, took)], start + at


class Phase:
    """Until a source runs out: first slot, blocks done before it, slots of blocks."""

    def __init__(self, pieces: list[Piece]):
        self.start, self.done = pieces[0].start, np.array(pieces[0].done, np.int64)
        self.sources = np.concatenate([p.source for p in pieces])

    def slot(self, source: int, block: np.ndarray) -> np.ndarray:
        """Slots, from the phase's start, of a source's blocks counted from the phase's start."""
        return np.flatnonzero(self.sources == source)[block]


def phases(weights: list[int], blocks: list[int]) -> list[Phase]:
    """The phases that place ``blocks[s]`` blocks of every source s."""
    return [Phase(list(pieces)) for _, pieces in groupby(_pieces(weights, blocks), lambda p: p.start)]


def _scheduled(spark: SparkSession, weights: list[int], blocks: list[int]) -> DataFrame:
    """(__pf_source, mix_block, mix_slot, mix_release, mix_deadline) of all blocks; the driver holds
    fewer than two parts of PART_ROWS rows, however long the schedule."""
    names = ["__pf_source", "mix_block", "mix_slot", "mix_release", "mix_deadline"]
    path, held, rows = new_path(spark, "mix-schedule"), [np.zeros((5, 0), np.int64)], 0

    def write() -> None:
        part = pa.table([pa.array(c) for c in np.concatenate(held, axis=1)], names=names)
        spark.createDataFrame(part).write.mode("append").parquet(path)

    for piece in _pieces(weights, blocks):
        held.append(piece.table())
        rows += len(piece.source)
        if rows >= PART_ROWS:
            write()
            held, rows = held[:1], 0
    if rows or len(held) == 1:
        write()
    return spark.read.schema(", ".join(f"{n} long" for n in names)).parquet(path)


def _before(sizes: DataFrame) -> DataFrame:
    """(__pf_source, __pf_bucket, __pf_salt, __pf_first): the rows of a source in the buckets before a
    bucket, summed in two steps, so that no task holds all buckets of a source."""
    sizes = sizes.withColumn("__pf_part", F.floor(F.col("__pf_bucket") / SUM_BUCKETS))

    def running(by: list[str], *order: str) -> Column:
        window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(window), F.lit(0))

    parts = sizes.groupBy("__pf_source", "__pf_part").agg(F.sum("n").alias("n"))
    parts = parts.select("__pf_source", "__pf_part", running(["__pf_source"], "__pf_part").alias("__pf_past"))
    inside = sizes.withColumn("__pf_near", running(["__pf_source", "__pf_part"], "__pf_bucket", "__pf_salt"))
    found = inside.join(parts, ["__pf_source", "__pf_part"])
    return found.select(*BUCKET, (F.col("__pf_past") + F.col("__pf_near")).alias("__pf_first"))


def _spread(keyed: DataFrame, bucket_rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows with __pf_salt, sizes of buckets). A bucket that repeated rows have filled far beyond
    ``bucket_rows`` is split: its rows are written once with a salt of their own, as they cannot be
    told apart otherwise, and all stay."""
    plain = keyed.groupBy("__pf_source", "__pf_bucket").agg(F.count(F.lit(1)).alias("n"))
    sizes = materialize(plain.withColumn("__pf_salt", F.lit(0).cast("long")), "mix-sizes")
    keyed = keyed.withColumn("__pf_salt", F.lit(0).cast("long"))
    hot = sizes.where(F.col("n") > HOT_BUCKET * bucket_rows)
    if not hot.limit(1).count():
        return keyed, sizes
    key = ["__pf_source", "__pf_bucket"]
    parts = sized(materialize(hot.select(*key, F.ceil(F.col("n") / bucket_rows).alias("__pf_parts")), "mix-hot"))
    salted = keyed.join(parts, key).withColumn("__pf_salt", F.pmod(F.monotonically_increasing_id(), F.col("__pf_parts")))
    salted = materialize(salted.select(*keyed.columns), "mix-salted")
    rest = sizes.join(parts.select(*key), key, "left_anti").select(*BUCKET, "n")
    counted = salted.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("n"))
    return keyed.join(parts.select(*key), key, "left_anti").select(*keyed.columns).unionByName(salted), materialize(rest.unionByName(counted), "mix-sizes")


def _numbered(docs: DataFrame, sources: DataFrame, source_col: str, bucket_rows: int) -> DataFrame:
    """docs with __pf_source and __pf_rank, a row number within the source in hash order.

    Rows are numbered within buckets of about ``bucket_rows``; a bucket's first number is the count
    of the buckets before it, so that no source meets in one task."""
    keyed = docs.withColumn("__pf_h", row_hash(docs))
    keyed = keyed.join(F.broadcast(sources), keyed[f"`{source_col}`"].eqNullSafe(sources["__pf_name"])).drop("__pf_name")
    keyed, sizes = _spread(keyed.withColumn("__pf_bucket", F.pmod("__pf_h", F.col("__pf_buckets"))), bucket_rows)
    firsts = materialize(_before(sizes), "mix-firsts")
    inside = Window.partitionBy(*BUCKET).orderBy("__pf_h")
    ranked = keyed.withColumn("__pf_in", F.row_number().over(inside) - 1)
    ranked = ranked.join(sized(firsts), BUCKET)
    return ranked.withColumn("__pf_rank", F.col("__pf_first") + F.col("__pf_in")).drop("__pf_h", "__pf_buckets", *BUCKET[1:], "__pf_in", "__pf_first")


def mix(docs: DataFrame, source_col: str = "source", targets: dict[str | None, float] | None = None, block_docs: int = BLOCK_DOCS, resolution: int = RESOLUTION, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs with mix_block, mix_release, mix_deadline, mix_slot and mix_position (OUTPUTS).

    Reading by mix_position gives the mix; positions of a source's last, partial block are left
    out of the sequence, so positions ascend but need not be dense."""
    spark = docs.sparkSession
    docs = docs.drop(*OUTPUTS)
    counts = docs.groupBy(F.col(f"`{source_col}`").alias("s")).count().collect()
    counts = sorted(((r["s"], r["count"]) for r in counts), key=lambda r: (r[0] is not None, r[0] or ""))
    raw = [n**FLATTEN if targets is None else float(targets.get(s, 0)) for s, n in counts]
    blocks = [-(-n // block_docs) for _, n in counts]
    weights = whole_weights(raw, SCALE // (sum(blocks) + 1), resolution)
    rows = [(s, i, max(1, -(-n // bucket_rows))) for i, (s, n) in enumerate(counts)]
    sources = spark.createDataFrame(rows, "__pf_name string, __pf_source long, __pf_buckets long")
    ranked = _numbered(docs, sources, source_col, bucket_rows).withColumn("mix_block", F.floor(F.col("__pf_rank") / block_docs).cast("long"))
    placed = ranked.join(sized(_scheduled(spark, weights, blocks)), ["__pf_source", "mix_block"])
    position = F.col("mix_slot") * block_docs + F.col("__pf_rank") % block_docs
    return placed.select(*[f"`{c}`" for c in docs.columns], *OUTPUTS[:4], position.alias(OUTPUTS[4]))
