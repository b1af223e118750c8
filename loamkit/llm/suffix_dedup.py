"""Substring dedup by blockwise suffix sorting with a difference cover.

Removes every byte covered by a DEPTH-byte string that also starts anywhere else in the corpus.
Only suffixes that share a bucket can share their first DEPTH bytes. A suffix's bucket is the hash
of its anchor: of the K-byte strings among its first DEPTH bytes, the leftmost of least hash. The
anchor depends on these bytes alone, so equal strings meet in one bucket, and neighbouring suffixes
mostly share an anchor, so that a run of suffixes travels as one row (its bucket and a hash of the
bytes that the run spans), about 1.5 rows per 100 bytes of text:

1. Buckets with one row hold nothing repeated. Most text ends here.
2. Rows of a bucket whose spans are equal are repeated as a whole.
3. What is left, distinct spans in shared buckets (around the ends of repeated passages), is sorted
   suffix by suffix, one block of buckets at a time: spans are laid out so that anchors fall on
   multiples of V; suffixes are sorted by their bytes up to the next position of a difference
   cover modulo V, and ties by that position's rank among all cover positions of the block, ranked
   beforehand by doubling in steps of V. Neighbours in that order are then compared byte by byte.
4. A bucket with over BUCKET_SPANS distinct spans (a passage that very many documents share ends in
   one) is first split by further bytes, as a radix sort does: its spans are cut by distance from
   the anchor into pieces of up to WIDTHS[0] suffixes, the bytes that all suffixes of a piece share
   join the bucket's key, equal pieces are again repeated as a whole, and the rest is sorted as in
   3. A bucket that is too large even so is split down to single suffixes, where the key holds all
   DEPTH bytes and nothing is left to sort.

Memory is bounded by a block (about BLOCK_SPANS, and BUCKET_SPANS for its last bucket) and by a
segment of text (SEGMENT). Buckets, spans and pieces are compared by 64-bit hashes within their
group. Texts meet their ranges by broadcast only where these measure at most ``small`` bytes.

Defined cases: null text is empty and has the hash of no bytes; texts under DEPTH bytes lose
nothing; very long texts are cut into overlapping segments and lose no suffix; rows that repeat an
id and a text count as two occurrences and come out twice; extra columns are ignored, whatever
their names; an empty table gives an empty result."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamkit.llm._shared import BROADCAST_BYTES, materialize, sized, small_batches

DEPTH = 200
K = 64
#: A perfect difference set: every residue modulo V is a difference of two of these.
V, COVER = 31, (0, 1, 3, 8, 12, 18)
SEGMENT = 1 << 20
BLOCK_SPANS = 4_000
#: Distinct spans above which a bucket is split, and the suffixes of a piece in the first and the
#: second split.
BUCKET_SPANS = 2_000
WIDTHS = (16, 1)
#: Distances from the anchor whose suffixes are sorted at a time.
SLAB = 16
_ODD = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 24) - 1)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, SEGMENT + 4 * DEPTH)
        with np.errstate(over="ignore"):
            for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
                _powers[name] = np.cumprod(np.append(np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)))
    return _powers["up"], _powers["down"]


class Runs:
    """Runs of suffixes of a segment with a common anchor: document, first and last suffix,
    anchor (all from the document's start), bucket and span hash."""

    def __init__(self, texts: list[np.ndarray], depth: int = DEPTH, k: int = K):
        starts = np.cumsum([0] + [len(t) for t in texts])
        b = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
        n = len(b)
        up, down = _power(n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTES[b] * up[:n], out=sums[1:])
            grams = _mix((sums[k:] - sums[:-k]) * down[: n - k + 1])
            least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
            wide, reach = 1, depth - k + 1
            while 2 * wide <= reach:
                least = np.minimum(least[:-wide], least[wide:])
                wide *= 2
            if reach > wide:
                least = np.minimum(least[: len(least) - (reach - wide)], least[reach - wide :])
            anchor = (least & _LOW).astype(np.int64)
            inside = np.ones(len(anchor), bool)
            for s in starts[1:-1]:
                inside[max(0, s - depth + 1) : s] = False
            at = np.flatnonzero(inside)
            a = anchor[at]
            new = np.ones(len(at), bool)
            new[1:] = (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)
            first = np.flatnonzero(new)
            lo, hi, a = at[first], at[np.append(first[1:], len(at)) - 1] if len(first) else at[first], a[first]
            self.bucket = grams[a].view(np.int64)
            span = (sums[hi + depth] - sums[lo]) * down[lo]
            shape = ((a - lo) * 65_536 + (hi - lo)).astype(np.uint64)
            self.span = _mix(span ^ _mix(shape + np.uint64(_ODD))).view(np.int64)
        self.doc = np.searchsorted(starts, lo, side="right") - 1
        self.lo, self.hi, self.anchor = lo - starts[self.doc], hi - starts[self.doc], a - starts[self.doc]


def _segments(texts: pa.Array, depth: int) -> Iterator[tuple[list[int], list[int], list[np.ndarray]]]:
    """(rows, offsets in the row's text, bytes) of about SEGMENT bytes; long texts are cut with an
    overlap that keeps every suffix of ``depth`` bytes whole in one segment."""
    rows: list[int] = []
    offsets: list[int] = []
    parts: list[np.ndarray] = []
    size = 0
    for i, text in enumerate(texts):
        raw = np.frombuffer(text.as_buffer() or b"", np.uint8) if text.is_valid else np.zeros(0, np.uint8)
        for s in range(0, len(raw) - depth + 1, SEGMENT):
            part = raw[s : s + SEGMENT + depth - 1]
            if size and size + len(part) > SEGMENT:
                yield rows, offsets, parts
                rows, offsets, parts, size = [], [], [], 0
            rows.append(i)
            offsets.append(s)
            parts.append(part)
            size += len(part)
    if parts:
        yield rows, offsets, parts


def _runs(batches: Iterator[pa.RecordBatch], places: bool, depth: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, offsets, parts in _segments(batch.column(1).cast(pa.binary()), depth):
            runs = Runs(parts, depth, k)
            if not places:
                yield pa.RecordBatch.from_arrays([pa.array(runs.bucket), pa.array(runs.span)], names=["bucket", "span"])
                continue
            off = np.array(offsets)[runs.doc]
            uid = batch.column(0).take(pa.array(np.array(rows)[runs.doc]))
            yield pa.RecordBatch.from_arrays([uid, *(pa.array(x + off) for x in (runs.lo, runs.hi, runs.anchor)), pa.array(runs.bucket), pa.array(runs.span)], names=["uid", "lo", "hi", "anchor", "bucket", "span"])


def repeated_suffixes(spans: list[bytes], leads: np.ndarray, buckets: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(span index, suffix offset) of the suffixes whose first ``depth`` bytes another suffix of
    the block shares; a suffix of a span starts at 0 to len - depth, the anchor at ``leads``."""
    sizes = np.array([len(s) for s in spans])
    base, at = np.zeros(len(spans), np.int64), 0
    for i, (size, lead) in enumerate(zip(sizes.tolist(), leads.tolist())):
        at += -(at + lead) % V
        base[i] = at
        at += size
    tail = 320
    text = np.zeros(at + tail, np.uint8)
    for i, s in enumerate(spans):
        text[base[i] : base[i] + sizes[i]] = np.frombuffer(s, np.uint8)
    n = at + tail - 8
    words = np.zeros(n, np.uint64)
    for j in range(8):
        words = (words << np.uint64(8)) | text[j : j + n]

    # ranks of the cover's positions: by their first 32 bytes, then doubling in steps of V
    on = np.zeros(V, bool)
    on[list(COVER)] = True
    cover = np.flatnonzero(on[np.arange(at + 32) % V])
    place = np.full(at + tail, -1, np.int64)
    place[cover] = np.arange(len(cover))
    keys = [words[cover + 8 * j] for j in range(4)]
    order = np.lexsort(keys[::-1])
    differs = np.zeros(len(order), bool)
    for key in keys:
        differs[1:] |= key[order][1:] != key[order][:-1]
    rank = np.empty(len(cover), np.int64)
    rank[order] = np.cumsum(differs)
    known, step = 32, V
    while known < depth:
        later = np.minimum(cover + step, at + tail - 1)
        after = np.where(place[later] >= 0, rank[place[later]], -1) + 1
        rank = np.unique(rank * (len(cover) + 2) + after, return_inverse=True)[1]
        known, step = step + known, 2 * step

    # the suffixes, by bucket and distance from the anchor, then bytes up to the cover, then rank;
    # only those of one distance can be equal, so a few distances at a time will do
    count = sizes - depth + 1
    bucket = np.unique(buckets, return_inverse=True)[1]
    shifts = np.array([next(x for x in range(V) if on[(r + x) % V]) for r in range(V)])
    owners, offsets = [], []
    for near in range(int((leads - count).min()) + 1, int(leads.max()) + 1, SLAB):
        low, high = np.clip(leads - near - SLAB + 1, 0, count), np.clip(leads - near + 1, 0, count)
        owner = np.repeat(np.arange(len(spans)), high - low)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(high - low) - high, high - low)
        start, before = base[owner] + offset, leads[owner] - offset
        shift = shifts[start % V]
        group = bucket[owner] * 65_536 + before
        heads = []
        for j in range(4):
            keep = np.clip(shift - 8 * j, 0, 8).astype(np.uint64) * np.uint64(8)
            mask = np.where(keep == 64, ~np.uint64(0), ~(~np.uint64(0) >> np.minimum(keep, np.uint64(63))))
            heads.append(words[start + 8 * j] & mask)
        order = np.lexsort([rank[place[start + shift]], *heads[::-1], group])
        one, two = start[order[:-1]], start[order[1:]]
        alive = np.flatnonzero(group[order[:-1]] == group[order[1:]])
        for j in [*range(0, depth - 7, 8), depth - 8]:
            alive = alive[words[one[alive] + j] == words[two[alive] + j]]
        hit = np.zeros(len(owner), bool)
        hit[order[alive]] = hit[order[alive + 1]] = True
        owners.append(owner[hit])
        offsets.append(offset[hit])
    owner, offset = np.concatenate(owners), np.concatenate(offsets)
    order = np.lexsort([offset, owner])
    return owner[order], offset[order]


def _ranges(owner: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first, last) of maximal runs of consecutive offsets."""
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner))[: len(first)] - 1
    return owner[first], offset[first], offset[last]


def _sort_block(depth: int):  # noqa: ANN202
    def run(block: pd.DataFrame) -> pd.DataFrame:
        owner, first, last = _ranges(*repeated_suffixes(block["bytes"].tolist(), block["lead"].to_numpy(np.int64), block["bucket"].to_numpy(np.int64), depth))
        lo = block["lo"].to_numpy(np.int64)[owner]
        return pd.DataFrame({"uid": block["uid"].to_numpy(np.int64)[owner], "lo": lo + first, "hi": lo + last})

    return run


def _cut(depth: int):  # noqa: ANN202
    """Spans' bytes from (text, list of runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, texts, lists = batch.column(0), batch.column(1).cast(pa.binary()), batch.column(2)
            out: list[tuple] = []
            for i in range(len(uid)):
                raw, u = texts[i].as_py(), uid[i].as_py()
                for x in lists[i].as_py():
                    out.append((x["bucket"], x["anchor"] - x["lo"], raw[x["lo"] : x["hi"] + depth], u, x["lo"]))
            columns = list(zip(*out)) if out else [[]] * 5
            types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["bucket", "lead", "bytes", "uid", "lo"])

    return run


def _pieces(spans: DataFrame, depth: int, width: int) -> DataFrame:
    """Spans cut into pieces of up to ``width`` suffixes by distance from the anchor; a piece's
    bucket is that of its span with the bytes that all suffixes of such a piece share."""
    near, far = F.col("lead") - (F.octet_length("bytes") - depth), F.col("lead")
    cut = spans.withColumn("slab", F.explode(F.sequence(F.floor(near / width), F.floor(far / width))))
    first = F.col("lead") - F.least(far, F.col("slab") * width + (width - 1))  # the piece's first suffix
    last = F.col("lead") - F.greatest(near, F.col("slab") * width)
    shared = F.substring(F.col("bytes"), (F.col("lead") - F.col("slab") * width + 1).cast("int"), F.lit(depth - width + 1))
    return cut.select(
        F.xxhash64("bucket", "slab", shared).alias("bucket"),
        (F.col("lead") - first).alias("lead"),
        F.substring(F.col("bytes"), (first + 1).cast("int"), (last - first + depth).cast("int")).alias("bytes"),
        "uid",
        (F.col("lo") + first).alias("lo"),
    )


def _sorted_spans(spans: DataFrame, depth: int, block_spans: int) -> DataFrame:
    """(uid, lo, hi) of the suffixes of spans (bucket, lead, bytes, uid, lo) that repeat, found by
    sorting one block of whole buckets at a time."""
    blocks = max(1, -(-spans.count() // block_spans))
    return spans.withColumn("block", F.pmod(F.xxhash64("bucket"), F.lit(blocks))).groupBy("block").applyInPandas(_sort_block(depth), "uid long, lo long, hi long")


def _resolved(spans: DataFrame, depth: int, bucket_spans: int, block_spans: int, small: int) -> DataFrame:
    """(uid, lo, hi) of all suffixes of distinct spans that repeat; large buckets are split first."""
    out = []
    for width in WIDTHS:
        large = materialize(spans.groupBy("bucket").count().where(F.col("count") > bucket_spans).select("bucket"), "sfx-large")
        if not large.limit(1).count():
            break
        large = sized(large, small)
        out.append(_sorted_spans(materialize(spans.join(large, "bucket", "left_anti"), "sfx-fitting"), depth, block_spans))
        pieces = materialize(_pieces(spans.join(large, "bucket", "left_semi"), depth, width).withColumn("x", F.xxhash64("lead", "bytes")), "sfx-pieces")
        kinds = materialize(pieces.groupBy("bucket", "x").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("u"), F.min_by("lo", "uid").alias("l")), "sfx-piece-kinds")
        copies = sized(materialize(kinds.where("n > 1").select("bucket", "x"), "sfx-piece-copies"), small)
        out.append(materialize(pieces.join(copies, ["bucket", "x"], "left_semi").select("uid", "lo", (F.col("lo") + F.octet_length("bytes") - depth).alias("hi")), "sfx-piece-whole"))
        several = kinds.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket")
        ones = kinds.join(several, "bucket", "left_semi").select("bucket", "x", F.col("u").alias("uid"), F.col("l").alias("lo"))
        ones = sized(materialize(ones, "sfx-piece-ones"), small)
        spans = materialize(pieces.join(ones, ["bucket", "x", "uid", "lo"], "left_semi").drop("x"), "sfx-split")
    out.append(_sorted_spans(spans, depth, block_spans))
    return reduce(DataFrame.unionByName, out)


def repeated_ranges(docs: DataFrame, depth: int = DEPTH, k: int = K, bucket_spans: int = BUCKET_SPANS, block_spans: int = BLOCK_SPANS, small: int = BROADCAST_BYTES) -> DataFrame:
    """(uid, lo, hi): ranges of suffix starts in docs (uid, text) whose first ``depth`` bytes start
    elsewhere too; ranges may touch or overlap."""
    seen = docs.mapInArrow(lambda b: _runs(b, False, depth, k), "bucket long, span long")
    shared = seen.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), (F.min("span") != F.max("span")).alias("mixed")).where("n > 1").select("bucket", "mixed")
    shared = materialize(shared, "sfx-shared")
    runs = docs.mapInArrow(lambda b: _runs(b, True, depth, k), "uid long, lo long, hi long, anchor long, bucket long, span long")
    runs = materialize(runs.join(shared, "bucket"), "sfx-runs")
    whole = runs.where("NOT mixed").select("uid", "lo", "hi")

    # of equal spans, all of which are repeated, one is sorted among the others of its bucket
    mixed = runs.where("mixed")
    kinds = materialize(mixed.groupBy("bucket", "span").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("uid", "lo", "hi", "anchor")).alias("r")), "sfx-kinds")
    again = sized(materialize(kinds.where("n > 1").select("bucket", "span"), "sfx-again"), small)
    copies = materialize(mixed.join(again, ["bucket", "span"], "left_semi").select("uid", "lo", "hi"), "sfx-copies")

    lists = kinds.groupBy("r.uid").agg(F.collect_list(F.struct("r.lo", "r.hi", "r.anchor", "bucket")).alias("runs"))
    lists = materialize(lists, "sfx-lists")  # grows with the texts, which are dealt out at any size
    spans = docs.join(lists, "uid").select("uid", "text", "runs").mapInArrow(_cut(depth), "bucket long, lead long, bytes binary, uid long, lo long")
    # a row that is there twice comes out twice here, and all of it is in ``copies`` already
    spans = materialize(spans, "sfx-spans")
    return whole.unionByName(copies).unionByName(_resolved(spans, depth, bucket_spans, block_spans, small))


def _merged(ranges: DataFrame, depth: int) -> DataFrame:
    """(uid, cuts): disjoint byte ranges to remove, as an array of (lo, hi), hi exclusive."""
    by_doc = Window.partitionBy("uid").orderBy("lo", "hi")
    before = by_doc.rowsBetween(Window.unboundedPreceding, -1)
    marked = ranges.select("uid", "lo", (F.col("hi") + depth).alias("hi")).distinct()
    marked = marked.withColumn("new", (F.coalesce(F.max("hi").over(before), F.lit(-1)) < F.col("lo")).cast("int"))
    marked = marked.withColumn("island", F.sum("new").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    islands = marked.groupBy("uid", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return islands.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("cuts"))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, lists = pc.fill_null(batch.column(1), "").cast(pa.binary()), batch.column(2)
        out: list[tuple[int, int, int, str, list[dict]]] = []
        for i in range(len(texts)):
            raw, cuts = texts[i].as_py(), lists[i].as_py() or []
            digest, at, gone = hashlib.sha256(), 0, 0
            for cut in cuts:
                digest.update(raw[at : cut["lo"]])
                at, gone = cut["hi"], gone + cut["hi"] - cut["lo"]
            digest.update(raw[at:])
            out.append((len(raw), gone, len(cuts), digest.hexdigest(), cuts))
        columns = list(zip(*out)) if out else [[]] * 5
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), kind]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "cuts"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, small: int = BROADCAST_BYTES, **settings: int) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and ``cuts``, the
    removed byte ranges."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.withColumn("uid", F.xxhash64("doc_id", "text"))
    ranges = materialize(repeated_ranges(rows.select("uid", "text"), depth, small=small, **settings), "sfx-ranges")
    cuts = sized(materialize(_merged(ranges, depth), "sfx-cuts"), small)
    return rows.join(cuts, "uid", "left").select("doc_id", "text", "cuts").mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, cuts array<struct<lo:long,hi:long>>")
