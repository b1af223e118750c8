"""Jaccard join of word shingles by universe partitions and the pigeonhole principle.

A text's set holds the hashes of its distinct five-word shingles. Sizes are cut into bands whose
ends stand in the ratio of the threshold, so that similar sets are of one band or of neighbours;
a pair is sought in the band of its larger set. In a band the universe of shingles is cut by hash
into as many segments as sets of that size may differ in, and some more. Two sets a and b with
a <= b that are similar differ in at most H(a, b) shingles; if a grants segment i the allowance
v(i) of -1 (not looked at), 0 (equal) or 1 (one shingle more or less), and the sum of v(i) + 1
exceeds H, then b stays within some segment's allowance. Equal segments meet by a hash of the
subset; one-deletion neighbours by hashes of the subset less one shingle.

The allowances go where they cost least. Subsets that no other set has are free. A set with more
than H free ones has no candidate at all; others add their cheapest shared subsets. Costs are counts
over all sets. Subsets that the same sets have are one group, looked up once. Where a set would be compared
with over BUDGET sets a shingle of its own, which costs more than its neighbourhoods, the subsets it chose
that over BUDGET others have are given up: it and all sets that have them are laid out again with their
one-deletion neighbourhoods, and allowances of 1 on cheap segments take the place of dear ones; its other
subsets are looked up as they are. Candidates are verified on the whole sets.

A crowd of near copies is first drawn together by few links: by the FEW subsets of least hash that
a set has, it is compared with the set that shares most with all others, twice. Subsets that only one
crowd has are then of no further use, and candidates are sought between different crowds only; of two
crowds one pair is compared before the others. A pair is a candidate only if the parities of its sets'
shingles over 64 PARITIES places differ in no more places than the sets may in shingles. Links within a crowd do not change components, so none
that counts is lost.

Equal sets are one node. A shingle is held by 64 bits and a set by 128: different ones that agree
would count as equal, at a chance of about 2^-64 for a pair of shingles.

Defined cases: null and empty texts and those of white space have an empty set, link with nothing and
are their own component; texts of fewer words than a shingle have one, the whole; very long texts are
read whole, their rows grow with their shingles; repeated rows share their component; a null id is
never the least of a component unless all are null; extra columns are ignored; an empty table gives
an empty result."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamkit.llm._shared import components, least_of_groups, materialize, sized, small_batches
from loamkit.llm.square_catchers import _joined, _words

WORDS, PERCENT = 5, 80
#: Segments beyond those that similar sets may differ in, as a part of them; for the sets of a
#: smaller band, which look into this one, subsets laid out beyond those they need.
SLACK, VISITOR_SLACK = 0.2, 0.1
#: Sets of other crowds that a set may be compared with, for each of its shingles, before its allowances
#: are chosen anew; and those that may have a subset of such a set which is looked up as it is.
BUDGET = 128
#: Subsets of a band by which crowds are drawn together, and rounds of that.
FEW, ROUNDS = 4, 3
#: Groups, the cheapest of a set, that are looked up before the others, as sets that they join into one
#: crowd do not meet again at each of those.
FIRST = 8
#: 64-bit words of the parities of a set's shingles by places: sets differ in at least as many shingles
#: as their parities do in places.
PARITIES = 16
#: Subsets that are looked at together when those that several crowds have are sought, and those that a
#: task lays out before it sends them off, a row for each such bucket.
BUCKET_KEYS, FLUSH_KEYS = 1 << 19, 1 << 19
#: Bytes of texts in a batch, as a batch gives several times its bytes.
SMALL_BATCH = 2 << 20


def differing(total: int, percent: int = PERCENT) -> int:
    """Shingles in which two similar sets of ``total`` together can differ."""
    return total + 2 * (-percent * total // (100 + percent))


@lru_cache(maxsize=1 << 16)
def layout(n: int, percent: int = PERCENT) -> tuple[int, int, int, int, int]:
    """For a set of ``n``: its band's first size, segments of that band and of the next one, and in
    how many shingles a similar set that is as large or larger can differ, in either."""
    low = 1
    while 100 * low // percent < n:
        low = 100 * low // percent + 1
    high = 100 * low // percent
    following = 100 * (high + 1) // percent
    most = lambda sizes: max((differing(n + b, percent) for b in sizes), default=0)
    partner = 100 * n // percent
    own, other = range(max(n, min(partner, high) - 9), min(partner, high) + 1), range(max(high + 1, partner - 9), partner + 1)
    segments = lambda top: -(-(1 + max(differing(2 * top - d, percent) for d in range(min(9, top)))) * (100 + int(100 * SLACK)) // 100)
    return low, segments(high), segments(following), most(own), most(other)


def shingles(texts: pa.Array, k: int = WORDS) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct shingles."""
    flat, begin = _words(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = flat.dictionary_encode()
    names = np.array([xxhash.xxh64_intdigest(w.as_buffer(), 42) for w in coded.dictionary], np.uint64)
    words, size = names[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64), np.diff(begin)
    grams = np.full(max(0, len(words) - k + 1), k, np.uint64)
    for j in range(k):
        grams = _joined(grams, words[j : j + len(grams)])
    out = []
    for at, n in zip(begin.tolist(), size.tolist()):
        if n >= k:
            out.append(np.unique(grams[at : at + n - k + 1]))
        else:
            whole = np.full(min(n, 1), n, np.uint64)
            for j in range(n):
                whole = _joined(whole, words[at + j : at + j + 1])
            out.append(whole)
    return out


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    return _joined(x, np.full(1, salt, np.uint64))


def _laid(tokens: np.ndarray, value: np.ndarray, band: int, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per segment the number and the summed hash of its shingles, of given values; per shingle its
    segment."""
    place = (_mixed(tokens, band) % np.uint64(segments)).astype(np.int64)
    content = np.zeros(segments, np.uint64)
    np.add.at(content, place, value)
    return np.bincount(place, minlength=segments), content, place


def _values(tokens: np.ndarray) -> np.ndarray:
    return _mixed(tokens, 1 << 40)


def _key(band: int, segment: np.ndarray, content: np.ndarray) -> np.ndarray:
    return _joined(_mixed(segment.astype(np.uint64), band), content).view(np.int64)


def _next_band(low: int, percent: int) -> int:
    return 100 * low // percent + 1


def _placed(tokens: np.ndarray, percent: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(side, spare, keys): the subsets of all segments of a set's own band, and of the next band as
    many of the fullest as it may need; spare are those beyond its need."""
    n, value = len(tokens), _values(tokens)
    low, own, following, h_own, h_next = layout(n, percent)
    for side, band, segments, h in ((0, low, own, h_own), (1, _next_band(low, percent), following, h_next)):
        if h or not side and band < _next_band(low, percent) - 1:  # a band of one size has no links of its own
            number, content, _ = _laid(tokens, value, band, segments)
            chosen = np.arange(segments)
            if side:
                wanted = min(segments, h + 3 + int(h * VISITOR_SLACK))
                chosen = np.sort(np.argpartition(-number, wanted - 1)[:wanted])
            yield side, len(chosen) - (h + 1) if h else len(chosen), _key(band, chosen, content[chosen])


def _parities(sets: list[np.ndarray]) -> list[pa.Array]:
    """For each set the parity of its shingles over 64 PARITIES places, as columns of 64 bits."""
    odd = np.zeros((len(sets), 64 * PARITIES), np.uint8)
    for i, tokens in enumerate(sets):
        odd[i] = np.bincount((_mixed(tokens, 3) % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1
    words = np.packbits(odd, axis=1, bitorder="little").view(np.int64)
    return [pa.array(words[:, j].copy()) for j in range(PARITIES)]


def _names(prefix: str = "p") -> list[str]:
    return [f"{prefix}{j}" for j in range(PARITIES)]


def _sets(docs: DataFrame, id_col: str, text_col: str, percent: int, uid_col: str | None = None) -> DataFrame:
    """(uid, doc_id, n, g1, g2, laid, spare0, spare1, own, next, p0 and so on, text): every row with the size
    and a hash of its set, the number of its subsets and of those to spare on either side, its subsets of
    least hash and its parities."""
    lists = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingles(batch.column(2))
            few: tuple[list[list[int]], list[list[int]]] = ([], [])
            counts = np.zeros((3, len(sets)), np.int64)
            for i, tokens in enumerate(sets):
                least = {}
                for side, spare, keys in _placed(tokens, percent) if len(tokens) else ():
                    least[side] = np.sort(keys)[:FEW].tolist()
                    counts[0, i] += len(keys)
                    counts[1 + side, i] = spare
                for side in (0, 1):
                    few[side].append(least.get(side, []))
            with np.errstate(over="ignore"):
                sums = [pa.array(np.array([_mixed(s, salt).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)) for salt in (1, 2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([len(s) for s in sets], pa.int64()), *sums, *map(pa.array, counts), *(pa.array(x, lists) for x in few), *_parities(sets), batch.column(2)], names=["uid", "doc_id", "n", "g1", "g2", "laid", "spare0", "spare1", "own", "next", *_names(), "text"])

    small_batches(docs.sparkSession, size=SMALL_BATCH)
    uid = F.col(f"`{uid_col}`").cast("long") if uid_col else F.monotonically_increasing_id()
    rows = docs.select(uid.alias("uid"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "uid long, doc_id long, n long, g1 long, g2 long, laid long, spare0 long, spare1 long, own array<long>, next array<long>, " + ", ".join(f"{p} long" for p in _names()) + ", text string")


def _subsets(texts: DataFrame, percent: int, buckets: int) -> DataFrame:
    """(bucket, side, keys, nodes, crowds): the subsets of each of (node, crowd, text), as arrays of 64-bit
    integers, those of a bucket and side in one row for many texts. Crowds are told by the bits in which they
    differ from the nodes: most are of one node, and zeros take no room when they are compressed."""

    def dealt(keys: list[np.ndarray], owners: list[tuple[int, int]], sides: list[int]) -> pa.RecordBatch:
        key, many = np.concatenate(keys), [len(k) for k in keys]
        place = (key.view(np.uint64) >> np.uint64(20)) % np.uint64(buckets) * np.uint64(2) + np.repeat(np.array(sides, np.uint64), many)
        order = np.argsort(place, kind="stable")
        rows, ends = np.unique(place[order], return_index=True)
        offsets = pa.py_buffer((np.append(ends, len(key)) * 8).astype(np.int32))
        node, crowd = np.array(owners, np.int64).T
        columns = [key, np.repeat(node, many), np.repeat(node ^ crowd, many)]
        lists = [pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(np.ascontiguousarray(x[order]))]) for x in columns]
        where = rows.astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(where >> 1), pa.array(where & 1), *lists], names=["bucket", "side", "keys", "nodes", "crowds"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, sides, held = [], [], [], 0
        for batch in batches:
            for owner, tokens in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), shingles(batch.column(2))):
                for side, _, found in _placed(tokens, percent):
                    keys.append(found)
                    owners.append(owner)
                    sides.append(side)
                    held += len(found)
                if held >= FLUSH_KEYS:
                    yield dealt(keys, owners, sides)
                    keys, owners, sides, held = [], [], [], 0
        if held:
            yield dealt(keys, owners, sides)

    return texts.select("node", "crowd", "text").mapInArrow(run, "bucket long, side long, keys binary, nodes binary, crowds binary")


def _several(bucket: pa.Table) -> pa.Table:
    """(group, node, crowd, side, others) of the subsets of a bucket that several crowds have: a hash of the
    sets that have it in their own band, and how many of those are of other crowds."""
    whole = lambda name: np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in bucket[name]])
    key, node = whole("keys"), whole("nodes")
    crowd = node ^ whole("crowds")
    own = 1 - np.repeat(bucket["side"].to_numpy(), [len(x.as_buffer()) // 8 for x in bucket["keys"]])
    order = np.lexsort((crowd, key))
    key, node, crowd, own = key[order], node[order], crowd[order], own[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    many = np.diff(np.append(first, len(key)))
    wanted = (np.add.reduceat(own, first) > 0) & (crowd[first] != crowd[first + many - 1])
    at = np.flatnonzero(np.repeat(wanted, many))
    key, node, crowd, own, many = key[at], node[at], crowd[at], own[at], many[wanted]
    first = np.cumsum(many) - many
    if not len(key):
        return pa.table({c: pa.array([], pa.int64()) for c in ("group", "node", "crowd", "side", "others")})
    group = np.add.reduceat(np.where(own > 0, _mixed(node.view(np.uint64), 4), np.uint64(0)), first)
    mine = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (crowd[1:] != crowd[:-1])))
    of_crowd = np.repeat(np.add.reduceat(own, mine), np.diff(np.append(mine, len(key))))
    others = np.repeat(np.add.reduceat(own, first), many) - of_crowd
    return pa.table({"group": np.repeat(group.view(np.int64), many), "node": node, "crowd": crowd, "side": 1 - own, "others": others})


def _neighbourhoods(texts: DataFrame, percent: int) -> DataFrame:
    """(key, node, crowd, n, side, segment, less, need, segments) of each of (node, crowd, hard, text): all
    subsets of its band, and with ``less`` those with one shingle less; for hard ones of the next
    band too. ``need`` is the allowance that is to be given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "node", "crowd", "n", "side", "segment", "less", "need", "segments"]
        for batch in batches:
            hard = batch.column(2).to_pylist()
            for i, tokens in enumerate(shingles(batch.column(3))):
                n, value, parts = len(tokens), _values(tokens), []
                low, own, following, h_own, h_next = layout(n, percent)
                for side, band, segments, h in ((0, low, own, h_own), (1, _next_band(low, percent), following, h_next)):
                    if not side or (hard[i] and h):
                        _, content, place = _laid(tokens, value, band, segments)
                        where = np.concatenate([np.arange(segments), place])
                        what = np.concatenate([content, content[place] - value])
                        less = np.arange(len(where)) >= segments
                        parts.append((_key(band, where, what), where, less, np.full(len(where), side), np.full(len(where), h + 1 if h else 0), np.full(len(where), segments)))
                key, where, less, side, need, of = (np.concatenate(x) for x in zip(*parts))
                whole = [pa.array(np.full(len(key), x)) for x in (batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), n)]
                yield pa.RecordBatch.from_arrays([pa.array(key), *whole, pa.array(side), pa.array(where), pa.array(less), pa.array(need), pa.array(of)], names=names)

    return texts.select("node", "crowd", "hard", "text").mapInArrow(run, "key long, node long, crowd long, n long, side long, segment long, less boolean, need long, segments long")


def _linked(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, ca, cb) those whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for x, y in zip(shingles(batch.column(4)), shingles(batch.column(5))):
                common = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(100 * common >= percent * (len(x) + len(y) - common) and common > 0)
            yield batch.select([0, 1, 2, 3]).filter(pa.array(alike, pa.bool_()))

    named = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "pj-named")
    texts = texts.join(sized(named), "node", "left_semi")  # only these are dealt out
    a, b = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    found = pairs.select("a", "b", "ca", "cb").join(a, "a").join(b, "b").select("a", "b", "ca", "cb", "ta", "tb")
    return found.mapInArrow(run, "a long, b long, ca long, cb long")


def _may_link(percent: int) -> Column:
    """Whether sets of the sizes na and nb and the parities a0, b0 and so on may be similar."""
    n, m = F.col("na"), F.col("nb")
    differ = sum((F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in zip(_names("a"), _names("b"))), F.lit(0))
    most = n + m - 2 * F.floor((percent * (n + m) + 99 + percent) / (100 + percent))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (differ <= most)


def _cut(parities: DataFrame, nodes: DataFrame) -> DataFrame:
    """The parities of these nodes alone, so that few are dealt out."""
    named = sized(materialize(nodes.select("node").distinct(), "pj-asked"))
    return sized(materialize(parities.join(named, "node", "left_semi"), "pj-parities"))


def _as(df: DataFrame, side: str) -> DataFrame:
    """Columns node, crowd, n and the parities under their names for one side of a pair."""
    return df.withColumnsRenamed({"node": side, "crowd": "c" + side, "n": "n" + side, **dict(zip(_names(), _names(side)))})


def _moved(crowds: DataFrame, links: DataFrame) -> DataFrame:
    """crowds (node, crowd), renamed by the components of the links between crowds."""
    links = materialize(links, "pj-joined")
    if links.isEmpty():
        return crowds
    roots = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    moved = crowds.join(roots.withColumnRenamed("node", "crowd"), "crowd", "left")
    return materialize(moved.select("node", F.coalesce("root", "crowd").alias("crowd")), "pj-crowds")


def _tried(pairs: DataFrame, crowds: DataFrame, texts: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """crowds after one pair of each two has been compared, and of the pairs (a, b, ca, cb), a stored
    table, the others of those that it has not joined, with their crowds as they are now."""
    low, high = F.least("ca", "cb"), F.greatest("ca", "cb")
    tried = materialize(pairs.groupBy(low.alias("low"), high.alias("high")).agg(F.min(F.struct("a", "b", "ca", "cb")).alias("p"), F.count(F.lit(1)).alias("many")), "pj-tried")
    joined = _moved(crowds, _linked(tried.select("p.*"), texts, percent))
    of = joined.join(crowds.withColumnRenamed("crowd", "old"), "node").where("node = old").select("old", F.col("crowd").alias("new"))
    left = pairs.join(tried.where("many > 1").select("low", "high", F.col("p.a").alias("a1"), F.col("p.b").alias("b1")), (low == F.col("low")) & (high == F.col("high"))).where("a <> a1 OR b <> b1")
    left = left.join(of.select(F.col("old").alias("ca"), F.col("new").alias("na")), "ca").join(of.select(F.col("old").alias("cb"), F.col("new").alias("nb")), "cb").where("na <> nb")
    return joined, materialize(left.select("a", "b", F.col("na").alias("ca"), F.col("nb").alias("cb")), "pj-left")


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, budget: int = BUDGET, uid_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (least doc_id reachable over links).

    If ``uid_col`` names the key of each row of ``docs``, a stored table, the row's key comes along as
    ``uid`` and its component's as ``root``, which is one component's alone, also where ids repeat or are
    missing; texts are then read there and not stored again."""
    rows = _sets(docs, id_col, text_col, percent, uid_col)
    rows = materialize(rows.drop("text") if uid_col else rows, "pj-rows")
    keys = ["n", "g1", "g2"]
    nodes = rows.where("n > 0").groupBy(*keys).agg(F.min("uid").alias("node"), F.min("doc_id").alias("least"), *[F.first(p).alias(p) for p in ("laid", "spare0", "spare1", *_names())])
    nodes = materialize(nodes, "pj-nodes")
    parities = nodes.select("node", *_names())
    # the one text of every different set
    ours = rows.withColumnRenamed("uid", "node").join(sized(nodes.select("node")), "node", "left_semi")
    texts = docs.select(F.col(f"`{uid_col}`").cast("long").alias("node"), F.col(f"`{text_col}`").cast("string").alias("text")) if uid_col else rows.select(F.col("uid").alias("node"), "text")

    # crowds, by few subsets of each set
    entry = lambda name, side: F.transform(name, lambda k: F.struct(k.alias("key"), F.lit(side).alias("side")))
    few = materialize(ours.select("node", "n", F.explode(F.concat(entry("own", 0), entry("next", 1))).alias("f")).select("node", "n", "f.*"), "pj-few")
    few = few.join(few.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "key")
    few = few.withColumn("weight", F.sum("held").over(Window.partitionBy("node"))).drop("held")
    few = materialize(few, "pj-shared-few")
    few = materialize(few.join(_cut(parities, few), "node"), "pj-met")
    crowds = nodes.select("node", F.col("node").alias("crowd"))
    for _ in range(ROUNDS):
        placed = few.join(sized(crowds), "node")
        centre = placed.where("side = 0").groupBy("key").agg(F.max(F.struct("weight", "node", "crowd", "n", *_names())).alias("c")).select("key", "c.*")
        stars = _as(placed.drop("weight", "side"), "a").join(_as(centre, "b"), "key").where((F.col("ca") != F.col("cb")) & _may_link(percent))
        stars = stars.groupBy("a", "ca").agg(F.max(F.struct("weight", "b", "cb")).alias("s"))
        pairs = materialize(stars.select("a", "s.b", "ca", "s.cb"), "pj-stars")
        crowds = _moved(crowds, _linked(pairs, texts, percent))

    # all subsets; of use are those that several crowds have
    buckets = max(1, -(-(nodes.agg(F.sum("laid")).first()[0] or 0) // BUCKET_KEYS))
    dealt = _subsets(texts.join(sized(crowds), "node"), percent, buckets)
    shared = dealt.groupBy("bucket").applyInArrow(_several, "group long, node long, crowd long, side long, others long")
    shared = materialize(shared, "pj-shared")
    spares = sized(materialize(nodes.select("node", "n", "spare0", "spare1"), "pj-spares"))

    # the cheapest of them for each set, by how many sets of other crowds have them
    whole = Window.partitionBy("node")
    cheapest = Window.partitionBy("node", "side").orderBy("others", "group")
    need = F.count(F.lit(1)).over(Window.partitionBy("node", "side")) - F.when(F.col("side") == 0, F.col("spare0")).otherwise(F.col("spare1"))
    chosen = shared.where("others > 0").join(spares, "node").withColumns({"rank": F.row_number().over(cheapest), "need": need}).where("rank <= need")
    chosen = chosen.groupBy("node", "group", "crowd", "n", "side").agg(F.first("others").alias("others"))
    chosen = chosen.withColumn("hard", (F.sum("others").over(whole) > budget * F.col("n")) & (F.col("others") > budget))
    place = F.row_number().over(whole.orderBy("others", "group", "side"))
    chosen = materialize(chosen.select("group", "node", "crowd", "n", "side", "hard", (place <= FIRST).alias("first")), "pj-chosen")

    asked_for = sized(materialize(chosen.select("group").distinct(), "pj-groups"))
    index = shared.where("side = 0").join(asked_for, "group", "left_semi").select("group", "node", "crowd").distinct()
    index = materialize(index.join(spares, "node").drop("spare0", "spare1"), "pj-index")
    larger = (F.col("side") == 1) | (F.col("nb") > F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") > F.col("a")))
    apart = (F.col("ca") != F.col("cb")) & larger & _may_link(percent)
    bits = _cut(parities, chosen.select("node").union(index.select("node")))
    met = lambda rows, index: _as(rows.where("NOT hard").drop("hard", "first").join(bits, "node"), "a").join(_as(index.join(bits, "node"), "b"), "group").where(apart).select("a", "b", "ca", "cb")
    crowds, left = _tried(materialize(met(chosen.where("first"), index).distinct(), "pj-first"), crowds, texts, percent)
    chosen, index = (df.drop("crowd").join(sized(crowds), "node") for df in (chosen, index))
    pairs = met(chosen.where("NOT first"), index).union(left)

    # sets with many candidates, and those that share their subsets, once more with neighbourhoods
    hard = chosen.where("hard")
    named = index.join(hard.select("group").distinct(), "group").select("node", F.lit(False).alias("hard"))
    again = named.union(hard.select("node", "hard")).groupBy("node").agg(F.bool_or("hard").alias("hard"))
    again = materialize(again.join(crowds, "node"), "pj-again")
    if not again.isEmpty():
        near = materialize(_neighbourhoods(texts.join(sized(again), "node"), percent), "pj-near")
        held = near.where("side = 0")
        of_crowd = held.groupBy("key", "crowd").agg(F.count_if(~F.col("less")).alias("e"), F.count_if("less").alias("d"))
        of_all = of_crowd.groupBy("key").agg(F.sum("e").alias("all_e"), F.sum("d").alias("all_d"), F.min("crowd").alias("low"), F.max("crowd").alias("high"))
        asked = near.where("need > 0").join(sized(again.where("hard").select("node")), "node", "left_semi")
        asked = asked.join(of_all.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & ((F.col("low") != F.col("crowd")) | (F.col("high") != F.col("crowd")))).drop("k", "low", "high")
        asked = asked.join(of_crowd, ["key", "crowd"], "left")
        rest = lambda x: F.col(f"all_{x}") - F.coalesce(x, F.lit(0))
        asked = asked.withColumns({"as_is": rest("e"), "one_more": rest("d")})
        by_segment = asked.groupBy("node", "side", "segment", "need", "segments").agg(F.sum(F.when(~F.col("less"), F.col("as_is")).otherwise(0)).alias("zero"), F.sum(F.when(F.col("less"), F.col("as_is")).otherwise(F.col("one_more"))).alias("one"))
        # segments that nobody else meets take an allowance of 1 for nothing
        others = F.count(F.lit(1)).over(Window.partitionBy("node", "side"))
        by_segment = by_segment.withColumn("need", F.col("need") - 2 * (F.col("segments") - others)).where("need > 0")
        steps = F.array(F.struct(F.lit(1).alias("step"), F.col("zero").alias("price")), F.struct(F.lit(2).alias("step"), F.greatest("zero", "one").alias("price")))
        priced = by_segment.select("node", "side", "segment", "need", F.explode(steps).alias("s")).select("node", "side", "segment", "need", "s.*")
        order = Window.partitionBy("node", "side").orderBy("price", "step", "segment")  # a second step never comes before its first
        granted = priced.withColumn("rank", F.row_number().over(order)).where("rank <= need").groupBy("node", "side", "segment").agg(F.max("step").alias("step"))
        looks = asked.where("as_is > 0 OR one_more > 0").join(granted, ["node", "side", "segment"]).where("NOT less OR step = 2")
        kinds = F.when(F.col("less") | (F.col("step") == 1), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
        looks = looks.select("key", F.explode(kinds).alias("less"), "node", "crowd", "n", "side")
        # only what a set looks for is joined with parities
        asked_for = looks.select("key", "less").distinct()
        held = held.select("key", "less", "node", "crowd", "n").join(asked_for, ["key", "less"], "left_semi")
        found = _as(looks.join(bits, "node"), "a").join(_as(held.join(bits, "node"), "b"), ["key", "less"]).where(apart)
        pairs = pairs.union(found.select("a", "b", "ca", "cb"))
    pairs = materialize(pairs.distinct(), "pj-pairs")

    crowds, left = _tried(pairs, crowds, texts, percent)
    final = _moved(crowds, _linked(left, texts, percent))

    placed = nodes.join(final, "node")
    least = placed.groupBy("crowd").agg(F.min("least").alias("component_id"))
    by_set = materialize(placed.join(least, "crowd").select(*keys, "component_id", F.col("crowd").alias("root")), "pj-found")
    more = ["root", "uid"] * bool(uid_col)
    empty = rows.where("n = 0").withColumn("root", F.col("uid")).select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), *more)
    return rows.where("n > 0").select("doc_id", "uid", *keys).join(sized(by_set), keys).select("doc_id", F.col("n").alias("n_shingles"), "component_id", *more).union(empty)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component of ``similar_sets``: that of its least id; all columns kept.

    A null id is the least only if all are null; of rows that repeat the least id one stays; null and
    empty texts and those of white space stay, as they link with nothing."""
    keyed = materialize(docs.withColumn("__pj_uid", F.monotonically_increasing_id()), "pj-docs")
    found = materialize(similar_sets(keyed, id_col, text_col, percent, uid_col="__pj_uid"), "pj-verdicts")
    return least_of_groups(keyed, found, "__pj_uid").select(*[f"`{c}`" for c in docs.columns])
