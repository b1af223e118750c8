"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ from a passage by up to k edits, k being ERROR_RATE of m.
Cut into k + 1 pieces, at least one piece of the item must then occur unchanged, so documents are
searched for all pieces at once (Aho-Corasick), each hit gives a stretch of text where the item
may lie, and Myers' bit-parallel algorithm finds the item's least edit distance there. Items are a
stated query set: they are held in blocks of about BLOCK_BYTES of text; a block is broadcast, the
documents are searched, and with more blocks the result is written before the next is fetched.

Letters are compared in lower case and white space as spaces; spans are in code points of the
original text. Defined cases: null texts are empty; very long texts are searched whole; empty items
match nothing; items too short for an edit match exactly; of matches of one item that tie in
distance the first counts; repeated items and rows are matched one by one; extra columns are
ignored by ``find_matches`` and kept by ``clean_rows``, whatever their names; empty tables give no
matches."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamkit.llm._shared import materialize, small_batches

ERROR_RATE = 0.05
BLOCK_BYTES = 8 << 20
SPACES = str.maketrans({c: " " for c in "\t\n\v\f\r   "})


def fold(text: str) -> str:
    """Lower case and plain spaces, one character for one."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.translate(SPACES)


def budget(length: int, rate: float = ERROR_RATE) -> int:
    return int(length * rate)


def cut(item: str, rate: float = ERROR_RATE) -> list[tuple[int, str]]:
    """The item's pieces with their offsets, one more than its budget of edits."""
    n = budget(len(item), rate) + 1
    edges = [i * len(item) // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


def peq(item: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    return masks


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(least distance of the pattern to any stretch of text, end of the first such stretch)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    get = masks.get
    for i, c in enumerate(text):
        eq = get(c, 0)
        across = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(across | plus)), plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best, end = score, i + 1
        steady = eq | minus
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(steady | up)), up & steady
    return best, end


class Matcher:
    """Items of one block with their pieces and bit masks."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, t) for i, t in ((i, fold(t or "")) for i, t in items) if t]
        self.rate = rate
        self.masks = [peq(t) for _, t in self.items]
        self.back = [peq(t[::-1]) for _, t in self.items]
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, text) in enumerate(self.items):
            for at, piece in cut(text, rate):
                where[piece].append((n, at))
        self.pieces = ahocorasick.Automaton()
        for piece, places in where.items():
            self.pieces.add_word(piece, (len(piece), places))
        self.pieces.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of the best match of each item within budget."""
        if not self.items:
            return []
        text = fold(text)
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (length, places) in self.pieces.iter(text):
            for n, at in places:
                starts[n].add(end + 1 - length - at)
        out = []
        for n, guesses in starts.items():
            item = self.items[n][1]
            m, k = len(item), budget(len(item), self.rate)
            best: tuple[int, int, int] | None = None
            lo = hi = None
            stretches = []
            for g in sorted(guesses):
                a, b = max(0, g - k), min(len(text), g + m + k)
                if hi is not None and a <= hi:
                    hi = max(hi, b)
                else:
                    if hi is not None:
                        stretches.append((lo, hi))
                    lo, hi = a, b
            stretches.append((lo, hi))
            for a, b in stretches:
                part = text[a:b]
                at = part.find(item)
                if at >= 0:
                    best = (0, a + at, a + at + m)
                    break
                distance, end = myers(self.masks[n], m, part)
                if distance <= k and (best is None or distance < best[0]):
                    # the start: the same search backwards from the end
                    _, back = myers(self.back[n], m, part[max(0, end - m - k) : end][::-1])
                    best = (distance, a + end - back, a + end)
            if best:
                out.append((self.items[n][0], *best))
        return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[Broadcast, bool]]:
    """Broadcasts of items, about ``block_bytes`` of their text each, and whether one is the last.
    A block is fetched when it is asked for."""
    total = benchmark.agg(F.sum(F.octet_length("text") + 64).alias("b")).first()["b"] or 0
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        mine = benchmark if blocks == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        items = [(r["item_id"], r["text"]) for r in mine.select("item_id", "text").collect()]
        yield benchmark.sparkSession.sparkContext.broadcast(items), b == blocks - 1


def find_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, distance, start, end): for every document and item whose best match is
    within the item's budget of edits."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = "doc_id long, item_id long, distance int, start long, end long"
    found = []
    for items, last in _blocks(benchmark, block_bytes):

        def search(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            matcher = Matcher(items.value, rate)
            for batch in batches:
                ids, out = batch.column(0).to_pylist(), []
                for doc, text in zip(ids, pc.fill_null(batch.column(1), "")):
                    out += [(doc, *m) for m in matcher.matches(text.as_py())]
                columns = list(zip(*out)) if out else [[]] * 5
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "item_id", "distance", "start", "end"])

        matched = rows.mapInArrow(search, schema)
        if not last:
            matched = materialize(matched, "matches")
            items.unpersist()
        found.append(matched)
    return reduce(DataFrame.unionByName, found)


def _clean(items: Broadcast, rate: float) -> Callable[..., Column]:
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(items.value, rate)
        for texts in batches:
            yield pd.Series([not matcher.matches(t or "") for t in texts], dtype=bool)

    return clean


def clean_rows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows that hold a test item; all columns kept. Each row is judged by its own
    text, whatever its id."""
    small_batches(docs.sparkSession)
    for items, last in _blocks(benchmark, block_bytes):
        docs = docs.where(_clean(items, rate)(F.col(f"`{text_col}`")))
        if not last:
            docs = materialize(docs, "clean-rows")
            items.unpersist()
    return docs
