"""Periodic runs of words, by catching squares with dyadic blocks.

A square is a stretch of words that says the same thing twice; a run is a maximal stretch that
repeats with one smallest period, at least twice over. For every power of two s the text is cut
into blocks of s words. A block that is complete becomes a catcher for squares of periods 2s to
4s - 1: the first half of such a square has 2s words or more, so it holds a whole block, and the
block comes again one period later. Each appended word completes a suffix of s words, whose two
live catchers are the blocks two and three places back; suffixes and blocks are compared by a hash
that is built from the halves' hashes. Where they agree, the stretch is drawn out to both sides by
blocks of falling size, and is a run if two periods fit in. What a known run already explains is
passed over; equal stretches of several periods merge into the one of the smallest. Periods below
four are followed word by word. Words of a batch of texts are appended together, one step for each
block size, with a word between texts that equals no other. Runs are compared word by word in the
end, so that the hashes decide nothing by themselves.

All of a text's words are in memory while it is worked on, about 150 bytes each with the hashes of
STORED block sizes; larger blocks keep only the latest size.

Defined cases: null and empty texts, and those of white space, have no words and no runs; very long
texts are read whole; repeated rows give equal rows; null ids stay null; extra columns are ignored;
an empty table gives an empty result. Ties between runs do not matter, as all are returned."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamkit.llm._shared import small_batches

#: Words of the shortest run.
LEAST = 12
#: Block sizes whose hashes are kept for drawing stretches out: 1, 2, 4 and so on.
STORED = 12
#: Periods below this are followed word by word.
SHORT = 4


def _joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Hashes of blocks from those of their halves."""
    with np.errstate(over="ignore"):
        z = x * np.uint64(0x9E3779B97F4A7C15) + (y ^ (y >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
        z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return z ^ (z >> np.uint64(29))


def _drawn(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
    """How far the words from x and from y on agree, forwards (step 1) or backwards (-1)."""
    n, far, top = len(levels[0]), np.zeros(len(x), np.int64), len(levels) - 1
    for k in range(top, -1, -1):
        s, live = 1 << k, np.arange(len(x))
        while len(live):
            a, b = x[live] + step * far[live], y[live] + step * far[live]
            if step < 0:
                a, b = a - s, b - s
            inside = (a >= 0) & (b + s <= n)
            live, a, b = live[inside], a[inside], b[inside]
            live = live[levels[k][a] == levels[k][b]]
            far[live] += s
            if k < top:  # below the largest size, one more block at most can fit
                break
    return far


def _stretches(words: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of period q, word by word."""
    same = np.flatnonzero(np.diff(np.concatenate(([False], words[q:] == words[:-q], [False])).view(np.int8)))
    return same[::2], same[1::2] + q


def _caught(hashes: np.ndarray, s: int, back: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, period) where a suffix of s words equals the catcher ``back`` blocks before its own,
    and the block before that catcher has not come again at the same distance."""
    m = len(hashes) - back * s
    same = np.repeat(hashes[: max(m, 0) : s], s)[:m] == hashes[back * s :]
    fresh = same.copy()
    fresh[s:] &= ~same[:-s]
    at = np.flatnonzero(fresh)
    return at - at % s, back * s + at % s


def runs(words: np.ndarray, longest: int, least: int = LEAST) -> np.ndarray:
    """(start, end, period) of all runs of at least ``least`` words, by start and period.

    ``words`` holds numbers for words, ``longest`` the words of the longest text in it."""
    n, found = len(words), [np.zeros((0, 3), np.int64)]
    explained: tuple[np.ndarray, np.ndarray] | None = None

    def keep(start: np.ndarray, end: np.ndarray, q: np.ndarray) -> None:
        nonlocal explained
        long = end - start >= np.maximum(least, 2 * q)
        new = np.unique(np.stack([start[long], end[long], q[long]], axis=1), axis=0)
        found.append(new)
        if len(new) and explained is None:
            explained = np.zeros(n, np.int64), np.ones(n, np.int64)
        for a, b, p in new[np.lexsort((-new[:, 2], new[:, 1] - new[:, 0]))].tolist():
            if explained[0][a] < b or p % explained[1][a]:
                explained[0][a:b], explained[1][a:b] = b, p

    for q in range(1, min(SHORT, n)):
        start, end = _stretches(words, q)
        keep(start, end, np.full(len(start), q))
    latest, s = _joined(words.astype(np.uint64), np.zeros(n, np.uint64)), 1
    levels = [latest]
    while 8 * s <= longest:  # two periods of twice the next block size
        latest, s = _joined(latest[:-s], latest[s:]), 2 * s
        if len(levels) <= STORED:
            levels.append(latest)
        for back in (2, 3):
            block, q = _caught(latest, s, back)
            if explained is not None:
                open_ = (explained[0][block] < block + q + s) | (q % explained[1][block] != 0)
                block, q = block[open_], q[open_]
            if len(block):
                end = block + q + s + _drawn(levels, block + s, block + q + s, 1)
                keep(block - _drawn(levels, block, block + q, -1), end, q)
    whole = np.concatenate(found)
    for q in {int(q) for a, b, q in whole.tolist() if not _maximal(words, a, b, q)}:  # a hash has lied
        start, end = _stretches(words, q)
        long = end - start >= max(least, 2 * q)
        whole = np.concatenate([whole[whole[:, 2] != q], np.stack([start[long], end[long], np.full(long.sum(), q)], axis=1)])
    whole = whole[np.lexsort((whole[:, 2], whole[:, 1], whole[:, 0]))]
    first = np.ones(len(whole), bool)
    first[1:] = (whole[1:, :2] != whole[:-1, :2]).any(axis=1)  # of equal stretches the smallest period
    whole = whole[first]
    return whole[np.lexsort((whole[:, 2], whole[:, 0]))]


def _maximal(words: np.ndarray, start: int, end: int, q: int) -> bool:
    grows = (start > 0 and words[start - 1] == words[start - 1 + q]) or (end < len(words) and words[end] == words[end - q])
    return not grows and np.array_equal(words[start : end - q], words[start + q : end])


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and where each text's begin."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = split.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    return flat.filter(full), before[split.offsets.to_numpy() - split.offsets[0].as_py()]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per input row: doc_id, n_words, runs (start, length and period in words, by start and
    then period), and collapsed: the text, its words joined by single spaces, without those that
    any run holds after its first period."""
    kind = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            flat, begin = _words(texts)
            size = np.diff(begin)
            number = np.arange(len(texts))
            coded = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
            line = np.full(len(flat) + len(texts), -1, np.int64)  # each text's words, then a word of its own
            place = np.arange(len(flat)) + np.repeat(number, size)
            line[place] = coded
            line[begin[1:] + number] = -1 - number
            start, end, q = runs(line, int(size.max(initial=0)), least).T
            owner = np.searchsorted(begin[1:] + number, start)
            dropped = np.zeros(len(line) + 1, np.int64)
            np.add.at(dropped, start + q, 1)
            np.add.at(dropped, end, -1)
            stays = np.cumsum(dropped)[place] == 0
            kept = np.concatenate(([0], np.cumsum(stays)))[begin].astype(np.int32)
            said = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept), flat.filter(pa.array(stays))), " ")
            each = pa.StructArray.from_arrays([pa.array(x) for x in (start - begin[owner] - owner, end - start, q)], fields=list(kind))
            edges = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts))))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.ListArray.from_arrays(pa.array(edges), each), said], names=["doc_id", "n_words", "runs", "collapsed"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    )
