"""Secret scan with multipart credential linking.

Strong patterns (assignments, AWS-style access ids, long hexadecimal runs) are reported on their
own. Weak parts (bare identifiers, high-entropy tokens, endpoints) mean nothing alone; they are
reported only where complementary parts, disjoint from them, lie in one scope within ``reach`` code
points: an identifier or a token needs its counterpart, an endpoint needs both, disjoint from each
other. A scope is a paragraph: text between empty lines. The parts of a text are joined to each
other as intervals: per scope and role they lie sorted by end and by start, and those within reach
on either side are found by bisection. Parts of one kind do not overlap, so that these are few and
a text of n parts takes about n log n steps. As scopes never cross documents, the join needs no
shuffle: it runs where the text was read.

Defined cases: null text is the empty text; rows without parts come out with zero counts and empty
strings; very long texts are read whole, and tokens of any length are parts; of parts that start
together the order is that of KINDS; one stretch of text that fits two roles does not complement
itself; repeated rows are scanned one by one; extra columns are ignored, whatever their names; an
empty table gives an empty result."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamkit.llm._shared import small_batches

#: Kinds in the order that breaks ties of start; the first three are the base.
KINDS = ["assign", "access", "hex", "ident", "blob", "endpoint"]
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "ident": "id", "blob": "secret", "endpoint": "endpoint"}
#: The most code points between complementary parts.
REACH = 200
BREAK = re.compile(r"\n[ \t]*\n")
#: What a weak kind needs beside it: parts of all these roles.
NEEDS = {"ident": ("secret",), "blob": ("id",), "endpoint": ("id", "secret")}

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
IDENT = re.compile(r"""(?:client_?id|account_?id|key_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", re.IGNORECASE | re.ASCII)
BLOB = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])")
#: A name with dots and a port begins where no name runs on before it, and gives nothing back, so
#: that long names are read once.
ENDPOINT = re.compile(r"https?://[^\s\"'<>]+|(?<![A-Za-z0-9_-])(?<![A-Za-z0-9_-]\.)[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++)++:[0-9]{2,5}\b")
#: What a text must match for its pattern to be tried; these may match more, never less.
HINTS = {
    "assign": r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
    "ident": r"(?i)(client_?id|account_?id|key_?id|user_?name|login)[\"']? *[:=]",
    "blob": r"[A-Za-z0-9+/_-]{20}",
    "endpoint": r"https?://|[A-Za-z0-9_-]:[0-9]{2}",
}


def _mixed(token: str) -> bool:
    """Whether a token has upper, lower and digit, and many different characters."""
    return any(c.isupper() for c in token) and any(c.islower() for c in token) and any(c.isdigit() for c in token) and len(set(token)) >= 10


def find(kind: str, text: str) -> list[tuple[int, int]]:
    """Spans of one kind, leftmost and non-overlapping, in code points."""
    if kind == "assign":
        return [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if kind == "access":
        return [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if kind == "hex":
        return [m.span() for m in HEX.finditer(text)]
    if kind == "blob":
        return [m.span() for m in BLOB.finditer(text) if _mixed(m[0])]
    return [m.span() for m in (IDENT if kind == "ident" else ENDPOINT).finditer(text)]


def joined(spans: list[tuple[int, int, str]]) -> str:
    ordered = sorted((start, KINDS.index(kind), end) for start, end, kind in spans)
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in ordered)


def linked(found: list[tuple[int, int, str]], breaks: list[int], reach: int = REACH) -> list[tuple[int, int, str]]:
    """The weak parts of a text that lie within ``reach`` of all they need. ``breaks`` are the
    ascending places of the empty lines."""
    by_start: dict[tuple[int, str], list[tuple[int, int]]] = defaultdict(list)
    by_end: dict[tuple[int, str], list[tuple[int, int]]] = defaultdict(list)
    for start, end, kind in found:
        key = bisect_left(breaks, start), ROLE[kind]
        by_start[key].append((start, end))
        by_end[key].append((end, start))
    for places in (*by_start.values(), *by_end.values()):
        places.sort()

    def beside(start: int, end: int, key: tuple[int, str]) -> list[tuple[int, int]]:
        before, after = by_end.get(key, []), by_start.get(key, [])
        near = [(s, e) for e, s in before[bisect_left(before, (start - reach, -1)) : bisect_right(before, (start, start))]]
        return near + after[bisect_left(after, (end, -1)) : bisect_left(after, (end + reach + 1, -1))]

    out = []
    for start, end, kind in found:
        if kind in NEEDS:
            near = [beside(start, end, (bisect_left(breaks, start), role)) for role in NEEDS[kind]]
            if all(near) and (len(near) == 1 or _disjoint(*near)):
                out.append((start, end, kind))
    return out


def _disjoint(one: list[tuple[int, int]], two: list[tuple[int, int]]) -> bool:
    """Whether some interval of one list lies before or after some of the other."""
    return min(e for _, e in one) <= max(s for s, _ in two) or min(e for _, e in two) <= max(s for s, _ in one)


def _scan(reach: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            may = {kind: pc.match_substring_regex(texts, hint).to_pylist() for kind, hint in HINTS.items()}
            counts: dict[str, list[int]] = {k: [] for k in KINDS[:3]}
            digests, bases, spans = [], [], []
            for i in range(len(texts)):
                found: list[tuple[int, int, str]] = []
                if any(may[k][i] for k in KINDS):
                    text = texts[i].as_py()
                    for kind in KINDS:
                        if may[kind][i]:
                            found += [(s, e, kind) for s, e in find(kind, text)]
                base = [x for x in found if x[2] in KINDS[:3]]
                for kind in KINDS[:3]:
                    counts[kind].append(sum(x[2] == kind for x in base))
                bases.append(joined(base))
                digests.append(hashlib.sha256(bases[-1].encode()).hexdigest())
                weak = linked(found, [m.start() for m in BREAK.finditer(text)], reach) if len(found) > max(1, len(base)) else []
                spans.append(joined(base + weak) if weak else bases[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS[:3]), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(bases, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "base_spans"],
            )

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per input row: counts of base kinds, digest of the base spans, ``spans``: the base
    spans with the linked weak parts, and ``base_spans`` alone."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, base_spans string"
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(_scan(reach), schema)
