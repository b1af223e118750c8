"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Entries are brought to whole numbers, x = floor(SCALE * entry). The fit list holds each distinct
vector once, n of them with the per-dimension sums S. The leading eigenvectors of its covariance V
(divisor n, centred before multiplying) are found without forming V: a block Q of columns goes
through the polynomial recurrence of Chebyshev, each step of which is one distributed pass that adds
up Xc'(Xc Q) over the partitions, Xc being the centred vectors. The polynomial is small on
[0, cut], where cut is the block's least Ritz value, and grows fast above, so that it damps the
unwanted spectrum. After DEGREE steps Q is made orthonormal (QR) and the Rayleigh-Ritz values and
vectors of V in Q are taken, with one more pass, which also gives the residuals. It ends when the
residuals of the wanted pairs are below TOLERANCE of the largest eigenvalue, or below ROUNDED and
no longer falling; else it fails. The block has GUARD columns more than are wanted. The driver
holds d x (wanted + GUARD) numbers; a pass sends it one such block, added up in the executors, or one
from each of FEW_PARTS partitions at most.

``whiten`` then projects every remaining row, and one more pass over the fit list measures how far
the covariance of the whitened vectors is from the identity.

Defined cases: rows whose vector is null or holds null or non-finite entries, or entries too large
for a long once scaled, are dropped, as are vectors that have not the commonest number of entries
(of equally common ones the larger); repeated vectors count once in the fit and get rows each;
eigenvalues that are zero to rounding have no component, so that fewer than ``wanted`` may come out;
null ids stay null; ties of eigenvalues leave the choice within their space; extra columns are
ignored; without two different vectors the result is empty. A deviation that does not fit a long
is an error."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamkit.llm._shared import materialize

SCALE, WANTED = 256, 4
#: Columns beyond those wanted, and steps of the recurrence between two orthonormal blocks.
GUARD, DEGREE = 44, 8
#: Residuals, in parts of the largest eigenvalue, at which a pair is taken, and at which it may be
#: taken once they no longer fall.
TOLERANCE, ROUNDED, CYCLES = 1e-13, 1e-10, 200
#: Partitions whose blocks the driver adds up itself; blocks of more are added up in the executors.
FEW_PARTS = 64
#: Eigenvalues below this part of the trace are zero.
ZERO = 1e-12


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x): rows with a sound vector, as whole numbers."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("e")).where("e IS NOT NULL AND size(e) > 0")
    fine = rows.where(F.forall("e", lambda c: c.isNotNull() & (F.abs(c) <= 2.0**62 / scale)))
    return fine.select("vec_id", F.transform("e", lambda c: F.floor(c * scale).cast("long")).alias("x"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _passed(fit: DataFrame, mean: np.ndarray, block: np.ndarray, half: Callable[[np.ndarray], np.ndarray] | None = None, few: bool = False) -> np.ndarray:
    """Sum over the fit list of Xc'(Xc block), one distributed pass; with ``half`` of half(Xc block).
    ``few`` says that there are few partitions."""
    width = block.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            centred = _matrix(batch.column(0)) - mean
            through = centred @ block
            part = centred.T @ through if half is None else half(through)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), *[pa.array(c) for c in total.T.copy()]], names=["i", *[f"c{j}" for j in range(width)]])

    parts = fit.mapInArrow(run, "i long, " + ", ".join(f"c{j} double" for j in range(width)))
    if not few:
        parts = parts.groupBy("i").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(width)])
    table = parts.toArrow()
    rows = table.column(0).to_numpy()
    total = np.zeros((int(rows.max()) + 1, width))
    np.add.at(total, rows, np.stack([table.column(j + 1).to_numpy() for j in range(width)], axis=1))
    return total


def leading(apply: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int = WANTED, guard: int = GUARD, degree: int = DEGREE) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of a symmetric operator without negative ones, of
    which ``apply`` gives the product with a block, the largest first."""
    width, wanted = min(dim, wanted + guard), min(dim, wanted)
    block = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, width)))[0]

    def ritz(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
        image = apply(q)
        small = q.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        rest = np.linalg.norm(image @ turn - q @ turn * values, axis=0)
        return values, q @ turn, float(rest[:wanted].max() / max(values[0], 1e-300)), image @ turn

    values, block, rest, image = ritz(block)
    for _ in range(CYCLES):
        if rest <= TOLERANCE or width == dim or values[0] <= 0:
            return np.maximum(values[:wanted], 0), block[:, :wanted]
        before = values, block, rest
        half = max(values[-1], ZERO * values[0]) / 2  # the unwanted spectrum lies in [0, 2 half]
        grown = half / (values[0] - half)  # scaled so that the largest eigenvalue's part stays near one
        last, now = block, (image - half * block) * (grown / half)
        damp = grown
        for _ in range(degree - 1):
            step = 1 / (2 / grown - damp)
            last, now = now, (apply(now) - half * now) * (2 * step / half) - damp * step * last
            damp = step
        values, block, rest, image = ritz(np.linalg.qr(now)[0])
        if before[2] <= ROUNDED and rest >= before[2] / 2:
            values, block, rest = min(before, (values, block, rest), key=lambda x: x[2])
            return np.maximum(values[:wanted], 0), block[:, :wanted]
    raise ArithmeticError(f"the residuals stay at {rest:.1e} of the largest eigenvalue")


def fit(x: DataFrame, wanted: int = WANTED) -> dict[str, object] | None:
    """The whitening of vectors (x): n, sums, mean, values, vectors, trace, error and dim; None
    without two different vectors."""
    size = x.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if size is None:
        return None
    dim = size["d"]
    distinct = materialize(x.where(F.size("x") == dim).select("x").distinct(), "whiten-fit")
    # in decimals where sums of longs might not fit
    sums = distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s"), F.count(F.lit(1)).alias("n")).orderBy("i").collect()
    n, exact = sums[0]["n"], [int(r["s"]) for r in sums]
    if n < 2:
        return None
    mean = np.array([s / n for s in exact])
    trace = _trace(distinct, mean) / n
    few = distinct.rdd.getNumPartitions() <= FEW_PARTS
    values, vectors = leading(lambda q: _passed(distinct, mean, q, few=few) / n, dim, wanted)
    real = values > ZERO * trace
    values, vectors = values[real], vectors[:, real]
    white = vectors / np.sqrt(values)
    spread = _passed(distinct, mean, white, lambda t: t.T @ t, few) / n
    return {"n": n, "sums": exact, "mean": mean, "values": values, "vectors": vectors, "trace": trace, "error": float(np.abs(spread - np.eye(len(values))).max(initial=0)), "dim": dim}


def _trace(distinct: DataFrame, mean: np.ndarray) -> float:
    """Sum of the squared lengths of the centred vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([0.0 + sum(float(np.square(_matrix(b.column(0)) - mean).sum()) for b in batches if b.num_rows)])], names=["t"])

    return distinct.mapInArrow(run, "t double").agg(F.sum("t").alias("t")).first()["t"]


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Sum over dimensions of (n x - S)^2, exact: in 64 bits where that is sure to be enough, else
    in whole numbers of any size."""
    most = n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, sums))
    if most * most * x.shape[1] < 1 << 63:
        apart = n * x - np.array(sums, np.int64)
        return (apart * apart).sum(axis=1)
    apart = n * x.astype(object) - np.array(sums, object)
    total = (apart * apart).sum(axis=1)
    if max(total) >= 1 << 63:
        raise OverflowError("a deviation does not fit a long")
    return total.astype(np.int64)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", wanted: int = WANTED, scale: int = SCALE) -> DataFrame:
    """A row for each sound row and component: vec_id, component (from 1, by falling eigenvalue), n,
    deviation (sum over dimensions of (n x - S)^2), whitened, explained (part of the trace), and
    identity_error (of the whole)."""
    x = whole_vectors(vectors, id_col, vec_col, scale)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = fit(x, wanted)
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)
    n, sums, mean, values, dim, error = (found[k] for k in ("n", "sums", "mean", "values", "dim", "error"))
    white, part = found["vectors"] / np.sqrt(values), values / found["trace"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, many, k = _matrix(batch.column(1)), batch.num_rows, len(values)
            each = np.repeat(np.arange(many), k)
            columns = [np.tile(np.arange(1, k + 1, dtype=np.int32), many), np.full(many * k, n), _deviations(rows, n, sums)[each], ((rows - mean) @ white).ravel(), np.tile(part, many), np.full(many * k, error)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(each)), *map(pa.array, columns)], names=[f.split()[0] for f in schema.split(", ")])

    return x.where(F.size("x") == dim).mapInArrow(run, schema)
