"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written

#: Rows of a block of the fit list.
ROWS = 4096
#: Steps from a new random direction after all components have settled: another copy of an eigenvalue shows up there.
PROBE = 8

OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, x with x as bytes: integers of the fewest bytes (2, 4 or 8) that hold all of the row's, so equal rows have equal bytes."""
    for batch in batches:
        lists = batch.column("x")
        sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
        d = int(sizes[0]) if len(sizes) else 0
        x = flat.reshape(len(batch), d)
        fits = [np.ones(len(x), bool)]
        for kind in (np.int32, np.int16):
            limits = np.iinfo(kind)
            fits.append(((x >= limits.min) & (x <= limits.max)).all(axis=1))
        raw: list[bytes] = [b""] * len(x)
        for kind, own in ((np.int16, fits[2]), (np.int32, fits[1] & ~fits[2]), (np.int64, ~fits[1])):
            at, body, step = np.flatnonzero(own), x[own].astype(kind).tobytes(), d * np.dtype(kind).itemsize
            for k, i in enumerate(at.tolist()):
                raw[i] = body[k * step : (k + 1) * step]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(raw, pa.binary())], ["vec_id", "x"])


def _matrix(raw: list[bytes], d: int) -> np.ndarray:
    """Packed rows as one matrix of 64-bit integers."""
    out = np.empty((len(raw), d), np.int64)
    sizes = np.array([len(r) // d for r in raw])
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        out[at] = np.frombuffer(b"".join(raw[i] for i in at), f"<i{size}").reshape(len(at), d)
    return out


def fit_blocks(rows: DataFrame, d: int) -> DataFrame:
    """The fit list: each distinct row once, in written blocks of about ROWS rows. Copies combine before the shuffle, so a row that is a third of the table costs one row a task."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for batch in batches:
            held += batch.column("x").to_pylist()
            while len(held) >= ROWS:
                yield pa.RecordBatch.from_arrays([pa.array([_matrix(held[:ROWS], d).tobytes()], pa.binary())], ["block"])
                held = held[ROWS:]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([_matrix(held, d).tobytes()], pa.binary())], ["block"])

    return written(rows.select("x").distinct().mapInArrow(blocks, "block binary"), "whiten-fit")


def _over(blocks: DataFrame, d: int, of, kind: str = "double") -> dict[int, float]:
    """Sums over all blocks of what `of` gives for each (a vector of bounded length): summed in each task, then by position in Spark, so the driver gets one number a position."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column("block").to_pylist():
                got = of(np.frombuffer(raw, np.int64).reshape(-1, d))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["at", "value"])

    got = blocks.mapInArrow(each, f"at int, value {kind}").groupBy("at")
    return {r["at"]: r["value"] for r in got.agg(F.sum(F.col("value").cast("decimal(38,0)") if kind == "long" else "value").alias("value")).collect()}


def list_sums(blocks: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows of the fit list and the exact sum of each dimension, of any size: upper and lower halves are summed apart."""
    got = _over(blocks, d, lambda x: np.concatenate([[len(x)], (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)]), "long")
    return int(got.get(0, 0)), [(int(got[1 + i]) << 32) + int(got[1 + d + i]) for i in range(d)] if got else []


def bidiagonal(multiply, d: int, want: int) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns) of a matrix X of d columns: the `want` largest, fewer if its rank is less.

    Golub-Kahan-Lanczos. The left vectors are as long as the table and never stored: u_j = X w_j for a w_j of d numbers,
    and with g_j = Xᵀu_j its product with any X v is g_j.v, so both sides are reorthogonalised in full (twice) from d
    numbers each. multiply(w) -> (Xᵀ(X w), |X w|²) is the one pass over the rows that a step takes. Where a direction
    is used up, a new random one goes on. Once the wanted values have settled to double precision, PROBE further steps
    look for further copies of them. At d steps the decomposition is complete.
    """
    draw = np.random.default_rng(12)
    right, left, images = (np.zeros((d, 0)) for _ in range(3))
    alphas: list[float] = []
    betas: list[float] = []
    eps = np.finfo(float).eps
    probes, settled = 0, False

    def fresh() -> np.ndarray:
        v = draw.standard_normal(d)
        for _ in range(3):
            v -= right @ (right.T @ v)
            v /= np.linalg.norm(v)
        return v

    v = fresh()
    while True:
        w = v.copy()
        for _ in range(2):
            w -= left @ (images.T @ w)
        image, square = multiply(w)
        alpha = float(np.sqrt(max(square, 0.0)))
        top = max([alpha, *alphas, *betas])
        if alpha <= d * eps * top or not alpha:
            alpha, w, image = 0.0, np.zeros(d), np.zeros(d)
        else:
            w, image = w / alpha, image / alpha
        right, left, images = np.column_stack([right, v]), np.column_stack([left, w]), np.column_stack([images, image])
        alphas.append(alpha)
        k = len(alphas)
        u, values, q = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
        if k == d:
            break
        rest = image.copy()
        for _ in range(2):
            rest -= right @ (right.T @ rest)
        beta = float(np.linalg.norm(rest))
        small = beta <= d * eps * values[0]
        done = k >= want and bool((beta * np.abs(u[-1, :want]) <= 4 * eps * values[0]).all())
        probes = probes + 1 if settled else 0
        if settled and probes >= PROBE and done:
            break
        if done and not settled:
            settled, small = True, True
        settled = settled and (done or probes < PROBE)
        betas.append(0.0 if small else beta)
        v = fresh() if small else rest / beta
    keep = min(want, int((values > d * eps * values[0]).sum()))
    return values[:keep], right @ q[:keep].T


def whitened(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, components: int = 4) -> DataFrame:
    """For each row and each of the first principal components: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    An entry c counts as x = floor(scale * c). Means, covariance (divisor n) and components are those of the distinct x
    vectors, n of them with sums S; whitened is (x - S/n) on the unit eigenvector over the root of its eigenvalue,
    deviation the exact sum of (n*x - S)², null where that leaves 64 bits, explained the eigenvalue's part of the trace,
    identity_error the largest entry by which the covariance of `whitened` over the fit list differs from the identity.
    An eigenvector's largest entry is positive (of equal ones the first).

    Decided: a vector that is null or holds a null or an entry that isn't finite is left out; what leaves 64 bits after
    scaling counts as the nearest integer of 64 bits. Vectors of another length than most (of equal counts, the longer) have no place in the
    covariance and are left out too. Repeated rows and repeated or null ids come out once for each row, but repeated
    vectors count once in the fit. Fewer components come out where the covariance has a smaller rank, none where all
    rows are alike. More columns aren't read. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    sound = F.forall(vector_col, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    x = F.transform(vector_col, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    rows = vectors.filter(F.col(vector_col).isNotNull()).filter(sound).select(F.col(id_col).cast("long").alias("vec_id"), F.when(sound, x).alias("x")).filter(F.size("x") > 0)
    length = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("d")).first()
    if length is None:
        return spark.createDataFrame([], OUT)
    d = length["d"]
    rows = written(rows.filter(F.size("x") == d).mapInArrow(packed, "vec_id long, x binary"), "whiten-rows")
    blocks = fit_blocks(rows, d)
    n, sums = list_sums(blocks, d)
    mean = np.array([s / n for s in sums])

    def multiply(w: np.ndarray) -> tuple[np.ndarray, float]:
        def both(x: np.ndarray) -> np.ndarray:
            r = x - mean
            xw = r @ w
            return np.concatenate([xw @ r, [xw @ xw]])

        got = _over(blocks, d, both)
        return np.array([got[i] for i in range(d)]) / n, got[d] / n

    trace = _over(blocks, d, lambda x: np.array([((x - mean) ** 2).sum()]))[0] / n
    deviations, axes = bidiagonal(multiply, d, min(components, d)) if trace else (np.zeros(0), np.zeros((d, 0)))
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    c, to = len(deviations), axes / deviations

    def moments(x: np.ndarray) -> np.ndarray:
        y = (x - mean) @ to
        return np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])

    off = 0.0
    if c:
        got = _over(blocks, d, moments)
        flat = np.array([got[i] for i in range(c + c * c)]) / n
        off = float(np.abs(flat[c:].reshape(c, c) - np.outer(flat[:c], flat[:c]) - np.eye(c)).max())
    shares = (deviations**2 / trace).tolist() if c else []

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.array(sums, object)
        most = max(map(abs, sums))
        for batch in batches:
            x = _matrix(batch.column("x").to_pylist(), d)
            reach = n * (int(np.abs(x.astype(float)).max()) + 1 if len(x) else 0) + most
            if d * reach * reach < 2**62:
                deviation = pa.array(((n * x - total.astype(np.int64)) ** 2).sum(axis=1))
            else:
                exact = [sum(v * v for v in (n * r.astype(object) - total).tolist()) for r in x]
                deviation = pa.array([v if v < 2**63 else None for v in exact], pa.int64())
            y, m = (x - mean) @ to, len(x)
            take = np.repeat(np.arange(m), c)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(take)), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), m)), pa.array(np.full(m * c, n, np.int64)), deviation.take(pa.array(take)),
                pa.array(y.ravel()), pa.array(np.tile(np.array(shares, float), m)), pa.array(np.full(m * c, off)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(projected, OUT)


def op12_golub_kahan_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
