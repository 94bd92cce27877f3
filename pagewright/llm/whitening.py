"""Embedding whitening by Chebyshev-filtered subspace iteration.

The fit list is every vector that is not null and holds no null or non-finite
entry; each entry c becomes the integer x = floor(1024 * c) + 100000.  The
leading eigenvectors of the covariance V of x (divisor n, centred before
multiplying) are found without forming V: every product V @ Y is one
distributed pass over the fit list (partial Xc^T (Xc Y) per task, summed by
a small shuffle), a Chebyshev polynomial in V damps the unwanted part of the
spectrum [0, cut], and QR plus Rayleigh-Ritz of the filtered block follow until
the residual of every wanted pair is certified below ``TOLERANCE``.

Defined cases: a null vector, a null or non-finite entry, or an entry of
magnitude 2**52 / 1024 or more (whose x would not be exact) drops the row;
vectors whose length differs from the longest remaining length are dropped as
well; an empty table, empty vectors or a zero covariance give no rows.  Only
components with a positive eigenvalue are returned.  Repeated rows and
repeated ``vec_id`` are separate rows of the fit list.  Columns of the input
other than ``vec_id`` and ``embedding`` are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Components returned; guard vectors widen the block so the filter cuts deeper.
COMPONENTS = 8
GUARD = 24
#: Chebyshev degree bounds, and the certified residual relative to the largest eigenvalue.
DEGREES = (2, 12)
TOLERANCE = 1e-11
#: Outer iterations without a smaller residual after which the block is taken as it is.
STALL = 4
SEED = 7
#: Magnitudes of entries whose x is exact.
LIMIT = float(2**52) / 1024.0


def fit_list(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x array<bigint>) of every usable row, as defined in the module."""
    e = F.col(vec_col)
    finite = F.forall(e, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < F.lit(LIMIT)))
    usable = vectors.select(F.col(id_col).alias("vec_id"), e.alias("v")).where(e.isNotNull() & finite)
    x = F.transform("v", lambda v: (F.floor(v.cast("double") * 1024).cast("long") + F.lit(100000)))
    return usable.select("vec_id", x.alias("x"))


def _sums(fit: DataFrame) -> tuple[int, int, list[int], list[int]]:
    """n, d and exact per-dimension sums of x and x*x of the fit list."""
    d = fit.agg(F.max(F.size("x"))).first()[0] or 0
    if d <= 0:
        return 0, 0, [], []
    fit = fit.where(F.size("x") == d)
    rows = (
        fit.select(F.posexplode("x").alias("j", "v"))
        .groupBy("j")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v").cast("decimal(38,0)") * F.col("v")).alias("q"))
        .collect()
    )
    rows.sort(key=lambda r: r.j)
    n = rows[0].n if rows else 0
    return n, d, [int(r.s) for r in rows], [int(r.q) for r in rows]


def _product(centred: DataFrame, d: int, block: np.ndarray) -> np.ndarray:
    """Xc^T (Xc @ block) / n over the distributed fit list (d x k)."""
    k = block.shape[1]
    held = np.ascontiguousarray(block, dtype=np.float64)

    def part(batches):
        total = np.zeros((d, k))
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            if len(flat):
                xc = flat.reshape(-1, d)
                total += xc.T @ (xc @ held)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], type=pa.list_(pa.float64()))], names=["m"])

    rows = (
        centred.select("c").mapInArrow(part, "m array<double>")
        .select(F.posexplode("m").alias("i", "v"))
        .groupBy("i").agg(F.sum("v").alias("v"))
        .collect()
    )
    out = np.zeros(d * k)
    for r in rows:
        out[r.i] = r.v
    return out.reshape(d, k)


def _degree(theta: np.ndarray, want: int, cut: float) -> int:
    """Degree that lifts the last wanted Ritz value about 1e4 over the damped
    interval, without letting the first outgrow it by more than 1e10."""
    t = lambda lam: 2.0 * lam / cut - 1.0
    low, high = DEGREES
    a_k = math.acosh(max(t(theta[want - 1]), 1.0 + 1e-12))
    a_1 = math.acosh(max(t(theta[0]), 1.0 + 1e-12))
    m = math.ceil(math.log(2e4) / a_k)
    if a_1 > a_k:
        m = min(m, max(low, int(math.log(1e10) / (a_1 - a_k))))
    return max(low, min(high, m))


def leading_pairs(centred: DataFrame, n: int, d: int, want: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, int]:
    """Eigenvalues (falling) and unit eigenvectors (d x want) of V, and the
    number of distributed passes used."""
    width = min(d, want + GUARD)
    rng = np.random.default_rng(SEED)
    y, _ = np.linalg.qr(rng.standard_normal((d, width)))
    passes, best, stalled = 0, math.inf, 0
    scale = lambda b: _product(centred, d, b) / n
    vy = scale(y)
    passes += 1
    while True:
        # Rayleigh-Ritz on the current block
        theta, w = np.linalg.eigh(y.T @ vy)
        order = np.argsort(theta)[::-1]
        theta, w = theta[order], w[:, order]
        y, vy = y @ w, vy @ w
        if theta[0] <= 0:
            return theta[:0], y[:, :0], passes
        residual = np.linalg.norm(vy[:, :want] - y[:, :want] * theta[:want], axis=0).max()
        if residual <= TOLERANCE * theta[0] or width == d:
            break  # certified, or the block spans the whole space
        stalled = stalled + 1 if residual >= best else 0
        best = min(best, residual)
        if stalled >= STALL:
            break
        # the damped interval reaches the smallest Ritz value of the block
        cut = theta[-1] if theta[-1] > 0 else theta[want - 1] * 1e-3
        # Chebyshev recurrence over [0, cut]: T1 = (2V/cut - I) y, T_{j+1} = 2 (2V/cut - I) T_j - T_{j-1}
        m = _degree(theta, want, cut)
        prev, now = y, 2.0 * vy / cut - y
        for _ in range(m - 1):
            top = max(np.abs(now).max(), 1e-300)
            prev, now = prev / top, now / top
            v_now = scale(now)
            passes += 1
            prev, now = now, 2.0 * (2.0 * v_now / cut - now) - prev
        y, _ = np.linalg.qr(now)
        vy = scale(y)
        passes += 1
    keep = theta[:want] > 0
    vectors = y[:, :want][:, keep]
    # one sign for all rows: the entry of largest magnitude is positive
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return theta[:want][keep], vectors * signs, passes


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: vec_id, component, n,
    deviation (sum of (n*x - S)^2, exact), whitened, explained and
    identity_error (largest entry of |cov(whitened) - I|, one value)."""
    spark = vectors.sparkSession
    fit = materialize(fit_list(vectors), "whiten-fit")
    n, d, sums, squares = _sums(fit)
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if n == 0:
        return spark.createDataFrame([], schema)
    fit = fit.where(F.size("x") == d)
    s_arr = F.array(*[F.lit(s).cast("long") for s in sums])
    # centred entries (n*x - S) / n, exact before the one rounding to double
    centred = F.transform("x", lambda v, j: (F.lit(n) * v - F.element_at(s_arr, j + 1)).cast("double") / F.lit(float(n)))
    table = materialize(fit.select("vec_id", "x", centred.alias("c")), "whiten-centred")
    trace = sum(n * q - s * s for s, q in zip(sums, squares)) / n**2
    if trace <= 0:
        return spark.createDataFrame([], schema)
    values, vecs, _ = leading_pairs(table, n, d, min(components, d))
    k = len(values)
    if k == 0:
        return spark.createDataFrame([], schema)
    scaled = vecs / np.sqrt(values)
    # covariance of the whitened values, from one more pass over the data
    mean = _column_means(table, d)
    centred_mean = mean @ scaled
    cov = scaled.T @ (_product(table, d, scaled) / n) - np.outer(centred_mean, centred_mean)
    identity_error = float(np.abs(cov - np.eye(k)).max())
    dev = F.aggregate(
        F.transform("x", lambda v, j: F.pow(F.lit(n).cast("decimal(38,0)") * v - F.element_at(s_arr, j + 1), 2)
                    .cast("decimal(38,0)")),
        F.lit(0).cast("decimal(38,0)"), lambda a, b: (a + b).cast("decimal(38,0)"),
    ).cast("long")
    parts = []
    for c in range(k):
        q = F.array(*[F.lit(float(v)) for v in scaled[:, c]])
        proj = F.aggregate(F.zip_with("c", q, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
        parts.append(F.struct(F.lit(c + 1).alias("component"), proj.alias("whitened"), F.lit(float(values[c] / trace)).alias("explained")))
    return table.select("vec_id", dev.alias("deviation"), F.explode(F.array(*parts)).alias("p")).select(
        "vec_id", F.col("p.component").cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.col("p.whitened").alias("whitened"), F.col("p.explained").alias("explained"),
        F.lit(identity_error).alias("identity_error"),
    )


def _column_means(table: DataFrame, d: int) -> np.ndarray:
    rows = table.select(F.posexplode("c").alias("j", "v")).groupBy("j").agg(F.avg("v").alias("m")).collect()
    out = np.zeros(d)
    for r in rows:
        out[r.j] = r.m
    return out
