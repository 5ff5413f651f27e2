"""Whitening of embeddings: principal components by spectral divide and conquer on polar decompositions.

The covariance is gathered over the distinct integer vectors: counts and sums first, then products of the centred vectors, added up by Spark; what
reaches the driver is one matrix, whose size depends on the dimension alone. There, the polar factor of the covariance minus a shift is the
sign of each of its eigenvalues (dynamically weighted Halley steps in QR form); half of it plus the identity projects on the
eigenvectors above the shift, and bases of that space and of its complement split the covariance into two smaller ones, down to single components.
The leading components, scaled to unit variance, are broadcast and applied to all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound.llm.common import drop_shared, map_texts, read, write_shared
from tallyhound.llm.search import usable, whole_numbers

_EPS = np.finfo(float).eps


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix: the same eigenvectors, with the signs of the eigenvalues.

    Halley's iteration with weights that follow a lower bound of the singular values (QDWH), each step by a QR decomposition."""
    n = len(a)
    x = a / np.linalg.norm(a)
    least = max(np.linalg.norm(x, -2) * 0.9, _EPS)
    for _ in range(60):
        d = (4 * (1 - least**2) / least**4) ** (1 / 3) if least < 1 else 0.0
        root = np.sqrt(1 + d)
        p = root + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - least**2) / (least**2 * root)))
        q = (p - 1) ** 2 / 4
        c = p + q - 1
        least = min(1.0, least * (p + q * least**2) / (1 + c * least**2))
        both, _ = np.linalg.qr(np.vstack((np.sqrt(c) * x, np.eye(n))))
        after = (q / c) * x + (p - q / c) / np.sqrt(c) * (both[:n] @ both[n:].T)
        after = (after + after.T) / 2
        moved, x = np.linalg.norm(after - x), after
        if moved < 10 * n * _EPS and least > 1 - 10 * _EPS:
            break
    return x


def split(a: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first columns (so many) span eigenvectors of ``a`` above a shift and whose others span the rest; None if all eigenvalues are equal, to rounding."""
    n = len(a)
    scale = np.linalg.norm(a)
    diagonal = np.sort(np.diag(a))
    mean = diagonal.mean()
    if np.linalg.norm(a - mean * np.eye(n)) <= 4 * n * _EPS * scale:
        return None
    shifts = [float(np.median(diagonal)), float(mean)] + [float(mean + s * np.linalg.norm(a - mean * np.eye(n)) / n) for s in (0.0, 0.31, -0.31, 0.77, -0.77)]
    best, loss = None, np.inf
    for shift in shifts:
        u = polar(a - shift * np.eye(n))
        rank = round((n + float(np.trace(u))) / 2)
        if not 0 < rank < n:
            continue
        projector = (u + np.eye(n)) / 2
        basis, _ = np.linalg.qr(projector @ rng.standard_normal((n, rank)))
        basis, _ = np.linalg.qr(projector @ basis)
        rest, _ = np.linalg.qr(np.hstack((basis, rng.standard_normal((n, n - rank)))))
        rest = rest[:, rank:]
        off = np.linalg.norm(basis.T @ a @ rest)  # what the split would drop
        if off < loss:
            best, loss = (np.hstack((basis, rest)), rank), off
        if off <= 8 * n * _EPS * scale:
            break
    return best


def components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns."""
    rng, n = np.random.default_rng(0), len(a)
    values, vectors = np.zeros(n), np.zeros((n, n))
    todo, at = [np.eye(n)], 0
    while todo:
        basis = todo.pop()
        part = basis.T @ a @ basis
        part = (part + part.T) / 2
        found = split(part, rng) if len(part) > 1 else None
        if found is None:
            k = basis.shape[1]
            vectors[:, at : at + k], at = basis, at + k
        else:
            q, rank = found
            todo += [basis @ q[:, :rank], basis @ q[:, rank:]]
    vectors, _ = np.linalg.qr(vectors)  # rounding of the products
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def rows_of(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, width)


def added(fit: DataFrame, size: int, width: int, part: Callable[[np.ndarray], np.ndarray], kind: str) -> list:
    """The sum of ``part`` (an array of ``size`` numbers) over all vectors: one partial array a task, added up by place."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                own = part(rows_of(b, width))
                total = own if total is None else total + own
        if total is not None:
            values = [Decimal(int(v)) for v in total] if kind.startswith("decimal") else total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(values, pa.decimal128(38, 0) if kind.startswith("decimal") else pa.float64())], names=["place", "value"])

    found = map_texts(fit.select("x"), run, f"place long, value {kind}").groupBy("place").agg(F.sum("value").alias("value")).collect()  # as many as the dimension, or its square
    out = [0] * size
    for r in found:
        out[r.place] = r.value
    return out


def whole_sum(x: np.ndarray) -> np.ndarray:
    return x.sum(0) if float(np.abs(x.astype(float)).max(initial=0)) * len(x) < 2**62 else x.astype(object).sum(0)


def covariance(fit: DataFrame, width: int, mean: np.ndarray, n: int, onto: np.ndarray | None = None) -> np.ndarray:
    """Covariance of the vectors, or of what they are ``onto`` columns; divisor ``n``, centred first."""
    k = width if onto is None else onto.shape[1]

    def part(x: np.ndarray) -> np.ndarray:
        y = x - mean
        y = y if onto is None else y @ onto
        return (y.T @ y).ravel()

    a = np.array(added(fit, k * k, width, part, "double")).reshape(k, k) / n
    return (a + a.T) / 2


def whiten(vectors: DataFrame, most: int | None = None, scale: int = 256) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every usable row of ``vectors`` (``vec_id, embedding``) and each of
    its first ``most`` (all, without) principal components, numbered from 1 by falling variance.

    A component of a row is x = floor(scale * entry). The fit list holds each distinct x vector once: n of them, of sum S. ``deviation`` is the
    sum over dimensions of (n * x - S) ** 2, exactly (null beyond a long); ``whitened`` is x - S / n along the component over its standard deviation;
    ``explained`` its share of the variance; ``identity_error`` the largest entry, without sign, of the fit list's whitened covariance
    minus the identity.

    Null vectors, and those that hold null or non-finite entries, are left out; shorter vectors count as followed by zeros. Each repeated row gets its
    rows; a null id is kept. A component without variance (all of them, where there is one distinct vector) has a null ``whitened``, and
    ``explained`` is null where nothing varies. Other columns are ignored. Where no row is usable there is no result.
    """
    spark, v = vectors.sparkSession, F.col("embedding").cast("array<double>")
    rows = vectors.filter(usable(v)).select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(v, scale).alias("x"))
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))))
    fit = write_shared(rows.select("x").distinct(), "whitening-fit")
    n = fit.count()
    sums = np.array([int(s) for s in added(fit, width, width, whole_sum, "decimal(38,0)")], object)
    mean = (sums / max(n, 1)).astype(float)
    v = covariance(fit, width, mean, max(n, 1))
    values, basis = components(v)
    k, trace = min(width, most or width), float(np.trace(v))
    varied = int((values[:k] > width * _EPS * trace).sum())
    onto = basis[:, :varied] / np.sqrt(values[:varied])
    error = float(np.abs(covariance(fit, width, mean, n, onto) - np.eye(varied)).max()) if varied else 0.0
    drop_shared(fit)
    known = spark.sparkContext.broadcast((onto, mean, sums, [float(e) / trace for e in values[:k]] if trace > 0 else [None] * k))

    def deviations(x: np.ndarray, sums: np.ndarray) -> list[int | None]:
        if n * float(np.abs(x.astype(float)).max(initial=0)) < 2**53:
            d = x * n - sums.astype(np.int64)
            if float((d.astype(float) ** 2).sum(1).max(initial=0)) < 2**62:
                return (d * d).sum(1).tolist()
        d = x.astype(object) * n - sums
        return [s if s < 2**63 else None for s in (d * d).sum(1)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        onto, mean, sums, share = known.value
        for b in batches:
            if b.num_rows and k:
                x, m = rows_of(b, width), b.num_rows
                own = np.full((m, k), np.nan)
                own[:, :varied] = (x - mean) @ onto
                at = np.repeat(np.arange(m), k)
                columns = [b.column("vec_id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n))]
                columns += [pa.array(deviations(x, sums), pa.int64()).take(pa.array(at)), pa.array(own.ravel(), from_pandas=True), pa.array(share * m, pa.float64()), pa.array(np.full(m * k, error))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_texts(rows, run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"), 4)
