"""Whitening of embeddings by their leading principal components, found without ever forming the covariance.

Entries become whole numbers floor(SCALE * c); each distinct vector of them counts once (the fit list, n vectors). One pass sums
the fit list exactly. Then block Lanczos: each round is one distributed pass that multiplies the centred vectors' X'X with a block
of BLOCK directions, never with more than these few columns in a task; new directions are orthogonalised twice against all
earlier ones. Where a block loses rank (an invariant subspace, equal eigenvalues), random directions orthogonal to all others take
the place of the lost ones, so multiple eigenvalues are all found. It ends when the residuals |Vy - ey| of the wanted components
are below TOLERANCE of the largest eigenvalue, or the directions span the whole space; the driver holds dimension x dimension
numbers at most, whatever the number of rows. The trace comes from the summed squared deviations of the same passes.

Nulls and edges: rows whose vector is null, is empty, holds null or non-finite entries or entries of 2**51 or more, or has
another length than most have (ties: the shorter) take no part. Null and repeated ids and repeated vectors are rows like others in
the result. Components whose eigenvalue is no more than rounding (fewer distinct vectors than components, equal vectors) can't be
scaled to variance one and are left out; so a table with one distinct vector, or none, gives no rows. Equal eigenvalues leave the
choice of axes within their space to a fixed seed. Columns other than id and vector aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_batches, released, table, written

SCALE, COMPONENTS, BLOCK, TOLERANCE = 256, 4, 16, 1e-14
LARGEST = 2.0**51
WHOLE = "id {}, x binary"


def whole_numbers(embedding: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(places, vectors) of the usable rows of a list column: int64 vectors, whatever their lengths."""
    if isinstance(embedding, pa.ChunkedArray):
        embedding = embedding.combine_chunks()
    sizes = np.asarray(embedding.value_lengths().fill_null(0))
    values = embedding.flatten()
    values = values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes nan
    first = np.concatenate(([0], np.cumsum(sizes)))
    with np.errstate(invalid="ignore", over="ignore"):
        fine = np.isfinite(values) & (np.abs(values) < LARGEST)
    bad = np.concatenate(([0], np.cumsum(~fine)))
    places = np.flatnonzero((sizes > 0) & (bad[first[1:]] == bad[first[:-1]]))
    x = np.floor(SCALE * np.where(fine, values, 0.0)).astype("<i8")
    return places, [x[first[i] : first[i + 1]] for i in places]


def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        places, vectors = whole_numbers(b.column(1))
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(places)), pa.array([v.tobytes() for v in vectors], pa.binary())], ["id", "x"])


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a binary column that all have dim entries."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, dim)


def exact_sums(dim: int):
    """Per task: for each dimension the sum of the high and of the low 32 bits of all entries, and the largest absolute entry."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, top = np.zeros(dim, np.int64), np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0), dim)
                high += (x >> 32).sum(axis=0)
                low += (x & 0xFFFFFFFF).sum(axis=0)
                top = np.maximum(top, np.abs(x).max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(high), pa.array(low), pa.array(top)], ["i", "high", "low", "top"])

    return task


@dataclass
class Whitening:
    """Fitted: n, sums (exact), values and vectors (columns) of the components, trace, directions spanned, residuals, and how many directions were restarted."""

    dim: int
    n: int
    sums: list[int]
    largest: int
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    spanned: int
    residuals: np.ndarray
    restarts: int = 0
    identity_error: float = 0.0
    small: bool = field(init=False)

    def __post_init__(self) -> None:
        # n*x - S and the sum of its squares stay within 64 bits
        self.small = self.dim * (self.n * self.largest + max(map(abs, self.sums), default=0)) ** 2 < 1 << 63

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, exact."""
        if self.small:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(np.float64)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


def summed(fit: DataFrame, task, width: int) -> np.ndarray:
    """The sum over all tasks of the `width` doubles that each gives."""
    rows = fit.select("x").mapInArrow(task, "i int, value double").groupBy("i").agg(F.sum("value").alias("value")).collect()  # width rows
    out = np.zeros(width)
    for r in rows:
        out[r["i"]] = r["value"]
    return out


def values_of(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["i", "value"])


def multiply(share):
    """Per task: (X'X)B of the centred vectors for a block B, and last the sum of squared deviations."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, block = share.value
        total, squares = np.zeros(block.shape), 0.0
        for b in batches:
            if b.num_rows:
                c = model.centred(matrix(b.column(0), model.dim))
                total += c.T @ (c @ block)
                squares += float(np.einsum("ij,ij->", c, c))
        yield values_of(np.append(total.ravel(), squares))

    return task


def second_moments(share):
    """Per task: sums and products of the whitened vectors."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = share.value
        k = len(model.values)
        total, squares = np.zeros(k), np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                w = model.whiten(matrix(b.column(0), model.dim))
                total += w.sum(axis=0)
                squares += w.T @ w
        yield values_of(np.append(total, squares.ravel()))

    return task


def new_directions(block: np.ndarray, basis: np.ndarray, scale: float, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Orthonormal columns for block, orthogonal to basis; columns that are lost to it are replaced by random ones. Also how many."""
    dim, room, restarts = len(block), basis.shape[1], 0
    out = np.zeros((dim, 0))
    for j in range(min(block.shape[1], dim - room)):
        v, size = block[:, j], scale
        while True:
            known = np.hstack([basis, out])
            for _ in range(2):
                v = v - known @ (known.T @ v)
            norm = np.linalg.norm(v)
            if norm > 1e-12 * size:
                break
            v, size = rng.normal(size=dim), 1.0
            restarts += 1
        v = v / norm
        v = v - known @ (known.T @ v)  # what rounding left
        out = np.hstack([out, (v / np.linalg.norm(v))[:, None]])
    return out, restarts


def fit_whitening(fit: DataFrame, dim: int, components: int = COMPONENTS, block: int = BLOCK, tolerance: float = TOLERANCE, seed: int = 7) -> Whitening:
    """Lanczos over fit (x: distinct vectors of dim whole numbers), which is read once a round."""
    context = fit.sparkSession.sparkContext
    n = fit.count()
    rows = fit.select("x").mapInArrow(exact_sums(dim), "i int, high long, low long, top long").groupBy("i")
    # a row a dimension; decimals, for sums of longs of many tasks may pass 64 bits
    wide = "decimal(38,0)"
    rows = rows.agg(F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low"), F.max("top").alias("top")).collect()
    sums, largest = [0] * dim, 0
    for r in rows:
        sums[r["i"]] = (int(r["high"]) << 32) + int(r["low"])
        largest = max(largest, r["top"])
    model = Whitening(dim, n, sums, largest, np.zeros(0), np.zeros((dim, 0)), 0.0, 0, np.zeros(0))
    rng = np.random.default_rng(seed)
    basis, image = np.zeros((dim, 0)), np.zeros((dim, 0))
    at, restarts = new_directions(rng.normal(size=(dim, max(block, components))), basis, 1.0, rng)
    while True:
        share = context.broadcast((model, at))
        got = summed(fit, multiply(share), at.size + 1) / n
        released(share)
        model.trace = float(got[-1])
        basis, image = np.hstack([basis, at]), np.hstack([image, got[:-1].reshape(at.shape)])
        small = basis.T @ image
        values, inner = np.linalg.eigh((small + small.T) / 2)
        values, inner = values[::-1][:components], inner[:, ::-1][:, :components]
        vectors = basis @ inner
        residuals = np.linalg.norm(image @ inner - vectors * values, axis=0)
        top = max(float(values[0]), 0.0)
        if basis.shape[1] == dim or (residuals <= tolerance * top).all():
            break
        at, lost = new_directions(got[:-1].reshape(at.shape), basis, max(top, 1e-300), rng)
        restarts += lost
    keep = values > max(top, 0.0) * dim * 4 * np.finfo(float).eps
    vectors = vectors[:, keep] / np.linalg.norm(vectors[:, keep], axis=0)
    model.values, model.vectors, model.residuals, model.spanned, model.restarts = values[keep], vectors, residuals, basis.shape[1], restarts
    if len(model.values):
        share, k = context.broadcast(model), len(model.values)
        got = summed(fit, second_moments(share), k + k * k) / n
        released(share)
        mean = got[:k]
        model.identity_error = float(np.abs(got[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())
    return model


def apply(share):
    """A row a vector and component."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = share.value
        k = len(m.values)
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(1), m.dim)
            d = m.deviations(x)
            whitened = ((d / m.n).astype(np.float64) @ m.vectors / np.sqrt(m.values)).ravel()
            deviation = pa.array((d * d).sum(axis=1) if m.small else [int(v) for v in (d * d).sum(axis=1)], pa.int64() if m.small else pa.decimal128(38)).cast(pa.decimal128(38))
            each = np.repeat(np.arange(b.num_rows), k)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)), deviation.take(pa.array(each)), pa.array(whitened)],
                ["id", "component", "deviation", "whitened"],
            )

    return task


def whitened(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """(id, component, deviation decimal, whitened) for each usable row, and the fitted model (None without usable rows)."""
    spark = vectors.sparkSession
    byte_batches(spark)
    kind = vectors.schema[id].dataType.simpleString()
    rows = written(vectors.select(F.col(id).alias("id"), F.col(embedding).alias("x")).mapInArrow(scaled, WHOLE.format(kind)), "whole-vectors")
    sizes = rows.groupBy(F.octet_length("x").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    schema = f"id {kind}, component int, deviation decimal(38,0), whitened double"
    if not sizes:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id), None
    rows, dim = rows.where(F.octet_length("x") == sizes[0]["size"]), sizes[0]["size"] // 8
    # distinct by partial aggregation, so equal vectors meet before the exchange
    fit = written(rows.select("x").distinct(), "fit-list")
    model = fit_whitening(fit, dim, components)
    if not len(model.values):
        return spark.createDataFrame([], schema).withColumnRenamed("id", id), model
    share = spark.sparkContext.broadcast(model)
    return rows.mapInArrow(apply(share), schema).withColumnRenamed("id", id), model


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings projected on the four leading components with variance one; a deviation beyond 64 bits is an error."""
    out, model = whitened(table(spark, sf_dir, "embeddings"))
    m = model or Whitening(0, 0, [], 0, np.zeros(0), np.zeros((0, 0)), 0.0, 0, np.zeros(0))
    explained = F.element_at(F.array(*[F.lit(float(e / m.trace)) for e in m.values]), F.col("component")) if len(m.values) else F.lit(None).cast("double")
    return out.select(
        "vec_id", "component", F.lit(m.n).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"), "whitened", explained.alias("explained"), F.lit(m.identity_error).alias("identity_error")
    )
