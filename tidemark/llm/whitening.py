"""Whitening of embeddings: exact integer covariance from bit planes.

Entries become integers x = floor(scale * c). Every distinct vector counts once. In each dimension x minus its smallest value has few bits; the rows of a
block are packed, one bit plane per dimension and bit, into 64-bit words, and the number of common ones of two planes,
weighted by both bits, adds up to the cross-products of two dimensions. These counts are summed per (pair of dimensions, sum of both
bits), so nothing overflows whatever the number of rows, and only (dimensions^2 * bits) counters reach the driver. There they become
cross-products, exact integers, and are centred as integers before one division gives the covariance to ``eigh``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import fsum

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import saved

SCALE = 256
#: Rows of a block of bit planes, a multiple of 64; a task holds one block at a time.
BLOCK_ROWS = 8192
_LONG = 2**63


def _vectors(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """The vectors of a batch, which are equally long, as a matrix."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _integers(embeddings: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, x): the usable vectors as integers. A product beyond a long takes the nearest long."""
    v = f"`{vector_col}`"
    usable = f"size({v}) > 0 AND forall({v}, c -> c IS NOT NULL AND NOT isnan(c) AND abs(cast(c AS double)) < double('infinity'))"
    whole = f"transform({v}, c -> cast(floor({float(scale)!r}D * cast(c AS double)) AS bigint))"
    return embeddings.where(usable).select(F.col(f"`{id_col}`").alias("id"), F.expr(whole).alias("x"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    low = high = None
    for batch in batches:
        if batch.num_rows:
            x = _vectors(batch, "x")
            here = x.min(axis=0), x.max(axis=0)
            low, high = here if low is None else (np.minimum(low, here[0]), np.maximum(high, here[1]))
    if low is not None:
        yield pa.RecordBatch.from_pydict({"d": np.arange(len(low), dtype=np.int32), "low": low, "high": high})


@dataclass(frozen=True)
class Planes:
    """How entries are cut into bit planes: the smallest entry and the number of bits of each dimension."""

    low: tuple[int, ...]
    bits: tuple[int, ...]
    #: Dimension and bit of each plane, plane by plane.
    dimension: np.ndarray = field(init=False, repr=False, compare=False)
    bit: np.ndarray = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "dimension", np.repeat(np.arange(len(self.bits)), self.bits))
        object.__setattr__(self, "bit", np.concatenate([np.arange(b) for b in self.bits] or [np.arange(0)]).astype(np.int64))

    def pack(self, x: np.ndarray) -> np.ndarray:
        """Bit planes of a block, one row of words per plane."""
        # The difference of two longs fits 64 bits without a sign, also where the subtraction wraps.
        shifted = x.astype(np.int64).view(np.uint64) - np.array(self.low, np.int64).view(np.uint64)
        ones = (shifted[:, self.dimension] >> self.bit.astype(np.uint64)) & np.uint64(1)
        packed = np.packbits(ones.astype(np.uint8), axis=0)
        words = np.zeros((-(-packed.shape[0] // 8) * 8, packed.shape[1]), np.uint8)
        words[: len(packed)] = packed
        return np.ascontiguousarray(words.T).view(np.uint64)


class Counters:
    """Counters of a task: ``ones[i, j, shift]`` common ones weigh 2^shift in the product of dimensions i <= j, ``single[plane]`` ones are in a plane."""

    def __init__(self, planes: Planes):
        self.planes, self.rows = planes, 0
        d = len(planes.bits)
        self.ones = np.zeros((d, d, max(1, 2 * max(planes.bits) - 1)), np.int64)
        self.single = np.zeros(len(planes.bit), np.int64)

    def add(self, x: np.ndarray) -> None:
        self.rows += len(x)
        words = self.planes.pack(x)
        used = np.flatnonzero(words.any(axis=1))
        held, dimension, bit = words[used], self.planes.dimension[used], self.planes.bit[used]
        for k, at in enumerate(used):
            ones = np.bitwise_count(held[k:] & held[k]).sum(axis=1, dtype=np.int64)
            self.single[at] += ones[0]
            # Two different planes of one dimension stand for both orders of the pair.
            ones[1:] <<= dimension[k + 1 :] == dimension[k]
            self.ones[dimension[k], dimension[k:], bit[k] + bit[k:]] += ones

    def rows_out(self) -> pa.RecordBatch:
        """(i, j, shift, ones); j is -1 for the ones of a single plane, i and j are -1 for the number of rows."""
        i, j, shift = np.nonzero(self.ones)
        alone = np.full(len(self.single), -1)
        return pa.RecordBatch.from_pydict(
            {
                "i": np.concatenate([i, self.planes.dimension, [-1]]).astype(np.int32),
                "j": np.concatenate([j, alone, [-1]]).astype(np.int32),
                "shift": np.concatenate([shift, self.planes.bit, [0]]).astype(np.int32),
                "ones": np.concatenate([self.ones[i, j, shift], self.single, [self.rows]]).astype(np.int64),
            }
        )


def _scatter(planes: Planes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = Counters(planes)
        waiting, held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(_vectors(batch, "x"))
            held += batch.num_rows
            while held >= BLOCK_ROWS:
                x = np.concatenate(waiting)
                counters.add(x[:BLOCK_ROWS])
                waiting, held = [x[BLOCK_ROWS:]], held - BLOCK_ROWS
        if held:
            counters.add(np.concatenate(waiting))
        if counters.rows:
            yield counters.rows_out()

    return run


@dataclass(frozen=True)
class Whitening:
    """What was fitted: n distinct vectors, their sums, and per component eigenvalue, unit vector and share of the variance."""

    n: int
    sums: tuple[int, ...]
    values: tuple[float, ...]
    components: tuple[tuple[float, ...], ...]
    explained: tuple[float, ...]

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def covariance(n: int, sums: list[int], products: dict[tuple[int, int], int]) -> np.ndarray:
    """Centred as integers: (n * sum of products - product of sums) / n^2, divided once."""
    d = len(sums)
    out = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            out[i, j] = out[j, i] = (n * products.get((i, j), 0) - sums[i] * sums[j]) / (n * n)
    return out


def exact_sums(low: list[int], counters: list[tuple[int, int, int, int]]) -> tuple[int, list[int], dict[tuple[int, int], int]]:
    """(n, sums, products of dimensions i <= j) of the unshifted entries from the counters of all tasks."""
    n, sums, products = 0, [0] * len(low), {}
    for i, j, shift, ones in counters:
        if i < 0:
            n += ones
        elif j < 0:
            sums[i] += ones << shift
        else:
            products[i, j] = products.get((i, j), 0) + (ones << shift)
    whole = {
        (i, j): products.get((i, j), 0) + low[i] * sums[j] + low[j] * sums[i] + n * low[i] * low[j]
        for i in range(len(low)) for j in range(i, len(low))
    }
    return n, [s + n * a for s, a in zip(sums, low)], whole


def fit(distinct: DataFrame, components: int) -> Whitening | None:
    """Fit on stored distinct vectors (column x, equally long); None without any."""
    found = distinct.mapInArrow(_ranges, "d int, low long, high long").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    ranges = sorted(tuple(r) for r in found.collect())  # one row per dimension
    if not ranges:
        return None
    low = [a for _, a, _ in ranges]
    planes = Planes(tuple(low), tuple((b - a).bit_length() for _, a, b in ranges))
    counters = distinct.mapInArrow(_scatter(planes), "i int, j int, shift int, ones long").groupBy("i", "j", "shift").agg(F.sum("ones"))
    n, sums, products = exact_sums(low, [tuple(r) for r in counters.collect()])  # at most dimensions^2 * 128 rows
    matrix = covariance(n, sums, products)
    values, vectors = np.linalg.eigh(matrix)
    trace = fsum(np.diagonal(matrix))
    order = np.argsort(values)[::-1][:components]
    # What rounding leaves of a direction without variance is no variance.
    noise = len(low) * np.finfo(float).eps * max(trace, 0.0)
    kept = [float(v) if v > noise else 0.0 for v in values[order]]
    return Whitening(
        n, tuple(sums), tuple(kept), tuple(tuple(vectors[:, k].tolist()) for k in order), tuple(v / trace if v else 0.0 for v in kept)
    )


def _whitened(centred: np.ndarray, model: Whitening) -> np.ndarray:
    """Projections of centred rows over the square roots of the eigenvalues; zero in a direction without variance."""
    values = np.array(model.values)
    return np.divide(centred @ np.array(model.components).T, np.sqrt(values), out=np.zeros((len(centred), len(values))), where=values > 0)


def _centred(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray | None]:
    """(x - S/n as doubles, n * x - S as integers or None where they may not fit): subtracted as integers, divided once."""
    reach = max(max(abs(int(x.max())), abs(int(x.min()))) * model.n + max(map(abs, model.sums)), 1) if x.size else 1
    if reach < _LONG:
        apart = model.n * x - np.array(model.sums, np.int64)
        return apart / model.n, apart if reach * reach * x.shape[1] < _LONG else None
    exact = [[(model.n * v - s) / model.n for v, s in zip(row, model.sums)] for row in x.tolist()]
    return np.array(exact).reshape(x.shape), None


def _deviations(x: np.ndarray, model: Whitening, apart: np.ndarray | None) -> list[int | None]:
    """Exact sums of (n * x - S)^2; null where a long can't hold it."""
    if apart is not None:
        return (apart * apart).sum(axis=1).tolist()
    exact = [sum((model.n * v - s) ** 2 for v, s in zip(row, model.sums)) for row in x.tolist()]
    return [v if v < _LONG else None for v in exact]


def _errors(model: Whitening):
    """Sums of the products of whitened values over the fit list, one row per pair of components and task."""
    pairs = [(a, b) for a in range(len(model.values)) for b in range(a, len(model.values))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(model.values),) * 2)
        for batch in batches:
            if batch.num_rows:
                w = _whitened(_centred(_vectors(batch, "x"), model)[0], model)
                total += w.T @ w
        yield pa.RecordBatch.from_pydict(
            {"a": np.array([a for a, _ in pairs], np.int32), "b": np.array([b for _, b in pairs], np.int32), "products": [total[p] for p in pairs]}
        )

    return run


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, over components with variance."""
    found = distinct.mapInArrow(_errors(model), "a int, b int, products double").groupBy("a", "b").agg(F.sum("products").alias("products"))
    entries = [abs(r["products"] / model.n - (r["a"] == r["b"])) for r in found.collect() if model.values[r["a"]] and model.values[r["b"]]]
    return max(entries, default=0.0)


def _rows(model: Whitening, error: float, id_type: pa.DataType):
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    types = [id_type, pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(model.values)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch, "x")
            centred, apart = _centred(x, model)
            rows, deviation = len(x), _deviations(x, model, apart)
            columns = [
                batch.column("id").take(pa.array(np.repeat(np.arange(rows), m))), np.tile(np.arange(1, m + 1), rows), np.full(rows * m, model.n),
                [v for v in deviation for _ in range(m)], _whitened(centred, model).ravel(), np.tile(model.explained, rows), np.full(rows * m, error),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, types)], names)

    return run


def whiten(
    embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, scale: int = SCALE
) -> DataFrame:
    """One row per usable row and component: ``id_col``, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds null or non-finite entries are dropped; so are empty vectors and those that are not as long as most vectors
    (of equally many, the longer ones). Repeated vectors count once in the fit and come back as often as they are; null and repeated ids stay
    as they are. Vectors shorter than ``components`` have as many components as entries. A component without variance has
    whitened and explained 0 and stays out of identity_error. A deviation that a long can't hold is null. Eigenvectors may have either
    sign, the same for all rows. An empty table gives no rows. Other columns are not looked at.
    """
    rows = _integers(embeddings, id_col, vector_col, scale)
    lengths = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    schema = f"id {dict(rows.dtypes)['id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if lengths is None:
        return embeddings.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    rows = rows.where(F.size("x") == lengths["width"])
    # Copies combine ahead of the shuffle, so a vector that most rows hold is one row per task.
    distinct = saved(rows.select("x").distinct(), "distinct-vectors", compression="zstd")
    model = fit(distinct, components)
    error = identity_error(distinct, model)
    id_type = rows.select("id").limit(0).toArrow().schema.field("id").type
    return rows.mapInArrow(_rows(model, error, id_type), schema).withColumnRenamed("id", id_col)
