"""Arithmetic on vectors held in array columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, functions as F, types as T

from foldgraph.functions.arrays import let

# Floors and epsilons of the encoder's arithmetic.
NORM_FLOOR = 1e-12
LAYER_NORM_EPS = 1e-5
BATCH_NORM_EPS = 1e-5


def fold(array: Column, term: Callable[[Column], Column]) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda total, x: total + term(x))


def l2_normalize(vector: Column) -> Column:
    """Vector / max(norm, floor) in double precision."""
    wide = vector.cast("array<double>")
    norm = F.greatest(F.sqrt(fold(wide, lambda x: x * x)), F.lit(NORM_FLOOR))
    return let(norm, lambda n: F.transform(wide, lambda x: x / n))


def relu(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.greatest(x, F.lit(0.0)))


def add(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda x, y: x + y)


def scale(vector: Column, by: Column) -> Column:
    return F.transform(vector, lambda x: x * by)


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in np.ravel(values)])


def elements(vector: Column, size: int) -> list[Column]:
    """The elements of a vector of known size."""
    return [F.get(vector, F.lit(i)) for i in range(size)]


def linear(vector: Column, weight: np.ndarray, bias: np.ndarray) -> Column:
    """weight @ vector + bias with literal weights; meant for small layers.

    Plain arithmetic on the elements, which stays in generated code.
    """

    def row(values, offset):
        total = F.lit(float(offset))
        for i, value in enumerate(values):
            total = total + F.get(vector, F.lit(i)) * F.lit(float(value))
        return total

    return F.array(*[row(values, offset) for values, offset in zip(weight, np.ravel(bias))])


def row_sums(x: np.ndarray) -> np.ndarray:
    """Sums of rows, added up from the left as the columns above do."""
    total = np.zeros(len(x))
    for column in x.T:
        total = total + column
    return total


def affine(x: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """:func:`linear` of every row of ``x``, to the last bit."""
    out = np.empty((len(x), len(weight)))
    for j, (values, offset) in enumerate(zip(weight.astype(np.float64), np.ravel(bias).astype(np.float64))):
        total = np.full(len(x), offset)
        for column, value in zip(x.T, values):
            total = total + column * value
        out[:, j] = total
    return out


def rectified(x: np.ndarray) -> np.ndarray:
    return np.where(x < 0, 0.0, x)


def _matrix(vectors: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``size`` numbers of every list as rows, and which rows lack one of them."""
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    if not flat.null_count and (lengths == size).all():
        return values.reshape(-1, size), np.zeros(len(lengths), dtype=bool)
    absent = flat.is_null().to_numpy(zero_copy_only=False)
    start = np.cumsum(lengths) - lengths
    rows, lacking = np.zeros((len(lengths), size)), np.zeros(len(lengths), dtype=bool)
    for i in range(size):
        there = np.flatnonzero(lengths > i)
        rows[there, i] = values[start[there] + i]
        lacking[lengths <= i] = True
        lacking[there] |= absent[start[there] + i]
    return rows, lacking


def _vectors(rows: np.ndarray, lacking: np.ndarray) -> pa.ListArray:
    """Rows as lists; those of ``lacking`` hold nulls."""
    mask = np.repeat(lacking, rows.shape[1]) if lacking.any() else None
    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(rows).ravel(), mask=mask))


def linear_each(vectors: Column, weight: np.ndarray, bias: np.ndarray) -> Column:
    """:func:`linear` of every vector of an array of vectors, in double precision."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            rows, lacking = _matrix(lists.flatten(), weight.shape[1])
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.ListArray.from_arrays(offsets, _vectors(affine(rows, weight, bias), lacking), mask=lists.is_null() if lists.null_count else None)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, T.ArrayType(T.ArrayType(T.DoubleType())))(vectors)


def dense(make: Callable[..., np.ndarray], *names: str) -> Column:
    """``make`` of the matrices whose rows are the vectors of some columns, all of one size in a column, in double precision."""

    def run(*columns: pa.Array) -> pa.Array:
        sizes = [int(c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).max(initial=1)) for c in columns]
        parts = [_matrix(c, size) for c, size in zip(columns, sizes)]
        return _vectors(make(*[rows for rows, _ in parts]), np.logical_or.reduce([lacking for _, lacking in parts]))

    run.__annotations__ = {"columns": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.ArrayType(T.DoubleType()))(*names)


def layer_norm(vector: Column, gain: np.ndarray, shift: np.ndarray) -> Column:
    size = F.size(vector)

    def scaled(x):
        mean = fold(x, lambda v: v) / size

        def out(m):
            spread = fold(x, lambda v: (v - m) * (v - m)) / size
            unit = let(F.sqrt(spread + LAYER_NORM_EPS), lambda sd: F.transform(x, lambda v: (v - m) / sd))
            return F.zip_with(F.zip_with(unit, literal(gain), lambda v, g: v * g), literal(shift), lambda v, b: v + b)

        return let(mean, out)

    return let(vector, scaled)


def batch_norm_eval(vector: Column, gain, shift, mean, variance) -> Column:
    """Batch norm with running statistics, folded into one factor and one offset."""
    gain, shift, mean, variance = (np.ravel(x).astype(np.float64) for x in (gain, shift, mean, variance))
    factor = gain / np.sqrt(variance + BATCH_NORM_EPS)
    offset = shift - mean * factor
    return F.zip_with(F.zip_with(vector, literal(factor), lambda v, f: v * f), literal(offset), lambda v, o: v + o)


def _round_half(x: Column) -> Column:
    """A double rounded to half precision, ties to even: 11 significant bits, steps of 2**-24 below 2**-14, infinite from 65520 on."""
    size = F.abs(x)
    guess = F.floor(F.log2(size))  # one off at most, beside a power of two
    power = F.pow(F.lit(2.0), guess)
    exponent = guess + F.when(2 * power <= size, 1).when(power > size, -1).otherwise(0)
    step = F.pow(F.lit(2.0), F.greatest(exponent, F.lit(-14)) - 10)
    rounded = F.rint(x / step) * step
    infinite = F.lit(float("inf"))
    return F.when(F.isnan(x) | (size == 0) | (size == infinite), x).when(F.abs(rounded) > 65504, F.signum(x) * infinite).otherwise(rounded)


def cast_embedding(vector: Column, dtype: str = "float16") -> Column:
    """Vector at 16, 32 or 64 bit precision.

    Spark has no half type, so 16-bit values are rounded and held as float.
    """
    kinds = {"float16": T.FloatType(), "float32": T.FloatType(), "float64": T.DoubleType()}
    if dtype not in kinds:
        raise ValueError(f"embeddings are float16, float32 or float64, not {dtype}")
    if dtype == "float16":
        return F.transform(vector.cast("array<double>"), _round_half).cast("array<float>")
    return vector.cast(T.ArrayType(kinds[dtype]))
