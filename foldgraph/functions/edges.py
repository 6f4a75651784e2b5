"""Edges and feature vectors of whole batches of molecules.

The neighbours of a residue are known by arithmetic, so the edges of a batch
are a few NumPy operations over the positions of all its rows. Results are
given out some rows at a time: a molecule has several edges for each residue.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

from foldgraph.functions.pairing import _row_views
from foldgraph.spec import EDGE_CODES, GraphSpec

EDGES_TYPE = T.StructType(
    [
        T.StructField("src", T.ArrayType(T.IntegerType())),
        T.StructField("dst", T.ArrayType(T.IntegerType())),
        T.StructField("types", T.ArrayType(T.ByteType())),
    ]
)
#: Residues whose edges are made together.
RESIDUES_AT_ONCE = 25_000


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and all numbers of a list column; a null list is empty."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([[0], np.cumsum(sizes)]), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _list_array(offsets: np.ndarray, values: pa.Array, null: np.ndarray) -> pa.ListArray:
    mask = pa.array(null) if null.any() else None
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values, mask=mask)


def _nulls(*columns: pa.Array) -> np.ndarray:
    return np.logical_or.reduce([c.is_null().to_numpy(zero_copy_only=False) for c in columns])


def _by_some_rows(make: Callable[..., pa.Array], residues: int) -> Callable:
    """``make`` over batches of columns, of which number ``residues`` tells how many rows to work on together."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            ends = np.cumsum(columns[residues].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            at, done = 0, 0
            while at < len(ends):
                stop = max(at + 1, int(np.searchsorted(ends, done + RESIDUES_AT_ONCE, side="right")))
                yield make(*[c.slice(at, stop - at) for c in columns])
                at, done = stop, int(ends[stop - 1])
            if not len(ends):
                yield make(*columns)

    # Spark tells the kind of a function by these types.
    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return run


def _places(residues: pa.Array, partner: pa.Array):
    """Row starts, rows, residues, indices in the row, where each residue's partner is held, and whether it is."""
    at, r = _lists(residues)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    held, p = _lists(partner)
    known = (r >= 0) & (r < np.diff(held)[row])
    return at, row, r, np.arange(len(r)) - at[row], held, p, known


def _edges(residues: pa.Array, partner: pa.Array, skip2: bool) -> pa.Array:
    at, row, r, k, held, p, known = _places(residues, partner)
    rows = len(at) - 1
    one, two = np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)
    one[:-1] = np.where(row[1:] == row[:-1], r[1:] - r[:-1], 0)
    two[:-2] = np.where(row[2:] == row[:-2], r[2:] - r[:-2], 0)

    chain = np.flatnonzero(one == 1)
    place = np.full(len(p), -1, np.int64)
    place[held[row[known]] + r[known]] = k[known]
    opener = np.flatnonzero(known)
    mate = p[held[row[opener]] + r[opener]]
    opener, mate = opener[mate > r[opener]], mate[mate > r[opener]]
    mate = place[held[row[opener]] + mate]
    opener, mate = opener[mate >= 0], mate[mate >= 0]
    hop = np.flatnonzero((one == 2) | (two == 2)) if skip2 else np.zeros(0, np.int64)

    each = [np.bincount(row[x], minlength=rows) for x in (chain, opener, hop)]
    offsets = np.concatenate([[0], np.cumsum(2 * (each[0] + each[1] + each[2]))])
    src, dst, kinds = (np.empty(offsets[-1], kind) for kind in (np.int32, np.int32, np.int8))

    def put(place, a, b, kind):
        src[place], dst[place], kinds[place] = a, b, EDGE_CODES[kind]

    first = offsets[:-1]
    for from_, to, count, names in ((chain, k[chain] + 1, each[0], ("backbone_forward", "backbone_reverse")), (opener, mate, each[1], ("base_pair_forward", "base_pair_reverse"))):
        of = row[from_]
        place = first[of] + np.arange(len(of)) - (np.cumsum(count) - count)[of]
        put(place, k[from_], to, names[0])
        put(place + count[of], to, k[from_], names[1])
        first = first + 2 * count
    of = row[hop]
    place = first[of] + 2 * (np.arange(len(of)) - (np.cumsum(each[2]) - each[2])[of])
    ahead = k[hop] + np.where(one[hop] == 2, 1, 2)
    put(place, k[hop], ahead, "skip2_forward")
    put(place + 1, ahead, k[hop], "skip2_reverse")
    null = _nulls(residues, partner)
    return pa.StructArray.from_arrays([_list_array(offsets, pa.array(x), null) for x in (src, dst, kinds)], names=[f.name for f in EDGES_TYPE])


def edge_lists(residues: Column, partner: Column, spec: GraphSpec) -> Column:
    """struct(src, dst, types) of the edges between chosen residues, as indices among them.

    Backbone forward by position, backbone reverse, pairs by opener, pairs
    reverse by opener, then skip-2 forward and reverse in turn by position.
    """
    skip2 = spec.skip2
    # Named twice, so that the optimizer leaves the search for residues a column of its own.
    return F.arrow_udf(_by_some_rows(lambda r, p, _: _edges(r, p, skip2), 0), EDGES_TYPE)(residues, partner, residues)


def _entries(places: pa.Array, values: pa.Array) -> pa.Array:
    sizes = places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, held = np.concatenate([[0], np.cumsum(sizes)]), values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place, flat = places.flatten(), values.flatten()
    k = place.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    there = (k >= 0) & (k < held[row])
    found = flat.take(pa.array(np.where(there, (np.cumsum(held) - held)[row] + k, 0), mask=~there))
    return _list_array(at, found, _nulls(places))


def entries_at(places: Column | str, values: Column | str) -> Column:
    """The entries of one array at the places another lists; null where there is none."""
    return F.arrow_udf(_by_some_rows(_entries, 0), T.ArrayType(T.IntegerType()))(places, values)


def _digests(src: pa.Array, dst: pa.Array, types: pa.Array) -> pa.Array:
    null = _nulls(src, dst, types)
    src, dst, types = (x.filter(pa.array(~null)) for x in (src, dst, types))
    at = np.concatenate([[0], np.cumsum(src.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])
    lines = pc.binary_join_element_wise(src.flatten().cast(pa.string()), ">", dst.flatten().cast(pa.string()), ":", types.flatten().cast(pa.string()), "")
    if lines.null_count:
        at, lines = np.concatenate([[0], np.cumsum(lines.is_valid().to_numpy(zero_copy_only=False))])[at], lines.drop_null()
    whole = iter(pc.binary_join(_list_array(at, lines, np.zeros(len(src), bool)), ","))
    return pa.array([None if gone else hashlib.md5(next(whole).as_buffer()).hexdigest() for gone in null.tolist()], pa.string())


def edge_digests(src: Column | str, dst: Column | str, types: Column | str) -> Column:
    """MD5 of a graph's edges as text, ``src>dst:type`` joined by commas; arrays of one row are equally long, and edges with a null are left out."""
    return F.arrow_udf(_by_some_rows(_digests, 0), T.StringType())(src, dst, types)


def _features(sequence: pa.Array, partner: pa.Array, residues: pa.Array, table: np.ndarray, bases: str, sides: bool, positional: bool) -> pa.Array:
    at, row, r, _, held, p, known = _places(residues, partner)
    starts, chars = _row_views(sequence)
    starts = starts.astype(np.int64)
    known &= r < np.diff(starts)[row]
    number = np.full(256, -1, np.int64)
    number[np.frombuffer(bases.encode(), np.uint8)] = np.arange(len(bases))
    base, mate = np.full(len(r), -1, np.int64), np.full(len(r), -1, np.int64)
    base[known] = number[chars[starts[row[known]] + r[known]]]
    mate[known] = p[held[row[known]] + r[known]]
    state = np.where(mate < 0, 0, np.where(mate > r, 1, 2) if sides else 1)
    values = table[state * len(bases) + np.maximum(base, 0)]
    if positional:
        # In single precision throughout, as relative_angle.
        share = (r / np.maximum(np.diff(held)[row] - 1, 1)).astype(np.float32)
        angle = (share * np.float32(math.pi)).astype(np.float64)
        values = np.concatenate([values, np.sin(angle).astype(np.float32)[:, None], np.cos(angle).astype(np.float32)[:, None]], axis=1)
    vectors = _list_array(np.arange(len(values) + 1) * values.shape[1], pa.array(values.ravel()), base < 0)
    return _list_array(at, vectors, _nulls(sequence, partner, residues))


def feature_lists(sequence: Column, partner: Column, residues: Column, table: np.ndarray, bases: str, sides: bool, positional: bool) -> Column:
    """Rows of ``table`` by state (free, opening or paired, closing if ``sides``) and base, and the place on the molecule."""
    table = np.asarray(table, np.float32)
    make = lambda s, p, r, _: _features(s, p, r, table, bases, sides, positional)
    return F.arrow_udf(_by_some_rows(make, 2), T.ArrayType(T.ArrayType(T.FloatType())))(sequence, partner, residues, residues)
