"""Matching the brackets of a secondary structure.

A structure is at most a few thousand characters and sits in one row, so its
pair table needs no shuffle. Spark SQL has no running state inside a row,
hence one Arrow function; it works on whole batches with NumPy and has no loop
per row. The relational form, windows over exploded characters, is
``bracket_depth`` and ``partner_by_level`` in :mod:`foldgraph.operators.graphs`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

SCAN_TYPE = T.StructType(
    [
        T.StructField("unmatched_close", T.IntegerType()),
        T.StructField("unmatched_open", T.IntegerType()),
        T.StructField("partner", T.ArrayType(T.IntegerType())),
        T.StructField("openers", T.ArrayType(T.IntegerType())),
    ]
)


def _row_views(texts: pa.Array):
    """Characters of all rows as one byte vector, with the row offsets in it."""
    texts = texts.cast(pa.string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(1, np.int32), np.zeros(0, np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    chars = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], chars


#: Characters that are scanned together; a number of each takes eight bytes in several arrays.
CHARACTERS_AT_ONCE = 200_000


def _scan(texts: pa.Array) -> pa.Array:
    return _in_parts(texts, True)


def _unmatched(texts: pa.Array) -> pa.Array:
    return _in_parts(texts, False)


def _in_parts(texts: pa.Array, with_pairs: bool) -> pa.Array:
    texts = texts.cast(pa.string())
    part = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64) // CHARACTERS_AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    return pa.concat_arrays([_scanned(texts.slice(a, b - a), with_pairs) for a, b in zip(cuts, cuts[1:])])


def _scanned(texts: pa.Array, with_pairs: bool) -> pa.Array:
    offsets, chars = _row_views(texts)
    rows = len(offsets) - 1
    lengths = np.diff(offsets)
    opens, closes = chars == ord("("), chars == ord(")")
    running = np.cumsum(opens.astype(np.int32) - closes.astype(np.int32), dtype=np.int64)
    before = np.concatenate(([0], running))[offsets]
    depth = running - np.repeat(before[:-1], lengths)
    final = before[1:] - before[:-1]
    lowest = np.zeros(rows, dtype=np.int64)
    filled = np.flatnonzero(lengths)
    if len(filled):
        lowest[filled] = np.minimum.reduceat(depth, offsets[filled])
    good = (lowest >= 0) & (final == 0)

    close_at, open_at = np.full(rows, -1, np.int32), np.full(rows, -1, np.int32)
    for row in np.flatnonzero(~good):
        part = slice(offsets[row], offsets[row + 1])
        if lowest[row] < 0:
            close_at[row] = np.argmax(depth[part] < 0)
        else:
            settled = np.flatnonzero(depth[part] == 0)
            after = settled[-1] + 1 if len(settled) else 0
            open_at[row] = after + np.argmax(opens[part][after:])

    if not with_pairs:
        return pa.StructArray.from_arrays([pa.array(close_at), pa.array(open_at)], names=[f.name for f in SCAN_TYPE.fields[:2]])
    # Brackets of one level alternate open, close along the row, and each row
    # holds as many of either, so a stable sort by level puts partners side by side.
    usable = np.repeat(good, lengths)
    at = np.flatnonzero((opens | closes) & usable)
    level = (depth + closes)[at]
    at = at[np.argsort(level.astype(np.uint16) if level.size and level.max() < 65536 else level, kind="stable")]
    partner = np.full(len(chars), -1, dtype=np.int32)
    row_start = np.repeat(offsets[:-1], lengths)
    left, right = at[0::2], at[1::2]
    partner[left] = right - row_start[left]
    partner[right] = left - row_start[right]
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(partner))
    first = np.flatnonzero(opens & usable)
    pairs = np.searchsorted(first, offsets).astype(np.int32)
    openers = pa.ListArray.from_arrays(pa.array(pairs), pa.array((first - row_start[first]).astype(np.int32)))
    return pa.StructArray.from_arrays(
        [pa.array(close_at), pa.array(open_at), lists, openers], names=[f.name for f in SCAN_TYPE]
    )


def scan_brackets(structure: Column | str) -> Column:
    """struct(unmatched_close, unmatched_open, partner, openers) of a structure.

    The positions are -1 where there is nothing to report: the first ')' with
    no open bracket, or, failing that, the earliest '(' never closed.
    ``partner`` holds the position of each bracket's partner, -1 elsewhere;
    ``openers`` lists the positions of '('. Of an unbalanced structure the
    table is all -1 and the list empty.
    """
    return F.arrow_udf(_scan, SCAN_TYPE)(structure)


def unmatched_brackets(structure: Column | str) -> Column:
    """struct(unmatched_close, unmatched_open) as of :func:`scan_brackets`, without the pairs."""
    return F.arrow_udf(_unmatched, T.StructType(SCAN_TYPE.fields[:2]))(structure)


def pair_table(structure: Column | str) -> Column:
    return scan_brackets(structure)["partner"]
