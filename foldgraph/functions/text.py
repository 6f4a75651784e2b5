"""Normalising and judging the text of a molecule record."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from foldgraph.functions.arrays import let
from foldgraph.functions.pairing import _row_views
from foldgraph.spec import MAX_LENGTH

# The characters that count as blank at either end of a cell.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
INTEGER = "^[+-]?[0-9]+(_[0-9]+)*$"


def strip(cell: Column) -> Column:
    return F.btrim(cell, F.lit(BLANKS))


def normalize_sequence(cell: Column) -> Column:
    return F.replace(F.upper(strip(cell)), F.lit("T"), F.lit("U"))


def base_pieces(text: Column | str, piece: int) -> Column:
    """The ASCII letters of a text as bases, in pieces of ``piece``, the last one shorter; null has none.

    The letters of the alphabet stand for A, C, G and U in turn, in either case.
    """
    base = np.zeros(256, np.uint8)
    for first in "aA":
        base[ord(first) : ord(first) + 26] = np.frombuffer(b"ACGU" * 6 + b"AC", np.uint8)

    def cut(texts: pa.Array) -> pa.Array:
        offsets, chars = _row_views(texts)
        bases = base[chars]
        at = np.concatenate([[0], np.cumsum(bases != 0, dtype=np.int32)])[offsets]
        pieces = -(-np.diff(at) // piece)
        held = np.concatenate([[0], np.cumsum(pieces)])
        starts = np.repeat(at[:-1], pieces) + piece * (np.arange(held[-1]) - np.repeat(held[:-1], pieces))
        starts = np.append(starts, at[-1]).astype(np.int32)
        bits = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(bases[bases != 0]))
        return pa.ListArray.from_arrays(pa.array(held.astype(np.int32)), bits)

    return F.arrow_udf(cut, T.ArrayType(T.StringType()))(text)


def parse_position_list(cell: Column, dtype: T.DataType, name: str) -> Column:
    """Cell -> struct(values array<long>, error string).

    Accepts one integer, a whole-valued float, or a comma list in text; an
    empty cell lists nothing. Values past 64 bits saturate: they are outside
    any molecule either way.
    """

    def result(values=None, error=None):
        return F.struct(
            (F.array() if values is None else values).cast("array<long>").alias("values"),
            (F.lit(None) if error is None else error).cast("string").alias("error"),
        )

    not_whole = result(error=F.lit(f"{name} must be an integer or a list of integers"))
    if isinstance(dtype, T.IntegralType):
        return F.when(cell.isNull(), result()).otherwise(result(F.array(cell)))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        whole = (cell == F.floor(cell)) & (F.abs(cell) < F.lit(2.0**63))
        return F.when(cell.isNull(), result()).when(whole, result(F.array(cell))).otherwise(not_whole)
    if isinstance(dtype, T.NullType):
        return result()
    if not isinstance(dtype, T.StringType):
        return F.when(cell.isNull(), result()).otherwise(not_whole)

    def number(item):
        edge = F.when(item.startswith("-"), F.lit(-(2**63))).otherwise(F.lit(2**63 - 1))
        return F.coalesce(F.regexp_replace(item, "[_+]", "").try_cast("long"), edge)

    def judged(items):
        bad = F.filter(items, lambda x: ~x.rlike(INTEGER))
        return (
            F.when(F.exists(items, lambda x: x == ""), result(error=F.lit(f"empty item in the {name} list")))
            .when(F.size(bad) > 0, result(error=F.concat(F.lit("not an integer in "), F.lit(f"{name}: "), F.get(bad, F.lit(0)))))
            .otherwise(result(F.transform(items, number)))
        )

    text = strip(cell)
    items = F.transform(F.split(text, ",", -1), strip)
    return F.when(cell.isNull() | (text == ""), result()).otherwise(let(items, judged))


def window_identifier(identifier: Column, start: Column, end: Column) -> Column:
    return F.concat(identifier, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def strange_characters(text: Column, allowed: str) -> Column:
    left = F.regexp_replace(text, allowed, "")
    return F.array_join(F.array_sort(F.array_distinct(F.split(left, ""))), " ")


def molecule_fault(sequence: Column, structure: Column, brackets: Column, maximum: int = MAX_LENGTH) -> Column:
    """First broken rule of a normalised molecule as struct(rule, message), else null.

    ``brackets`` is the result of :func:`foldgraph.functions.pairing.unmatched_brackets`.
    """

    def fault(rule, *message):
        parts = [m if isinstance(m, Column) else F.lit(m) for m in message]
        return F.struct(F.lit(rule).alias("rule"), F.concat(*[p.cast("string") for p in parts]).alias("message"))

    n, m = F.length(sequence), F.length(structure)
    close, open_ = brackets["unmatched_close"], brackets["unmatched_open"]
    return (
        F.when(n == 0, fault("empty_sequence", "the sequence is empty"))
        .when(n > maximum, fault("too_long", n, f" nt is more than {maximum}"))
        .when(n != m, fault("length_mismatch", "structure has ", m, " characters, sequence has ", n))
        .when(sequence.rlike("[^ACGU]"), fault("sequence_alphabet", "unknown bases: ", strange_characters(sequence, "[ACGU]+")))
        .when(structure.rlike("[^.()]"), fault("structure_alphabet", "unknown symbols: ", strange_characters(structure, "[.()]+")))
        .when(close >= 0, fault("unmatched_close", "')' without partner at position ", close))
        .when(open_ >= 0, fault("unmatched_open", "'(' without partner at position ", open_))
    )


def identifier_fault(identifier: Column) -> Column:
    def fault(rule, message):
        return F.struct(F.lit(rule).alias("rule"), F.lit(message).alias("message"))

    return F.when(identifier == "", fault("empty_identifier", "the identifier is empty")).when(
        identifier.rlike("[\t\r\n]"), fault("identifier_break", "the identifier holds a tab or line break")
    )


def window_fault(start: Column, end: Column, length: Column) -> Column:
    """Bounds are given together and satisfy 0 <= start < end <= length."""

    def fault(rule, *message):
        parts = [m if isinstance(m, Column) else F.lit(m) for m in message]
        return F.struct(F.lit(rule).alias("rule"), F.concat(*[p.cast("string") for p in parts]).alias("message"))

    return F.when(
        start.isNull() != end.isNull(), fault("half_window", "start and end must be given together")
    ).when(
        (start < 0) | (end > length) | (start >= end),
        fault("window_bounds", "window [", start, ", ", end, ") is not inside ", length, " nt"),
    )
