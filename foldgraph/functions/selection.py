"""Which residues of a molecule a window keeps, inside one row.

A molecule is one row, its pair table an array of at most ``MAX_LENGTH``
entries, and the neighbours of a residue are known by arithmetic: one and two
steps along the backbone and the pair partner. So the search for context needs
neither an edge table nor joins, and no row leaves its partition.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from foldgraph.functions.arrays import first_n, let
from foldgraph.spec import CONTEXT, CORE

def window_residues(start: Column, end: Column) -> Column:
    return F.sequence(start, end - 1)


def crossing_partners(partner: Column, start: Column, end: Column) -> Column:
    """Partners outside ``[start, end)`` of the residues inside it."""
    inside = F.slice(partner, start + 1, end - start)
    return F.filter(inside, lambda q: (q >= 0) & ((q < start) | (q >= end)))


def neighbours(position: Column, partner: Column, skip2: bool) -> Column:
    steps = [position - 1, position + 1] + ([position - 2, position + 2] if skip2 else [])
    return F.array(*steps, F.get(partner, position))


def expand_context(partner: Column, start: Column, end: Column, hops: int, skip2: bool) -> Column:
    """Residues outside the window, sorted, that lie within ``hops`` of it.

    The first hop leads to crossing partners only; later hops follow every
    edge kind from there. Window residues are known from the outset, so the
    search never goes on through them.
    """
    first = crossing_partners(partner, start, end)
    if hops == 1:
        return F.array_sort(first)
    length = F.size(partner)

    def grow(state, _):
        near = F.flatten(F.transform(state["edge"], lambda p: neighbours(p, partner, skip2)))
        outside = F.filter(near, lambda q: (q >= 0) & (q < length) & ((q < start) | (q >= end)))
        return let(
            F.array_except(outside, state["all"]),
            lambda new: F.struct(F.concat(state["all"], new).alias("all"), new.alias("edge")),
        )

    grown = let(
        first,
        lambda found: F.aggregate(
            F.sequence(F.lit(2), F.lit(hops)), F.struct(found.alias("all"), found.alias("edge")), grow
        ),
    )
    return F.array_sort(grown["all"])


def selected_residues(
    partner: Column, start: Column, end: Column, length: Column, keep_paired: bool, hops: int, skip2: bool
) -> Column:
    """Sorted residues of a record's graph; all of them without a window."""
    if keep_paired:
        window = let(
            expand_context(partner, start, end, hops, skip2),
            lambda found: F.concat(
                F.filter(found, lambda p: p < start), window_residues(start, end), F.filter(found, lambda p: p >= end)
            ),
        )
    else:
        window = window_residues(start, end)
    return F.when(start.isNull(), first_n(length)).otherwise(window)


def residue_roles(residues: Column, start: Column, end: Column) -> Column:
    """0 for a residue of the window, 1 for kept context."""
    core, context = F.lit(CORE).cast("tinyint"), F.lit(CONTEXT).cast("tinyint")
    return F.when(start.isNull(), F.array_repeat(core, F.size(residues))).otherwise(
        F.transform(residues, lambda p: F.when((p >= start) & (p < end), core).otherwise(context))
    )


def runs(residues: Column) -> Column:
    """Maximal stretches of consecutive residues as struct(first, last, at).

    ``at`` is the dense index of the first residue of the stretch.
    """
    n = F.size(residues)

    def heads_to_runs(heads):
        return F.transform(
            heads,
            lambda k, i: F.struct(
                F.get(residues, k).alias("first"),
                F.get(residues, F.coalesce(F.get(heads, i + 1), n) - 1).alias("last"),
                k.alias("at"),
            ),
        )

    heads = F.filter(
        first_n(n), lambda k: (k == 0) | (F.get(residues, k) != F.coalesce(F.get(residues, k - 1), F.lit(-9)) + 1)
    )
    return let(heads, heads_to_runs)


def dense_index(position: Column, stretches: Column) -> Column:
    """Index of a residue among the selected ones, null if it is not selected."""
    hit = F.filter(stretches, lambda r: (position >= r["first"]) & (position <= r["last"]))
    return F.get(F.transform(hit, lambda r: position - r["first"] + r["at"]), F.lit(0))
