"""Node features and edge codes as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from foldgraph.functions.edges import feature_lists
from foldgraph.spec import GraphSpec

# The order of the one-hot positions.
BASES = ["A", "C", "G", "U"]
STATES = ["(", ".", ")"]


def _one_hot(value: Column, names: list[str]) -> Column:
    return F.array(*[(value == name).cast("float") for name in names])


def base_one_hot(base: Column) -> Column:
    return _one_hot(base, BASES)


def paired_flag(state: Column) -> Column:
    return F.array((state != ".").cast("float"))


def structure_one_hot(state: Column) -> Column:
    return _one_hot(state, STATES)


def relative_angle(position: Column, length: Column) -> Column:
    """pi * i / max(L-1, 1), in single precision throughout."""
    share = (position / F.greatest(length - 1, F.lit(1))).cast("float")
    return share * F.lit(math.pi).cast("float")


def relative_position(position: Column, length: Column) -> Column:
    angle = relative_angle(position, length)
    return F.array(F.sin(angle).cast("float"), F.cos(angle).cast("float"))


def assemble_features(base: Column, state: Column, position: Column, length: Column, spec: GraphSpec) -> Column:
    parts = [base_one_hot(base), paired_flag(state) if spec.structure_feature == "A" else structure_one_hot(state)]
    if spec.positional:
        parts.append(relative_position(position, length))
    return F.concat(*parts)


def node_features(sequence: Column, partner: Column, residues: Column, spec: GraphSpec) -> Column:
    """Feature vectors of the chosen residues, each as in the whole molecule; ``partner`` is -1 without one.

    Base and structure parts come from a table of all cases.
    """
    states = [".", "("] if spec.structure_feature == "A" else [".", "(", ")"]
    flag = (lambda state: [state != "."]) if spec.structure_feature == "A" else (lambda state: [state == t for t in STATES])
    table = [[float(x) for x in [*(name == b for b in BASES), *flag(state)]] for state in states for name in BASES]
    return feature_lists(sequence, partner, residues, table, "".join(BASES), spec.structure_feature == "B", spec.positional)


def edge_type_code(name: Column, spec: GraphSpec = GraphSpec()) -> Column:
    table = [F.lit(x) for item in spec.edge_codes.items() for x in item]
    return F.try_element_at(F.create_map(*table), name).cast("tinyint")


def edge_type_name(code: Column, spec: GraphSpec = GraphSpec()) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in spec.edge_codes]), code.cast("int") + 1)


def edge_one_hot(code: Column, spec: GraphSpec = GraphSpec()) -> Column:
    return F.array(*[(code == k).cast("float") for k in range(spec.edge_dim)])


def spec_fingerprint(spec: GraphSpec = GraphSpec()) -> Column:
    return F.sha2(F.lit(spec.canonical()), 256)
