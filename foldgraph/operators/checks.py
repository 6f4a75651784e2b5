"""Invariants of graphs, shards, manifests and weight tables.

Each check returns the offending rows with the rule they break, so an empty
result means a clean dataset. Checks of one graph are expressions over its
row; only uniqueness and per-shard totals group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foldgraph.errors import GraphError, SpecMismatch
from foldgraph.functions.arrays import first_n
from foldgraph.spec import CONTEXT, CORE, FORMAT_VERSION, EncoderShape, GraphSpec


def broken_rules(df: DataFrame, rules: list[tuple[str, Column]], *keys: str) -> DataFrame:
    """(keys, rule): one row for each rule whose condition holds.

    The rules are exploded, not filtered: a filter would be pushed below the
    columns it reads, and these be computed once more for it.
    """
    # No lambda: one would have all rules below it interpreted.
    flagged = [F.when(F.coalesce(test, F.lit(True)), F.lit(name)).otherwise("") for name, test in rules]
    return df.select(*keys, F.explode(F.array_remove(F.array(*flagged), "")).alias("rule"))


def not_increasing(values: Column) -> Column:
    """True where some entry does not exceed the one before it."""
    return F.exists(first_n(F.size(values) - 1), lambda k: F.get(values, k + 1) <= F.get(values, k))


def _outside(values: Column, high: Column, kind: str = "int") -> Column:
    """As ``exists`` of an entry below 0 or not below ``high``, in generated code rather than by a lambda.

    Null entries leave it null where no entry is outside, as the search for -1 does.
    """
    found = (F.array_min(values) < 0) | (F.array_max(values) >= high)
    # If all entries are null there are no extremes.
    found = F.when(high.isNull(), found).otherwise(F.coalesce(found, F.lit(False)))
    return F.when(F.size(values) == 0, False).otherwise(found | F.array_contains(values, F.lit(-1).cast(kind)))


def _graph_rules(spec: GraphSpec) -> list[tuple[str, Column]]:
    residues, roles = F.col("residue_index"), F.col("node_roles")
    n, m = F.size(residues), F.size("edge_src")
    sequence, structure = F.col("sequence"), F.col("structure")
    no_text = F.col("graph_id").isNull() | sequence.isNull() | structure.isNull()
    return [
        ("metadata", no_text | (F.col("graph_id") == "") | (sequence == "") | (F.length(structure) != F.length(sequence))),
        ("no_nodes", n < 1),
        ("roles_shape", F.size(roles) != n),
        ("feature_shape", (F.size("node_features") != n) | F.exists("node_features", lambda f: F.size(f) != spec.feature_width)),
        ("edge_shape", (F.size("edge_dst") != m) | (F.size("edge_types") != m)),
        ("edge_range", _outside(F.col("edge_src"), n) | _outside(F.col("edge_dst"), n)),
        ("edge_type_range", _outside(F.col("edge_types"), F.lit(spec.edge_dim), "tinyint")),
        ("residue_range", _outside(residues, F.length(sequence))),
        ("residue_order", not_increasing(residues)),
        ("unknown_role", F.exists(roles, lambda r: ~r.isin(CORE, CONTEXT))),
        ("no_core", ~F.array_contains(roles, F.lit(CORE).cast("tinyint"))),
        ("counts", (F.col("node_count") != n) | (F.col("edge_count") != m)),
    ]


def check_graphs(graphs: DataFrame, spec: GraphSpec = GraphSpec()) -> DataFrame:
    """(graph_id, rule) for every rule of the per-graph contract a graph breaks."""
    return broken_rules(graphs, _graph_rules(spec), "graph_id")


def check_unique_ids(records: DataFrame, *scope: str) -> DataFrame:
    """Identifiers that occur more than once in the table, or in each ``scope``."""
    return records.groupBy(*scope, "graph_id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def _value_rules() -> list[tuple[str, Column]]:
    # Searched in generated code; null entries make a search null, as they would a lambda.
    values = F.flatten("node_features")
    strange = [F.array_contains(values, F.lit(float(x)).cast("float")) for x in ("nan", "inf", "-inf")]
    return [
        ("not_finite", strange[0] | strange[1] | strange[2]),
        ("crossing_edge", _outside(F.concat("edge_src", "edge_dst"), F.col("node_count"))),
    ]


def check_values(graphs: DataFrame) -> DataFrame:
    """Graphs with a feature that is not finite, or an edge leaving the graph."""
    return broken_rules(graphs, _value_rules(), "graph_id")


def refuse_broken(graphs: DataFrame, spec: GraphSpec = GraphSpec(), values: bool = False) -> DataFrame:
    """``graphs``, of which a row that breaks a rule fails the task that reads it; no pass of its own."""
    rules = _graph_rules(spec) + (_value_rules() if values else [])
    fault = F.coalesce(*[F.when(F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in rules])
    text = F.concat(F.lit("invalid graph "), F.coalesce("graph_id", F.lit("without id")), F.lit(": "), fault)
    # The verdict is part of two columns that every reader of graphs takes.
    return graphs.withColumns({
        c: F.when(fault.isNull(), F.col(c)).otherwise(F.raise_error(text).cast(graphs.schema[c].dataType)) for c in ("graph_id", "node_count")
    })


def check_spec(graphs: DataFrame, spec: GraphSpec = GraphSpec()) -> DataFrame:
    """Graphs built under another contract than the expected one."""
    return graphs.where(~F.col("graph_spec_sha256").eqNullSafe(F.lit(spec.fingerprint))).select("graph_id", "graph_spec_sha256")


def shard_counts(graphs: DataFrame, *more: Column) -> DataFrame:
    """Records, nodes, core nodes and edges of each shard, and ``more`` totals of the same pass."""
    counts = [F.sum(F.col(c).cast("long")).alias(c) for c in ("node_count", "core_count", "edge_count")]
    # The totals come first: in those after them Spark would take node_count for the sum.
    counted = graphs.groupBy("shard_id").agg(*more, F.count(F.lit(1)).alias("record_count"), *counts)
    return counted.select("shard_id", "record_count", "node_count", "core_count", "edge_count", *counted.columns[1 : 1 + len(more)])


def judged_shards(graphs: DataFrame, spec: GraphSpec = GraphSpec(), max_nodes: int = 2**31 - 1, *more: Column, values: bool = False) -> DataFrame:
    """Counts of each shard, ``found`` (rule, rows) of the broken rules, and ``more`` totals, all from one pass."""
    rules = _graph_rules(spec) + (_value_rules() if values else [])
    broken = [(name, F.count_if(F.coalesce(test, F.lit(True)))) for name, test in rules]
    contract = F.col("graph_spec_sha256")
    broken.append(("mixed_contract", F.when(F.min(contract) != F.max(contract), 1).otherwise(0).cast("long")))
    nodes = F.sum(F.col("node_count").cast("long"))
    broken.append(("too_many_nodes", F.when(nodes > max_nodes, 1).otherwise(0).cast("long")))
    found = F.array(*[F.struct(F.lit(name).alias("rule"), rows.alias("rows")) for name, rows in broken])
    return shard_counts(graphs, F.filter(found, lambda x: x["rows"] > 0).alias("found"), *more)


def shard_faults(judged: DataFrame, repeats: DataFrame) -> DataFrame:
    """(shard_id, rule, rows) of judged shards and of their repeated ids."""
    counted = repeats.groupBy("shard_id").agg(F.count(F.lit(1)).alias("rows"))
    faults = judged.select("shard_id", F.inline("found"))
    return faults.unionByName(counted.select("shard_id", F.lit("duplicate_identifier").alias("rule"), "rows"))


def check_shards(graphs: DataFrame, spec: GraphSpec = GraphSpec(), max_nodes: int = 2**31 - 1) -> DataFrame:
    """(shard_id, rule, rows): per-graph faults by shard, repeated ids, mixed contracts, size.

    One pass counts every rule, combined before the shuffle; a second one reads the ids alone.
    """
    # Counting per id first combines the copies of one id before the shuffle.
    return shard_faults(judged_shards(graphs, spec, max_nodes), check_unique_ids(graphs, "shard_id"))


def check_offsets(offsets: DataFrame) -> DataFrame:
    """Rows of a CSR offset table that are not running totals of their counts."""
    along = W.partitionBy("shard_id").orderBy("shard_ord")
    expected_nodes = F.coalesce(F.lag(F.col("node_ptr") + F.col("node_count")).over(along), F.lit(0))
    expected_edges = F.coalesce(F.lag(F.col("edge_ptr") + F.col("edge_count")).over(along), F.lit(0))
    judged = offsets.withColumn("bad", (F.col("node_ptr") != expected_nodes) | (F.col("edge_ptr") != expected_edges) | (F.col("node_count") < 1))
    return judged.where("bad").select("shard_id", "graph_id")


def check_manifest(graphs: DataFrame, manifest: DataFrame, spec: GraphSpec | None = None) -> DataFrame:
    """(shard_id, rule) of shards that differ from their manifest row."""
    return manifest_faults(shard_counts(graphs), manifest, spec)


def manifest_faults(counts: DataFrame, manifest: DataFrame, spec: GraphSpec | None = None) -> DataFrame:
    """:func:`check_manifest` for shards that are counted already."""
    stored = counts.select("shard_id", *[F.col(c).alias(f"found_{c}") for c in ("record_count", "node_count", "edge_count")])
    both = stored.join(manifest, "shard_id", "full_outer")
    unlisted, empty = F.col("format_version").isNull(), F.col("found_record_count").isNull()
    rules = [("not_in_manifest", unlisted), ("no_data", empty), ("version", ~unlisted & (F.col("format_version") != FORMAT_VERSION))]
    for c in ("record_count", "node_count", "edge_count"):
        rules.append((c, ~unlisted & ~empty & (F.col(f"found_{c}") != F.col(c))))
    if spec is not None:
        rules.append(("contract", ~unlisted & (F.col("graph_spec_sha256") != spec.fingerprint)))
    return broken_rules(both, rules, "shard_id")


def check_columns(present: list[str], required: list[str], optional: list[str] = ()) -> None:
    """Stored columns: all required ones, nothing unexpected."""
    missing, strange = set(required) - set(present), set(present) - set(required) - set(optional)
    if missing:
        raise GraphError("missing columns: " + ", ".join(sorted(missing)))
    if strange:
        raise GraphError("unexpected columns: " + ", ".join(sorted(strange)))


def check_weights(weights: DataFrame, shape: EncoderShape = EncoderShape()) -> DataFrame:
    """(tensor, rows, width) of tensors missing, unknown or of the wrong shape."""
    expected = weights.sparkSession.createDataFrame(
        [(name, rows, width) for name, (rows, width) in shape.tensors().items()], "tensor string, rows long, width int"
    )
    found = weights.groupBy("tensor").agg(
        F.count(F.lit(1)).alias("found_rows"),
        F.count_distinct("row").alias("distinct_rows"),
        F.min("row").alias("low"),
        F.max("row").alias("high"),
        F.min(F.size("values")).alias("narrow"),
        F.max(F.size("values")).alias("wide"),
    )
    wrong = (
        F.col("found_rows").isNull() | F.col("rows").isNull() | (F.col("found_rows") != F.col("rows"))
        | (F.col("distinct_rows") != F.col("rows")) | (F.col("low") != 0) | (F.col("high") != F.col("rows") - 1)
        | (F.col("narrow") != F.col("width")) | (F.col("wide") != F.col("width"))
    )
    return expected.join(found, "tensor", "full_outer").where(wrong).select("tensor", F.col("found_rows").alias("rows"), F.col("wide").alias("width"))


def parameter_total(weights: DataFrame) -> DataFrame:
    """Trainable values in a weight table; running statistics do not count."""
    return weights.where(~F.contains("tensor", F.lit(".running_"))).agg(F.sum(F.size("values").cast("long")).alias("parameters"))


def require_clean(faults: DataFrame, what: str, error: type[GraphError] = GraphError) -> None:
    found = faults.limit(1).collect()
    if found:
        raise error(f"{what}: {found[0].asDict()}")


def require_spec(graphs: DataFrame, spec: GraphSpec) -> None:
    require_clean(check_spec(graphs, spec), "graphs of another contract", SpecMismatch)
