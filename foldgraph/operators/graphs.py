"""Molecule records to typed-edge graphs.

A graph is one row; ``unpack_nodes`` and ``unpack_edges`` give the long form.
Nothing here shuffles except ``by_molecule``, the relational pairing windows and ``pack_graphs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from foldgraph.functions.arrays import let
from foldgraph.functions.edges import edge_lists
from foldgraph.functions.features import node_features, spec_fingerprint
from foldgraph.functions.pairing import scan_brackets
from foldgraph.functions.selection import residue_roles, selected_residues
from foldgraph.session import bound_batches
from foldgraph.spec import CORE, GraphSpec


def with_edges(selected: DataFrame, spec: GraphSpec) -> DataFrame:
    """Add edge_src, edge_dst, edge_types in the fixed edge order of :func:`edge_lists`."""
    linked = selected.withColumn("_edges", edge_lists(F.col("residue_index"), F.col("partner"), spec))
    return linked.withColumns({f"edge_{name}": F.col(f"_edges.{name}") for name in ("src", "dst", "types")}).drop("_edges")


def select_residues(
    records: DataFrame, spec: GraphSpec = GraphSpec(), keep_paired_neighbours: bool = False, context_hops: int = 1
) -> DataFrame:
    """Records with their pair table, selected residues and roles."""
    if context_hops < 1:
        raise ValueError("context_hops must be at least 1")
    start, end = F.col("start"), F.col("end")
    return (
        bound_batches(records).withColumn("_scan", scan_brackets("structure"))
        .withColumns({"partner": F.col("_scan.partner"), "openers": F.col("_scan.openers")})
        .drop("_scan")
        .withColumn(
            "residue_index",
            selected_residues(
                F.col("partner"), start, end, F.length("sequence"), keep_paired_neighbours, context_hops, spec.skip2
            ),
        )
    )


def build_graphs(
    records: DataFrame,
    spec: GraphSpec = GraphSpec(),
    *,
    keep_paired_neighbours: bool = False,
    context_hops: int = 1,
) -> DataFrame:
    """One graph per record, as nested columns, without a shuffle."""
    start, end = F.col("start"), F.col("end")
    selected = select_residues(records, spec, keep_paired_neighbours, context_hops)
    features = node_features(F.col("sequence"), F.col("partner"), F.col("residue_index"), spec)
    return with_edges(selected, spec).select(
        "graph_id", "molecule_id", "sequence", "structure", "start", "end", "record_ord",
        features.alias("node_features"),
        "edge_src",
        "edge_dst",
        "edge_types",
        "residue_index",
        residue_roles(F.col("residue_index"), start, end).alias("node_roles"),
        F.size("residue_index").alias("node_count"),
        F.size("edge_types").alias("edge_count"),
        F.coalesce(end - start, F.length("sequence")).cast("int").alias("core_count"),
        spec_fingerprint(spec).alias("graph_spec_sha256"),
        *[c for c in records.columns if c in ("shard_id", "node_ptr", "edge_ptr")],
    )


def unpack_nodes(graphs: DataFrame, *extra: str, features: bool = True) -> DataFrame:
    """One row per node: index, source residue, role, features.

    Spark makes all arrays of the zip, read or not: without ``features`` they are not made.
    """
    names = {"residue_index": "residue_index", "node_roles": "node_role"} | ({"node_features": "features"} if features else {})
    return graphs.select("graph_id", *extra, F.posexplode(F.arrays_zip(*names)).alias("node_idx", "n")).select(
        "graph_id", *extra, "node_idx", *[F.col(f"n.{a}").alias(name) for a, name in names.items()]
    )


def unpack_edges(graphs: DataFrame, *extra: str) -> DataFrame:
    """One row per edge, in edge order."""
    zipped = F.arrays_zip("edge_src", "edge_dst", "edge_types")
    return graphs.select("graph_id", *extra, F.posexplode(zipped).alias("edge_ord", "e")).select(
        "graph_id", *extra, "edge_ord", F.col("e.edge_src").alias("src"), F.col("e.edge_dst").alias("dst"),
        F.col("e.edge_types").alias("edge_type"),
    )


def pack_graphs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Long form back to one row per graph.

    A graph has at most ``MAX_LENGTH`` nodes and a handful of edges for each,
    so the collected lists are bounded however many graphs there are.
    """
    packed_nodes = nodes.groupBy("graph_id").agg(
        F.array_sort(F.collect_list(F.struct("node_idx", "residue_index", "node_role", "features"))).alias("n")
    )
    # An edge of a graph within the limits is one number, by its place first; any other is collected as it is.
    limit = 1 << 20
    small = [F.col(c).between(0, limit - 1) for c in ("edge_ord", "src", "dst")]
    fits = small[0] & small[1] & small[2] & F.col("edge_type").between(0, 7)
    number = F.lit(0).cast("long")
    for name, bits in (("edge_ord", 20), ("src", 20), ("dst", 20), ("edge_type", 3)):
        number = F.shiftleft(number, bits) + F.col(name)

    def unpacked(x):
        cut = lambda at: F.shiftright(x, at).bitwiseAND(F.lit(limit - 1))
        parts = {"edge_ord": cut(43), "src": cut(23), "dst": cut(3), "edge_type": x.bitwiseAND(F.lit(7))}
        return F.struct(*[v.cast(edges.schema[n].dataType).alias(n) for n, v in parts.items()])

    collected = edges.groupBy("graph_id").agg(
        F.collect_list(F.when(fits, number)).alias("near"),
        F.collect_list(F.when(~F.coalesce(fits, F.lit(False)), F.struct("edge_ord", "src", "dst", "edge_type"))).alias("far"),
    )
    near = F.transform(F.array_sort("near"), unpacked)
    packed_edges = collected.select("graph_id", F.when(F.size("far") == 0, near).otherwise(F.array_sort(F.concat(near, "far"))).alias("e"))
    none = F.array()
    return packed_nodes.join(packed_edges, "graph_id", "left").select(
        "graph_id",
        F.col("n.features").alias("node_features"),
        F.coalesce(F.col("e.src"), none.cast("array<int>")).alias("edge_src"),
        F.coalesce(F.col("e.dst"), none.cast("array<int>")).alias("edge_dst"),
        F.coalesce(F.col("e.edge_type"), none.cast("array<tinyint>")).alias("edge_types"),
        F.col("n.residue_index").alias("residue_index"),
        F.col("n.node_role").alias("node_roles"),
        F.size("n").alias("node_count"),
        F.coalesce(F.size("e"), F.lit(0)).alias("edge_count"),
        F.size(F.filter("n", lambda x: x["node_role"] == CORE)).alias("core_count"),
    )


def by_molecule(records: DataFrame, positions_per_part: int = 4_000_000) -> DataFrame:
    """Records dealt by ``graph_id`` and sorted by it, for windows along each molecule.

    A position has some forty bytes as a row and two in its record. So the
    records are shuffled here, and the windows over their positions need no
    exchange. Parts hold about ``positions_per_part`` positions, and
    at least as many parts are made as a shuffle has.
    """
    total = records.agg(F.sum(F.length("sequence"))).first()[0] or 0
    parts = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // positions_per_part))
    return records.repartition(parts, "graph_id").sortWithinPartitions("graph_id")


def explode_nucleotides(records: DataFrame, *extra: str) -> DataFrame:
    """One row per position of the molecule: base and structure symbol."""
    zipped = F.arrays_zip(F.split("sequence", "").alias("base"), F.split("structure", "").alias("state"))
    return records.select("graph_id", *extra, F.posexplode(zipped).alias("pos", "c")).select(
        "graph_id", *extra, "pos", "c.base", "c.state"
    )


def bracket_depth(nucleotides: DataFrame) -> DataFrame:
    """Open brackets after each position."""
    step = F.when(F.col("state") == "(", 1).when(F.col("state") == ")", -1).otherwise(0)
    along = W.partitionBy("graph_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    return nucleotides.withColumn("depth", F.sum(step).over(along))


def partner_by_level(depths: DataFrame) -> DataFrame:
    """Pair table by windows: on one level, brackets alternate open and close.

    The window keys contain ``graph_id``, so the exchange made for the depth
    serves here too.
    """
    state = F.col("state")
    level = F.when(state == "(", F.col("depth")).when(state == ")", F.col("depth") + 1).otherwise(0)
    beside = W.partitionBy("graph_id", "level").orderBy("pos")
    partner = (
        F.when(state == "(", F.lead("pos").over(beside)).when(state == ")", F.lag("pos").over(beside)).otherwise(-1)
    )
    return depths.withColumn("level", level).withColumn("partner", partner).drop("level")


def opener_rank(nucleotides: DataFrame) -> DataFrame:
    """0-based rank of each opening bracket in its molecule."""
    along = W.partitionBy("graph_id").orderBy("pos")
    return nucleotides.where("state = '('").withColumn("opener", F.row_number().over(along) - 1)


def graph_counts(graphs: DataFrame) -> DataFrame:
    return graphs.select("graph_id", "node_count", "edge_count", "core_count")


def core_span(graphs: DataFrame) -> DataFrame:
    """Half-open span and positions of a graph's core residues."""
    # Bound, so that the roles are not made anew for every residue.
    core = let(F.col("node_roles"), lambda roles: F.filter("residue_index", lambda p, i: F.get(roles, i) == CORE))
    return graphs.withColumn("core_positions", core).select(
        "graph_id",
        F.array_min("core_positions").alias("core_start"),
        (F.array_max("core_positions") + 1).alias("core_end"),
        "core_positions",
    )
