"""The message-passing encoder over graph rows.

Graphs are independent of each other, so encoding needs no shuffle: every
partition streams its graphs through Arrow, gathers them into microbatches
bounded by nodes and edges, and runs the layers as NumPy matrix products. The
same layers by explode, sum and group are ``encode_relational``; the two are tested against each other.

No trained weights come with this package. They are a table
``(tensor string, row int, values array<float>)`` the caller supplies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foldgraph.errors import GraphError
from foldgraph.functions import vectors as V
from foldgraph.operators.checks import check_weights, require_clean, require_spec
from foldgraph.operators.packing import refuse_oversized
from foldgraph.session import bound_batches, cut_lineage
from foldgraph.spec import CORE, EncoderShape

NEEDED = ["node_features", "edge_src", "edge_dst", "edge_types", "residue_index", "node_roles"]
#: Nodes whose matrices are worked on together; those of more leave the processor's cache.
NODES_AT_ONCE = 8_000
PASSED = ["graph_id", "length", "start", "end", "node_count", "record_ord"]


def load_weights(weights: DataFrame, shape: EncoderShape) -> dict[str, np.ndarray]:
    """Weight table -> arrays, once its tensors have the expected shapes.

    The shapes fix the number of values, so what is brought to the driver and
    broadcast is bounded by the architecture, not by any data.
    """
    require_clean(check_weights(weights, shape), "weight table does not fit the encoder")
    held = {name: np.zeros(size, np.float32) for name, size in shape.tensors().items()}
    for r in weights.collect():
        held[r.tensor][r.row] = r["values"]
    return held


def _prepared(w: dict[str, np.ndarray], shape: EncoderShape) -> dict:
    """Weights as the layers use them.

    What is linear after a product is made part of its weights: the batch
    normalisation of the first one of a layer, and taking the mean off for the
    layer normalisation of the second. This changes no more than the last bits.
    """

    def affine(name, factor=1.0, shift=0.0, mean=0.0):
        weight, bias = w[f"{name}.weight"].T.astype(np.float64), w[f"{name}.bias"][0].astype(np.float64)
        return weight * factor, (bias - mean) * factor + shift

    def single(*arrays):
        return tuple(np.ascontiguousarray(x, dtype=np.float32) for x in arrays)

    layers = []
    for k in range(shape.layers):
        conv = f"convs.{k}"
        gain, shift, mean, variance = (w[f"{conv}.mlp.1.{p}"][0].astype(np.float64) for p in ("weight", "bias", "running_mean", "running_var"))
        first = affine(f"{conv}.mlp.0", gain / np.sqrt(variance + V.BATCH_NORM_EPS), shift, mean)
        last, bias = affine(f"{conv}.mlp.4")
        centred = last - last.mean(axis=1, keepdims=True), bias - bias.mean()
        by_kind = w[f"{conv}.edge_lin.weight"].T + w[f"{conv}.edge_lin.bias"]
        layers.append((1 + w[f"{conv}.eps"][0, 0], by_kind, single(*first), single(*centred), single(w[f"norms.{k}.weight"][0], w[f"norms.{k}.bias"][0])))
    return {"input": single(*affine("input")), "layers": layers, "head": [single(*affine(f"head.{i}")) for i in (0, 2)]}


def _by_kind(src, dst, kind):
    """Edges of each kind, and whether no node receives two of that kind."""
    groups = []
    for code in np.unique(kind):
        at = np.flatnonzero(kind == code)
        groups.append((code, src[at], dst[at], np.bincount(dst[at]).max() == 1))
    return groups


def _receive(total, h, groups, by_kind):
    """Add relu(h_src + w_kind) of every edge to its receiver's row of ``total``."""
    for code, senders, receivers, single in groups:
        messages = h[senders]
        messages += by_kind[code]
        np.maximum(messages, 0, out=messages)
        if single:
            total[receivers] += messages
        else:
            np.add.at(total, receivers, messages)


def _senders(groups, n: int):
    """Groups as (kind, sender of each node, itself): the sender is ``n`` where there is none, and no array where a node has several."""
    placed = []
    for code, senders, receivers, single in groups:
        of = np.full(n, n, dtype=np.intp) if single else None
        if single:
            of[receivers] = senders
        placed.append((code, of, (code, senders, receivers, single)))
    return placed


def _affine(x, weight, bias, out=None):
    out = np.matmul(x, weight, out=out)
    out += bias
    return out


def _run_layers(w, shape: EncoderShape, features, src, dst, kind):
    """Embeddings of all nodes of one microbatch, with the weights of :func:`_prepared`."""
    n, width = len(features), shape.hidden
    if len(src) and (max(src.max(), dst.max()) >= n or min(src.min(), dst.min()) < 0):
        raise IndexError("an edge leaves its batch")
    groups = _senders(_by_kind(src, dst, kind), n)
    # The last row is the state of no node: no message is left of it.
    states = np.full((n + 1, width), -np.inf, np.float32)
    h = states[:n]
    _affine(features, *w["input"], out=h)
    message, total, update = (np.empty((n, width), np.float32) for _ in range(3))
    inner = np.empty((n, 2 * width), np.float32)
    for own, by_kind, first, last, (gain, shift) in w["layers"]:
        np.multiply(h, own, out=total)
        # relu(h + w) is max(h, -w) + w, so the vectors of all kinds are added once; from no node comes -w.
        kinds = np.zeros(width, np.float32)
        for code, senders, group in groups:
            if senders is None or not np.isfinite(by_kind[code]).all():
                _receive(total, h, [group], by_kind)
                continue
            np.take(states, senders, axis=0, out=message, mode="clip")
            np.maximum(message, -by_kind[code], out=message)
            total += message
            kinds += by_kind[code]
        total += kinds
        np.maximum(_affine(total, *first, out=inner), 0, out=inner)
        _affine(inner, *last, out=update)
        spread = np.einsum("ij,ij->i", update, update) / np.float32(width)
        update /= np.sqrt(spread + np.float32(V.LAYER_NORM_EPS))[:, None]
        update *= gain
        update += shift
        if shape.residual:
            h += update
        else:
            h[:] = update
    return _affine(np.maximum(_affine(h, *w["head"][0]), 0), *w["head"][1])


def _ints(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _batch_ends(nodes, edges, limit_nodes, limit_edges) -> list[int]:
    """Ends of the greedy runs of graphs within both limits."""
    cum_n, cum_e = np.concatenate(([0], np.cumsum(nodes))), np.concatenate(([0], np.cumsum(edges)))
    ends, at = [], 0
    while at < len(nodes):
        at = int(
            min(
                np.searchsorted(cum_n, cum_n[at] + limit_nodes, side="right"),
                np.searchsorted(cum_e, cum_e[at] + limit_edges, side="right"),
            )
            - 1
        )
        ends.append(at)
    return ends


def _encode_rows(w, shape: EncoderShape, rows: pa.RecordBatch, half: bool, out_type: pa.DataType):
    """Residues and vectors of the core nodes of some graphs."""
    nodes = rows["residue_index"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    edges = rows["edge_src"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    base = np.repeat(np.concatenate(([0], np.cumsum(nodes)[:-1])), edges)
    features = rows["node_features"].flatten().flatten().to_numpy(zero_copy_only=False)
    features = features.astype(np.float32).reshape(-1, shape.spec.feature_width)
    src, dst = _ints(rows["edge_src"]) + base, _ints(rows["edge_dst"]) + base
    out = _run_layers(w, shape, features, src, dst, _ints(rows["edge_types"])).astype(np.float64)
    out /= np.maximum(np.sqrt(np.einsum("ij,ij->i", out, out)), V.NORM_FLOOR)[:, None]

    core = _ints(rows["node_roles"]) == CORE
    graph = np.repeat(np.arange(len(nodes)), nodes)[core]
    offsets = np.concatenate(([0], np.cumsum(np.bincount(graph, minlength=len(nodes))))).astype(np.int32)
    kept = out if core.all() else out[core]
    kept = kept.astype(np.float16).astype(np.float32) if half else kept
    flat = pa.array(np.ascontiguousarray(kept).ravel()).cast(out_type)
    row_offsets = pa.array(np.arange(len(kept) + 1, dtype=np.int32) * shape.out_dim)
    matrix = pa.ListArray.from_arrays(pa.array(offsets), pa.ListArray.from_arrays(row_offsets, flat))
    residues = pa.ListArray.from_arrays(pa.array(offsets), pa.array(_ints(rows["residue_index"])[core].astype(np.int32)))
    return residues, matrix


def encode(
    graphs: DataFrame,
    weights: DataFrame,
    shape: EncoderShape = EncoderShape(),
    *,
    max_batch_nodes: int = 60_000,
    max_batch_edges: int = 300_000,
    embedding_dtype: str = "float16",
) -> DataFrame:
    """One row per graph: core residues 5' to 3' and a unit vector for each.

    Limits bound the memory of a task; they do not change the result beyond
    the last bits. A graph above them, or of another contract, fails the task
    that meets it; ``check_sizes`` looks for one beforehand. ``record_ord`` is
    the graph's place in the input.
    """
    if max_batch_nodes <= 0 or max_batch_edges <= 0:
        raise GraphError("batch limits must be positive")
    if embedding_dtype not in ("float16", "float32", "float64"):
        raise ValueError(f"embeddings are float16, float32 or float64, not {embedding_dtype}")
    held = graphs.sparkSession.sparkContext.broadcast(_prepared(load_weights(weights, shape), shape))
    half = embedding_dtype == "float16"
    spark_type, out_type = ("double", pa.float64()) if embedding_dtype == "float64" else ("float", pa.float32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch["residue_index"].value_lengths().to_numpy(zero_copy_only=False)
            edges = batch["edge_src"].value_lengths().to_numpy(zero_copy_only=False)
            at = 0
            together = min(max_batch_nodes, max(NODES_AT_ONCE, nodes.max(initial=0)))
            for end in _batch_ends(nodes, edges, together, max_batch_edges):
                rows = batch.slice(at, end - at)
                residues, matrix = _encode_rows(held.value, shape, rows, half, out_type)
                passed = [rows[name] for name in PASSED]
                yield pa.RecordBatch.from_arrays([*passed, residues, matrix], names=[*PASSED, "residue_index", "embedding"])
                at = end

    passed = "graph_id string, length int, start int, end int, node_count int, record_ord long"
    fault = (
        F.when(~F.col("graph_spec_sha256").eqNullSafe(F.lit(shape.spec.fingerprint)), F.lit("another graph contract"))
        .when(F.col("node_count") > max_batch_nodes, F.lit("more nodes than max_batch_nodes"))
        .when(F.col("edge_count") > max_batch_edges, F.lit("more edges than max_batch_edges"))
    )
    refused = F.raise_error(F.concat(F.lit("cannot encode "), F.col("graph_id"), F.lit(": "), fault)).cast("int")
    ready = bound_batches(graphs).withColumn("length", F.length("sequence")).withColumn(
        "node_count", F.when(fault.isNull(), F.col("node_count")).otherwise(refused)
    )
    return ready.select(*PASSED, *NEEDED).mapInArrow(
        run, f"{passed}, residue_index array<int>, embedding array<array<{spark_type}>>"
    )


def check_sizes(graphs: DataFrame, shape: EncoderShape, max_batch_nodes: int, max_batch_edges: int) -> None:
    """Refuse foreign or oversized graphs before encoding; reads three short columns."""
    require_spec(graphs, shape.spec)
    refuse_oversized(graphs, "node_count", max_batch_nodes, "max_batch_nodes")
    refuse_oversized(graphs, "edge_count", max_batch_edges, "max_batch_edges")


def unpack_embeddings(embeddings: DataFrame) -> DataFrame:
    """One row per core nucleotide."""
    zipped = F.arrays_zip("residue_index", "embedding")
    return embeddings.select("graph_id", F.explode(zipped).alias("e")).select("graph_id", "e.residue_index", "e.embedding")


def collect_matrix(embeddings: DataFrame) -> DataFrame:
    """Long form back to one matrix per graph, 5' to 3'; bounded by the molecule."""
    rows = F.array_sort(F.collect_list(F.struct("residue_index", "embedding")))
    return embeddings.groupBy("graph_id").agg(rows.alias("r")).select(
        "graph_id", F.col("r.residue_index").alias("residue_index"), F.col("r.embedding").alias("embedding")
    )


def filter_core(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("node_role") == CORE)


def with_states(graphs: DataFrame, held: dict[str, np.ndarray]) -> DataFrame:
    """Graphs with the input state ``h`` of each node."""
    return bound_batches(graphs).withColumn("h", V.linear_each(F.col("node_features"), held["input.weight"], held["input.bias"]))


def _sent(graphs: DataFrame, received) -> DataFrame:
    """Rows (graph_id, dst, edge_type, h) for entries struct(src, dst, edge_type).

    A graph holds its own node states, so a source is looked up in the row:
    no join, and no row leaves its task.
    """
    return graphs.select("graph_id", "h", F.explode(received).alias("e")).select(
        "graph_id", F.col("e.dst").alias("dst"), F.col("e.edge_type").alias("edge_type"), F.get("h", F.col("e.src")).alias("h")
    )


def _edge_entries():
    zipped = F.arrays_zip(F.col("edge_src").alias("src"), F.col("edge_dst").alias("dst"), F.col("edge_types").alias("edge_type"))
    return zipped.cast("array<struct<src:int,dst:int,edge_type:tinyint>>")


def gather_sources(graphs: DataFrame) -> DataFrame:
    """Each edge with the state of its source node."""
    return _sent(graphs, _edge_entries())


def edge_type_lookup(edges: DataFrame, by_kind: np.ndarray) -> DataFrame:
    """Add the vector of the edge's kind; there are at most ``edge_dim`` of them."""
    table = F.array(*[V.literal(row) for row in by_kind])
    return edges.withColumn("w", F.get(table, F.col("edge_type").cast("int")))


def neighbour_sum(
    graphs: DataFrame, by_kind: np.ndarray, max_batch_nodes: int = 60_000, max_batch_edges: int = 300_000, carried: tuple[str, ...] = ()
) -> DataFrame:
    """(graph_id, node_idx, h, agg): sum over incoming edges of relu(h_src + w_kind).

    Columns named in ``carried`` hold a number for each node, which is given out with the node.

    A graph lies in one row, so its messages are added there, some graphs at
    a time: nothing is exploded before the sum and nothing is shuffled. A node
    without edges gets zeros. A graph above a limit is summed by itself.
    """
    kinds = by_kind.astype(np.float64)
    size = kinds.shape[1]

    def vectors(matrix: np.ndarray) -> pa.ListArray:
        offsets = pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * size)
        return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch["h"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            edges = batch["edge_src"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            limits = max(max_batch_nodes, nodes.max(initial=0)), max(max_batch_edges, edges.max(initial=0))
            at = 0
            for end in _batch_ends(nodes, edges, *limits):
                rows, n, m = batch.slice(at, end - at), nodes[at:end], edges[at:end]
                first = np.concatenate(([0], np.cumsum(n)[:-1]))
                base = np.repeat(first, m)
                states = rows["h"].flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                total = np.zeros_like(states)
                groups = _by_kind(_ints(rows["edge_src"]) + base, _ints(rows["edge_dst"]) + base, _ints(rows["edge_types"]))
                _receive(total, states, groups, kinds)
                owner = pa.array(np.repeat(np.arange(len(n)), n))
                place = (np.arange(len(states)) - np.repeat(first, n)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [rows["graph_id"].take(owner), pa.array(place), vectors(states), vectors(total), *[rows[c].flatten() for c in carried]],
                    names=["graph_id", "node_idx", "h", "agg", *carried],
                )
                at = end

    more = "".join(f", {c} {graphs.schema[c].dataType.elementType.simpleString()}" for c in carried)
    return bound_batches(graphs).select("graph_id", "h", "edge_src", "edge_dst", "edge_types", *carried).mapInArrow(
        run, f"graph_id string, node_idx int, h array<double>, agg array<double>{more}"
    )


def _conv_update(held: dict[str, np.ndarray], k: int, residual: bool):
    """The dense part of layer ``k`` in double precision: states and neighbour sums of some nodes to their new states."""
    conv = f"convs.{k}"
    own = 1.0 + float(held[f"{conv}.eps"][0, 0])
    first, last = ((held[f"{conv}.mlp.{i}.weight"], held[f"{conv}.mlp.{i}.bias"]) for i in (0, 4))
    gain, shift, mean, variance = (np.ravel(held[f"{conv}.mlp.1.{p}"]).astype(np.float64) for p in ("weight", "bias", "running_mean", "running_var"))
    factor = gain / np.sqrt(variance + V.BATCH_NORM_EPS)
    offset = shift - mean * factor
    norm_gain, norm_shift = (np.ravel(held[f"norms.{k}.{p}"]).astype(np.float64) for p in ("weight", "bias"))

    def update(h: np.ndarray, agg: np.ndarray) -> np.ndarray:
        t = V.rectified(V.affine(h * own + agg, *first) * factor + offset)
        t = V.affine(t, *last)
        centred = t - (V.row_sums(t) / t.shape[1])[:, None]
        spread = np.sqrt(V.row_sums(centred * centred) / t.shape[1] + V.LAYER_NORM_EPS)
        new = centred / spread[:, None] * norm_gain + norm_shift
        return h + new if residual else new

    return update


def conv_layer(graphs: DataFrame, held: dict[str, np.ndarray], k: int, residual: bool = True, carried: tuple[str, ...] = ()) -> DataFrame:
    """One layer over graphs with states: (graph_id, node_idx, h), and the ``carried`` columns of :func:`neighbour_sum`.

    The arithmetic on a node's elements is one Arrow function over many nodes:
    as columns, a layer is one generated method too long to be compiled.
    """
    conv = f"convs.{k}"
    by_kind = held[f"{conv}.edge_lin.weight"].T + held[f"{conv}.edge_lin.bias"]
    mixed = neighbour_sum(graphs, by_kind, carried=carried)
    return mixed.select("graph_id", "node_idx", V.dense(_conv_update(held, k, residual), "h", "agg").alias("h"), *carried)


def nest_states(states: DataFrame) -> DataFrame:
    """(graph_id, h): node states back in one row per graph; bounded by the molecule."""
    rows = F.array_sort(F.collect_list(F.struct("node_idx", "h")))
    return states.groupBy("graph_id").agg(rows.alias("r")).select("graph_id", F.col("r.h").alias("h"))


def encode_relational(graphs: DataFrame, weights: DataFrame, shape: EncoderShape) -> DataFrame:
    """The encoder by explode, sum and group: (graph_id, residue_index, embedding).

    Meant for small layer sizes and for checking :func:`encode`.
    """
    held = load_weights(weights, shape)
    current = with_states(graphs, held).select("graph_id", "edge_src", "edge_dst", "edge_types", "residue_index", "node_roles", "h")
    # No layer needs the states of the last one, so its nodes go on as they are, unless nodes of several graphs meet under one id.
    shared = not graphs.groupBy("graph_id").count().where("count > 1 or graph_id is null").isEmpty()
    for k in range(shape.layers if shared else shape.layers - 1):
        states = nest_states(conv_layer(current, held, k, shape.residual))
        # The plan of a layer holds that of the one before; cut it to keep it short.
        current = cut_lineage(current.drop("h").join(states, "graph_id"))
    if shared:
        nodes = current.select("graph_id", F.explode(F.arrays_zip("residue_index", "node_roles", "h")).alias("n")).select("graph_id", "n.*")
    else:
        nodes = conv_layer(current, held, shape.layers - 1, shape.residual, ("residue_index", "node_roles"))
    core = filter_core(nodes.withColumnRenamed("node_roles", "node_role"))

    def unit(h: np.ndarray) -> np.ndarray:
        head = V.rectified(V.affine(h, held["head.0.weight"], held["head.0.bias"]))
        out = V.affine(head, held["head.2.weight"], held["head.2.bias"])
        return out / np.maximum(np.sqrt(V.row_sums(out * out)), V.NORM_FLOOR)[:, None]

    return core.select("graph_id", "residue_index", V.dense(unit, "h").alias("embedding"))


def formula_weights(spark, shape: EncoderShape) -> DataFrame:
    """A weight table of the right shape from a fixed formula, for tests and benchmarks.

    Values are multiples of 1/64; they carry no biological meaning.
    """
    sizes = spark.createDataFrame(
        [(i, name, rows, width) for i, (name, (rows, width)) in enumerate(shape.tensors().items())],
        "i int, tensor string, rows int, width int",
    )
    cell = F.expr(
        "transform(sequence(0, width - 1), c -> cast(case when tensor like '%.running_var' then 1 + (c % 4) / 4 "
        "when tensor like '%mlp.1.weight' or tensor like 'norms.%.weight' then 1 "
        "else ((i * 7 + row * 31 + c * 17 + row * c * 5) % 23 - 11) / 64 end as float))"
    )
    return sizes.select("*", F.explode(F.expr("sequence(0, rows - 1)")).alias("row")).select("tensor", "row", cell.alias("values"))
