"""Order-preserving packing of records into shards and microbatches.

The rule is a fold over the whole order: a part is closed when the next record
would pass a limit. It is computed exactly and in parallel. The ordered keys
are range-partitioned once and kept; then

1. each partition works out, for every place where the first part of its own
   could begin, how the packing leaves the partition (one short row for each
   partition);
2. these rows are chained, one step for each partition, which fixes where each
   partition really begins;
3. each partition is packed from that point on.

Both passes stream through a partition in Arrow batches. What the driver sees
is the short rows of step 1, never the records.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from foldgraph.errors import GraphError
from foldgraph.operators.checks import check_unique_ids, require_clean
from foldgraph.session import cut_lineage

NO_LIMIT = np.iinfo(np.int64).max // 4
SUMMARY = (
    "pid int, pre_a array<long>, pre_b array<long>, out_a array<long>, out_b array<long>, starts array<long>, "
    "total_a long, total_b long, rows long, first_key long, last_key long"
)


def _part_ends(cum_a, cum_b, resets, at, limit_a, limit_b):
    """Where a part begun at each index of ``at`` ends within the batch."""
    by_a = np.searchsorted(cum_a, cum_a[at] + limit_a, side="right") - 1
    by_b = np.searchsorted(cum_b, cum_b[at] + limit_b, side="right") - 1
    by_key = resets[np.searchsorted(resets, at, side="right")]
    return np.minimum(np.minimum(by_a, by_b), by_key)


def _columns(batch: pa.RecordBatch):
    return (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))


class _Chunk:
    """Prefix sums and forced boundaries of one Arrow batch."""

    def __init__(self, a, b, key, last_key):
        self.n = len(a)
        self.cum_a = np.concatenate(([0], np.cumsum(a)))
        self.cum_b = np.concatenate(([0], np.cumsum(b)))
        changed = np.flatnonzero(np.diff(key)) + 1
        forced = [0] if last_key is not None and key[0] != last_key else []
        self.forced_first = bool(forced)
        self.resets = np.concatenate((changed, [self.n])).astype(np.int64)

    def first_start(self, open_a, open_b, limit_a, limit_b):
        """First index that no longer fits an open part; n if all fit."""
        if self.forced_first:
            return np.zeros_like(open_a)
        by_a = np.searchsorted(self.cum_a, limit_a - open_a, side="right") - 1
        by_b = np.searchsorted(self.cum_b, limit_b - open_b, side="right") - 1
        return np.minimum(np.minimum(by_a, by_b), self.resets[0])

    def run(self, at, limit_a, limit_b):
        """Pack from each index; returns the last start and the number of starts."""
        at, last, starts = at.copy(), at.copy(), np.zeros(len(at), np.int64)
        moving = np.flatnonzero(at < self.n)
        while len(moving):
            last[moving] = at[moving]
            starts[moving] += 1
            at[moving] = _part_ends(self.cum_a, self.cum_b, self.resets, at[moving], limit_a, limit_b)
            moving = moving[at[moving] < self.n]
        return last, starts


def _summarise(limit_a: int, limit_b: int):
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre_a = pre_b = np.zeros(0, np.int64)
        out_a = out_b = starts = np.zeros(0, np.int64)
        total_a = total_b = rows = 0
        first_key = last_key = None
        growing = True
        for batch in batches:
            a, b, key = _columns(batch)
            if not len(a):
                continue
            pid = batch.column(3)[0].as_py()
            chunk = _Chunk(a, b, key, last_key)
            if len(out_a):
                at = chunk.first_start(out_a, out_b, limit_a, limit_b)
                last, more = chunk.run(at, limit_a, limit_b)
                begun = at < chunk.n
                out_a = np.where(begun, chunk.cum_a[-1] - chunk.cum_a[np.minimum(last, chunk.n)], out_a + chunk.cum_a[-1])
                out_b = np.where(begun, chunk.cum_b[-1] - chunk.cum_b[np.minimum(last, chunk.n)], out_b + chunk.cum_b[-1])
                starts = starts + more
            if growing:
                # Entries: every index an earlier part could still reach up to.
                new = np.arange(chunk.n if not chunk.forced_first else 1)
                fits = (total_a + chunk.cum_a[new] <= limit_a) & (total_b + chunk.cum_b[new] <= limit_b) & (new <= chunk.resets[0])
                growing = bool(fits.all()) and not chunk.forced_first and chunk.resets[0] == chunk.n
                new = new[fits]
                last, more = chunk.run(new, limit_a, limit_b)
                pre_a, pre_b = np.append(pre_a, total_a + chunk.cum_a[new]), np.append(pre_b, total_b + chunk.cum_b[new])
                out_a, out_b = np.append(out_a, chunk.cum_a[-1] - chunk.cum_a[last]), np.append(out_b, chunk.cum_b[-1] - chunk.cum_b[last])
                starts = np.append(starts, more)
            total_a, total_b, rows = total_a + int(chunk.cum_a[-1]), total_b + int(chunk.cum_b[-1]), rows + chunk.n
            first_key = int(key[0]) if first_key is None else first_key
            last_key = int(key[-1])
        if rows:
            lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (pre_a, pre_b, out_a, out_b, starts)]
            scalars = [pa.array([x], pa.int64()) for x in (total_a, total_b, rows, first_key, last_key)]
            names = ["pid", "pre_a", "pre_b", "out_a", "out_b", "starts", "total_a", "total_b", "rows", "first_key", "last_key"]
            yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), *lists, *scalars], names=names)

    return summarise


def _chain(summaries, limit_a: int, limit_b: int) -> dict[int, tuple]:
    """Open part on entry to each partition: (a, b, last key, parts begun so far)."""
    entries, state = {}, (0, 0, None, 0)
    for s in summaries:
        entries[s.pid] = state
        open_a, open_b, key, begun = state
        if key is None or key != s.first_key:
            j = 0
        else:
            # The open part takes j records: the longest prefix that still fits.
            reach_a = np.searchsorted(np.array(s.pre_a), limit_a - open_a, side="right") - 1
            reach_b = np.searchsorted(np.array(s.pre_b), limit_b - open_b, side="right") - 1
            j = int(min(reach_a, reach_b))
            whole = open_a + s.total_a <= limit_a and open_b + s.total_b <= limit_b and len(s.pre_a) == s.rows
            if whole and s.first_key == s.last_key:
                state = (open_a + s.total_a, open_b + s.total_b, s.last_key, begun)
                continue
        state = (s.out_a[j], s.out_b[j], s.last_key, begun + s.starts[j])
    return entries


def _assign(entries, limit_a: int, limit_b: int, names: list[str]):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            a, b, key = _columns(batch)
            if not len(a):
                continue
            state = entries.value[batch.column(3)[0].as_py()] if state is None else state
            open_a, open_b, last_key, begun = state
            chunk = _Chunk(a, b, key, last_key)
            if last_key is None:
                at = 0
            else:
                at = int(chunk.first_start(np.array([open_a]), np.array([open_b]), limit_a, limit_b)[0])
            first, marks = at, np.zeros(chunk.n, np.int64)
            while at < chunk.n:
                marks[at], first_of_last = 1, at
                at = int(_part_ends(chunk.cum_a, chunk.cum_b, chunk.resets, np.array([at]), limit_a, limit_b)[0])
            part = begun + np.cumsum(marks) - 1
            if first < chunk.n:
                open_a, open_b = int(chunk.cum_a[-1] - chunk.cum_a[first_of_last]), int(chunk.cum_b[-1] - chunk.cum_b[first_of_last])
            else:
                open_a, open_b = open_a + int(chunk.cum_a[-1]), open_b + int(chunk.cum_b[-1])
            state = (open_a, open_b, int(key[-1]), begun + int(marks.sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[4:], pa.array(part)], names=names)

    return assign


def greedy_parts(
    df: DataFrame,
    name: str,
    order: str,
    a: Column,
    limit_a: int | None,
    b: Column,
    limit_b: int | None,
    key: Column | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """``df`` in order, with its part numbers in ``name``.

    Greedy packing by two weights, restarting where ``key`` changes. No
    weight may be negative or above its limit. The rows are shuffled once,
    by ranges of ``order``, and come back sorted inside those ranges.
    """
    limit_a, limit_b = (NO_LIMIT if x is None else int(x) for x in (limit_a, limit_b))
    if limit_a <= 0 or limit_b <= 0:
        raise GraphError("packing limits must be positive")
    spark = df.sparkSession
    keyed = df.select(
        F.col(order).alias("_ord"),
        a.cast("long").alias("_a"),
        b.cast("long").alias("_b"),
        (F.lit(0) if key is None else key).cast("long").alias("_key"),
        "*",
    )
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    arranged = keyed.repartitionByRange(count, "_ord").sortWithinPartitions("_ord").drop("_ord")
    # The range a row lies in is kept with it: later tasks may be numbered otherwise.
    here = F.spark_partition_id()
    kept = cut_lineage(arranged.select("_a", "_b", "_key", here.alias("_pid"), *df.columns))
    narrow = kept.select("_a", "_b", "_key", "_pid")
    summaries = narrow.mapInArrow(_summarise(limit_a, limit_b), SUMMARY).orderBy("pid").toLocalIterator()
    entries = spark.sparkContext.broadcast(_chain(summaries, limit_a, limit_b))
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])
    return kept.mapInArrow(_assign(entries, limit_a, limit_b, schema.names), schema)


def check_limits(df: DataFrame, size: str, limit: int | None, what: str, key: str = "graph_id") -> DataFrame:
    """Rows too large for any part."""
    return df.where(F.lit(False) if limit is None else F.col(size) > limit).select(
        key, F.col(size).cast("long").alias("size"), F.lit(what).alias("limit")
    )


def refuse_oversized(df: DataFrame, size: str, limit: int | None, what: str) -> None:
    if limit is None:
        return
    largest = df.agg(F.max(F.struct(F.col(size).alias("size"), F.col("graph_id").alias("id"))).alias("top")).first().top
    if largest is not None and largest["size"] > limit:
        raise GraphError(f"{largest['id']} has size {largest['size']}, above {what}={limit}")


def assign_shards(
    records: DataFrame, *, max_records: int, max_nodes: int | None = None, partitions: int | None = None
) -> DataFrame:
    """Records with ``shard_id``, sorted by it inside their partitions.

    Sizes count the source molecule, even for a window.
    """
    if max_records <= 0 or (max_nodes is not None and max_nodes <= 0):
        raise GraphError("packing limits must be positive")
    refuse_oversized(records, "length", max_nodes, "max_nodes")
    return greedy_parts(
        records, "shard_id", "record_ord", F.lit(1), max_records, F.col("length"), max_nodes, partitions=partitions
    )


def assign_microbatches(
    graphs: DataFrame, *, max_batch_nodes: int = 60_000, max_batch_edges: int = 300_000, partitions: int | None = None
) -> DataFrame:
    """Sizes of each graph with ``batch_id``: greedy inside each shard on nodes and edges.

    ``record_ord`` must order shards as well, as it does after ``assign_shards``.
    """
    if max_batch_nodes <= 0 or max_batch_edges <= 0:
        raise GraphError("packing limits must be positive")
    sized = graphs.select("graph_id", "shard_id", "record_ord", "node_count", "edge_count")
    refuse_oversized(sized, "node_count", max_batch_nodes, "max_batch_nodes")
    refuse_oversized(sized, "edge_count", max_batch_edges, "max_batch_edges")
    return greedy_parts(
        sized, "batch_id", "record_ord", F.col("node_count"), max_batch_nodes, F.col("edge_count"), max_batch_edges,
        F.col("shard_id"), partitions,
    )


def csr_offsets(graphs: DataFrame) -> DataFrame:
    """node_ptr and edge_ptr: nodes and edges of a shard before each graph.

    A shard is bounded by its packing limits, and so is the window.
    """
    before = W.partitionBy("shard_id").orderBy("record_ord").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    return graphs.select(
        "shard_id", "graph_id", "record_ord", "node_count", "edge_count",
        F.coalesce(F.sum("node_count").over(before), zero).alias("node_ptr"),
        F.coalesce(F.sum("edge_count").over(before), zero).alias("edge_ptr"),
        (F.row_number().over(W.partitionBy("shard_id").orderBy("record_ord")) - 1).alias("shard_ord"),
    )


def concat_graphs(*sets: DataFrame) -> DataFrame:
    """Graphs of several sets in one shard, each set after the one before.

    ``record_ord`` stays a number: the orders of a set follow the last of the
    set before it. Sets of another contract, or sharing an identifier, are refused.
    """
    if not sets:
        raise GraphError("no graphs to put into a shard")
    narrow = ["graph_id", "record_ord", "graph_spec_sha256"]
    tagged = [s.select(*narrow, F.lit(i).alias("part")) for i, s in enumerate(sets)]
    heads = reduce(DataFrame.unionByName, tagged)
    contract = F.coalesce("graph_spec_sha256", F.lit(""))
    # One row for each set given.
    spans = heads.groupBy("part").agg(
        F.min("record_ord").alias("low"), F.max("record_ord").alias("high"),
        F.min(contract).alias("least"), F.max(contract).alias("most"),
    ).orderBy("part").collect()
    if not spans:
        raise GraphError("no graphs to put into a shard")
    if len({c for r in spans for c in (r.least, r.most)}) > 1:
        raise GraphError("graphs of different contracts cannot share a shard")
    require_clean(check_unique_ids(heads), "graphs of one shard share an identifier")
    shifts, at = {}, 0
    for r in spans:
        shifts[r.part], at = at - r.low, at + r.high - r.low + 1
    if at > 2**63 - 1:
        raise GraphError("the orders of these sets do not fit into one number")
    moved = [s.withColumn("record_ord", F.col("record_ord") + F.lit(shifts.get(i, 0)).cast("long")) for i, s in enumerate(sets)]
    return reduce(DataFrame.unionByName, moved)


def shard_edges(graphs: DataFrame) -> DataFrame:
    """Edges of each shard with node numbers counted over the whole shard.

    Graphs with a node_ptr and edge_ptr, of records joined to ``csr_offsets``
    before they were built, stay where they are: a record is some thirty times shorter than its edges.
    """
    if {"node_ptr", "edge_ptr"} <= set(graphs.columns):
        placed = graphs
    else:
        offsets = csr_offsets(graphs).select("shard_id", "record_ord", "node_ptr", "edge_ptr")
        placed = graphs.select("shard_id", "record_ord", "graph_id", "edge_src", "edge_dst", "edge_types").join(
            offsets, ["shard_id", "record_ord"]
        )
    zipped = F.arrays_zip("edge_src", "edge_dst", "edge_types")
    return placed.select("shard_id", "graph_id", "node_ptr", "edge_ptr", F.posexplode(zipped).alias("at", "e")).select(
        "shard_id", "graph_id",
        (F.col("edge_ptr") + F.col("at")).alias("edge_ord"),
        (F.col("node_ptr") + F.col("e.edge_src")).alias("src"),
        (F.col("node_ptr") + F.col("e.edge_dst")).alias("dst"),
        F.col("e.edge_types").alias("edge_type"),
    )


def slice_shard(graphs: DataFrame, shard_id: int, start: int, stop: int) -> DataFrame:
    """Graphs ``[start, stop)`` of a shard; their offsets start from zero again."""
    shard = graphs.where(F.col("shard_id") == shard_id)
    count = shard.count()
    if not 0 <= start < stop <= count:
        raise IndexError(f"[{start}, {stop}) is not a range of the {count} graphs of shard {shard_id}")
    at = F.row_number().over(W.partitionBy("shard_id").orderBy("record_ord")) - 1
    return shard.withColumn("_at", at).where((F.col("_at") >= start) & (F.col("_at") < stop)).drop("_at")
