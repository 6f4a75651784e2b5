"""The jobs a user starts: table to graphs, graphs to embeddings, and both at once."""

from __future__ import annotations

import platform
import time
from dataclasses import dataclass, field

import numpy as np
import pyspark
from pyspark.sql import DataFrame, SparkSession, functions as F

from foldgraph.errors import GraphError
from foldgraph.functions.features import spec_fingerprint
from foldgraph.operators import packing
from foldgraph.operators.encoder import encode
from foldgraph.operators.graphs import build_graphs
from foldgraph.operators.records import Columns, require_non_empty
from foldgraph.session import materialize
from foldgraph.sources.shards import read_once, row_hash, write_shards
from foldgraph.sources.tables import read_records
from foldgraph.spec import EncoderShape, GraphSpec


@dataclass(frozen=True)
class Context:
    """Paired neighbours to keep around a window; naming a depth switches them on."""

    keep_paired_neighbours: bool = False
    context_hops: int | None = None

    def options(self) -> dict:
        keep = self.keep_paired_neighbours or self.context_hops is not None
        return {"keep_paired_neighbours": keep, "context_hops": 1 if self.context_hops is None else self.context_hops}


@dataclass(frozen=True)
class TableOptions:
    columns: Columns = field(default_factory=Columns)
    delimiter: str = "\t"
    use_windows: bool = True
    on_error: str = "fail"

    def read(self, spark: SparkSession, path) -> DataFrame:
        cleaned = read_records(
            spark, path, self.columns, delimiter=self.delimiter, use_windows=self.use_windows, on_error=self.on_error
        )
        return cleaned.records if self.on_error == "fail" else require_non_empty(materialize(cleaned.records))


def embedding_manifest(embeddings: DataFrame) -> DataFrame:
    """Per graph: place in the input, sizes, window, and the shape of its matrix."""
    return embeddings.select(
        "record_ord", "graph_id", "length", "node_count", F.size("residue_index").alias("core_length"), "start", "end",
        F.coalesce(F.size(F.get("embedding", F.lit(0))), F.lit(0)).alias("embedding_dim"),
    )


def dataset_checksum(df: DataFrame) -> DataFrame:
    """One order-free hash of a whole dataset; combined on the map side."""
    return df.agg(F.sum(row_hash(df.columns)).cast("string").alias("checksum"), F.count(F.lit(1)).alias("rows"))


def weights_checksum(weights: DataFrame) -> str:
    """Which weights made a set of vectors: a hash of all their values."""
    return dataset_checksum(weights.select("tensor", "row", "values")).first().checksum


def build_summary(graphs: DataFrame, spec: GraphSpec = GraphSpec()) -> DataFrame:
    return graphs.agg(
        F.count(F.lit(1)).alias("records"),
        F.coalesce(F.sum(F.col("node_count").cast("long")), F.lit(0)).alias("nodes"),
        F.coalesce(F.sum(F.col("edge_count").cast("long")), F.lit(0)).alias("edges"),
    ).withColumn("graph_spec_sha256", spec_fingerprint(spec))


def write_embeddings(embeddings: DataFrame, path: str) -> DataFrame:
    """One row per graph id, into a folder without embeddings; returns the dataset as stored."""
    embeddings.write.parquet(f"{path}/embeddings")
    return embeddings.sparkSession.read.parquet(f"{path}/embeddings")


def write_manifest(stored: DataFrame, path: str, run: dict, *, checksum: bool = False) -> DataFrame:
    """Records and run facts next to the embeddings, written once those are complete.

    The run row comes last, so a folder that has it is whole. Nothing is
    overwritten: a new run takes a new path.
    """
    spark = stored.sparkSession
    embedding_manifest(stored).write.json(f"{path}/manifest/records")
    facts = {
        "status": "complete", "output": path, "spark": pyspark.__version__, "python": platform.python_version(),
        "numpy": np.__version__, **run,
    }
    totals = stored.agg(F.count(F.lit(1)).alias("records"))
    if checksum:
        totals = dataset_checksum(stored).withColumnsRenamed({"checksum": "output_checksum", "rows": "records"})
    row = totals.withColumns({k: F.lit(v) for k, v in facts.items()})
    row.coalesce(1).write.json(f"{path}/manifest/run")
    return spark.read.json(f"{path}/manifest/run")


def build_graph_dataset(
    spark: SparkSession,
    table,
    path: str,
    spec: GraphSpec = GraphSpec(),
    *,
    options: TableOptions = TableOptions(),
    context: Context = Context(),
    max_records: int = 128,
    max_nodes: int | None = 60_000,
    checksum: bool = False,
) -> DataFrame:
    """Delimited table -> shards on Parquet; returns the summary row."""
    started = time.time()
    records = options.read(spark, table)
    sharded = packing.assign_shards(records, max_records=max_records, max_nodes=max_nodes)
    manifest = write_shards(
        build_graphs(sharded, spec, **context.options()), path, spec, checksum=checksum, arranged=True
    )
    return (
        manifest.agg(F.sum("record_count").alias("records"), F.sum("node_count").alias("nodes"), F.sum("edge_count").alias("edges"))
        .withColumn("graph_spec_sha256", spec_fingerprint(spec))
        .withColumn("elapsed_seconds", F.lit(time.time() - started))
    )


def embed_graph_dataset(
    spark: SparkSession,
    graphs_at: str,
    weights: DataFrame,
    path: str,
    shape: EncoderShape = EncoderShape(),
    *,
    max_batch_nodes: int = 60_000,
    max_batch_edges: int = 300_000,
    embedding_dtype: str = "float16",
    verify_checksum: bool = False,
    validation: str = "metadata",
    checksum: bool = False,
) -> DataFrame:
    """Stored shards -> embeddings and manifest; returns the run row.

    The graphs are read once, besides their ids and sizes: the pass that encodes
    them judges them too, and the run row, without which a folder is not whole,
    is written only if what was read agrees with their manifest.
    """
    started = time.time()
    graphs, pending = read_once(spark, graphs_at, shape.spec, verify_checksum=verify_checksum, validation=validation)
    for most, limit, what in ((pending.most_nodes, max_batch_nodes, "max_batch_nodes"), (pending.most_edges, max_batch_edges, "max_batch_edges")):
        if most > limit:
            raise GraphError(f"a graph has size {most}, above {what}={limit}")
    encoded = encode(
        graphs, weights, shape, max_batch_nodes=max_batch_nodes, max_batch_edges=max_batch_edges, embedding_dtype=embedding_dtype
    )
    stored = write_embeddings(encoded, path)
    pending.confirm()
    run = {
        "input": graphs_at, "graph_spec_sha256": shape.spec.fingerprint, "weights_checksum": weights_checksum(weights),
        "elapsed_seconds": time.time() - started,
    }
    return write_manifest(stored, path, run, checksum=checksum)


def embed_table(
    spark: SparkSession,
    table,
    weights: DataFrame,
    path: str,
    shape: EncoderShape = EncoderShape(),
    *,
    options: TableOptions = TableOptions(),
    context: Context = Context(),
    max_batch_nodes: int = 60_000,
    max_batch_edges: int = 300_000,
    embedding_dtype: str = "float16",
) -> DataFrame:
    """Delimited table -> embeddings and manifest, with no stored graphs between."""
    started = time.time()
    records = options.read(spark, table)
    graphs = build_graphs(records, shape.spec, **context.options())
    encoded = encode(
        graphs, weights, shape, max_batch_nodes=max_batch_nodes, max_batch_edges=max_batch_edges, embedding_dtype=embedding_dtype
    )
    stored = write_embeddings(encoded, path)
    lines = spark.read.text(table)
    source = dataset_checksum(lines).first()
    run = {
        "input": str(table), "input_checksum": source.checksum, "graph_spec_sha256": shape.spec.fingerprint,
        "weights_checksum": weights_checksum(weights), "elapsed_seconds": time.time() - started,
    }
    return write_manifest(stored, path, run, checksum=True)
