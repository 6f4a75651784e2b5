"""What several operators share: scratch tables, word hashes, streamed groups, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BLANKS = " \t\n\x0b\f\r"


def scratch_path(spark: SparkSession) -> str:
    """A fresh folder in the shared folder that ``spark.checkpoint.dir`` names.

    Only where the setting is absent, and only on a local master, is one chosen here.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to shared scratch and read it back: its lineage ends here and survives lost executors."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body's lambdas read it."""
    return F.transform(F.array(value), body)[0]


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-case words between blanks; null text has no words."""
    clean = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(BLANKS))
    return F.when(F.length(clean) == 0, F.array().cast("array<long>")).otherwise(
        F.transform(F.split(clean, r"\s+"), lambda w: F.xxhash64(w))
    )


def shingle_hashes(text: Column, size: int = 5) -> Column:
    """A hash for each run of ``size`` words, repeats included; a shorter text is one run, no words are none."""

    def runs(h: Column) -> Column:
        long = F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(size)]))
        return F.when(F.size(h) == 0, h).when(F.size(h) < size, F.array(F.xxhash64(h))).otherwise(long)

    return let(word_hashes(text), runs)


def stream_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The groups of equal ``keys`` of sorted batches, one table each; only one group and batch are held."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        values = [table.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(table.num_rows, dtype=bool)
        for v in values:
            new[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), table.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            key = tuple(v[a] for v in values)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            last = key
            held.append(table.slice(a, b - a))
    if held:
        yield pa.concat_tables(held)


def list_column(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and flat values of a list column."""
    column = table.column(name).combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.flatten().to_numpy(zero_copy_only=False)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b): ``root`` is the least node it is connected to.

    Alternates two steps over distinct edges until nothing changes: every
    node's larger neighbours are tied to its least neighbour, then its smaller
    ones are. Edges are pre-aggregated to one minimum per node, and each round
    is written to shared scratch, so a lost executor repeats one round at most.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # Larger neighbours to the least one.
        wide = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Smaller neighbours to the least one.
        low = wide.groupBy("a").agg(F.min("b").alias("m"))
        tied = wide.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        following = written(tied.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        done = following.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        before = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        edges = following
        if done == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def worker_state(name: str, make: Callable[[], object]) -> object:
    """``make()``, once for each Python worker process and name.

    Functions travel to the workers by value, with their own copy of a
    module's variables each time; what must last from task to task is kept
    with the interpreter.
    """
    import sys
    import types

    home = sys.modules.setdefault("_worker_state", types.ModuleType("_worker_state"))
    if name not in home.__dict__:
        home.__dict__[name] = make()
    return home.__dict__[name]
