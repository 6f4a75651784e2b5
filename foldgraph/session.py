"""Scratch space, complete lookups and row numbering."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder under the shared folder named by ``spark.checkpoint.dir``.

    Where the setting is absent, a local master gets a temporary folder of its
    own; a cluster without the setting is an error, since a machine-local
    folder would be lost with its machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="foldgraph-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/foldgraph-{uuid.uuid4().hex}"


#: Bytes of rows that go to a Python worker at once, and Spark's own limit, which stands for none chosen.
BATCH_BYTES, UNCHOSEN = "1m", "67108864b"


def bound_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session sends rows to Python workers a megabyte at a time, unless it has a limit of its own.

    A molecule's arrays are some thirty times as long as its record. In batches of 10,000 such rows, each step of a task holds
    a batch on either side, and the rows that wait for their results are written to disk.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, UNCHOSEN) == UNCHOSEN:
        conf.set(key, BATCH_BYTES)
    return df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(scratch_dir(df.sparkSession))
    return df.checkpoint()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a scratch table on the shared folder and read it back.

    For a result that several later steps read in part: unlike a checkpoint,
    the table can be read column by column.
    """
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def looked_up(df: DataFrame, side: DataFrame, keys: list[str], found: str) -> DataFrame:
    """Join ``side``, which must know every row's keys: a row it does not know is an error, never left out.

    Spark broadcasts ``side`` below its size threshold and shuffles beyond it.
    """
    joined = df.join(side, keys, "left")
    missing = F.raise_error(F.concat(F.lit("no entry for "), F.to_json(F.struct(*keys)))).cast("long")
    return joined.withColumn(found, F.coalesce(F.col(found), missing))


def number_rows(df: DataFrame, name: str, file: str | None = None) -> DataFrame:
    """Add a dense 0-based number in partition order, without sorting anything.

    The rows are written to shared scratch with their partition, so counting
    and numbering see the same partitions whatever executors come and go. A
    row's number is its place in its partition plus the rows of the partitions
    before it. With ``file``, the column of a source path whose files are each
    read by one task, files follow each other by path instead.
    """
    group = F.shiftright("_mono", 33) if file is None else F.col(file)
    tagged = materialize(df.withColumn("_mono", F.monotonically_increasing_id()).withColumn("_group", group))
    counts = tagged.groupBy("_group").agg(F.count(F.lit(1)).alias("n"), F.min("_mono").alias("first")).collect()
    shifts, total = [], 0
    for row in sorted(counts, key=lambda r: r._group):
        shifts.append((row._group, total - row.first))
        total += row.n
    kind = "long" if file is None else "string"
    side = df.sparkSession.createDataFrame(shifts, f"_group {kind}, _shift long")
    numbered = looked_up(tagged, side, ["_group"], "_shift")
    return numbered.withColumn(name, F.col("_mono") + F.col("_shift")).drop("_mono", "_group", "_shift")


def spread(df: DataFrame) -> DataFrame:
    """Redistribute a source that has fewer partitions than there are cores.

    Everything from records to embeddings is narrow, so a source in one small
    file would run on one core. A source with enough splits is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df
