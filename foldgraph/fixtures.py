"""Molecules derived from the supplied ``documents`` table.

The whole text of every document is used: its ASCII letters become bases and
are cut into consecutive pieces of at most ``piece`` nt, one molecule each.
The structure of a piece repeats a unit of two hairpins inside a helix, and
longer pieces are closed by a helix over their full length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foldgraph.functions.text import base_pieces
from foldgraph.session import spread
from foldgraph.spec import EncoderShape

PIECE = 400


def rna(spark: SparkSession, sf_dir: str, piece: int = PIECE) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = documents.select("doc_id", base_pieces("text", piece).alias("bits")).select("doc_id", F.posexplode("bits").alias("piece", "sequence"))
    # Pieces, not documents, are spread: one document may hold much of all text.
    sized = spread(pieces).select(
        "doc_id",
        "piece",
        "sequence",
        F.length("sequence").alias("n"),
        F.expr("cast(4 + (doc_id + piece) % 5 as int)").alias("stem"),
        F.expr("cast(doc_id % 3 as int)").alias("helix"),
        F.expr("case when length(sequence) >= 60 then 3 else 0 end").alias("closing"),
    )
    hairpin = "repeat('(', stem) || '....' || repeat(')', stem)"
    unit = f"repeat('(', helix) || '.' || {hairpin} || {hairpin} || repeat(')', helix) || '...'"
    inner = f"rpad(repeat({unit}, (n - 2 * closing) div (2 * helix + 4 * stem + 12)), n - 2 * closing, '.')"
    return sized.select(
        "doc_id",
        "piece",
        F.expr("cast(doc_id * 65536 + piece as bigint)").alias("row_ord"),
        F.expr("'rna-' || doc_id || '-' || piece").alias("transcript_id"),
        "sequence",
        F.expr(f"repeat('(', closing) || {inner} || repeat(')', closing)").alias("secondary_structure"),
    )


def rna_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the longer molecules list one window, the others two; short ones none."""
    base = rna(spark, sf_dir).withColumn("n", F.length("sequence")).withColumn("q", F.expr("n div 4"))
    one = "(doc_id + piece) % 2 = 0"
    return base.select(
        "row_ord", "transcript_id", "sequence", "secondary_structure",
        F.expr(f"case when n < 20 then '' when {one} then cast(q as string) else q || ',' || (q + 3) end").alias("start"),
        F.expr(f"case when n < 20 then '' when {one} then cast(q + 11 as string) else (q + 9) || ', ' || n end").alias("end"),
    )


def rna_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every molecule, most of them damaged in one of several ways by ``k``."""
    base = rna(spark, sf_dir).withColumn("k", F.expr("(doc_id + piece) % 11"))
    return base.select(
        "row_ord",
        F.expr("case k when 5 then 'rna-dup' when 7 then '  ' when 8 then 'a' || chr(9) || transcript_id else transcript_id end").alias("transcript_id"),
        F.expr(
            "case k when 1 then substr(sequence, 1, length(sequence) - 1) || 'N' "
            "when 6 then ' ' || lower(replace(sequence, 'U', 'T')) || ' ' when 9 then ' ' else sequence end"
        ).alias("sequence"),
        F.expr(
            "case k when 2 then substr(secondary_structure, 2) when 3 then ')' || substr(secondary_structure, 2) "
            "when 4 then substr(secondary_structure, 1, length(secondary_structure) - 1) || '(' "
            "when 10 then replace(secondary_structure, '....', '.[].') else secondary_structure end"
        ).alias("secondary_structure"),
    )


def weights_from_embeddings(spark: SparkSession, sf_dir: str, shape: EncoderShape) -> DataFrame:
    """A weight table made of all supplied ``embeddings``, in steps of 1/64 from -1 up to 1.

    The vectors, in steps of 1/64, are added up in as many slots as the tensors
    have rows (or as there are vectors, if fewer), by their id, and each sum is
    taken modulo 128 steps. A row takes the slot of its number in the whole
    table of rows; wider rows repeat it. Gains are 1 and variances positive.
    """
    sizes, first = [], 0
    for name, (rows, width) in shape.tensors().items():
        sizes.append((name, first, rows, width))
        first += rows
    table = spark.createDataFrame(sizes, "tensor string, first long, rows int, width int")
    table = table.select("tensor", "first", "width", F.explode(F.expr("sequence(0, rows - 1)")).alias("row"))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    slots = min(first, vectors.count())
    cells = vectors.select(F.expr(f"vec_id % {slots}").alias("slot"), F.posexplode("embedding").alias("c", "x"))
    sums = cells.groupBy("slot", "c").agg(F.expr("pmod(sum(cast(round(x * 64) as bigint)) + 64, 128) - 64").alias("steps"))
    held = sums.groupBy("slot").agg(F.expr("transform(array_sort(collect_list(struct(c, steps))), x -> x.steps)").alias("steps"))
    value = F.expr(
        "transform(sequence(0, width - 1), c -> cast(case "
        "when tensor like '%mlp.1.weight' or tensor like 'norms.%.weight' then 1 "
        "when tensor like '%.running_var' then 1 + abs(steps[c % size(steps)]) / 64 "
        "else steps[c % size(steps)] / 64 end as float))"
    )
    return table.withColumn("slot", F.expr(f"(first + row) % {slots}")).join(held, "slot").select("tensor", "row", value.alias("values"))


def write_table(rows: DataFrame, path: str, delimiter: str = "\t") -> str:
    """Rows as delimited text with a header in every file; blank cells stay blank."""
    rows.write.option("sep", delimiter).option("header", True).option("emptyValue", "").csv(path)
    return path
