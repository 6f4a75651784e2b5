"""Document fingerprints: one-permutation MinHash, densified, low-order bits, no Python on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foldgraph.llm.common import let, shingle_hashes

#: Bins of the one permutation, and low-order bits kept of each bin's minimum. 128 bins
#: are the top 7 bits of a hash, and 8 bits two hex digits of the packed string.
BIN_BITS, BITS = 7, 8
BINS = 1 << BIN_BITS


def _bin(x: Column) -> Column:
    return F.shiftright(x, 64 - BIN_BITS)


def bin_values(shingles: Column) -> Column:
    """The kept bits of each bin, empty for no shingles.

    Every shingle is hashed once; the top bits of the hash are its bin and a
    bin keeps its least hash. An empty bin takes the value of the non-empty
    bin that comes first in an order of bins hashed from the empty bin's own
    number, which is what drawing bins at random until one is non-empty gives
    (optimal densification), without drawing one twice.
    """
    low = (1 << BITS) - 1

    def of(least: Column) -> Column:
        def borrowed(b: Column) -> Column:
            ranked = F.transform(least, lambda x: F.xxhash64(b, _bin(x)).bitwiseAND(F.lit(~low)).bitwiseOR(x.bitwiseAND(F.lit(low))))
            return F.array_min(ranked).bitwiseAND(F.lit(low))

        def dense(own: Column) -> Column:
            every = F.sequence(F.lit(-BINS // 2).cast("long"), F.lit(BINS // 2 - 1).cast("long"))
            return F.transform(every, lambda b: F.coalesce(F.try_element_at(own, b), borrowed(b)))

        filled = F.transform(least, lambda x: x.bitwiseAND(F.lit(low)))
        own = F.map_from_arrays(F.transform(least, _bin), filled)
        return F.when(F.size(least) == BINS, filled).when(F.size(least) == 0, least).otherwise(let(own, dense))

    def least_of_bins(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1))))

    return let(let(F.sort_array(shingles), least_of_bins), of)


def packed(values: Column) -> Column:
    """Bin values as a string of two hex digits each."""
    return F.array_join(F.transform(values, lambda v: F.lpad(F.lower(F.hex(v)), BITS // 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity: the share of equal bins, less the share that agrees by chance.

    1 for two texts without words, 0 if only one has none.
    """
    chance = 1.0 / (1 << BITS)
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(0)))
    corrected = F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(corrected)


def fingerprint(text: Column, size: int = 5) -> Column:
    """The packed fingerprint of a text's runs of ``size`` words; '' for no words."""
    return packed(bin_values(shingle_hashes(text, size)))


def with_openings(docs: DataFrame, rows_per_block: int = 512, max_blocks: int = 200_000) -> tuple[DataFrame, W]:
    """Rows and a window over which ``lead`` is the next row by descending doc_id, after the last the first.

    ``docs`` has doc_id and text. Rows of one doc_id follow each other by a
    hash of the text, so equal rows are neighbours in any order; rows without
    doc_id come last. One shuffle: rows go to blocks of consecutive ids, and
    every block also gets a copy (``_copy``) of the row that opens the block after it.
    Only block heads, at most ``2 * max_blocks`` pairs of numbers, are
    broadcast or ordered as one.
    """
    n, lo, hi = docs.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    blocks = min(max_blocks, max(1, n // rows_per_block))
    lo, hi = (0, 0) if lo is None else (lo, hi)
    width = (float(hi) - float(lo) + 1.0) / blocks
    hashed = F.xxhash64("text")
    block = F.when(F.col("doc_id").isNull(), -1 - F.pmod(hashed, F.lit(blocks))).otherwise(
        F.floor((F.col("doc_id").cast("double") - F.lit(float(lo))) / F.lit(width)).cast("long")
    )
    rows = docs.withColumn("_block", block).withColumn("_at", F.coalesce("doc_id", hashed))
    heads = rows.groupBy("_block").agg(F.max("_at").alias("_at"))
    down = W.orderBy(F.desc("_block"))
    last = W.partitionBy()
    targets = heads.select("_block", "_at", F.coalesce(F.lag("_block").over(down), F.min("_block").over(last)).alias("_target"))
    opening = rows.join(F.broadcast(targets), ["_block", "_at"]).withColumn(
        "_rank", F.row_number().over(W.partitionBy("_block").orderBy(hashed))
    )
    copies = opening.where("_rank = 1").withColumn("_block", F.col("_target")).drop("_rank", "_target")
    every = rows.withColumn("_copy", F.lit(False)).unionByName(copies.withColumn("_copy", F.lit(True)))
    return every, W.partitionBy("_block").orderBy("_copy", F.desc("_at"), hashed)


def edited_fingerprints(docs: DataFrame, size: int = 5) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The edited text has the last ``floor(n_chars / 3)`` code points replaced by
    the first as many (or all) of the next document by descending doc_id. Null
    texts are empty; an empty text has the fingerprint ''. A single document is
    its own next. Equal rows follow one another, rows without doc_id come last.
    Every row gives one row; only doc_id and text are read.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    every, order = with_openings(rows)
    lead = (
        every.withColumn("_bins", bin_values(shingle_hashes(F.col("text"), size)).cast("array<smallint>"))
        .select("doc_id", "text", "_bins", "_copy", F.lead("text").over(order).alias("_next"), F.lead("_bins").over(order).alias("_next_bins"))
        .where("not _copy")
    )
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("_next"), F.lit(1), cut))
    texts = lead.select("doc_id", n.cast("long").alias("n_chars"), "_bins", "_next_bins", edited.alias("_edited"))
    bins = texts.withColumn("_edited_bins", bin_values(shingle_hashes(F.col("_edited"), size)).cast("array<smallint>"))
    return bins.select(
        "doc_id", "n_chars", F.sha2(F.col("_edited"), 256).alias("edited_sha256"),
        packed(F.col("_bins")).alias("fingerprint"), packed(F.col("_edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("_bins"), F.col("_edited_bins")).alias("near_edited"),
        likeness(F.col("_bins"), F.col("_next_bins")).alias("near_next"),
    )
