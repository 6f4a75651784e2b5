"""N-gram Jaccard join by chosen paths: sets are split on sampled shared tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foldgraph.llm.common import components, list_column, shingle_hashes, stream_groups, written


def _chosen(tokens: Column, rank, size: Column, expected: float) -> Column:
    """Tokens whose rank, uniform over the longs, is among the lowest ``expected / size`` share.

    A token shared by two sets is chosen by both if it is chosen by the larger.
    """
    share = F.least(F.lit(1.0), F.lit(expected) / size)
    cutoff = (share * F.lit(2.0**64) - F.lit(2.0**63)).cast("double")
    return F.filter(tokens, lambda t: rank(t).cast("double") < cutoff)


def _buckets(rows: DataFrame) -> DataFrame:
    """(bucket, set, size, members) of the buckets that hold two sets or more."""
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return rows.join(counts, "bucket")


def leaf_buckets(chosen: DataFrame, whole_sets, threshold: float, small: int, depth: int, again: float) -> DataFrame:
    """Buckets (bucket, set, size, members) that need no further split.

    A bucket of at most ``small`` sets is done. The sets of a larger one choose
    further tokens, by a hash of the path so far, and meet again under the
    longer path; ``whole_sets`` gives their tokens. What is still large after
    ``depth`` splits consists of sets that share most of what they have, and
    is done too: it is compared in blocks, whole. A split loses a pair at the
    threshold from its bucket with probability ``exp(-again)``.
    """
    level = written(_buckets(chosen))
    done, sets = [level.where(F.col("members") <= small)], None
    for _ in range(depth):
        large = level.where(F.col("members") > small)
        if large.isEmpty():
            return _union(done)
        if sets is None:
            sets = whole_sets(large).select("set", "tokens")
        path = F.col("bucket")
        child = F.explode(_chosen(F.col("tokens"), lambda t: F.xxhash64(t, path), F.col("size"), again / threshold))
        deeper = large.select("bucket", "set", "size").join(sets, "set").select("set", "size", F.col("bucket").alias("above"), child.alias("token"))
        level = written(_buckets(deeper.select(F.xxhash64("above", "token").alias("bucket"), "set", "size")))
        done.append(level.where(F.col("members") <= small))
    done.append(level.where(F.col("members") > small))
    return _union(done)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class _Group:
    """The sets of one bucket, or of two blocks of a bucket, by some of their tokens or all."""

    def __init__(self, table: pa.Table, tokens: str):
        self.set = table.column("set").to_numpy()
        self.size = table.column("size").to_numpy().astype(np.int64)
        self.block = table.column("block").to_numpy()
        self.at, self.tokens = list_column(table, tokens)
        self.leaf_at, self.leaves = list_column(table, "leaves")
        self.bucket = int(table.column("bucket")[0].as_py())
        self.two = bool(table.column("i")[0].as_py() != table.column("j")[0].as_py())

    def pairs(self, threshold: float, enough) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of which this bucket is the least that both are in, of sizes that can be similar, whose shared tokens are ``enough``."""
        return self._few(threshold, enough) if len(self.set) <= 24 else self._many(threshold, enough)

    def _few(self, threshold: float, enough) -> tuple[np.ndarray, np.ndarray]:
        left, right = [], []
        leaves = [self.leaves[a:b] for a, b in zip(self.leaf_at, self.leaf_at[1:])]
        low = [set(x[x < self.bucket].tolist()) for x in leaves]
        tokens = [self.tokens[a:b] for a, b in zip(self.at, self.at[1:])]
        size = self.size.tolist()
        for x in range(len(size)):
            for y in range(x + 1, len(size)):
                small, large = (size[x], size[y]) if size[x] < size[y] else (size[y], size[x])
                if small < threshold * large or (self.two and self.block[x] == self.block[y]) or not low[x].isdisjoint(low[y]):
                    continue
                if enough(len(np.intersect1d(tokens[x], tokens[y], assume_unique=True)), small, large):
                    left.append(x)
                    right.append(y)
        return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)

    def _many(self, threshold: float, enough) -> tuple[np.ndarray, np.ndarray]:
        m = len(self.set)
        earlier = self.leaves < self.bucket
        owner = np.repeat(np.arange(m), np.diff(self.leaf_at))
        open_ = self._shared(self.leaves[earlier], owner[earlier]) == 0
        small, large = np.minimum.outer(self.size, self.size), np.maximum.outer(self.size, self.size)
        open_ &= small >= threshold * large
        open_ &= np.triu(np.ones((m, m), dtype=bool), 1)
        if self.two:
            open_ &= self.block[:, None] != self.block[None, :]
        if not open_.any():
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        both = self._shared(self.tokens, np.repeat(np.arange(m), np.diff(self.at)))
        return np.nonzero(open_ & enough(both, small, large))

    def _shared(self, values: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """How many values each two sets share, some thousand values at a time."""
        m = len(self.set)
        out = np.zeros((m, m), dtype=np.float32)
        _, column, count = np.unique(values, return_inverse=True, return_counts=True)
        shared = count > 1
        number = np.cumsum(shared) - 1
        keep = shared[column]
        column, owner = number[column[keep]], owner[keep]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        columns = int(shared.sum())
        width = min(2048, columns)
        for first in range(0, columns, max(1, width)):
            a, b = np.searchsorted(column, [first, first + width])
            x = np.zeros((m, width), dtype=np.float32)
            x[owner[a:b], column[a:b] - first] = 1
            out += x @ x.T
        return out


def _promising(batches: Iterator[pa.RecordBatch], threshold: float, low: int) -> Iterator[pa.RecordBatch]:
    """Rows of the sets with a pair here that their least hashes do not rule out.

    Of the ``low`` least hashes of two sets' union, the share in both estimates
    their similarity, and those are among the ``low`` least of each. Half the
    threshold is five standard deviations off for 32 hashes.
    """
    for table in stream_groups(batches, "bucket", "i", "j"):
        x, y = _Group(table, "low").pairs(threshold, lambda both, small, large: both >= threshold / 2 * np.minimum(low, large))
        if len(x):
            yield from table.select(["bucket", "i", "j", "block", "set", "size", "leaves"]).take(np.unique(np.concatenate([x, y]))).combine_chunks().to_batches()


def _verified(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """For each set with a link here: its links, their documents, and the least set it is tied to here."""
    for table in stream_groups(batches, "bucket", "i", "j"):
        group, copies = _Group(table, "tokens"), table.column("copies").to_numpy()
        x, y = group.pairs(threshold, lambda both, small, large: both >= threshold * (small + large - both))
        if not len(x):
            continue
        m = len(group.set)
        texts = np.bincount(x, minlength=m) + np.bincount(y, minlength=m)
        documents = np.bincount(x, weights=copies[y], minlength=m) + np.bincount(y, weights=copies[x], minlength=m)
        root = group.set.copy()
        while True:  # the least set spreads over the links
            before = root.copy()
            np.minimum.at(root, x, root[y])
            np.minimum.at(root, y, root[x])
            if (before == root).all():
                break
        linked = texts > 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(group.set[linked]), pa.array(root[linked]), pa.array(texts[linked].astype(np.int64)), pa.array(documents[linked].astype(np.int64))],
            names=["set", "root", "texts", "documents"],
        )


def jaccard_join(
    docs: DataFrame, *, size: int = 5, threshold: float = 0.8, runs: int = 9, small: int = 4096, depth: int = 3, again: float = 2.5, block: int = 1024,
    low: int = 32,
) -> DataFrame:
    """doc_id, class_id, n_links, n_texts, class_key, text_hash of every row: near-duplicate classes by Jaccard similarity of word runs.

    Two texts are linked if the sets of their runs of ``size`` words (a shorter
    text is one run) have a similarity of ``threshold`` or more. ``class_id``
    is the least doc_id that a row is connected to by links, ``n_links`` the
    number of other documents linked to it directly, ``n_texts`` the number
    of different texts among them besides its own. ``class_key`` names the
    class by its texts, ``text_hash`` (XXH64) the row's text.

    Chosen paths: of a set with n tokens, those in the lowest ``runs /
    (threshold * n)`` share of their hashes are chosen; this is ``runs``
    independent samplings at once, and two similar sets meet in at least one
    bucket with probability ``1 - exp(-runs)``. Large buckets split again by
    further tokens (:func:`leaf_buckets`), which costs a pair at the threshold
    some of its buckets: where all of them split ``depth`` = 3 times, it still
    meets with probability ``1 - exp(-8)``. A pair that meets in many buckets
    counts only in the least of them. There, the ``low`` least hashes of both
    rule out most pairs that merely share a passage, and the rest are compared
    by their whole sets, which only then are fetched. Nothing is capped: a bucket that cannot be split is
    compared in blocks of ``block`` sets.

    Equal sets are one class from the start and travel once, so a text copied
    into a third of all rows is one set. No list of pairs is made: a task adds
    up links and keeps one tie a set; classes are the ties' components.

    Texts without words have no runs and link to nothing; rows without doc_id
    cannot be named, link to nothing and have a null class. Rows that repeat a
    doc_id with different texts are different documents: their classes may
    share a ``class_id``, not a ``class_key``. Only doc_id and text are read.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tokens = F.sort_array(F.array_distinct(shingle_hashes(F.col("text"), size)))
    hashed = named.withColumn("tokens", tokens)
    set_key = F.when((F.size("tokens") > 0) & F.col("doc_id").isNotNull(), F.xxhash64("tokens"))
    first = _chosen(F.col("tokens"), lambda t: t, F.col("size"), runs / threshold)
    members = written(
        hashed.select("doc_id", set_key.alias("set"), F.size("tokens").alias("size"), "tokens", F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
        .withColumn("first", first)
        .withColumn("low", F.slice("tokens", 1, low)).drop("tokens")
    )
    named_sets = members.where("set is not null")
    distinct = named_sets.groupBy("set").agg(F.min("doc_id").alias("name"), F.count(F.lit(1)).alias("copies"), F.min("size").alias("size"))
    chosen = named_sets.select("set", "size", F.explode("first").alias("bucket")).distinct()

    def whole_sets(wanted: DataFrame) -> DataFrame:
        """(set, name, copies, tokens) of the wanted sets, from one document's text each."""
        names = wanted.select("set").distinct().join(distinct, "set").select(F.col("name").alias("doc_id"), "set", "name", "copies")
        sets = written(named.join(names, "doc_id").select("set", "name", "copies", tokens.alias("tokens")))
        if sets.count() > sets.select("set").distinct().count():  # a doc_id that stands for several rows
            sets = written(sets.where(F.col("set") == F.xxhash64("tokens")).dropDuplicates(["set"]))
        return sets

    leaves = written(leaf_buckets(chosen, whole_sets, threshold, small, depth, again))
    in_leaves = leaves.groupBy("set").agg(F.sort_array(F.collect_set("bucket")).alias("leaves"))
    known = named_sets.select("set", "low").join(in_leaves, "set").dropDuplicates(["set"])
    blocks = F.ceil(F.col("members") / block).cast("int")
    mine = F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int")
    placed = (
        leaves.withColumn("blocks", blocks).withColumn("block", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", "set", "size", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    open_rows = dealt(placed.join(known, "set").select("bucket", "i", "j", "block", "set", "size", "leaves", "low"))
    promising = written(
        open_rows.mapInArrow(lambda batches: _promising(batches, threshold, low), "bucket long, i int, j int, block int, set long, size int, leaves array<long>")
    )
    rows = dealt(promising.join(whole_sets(promising), "set").select("bucket", "i", "j", "block", "set", "name", "size", "copies", "tokens", "leaves"))
    found = written(rows.mapInArrow(lambda batches: _verified(batches, threshold), "set long, root long, texts long, documents long"))

    classes = components(found.select(F.col("set").alias("a"), F.col("root").alias("b")))
    tied = classes.select("node", "root").unionByName(classes.select(F.col("root").alias("node"), "root").distinct())
    named_classes = tied.join(distinct, F.col("node") == F.col("set")).groupBy("root").agg(F.min("name").alias("class_id"))
    in_class = tied.join(named_classes, "root").select("node", "root", "class_id")
    links = found.groupBy("set").agg(F.sum("texts").alias("texts"), F.sum("documents").alias("documents"))
    by_set = (
        distinct.join(links, "set", "left").join(in_class, F.col("set") == F.col("node"), "left")
        .select("set", F.coalesce("class_id", "name").alias("class_id"), F.coalesce("root", "set").alias("class_key"),
                (F.coalesce("documents", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_texts"))
    )
    zero = F.lit(0).cast("long")
    return members.select("doc_id", "set", "text_hash").join(by_set, "set", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", zero).alias("n_links"), F.coalesce("n_texts", zero).alias("n_texts"),
        "class_key", "text_hash",
    )


def keep_first(docs: DataFrame, joined: DataFrame) -> DataFrame:
    """One row of each class: that of least doc_id and, among its texts, of least hash; of rows that repeat both, the least by its columns.

    Rows without doc_id, and without words unless they repeat doc_id and text, stay.
    """
    document = ["doc_id", "text_hash"]
    rows = joined.where("doc_id is not null").groupBy("class_key", *document).agg(F.count(F.lit(1)).alias("n"))
    first = rows.where("class_key is not null").groupBy("class_key").agg(F.min(F.struct(*document)).alias("first"), F.count(F.lit(1)).alias("texts")).where("texts > 1")
    gone = rows.join(first, "class_key").where(F.struct(*document) != F.col("first")).select(F.col("doc_id").alias("__llm_id"), F.col("text_hash").alias("__llm_hash"))
    named = (F.col("doc_id").cast("long") == F.col("__llm_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__llm_hash"))
    left = docs.join(gone, named, "left_anti")
    repeated = rows.where("n > 1").select(F.col("doc_id").alias("__llm_id"), F.col("text_hash").alias("__llm_hash"))
    if repeated.isEmpty():
        return left
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = left.join(repeated, named, "left_semi").groupBy(F.col("doc_id").alias("__llm_id"), F.xxhash64(F.col("text").cast("string")).alias("__llm_hash"))
    one = again.agg(F.min_by(every, F.to_json(every)).alias("__llm_r")).select("__llm_r.*")
    return left.join(repeated, named, "left_anti").unionByName(one)
