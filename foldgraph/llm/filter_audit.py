"""How filters interact: what each removes, alone and after the others, in every order."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from foldgraph.llm.common import written
from foldgraph.llm.periodic import words_of


def _few_words(text: Column) -> Column:
    return F.size(words_of(text)) < 100


def _same_words(text: Column) -> Column:
    words = words_of(text)
    return 100 * F.size(F.array_distinct(words)) < 80 * F.size(words)


def _capitals(text: Column) -> Column:
    return 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text)


def _symbols(text: Column) -> Column:
    return text.rlike("[#$%&*|]")


#: Failure conditions of a text that is not null, by letter; a further one is added for repeated texts.
FILTERS: dict[str, Callable[[Column], Column]] = {"A": _few_words, "B": _same_words, "C": _capitals, "D": _symbols}


def repeated(docs: DataFrame, narrow: DataFrame, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, part, hash of the rows whose text a smaller doc_id has too, letter for letter.

    ``narrow`` has doc_id, part and hash (``key`` of the text) of every row. Texts
    meet once, grouped by hash and whole text, combined before the shuffle; each
    gives its least doc_id. Where a hash stands for one text, which is then
    proven by the texts themselves, the rows with a larger doc_id are found by
    a left semi-join of the narrow rows; where several texts share a hash, the
    semi-join compares the texts as well.
    """
    texts = docs.select("doc_id", "part", "text", key(F.col("text")).alias("hash"))
    least = texts.groupBy("hash", "text").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    by_hash = written(least.groupBy("hash").agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("texts"), F.max("n").alias("n")).where("n > 1 or texts > 1"))
    later = (F.col("l.hash") == F.col("r.hash")) & (F.col("r.least") < F.col("l.doc_id"))
    found = narrow.alias("l").join(by_hash.where("texts = 1").alias("r"), later, "left_semi").select("doc_id", "part", "hash")
    shared = by_hash.where("texts > 1").select("hash")
    if shared.isEmpty():
        return found
    clash = written(texts.join(shared, "hash", "left_semi"))
    owners = clash.groupBy("hash", "text").agg(F.min("doc_id").alias("least"))
    exact = later & (F.col("l.text") == F.col("r.text"))
    return found.unionByName(clash.alias("l").join(owners.alias("r"), exact, "left_semi").select("doc_id", "part", "hash"))


def combinations(
    docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column], Column]], *, part: str = "lang", key: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """part, bits, quality, toxic, n: how many rows of a part fail just the filters of ``bits``.

    Bit i is the i-th filter; the bit after them is the filter of repeated
    texts: a smaller doc_id has the same text. Each row's failures, and the
    rows that fail the last filter (:func:`repeated`), are united and added up
    to one combination a document, then counted. ``quality`` and ``toxic`` say
    whether ``labels`` has a row of the doc_id with that value 1.

    A null text is an empty one; a null ``part`` is the empty string. A row
    without doc_id counts, but repeats nothing and has no labels. Rows that
    share doc_id, part and text count each; they repeat each other's text only
    if a smaller doc_id has it. Different texts of one doc_id and part are told
    apart by ``key``, 64 bits by default. Empty tables give no rows. Only narrow rows,
    and each text once a task, are shuffled.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    bits = F.lit(0)
    for i, fails in enumerate(filters.values()):
        bits = bits + F.when(fails(F.col("text")), F.lit(1 << i)).otherwise(F.lit(0))
    narrow = written(given.select("doc_id", "part", key(F.col("text")).alias("hash"), bits.alias("bits")))
    again = repeated(given, narrow, key).withColumn("bits", F.lit(1 << len(filters))).withColumn("n", F.lit(0).cast("long"))
    failures = narrow.withColumn("n", F.lit(1).cast("long")).unionByName(again)
    # A doc_id that is null stands for many documents: only counts are kept of them, and they never meet a repeat.
    one = failures.groupBy("doc_id", "part", "hash").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("quality"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    marked = one.join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("quality", "toxic")})
    return marked.groupBy("part", "bits", "quality", "toxic").agg(F.sum("n").alias("n"))


def interactions(combos: DataFrame, letters: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: every order of the filters, step by step.

    ``letters`` names the bits of ``combos`` (:func:`combinations`). A filter
    removes what fails it and no earlier one; what an earlier one removed
    already is redundant. ``shapley`` adds up a filter's removals over all
    orders: of the n! orders, a document with k failures is removed by each of
    its filters in n!/k. Parts are rows; a part has a row for each order and
    step, zeros included.
    """
    orders, steps = list(permutations(range(len(letters)))), []
    for order in orders:
        before = 0
        for step, f in enumerate(order, start=1):
            steps.append(f"{''.join(letters[i] for i in order)},{step},{1 << f},{before}")
            before |= 1 << f
    every = combos.withColumn("g", F.explode(F.split(F.lit(" ".join(steps)), " "))).withColumn("g", F.split("g", ",")).select(
        "*", F.col("g")[0].alias("filter_order"), F.col("g")[1].cast("int").alias("step"), F.col("g")[2].cast("int").alias("f"), F.col("g")[3].cast("int").alias("before")
    )
    fails = F.col("bits").bitwiseAND(F.col("f")) != 0
    there = F.col("bits").bitwiseAND(F.col("before")) == 0
    share = F.expr(f"n * {len(orders)} div bit_count(bits)")

    def total(when: Column, value: Column | None = None) -> Column:
        return F.sum(F.when(when, F.col("n") if value is None else value).otherwise(F.lit(0).cast("long")))

    return every.groupBy("part", "filter_order", "step").agg(
        total(there & ~fails).alias("kept"), total(there & fails).alias("removed"), total(~there & fails).alias("redundant"),
        total(F.col("bits") == F.col("f")).alias("unique_fails"), total(there & fails & F.col("quality")).alias("good_lost"),
        total(there & fails & F.col("toxic")).alias("toxic_lost"), total(fails, share).alias("shapley"),
    )
