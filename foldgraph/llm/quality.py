"""Quality rules as a short-circuit cascade, ordered by rejection per cost on a sample."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from foldgraph.llm.common import BLANKS, let, written
from foldgraph.llm.periodic import words_of

WORD_CHAR = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Rule:
    """A document fails if ``fails`` is true; it may read text, words and the measures."""

    name: str
    fails: Column


def repeated_words(words: Column, width: int = 3) -> Column:
    """How many words lie in a run of ``width`` words that the text holds twice or more, the first included.

    Runs are compared by 64-bit hashes. Where no hash repeats the answer is 0;
    else hashes are sorted with their places, and the places of repeated ones
    are joined to stretches.
    """
    n = F.size(words) - (width - 1)
    columns = [F.slice(words, F.lit(i + 1), n).alias(f"w{i}") for i in range(width)]
    hashes = F.transform(F.arrays_zip(*columns), lambda z: F.xxhash64(*[z[f"w{i}"] for i in range(width)]))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(placed, lambda s: F.aggregate(
            F.sort_array(F.transform(
                F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))),
                lambda x: x["i"],
            )),
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda acc, i: F.struct((acc["n"] + i + width - F.greatest(i, acc["end"])).alias("n"), (i + width).alias("end")),
            lambda acc: acc["n"],
        ))

    return F.when(n < 2, 0).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of every row.

    Words are ``[^\\x20\\x09-\\x0D]+``, lines are split at line feeds and count if
    they hold a word. ``n_dup_lines`` are equal to an earlier line; characters
    are code points. A null text has none of it.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    parts = docs.select("doc_id", text.alias("text"), words_of(F.col("text").cast("string")).alias("words"), lines.alias("lines"))
    return parts.select(
        "doc_id", "text", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )


def rules() -> list[Rule]:
    """The rules beyond the base conditions, for documents of :func:`measured`."""
    n = F.col("n_words")
    return [
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
        Rule("symbols", 100 * F.col("n_symbols") > 25 * n),
        Rule("equal_lines", 100 * F.col("n_dup_lines") > 50 * F.col("n_lines")),
        Rule("capitals", 2 * F.regexp_count("text", F.lit(r"\p{Lu}")) > F.col("word_chars")),
        Rule("letters", 10 * F.length(F.regexp_replace("text", r"\P{L}+", "")) < 5 * F.col("word_chars")),
        Rule("ellipsis", 100 * F.regexp_count("text", F.lit(r"(?:\.\.\.|…)[ \t\r]*(?:\n|\z)")) > 30 * F.col("n_lines")),
    ]


def by_rejection_per_cost(sample: DataFrame, candidates: list[Rule], clock: Callable[[], float] = time.perf_counter, rounds: int = 2) -> list[Rule]:
    """``candidates``, the one that rejects most of the remaining sample per second first, and so on.

    A rule's cost is the time to judge the whole sample by it, the least of
    ``rounds``, less that of a rule that looks at nothing. Its rejection is
    counted among the rows that the rules before it leave. Both only set the
    order of work: the documents that some rule rejects are the same in any.
    """
    def seconds(fails: Column) -> float:
        took = []
        for _ in range(rounds):
            began = clock()
            sample.agg(F.count_if(fails)).collect()
            took.append(clock() - began)
        return min(took)

    idle = seconds(F.col("n_words") < 0)
    cost = {r.name: max(seconds(r.fails) - idle, 1e-4) for r in candidates}
    bits = sum((F.when(r.fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(candidates)), F.lit(0))
    left = {row.bits: row.n for row in sample.groupBy(bits.alias("bits")).agg(F.count(F.lit(1)).alias("n")).collect()}
    number, ordered = {r.name: i for i, r in enumerate(candidates)}, []
    while len(ordered) < len(candidates):
        rest = [r for r in candidates if r not in ordered]
        best = max(rest, key=lambda r: sum(n for b, n in left.items() if b >> number[r.name] & 1) / cost[r.name])
        ordered.append(best)
        left = {b: n for b, n in left.items() if not b >> number[best.name] & 1}
    return ordered


def cascade(ordered: list[Rule]) -> Column:
    """The name of the first rule that a document fails, null if none; later rules are not looked at."""
    verdict = F.when(F.coalesce(ordered[0].fails, F.lit(False)), ordered[0].name)
    for r in ordered[1:]:
        verdict = verdict.when(F.coalesce(r.fails, F.lit(False)), r.name)
    return verdict


def judge_quality(docs: DataFrame, *, min_words: int = 50, max_repeated: int = 50, candidates: list[Rule] | None = None, sample_rows: int = 2000) -> DataFrame:
    """doc_id, the measures (:func:`measured`), base_failed and kept of every row.

    ``base_failed``: under ``min_words`` words, or more than ``max_repeated`` of
    a hundred words repeated. Other documents go through a cascade of rules
    (:func:`cascade`), of which an expensive one is evaluated only where the
    ones before it found nothing; ``kept`` is whether none did. The order is
    set on a sample of about ``sample_rows`` rows, by a hash of the text's
    length and doc_id (:func:`by_rejection_per_cost`); it changes the work, never the verdict.

    One pass over whole texts in generated code, without a shuffle. A null or
    empty text has no words and fails. Rows are judged one by one: repeated
    rows, ties and null doc_ids change nothing. An empty table gives no rows.
    Only doc_id and text are read.
    """
    chosen = candidates if candidates is not None else rules()
    every = measured(docs)
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    rows = docs.count()
    picked = docs.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(max(1, rows // sample_rows))) == 0) if rows > sample_rows else docs
    sample = written(measured(picked).where(~base))
    ordered = by_rejection_per_cost(sample, chosen)
    return every.withColumn("base_failed", base).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(F.col("base_failed"), False).otherwise(cascade(ordered).isNull()).alias("kept"),
    )
