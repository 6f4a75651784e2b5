"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foldgraph.llm.common import written

UNKNOWN = "und"
#: Runs of letters, of any script.
LETTERS = r"[^\W\d_]+"
#: Word scores remembered by a worker; beyond it the memory starts anew.
MEMORY = 500_000
#: Documents whose words are scored together.
SLICE = 500


class Model:
    """Log frequencies of words and of character n-grams by language, of bounded size."""

    def __init__(self, langs: list[str], words: dict[str, np.ndarray], grams: dict[str, np.ndarray], floor: np.ndarray, longest: int):
        self.langs, self.words, self.longest = langs, words, longest
        # Row 0 is the floor; an n-gram shorter than the longest counts for less.
        self.rows = {g: i for i, g in enumerate(grams, 1)}
        self.table = np.stack([floor, *(v * (len(g) / longest) for g, v in grams.items())])

    def scores(self, words: list[str]) -> np.ndarray:
        """A row of per-language scores for each word: its own log frequency if known, else by backoff.

        An unknown word, marked at both ends, is read from the left: the longest
        known n-gram at each place counts, each step down to a shorter one
        leaving less of it, and a letter that no language has counts as the floor.
        """
        get, longest = self.rows.get, self.longest
        flat: list[int] = []
        starts, unknown = [], []
        for w, word in enumerate(words):
            if word in self.words:
                continue
            unknown.append(w)
            starts.append(len(flat))
            marked = f"<{word}>"
            for at in range(max(1, len(marked) - longest + 1)):
                row = get(marked[at : at + longest])
                shorter = longest - 1
                while row is None and shorter:
                    row = get(marked[at : at + shorter])
                    shorter -= 1
                flat.append(row or 0)
        out = np.zeros((len(words), len(self.langs)))
        if unknown:
            out[unknown] = np.add.reduceat(self.table[flat], starts)
        for w, word in enumerate(words):
            if word in self.words:
                out[w] = self.words[word]
        return out


def fit(
    labelled: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", max_documents: int = 8_000, least_documents: int = 200, max_words: int = 40_000, max_grams: int = 40_000,
    min_count: int = 3, longest: int = 4,
) -> Model | None:
    """Learn from about ``max_documents`` labelled rows at most, whole texts each.

    Every language gets an equal part of them, ``least_documents`` at least, or
    all rows if it has fewer. Rows are chosen by a hash of ``key`` and text, so
    that copies of a text are taken by their share, not all or none.
    Words and n-grams are counted by Spark; the most frequent ``max_words`` and
    ``max_grams`` seen ``min_count`` times come to the driver, so the model has
    one bounded size. N-grams are counted once a distinct word, so that what
    unknown words look like is not drowned by the commonest words. Rows
    without text or language teach nothing; None if there is none.
    """
    rows = labelled.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    found = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    langs = found.count()
    if not langs:
        return None
    wanted = max(least_documents, max_documents // langs)
    # One row a language, as many as the model has columns, is broadcast.
    # A hash is uniform over the longs; the share is compared as a fraction of them, so it may be as small as it needs to be.
    place = F.xxhash64("key", "text").cast("double") / F.lit(2.0**64) + 0.5
    rows = rows.join(F.broadcast(found.select("lang", (F.lit(float(wanted)) / F.col("n")).alias("share"))), "lang").where(place < F.col("share"))
    split = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    counted = written(rows.select("lang", split.alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for name, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                marked = f"<{word}>"
                found.update([(name, marked[i : i + n]) for n in range(1, longest + 1) for i in range(len(marked) - n + 1)])
            names, items = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(items, pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "item", "n"]
            )

    spelled = counted.select("lang", "word").mapInArrow(grams, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n"))
    both = written(
        counted.select("lang", F.lit("w").alias("kind"), F.col("word").alias("item"), "n").unionByName(
            spelled.select("lang", F.lit("g").alias("kind"), "item", "n")
        )
    )
    every = both.groupBy("kind", "item").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    sums = both.groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()
    if not sums:  # no word in any text
        return None
    langs = sorted({r.lang for r in sums})
    size = {k: np.array([next((r.n for r in sums if r.kind == k and r.lang == g), 0) for g in langs], dtype=float) for k in "wg"}
    # What a language has not shown is equally unlikely in each, however much of it was read.
    unseen = {k: 0.1 / (size[k].sum() + 1.0) for k in "wg"}
    size = {k: np.maximum(v, 1.0) for k, v in size.items()}
    tables: dict[str, dict[str, np.ndarray]] = {}
    for kind, most in (("w", max_words), ("g", max_grams)):
        top = every.where((F.col("kind") == kind) & (F.col("total") >= min_count)).orderBy(F.desc("total"), "item").limit(most)
        tables[kind] = {
            r.item: np.log(np.array([r.by.get(g, 0) for g in langs], dtype=float) / size[kind] + unseen[kind]) for r in top.collect()
        }
    return Model(langs, tables["w"], tables["g"], np.full(len(langs), np.log(unseen["g"])), longest)


def predict(docs: DataFrame, model: Model | None, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred and score (its posterior probability) of every row.

    The scores of all words of the whole text add up; the probability takes
    languages to be equally likely beforehand and grows with the length of the
    text. Null texts, texts without a letter, and any text when nothing was
    learned, are ``und`` with score 0. Ties go to the first language by name.
    Rows are independent and repeated rows repeat. The model's size is bounded
    by how it was fitted, and it is sent to every worker.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        find = re.compile(LETTERS).findall
        numbers: dict[str, int] = {}
        table = np.zeros((0, len(known.langs) if known else 1))
        for batch in batches:
            names, scores = [], []
            for from_row in range(0, batch.num_rows, SLICE):
                texts = batch.column(len(keep)).slice(from_row, SLICE).to_pylist()
                counted = [Counter(find((t or "").lower())) if known else None for t in texts]
                if len(numbers) > MEMORY:
                    numbers, table = {}, table[:0]
                fresh = list({w for words in counted if words for w in words if w not in numbers})
                if fresh:
                    table = np.concatenate([table, known.scores(fresh)])
                    numbers.update(zip(fresh, range(len(numbers), len(table))))
                for words in counted:
                    if not words:
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    at = np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))
                    total = np.fromiter(words.values(), dtype=float, count=len(words)) @ table[at]
                    best = int(total.argmax())
                    names.append(known.langs[best])
                    scores.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*keep, "lang_pred", "score"],
            )

    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", lang_pred string, score double"
    return docs.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    """Whether a row is kept from learning: a quarter of the ids, by CRC-32 of the id as text."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from those not held out.

    Rows without doc_id can neither be tested nor taught: they are not held out and teach nothing.
    """
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()), **options)
    marked = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(marked, model, keep=("doc_id", "held_out"))
