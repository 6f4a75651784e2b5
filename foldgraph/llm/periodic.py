"""Periodic runs of words: segments split at rare words until stable, survivors scanned lag by lag."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foldgraph.llm.common import BLANKS, worker_state

#: Words worked on together; a longer text is worked on alone.
WORDS_AT_ONCE = 500_000
#: Words remembered by a worker; beyond it the memory starts anew.
MEMORY = 1_000_000
RUNS = "array<struct<start:long,length:long,period:long>>"


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    clean = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(F.length(clean) == 0, F.array().cast("array<string>")).otherwise(F.split(clean, r"[\x20\x09-\x0D]+"))


def segments(codes: np.ndarray, ends: np.ndarray, least: int, rare: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the stretches in which every word occurs ``rare`` times or more, ``least`` words or longer.

    ``ends`` are where texts end. A word of a run of four periods occurs four
    times in it, so a word that its segment holds less often is in no run there
    and splits it; the parts are split again by their own counts.
    """
    at = np.arange(len(codes))
    of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    width = np.int64(codes.max() + 1) if len(codes) else np.int64(1)
    starts, stops = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    while len(at):
        key = of * width + codes[at]
        order = np.argsort(key)
        first = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
        size = np.diff(np.append(first, len(key)))
        often = np.empty(len(key), dtype=bool)
        often[order] = np.repeat(size >= rare, size)
        split = np.zeros(of[-1] + 1, dtype=bool)
        split[of[~often]] = True
        again = split[of]
        # Segments without a rare word are stable.
        ready = at[~again]
        if len(ready):
            cut = np.flatnonzero(np.concatenate([[True], np.diff(of[~again]) != 0]))
            starts.append(ready[cut])
            stops.append(ready[np.append(cut[1:], len(ready)) - 1] + 1)
        at, of = at[often & again], of[often & again]
        if len(at):
            part = np.cumsum(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(of) != 0)])) - 1
            long = np.bincount(part)[part] >= least
            at, of = at[long], part[long]
            of = np.cumsum(np.concatenate([[False], np.diff(of) != 0])) if len(of) else of
    start, stop = np.concatenate(starts), np.concatenate(stops)
    long = stop - start >= least
    return start[long], stop[long]


def _equal_ahead(x: np.ndarray, y: np.ndarray) -> int:
    """How many first elements of ``x`` and ``y`` are equal, looked at in growing pieces."""
    n, at, step = min(len(x), len(y)), 0, 32
    while at < n:
        unlike = x[at : at + step] != y[at : at + step]
        if unlike.any():
            return at + int(unlike.argmax())
        at += step
        step *= 2
    return n


def scan(codes: np.ndarray, start: np.ndarray, stop: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, stop, period) of every run inside the segments.

    For each lag the words at its multiples are compared: a run of four periods
    holds four of them in a row. Where three in a row equal their successor,
    the stretch around is measured. Lags ascend, so a stretch is met at its
    smallest period first; later lags pass over what lies in a known run, as
    by then it can only be a multiple of that run's period.
    """
    order = np.argsort(start - stop, kind="stable")
    start, length = start[order], (stop - start)[order]
    ends = np.cumsum(length)
    begins = ends - length
    x = np.concatenate([codes[a : a + n] for a, n in zip(start.tolist(), length.tolist())]) if len(start) else codes[:0]
    found: list[tuple[int, int, int]] = []
    known: set[tuple[int, int]] = set()
    run_starts = run_reach = np.zeros(0, dtype=np.int64)
    alive = len(start)
    for q in range(1, int(length[0]) // times + 1 if len(start) else 1):
        while alive and length[alive - 1] < max(least, times * q):
            alive -= 1
        grid = x[: int(ends[alive - 1]) : q] if alive else x[:0]
        equal = grid[1:] == grid[:-1]
        near = equal[: len(equal) - times + 2]
        for i in range(1, times - 1):
            near = near & equal[i : i + len(near)]
        at = np.flatnonzero(near) * q
        if not len(at):
            continue
        last = at + (times - 1) * q
        seg = np.searchsorted(begins, at, side="right") - 1
        open_ = last < ends[seg]
        if len(run_starts):
            before = np.searchsorted(run_starts, at, side="right") - 1
            open_ &= (before < 0) | (run_reach[before] <= last)
        new, s, e = [], 0, 0
        for c, z, k in zip(at[open_].tolist(), last[open_].tolist(), seg[open_].tolist()):
            if s <= c and z < e:
                continue
            low, high = int(begins[k]), int(ends[k])
            right = _equal_ahead(x[c : high - q], x[c + q : high])
            left = _equal_ahead(x[low:c][::-1], x[low + q : c + q][::-1])
            s, e = c - left, c + right + q
            if e - s >= max(least, times * q) and (s, e) not in known:
                known.add((s, e))
                new.append((s, e))
                shift = int(start[k]) - low
                found.append((s + shift, e + shift, q))
        if new:
            runs = np.array(sorted(known))
            run_starts, run_reach = runs[:, 0], np.maximum.accumulate(runs[:, 1])
    return found


def periodic_runs(docs: DataFrame, *, text: str = "text", key: str = "doc_id", least: int = 6, times: int = 4) -> DataFrame:
    """``key``, runs, collapsed of every row: its periodic runs of words, and its text without their repetitions.

    Words are ``[^\\x20\\x09-\\x0D]+``, compared byte by byte, numbered from 0. A
    run is a stretch with smallest period q in which words q apart are equal,
    of ``max(least, times * q)`` words or more, which neither neighbouring word
    extends; ``times`` is 3 or more. ``runs`` lists (start, length, period) by start, then period.
    ``collapsed`` is the words that lie in no run after its first period,
    joined by blanks.

    Whole texts are worked on, many at once (:func:`segments`, :func:`scan`): n
    words cost about n log n steps, however often they repeat. Nothing is shuffled and a
    task holds about ``WORDS_AT_ONCE`` words or one text. A null, empty or blank text has
    no runs and an empty collapsed text; rows are judged one by one, so
    repeated rows and null keys do no harm. Other columns are not read.
    """
    if times < 3:
        raise ValueError("runs have three periods at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Known(dict):
            def __missing__(self, word: bytes) -> int:
                self[word] = n = len(self)
                return n

        known = worker_state("periodic-words", Known)
        for batch in batches:
            held, rows, first = [], 0, 0
            for i, value in enumerate(batch.column(1).cast(pa.binary())):
                held.append((value.as_py() or b"").split())
                rows += len(held[-1])
                if rows >= WORDS_AT_ONCE:
                    yield answer(batch.column(0).slice(first, len(held)), held, known)
                    held, rows, first = [], 0, i + 1
            if held:
                yield answer(batch.column(0).slice(first, len(held)), held, known)

    def answer(keys: pa.Array, texts: list[list[bytes]], known: dict) -> pa.RecordBatch:
        if len(known) > MEMORY:
            known.clear()
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes)
        codes = np.fromiter((c for t in texts for c in map(known.__getitem__, t)), dtype=np.int64, count=int(ends[-1]))
        found = np.array(scan(codes, *segments(codes, ends, least, times), least, times), dtype=np.int64).reshape(-1, 3)
        found = found[np.lexsort((found[:, 2], found[:, 0]))]
        doc = np.searchsorted(ends, found[:, 0], side="right")
        gone = np.zeros(len(codes) + 1, dtype=np.int64)
        np.add.at(gone, found[:, 0] + found[:, 2], 1)
        np.add.at(gone, found[:, 1], -1)
        kept = gone.cumsum()[:-1] == 0
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
        collapsed = []
        for i, t in enumerate(texts):
            if bounds[i] != bounds[i + 1]:
                t = [t[j] for j in np.flatnonzero(kept[ends[i] - sizes[i] : ends[i]]).tolist()]
            collapsed.append(b" ".join(t))
        begin = found[:, 0] - (ends - sizes)[doc] if len(found) else found[:, 0]
        numbers = [pa.array(v) for v in (begin, found[:, 1] - found[:, 0], found[:, 2])]
        runs = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(numbers, names=["start", "length", "period"]))
        return pa.RecordBatch.from_arrays([keys, runs, pa.array(collapsed, pa.binary()).cast(pa.string())], names=[key, "runs", "collapsed"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, runs {RUNS}, collapsed string")


def with_loops(docs: DataFrame) -> DataFrame:
    """doc_id, text, where the words of every tenth document repeat from some place on.

    With ``h`` the CRC-32 of the decimal doc_id and ``g = h div 10``, the n
    words of documents with ``h % 10 = 0`` repeat those from ``a = g % n`` on,
    ``p = 1 + (n - a) div (3 + g % 8)`` at a time. A null doc_id repeats nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    split = docs.select("doc_id", "text", F.floor(h / 10).cast("long").alias("g"), F.when(h % 10 == 0, words_of(F.col("text"))).alias("w"))
    looped = F.size("w") > 0
    placed = split.withColumn("a", F.when(looped, F.expr("cast(g % size(w) as int)")))
    placed = placed.withColumn("p", F.when(looped, F.expr("cast(1 + (size(w) - a) div (3 + g % 8) as int)")))
    again = F.transform(F.sequence(F.lit(0), F.size("w") - F.col("a") - 1), lambda i: F.get(F.col("w"), F.col("a") + i % F.col("p")))
    text = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), again), " ")
    return placed.select("doc_id", F.when(looped, text).otherwise(F.col("text")).alias("text"))
