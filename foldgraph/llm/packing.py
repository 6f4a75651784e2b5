"""Packing into sequences: cutting-stock patterns over a length histogram, by column generation."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from foldgraph.llm.common import worker_state, written

#: Words and odd chunks remembered by a worker; beyond it the memory starts anew.
MEMORY = 250_000
#: Bytes of text encoded together by a worker, or one longer text.
SLICE = 4_000_000
PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


def gathered(values: np.ndarray, start: np.ndarray, size: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``start``, ``size`` of ``values`` that ``chosen`` numbers, one after another, and where each begins."""
    each = size[chosen]
    after = np.concatenate([[0], np.cumsum(each)])
    return values[np.repeat(start[chosen] - after[:-1], each) + np.arange(after[-1])], after


class WordEncoder:
    """Ids of whole texts by a ``tokenizers`` file that lower-cases and drops blanks.

    Its pieces never cross blanks, so texts are split at blanks, and equal chunks
    numbered, by Arrow; only distinct ones are looked at. A chunk of plain letters and trailing ASCII marks splits
    into a lower-case word and the marks; new words are encoded many at a time
    and told apart by the tokens that end a word, and remembered. Every other chunk is given
    to the library as it is, and so is a whole text with one of the four
    control characters that Python, but not the library, takes for a blank.
    """

    plain = "[A-Za-zÀ-ÖØ-öø-ÿ]*"
    marked = rf"^(?P<word>{plain})(?P<marks>[!-/:-@\[-`{{-~]*)$"
    control = "[\x1c-\x1f]"

    def __init__(self, document: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(document)
        self.library.no_truncation()
        self.library.no_padding()
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, fresh: list[str]) -> None:
        letters = re.compile(self.plain).fullmatch
        words, odd = [], []
        for s in fresh:
            (words if letters(s) else odd).append(s)
        groups = [words[i : i + 200] for i in range(0, len(words), 200)]
        for group, packed in zip(groups, self._encode([" ".join(g) for g in groups])):
            cuts = ((np.flatnonzero(self.ends[np.frombuffer(packed, dtype="<u4")]) + 1) * 4).tolist()
            if len(cuts) != len(group):
                raise ValueError("the vocabulary does not mark the ends of words")
            self.known.update(zip(group, [packed[x:y] for x, y in zip([0, *cuts], cuts)]))
        self.known.update(zip(odd, self._encode(odd)))

    def _packed(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words, marks or odd chunks: all ids, and where those of each begin and how many they are."""
        strings = strings.to_pylist()
        packed = list(map(self.known.get, strings))
        if None in packed:
            self._learn([s for s, p in zip(strings, packed) if p is None])
            packed = list(map(self.known.__getitem__, strings))
        size = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4
        return np.frombuffer(b"".join(packed), dtype="<u4"), np.cumsum(size) - size, size

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; none for null."""
        if len(self.known) > MEMORY:
            self.known = {"": b""}
        texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, self.control)
        split = pc.utf8_split_whitespace(pc.if_else(whole, pa.scalar("", pa.large_string()), texts) if pc.any(whole).as_py() else texts)
        chunks = split.flatten().dictionary_encode()
        parts = pc.extract_regex(chunks.dictionary, self.marked)
        words = pc.coalesce(pc.utf8_lower(pc.struct_field(parts, "word")), chunks.dictionary).dictionary_encode()
        marks = pc.coalesce(pc.struct_field(parts, "marks"), pa.scalar("", pa.large_string())).dictionary_encode()
        ids, start, size = zip(self._packed(words.dictionary), self._packed(marks.dictionary))
        # A chunk is its word's ids and its marks' ids.
        both = np.stack([words.indices.to_numpy(), marks.indices.to_numpy() + len(words.dictionary)], axis=1).ravel()
        of_chunks, after = gathered(np.concatenate(ids), np.concatenate([start[0], start[1] + len(ids[0])]), np.concatenate(size), both)
        flat, after = gathered(of_chunks, after[:-1:2], np.diff(after[::2]), chunks.indices.to_numpy())
        offsets = split.offsets.to_numpy()
        ends = after[offsets - offsets[0]].tolist()
        out = [flat[x:y].tobytes() for x, y in zip(ends, ends[1:])]
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self._encode([texts[i].as_py()])[0]
        return out


def cut(n: int, capacity: int, grid: int) -> list[int]:
    """The pieces of ``n`` tokens: full sequences, one multiple of ``grid``, one tail."""
    rest = n % capacity
    return [capacity] * (n // capacity) + [k for k in (rest - rest % grid, rest % grid) if k]


def token_pieces(docs: DataFrame, tokenizer: str, *, capacity: int = 4096, grid: int = 64, end_id: int = 2, key: str = "doc_id") -> DataFrame:
    """Every document's ids, ended by ``end_id``, as pieces: key, start, length, ids_crc32, doc_tokens."""
    document = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state(f"words-{hashlib.sha256(document.value.encode()).hexdigest()}", lambda: WordEncoder(document.value))
        end = end_id.to_bytes(4, "little")

        def flush(texts: pa.Array, keys: pa.Array) -> pa.RecordBatch:
            of, starts, lengths, crcs, totals = [], [], [], [], []
            for row, packed in enumerate(encoder.encode(texts)):
                packed += end
                n, at = len(packed) // 4, 0
                for size in cut(n, capacity, grid):
                    of.append(row)
                    starts.append(at)
                    lengths.append(size)
                    crcs.append(zlib.crc32(packed[at * 4 : (at + size) * 4]))
                    totals.append(n)
                    at += size
            return pa.RecordBatch.from_arrays(
                [keys.take(pa.array(of, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals))],
                names=[key, "start", "length", "ids_crc32", "doc_tokens"],
            )

        for batch in batches:
            held = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            first = 0
            while first < batch.num_rows:
                after = int(np.searchsorted(held, (held[first - 1] if first else 0) + SLICE)) + 1
                yield flush(batch.column(1).slice(first, after - first), batch.column(0).slice(first, after - first))
                first = after

    kind = dict(docs.dtypes)[key]
    return docs.select(key, F.col("text").cast("string")).mapInArrow(run, f"{key} {kind}, {PIECES}")


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of most value within the capacity: an unbounded knapsack by dynamic programming."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    sizes_up, values_up = sizes[order], values[order]
    fitting = np.searchsorted(sizes_up, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        k = fitting[room]
        best[room] = best[room - 1]
        if k:
            worth = best[room - sizes_up[:k]] + values_up[:k]
            i = int(worth.argmax())
            if worth[i] > best[room] + 1e-12:
                best[room], took[room] = worth[i], order[i]
    counts, room = np.zeros(len(sizes), dtype=np.int64), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            counts[took[room]] += 1
            room -= int(sizes[took[room]])
    return float(best[capacity]), counts


def patterns(sizes: list[int], demand: list[int], capacity: int, close: float = 1.0005) -> list[tuple[np.ndarray, float]]:
    """Patterns (pieces of each size) and how often each is used, for the least number of sequences.

    The linear program over patterns is solved by column generation: its duals
    price new patterns through the knapsack, and the best one enters the basis,
    until none improves or the solution is within ``close`` of the lower bound
    that the best price proves.
    """
    s, d = np.array(sizes), np.array(demand, dtype=float)
    basis = np.diag(capacity // s).astype(float)
    for _ in range(60 * len(s)):
        used = np.linalg.solve(basis, d)
        duals = np.linalg.solve(basis.T, np.ones(len(s)))
        worth, column = price(duals, s, capacity)
        if worth <= 1 + 1e-9 or used.sum() <= close * used.sum() / worth:
            break
        step = np.linalg.solve(basis, column.astype(float))
        ratio = np.full(len(s), np.inf)
        np.divide(np.maximum(used, 0), step, out=ratio, where=step > 1e-9)
        basis[:, int(ratio.argmin())] = column
    used = np.linalg.solve(basis, d)
    return [(basis[:, j].round().astype(np.int64), float(used[j])) for j in range(len(s))]


def plan_sequences(histogram: dict[int, int], capacity: int, grid: int) -> tuple[dict[int, np.ndarray], int]:
    """For each length, rows of (first rank, pieces a sequence, first sequence, offset in it); and the number of sequences.

    Lengths on the grid and tails are two cutting-stock problems. Patterns are
    used as often as the linear program says, rounded down; what the rounding
    leaves, at most a pattern of each length, fills further sequences from the
    longest piece down.
    """
    left = dict(histogram)
    chosen: list[tuple[dict[int, int], int]] = []
    for group in ([n for n in histogram if n % grid == 0], [n for n in histogram if n % grid]):
        if not group:
            continue
        unit = grid if group[0] % grid == 0 else 1
        solved = patterns([n // unit for n in group], [histogram[n] for n in group], capacity // unit)
        for counts, used in solved:
            pattern = {n: int(c) for n, c in zip(group, counts) if c}
            times = min([int(used + 1e-6), *(left[n] // c for n, c in pattern.items())])
            if times > 0:
                chosen.append((pattern, times))
                for n, c in pattern.items():
                    left[n] -= c * times
    while any(left.values()):
        room, pattern = capacity, {}
        for n in sorted(left, reverse=True):
            if c := min(room // n, left[n]):
                pattern[n] = c
                left[n] -= c
                room -= c * n
        chosen.append((pattern, 1))
    rows: dict[int, list] = {n: [] for n in histogram}
    rank, sequence = dict.fromkeys(histogram, 0), 0
    for pattern, times in chosen:
        offset = 0
        for n, c in sorted(pattern.items(), reverse=True):
            rows[n].append((rank[n], c, sequence, offset))
            rank[n] += c * times
            offset += c * n
        sequence += times
    return {n: np.array(r, dtype=np.int64).reshape(-1, 4) for n, r in rows.items()}, sequence


def pack_documents(
    docs: DataFrame, tokenizer: str, *, capacity: int = 4096, grid: int = 64, end_id: int = 2, key: str = "doc_id", rows_per_bucket: int = 2000
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A text's ids by the ``tokenizers`` file, then ``end_id``, are cut into full
    sequences, one multiple of ``grid`` and one tail shorter than it, so there
    are at most ``capacity / grid + grid`` lengths whatever the input. The
    driver sees that histogram alone and solves it; its patterns are assigned
    to the pieces by their rank within their length. Ranks are counted in
    buckets of about ``rows_per_bucket`` pieces, so a common length is no
    group of its own. Texts are encoded once: pieces go to shared scratch.

    Null and empty texts are the end id alone. Repeated rows are packed as
    often as they are there. An empty table gives no rows; other columns are
    not read.
    """
    if capacity % grid:
        raise ValueError("the grid divides the capacity")
    pieces = written(token_pieces(docs, tokenizer, capacity=capacity, grid=grid, end_id=end_id, key=key))
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table, _ = plan_sequences(histogram, capacity, grid)
    buckets = max(1, sum(histogram.values()) // rows_per_bucket)
    placed = pieces.withColumn("_bucket", F.pmod(F.xxhash64(key, "start", "ids_crc32", "doc_tokens"), F.lit(buckets)))
    counts = placed.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(
        "length", "_bucket", (F.sum("_n").over(W.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_before")
    )
    local = F.row_number().over(W.partitionBy("length", "_bucket").orderBy(key, "start", "ids_crc32", "doc_tokens"))
    ranked = placed.withColumn("_local", local - 1).join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_local"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for n in np.unique(length).tolist():
                at = length == n
                first, each, base, shift = table[n][np.searchsorted(table[n][:, 0], rank[at], side="right") - 1].T
                place = rank[at] - first
                sequence[at] = base + place // each
                offset[at] = shift + place % each * n
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (key, "start", "length", "ids_crc32", "doc_tokens")), pa.array(sequence), pa.array(offset)],
                names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    kind = dict(docs.dtypes)[key]
    return ranked.select(key, "start", "length", "ids_crc32", "doc_tokens", "_rank").mapInArrow(assign, f"{key} {kind}, {PIECES}, sequence_id long, `offset` long")
