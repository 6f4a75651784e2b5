"""Substring dedup: shared k-mer seeds, collinear chains by a Fenwick tree, aligned passages."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foldgraph.llm.common import list_column, stream_groups

WORD = r"\S+"
#: Word hashes remembered by a worker; beyond it the memory starts anew.
MEMORY = 250_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Marks the place of a seed of many words.
LONG = np.int32(1 << 30)
#: Bytes of a word's hash that are compared.
WIDTH = 3


class Words:
    """Texts as arrays of 64-bit word hashes; words are runs without blanks, in lower case."""

    def __init__(self):
        import xxhash

        digest = xxhash.xxh3_64_intdigest

        class Known(dict):
            def __missing__(self, word: str) -> int:
                self[word] = value = digest(word)
                return value

        self.known = Known()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        if len(self.known) > MEMORY:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` words in a row."""
    n = max(0, len(hashes) - k + 1)
    mixed = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            mixed = mixed * _ODD + hashes[i : i + n]
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
    return mixed


def seeds(hashes: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the minimizers: of each ``window`` k-mers in a row, the one of least hash."""
    mixed = grams(hashes, k)
    n = len(mixed)
    if not n:
        return np.zeros(0, dtype=np.int64), mixed
    if n <= window:
        at = np.array([int(mixed.argmin())])
    else:
        # Places take the low bits, so a minimum names its place and of equal hashes the first is least.
        low = np.uint64(2**24 - 1)
        least, covered = (mixed & ~low) | (np.arange(n, dtype=np.uint64) & low), 1
        while covered < window:
            step = min(covered, window - covered)
            least = np.minimum(least[:-step], least[step:])
            covered += step
        start = np.arange(len(least), dtype=np.uint64)
        with np.errstate(over="ignore"):
            at = start + (((least & low) - start) & low)
        at = at[np.concatenate([[True], at[1:] != at[:-1]])].astype(np.int64)
    return at, mixed[at]


def planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes first: equal high bytes cost next to nothing once compressed."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def packed(name: str, values: np.ndarray) -> bytes:
    """A column's numbers for the shuffle; seeds are as good as random and stay as they are, documents go as steps from one to the next."""
    if name == "seed":
        return planes(values)
    return pa.compress(planes(np.diff(values, prepend=values.dtype.type(0)) if name == "doc" else values), codec="zstd", asbytes=True)


def unpacked(table: pa.RecordBatch | pa.Table, name: str, kind) -> np.ndarray:
    """The numbers of :func:`packed`, of all rows of a column; a row has ``n`` of them."""
    size, rows = np.dtype(kind).itemsize, []
    for held, n in zip(table.column(name), table.column("n").to_pylist()):
        data = held.as_buffer() if name == "seed" else pa.decompress(held.as_buffer(), size * n, codec="zstd")
        values = np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()
        rows.append(np.cumsum(values, dtype=kind) if name == "doc" else values)
    return np.concatenate(rows)


def dealt_rows(part: np.ndarray, columns: dict[str, np.ndarray], kinds: int = 1) -> pa.RecordBatch:
    """One row for each ``part`` (its number times ``kinds``, plus the kind), how many numbers it has, and those of every column by :func:`packed`."""
    order = np.argsort(part.astype(np.uint16) if len(part) and part.max() < 2**16 else part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    ends = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)]))
    firsts = part[[a for a, _ in ends]]
    sizes = np.array([b - a for a, b in ends], dtype=np.int32)
    arrays = [pa.array((firsts // kinds).astype(np.int32)), pa.array((firsts % kinds).astype(np.int32)), pa.array(sizes)]
    for name, values in columns.items():
        values = values[order]
        arrays.append(pa.array([packed(name, values[a:b]) for a, b in ends], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=["part", "kind", "n", *columns])


def candidates(seed: np.ndarray) -> np.ndarray:
    """Which places are the first of their seed."""
    order = np.argsort(seed)
    sorted_ = seed[order]
    first = np.zeros(len(seed), dtype=bool)
    if len(seed):
        first[np.minimum.reduceat(order, np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])))] = True
    return first


class Owners:
    """The least document of each seed, and its first place there, of the candidates that tasks have sent."""

    def __init__(self, seed: np.ndarray, doc: np.ndarray, at: np.ndarray):
        order = np.argsort(seed)
        sorted_ = seed[order]
        start = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(seed) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.append(start, len(seed)))
        self.seed, doc, at = sorted_[start], doc[order], at[order]
        self.doc = np.minimum.reduceat(doc, start) if len(seed) else doc
        self.at = np.minimum.reduceat(np.where(doc == np.repeat(self.doc, size), at, np.iinfo(np.int32).max), start) if len(seed) else at

    def anchors(self, seed: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(doc, owner, at, there) of the places outside the owners of their seeds."""
        row = np.searchsorted(self.seed, seed)
        # Hashes of runs of either length may agree by chance; such an anchor is none.
        other = (self.doc[row] != doc) & ((at ^ self.at[row]) & LONG == 0)
        row = row[other]
        return doc[other], self.doc[row], at[other], self.at[row]


def dense(doc: np.ndarray, at: np.ndarray, windows: list[tuple[int, int]]) -> np.ndarray:
    """Which anchors lie, for any (fewest, reach), among ``fewest`` places or more of their document within ``reach`` words."""
    order = np.lexsort((at, doc))
    d, p = doc[order], at[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (p[1:] != p[:-1])])
    place = np.cumsum(new) - 1
    d, p = d[new], p[new]
    opened = np.zeros(len(d) + 1, dtype=np.int64)
    for fewest, reach in windows:
        if len(d) >= fewest:
            last = fewest - 1
            close = np.flatnonzero((d[last:] == d[: len(d) - last]) & (p[last:] - p[: len(p) - last] < reach))
            opened[close] += 1
            opened[close + fewest] -= 1
    out = np.empty(len(doc), dtype=bool)
    out[order] = (opened.cumsum()[:-1] > 0)[place]
    return out


def thinned(doc: np.ndarray, owner: np.ndarray, at: np.ndarray, there: np.ndarray, step: int, fewest: int = 1) -> np.ndarray:
    """The anchors to chain: of anchors that follow each other word by word, every ``step``-th and the last; equal ones count once.

    A document and an owner with less than ``fewest`` anchors have none to chain.
    """
    order = np.lexsort((at, at - there, owner, doc))
    d, o, x, y = doc[order], owner[order], at[order], there[order]
    once = np.concatenate([[True], (d[1:] != d[:-1]) | (o[1:] != o[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    order, d, o, x, y = order[once], d[once], o[once], x[once], y[once]
    pair = np.cumsum(np.concatenate([[True], (d[1:] != d[:-1]) | (o[1:] != o[:-1])])) - 1
    several = np.bincount(pair)[pair] >= fewest
    order, d, o, x, y = order[several], d[several], o[several], x[several], y[several]
    if not len(order):
        return order
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (o[1:] != o[:-1]) | (x[1:] != x[:-1] + 1) | (y[1:] != y[:-1] + 1)])
    start = np.flatnonzero(new)
    nth = np.arange(len(x)) - np.repeat(start, np.diff([*start, len(x)]))
    return np.sort(order[(nth % step == 0) | np.concatenate([new[1:], [True]])])


def chain(here: np.ndarray, there: np.ndarray, gain: float, cost: float) -> list[np.ndarray]:
    """Collinear chains of anchors, best first; ``here`` ascends.

    The score of a chain is ``gain`` an anchor less ``cost`` for every word
    skipped on either side. The best predecessor of an anchor lies before it on
    both sides; with the gap cost split over the two ends, it is a maximum over
    a prefix of ``there``, which a Fenwick tree keeps.
    """
    n = len(here)
    slot = np.searchsorted(np.unique(there), there) + 1
    size = int(slot.max())
    value, holder = [-np.inf] * (size + 1), [-1] * (size + 1)
    score, parent = [0.0] * n, [-1] * n
    i = 0
    while i < n:
        same = i
        while same < n and here[same] == here[i]:  # anchors of one place cannot follow each other
            j, best, best_at = int(slot[same]) - 1, -np.inf, -1
            while j:
                if value[j] > best:
                    best, best_at = value[j], holder[j]
                j -= j & -j
            linked = best - cost * float(here[same] + there[same])
            score[same], parent[same] = (gain + linked, best_at) if linked > 0 else (gain, -1)
            same += 1
        for a in range(i, same):
            put, j = score[a] + cost * float(here[a] + there[a]), int(slot[a])
            while j <= size:
                if put > value[j]:
                    value[j], holder[j] = put, a
                j += j & -j
        i = same
    taken, chains = bytearray(n), []
    for end in sorted(range(n), key=lambda a: -score[a]):
        path, a = [], end
        while a >= 0 and not taken[a]:
            taken[a] = 1
            path.append(a)
            a = parent[a]
        if path:
            chains.append(np.array(path[::-1]))
    return chains


def word_numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of rows, and all their word hashes of ``WIDTH`` bytes each as numbers."""
    rows = pa.concat_arrays(column.chunks).cast(pa.large_binary())
    offsets = np.frombuffer(rows.buffers()[1], dtype=np.int64, count=len(rows) + 1, offset=8 * rows.offset)
    data = np.frombuffer(rows.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]].reshape(-1, WIDTH)
    numbers = data[:, 0].astype(np.int32)
    for i in range(1, WIDTH):
        numbers |= data[:, i].astype(np.int32) << 8 * i
    return (offsets - offsets[0]) // WIDTH, numbers


def equal_runs(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, k: int) -> np.ndarray:
    """Of which places in ``x`` and ``y`` the next ``k`` words are there and equal."""
    same = (px + k <= len(x)) & (py + k <= len(y))
    run = np.arange(k)
    same[same] = (x[px[same][:, None] + run] == y[py[same][:, None] + run]).all(axis=1)
    return same


def words_along(x: np.ndarray, y: np.ndarray, k: int, step: int) -> int:
    """Words that a chain's anchors can stand for: ``k`` each, and all between neighbours that thinning may have parted."""
    ahead = np.diff(x)
    return k + int(np.where(ahead == np.diff(y), np.minimum(ahead, step), np.minimum(ahead, k)).sum())


def between(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which words of ``p`` match ``q`` in order: equal heads and tails, and what difflib matches between them."""
    if len(p) == len(q) and (p == q).all():
        return np.ones(len(p), dtype=bool)
    matched, n = np.zeros(len(p), dtype=bool), min(len(p), len(q))
    unlike = np.flatnonzero(p[:n] != q[:n])
    head = int(unlike[0]) if len(unlike) else n
    unlike = np.flatnonzero(p[::-1][: n - head] != q[::-1][: n - head])
    tail = int(unlike[0]) if len(unlike) else n - head
    matched[:head] = matched[len(p) - tail :] = True
    p, q = p[head : len(p) - tail], q[head : len(q) - tail]
    if len(p) and len(q) and len(p) + len(q) > 2:
        for m in difflib.SequenceMatcher(None, p.tolist(), q.tolist(), autojunk=False).get_matching_blocks():
            matched[head + m.a : head + m.a + m.size] = True
    return matched


def align(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, k: int) -> np.ndarray:
    """Which words of ``a`` match ``b`` along a chain of anchors (places of equal k-mers in both)."""
    matched = np.zeros(len(a), dtype=bool)
    i, j = int(at_a[0]), int(at_b[0])
    # Outwards from the ends: as long as matches outweigh differences.
    back = min(i, j)
    matched[i - back : i] = _outwards(a[i - back : i][::-1] == b[j - back : j][::-1])[::-1]
    stop = int(at_a[-1]) + k
    if (at_a - at_b == i - j).all() and np.array_equal(a[i:stop], b[j : stop - i + j]):
        matched[i:stop] = True
        i, j = stop, stop - i + j
    else:
        for x, y in zip(at_a.tolist(), at_b.tolist()):
            if x >= i and y >= j:
                matched[i:x] = between(a[i:x], b[j:y])
                i, j = x, y
            end = x + k
            matched[x:end] = True
            if x - i == y - j:
                i, j = max(i, end), max(j, y + k)
    ahead = min(len(a) - i, len(b) - j)
    matched[i : i + ahead] = _outwards(a[i : i + ahead] == b[j : j + ahead])
    return matched


def _outwards(equal: np.ndarray) -> np.ndarray:
    """Matches up to the last place where there are as many of them as differences."""
    same = np.count_nonzero(equal)
    if same == 0 or same == len(equal):
        return equal
    balanced = np.flatnonzero(equal & (np.where(equal, 1, -1).cumsum() >= 0))
    equal[balanced[-1] + 1 if len(balanced) else 0 :] = False
    return equal


def intervals(at: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, stops and matching words of runs of ascending places with at most ``skip`` differing words in a row."""
    cuts = np.flatnonzero(np.diff(at) > skip + 1)
    first, last = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(at) - 1]])
    return at[first], at[last] + 1, last - first + 1


def similar_parts(at: np.ndarray, skip: int, min_words: int, similar: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, stops and matching words of the longest parts of runs (:func:`intervals`) that are long and similar enough.

    A part begins and ends with a match, has ``min_words`` words or more and a
    share of ``similar`` matches, and lies in no other such part. Every part
    that is long and similar enough lies in one that is returned, whatever
    stands beside it in its run; parts of one run may overlap.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start, stop, count in zip(*intervals(at, skip)):
        if stop - start < min_words:
            continue
        i = int(np.searchsorted(at, start))
        p = at[i : i + count]
        # Matches i to j qualify if ends[j] >= begins[i]; for each i, the last such j, which falls as begins[i] rises.
        n = np.arange(len(p))
        begins, ends = n - similar * p, n + 1 - similar * (p + 1)
        reach = np.maximum.accumulate(ends[::-1])[::-1]
        last = np.searchsorted(-reach, 1e-6 - begins, side="right") - 1
        longest = last > np.concatenate([[-1], np.maximum.accumulate(last)[:-1]])
        first, last = n[longest], last[longest]
        long = p[last] + 1 - p[first] >= min_words
        first, last = first[long], last[long]
        found.append((p[first], p[last] + 1, last - first + 1))
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    starts, stops, counts = (np.concatenate(x) for x in zip(*found))
    return starts, stops, counts


def repeated_passages(
    docs: DataFrame, *, min_words: int = 45, similar: float = 0.8, k: int = 4, long: int = 12, window: int = 24, fewest: int = 3, gain: float = 8.0, cost: float = 0.25,
    skip: int = 6, words_per_part: int = 750_000, words_at_once: int = 500_000
) -> DataFrame:
    """doc_id, text_hash, start_word, n_words, matched, sources: passages of a document that an earlier one holds too.

    Earlier is a smaller doc_id. Words are runs without blanks, in lower case,
    counted from 0. A passage has ``min_words`` words or more, of which a share
    of ``similar`` matches; it need not match exactly. Matching words with at
    most ``skip`` differing ones in a row between them are one run, and of a
    run the longest parts that qualify are reported (:func:`similar_parts`),
    which may overlap. ``sources`` lists the documents it was aligned with;
    ``text_hash`` (XXH64) tells texts of one doc_id apart.

    Every run of ``k`` words is a seed. Where a passage differs by single words,
    put in or put in place of others, one differing word spoils ``k`` seeds at
    most, so 45 words of which 36 match share six seeds of four words at
    least. A seed belongs to the least doc_id that has it, and every other
    document is compared with the owners of its seeds only. So a passage in a
    third of all documents makes one anchor for each of its seeds and
    documents, not one for each two documents. Common runs of ``k`` words have
    an owner elsewhere, which has not the rest of the passage; so runs of
    ``long`` words are seeds too, the minimizers of each ``window`` of them
    (:func:`seeds`). Equal runs of ``long + window - 1`` words are sure to share
    one, and it stands for all its runs of ``k`` words.

    A document's anchors that are too few for a passage around them are left
    out, and so are owners with fewer than ``fewest`` of them and chains of less than
    ``k + fewest - 1`` words: common phrases. Anchors are chained (:func:`chain`), the words around each chain are
    fetched from both documents, anchors whose words differ are dropped, and
    the rest is aligned (:func:`align`); a chain that matches fewer than
    ``k + fewest - 1`` words, a common phrase, does not count.

    Seeds are dealt by their hash to parts of about ``words_per_part`` words,
    and anchors by document. Of the seeds that a task meets more than once it
    sends the least document's as a candidate for the owner; the others follow after
    all candidates of the part and are looked up as they stream by, so a
    common seed is never held as a group. A part keeps 32 bits of a seed: as
    parts grow in number with the text, one seed in some thousands meets
    another by chance at any size, and the words are compared anyway.

    Rows without doc_id or with fewer than ``min_words`` words have no
    passages; texts that share a doc_id are not compared with each other, and
    each has its own passages. Passages repeated only inside one document are
    not its business. Empty tables give no rows; only doc_id and text are read.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).where("doc is not null and text is not null")

    held = named.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    parts = max(16, held // (6 * words_per_part))
    # Of n words at the threshold, (1 - similar) * n differ and spoil k seeds each. Of 2 * min_words words or more, a half
    # or the other qualifies by itself. Two seeds less are asked for, as words left out spoil seeds without being counted.
    windows = [(max(fewest, n - k + 1 - k * int((1 - similar) * n + 1e-9) - 2), n - k + 1) for n in range(min_words, 2 * min_words)]

    def seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            found, n = [], 0
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                hashes = words(text.as_py())
                if len(hashes) >= min_words:
                    values = grams(hashes, k)
                    at, rare = seeds(hashes, long, window)
                    found.append((d, np.concatenate([values, rare]), np.concatenate([np.arange(len(values), dtype=np.int32), at.astype(np.int32) | LONG])))
                    n += len(values)
                if n > words_at_once:
                    yield seed_batch(found)
                    found, n = [], 0
            if found:
                yield seed_batch(found)

    def seed_batch(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        found.sort(key=lambda x: x[0])  # so a seed's first place is that of its least document
        seed = np.concatenate([x[1] for x in found])
        doc = np.repeat([x[0] for x in found], [len(x[1]) for x in found])
        part = (seed >> np.uint64(32)) % np.uint64(parts) * np.uint64(2) + ~candidates(seed)
        return dealt_rows(part.astype(np.int32), {"seed": seed.astype(np.uint32), "doc": doc, "at": np.concatenate([x[2] for x in found])}, 2)

    def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sent, owners = -1, [], None

        def settled() -> Iterator[pa.RecordBatch]:
            """The part's owners, now that all candidates are here, and the candidates' own anchors."""
            nonlocal sent, owners
            if sent:
                columns = [np.concatenate(c) for c in zip(*sent)]
                sent, owners = [], Owners(*columns)
                yield from anchor_batch(owners.anchors(*columns))

        for batch in batches:
            row = batch.column("part").to_numpy() * 2 + batch.column("kind").to_numpy()
            cuts = (np.flatnonzero(np.diff(row)) + 1).tolist()
            for x, y in zip([0, *cuts], [*cuts, len(row)]):
                if row[x] // 2 != part:
                    yield from settled()
                    part = row[x] // 2
                table = batch.slice(x, y - x)
                columns = [unpacked(table, c, kind) for c, kind in (("seed", np.uint32), ("doc", np.int64), ("at", np.int32))]
                if row[x] % 2 == 0:
                    sent.append(columns)
                else:
                    yield from settled()
                    yield from anchor_batch(owners.anchors(*columns))
        yield from settled()

    def anchor_batch(found: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        doc, owner, at, there = found
        if len(doc):
            part = (doc.view(np.uint64) * _ODD >> np.uint64(32)) % np.uint64(parts)
            yield dealt_rows(part.astype(np.int32), {"doc": doc, "owner": owner, "at": at, "there": there})

    flank = max(6 * k, window)

    def chain_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in stream_groups(batches, "part"):
            columns = [unpacked(table, c, kind).astype(np.int64) for c, kind in (("doc", np.int64), ("owner", np.int64), ("at", np.int32), ("there", np.int32))]
            # A seed of many words stands for its runs of k words.
            rare = columns[2] >= LONG
            each = np.where(rare, long - k + 1, 1)
            columns = [np.repeat(c & ~int(LONG) if i >= 2 else c, each) for i, c in enumerate(columns)]
            ahead = np.arange(len(columns[0])) - np.repeat(np.cumsum(each) - each, each)
            columns[2:] = [c + ahead for c in columns[2:]]
            close = dense(columns[0], columns[2], windows)
            if not close.any():
                continue
            columns = [c[close] for c in columns]
            kept = thinned(*columns, 2 * k, fewest)
            if not len(kept):
                continue
            columns = [c[kept] for c in columns]
            order = np.lexsort((columns[3], columns[2], columns[1], columns[0]))
            docs_, owners, here, there = (c[order] for c in columns)
            new = np.concatenate([[True], (docs_[1:] != docs_[:-1]) | (owners[1:] != owners[:-1])])
            start = np.flatnonzero(new)
            stop = np.append(start[1:], len(here))
            # Anchors on one diagonal, each so near the last that it pays to go on, are one chain.
            ahead = np.where(new, 0, np.diff(here, prepend=0))
            apart = ~new & ((np.diff(here - there, prepend=0) != 0) | (ahead >= gain / (2 * cost)))
            straight = np.add.reduceat(apart, start, dtype=np.int64) == 0
            enough = k + np.add.reduceat(np.minimum(ahead, 2 * k), start) >= k + fewest - 1
            yield straight_chains(docs_, owners, here, there, start[straight & enough], stop[straight & enough])
            rows: list[tuple] = []
            for a, b in zip(start[~straight].tolist(), stop[~straight].tolist()):
                doc, owner = int(docs_[a]), int(owners[a])
                for n, path in enumerate(chain(here[a:b], there[a:b], gain, cost)):
                    x, y = here[a:b][path], there[a:b][path]
                    if words_along(x, y, k, 2 * k) < k + fewest - 1:
                        continue
                    for of, side in ((doc, x), (owner, y)):
                        low = max(0, int(side[0]) - flank)
                        rows.append((of, doc, owner, n, of == doc, low, int(side[-1]) + k + flank - low, side.tolist()))
                if len(rows) >= 4096:
                    yield chain_batch(rows)
                    rows = []
            if rows:
                yield chain_batch(rows)

    names = ["of", "doc", "owner", "chain", "mine", "low", "length", "places"]

    def straight_chains(doc: np.ndarray, owner: np.ndarray, here: np.ndarray, there: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
        """Rows of chains that are all anchors of a document and an owner: the document's side, then the owner's."""
        size = stop - start
        ends = np.cumsum(size)
        every = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)
        low = [np.maximum(0, side[start] - flank) for side in (here, there)]
        length = [side[stop - 1] + k + flank - x for side, x in zip((here, there), low)]
        offsets = np.concatenate([[0], ends, (ends[-1] if len(ends) else 0) + ends]).astype(np.int32)
        places = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([here[every], there[every]]).astype(np.int32)))
        n = len(start)
        both = lambda x, y, kind: pa.array(np.concatenate([x, y]).astype(kind))
        return pa.RecordBatch.from_arrays(
            [both(doc[start], owner[start], np.int64), both(doc[start], doc[start], np.int64), both(owner[start], owner[start], np.int64),
             pa.array(np.zeros(2 * n, dtype=np.int32)), both(np.ones(n), np.zeros(n), bool), both(*low, np.int32), both(*length, np.int32), places],
            names=names,
        )

    def chain_batch(rows: list[tuple]) -> pa.RecordBatch:
        of, d, o, n, mine, low, length, places = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(of, pa.int64()), pa.array(d, pa.int64()), pa.array(o, pa.int64()), pa.array(n, pa.int32()), pa.array(mine), pa.array(low, pa.int32()),
             pa.array(length, pa.int32()), pa.array(places, pa.list_(pa.int32()))],
            names=names,
        )

    every = named.mapInArrow(seed_rows, "part int, kind int, n int, seed binary, doc binary, at binary").repartition("part").sortWithinPartitions("part", "kind")
    anchors = every.mapInArrow(anchor_rows, "part int, kind int, n int, doc binary, owner binary, at binary, there binary")
    sorted_anchors = anchors.repartition("part").sortWithinPartitions("part")
    chains = sorted_anchors.mapInArrow(chain_rows, "of long, doc long, owner long, chain int, mine boolean, low int, length int, places array<int>")

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            hashes = [words(t.as_py()).view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hashes, pa.binary())], names=["of", "text_hash", "words"])

    texts = named.select("doc", F.xxhash64("text"), "text").mapInArrow(hash_rows, "of long, text_hash long, words binary")
    around = F.substring("words", WIDTH * F.col("low") + 1, WIDTH * F.col("length"))
    segments = chains.join(texts, "of").select("doc", "owner", "chain", "mine", "low", "places", "text_hash", around.alias("words"))

    def alike(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
        """Places of the words of ``x`` that match ``y`` along a chain; none if the chain's anchors are not of these texts."""
        first, last, shift = int(px[0]), int(px[-1]) + k, int(py[0] - px[0])
        straight = last <= len(x) and last + shift <= len(y) and (py - px == shift).all()
        if not (straight and np.array_equal(x[first:last], y[first + shift : last + shift])):
            same = equal_runs(x, y, px, py, k)
            return align(x, y, px[same], py[same], k).nonzero()[0] if same.any() else px[:0]
        back, ahead = min(first, first + shift), min(len(x) - last, len(y) - last - shift)
        before = _outwards(x[first - back : first][::-1] == y[first + shift - back : first + shift][::-1])[::-1].nonzero()[0] + first - back
        after = _outwards(x[last : last + ahead] == y[last + shift : last + shift + ahead]).nonzero()[0] + last
        return np.concatenate([before, np.arange(first, last), after])

    def passage_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in stream_groups(batches, "part"):
            doc, owner, number, low, text = (table.column(c).to_numpy() for c in ("doc", "owner", "chain", "low", "text_hash"))
            mine = table.column("mine").to_numpy(zero_copy_only=False)
            places_at, places = list_column(table, "places")
            words_at, words = word_numbers(table.column("words"))
            found: dict[tuple[int, int], tuple[list[np.ndarray], list[int]]] = {}
            cuts = (np.flatnonzero((doc[1:] != doc[:-1]) | (owner[1:] != owner[:-1]) | (number[1:] != number[:-1])) + 1).tolist()
            for at, stop in zip([0, *cuts], [*cuts, len(doc)]):
                own = int(np.count_nonzero(mine[at:stop]))
                seen = set()
                for a in range(at, at + own):
                    for b in range(at + own, stop):
                        if (text[a], text[b]) in seen:  # repeated rows
                            continue
                        seen.add((text[a], text[b]))
                        px, py = places[places_at[a] : places_at[a + 1]] - low[a], places[places_at[b] : places_at[b + 1]] - low[b]
                        hits = alike(words[words_at[a] : words_at[a + 1]], words[words_at[b] : words_at[b + 1]], px, py)
                        if len(hits) >= k + fewest - 1:
                            matched, owners = found.setdefault((int(doc[a]), int(text[a])), ([], []))
                            matched.append(hits + low[a])
                            owners.append(int(owner[a]))
            rows: list[tuple] = []
            for (d, h), (matched, owners) in found.items():
                starts, stops, counts = similar_parts(np.unique(np.concatenate(matched)), skip, min_words, similar)
                if not len(starts):
                    continue
                spans = [intervals(m, skip) for m in matched]
                span_starts, span_stops = (np.concatenate([s[i] for s in spans]) for i in (0, 1))
                span_owners = np.repeat(owners, [len(s[0]) for s in spans])
                for first, last, count in zip(starts.tolist(), stops.tolist(), counts.tolist()):
                    rows.append((d, h, first, last - first, count, np.unique(span_owners[(span_starts < last) & (span_stops > first)])))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=["doc_id", "text_hash", "start_word", "n_words", "matched", "sources"])

    dealt = segments.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(8 * parts)).cast("int")).repartition("part")
    arranged = dealt.sortWithinPartitions("part", "doc", "owner", "chain", F.desc("mine"))
    return arranged.mapInArrow(passage_rows, "doc_id long, text_hash long, start_word int, n_words int, matched int, sources array<long>")


def remove_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` without its passages; a text with nothing left goes, others keep their columns, with n_chars of the new text.

    A passage is cut out of the text it was found in, told by doc_id and ``text_hash``.
    """
    spans = F.sort_array(F.collect_set(F.struct(F.col("start_word").alias("a"), F.col("n_words").alias("n"))))
    cuts = passages.groupBy(F.col("doc_id").alias("__llm_id"), F.col("text_hash").alias("__llm_hash")).agg(spans.alias("__llm_cuts"))
    same = (F.col("doc_id").cast("long") == F.col("__llm_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__llm_hash"))
    joined = docs.join(cuts, same, "left").drop("__llm_id", "__llm_hash")
    columns = docs.columns
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        find = re.compile(WORD).finditer
        for batch in batches:
            texts = []
            for text, cuts_of in zip(batch.column("text").to_pylist(), batch.column("__llm_cuts").to_pylist()):
                if not cuts_of or text is None:
                    texts.append(text)
                    continue
                spans = [(m.start(), m.end()) for m in find(text)]
                out, at = [], 0
                for c in cuts_of:
                    first, last = c["a"], min(c["a"] + c["n"], len(spans)) - 1
                    if first <= last and spans[last][1] > at:  # passages may overlap
                        out.append(text[at : max(at, spans[first][0])])
                        at = spans[last][1]
                rest = "".join([*out, text[at:]])
                texts.append(rest if rest.strip() else None)
            new = pa.array(texts, pa.string())
            arrays = [new if c == "text" else batch.column(c) for c in columns]
            if "n_chars" in columns:
                at = columns.index("n_chars")
                changed = pc.utf8_length(new)
                keep = pc.is_null(batch.column("__llm_cuts"))
                arrays[at] = pc.if_else(keep, batch.column("n_chars"), changed.cast(batch.column("n_chars").type))
            gone = pc.and_(pc.is_null(new), pc.is_valid(batch.column("__llm_cuts")))
            yield pa.RecordBatch.from_arrays(arrays, names=list(columns)).filter(pc.invert(gone))

    return joined.select(*[F.col(f"`{c}`") for c in columns], "__llm_cuts").mapInArrow(run, schema)
