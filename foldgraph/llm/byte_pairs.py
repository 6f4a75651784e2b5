"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foldgraph.llm.common import worker_state

#: Fixed value: the split of byte-level vocabularies before any merge.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces remembered by a worker; beyond it the memory starts anew, results are the same.
MEMORY = 500_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """A byte-level BPE vocabulary, from the text of its ``tokenizers`` file.

    ``pairs`` is the compatibility table's ground: a merge of two tokens and
    the token it makes. Token numbers must follow the order of the merges.
    """

    def __init__(self, document: str):
        import ahocorasick
        import regex

        spec = json.loads(document)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.bytes: list[bytes] = [b""] * size
        for word, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in word)
        self.single = [0] * 256
        for i in vocab.values():
            if len(self.bytes[i]) == 1:
                self.single[self.bytes[i][0]] = i
        self.parts: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        last = max(self.single)
        for merge in merges:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            made = vocab[left + right]
            if made <= last:
                raise ValueError("token numbers do not follow the merges")
            last = made
            self.parts[made] = (vocab[left], vocab[right])
            self.pairs[vocab[left], vocab[right]] = made
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.bytes[i] = content.encode()
        self.compatible: dict[int, bool] = {}
        # Tokens that the merges of their own bytes do make; no other can ever come out.
        whole = set(self.single)
        for t, (left, right) in self.parts.items():
            if left in whole and right in whole and self._stays_apart(left, right, t, t):
                whole.add(t)
        number = {self.bytes[t]: t for t in whole}
        self.shorter = {}
        for t in whole:
            b = self.bytes[t]
            self.shorter[t] = next((number[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in number), -1)
        self.matcher = ahocorasick.Automaton()
        for t in whole:
            if len(self.bytes[t]) > 1:
                self.matcher.add_word(self.bytes[t].decode("latin-1"), t)
        if len(self.matcher):
            self.matcher.make_automaton()
        self.size = [len(b) for b in self.bytes]
        self.whole = {b.decode("latin-1"): t for b, t in number.items()}
        self.find = regex.compile(PIECES).findall
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        self.little = [i.to_bytes(4, "little") for i in range(size)]
        self.packed = _Memory(self)
        self.blob = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(self.size)])

    def _stays_apart(self, a: int, b: int, taken_a: int, taken_b: int) -> bool:
        """Whether merging leaves the border between ``a`` and ``b``.

        Merges are undone from the latest on both sides of the border. A merge
        over the border would have happened if it came before the merge that
        takes either neighbour away; of equal ones, the left comes first.
        """
        while True:
            over = self.pairs.get((a, b))
            if over is not None and over < taken_a and over <= taken_b:
                return False
            if a > b and a in self.parts:
                taken_a, a = a, self.parts[a][1]
            elif b in self.parts:
                taken_b, b = b, self.parts[b][0]
            elif a in self.parts:
                taken_a, a = a, self.parts[a][1]
            else:
                return True

    def fits(self, border: int) -> bool:
        """The compatibility table: whether BPE leaves two neighbours alone; filled as pairs are met."""
        if len(self.compatible) >= 2 * MEMORY:
            self.compatible.clear()
        a, b = border >> 32, border & 0xFFFFFFFF
        known = self.compatible[border] = self._stays_apart(a, b, len(self.size), len(self.size))
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """The tokens of one piece: longest matches, shortened and taken back where neighbours do not fit."""
        text = piece.decode("latin-1")
        if text in self.whole:
            return [self.whole[text]]
        size, shorter, compatible, n = self.size, self.shorter, self.compatible, len(piece)
        longest = [self.single[b] for b in piece]
        for end, t in self.matcher.iter(text):
            start = end + 1 - size[t]
            if size[t] > size[longest[start]]:
                longest[start] = t
        out: list[int] = []
        closed: set[int] = set()  # places from which the rest cannot be encoded
        at, t = 0, longest[0]
        while at < n:
            end = at + size[t]
            fits = end not in closed
            if fits and out:
                border = out[-1] << 32 | t
                fits = compatible.get(border)
                if fits is None:
                    fits = self.fits(border)
            if fits:
                out.append(t)
                at = end
                if at < n:
                    t = longest[at]
            elif shorter[t] >= 0:
                t = shorter[t]
            else:
                closed.add(at)
                t = out.pop()
                at -= size[t]
        return out

    def encode(self, text: str) -> bytes:
        """All ids of a text, as little-endian unsigned 32-bit integers."""
        if self.split is None or not any(s in text for s in self.special):
            return b"".join(map(self.packed.__getitem__, self.find(text)))
        out = []
        for part in self.split(text):
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                out.extend(map(self.packed.__getitem__, self.find(part)))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: each token's bytes are found by its offsets in one row of bytes."""
        starts = self.offsets[ids]
        sizes = self.offsets[ids + 1] - starts
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        where = np.arange(total) + np.repeat(starts - (ends - sizes), sizes)
        return self.blob[where].tobytes().decode("utf-8", "replace")


class _Memory(dict):
    """Piece -> packed ids, filled as pieces come."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMORY:
            self.clear()
        ids = b"".join([self.encoder.little[t] for t in self.encoder.encode_piece(piece.encode())])
        if len(piece) <= 64:
            self[piece] = ids
        return ids


def encode_documents(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: key, n_tokens, ids_sha256, decoded_sha256; ``ids array<long>`` too on request.

    ``tokenizer`` is the path of a byte-level vocabulary file, read on the
    driver (a vocabulary bounds its size) and sent with the tasks. Texts are
    encoded whole, without special tokens of the template; a special token's
    own string inside a text is that token. Null texts are empty, an empty
    text has no tokens and the digests of nothing. Rows are independent: no
    shuffle, repeated rows give repeated rows, other columns are not read.
    """
    document = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))
    schema = f"{key} {dict(docs.dtypes)[key]}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state(f"bpe-{hashlib.sha256(document.value.encode()).hexdigest()}", lambda: Encoder(document.value))
        sha = hashlib.sha256
        for batch in batches:
            counts, digests, decoded, lists = [], [], [], []
            for value in batch.column(1):
                packed = encoder.encode(value.as_py() or "")
                ids = np.frombuffer(packed, dtype="<u4").astype(np.int64)
                counts.append(len(ids))
                digests.append(sha(packed).hexdigest())
                decoded.append(sha(encoder.decode(ids).encode()).hexdigest())
                if with_ids:
                    lists.append(ids)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, schema)
