import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from foldgraph.llm import byte_pairs as bp, packing as pk
from tests.llm.conftest import SF

BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD = ["<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "\x1c\x1d x\x85y", "İstanbul ΑΣ Σ ß", "e\u0301 n\u0303", "don't I'll 'S", "a" * 3000, "12 345² ½", "\u200b\ufeff\u3000x",
       "<|startoftext|> hi", "A\u030angstrom \u212b \ufb01", " \n\n x  \t"]


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def texts(edge):
    rng, pool = random.Random(3), "abzéß中😀́ \n\t'sl019½_-.,!?AB"
    mixed = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    return [(i, t) for i, t in enumerate([t for _, t in edge] + ODD + mixed)]


def test_byte_pairs_equal_the_library(table, texts):
    t = library(BYTES)
    got = {r.doc_id: r for r in bp.encode_documents(table(texts), BYTES, with_ids=True).collect()}
    for i, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_compatible_pairs_are_what_merging_leaves(texts):
    t, encoder = library(BYTES), bp.Encoder(open(BYTES, encoding="utf-8").read())
    rng = random.Random(5)
    for _ in range(2000):
        a, b = rng.randrange(50256), rng.randrange(50256)
        joined = encoder.bytes[a] + encoder.bytes[b]
        if joined.isalpha() and joined.isascii():
            apart = t.encode(joined.decode(), add_special_tokens=False).ids == [a, b]
            assert encoder._stays_apart(a, b, 10**6, 10**6) == apart


def test_byte_pairs_of_nothing(table):
    assert bp.encode_documents(table([]), BYTES).count() == 0


def check_packing(rows, docs, capacity=4096):
    t = library(WORDS)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for p in sorted(by_doc.pop(i), key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(ids)
    assert not by_doc and sorted(by_sequence) == list(range(len(by_sequence)))
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
        total += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding, total


def test_packing_is_exact(table, texts):
    check_packing(pk.pack_documents(table(texts), WORDS).collect(), texts)


def test_packing_pads_little(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    padding, total = check_packing(pk.pack_documents(docs, WORDS).collect(), rows)
    assert padding < 4096 + 0.005 * total


def test_packing_edges(table, edge):
    rows = pk.pack_documents(table(edge), WORDS, rows_per_bucket=10).collect()
    assert sum(r.length for r in rows if r.start == 0 and r.doc_id == 1) == 1
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert pk.pack_documents(table([]), WORDS).count() == 0
    with pytest.raises(ValueError):
        pk.pack_documents(table([]), WORDS, capacity=100, grid=64)


def test_knapsack_and_patterns():
    rng = random.Random(2)
    for _ in range(20):
        sizes = sorted(rng.sample(range(1, 30), 5))
        values = np.array([rng.random() for _ in sizes])
        best, counts = pk.price(values, np.array(sizes), 40)
        every = [0.0] * 41
        for room in range(1, 41):
            every[room] = max([every[room - 1], *(every[room - s] + v for s, v in zip(sizes, values) if s <= room)])
        assert abs(best - every[40]) < 1e-9 and abs(counts @ values - best) < 1e-9 and counts @ np.array(sizes) <= 40
        demand = [rng.randint(1, 500) for _ in sizes]
        solved = pk.patterns(sizes, demand, 40, close=1.0)
        assert np.allclose(sum(c * u for c, u in solved), demand)
        assert all(c @ np.array(sizes) <= 40 for c, u in solved if u > 1e-9)
        assert sum(u for _, u in solved) >= np.dot(sizes, demand) / 40 - 1e-6
