import hashlib

import xxhash
from pyspark.sql import functions as F

from foldgraph.llm import fingerprints as fp

M = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hash_long(value, seed):
    return xxhash.xxh64_intdigest((value & M).to_bytes(8, "little"), seed=seed & M)


def bins(text):
    """One-permutation MinHash written out: the least hash of each bin, empty ones from the best-ranked other."""
    words = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in (text or "").lower().split()]
    runs = [words[i : i + 5] for i in range(max(1, len(words) - 4))] if words else []
    least = {}
    for run in runs:
        h = 42
        for w in run:
            h = hash_long(w, h)
        h = signed(h)
        least[h >> 57] = min(h, least.get(h >> 57, h))
    if not least:
        return []
    out = []
    for b in range(-64, 64):
        if b in least:
            out.append(least[b] & 255)
        else:
            out.append(min(signed((hash_long(c, hash_long(b, 42)) & ~255 & M) | (h & 255)) for c, h in least.items()) & 255)
    return out


def likeness(a, b):
    if not a or not b:
        return float(not a and not b)
    return max(0.0, (sum(x == y for x, y in zip(a, b)) / 128 - 1 / 256) / (1 - 1 / 256))


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    out = {}
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = bins(text), bins(edited), bins(after)
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{x:02x}" for x in a), "".join(f"{x:02x}" for x in b),
                  round(likeness(a, b), 9), round(likeness(a, c), 9))
    return out


def got(df):
    return {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()}


def test_equals_brute_force(table, prose):
    rows = [(i * 3, prose(i % 17, 5 + 13 * (i % 29))) for i in range(1300)]
    rows += [(10_000, None), (10_001, ""), (10_002, "one"), (10_003, "Éa naïve 中文 \U0001f600"), (2**40, prose(3, 3000)), (-5, prose(3, 3000))]
    assert got(fp.edited_fingerprints(table(rows))) == brute(rows)


def test_edges(table, edge):
    df = fp.edited_fingerprints(table(edge))
    rows = df.collect()
    assert len(rows) == len(edge)
    same = {r.fingerprint for r in rows if r.doc_id == 7}
    assert len(same) == 1 and len(same.pop()) == 256
    assert {r.fingerprint for r in rows if r.doc_id in (1, 2, 3)} == {""}
    assert fp.edited_fingerprints(table([])).count() == 0
    alone = fp.edited_fingerprints(table([(1, "a b c d e f g h i")])).first()
    assert alone.near_next == 1.0


def test_estimates_similarity(spark, prose):
    base = prose(1, 900).split()
    other = base[:450] + prose(2, 450).split()
    df = spark.createDataFrame([(" ".join(base), " ".join(other))], "a string, b string")
    value = df.select(fp.likeness(fp.bin_values(fp.shingle_hashes(F.col("a"))), fp.bin_values(fp.shingle_hashes(F.col("b"))))).first()[0]
    a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (base, other))
    assert abs(value - len(a & b) / len(a | b)) < 0.15


def test_no_python_in_the_plan(table, prose):
    plan = fp.edited_fingerprints(table([(1, prose(1, 30))]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
