import hashlib
import random
import re
import zlib

import numpy as np

from foldgraph.llm import periodic, queries


def brute(words, least=6, times=4):
    """Runs (start, length, period) by trying every period at every place."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def loops(seed, alphabet):
    """Words with repeated stretches of many lengths, nested and side by side."""
    rng = random.Random(seed)
    words = []
    while rng.random() < 0.85:
        period = [f"w{rng.randrange(alphabet)}" for _ in range(rng.randint(1, 7))]
        if rng.random() < 0.2:
            period = period * 3 + ["odd"]
        words += (period * rng.randint(1, 9))[: rng.randint(1, 60)]
    return " ".join(words)


def got(df):
    return sorted((r.doc_id is None, r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in df.collect())


def test_equals_brute_force(table, edge):
    rows = [(i, loops(i, [1, 2, 3, 12, 400][i % 5])) for i in range(400)]
    rows += [(5000, "a " * 7000), (5001, " ".join(["x y z"] * 900 + ["x y"])), (5002, "é b é b é b é b é b é b"), (5003, "a\x1cb " * 6)]
    rows += [(i, t) for i, t, *_ in edge if not t or len(t) < 5000]
    want = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = brute(words)
        want.append((i is None, i, runs, collapsed(words, runs)))
    assert got(periodic.periodic_runs(table(rows))) == sorted(want)


def test_very_long_and_empty(table, prose):
    long = prose(1, 60_000) + " " + "p q r " * 50_000 + prose(2, 60_000)
    [(_, _, runs, text)] = got(periodic.periodic_runs(table([(1, long)])))
    assert runs == [(60_000, 150_000, 3)] and text.split() == prose(1, 60_000).split() + ["p", "q", "r"] + prose(2, 60_000).split()
    assert got(periodic.periodic_runs(table([]))) == []


def test_segments_split_at_rare_words():
    codes = np.array([0, 1, 0, 1, 0, 1, 0, 1, 2, 0, 1, 0, 3, 3, 3, 3, 3, 3, 3])
    start, stop = periodic.segments(codes, np.array([len(codes)]), 6, 4)
    assert sorted(zip(start.tolist(), stop.tolist())) == [(0, 8), (12, 19)]


def test_query_plants_loops_and_digests(spark, prose, tmp_path):
    rows = [(i, [prose(i, 5 + i % 90), None, "", "a b a b a b a b a b"][min(3, i % 7)], "en", "s", 0) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, text, *_ in rows:
        words = (text or "").split()
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (j - a) % p] for j in range(a, n)]
        runs = brute(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        milli = 1000 * best[1] // best[2] if runs else None
        want[i] = (len(runs), *best, milli, digest, hashlib.sha256(collapsed(words, runs).encode()).hexdigest())
    out = queries.op12_periodic_runs(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {r[0]: tuple(r[1:]) for r in out.collect()} == want
    assert any(v[0] and v[3] > 1 for v in want.values())
