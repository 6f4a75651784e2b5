import random

import numpy as np

from foldgraph.llm import jaccard as jj, passages as ps
from foldgraph.llm.common import components


def runs(text, size=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, threshold=0.8):
    """class, links and linked texts of rows with distinct ids."""
    sets = {i: runs(t) for i, t in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}
    links, texts = {i: 0 for i in ids}, {i: set() for i in ids}
    for a in ids:
        for b in ids:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                if sets[a] != sets[b]:
                    texts[a].add(frozenset(sets[b]))
                    texts[b].add(frozenset(sets[a]))
                low = min(root[a], root[b])
                old = {root[a], root[b]}
                root = {k: low if v in old else v for k, v in root.items()}
    return {i: (root[i], links[i], len(texts[i])) for i in ids}


def edited(text, rate, seed):
    rng = random.Random(seed)
    return " ".join(w if rng.random() > rate else f"x{rng.randrange(10**6)}" for w in text.split())


def corpus(prose):
    rows = [(i, prose(i, 20 + 7 * (i % 40))) for i in range(150)]
    rows += [(1000 + i, edited(prose(i % 10, 200), 0.01 * (i % 6), i)) for i in range(120)]  # near copies, some near the threshold
    rows += [(2000 + i, prose(77, 90)) for i in range(60)]  # copies
    rows += [(3000 + i, prose(5, 40) + " " + prose(3000 + i, 30)) for i in range(90)]  # one passage in many
    rows += [(4000, "a b"), (4001, "A b"), (4002, "a"), (4003, "")]
    return rows


def got(df):
    return {r.doc_id: (r.class_id, r.n_links, r.n_texts) for r in df.collect()}


def test_join_equals_brute_force(table, prose):
    rows = corpus(prose)
    assert got(jj.jaccard_join(table(rows))) == brute(rows)


def test_split_buckets_and_blocks_lose_nothing(table, prose):
    rows = corpus(prose)
    want = brute(rows)
    assert got(jj.jaccard_join(table(rows), runs=16, small=8, depth=2, again=6, block=10)) == want


def test_join_on_supplied_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(jj.jaccard_join(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_join_edges(table, edge):
    docs = table(edge)
    joined = jj.jaccard_join(docs)
    rows = joined.collect()
    assert len(rows) == len(edge)
    assert all((r.class_id, r.n_links) == (r.doc_id, 0) for r in rows if r.doc_id in (1, 2, 3, 4) or r.doc_id is None)
    assert {r.class_id for r in rows if r.doc_id == 7} == {7}
    kept = jj.keep_first(docs, joined)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(7) == 1 and ids.count(None) == 2
    assert jj.jaccard_join(table([])).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000 + rng.randrange(200), 1000 + rng.randrange(200)) for _ in range(150)]
    root = {n: n for e in edges for n in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    df = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in df.collect()} == {n: r for n, r in root.items() if n != r}


def test_chain_equals_quadratic_search():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(1, 30))
        here, there = np.sort(rng.integers(0, 40, n)), rng.integers(0, 40, n)
        best = []
        for i in range(n):
            linked = [best[j] - 0.1 * (here[i] - here[j] + there[i] - there[j]) for j in range(i) if here[j] < here[i] and there[j] < there[i]]
            best.append(1.0 + max([0.0, *linked]))
        chains = ps.chain(here, there, 1.0, 0.1)
        first = chains[0]
        steps = np.diff(here[first]) + np.diff(there[first])
        assert abs(len(first) - 0.1 * steps.sum() - max(best)) < 1e-9
        assert (np.diff(here[first]) > 0).all() and (np.diff(there[first]) > 0).all()
        assert sorted(np.concatenate(chains).tolist()) == list(range(n))


def covered(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, set()).update(range(r.start_word, r.start_word + r.n_words))
    return out


def brute_covered(rows, least):
    """Words in exact common substrings of ``least`` words or more with an earlier document."""
    out, before = {}, set()
    for i, text in sorted(rows):
        w = text.lower().split()
        grams = [tuple(w[j : j + least]) for j in range(len(w) - least + 1)]
        out[i] = {j + d for j, g in enumerate(grams) if g in before for d in range(least)}
        before.update(grams)
    return {i: s for i, s in out.items() if s}


def test_exact_passages_are_found(table, prose):
    passage = [prose(900 + p, 60) for p in range(3)]
    rows = [(i, prose(i, 100) + " " + " ".join(passage[p] for p in range(3) if i >> p & 1) + " " + prose(500 + i, 50)) for i in range(40)]
    found, want = covered(ps.repeated_passages(table(rows))), brute_covered(rows, 50)
    assert set(found) == set(want)
    for i, words in want.items():
        assert len(words - found[i]) <= 2 and len(found[i] - words) <= 4  # the word beside a passage may agree with another source


def test_fuzzy_passages_and_clean_documents(table, prose):
    passage = prose(901, 80)
    rows = [(1, prose(1, 60) + " " + passage + " " + prose(2, 60)), (2, prose(3, 200)), (3, prose(4, 30) + " " + edited(passage, 0.06, 5) + " " + prose(6, 30))]
    got = ps.repeated_passages(table(rows)).collect()
    assert [(r.doc_id, r.sources) for r in got] == [(3, [1])]
    assert got[0].start_word <= 40 and got[0].start_word + got[0].n_words >= 100 and 30 <= got[0].start_word + 5


def test_removal(table, prose, edge):
    passage = prose(902, 70)
    rows = [(1, passage), (2, "Before " + passage + " after"), (3, passage)]
    docs = table(rows)
    left = {r.doc_id: (r.text, r.n_chars) for r in ps.remove_passages(docs, ps.repeated_passages(docs)).collect()}
    assert left == {1: (passage, len(passage)), 2: ("Before  after", 13)}
    docs = table(edge)
    passages = ps.repeated_passages(docs)
    assert {r.doc_id for r in passages.collect()} == {8}
    out = ps.remove_passages(docs, passages)
    assert out.columns == docs.columns and {1, 2, 3, 4} <= {r.doc_id for r in out.collect()}
    assert ps.repeated_passages(table([])).count() == 0


def test_minimizers_and_matches_between_anchors_against_loops():
    rng = np.random.default_rng(5)
    for n, k, window in ((5, 6, 16), (9, 6, 16), (300, 6, 16), (300, 3, 5), (40, 2, 1)):
        hashes = rng.integers(0, 4 if k == 3 else 2**60, n).astype(np.uint64)
        at, values = ps.seeds(hashes, k, window)
        _, every = ps.seeds(hashes, k, 1)
        starts = range(max(1, len(every) - window + 1)) if len(every) else []
        assert at.tolist() == sorted({min(range(s, min(s + window, len(every))), key=lambda i: (int(every[i]) >> 24, i)) for s in starts})
        assert values.tolist() == every[at].tolist()
    for p, q, matched in (
        ([1, 2, 3], [1, 2, 3], [1, 1, 1]), ([1, 9, 3], [1, 2, 3], [1, 0, 1]), ([], [1], []), ([1], [], [0]), ([1, 1], [1], [1, 0]),
        ([1, 2, 3, 4, 5, 6], [1, 3, 4, 7, 5, 6], [1, 0, 1, 1, 1, 1]), ([7, 8], [1, 2], [0, 0]),
    ):
        assert ps.between(np.array(p, dtype=np.int32), np.array(q, dtype=np.int32)).tolist() == [bool(m) for m in matched]
    starts, stops, counts = ps.intervals(np.array([0, 1, 5, 20]), 4)
    assert (starts.tolist(), stops.tolist(), counts.tolist()) == ([0, 20], [6, 21], [3, 1])


def test_exact_passages_beside_loose_matches_stay(table):
    rng = random.Random(12)
    word = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    first, middle, last = word(55), word(234), word(55)
    loose = [w if i % 19 >= 6 else f"y{i}" for i, w in enumerate(middle)]  # 13 equal, 6 not: no gap ends the run
    rows = [(1, " ".join(word(30) + first + middle + last + word(30))), (2, " ".join(word(30) + first + loose + last + word(30)))]
    docs = table(rows)
    passages = ps.repeated_passages(docs)
    found = covered(passages)
    assert set(found) == {2} and set(range(30, 85)) | set(range(319, 374)) <= found[2]
    assert all(r.matched >= 0.8 * r.n_words and r.n_words >= 45 for r in passages.collect())
    left = {r.doc_id: r.text.split() for r in ps.remove_passages(docs, passages).collect()}
    assert not set(left[2]) & {*first, *last} and left[2] == [w for i, w in enumerate(rows[1][1].split()) if i not in found[2]]


def test_similar_parts_against_loops():
    rng = np.random.default_rng(8)
    for _ in range(300):
        at = np.flatnonzero(rng.random(60) < rng.choice([0.6, 0.75, 0.9]))
        good = [
            (int(at[i]), int(at[j]) + 1, j - i + 1) for i in range(len(at)) for j in range(i, len(at))
            if at[j] + 1 - at[i] >= 12 and 5 * (j - i + 1) >= 4 * (at[j] + 1 - at[i]) and (np.diff(at[i : j + 1]) <= 4).all()
        ]
        want = [g for g in good if not any(o != g and o[0] <= g[0] and g[1] <= o[1] for o in good)]
        assert list(zip(*(x.tolist() for x in ps.similar_parts(at, 3, 12, 0.8)))) == want


def test_recall_of_partly_rewritten_passages(table):
    """Passages of 45 to 80 words, 80 to 95 % alike, evenly or randomly changed: all that brute force counts are found."""
    rng = random.Random(21)
    word = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows, wanted = [], {}
    for share in (0.8, 5 / 6, 0.9, 0.95):
        for words in (45, 50, 60, 80):
            for even in (True, False):
                for _ in range(4):
                    passage = word(words)
                    n = int((1 - share) * words + 1e-9)
                    changed = set([round((i + 0.5) * words / max(1, n)) for i in range(n)] if even else rng.sample(range(1, words - 1), n))
                    copy = [f"x{rng.randrange(10**9)}" if i in changed else w for i, w in enumerate(passage)]
                    same = np.array([i not in changed for i in range(words)]).nonzero()[0]
                    source, doc = 2 * len(wanted) + 1, 2 * len(wanted) + 2
                    rows += [(source, " ".join(word(40) + passage + word(40))), (doc, " ".join(word(25) + copy + word(25)))]
                    parts = ps.similar_parts(same, 6, 45, 0.8)
                    wanted[doc] = {25 + i for a, b, _ in zip(*parts) for i in range(a, b)}
    found = covered(ps.repeated_passages(table(rows)))
    held = {d: w for d, w in wanted.items() if w}
    assert len(held) > 100 and set(found) <= set(held)
    lost = [d for d, w in held.items() if len(w & found.get(d, set())) < 0.9 * len(w)]
    assert not lost, (len(lost), len(held), [(d, len(wanted[d])) for d in lost])


def test_splits_keep_the_recall_of_pairs_at_the_threshold(table):
    """2,000 pairs of a similarity of 0.8, every bucket split three times, with the query's own runs and further tokens."""
    rng = random.Random(31)
    word = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for i in range(2000):
        text = word(94)  # 90 runs of five words, of which 72 are all of the other text
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(text[:76]))]
    lost = jj.jaccard_join(table(rows), small=1).where("doc_id % 2 = 1 and n_links = 0").count()
    assert lost <= 3  # 0.03 % are 0.6


def test_passages_whose_short_runs_have_other_owners(table):
    """Two documents share 60 words; each four of them in a row stand in some earlier document as well."""
    rng = random.Random(41)
    word = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage = word(60)
    rows = [(i, " ".join(word(30) + passage[i : i + 4] + word(30))) for i in range(57)]
    rows += [(1000, " ".join(word(30) + passage + word(30))), (1001, " ".join(word(40) + passage + word(20)))]
    for at_once in (500_000, 200):
        found = covered(ps.repeated_passages(table(rows), words_at_once=at_once))
        assert set(found) == {1001} and found[1001] == set(range(40, 100))


def test_common_seeds_stream_through_small_parts(table, prose):
    """A passage in half of all documents, with tasks that send and resolve seeds a few hundred words at a time."""
    passage = prose(7777, 70)
    rows = [(i, prose(i, 50) + " " + (passage + " " if i % 2 else "") + prose(900 + i, 40)) for i in range(160)]
    found = covered(ps.repeated_passages(table(rows), words_at_once=300, words_per_part=500))
    assert set(found) == set(range(3, 160, 2)) and all(set(range(50, 120)) <= f and len(f) <= 74 for f in found.values())


def test_recall_of_words_put_in_and_left_out(table):
    """Passages of 60 to 100 words with up to a tenth of them left out, or as many put in, at random."""
    rng = random.Random(51)
    word = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows, wanted = [], {}
    for n in (60, 80, 100):
        for share in (0.03, 0.06, 0.1):
            for kind in ("out", "in"):
                for _ in range(4):
                    passage, chosen = word(n), set(rng.sample(range(1, n - 1), int(share * n)))
                    copy = [w for i, w in enumerate(passage) if i not in chosen] if kind == "out" else [x for i, w in enumerate(passage) for x in ([w, *word(1)] if i in chosen else [w])]
                    source = 2 * len(wanted) + 1
                    rows += [(source, " ".join(word(40) + passage + word(40))), (source + 1, " ".join(word(25) + copy + word(25)))]
                    wanted[source + 1] = set(range(25, 25 + len(copy)))
    found = covered(ps.repeated_passages(table(rows)))
    whole = sum(len(w & found.get(d, set())) >= 0.9 * len(w) for d, w in wanted.items())
    assert set(found) <= set(wanted) and whole >= 0.9 * len(wanted), (whole, len(wanted))


def test_texts_that_share_an_id_are_told_apart(spark, table, prose):
    a, b, passage = prose(1, 90), prose(2, 200), prose(3, 70)
    docs = table([(7, a), (8, a), (8, b)])
    kept = jj.keep_first(docs, jj.jaccard_join(docs))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(7, a), (8, b)]
    docs = table([(1, prose(4, 20) + " " + passage), (2, prose(5, 30) + " " + passage), (2, b), (2, b)])
    found = ps.repeated_passages(docs)
    left = sorted(r.text for r in ps.remove_passages(docs, found).where("doc_id = 2").collect())
    assert covered(found) == {2: set(range(30, 100))} and left == sorted([b, b, prose(5, 30) + " "])


def test_keep_first_with_columns_that_have_no_order(spark, prose):
    text = prose(1, 60)
    docs = spark.createDataFrame([(1, text, {"a": 1}), (1, text, {"a": 2}), (2, text, {}), (3, prose(2, 60), None)], "doc_id long, text string, more map<string,int>")
    kept = jj.keep_first(docs, jj.jaccard_join(docs))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, text), (3, prose(2, 60))] and kept.columns == docs.columns


def test_dealt_numbers_come_back_and_take_little_room():
    rng = np.random.default_rng(3)
    doc = np.repeat(np.sort(rng.integers(-(2**62), 2**62, 300)), 40)
    doc = np.concatenate([doc, [2**63 - 1, -(2**63), 0]])
    columns = {"seed": rng.integers(0, 2**32, len(doc)).astype(np.uint32), "doc": doc, "at": (np.arange(len(doc)) % 700).astype(np.int32)}
    part = rng.integers(0, 8, len(doc)).astype(np.int32)
    rows = ps.dealt_rows(part, columns, 2)
    assert sum(rows.column("n").to_pylist()) == len(doc) and sum(len(x) for x in rows.column("doc").to_pylist()) < 3 * len(doc)
    for i in range(rows.num_rows):
        row = rows.slice(i, 1)
        here = part == rows.column("part")[i].as_py() * 2 + rows.column("kind")[i].as_py()
        for name, values in columns.items():
            np.testing.assert_array_equal(ps.unpacked(row, name, values.dtype), values[here])
    for name, values in columns.items():
        order = np.argsort(part, kind="stable")
        np.testing.assert_array_equal(ps.unpacked(rows, name, values.dtype), values[order])
