import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from foldgraph.llm import filter_audit as fa

LABELS = "doc_id long, quality int, toxic int"


def fails(rows):
    """The letters each row fails, by definition."""
    out = []
    for doc_id, text, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        letters = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text))
        letters += "D" * bool(re.search("[#$%&*|]", text))
        letters += "E" * any(doc_id is not None and i is not None and i < doc_id and (t or "") == text for i, t, *_ in rows)
        out.append(letters)
    return out


def brute(rows, labels):
    good, toxic = ({r[0] for r in labels if r[0] is not None and r[k] == 1} for k in (1, 2))
    marks, out = fails(rows), {}
    shapley = {}
    for order in map("".join, permutations("ABCDE")):
        for row, failed in zip(rows, marks):
            first = next((x for x in order if x in failed), None)
            if first:
                shapley[(row[2] or "", first)] = shapley.get((row[2] or "", first), 0) + 1
            for step, letter in enumerate(order, 1):
                got = out.setdefault((row[2] or "", order, step), [0] * 6)
                gone = any(x in failed for x in order[: step - 1])
                got[0] += not gone and letter not in failed
                got[1] += not gone and letter in failed
                got[2] += gone and letter in failed
                got[3] += failed == letter
                got[4] += not gone and letter in failed and row[0] in good
                got[5] += not gone and letter in failed and row[0] in toxic
    return {k: (*v, shapley.get((k[0], k[1][k[2] - 1]), 0)) for k, v in out.items()}


def audited(docs, labels, **options):
    df = fa.interactions(fa.combinations(docs, labels, fa.FILTERS, **options), "ABCDE")
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def corpus(prose, edge):
    rows = [(i, prose(i % 25, 40 + 9 * (i % 20)), ["en", "fr", None, ""][i % 4]) for i in range(80)]
    rows += [(100 + i, prose(3, 200) if i % 3 else "A# " * 120, "en") for i in range(60)]
    return rows + [(*r, "de")[:3] for r in edge] + [(-5, "", None), (500, prose(2, 120).upper(), "en"), (501, "x | y", "fr")]


@pytest.mark.parametrize("key", [F.xxhash64, lambda t: F.length(t).cast("long")], ids=["hash", "weak"])
def test_equals_brute_force_even_where_hashes_collide(spark, table, prose, edge, key):
    rows = corpus(prose, edge)
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 160, 2)] + [(4, None, 1), (4, 1, None), (None, 1, 1)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    assert audited(table(rows), spark.createDataFrame(labels, LABELS), key=key) == brute(rows, labels)


def test_empty_tables(spark, table, prose):
    none = spark.createDataFrame([], LABELS)
    assert audited(table([]), none) == {}
    assert audited(table([(1, prose(1, 120), "en")]), none) == brute([(1, prose(1, 120), "en")], [])
