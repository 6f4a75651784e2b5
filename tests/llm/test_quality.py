import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from foldgraph.llm import quality, queries

SF = "/root/testdata/sf0.001"


def brute(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def corpus(prose, edge):
    line = prose(5, 12)
    rows = [(r[0], r[1]) for r in edge] + [(100 + i, prose(i, 30 + 7 * i)) for i in range(30)]
    rows += [(200, "\n".join([line] * 9)), (201, "\n".join([prose(i, 10) for i in range(20)] + ["", " ", "\t", ""])), (202, "a b c a b c a b"), (203, "a a a a a"), (204, "a b"),
             (205, " ".join(w + "###" for w in prose(1, 90).split())), (206, prose(2, 90).upper()), (207, "\n".join(prose(i, 9) + "..." for i in range(12))),
             (208, " ".join("1234567" for _ in range(1)) + " " + " ".join(f"{i}{i}" for i in range(90))), (209, " | ".join(prose(3, 90).split())),
             (210, "é ü " * 60), (211, prose(7, 60) + " " + prose(7, 60) + " " + prose(8, 130))]
    return rows


def test_measures_equal_brute_force(table, prose, edge):
    rows = corpus(prose, edge)
    got = quality.judge_quality(table(rows)).collect()
    assert len(got) == len(rows)
    want = Counter((i, *brute(t)) for i, t in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    kept = {r.doc_id: r.kept for r in got}
    assert not any(kept[i] for i in (200, 202, 205, 206, 207, 208, 209)) and all(kept[100 + i] for i in range(3, 30)) and kept[211]
    assert not any(r.kept and r.base_failed for r in got)


def test_empty_table_and_no_python(table, prose):
    assert quality.judge_quality(table([])).collect() == []
    plan = quality.judge_quality(table([(1, prose(1, 90))]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_order_is_by_rejection_per_cost(spark):
    """A clock that charges each rule a known price; what an earlier rule rejects no longer counts."""
    docs = spark.createDataFrame([(i, 60) for i in range(100)], "doc_id long, n_words long")
    dear, cheap, again = (quality.Rule("dear", F.col("doc_id") < 60), quality.Rule("cheap", F.col("doc_id") < 20), quality.Rule("again", F.col("doc_id") < 55))
    prices = iter([0.0, 10.0, 2.0, 5.0])  # nothing, dear, cheap, again
    ticks = iter([t for p in prices for t in (0.0, 1.0 + p)])
    ordered = quality.by_rejection_per_cost(docs, [dear, cheap, again], clock=lambda: next(ticks), rounds=1)
    # Rejections a second: 60/10, 20/2, 55/5 -> again; then 5/10 and 0/2.
    assert [r.name for r in ordered] == ["again", "dear", "cheap"]
    rows = docs.select("doc_id", quality.cascade(ordered).alias("why")).collect()
    assert {r.doc_id: r.why for r in rows} == {i: "again" if i < 55 else "dear" if i < 60 else None for i in range(100)}


def test_later_rules_are_not_evaluated(spark):
    boom = quality.Rule("boom", F.raise_error(F.lit("evaluated")).cast("boolean"))
    docs = spark.createDataFrame([(1, 60)], "doc_id long, n_words long")
    assert docs.select(quality.cascade([quality.Rule("first", F.col("n_words") > 0), boom]).alias("why")).collect()[0].why == "first"


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_quality_rules"])
def test_query_equals_its_statement(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cursor = con.execute(queries.ORACLE[name])
    names = [d[0] for d in cursor.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, got.select(names).collect()))) == sorted(map(repr, cursor.fetchall()))
