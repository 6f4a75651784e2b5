import duckdb
import pytest

from pyspark.sql import functions as F

from foldgraph.llm import queries, url_filters as uf

URLS = [None, "", "no scheme", "http://", "http://Example.ORG/en/1?x#y", "https://a.b.example.org/es/", "http://org", "http://org/", "http://xorg/a",
        "http://example.com?/fr/", "http://example.com/fr/x?y", "x://://com/de/", "http://EXAMPLE.com/FR/", "http://é.com/de/ü#z", "http://a.com/de/\n/x?",
        "http://user@example.org:80/en/1", "http://.org//", "ftp://example.org/en/" + "1" * 5000, "http://com/fr/#://org/"]


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0] if rest[cut:].startswith("/") else ""
    fits = [(len(h) + len(p), len(h), v == "block", h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else None
    return host, path, best and best[3], "block" if best and best[2] else "allow"


def test_equals_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)] + [(0, None, "h", "r"), (None, URLS[4], "h", "r")],
                                  "page_id long, url string, host string, rule string")
    got = sorted(map(repr, (tuple(r) for r in uf.judge_urls(pages, uf.rule_table(spark, queries.RULES)).collect())))
    assert got == sorted(repr((i, *brute(u, queries.RULES))) for i, u in [*enumerate(URLS), (0, None), (None, URLS[4])])


def test_many_rules_and_ties(spark):
    rules = [("block" if i % 2 else "allow", f"h{i % 40}.net", "/" + "ab" * (i % 5)) for i in range(400)] + [(None, "net", "/"), ("allow", None, "/"), ("block", "", "/")]
    urls = [f"http://s.h{i}.net/{'ab' * (i % 7)}" for i in range(60)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = sorted(tuple(r) for r in uf.judge_urls(pages, uf.rule_table(spark, rules)).collect())
    assert got == [(i, *brute(u, [r for r in rules if None not in r and r[1]])) for i, u in enumerate(urls)]


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert uf.judge_urls(pages, uf.rule_table(spark, queries.RULES)).count() == 0
    one = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    assert tuple(uf.judge_urls(one, uf.rule_table(spark, []), "block").first()) == (1, "a.org", "/x", None, "block")


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_statement(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '/root/testdata/{sf}/pages.parquet'")
    want = sorted(map(repr, con.execute(queries.OP9_SQL).fetchall()))
    assert sorted(repr(tuple(r)) for r in queries.op9_url_filters(spark, f"/root/testdata/{sf}").collect()) == want


def test_very_long_hosts_and_paths(spark):
    """A host of many labels makes as many expressions as the rules have label counts, not one a label."""
    rules = [("block", "a.b", "/x"), ("allow", "b", "/")]
    urls = ["http://" + "a." * 60_000 + "b/x" + "/y" * 50_000, "http://" + "." * 20_000 + "b/", "http://a.b", "http://b/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = sorted((r.page_id, r.rule, r.verdict) for r in uf.judge_urls(pages, uf.rule_table(spark, rules)).collect())
    assert got == [(0, "a.b/x", "block"), (1, "b/", "allow"), (2, None, "allow"), (3, "b/", "allow")]
    host = spark.range(1).select(uf.host_suffixes(F.lit("w.x.y.z"), [1, 3, 9]).alias("s")).first().s
    assert host == ["z", "x.y.z"]
