import random

import pytest
from pyspark.sql import functions as F

from foldgraph.errors import GraphError
from foldgraph.operators import graphs as G, packing as P
from tests.conftest import STEM


def fold(rows, limit_a, limit_b):
    out, part, a, b, last = {}, -1, 0, 0, None
    for order, x, y, key in rows:
        if last is None or key != last or a + x > limit_a or b + y > limit_b:
            part, a, b = part + 1, 0, 0
        a, b, last = a + x, b + y, key
        out[order] = part
    return out


def test_packing_equals_the_fold(spark):
    rnd = random.Random(11)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        for n, keys, top, limit_a, limit_b, parts in [
            (1, 1, 1, 1, None, 1), (700, 1, 1, 3, None, 5), (700, 1, 1, 128, 9000, 4), (900, 300, 20, 60, 900, 6),
            (900, 20, 20, 10**9, 500, 3), (800, 1, 1, 10**9, None, 7), (500, 170, 1, 1, 400, 2),
        ]:
            key = sorted(rnd.randrange(keys) for _ in range(n))
            rows = [(7 * i + 3, rnd.randint(1, top), rnd.randint(0, 400), key[i]) for i in range(n)]
            df = spark.createDataFrame(rnd.sample(rows, n), "o long, a long, b long, k long")
            got = P.greedy_parts(df, "part", "o", F.col("a"), limit_a, F.col("b"), limit_b, F.col("k"), parts)
            assert {r.o: r.part for r in got.collect()} == fold(rows, limit_a, limit_b or 10**18)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_shards(records):
    r = records([(f"r{i}", "ACGU", "....") for i in range(5)])
    got = P.assign_shards(r, max_records=3, max_nodes=8).orderBy("record_ord").collect()
    assert [x.shard_id for x in got] == [0, 0, 1, 1, 2]
    with pytest.raises(GraphError, match="max_nodes"):
        P.assign_shards(r, max_records=3, max_nodes=3)
    with pytest.raises(GraphError):
        P.assign_shards(r, max_records=0)
    # A window counts with its whole molecule.
    w = records([("a", *STEM, "0,8", "4,12")])
    assert [x.shard_id for x in P.assign_shards(w, max_records=9, max_nodes=20).orderBy("record_ord").collect()] == [0, 1]


def test_microbatches_restart_with_the_shard(records):
    r = P.assign_shards(records([(f"r{i}", "ACGU", "....") for i in range(7)]), max_records=3)
    got = P.assign_microbatches(G.build_graphs(r), max_batch_nodes=8, max_batch_edges=100).orderBy("record_ord").collect()
    assert [x.batch_id for x in got] == [0, 0, 1, 2, 2, 3, 4]
    by_edges = P.assign_microbatches(G.build_graphs(r), max_batch_nodes=800, max_batch_edges=10).orderBy("record_ord").collect()
    assert [x.batch_id for x in by_edges] == list(range(7))
    with pytest.raises(GraphError, match="max_batch_edges"):
        P.assign_microbatches(G.build_graphs(r), max_batch_edges=9)


def test_offsets_slices_and_unions(records):
    g = G.build_graphs(P.assign_shards(records([(f"r{i}", "ACGU"[: i + 1], "...."[: i + 1]) for i in range(4)]), max_records=9))
    offsets = P.csr_offsets(g).orderBy("shard_ord").collect()
    assert [(x.node_ptr, x.edge_ptr) for x in offsets] == [(0, 0), (1, 0), (3, 2), (6, 8)]
    part = P.csr_offsets(P.slice_shard(g, 0, 2, 4)).orderBy("shard_ord").collect()
    assert [(x.graph_id, x.node_ptr, x.edge_ptr) for x in part] == [("r2", 0, 0), ("r3", 3, 6)]
    for start, stop in ((2, 2), (-1, 2), (3, 5)):
        with pytest.raises(IndexError):
            P.slice_shard(g, 0, start, stop)
    both = P.concat_graphs(g, g.withColumn("graph_id", F.concat(F.lit("x"), "graph_id")))
    assert P.csr_offsets(both).agg(F.max("node_ptr")).first()[0] == 16
    edges = P.shard_edges(both).orderBy("edge_ord").collect()
    assert len(edges) == 36 and max(e.dst for e in edges) == 19
    assert dict(both.dtypes)["record_ord"] == "bigint" and both.select("record_ord").distinct().count() == 8
    with pytest.raises(GraphError):
        P.concat_graphs(g.limit(0))
    with pytest.raises(GraphError, match="share an identifier"):
        P.concat_graphs(g, g.where("graph_id = 'r2'"))


def test_edges_of_placed_graphs_stay_where_they_are(records):
    from pyspark.sql import functions as F

    r = records([("a", "ACGUACGU", "((....))"), ("b", "GGAACCUU", "........"), ("c", "ACGU", "....")])
    r = r.withColumn("shard_id", F.pmod("record_ord", F.lit(2)))
    g = G.build_graphs(r)
    offsets = P.csr_offsets(g).select("shard_id", "record_ord", "node_ptr", "edge_ptr").collect()
    offsets = r.sparkSession.createDataFrame(offsets, "shard_id long, record_ord long, node_ptr long, edge_ptr long")
    placed = P.shard_edges(G.build_graphs(r.join(F.broadcast(offsets), ["shard_id", "record_ord"])))
    assert "Exchange hash" not in placed._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, placed.collect())) == sorted(map(tuple, P.shard_edges(g).collect()))
