import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldgraph.errors import GraphError
from foldgraph.functions import pairing
from foldgraph.functions.pairing import scan_brackets
from foldgraph.operators import graphs as G
from foldgraph.spec import GraphSpec
from tests.conftest import STEM


def random_structure(rnd, n):
    out, depth = [], 0
    for left in range(n, 0, -1):
        if depth and depth >= left:
            pick = ")"
        else:
            pick = rnd.choice("(.." + (")" if depth else "")) if left > depth + 1 else rnd.choice("." + (")" if depth else ""))
        depth += {"(": 1, ")": -1, ".": 0}[pick]
        out.append(pick)
    return "".join(out)


def stack_pairs(structure):
    partner, stack = [-1] * len(structure), []
    for i, c in enumerate(structure):
        if c == "(":
            stack.append(i)
        elif c == ")":
            j = stack.pop()
            partner[i], partner[j] = j, i
    return partner


def plain_edges(structure, skip2=True):
    n, partner = len(structure), stack_pairs(structure)
    edges = [(i, i + 1, 0) for i in range(n - 1)] + [(i + 1, i, 1) for i in range(n - 1)]
    pairs = [(i, p) for i, p in enumerate(partner) if p > i]
    edges += [(i, p, 2) for i, p in pairs] + [(p, i, 3) for i, p in pairs]
    for i in range(n - 2 if skip2 else 0):
        edges += [(i, i + 2, 4), (i + 2, i, 5)]
    return edges


def plain_selection(structure, start, end, hops, skip2=True):
    partner, core = stack_pairs(structure), set(range(start, end))
    near = {}
    for a, b, _ in plain_edges(structure, skip2):
        near.setdefault(a, set()).add(b)
    edge = {partner[i] for i in core if partner[i] >= 0} - core
    found = core | edge
    for _ in range(hops - 1):
        edge = {b for a in edge for b in near.get(a, ())} - found
        found |= edge
    return sorted(found)


@pytest.fixture(scope="module")
def fuzz():
    rnd = random.Random(3)
    rows = []
    for i in range(120):
        n = rnd.choice([1, 2, 3, 8, 40, 150])
        s = random_structure(rnd, n)
        start = rnd.randrange(n)
        end = rnd.randint(start + 1, n)
        rows.append((f"m{i}", "".join(rnd.choice("ACGU") for _ in range(n)), s, start, end))
    return rows


def edges_of(row):
    return list(zip(row.edge_src, row.edge_dst, row.edge_types))


def test_small_graph(records):
    g = G.build_graphs(records([("rna-1", "ACGUACGU", "((....))")])).first()
    assert (g.node_count, g.edge_count, g.core_count) == (8, 30, 8)
    assert edges_of(g) == plain_edges("((....))")
    x = np.array(g.node_features, dtype=np.float32)
    assert x.shape == (8, 7)
    assert x[:, :4].argmax(1).tolist() == [0, 1, 2, 3] * 2 and x[:, 4].tolist() == [1, 1, 0, 0, 0, 0, 1, 1]
    angle = np.float32(np.pi) * (np.arange(8, dtype=np.float32) / 7)
    np.testing.assert_allclose(x[:, 5:], np.stack([np.sin(angle), np.cos(angle)], 1), atol=2e-7)


def test_single_and_double_nucleotides(records):
    one, two = G.build_graphs(records([("a", "A", "."), ("b", "AC", "..")])).orderBy("graph_id").collect()
    assert (one.node_count, one.edge_count, two.edge_count) == (1, 0, 2)
    assert one.node_features[0][5:] == [0.0, 1.0]


@pytest.mark.parametrize("hops,context", [(1, [2, 3, 5]), (2, list(range(8))), (3, list(range(9)))])
def test_worked_example(records, hops, context):
    r = records([("stem", *STEM, "9", "16")])
    g = G.build_graphs(r, keep_paired_neighbours=True, context_hops=hops).first()
    assert g.residue_index == context + list(range(9, 16))
    assert list(g.node_roles) == [1] * len(context) + [0] * 7
    full = G.build_graphs(records([("stem", *STEM)])).first()
    assert g.node_features == [full.node_features[i] for i in g.residue_index]
    plain = G.build_graphs(r).first()
    assert plain.residue_index == list(range(9, 16)) and set(plain.node_roles) == {0}


def test_context_needs_a_depth_and_the_switch(records):
    r = records([("stem", *STEM, "9", "16")])
    with pytest.raises(ValueError):
        G.build_graphs(r, context_hops=0)
    assert G.build_graphs(r, context_hops=3).first().node_count == 7


@pytest.mark.parametrize("skip2", [True, False])
def test_random_windows_against_a_plain_search(records, fuzz, skip2):
    spec = GraphSpec(skip2=skip2)
    r = records([(i, q, s, str(a), str(b)) for i, q, s, a, b in fuzz])
    for hops in (1, 2, 4):
        got = {g.molecule_id: g for g in G.build_graphs(r, spec, keep_paired_neighbours=True, context_hops=hops).collect()}
        for name, _, s, a, b in fuzz:
            chosen = plain_selection(s, a, b, hops, skip2)
            at = {p: k for k, p in enumerate(chosen)}
            kept = [(at[x], at[y], t) for x, y, t in plain_edges(s, skip2) if x in at and y in at]
            assert got[name].residue_index == chosen and edges_of(got[name]) == kept


def test_random_molecules_and_pair_windows(records, fuzz):
    r = records([(i, q, s) for i, q, s, _, _ in fuzz])
    for g in G.build_graphs(r).collect():
        assert edges_of(g) == plain_edges(g.structure)
    long = G.partner_by_level(G.bracket_depth(G.explode_nucleotides(r)))
    table = {x.graph_id: x.p for x in long.groupBy("graph_id").agg(F.expr("transform(array_sort(collect_list(struct(pos, partner))), x -> x.partner)").alias("p")).collect()}
    assert table == {i: stack_pairs(s) for i, _, s, _, _ in fuzz}


def test_unbalanced_positions(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("(.)") for _ in range(rnd.randint(0, 12))) for _ in range(400)] + ["", "(" * 4096, "é("]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("s", scan_brackets("t"))
    for row in rows.where("i < 400").collect():
        stack, close = [], -1
        for i, c in enumerate(row.t):
            if c == "(":
                stack.append(i)
            elif c == ")":
                if not stack:
                    close = i
                    break
                stack.pop()
        assert row.s.unmatched_close == close
        assert row.s.unmatched_open == (stack[0] if stack and close < 0 else -1)


def test_pack_reverses_unpack(records, fuzz):
    r = records([(i, q, s, str(a), str(b)) for i, q, s, a, b in fuzz])
    g = G.build_graphs(r, keep_paired_neighbours=True, context_hops=2)
    packed = G.pack_graphs(G.unpack_nodes(g), G.unpack_edges(g))
    assert packed.exceptAll(g.select(packed.columns)).isEmpty() and packed.count() == g.count()


def test_contract():
    assert GraphSpec().feature_width == 7 and GraphSpec(structure_feature="B", positional=False).feature_width == 7
    # Fixed value: the fingerprint of the default contract.
    assert GraphSpec().fingerprint == "da2e670e377e47667fec8a8ebb1c90c6e506b9cdd8a5555a6bfab50b202fb9bd"
    assert GraphSpec.from_document(GraphSpec(skip2=False).document()) == GraphSpec(skip2=False)
    for bad in ({"structure_feature": "C"}, {"edge_dim": 5}, {"format_version": 2}):
        with pytest.raises(GraphError):
            GraphSpec(**bad)
    for change in ({"node_feature_dimension": 9}, {"edge_types": {}}, {"extra_edges": ["skip3"]}):
        with pytest.raises(GraphError):
            GraphSpec.from_document({**GraphSpec().document(), **change})


def test_structure_feature_b(records):
    g = G.build_graphs(records([("a", "ACGU", "(.).")]), GraphSpec(structure_feature="B", positional=False)).first()
    assert [f[4:] for f in g.node_features] == [[1, 0, 0], [0, 1, 0], [0, 0, 1], [0, 1, 0]]


def test_graph_building_does_not_shuffle(records):
    plan = G.build_graphs(records([("a", "ACGU", "(.).")]), keep_paired_neighbours=True, context_hops=3)
    text = plan._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    above = text.split("ArrowEvalPython")[0]
    assert "Exchange" not in above


def test_roles_are_not_made_anew_for_each_residue(spark, records):
    g = G.build_graphs(records([("a", *STEM, "4", "12")]), keep_paired_neighbours=True, context_hops=2)
    plan = G.core_span(g)._jdf.queryExecution().optimizedPlan().toString()
    kept = next(line for line in plan.split("\n") if "filter(residue_index" in line)
    assert "transform(" not in re.search(r"filter\(residue_index#\d+, lambdafunction\((.*)", kept)[1].split(", lambda")[0]
    assert [tuple(r) for r in G.core_span(g).select("core_start", "core_end").collect()] == [(4, 12)]


@pytest.mark.parametrize("residues_at_once", [1, 400_000])
def test_edges_of_a_batch_against_a_loop(spark, monkeypatch, residues_at_once):
    from foldgraph.functions import edges as E

    monkeypatch.setattr(E, "RESIDUES_AT_ONCE", residues_at_once)
    rng = np.random.default_rng(5)
    rows = []
    for n in (0, 1, 2, 3, 30, 7):
        partner, free = [-1] * n, list(range(n))
        while len(free) > 4:
            a, b = (free.pop(int(rng.integers(len(free)))) for _ in range(2))
            partner[a], partner[b] = b, a
        rows.append((sorted(int(x) for x in np.flatnonzero(rng.random(n) < 0.7)), partner))
    batch = (pa.array([r for r, _ in rows], pa.list_(pa.int32())), pa.array([p for _, p in rows], pa.list_(pa.int32())))
    made = [x for part in E._by_some_rows(lambda r, p: E._edges(r, p, True), 0)(iter([batch])) for x in part.to_pylist()]
    for (r, partner), got in zip(rows, made, strict=True):
        at = {p: k for k, p in enumerate(r)}
        chain = [(at[p], at[p + 1]) for p in r if p + 1 in at]
        pairs = [(at[p], at[partner[p]]) for p in r if partner[p] > p and partner[p] in at]
        hops = [(at[p], at[p + 2]) for p in r if p + 2 in at]
        want = [(a, b, 0) for a, b in chain] + [(b, a, 1) for a, b in chain] + [(a, b, 2) for a, b in pairs] + [(b, a, 3) for a, b in pairs]
        want += [e for a, b in hops for e in ((a, b, 4), (b, a, 5))]
        assert list(zip(got["src"], got["dst"], got["types"])) == want


def test_pack_sends_an_edge_as_one_number_and_keeps_odd_ones(spark):
    nodes = spark.createDataFrame([("a", 0, 0, 0, [1.0])], "graph_id string, node_idx int, residue_index int, node_role byte, features array<float>")
    rows = [("a", 2, 5, 6, 1), ("a", 0, 4095, 7, 5), ("a", 1, None, 2, 3), ("a", 3, -1, 2**30, 100), ("a", 2, 5, 6, 1)]
    edges = spark.createDataFrame(rows, "graph_id string, edge_ord int, src int, dst int, edge_type byte")
    packed = G.pack_graphs(nodes, edges)
    (got,) = packed.collect()
    assert list(zip(got.edge_src, got.edge_dst, got.edge_types)) == [(4095, 7, 5), (None, 2, 3), (5, 6, 1), (5, 6, 1), (-1, 2**30, 100)]
    assert "near" in packed._jdf.queryExecution().optimizedPlan().toString()


def test_windows_along_molecules_shuffle_records_and_not_positions(spark, records):
    r = records([("a", *STEM), ("b", "ACGU", "(())")])
    depth = G.bracket_depth(G.explode_nucleotides(G.by_molecule(r)))
    plan = depth._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
    assert sorted(tuple(x) for x in depth.collect()) == sorted(tuple(x) for x in G.bracket_depth(G.explode_nucleotides(r)).collect())


def test_nodes_without_features_do_not_make_them(records):
    g = G.build_graphs(records([("a", *STEM)]))
    short = G.unpack_nodes(g, features=False)
    assert "node_features" not in short._jdf.queryExecution().optimizedPlan().toString()
    assert short.collect() == G.unpack_nodes(g).drop("features").collect()


def test_edge_digests_and_entries_against_expressions(spark):
    from pyspark.sql import functions as F

    from foldgraph.functions.edges import edge_digests, entries_at

    rows = [([0, 1], [1, 0], [0, 1], [5, 9]), ([], [], [], []), ([0, 7, -1], [2, 1, 1], [3, 3, 4], [8]), (None, [1], [0], [4]), ([0, None], [1, 1], [2, 2], None)]
    df = spark.createDataFrame(rows, "s array<int>, d array<int>, t array<tinyint>, r array<int>").coalesce(1)
    line = lambda x: F.concat(x["s"].cast("string"), F.lit(">"), x["d"].cast("string"), F.lit(":"), x["t"].cast("string"))
    got = df.select(edge_digests("s", "d", "t").alias("e"), entries_at("s", "r").alias("at")).collect()
    want = df.select(F.md5(F.array_join(F.transform(F.arrays_zip("s", "d", "t"), line), ",")).alias("e")).collect()
    assert [r.e for r in got] == [r.e for r in want]
    assert [r.at for r in got] == [[5, 9], [], [8, None, None], None, [None, None]]


def test_rules_in_generated_code_agree_with_lambdas(spark):
    from pyspark.sql import functions as F

    from foldgraph.operators import checks

    lists = [[], [0, 3], [-1], [4], [None], [0, None], [None, -2], [None, 4], None]
    df = spark.createDataFrame([(x, n) for x in lists for n in (4, None)], "x array<int>, n int").coalesce(1)
    new, old = checks._outside(F.col("x"), F.col("n")), F.exists("x", lambda x: (x < 0) | (x >= F.col("n")))
    assert [r for r in df.select("x", "n", new.alias("a"), old.alias("b")).collect() if r.a != r.b] == []
    nan, inf = float("nan"), float("inf")
    vectors = [[[0.0, 1.0]], [[nan]], [[1.0], [-inf]], [[inf, None]], [[None, 1.0]], [None], [[], []], [], None]
    df = spark.createDataFrame([(v, []) for v in vectors], "node_features array<array<float>>, e array<int>").coalesce(1)
    df = df.select("node_features", F.col("e").alias("edge_src"), F.col("e").alias("edge_dst"), F.lit(1).alias("node_count"))
    rule = dict(checks._value_rules())["not_finite"]
    assert "lambda" not in df.select(rule)._jdf.queryExecution().optimizedPlan().toString()
    strange = F.exists("node_features", lambda f: F.exists(f, lambda v: F.isnan(v) | (F.abs(v) == inf)))
    assert [r for r in df.select("node_features", rule.alias("a"), strange.alias("b")).collect() if r.a != r.b] == []


def test_rows_go_to_python_a_megabyte_at_a_time(records):
    """10,000 rows with their arrays are some hundred megabytes; no batch of a step is much above its limit."""
    graphs = G.build_graphs(records([(f"m{i}", "ACGU" * 100, "((((....))))" + "." * 388) for i in range(300)]))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    got = graphs.select("node_features", "edge_src", "edge_dst", "edge_types").mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in got) == 300 and max(r.bytes for r in got) < 2**21


def test_brackets_are_scanned_in_parts(monkeypatch):
    texts = pa.array(["((..))", None, "", "(()", "())(", ".", "(((...)))..()"] * 5)
    whole = [pairing._scanned(texts, pairs).to_pylist() for pairs in (True, False)]
    monkeypatch.setattr(pairing, "CHARACTERS_AT_ONCE", 7)
    most, scanned = [], pairing._scanned
    monkeypatch.setattr(pairing, "_scanned", lambda part, pairs: most.append(len("".join(x or "" for x in part.to_pylist()))) or scanned(part, pairs))
    assert [f(texts).to_pylist() for f in (pairing._scan, pairing._unmatched)] == whole and len(most) > 4 and max(most) <= 20
    assert pairing._scan(texts.slice(0, 0)).to_pylist() == []
