import numpy as np
import pytest
from pyspark.sql import functions as F

from foldgraph.errors import GraphError
from foldgraph.functions import vectors as V
from foldgraph.operators import checks, encoder as E, graphs as G
from foldgraph.plans import catalog, oracle as O
from foldgraph.spec import EncoderShape, GraphSpec
from foldgraph.streaming.arriving import split_seen
from tests.conftest import STEM

SHAPE = EncoderShape(hidden=6, layers=2, out_dim=5)
MOLECULES = [("stem", *STEM, "9,2", "16,8"), ("b", "ACGUACGU", "((....))"), ("c", "A", "."), ("d", "GGAACCUU", "........")]


@pytest.fixture(scope="module")
def weights(spark):
    return E.formula_weights(spark, SHAPE).cache()


@pytest.fixture(scope="module")
def graphs(records):
    return G.build_graphs(records(MOLECULES), keep_paired_neighbours=True, context_hops=2).cache()


def matrices(df):
    return {r.graph_id: np.array(r.embedding) for r in df.collect()}


def test_parameter_count(spark, weights):
    assert EncoderShape().parameter_count == 306436
    assert checks.check_weights(weights, SHAPE).isEmpty()
    assert checks.parameter_total(weights).first().parameters == SHAPE.parameter_count


def test_both_formulations_agree(graphs, weights):
    direct = matrices(E.encode(graphs, weights, SHAPE, embedding_dtype="float64"))
    joined = E.encode_relational(graphs, weights, SHAPE)
    other = matrices(E.collect_matrix(joined))
    assert direct.keys() == other.keys()
    for name, x in direct.items():
        np.testing.assert_allclose(x, other[name], atol=2e-6)


def test_relational_encoder_of_one_layer_moves_no_rows(graphs):
    shape = EncoderShape(hidden=4, layers=1, out_dim=3)
    weights = E.formula_weights(graphs.sparkSession, shape).cache()
    vectors = E.encode_relational(graphs, weights, shape)
    plan = vectors._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    direct, other = matrices(E.encode(graphs, weights, shape, embedding_dtype="float64")), matrices(E.collect_matrix(vectors))
    assert direct.keys() == other.keys()
    for name, x in direct.items():
        np.testing.assert_allclose(x, other[name], atol=2e-6)


def test_neighbour_sums_against_a_loop_and_without_a_shuffle(graphs, weights):
    held = E.load_weights(weights, SHAPE)
    by_kind = held["convs.0.edge_lin.weight"].T + held["convs.0.edge_lin.bias"]
    stated = E.with_states(graphs, held)
    summed = E.neighbour_sum(stated, by_kind, max_batch_nodes=9)
    assert "Exchange" not in summed._jdf.queryExecution().executedPlan().toString()
    got = {(r.graph_id, r.node_idx): (r.h, r.agg) for r in summed.collect()}
    assert len(got) == sum(r.node_count for r in graphs.collect())
    for r in stated.collect():
        want = np.zeros((r.node_count, SHAPE.hidden))
        for src, dst, kind in zip(r.edge_src, r.edge_dst, r.edge_types):
            want[dst] += np.maximum(np.array(r.h[src]) + by_kind[kind], 0)
        for i in range(r.node_count):
            assert got[r.graph_id, i][0] == r.h[i]
            np.testing.assert_allclose(got[r.graph_id, i][1], want[i], atol=1e-9)


def test_core_rows_unit_length_and_order(graphs, weights):
    out = E.encode(graphs, weights, SHAPE).collect()
    sizes = {r.graph_id: len(r.embedding) for r in out}
    assert sizes == {"stem:9-16": 7, "stem:2-8": 6, "b": 8, "c": 1, "d": 8}
    for r in out:
        x = np.array(r.embedding)
        np.testing.assert_allclose(np.linalg.norm(x, axis=1), 1, atol=2e-3)
        assert r.residue_index == sorted(r.residue_index)
        np.testing.assert_array_equal(x, x.astype(np.float16))


def test_batching_and_partitioning_do_not_matter(graphs, weights):
    whole = matrices(E.encode(graphs.coalesce(1), weights, SHAPE, embedding_dtype="float64"))
    for other in (
        E.encode(graphs.coalesce(1), weights, SHAPE, max_batch_nodes=16, max_batch_edges=70, embedding_dtype="float64"),
        E.encode(graphs.repartition(5), weights, SHAPE, embedding_dtype="float64"),
    ):
        for name, x in matrices(other).items():
            np.testing.assert_allclose(x, whole[name], rtol=1e-5, atol=3e-7)


def test_context_changes_the_core(records, weights):
    r = records([("stem", *STEM, "9", "16")])
    without = matrices(E.encode(G.build_graphs(r), weights, SHAPE, embedding_dtype="float32"))["stem:9-16"]
    within = matrices(E.encode(G.build_graphs(r, keep_paired_neighbours=True, context_hops=3), weights, SHAPE, embedding_dtype="float32"))
    assert without.shape == within["stem:9-16"].shape and not np.allclose(without, within["stem:9-16"], atol=1e-6)


def test_refusals(records, graphs, weights):
    for limits in ({"max_batch_nodes": 0}, {"max_batch_edges": -1}):
        with pytest.raises(GraphError):
            E.encode(graphs, weights, SHAPE, **limits)
    with pytest.raises(ValueError):
        E.encode(graphs, weights, SHAPE, embedding_dtype="int8")
    with pytest.raises(GraphError):
        E.encode(graphs, weights.where("tensor <> 'head.2.bias'"), SHAPE)
    with pytest.raises(Exception, match="max_batch_nodes"):
        E.encode(graphs, weights, SHAPE, max_batch_nodes=7).collect()
    foreign = G.build_graphs(records(MOLECULES[1:]), GraphSpec(edge_dim=8))
    with pytest.raises(Exception, match="contract"):
        E.encode(foreign, weights, SHAPE).collect()
    with pytest.raises(GraphError):
        E.check_sizes(graphs, SHAPE, 60_000, 20)


def test_half_precision_column(spark):
    df = spark.createDataFrame([([0.1, 1e-7, 70000.0],), (None,), ([],)], "v array<double>")
    got = [r.v for r in df.select(V.cast_embedding(F.col("v")).alias("v")).collect()]
    assert got[0] == [float(np.float16(x)) for x in (0.1, 1e-7, 70000.0)] and got[1] is None and got[2] == []
    with pytest.raises(ValueError):
        V.cast_embedding(F.col("v"), "int8")


def test_half_precision_equals_the_hardware_format(spark):
    rng = np.random.default_rng(6)
    every = np.arange(0, 0x7C00, 7, dtype=np.uint16).view(np.float16).astype(np.float64)
    ties = (every[:-1] + every[1:]) / 2
    edges = [65504.0, 65519.999, 65520.0, 1e300, 2.0**-14, 2.0**-24, 2.0**-25, 2.0**-25 * 1.0001, 1e-300, 5e-324, np.inf, 0.0]
    powers = np.ldexp(1.0, np.arange(-26, 17))
    values = np.concatenate([every, ties, edges, powers, np.nextafter(powers, 0), np.nextafter(powers, np.inf), rng.normal(size=2000), np.exp(rng.uniform(-20, 12, 2000))])
    values = np.concatenate([values, -values, [np.nan]])
    df = spark.createDataFrame([(values.tolist(),)], "v array<double>").select(V.cast_embedding(F.col("v")).alias("v"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    with np.errstate(over="ignore"):
        want = values.astype(np.float16).astype(np.float64)
    got = np.array(df.first().v)
    np.testing.assert_array_equal(got, want)
    np.testing.assert_array_equal(np.signbit(got[:-1]), np.signbit(want[:-1]))


def test_zero_vector_keeps_its_floor(spark):
    row = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<float>").select(V.l2_normalize(F.col("v")).alias("v")).collect()
    assert [r.v for r in row] == [[0.0, 0.0], [0.6, 0.8]]


def test_dense_steps_are_not_one_generated_method(graphs, weights):
    held = E.load_weights(weights, SHAPE)
    stated = E.with_states(graphs, held)
    for df in (stated.select("h"), E.conv_layer(stated, held, 0), E.encode_relational(graphs, E.formula_weights(graphs.sparkSession, EncoderShape(hidden=4, layers=1, out_dim=3)), EncoderShape(hidden=4, layers=1, out_dim=3))):
        assert " * " not in df._jdf.queryExecution().optimizedPlan().toString()


def test_vectors_by_batches_equal_column_arithmetic(spark):
    rng = np.random.default_rng(3)
    weight, bias = rng.normal(size=(3, 2)).astype(np.float32), rng.normal(size=3).astype(np.float32)
    rows = [(rng.normal(size=(n, 2)).tolist(),) for n in (3, 1)] + [([],), (None,), ([[1.0, None], None, [2.0], [0.5, 0.25, 9.0]],)]
    df = spark.createDataFrame(rows, "m array<array<double>>").coalesce(1)
    each = F.transform("m", lambda v: V.linear(v, weight, bias))
    got = [(r.a, r.b) for r in df.select(V.linear_each(F.col("m"), weight, bias).alias("a"), each.alias("b")).collect()]
    assert len(got) == 5 and all(a == b for a, b in got)
    flat = df.limit(2).select(F.explode("m").alias("v"))
    both = flat.select(V.dense(lambda x: V.rectified(V.affine(x, weight, bias)), "v").alias("a"), V.relu(V.linear(F.col("v"), weight, bias)).alias("b")).collect()
    assert len(both) == 4 and all(r.a == r.b for r in both)


def test_layers_against_a_loop():
    """Nodes that no edge reaches and that get two edges of a kind, large weights, no edges; an edge that leaves is refused."""
    rng = np.random.default_rng(5)
    w = {name: (rng.integers(-64, 64, size) / 8).astype(np.float32) for name, size in SHAPE.tensors().items()}
    for k in range(SHAPE.layers):
        w[f"convs.{k}.mlp.1.running_var"] = np.abs(w[f"convs.{k}.mlp.1.running_var"]) + 1
    features = rng.integers(0, 2, (9, SHAPE.spec.feature_width)).astype(np.float32)
    src, dst, kind = np.array([0, 1, 2, 3, 5, 6, 7, 7]), np.array([1, 0, 3, 2, 6, 6, 8, 0]), np.array([0, 1, 2, 3, 4, 4, 0, 5])

    wide = {name: x.astype(np.float64) for name, x in w.items()}
    affine = lambda name, x: x @ wide[f"{name}.weight"].T + wide[f"{name}.bias"]
    h = affine("input", features)
    for k in range(SHAPE.layers):
        conv = f"convs.{k}"
        total = (1 + wide[f"{conv}.eps"][0, 0]) * h
        for a, b, c in zip(src, dst, kind):
            total[b] += np.maximum(h[a] + (wide[f"{conv}.edge_lin.weight"].T + wide[f"{conv}.edge_lin.bias"])[c], 0)
        x, of = affine(f"{conv}.mlp.0", total), lambda p: wide[f"{conv}.mlp.1.{p}"]  # noqa: E731, B023
        x = (x - of("running_mean")) / np.sqrt(of("running_var") + V.BATCH_NORM_EPS) * of("weight") + of("bias")
        x = affine(f"{conv}.mlp.4", np.maximum(x, 0))
        x = x - x.mean(axis=1, keepdims=True)
        x = x / np.sqrt((x * x).mean(axis=1, keepdims=True) + V.LAYER_NORM_EPS)
        h = h + x * wide[f"norms.{k}.weight"] + wide[f"norms.{k}.bias"]
    want = affine("head.2", np.maximum(affine("head.0", h), 0))

    prepared = E._prepared(w, SHAPE)
    np.testing.assert_allclose(E._run_layers(prepared, SHAPE, features, src, dst, kind), want, rtol=1e-4, atol=1e-3 * np.abs(want).max())
    none = np.zeros(0, np.int64)
    assert np.isfinite(E._run_layers(prepared, SHAPE, features, none, none, none)).all()
    for bad in (-1, 9):
        with pytest.raises(IndexError):
            E._run_layers(prepared, SHAPE, features, np.array([bad]), np.array([0]), np.array([0]))


def test_vectors_are_compared_by_graph_and_never_broadcast(spark, records):
    """Near vectors are added up at 64 bits, far ones and those without a partner as they are."""
    g, weights = G.build_graphs(records(MOLECULES), O.SMALL.spec).cache(), E.formula_weights(spark, O.SMALL).cache()
    vectors = E.encode(g, weights, O.SMALL, embedding_dtype="float64").cache()
    exact = E.encode_relational(g, weights, O.SMALL)
    assert "Broadcast" not in catalog.settled_sums(vectors, g, weights)._jdf.queryExecution().executedPlan().toString()

    def rows(df):
        return sorted(tuple(r) for r in df.collect())

    want = rows(catalog.vector_sums(exact))
    assert rows(catalog.settled_sums(vectors, g, weights)) == want
    moved = lambda by: vectors.withColumn("embedding", F.transform("embedding", lambda v: F.transform(v, lambda x: x + by)))
    assert rows(catalog.settled_sums(moved(4e-4), g, weights)) == want
    far = moved(0.25)
    assert rows(catalog.settled_sums(far, g, weights)) == rows(catalog.vector_sums(E.unpack_embeddings(far))) != want
    assert rows(catalog.settled_sums(vectors, g.where("false"), weights)) == rows(catalog.vector_sums(E.unpack_embeddings(vectors)))
    # Residues in another order, and one that the other side has not.
    turned = vectors.withColumns({c: F.reverse(c) for c in ("residue_index", "embedding")})
    assert rows(catalog.settled_sums(turned, g, weights)) == want
    strange = vectors.withColumn("residue_index", F.transform("residue_index", lambda r: r + 100))
    assert rows(catalog.settled_sums(strange, g, weights)) == rows(catalog.vector_sums(E.unpack_embeddings(strange)))
    # Of ids that repeat, each vector meets each of its residue.
    twice = vectors.unionByName(vectors.where("graph_id = 'b'"))
    doubled = [(*r[:1], *(4 * x for x in r[1:])) if r[0] == "b" else r for r in want]
    for given in (twice, E.collect_matrix(E.unpack_embeddings(twice))):
        found = rows(catalog.settled_sums(given, g.unionByName(g.where("graph_id = 'b'")), weights))
        assert [r[:2] for r in found] == [r[:2] for r in doubled]


def test_arrivals_without_a_repeated_id_are_not_joined(records):
    g = G.build_graphs(records(MOLECULES)).withColumns({"dataset": F.lit("a"), "shard_id": F.lit(0).cast("long")})
    new, rejects = split_seen(g, None)
    assert "Join" not in new._jdf.queryExecution().executedPlan().toString()
    assert new.columns == g.columns and new.count() == g.count() and rejects.isEmpty()
    new, rejects = split_seen(g, g.where("graph_id = 'b'"))
    assert new.columns == g.columns and new.count() == g.count() - 1
    assert [tuple(r) for r in rejects.collect()] == [("b", "a", "duplicate_identifier")]
