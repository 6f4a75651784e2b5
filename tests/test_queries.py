"""A sample of the registered queries against DuckDB; the whole set is checked by the driver."""

from pathlib import Path

import duckdb
import pytest

from foldgraph.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = ["edge_census", "reject_rows", "expand_context", "reindex_nodes", "assign_shards", "neighbour_sum", "check_graphs", "relative_position"]
NAMES += ["checksum_damage", "conv_layer", "core_span", "encode_relational", "pack_graphs"]


@pytest.mark.skipif(not Path(SF).exists(), reason="the supplied tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    cursor = con.execute(catalog.ORACLE[name])
    names = sorted(d[0] for d in cursor.description)
    assert sorted(got.columns) == names
    at = [[d[0] for d in cursor.description].index(n) for n in names]
    assert sorted(tuple(map(repr, r)) for r in got.select(names).collect()) == sorted(tuple(repr(r[i]) for i in at) for r in cursor.fetchall())


def test_every_query_has_a_statement_but_the_hash():
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == {"dataset_checksum"}


def test_slice_of_a_document_with_fewer_molecules_than_asked_for(spark, tmp_path):
    for pieces in (0, 1, 2, 4):
        rows = [(1, "ACGU" * 300, "en", "x", 1200)] + [(0, "A" * (400 * pieces), "en", "x", 400 * pieces)]
        sf = str(tmp_path / str(pieces))
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
        got = catalog.QUERIES["slice_shard"](spark, sf).collect()
        assert sorted(r.node_ptr for r in got) == [400 * i for i in range(min(2, max(0, pieces - 1)))]


def test_shape_of_matrices_is_judged_in_generated_code(spark):
    unit, long = [1.0] + [0.0] * 31, [0.5] * 32
    rows = [("a", [unit, unit]), ("b", [unit, long]), ("c", []), ("d", [[float("nan")] * 32])]
    got = catalog.matrix_shape(spark.createDataFrame(rows, "graph_id string, embedding array<array<float>>"))
    assert {r.graph_id: (r.core_length, r.embedding_dim, r.unit) for r in got.collect()} == {
        "a": (2, 32, True), "b": (2, 32, False), "c": (0, None, True), "d": (1, 32, False)
    }
    assert "lambda" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not Path(SF).exists(), reason="the supplied tables are not here")
@pytest.mark.parametrize("name", ["encode", "write_manifest"])
def test_encoder_query(spark, name):
    test_query(spark, name)
