import numpy as np
import pytest
from pyspark.sql import functions as F

from foldgraph.errors import RecordError
from foldgraph.operators import encoder as E
from foldgraph.plans import jobs as J
from foldgraph.spec import EncoderShape
from foldgraph.streaming.arriving import embed_arriving_shards
from tests.conftest import STEM

SHAPE = EncoderShape(hidden=6, layers=2, out_dim=5)
HEAD = "transcript_id\tsequence\tsecondary_structure\tstart\tend\n"


@pytest.fixture(scope="module")
def weights(spark):
    return E.formula_weights(spark, SHAPE).cache()


def table(tmp_path, names, name="t.tsv"):
    lines = [f"{n}\t{STEM[0]}\t{STEM[1]}\t9,6\t16,12\n{n}-full\tACGUACGU\t((....))\t\t\n" for n in names]
    (tmp_path / name).write_text(HEAD + "".join(lines))
    return str(tmp_path / name)


def matrices(df):
    return {r.graph_id: np.array(r.embedding) for r in df.collect()}


def test_staged_equals_direct(spark, weights, tmp_path):
    source, context = table(tmp_path, ["a", "b"]), J.Context(context_hops=2)
    out = {k: str(tmp_path / k) for k in ("graphs", "staged", "direct")}
    summary = J.build_graph_dataset(spark, source, out["graphs"], context=context, max_records=2).first()
    assert (summary.records, summary.graph_spec_sha256) == (6, SHAPE.spec.fingerprint)
    run = J.embed_graph_dataset(spark, out["graphs"], weights, out["staged"], SHAPE, embedding_dtype="float32").first()
    assert (run.status, run.records) == ("complete", 6)
    J.embed_table(spark, source, weights, out["direct"], SHAPE, context=context, embedding_dtype="float32")
    staged, direct = (matrices(spark.read.parquet(f"{out[k]}/embeddings")) for k in ("staged", "direct"))
    assert staged.keys() == direct.keys() and staged["a:9-16"].shape == (7, 5)
    for name, x in staged.items():
        np.testing.assert_allclose(x, direct[name], rtol=1e-5, atol=3e-7)
    rows = {r.graph_id: r for r in spark.read.json(f"{out['direct']}/manifest/records").collect()}
    assert (rows["a:9-16"].start, rows["a:9-16"].end, rows["a:9-16"].core_length, rows["a:9-16"].node_count) == (9, 16, 7, 15)
    assert (rows["b-full"].length, rows["b-full"].embedding_dim) == (8, 5)
    in_order = [r.graph_id for r in sorted(rows.values(), key=lambda r: r.record_ord)]
    assert in_order == ["a:9-16", "a:6-12", "a-full", "b:9-16", "b:6-12", "b-full"]
    other = weights.withColumn("values", F.transform("values", lambda x: (x + F.when(F.col("row") == 5, 1).otherwise(0)).cast("float")))
    assert run.weights_checksum == J.weights_checksum(weights.repartition(3)) != J.weights_checksum(other)


def test_bad_rows_stop_a_job_or_are_left_out(spark, weights, tmp_path):
    path = table(tmp_path, ["a"])
    with open(path, "a") as handle:
        handle.write("bad\tACGN\t....\t\t\n")
    with pytest.raises(RecordError, match="line 4"):
        J.embed_table(spark, path, weights, str(tmp_path / "x"), SHAPE)
    J.embed_table(spark, path, weights, str(tmp_path / "y"), SHAPE, options=J.TableOptions(on_error="reject"))
    assert spark.read.parquet(str(tmp_path / "y/embeddings")).count() == 3


def test_a_named_depth_switches_context_on():
    assert J.Context(context_hops=1).options() == {"keep_paired_neighbours": True, "context_hops": 1}
    assert J.Context().options() == {"keep_paired_neighbours": False, "context_hops": 1}


def test_arriving_datasets(spark, weights, tmp_path):
    incoming, out = str(tmp_path / "incoming"), str(tmp_path / "out")

    def arrive(name, ids):
        J.build_graph_dataset(spark, table(tmp_path, ids, f"{name}.tsv"), f"{incoming}/{name}")

    def run():
        q = embed_arriving_shards(spark, incoming, weights, out, SHAPE)
        q.awaitTermination()
        return spark.read.parquet(f"{out}/embeddings"), spark.read.parquet(f"{out}/rejects")

    arrive("one", ["a", "b"])
    # Graphs that are not published are unfinished and stay untouched.
    spark.read.parquet(f"{incoming}/one/graphs/*").write.parquet(f"{incoming}/half/graphs/run")
    done, rejects = run()
    assert (done.count(), rejects.count()) == (6, 0)
    done, rejects = run()
    assert (done.count(), rejects.count()) == (6, 0)
    arrive("two", ["b", "c"])
    arrive("three", ["c", "d"])
    done, rejects = run()
    assert done.count() == done.select("graph_id").distinct().count() == 12
    assert sorted({r.graph_id for r in rejects.collect()}) == ["b-full", "b:6-12", "b:9-16", "c-full", "c:6-12", "c:9-16"]
