import numpy as np
from pyspark.sql import functions as F

from foldgraph.llm import neighbours as nb


def brute(rows, every, k):
    out = {}
    points = [(i, np.array(v)) for i, v in sorted(rows)]
    for i, q in points:
        if i % every == 0:
            scored = sorted((-float((q * v).sum()), j) for j, v in points if j != i)[:k]
            out[i] = [j for _, j in scored]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.vec_id)
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_and_scores(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("vec_id < 4000")
    rows = {r.vec_id: np.array(r.embedding, dtype=float) for r in vectors.collect()}
    df = nb.nearest(vectors, rows_per_block=1000)
    got, want = found(df), brute(list(rows.items()), 20, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.95
    assert all(abs(r.score - float((rows[r.query_id] * rows[r.vec_id]).sum())) < 1e-12 for r in df.limit(200).collect())


def test_ties_copies_and_bad_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(100)]
    rows += [(i, [1.0, 0.5, 0.0, 0.0]) for i in range(100, 220)]  # one vector, many times
    bad = [(500, None), (520, []), (540, [0.0] * 4), (560, [None, 1.0, 1.0, 1.0]), (580, [float("nan"), 1.0, 1.0, 1.0]), (600, [float("inf"), 0.0, 0.0, 0.0]),
           (620, [1.0, 2.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in [*rows, *bad, rows[3]]], "vec_id long, embedding array<float>, rank int, score double")
    got = found(nb.nearest(df, k=20, leaf=16, sure=0.9999))
    assert got == brute(rows, 20, 20)


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert nb.nearest(spark.createDataFrame([], schema)).count() == 0
    assert nb.nearest(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    three = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 9.0])], schema)
    assert found(nb.nearest(three)) == {0: [1, 2]}


def test_chi_square_points():
    for p, degrees, point in ((0.95, 1, 3.841), (0.5, 2, 1.386), (0.9, 8, 13.362)):
        assert abs(nb.chi_square_point(p, degrees) - point) < 1e-3


def recall(spark, ids, data, every=20, k=20):
    """Recall of the query's own defaults; a neighbour as near as the last one of brute force counts."""
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, data)], "vec_id long, embedding array<double>")
    got, place = found(nb.nearest(df, every=every, k=k)), {int(i): n for n, i in enumerate(ids)}
    shares = []
    for i in ids[ids % every == 0]:
        scores = data @ data[place[int(i)]]
        scores[place[int(i)]] = -np.inf
        least = np.partition(scores, -k)[-k]
        shares.append(sum(scores[place[j]] >= least - 1e-12 for j in got[int(i)]) / k)
    return float(np.mean(shares))


def test_recall_of_the_defaults_on_all_supplied_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("embedding is not null").dropDuplicates(["vec_id"]).collect()
    data = np.array([r.embedding for r in rows], dtype=float)
    assert recall(spark, np.array([r.vec_id for r in rows]), data) >= 0.9


def test_recall_of_the_defaults_on_clusters(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(16, 64))
    data = centres[rng.integers(0, 16, 8192)] + 0.5 * rng.normal(size=(8192, 64))
    assert recall(spark, np.arange(8192), data / np.linalg.norm(data, axis=1, keepdims=True)) >= 0.9


def test_the_stopping_test_is_sure_enough():
    import inspect

    assert inspect.signature(nb.nearest).parameters["sure"].default >= 0.95
