from pyspark.sql import functions as F

from foldgraph.llm import language as lg, toxicity as tx
from tests.llm.conftest import SF


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lg.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    assert got.where("score < 0 or score > 1").isEmpty()
    import zlib

    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got.select("doc_id").collect())


def test_language_edges(table, edge, prose):
    taught = [(100 + i, prose(i, 30), "aa", "s") for i in range(40)] + [(200 + i, "qux quy zzyz quux " * 9 + str(i), "bb", "s") for i in range(40)]
    rows = taught + [(i, t, None) for i, t in edge] + [(300, "zzyzq quxy", None), (301, "1234 --", None)]
    got = lg.identify(table(rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (1, 2, 3, 301))
    assert by[300].lang_pred == "bb" and by[7].lang_pred == "aa"
    assert {r.lang_pred for r in got} <= {"aa", "bb", "und"}
    assert {r.lang_pred for r in lg.identify(table([(1, "abc", None)])).collect()} == {"und"}
    assert lg.identify(table([])).count() == 0


def test_unknown_words_fall_back_to_shorter_grams():
    import numpy as np

    model = lg.Model(["a", "b"], {"known": np.array([-1.0, -2.0])}, {"abcd": np.array([-1.0, -5.0]), "x": np.array([-4.0, -2.0])}, np.array([-9.0, -9.0]), 4)
    scores = model.scores(["known", "abcd", "x"])
    assert scores[0].tolist() == [-1.0, -2.0]
    assert scores[1].tolist() == [-9.0 - 1.0 - 9.0, -9.0 - 5.0 - 9.0]  # "<abc", "abcd", "bcd>"
    assert scores[2].tolist() == [-9.0, -9.0]  # "<x>": nothing starts with "<"


def test_every_language_is_learned_whatever_its_share(table, prose):
    """A small sample, one text on half of all rows, and a language with few documents."""
    copies = [(i, "unos dos tres cuatro cinco seis " * 9, "bb") for i in range(2000)]
    rows = copies + [(5000 + i, prose(i, 40), "aa") for i in range(2000)] + [(9000 + i, f"qux quy zzyz quux qaz{i} " * 9, "cc") for i in range(12)]
    model = lg.fit(table(rows), max_documents=30, least_documents=10)
    assert model.langs == ["aa", "bb", "cc"]
    got = lg.predict(table([(1, "dos tres seis"), (2, prose(77, 20)), (3, "quy quux zzyz")]), model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {1: "bb", 2: "aa", 3: "cc"}
    # A share so small that nothing is chosen teaches nothing, and nothing fails.
    assert lg.fit(table(rows), max_documents=0, least_documents=0) is None
    assert {r.lang_pred for r in lg.predict(table([(1, "dos tres")]), None).collect()} == {"und"}


def test_scores_equal_a_count_by_hand(table):
    """Word and n-gram frequencies, floors and backoff recomputed without Spark."""
    import re
    from collections import Counter

    import numpy as np

    rows = [(1, "red red blue sky", "en"), (2, "red sea sea", "en"), (3, "rouge mer mer ciel rouge", "fr"), (4, "mer rouge red", "fr")]
    model = lg.fit(table(rows), min_count=1)
    words, grams = {g: Counter() for g in ("en", "fr")}, {g: Counter() for g in ("en", "fr")}
    for _, text, lang in rows:
        words[lang].update(re.findall(r"[^\W\d_]+", text))
    for lang, found in words.items():
        for w in found:
            grams[lang].update(f"<{w}>"[i : i + n] for n in range(1, 5) for i in range(len(w) + 3 - n))
    total = {k: {g: sum(c[g].values()) for g in c} for k, c in (("w", words), ("g", grams))}
    unseen = {k: 0.1 / (sum(t.values()) + 1) for k, t in total.items()}

    def by_hand(word, lang):
        if any(word in c for c in words.values()):
            return np.log(words[lang][word] / total["w"][lang] + unseen["w"])
        marked, score = f"<{word}>", 0.0
        for at in range(max(1, len(marked) - 3)):
            gram = next((marked[at : at + n] for n in range(4, 0, -1) if any(marked[at : at + n] in c for c in grams.values())), None)
            score += np.log(unseen["g"]) if gram is None else np.log(grams[lang][gram] / total["g"][lang] + unseen["g"]) * len(gram) / 4
        return score

    for word in ("red", "mer", "sky", "skies", "rougir", "zzz", "re"):
        want = [by_hand(word, g) for g in model.langs]
        assert np.allclose(model.scores([word])[0], want), word


def test_grades_come_from_margins_of_other_folds():
    import numpy as np

    rng = np.random.default_rng(3)
    n = 600
    strength = np.where(np.arange(n) % 2, rng.integers(1, 10, n), 0)  # of toxic rows, in one feature
    values, label = np.log1p(strength + rng.integers(0, 2, n)).astype(float), (strength > 0).astype(int)
    margin = tx.cross_fitted_margins(np.arange(n), np.zeros(n, dtype=int), values, label, rng.integers(0, 3, n), 1)
    grades = tx.graded(label, margin)
    assert set(grades[label == 0]) == {0} and set(grades[label > 0]) == {1, 2, 3}
    means = [strength[grades == g].mean() for g in (1, 2, 3)]
    assert means[0] < means[1] < means[2]
    assert tx.graded(label, np.zeros(n)).max() == 1  # equal margins, equal grades


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = tx.fit(docs, labels.where("doc_id % 3 <> 0"))
    got = tx.grade(docs, model).join(labels, "doc_id").where("doc_id % 3 = 0")
    right = got.agg(F.avg((F.col("rejected") == (F.col("toxic") == 1)).cast("int")), F.sum(((F.col("toxic") == 0) & F.col("rejected")).cast("int"))).first()
    # Of about 1,200 clean rows, which hold single words of the toxic ones, two or three are rejected.
    assert right[0] > 0.97 and right[1] <= 3
    assert list(model.thresholds) == sorted(model.thresholds)
    # Held-out order: of a toxic and a clean row, the toxic one is more severe.
    by = {t: sorted(r.severity for r in got.where(f"toxic = {t}").collect()) for t in (0, 1)}
    above = sum(sum(c < s for c in by[0]) for s in by[1]) / (len(by[0]) * len(by[1]))
    assert above > 0.98


def test_ordinal_fit_orders_grades():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.random(900) * 3
    grades = np.digitize(x + rng.normal(0, 0.1, 900), [1.0, 2.0])
    w, theta = tx.fit_ordinal(np.arange(900), np.zeros(900, dtype=int), x, grades, 1)
    expected = (1 / (1 + np.exp(theta[None] - w * x[:, None]))).sum(axis=1)
    assert np.corrcoef(expected, grades)[0, 1] > 0.95 and 0.8 < theta[0] / w[0] < 1.2 and 1.8 < theta[1] / w[0] < 2.2


def test_toxicity_edges(spark, table, edge):
    docs = table([*edge, *((1000 + i, "plain words here " + "vile awful " * (i % 2), None) for i in range(40))])
    labels = spark.createDataFrame([(1000 + i, None, i % 2, "x") for i in range(40)] + [(None, 1, 1, "x"), (1, 1, None, "x"), (1000, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    model = tx.fit(docs, labels)
    got = tx.grade(docs, model).collect()
    assert len(got) == docs.count()
    assert all(r.rejected == (r.doc_id % 2 == 1) for r in got if r.doc_id is not None and 1000 <= r.doc_id < 2000)
    assert all((r.severity, r.rejected) == (0.0, False) for r in got if r.doc_id in (1, 2))
    kept = tx.keep_civil(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r.rejected for r in got)
    assert tx.fit(docs, labels.where("toxic = 0")) is None and tx.grade(docs, None).where("rejected").isEmpty()
    assert tx.grade(table([]), model).count() == 0 and tx.fit(table([]), labels) is None
