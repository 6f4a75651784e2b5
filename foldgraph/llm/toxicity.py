"""Toxicity: cumulative-link ordinal regression over sparse word features."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LETTERS = r"[^\W\d_]+"
#: Severity grades of toxic rows.
GRADES = 3
#: Folds of the sample for the margins that grades come from.
FOLDS = 3


class Model:
    """Weights shared by all thresholds, and the thresholds, in ascending order."""

    def __init__(self, words: list[str], weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = dict(zip(words, weights.tolist())), thresholds

    def at_least(self, text: str, find) -> np.ndarray:
        """P(grade >= k) for each k from 1."""
        known = self.weights
        hits = Counter([w for w in find(text.lower()) if w in known])
        eta = sum(known[w] * np.log1p(c) for w, c in hits.items())
        return 1 / (1 + np.exp(np.clip(self.thresholds - eta, -50, 50)))


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int, *, decay: float = 2e-5, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of the proportional-odds model by Adam on the whole sample.

    P(grade >= k) = sigmoid(w.x - theta_k); the gaps between thresholds are
    kept positive by learning their logarithms.
    """
    n, k = len(grades), max(1, int(grades.max(initial=0)))
    w, theta0, gaps = np.zeros(n_features), 1.0, np.zeros(k - 1)
    state = [[np.zeros_like(np.atleast_1d(p).astype(float)) for _ in range(2)] for p in (w, theta0, gaps)]
    for step in range(1, steps + 1):
        theta = theta0 + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        eta = np.bincount(rows, weights=values * w[columns], minlength=n)
        cum = 1 / (1 + np.exp(np.clip(theta[None, :] - eta[:, None], -40, 40)))  # P(y >= k)
        padded = np.concatenate([np.ones((n, 1)), cum, np.zeros((n, 1))], axis=1)
        slope = padded * (1 - padded)
        at = np.arange(n)
        p = np.maximum(padded[at, grades] - padded[at, grades + 1], 1e-12)
        d_eta = -(slope[at, grades] - slope[at, grades + 1]) / p
        d_theta = np.zeros(k)
        for j in range(1, k + 1):
            d_theta[j - 1] = (slope[:, j] * ((grades == j) / p)).sum() - (slope[:, j] * ((grades == j - 1) / p)).sum()
        grads = [
            np.bincount(columns, weights=values * d_eta[rows], minlength=n_features) / n + decay * w,
            np.atleast_1d(d_theta.sum() / n),
            np.array([d_theta[j:].sum() * np.exp(gaps[j - 1]) for j in range(1, k)]) / n,
        ]
        moved = []
        for p_now, g, (m, v) in zip((w, np.atleast_1d(theta0), gaps), grads, state):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            moved.append(p_now - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9))
        w, theta0, gaps = moved[0], float(moved[1][0]), moved[2]
    return w, theta0 + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def cross_fitted_margins(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, label: np.ndarray, fold: np.ndarray, n_features: int, steps: int = 150) -> np.ndarray:
    """How far each row is beyond the threshold of a binary fit on the other folds."""
    margin = np.zeros(len(label))
    for f in np.unique(fold):
        own = fold == f
        number = np.cumsum(~own) - 1
        held = own[rows]
        if len(set(label[~own].tolist())) < 2:
            continue
        w, theta = fit_ordinal(number[rows[~held]], columns[~held], values[~held], label[~own], n_features, steps=steps)
        margin[own] = np.bincount(rows[held], weights=values[held] * w[columns[held]], minlength=len(label))[own] - theta[0]
    return margin


def graded(label: np.ndarray, margin: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """0 for clean rows; toxic rows by the quantiles of their margins, 1 to ``grades``, equal margins alike."""
    bad = margin[label > 0]
    cuts = np.quantile(bad, np.arange(1, grades) / grades) if len(bad) else np.zeros(grades - 1)
    return np.where(label > 0, 1 + (margin[:, None] > cuts).sum(axis=1), 0)


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20_000, max_words: int = 2_000, min_documents: int = 3) -> Model | None:
    """Fit on at most about ``max_rows`` labelled documents, chosen by a hash of doc_id; whole texts each.

    The label says toxic or not. How severe a toxic row is, grade 1 to 3, comes
    from how sure of it models are that have not seen it: the thirds of its
    margins in binary fits on the other folds (:func:`cross_fitted_margins`). The
    features are the ``max_words`` words most associated with the label. Rows without label,
    text or doc_id teach nothing; None if either class is missing.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    if total > max_rows:
        known = known.where(F.xxhash64("doc_id").cast("double") / F.lit(2.0**64) + 0.5 < max_rows / total)
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(known), "doc_id")
    sample = sample.select("toxic", "text", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int").alias("fold"))
    find = re.compile(LETTERS).findall

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted: dict[str, list[int]] = {"": [0, 0]}
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counted[""][toxic > 0] += 1
                for w in set(find(text.lower())):
                    counted.setdefault(w, [0, 0])[toxic > 0] += 1
            clean, bad = zip(*counted.values())
            yield pa.RecordBatch.from_arrays([pa.array(list(counted)), pa.array(clean, pa.int64()), pa.array(bad, pa.int64())], names=["word", "clean", "bad"])

    counted = sample.mapInArrow(spread, "word string, clean long, bad long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
    sizes = counted.where("word = ''").first()
    if sizes is None or not sizes.clean or not sizes.bad:
        return None
    p, q = F.col("bad") / sizes.bad, F.col("clean") / sizes.clean
    both = (F.col("bad") + F.col("clean")) / (sizes.bad + sizes.clean)
    z = (p - q) / F.sqrt(both * (1 - both) * (1 / sizes.bad + 1 / sizes.clean) + 1e-12)
    top = counted.where((F.col("word") != "") & (F.col("bad") + F.col("clean") >= min_documents)).withColumn("z", F.abs(z))
    chosen = top.orderBy(F.desc("z"), "word").limit(max_words).collect()
    words = [r.word for r in chosen]
    number = {w: i for i, w in enumerate(words)}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, at, values = [], [], []
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hits = Counter([w for w in find(text.lower()) if w in number])
                label.append(int(toxic > 0))
                at.append([number[w] for w in hits])
                values.append([float(np.log1p(c)) for c in hits.values()])
            yield pa.RecordBatch.from_arrays(
                [pa.array(label, pa.int32()), batch.column(2), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))],
                names=["label", "fold", "at", "value"],
            )

    # At most max_rows rows of at most max_words numbers; clean rows hold few of the words.
    got = sample.mapInArrow(features, "label int, fold int, at array<int>, value array<float>").toArrow()
    lengths = got.column("at").combine_chunks().value_lengths().to_numpy()
    rows = np.repeat(np.arange(len(lengths)), lengths)
    columns = got.column("at").combine_chunks().flatten().to_numpy()
    values = got.column("value").combine_chunks().flatten().to_numpy().astype(float)
    label = got.column("label").to_numpy().astype(int)
    grades = graded(label, cross_fitted_margins(rows, columns, values, label, got.column("fold").to_numpy(), len(words)))
    weights, thresholds = fit_ordinal(rows, columns, values, grades, len(words))
    return Model(words, weights, thresholds)


def grade(docs: DataFrame, model: Model | None, *, keep: tuple[str, ...] = ("doc_id",), reject: float = 0.3) -> DataFrame:
    """``keep`` columns, severity (the expected grade), p_toxic (of grade 1 or more), rejected (p_toxic is ``reject`` or more), grade (0, or the likeliest above it if rejected).

    Null and empty texts, and any text when nothing was learned, have severity
    0 and are not rejected. Rows are independent, repeated rows repeat.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, find = sent.value, re.compile(LETTERS).findall
        for batch in batches:
            severity, toxic, grades = [], [], []
            for value in batch.column(len(keep)):
                text = value.as_py()
                p = known.at_least(text, find) if known and text else np.zeros(1)
                severity.append(float(p.sum()))
                toxic.append(float(p[0]))
                grades.append(1 + int(np.argmax(p - np.append(p[1:], 0.0))) if p[0] >= reject else 0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), pa.array(severity), pa.array(toxic), pa.array(grades, pa.int32()),
                 pa.array([p >= reject for p in toxic])],
                names=[*keep, "severity", "p_toxic", "grade", "rejected"],
            )

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", severity double, p_toxic double, grade int, rejected boolean"
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("_text")).mapInArrow(run, schema)


def keep_civil(docs: DataFrame, model: Model | None, *, reject: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that :func:`grade` does not reject, with their columns, in one pass over the texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, find = sent.value, re.compile(LETTERS).findall
        for batch in batches:
            texts = (value.as_py() for value in batch.column("text"))
            yield batch.filter(pa.array([not (known and t and known.at_least(t, find)[0] >= reject) for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
