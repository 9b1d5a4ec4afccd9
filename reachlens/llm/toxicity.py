"""Toxicity: cumulative-link ordinal regression over sparse word features.

The chance of grade k or more is ``sigmoid(w . x - threshold_k)``: one weight per word,
shared by all grades, and ordered thresholds. ``x`` says which of the selected words a text
holds. The model is fitted on a bounded sample of labelled documents (``sample_rows`` per
class, chosen by a hash of the id); everything else covers all documents. Words are selected
in Spark by how much more often one class holds them; only those (``n_features`` at most) and
the sample's rows over them reach the driver. Weights have an L1 penalty, so most are zero.

The labels say only toxic or not; the grades above zero are taken from how many different
marker words a toxic sample document holds (see :func:`grades`). A caller with graded labels
passes them to :func:`fit` directly.

Defined results: a null text holds no words; a null label or id takes no part in fitting; a document
labelled both ways is toxic;
without labelled rows of both classes every document has severity 0; repeated rows are scored
row by row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reachlens.llm.license_scan import words_of
from reachlens.sources.shared import written


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass(frozen=True)
class Model:
    weights: dict[bytes, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = ()

    def at_least(self, words: set[bytes]) -> list[float]:
        """Chance of grade 1 or more, 2 or more, and so on."""
        score = sum(self.weights[w] for w in self.weights.keys() & words)
        return [float(_sigmoid(np.float64(score - t))) for t in self.thresholds]


def fit(
    rows: np.ndarray, cols: np.ndarray, grade: np.ndarray, weight: np.ndarray, n_cols: int, l1: float = 1.5e-4, steps: int = 3000,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds from a 0/1 matrix in coordinate form, by accelerated proximal
    gradient steps on the mean negative log likelihood of the cumulative-link model."""
    n, top = len(grade), int(grade.max())
    weight = weight / weight.sum()
    share = np.array([weight[grade >= k].sum() for k in range(1, top + 1)])
    theta = -np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1))
    w = np.zeros(n_cols)
    v, vt, momentum = w.copy(), theta.copy(), 1.0
    # A bound on the curvature that is separate for every word, so rare words move as fast.
    load = weight * (np.bincount(rows, minlength=n) + 1)
    rate = 1 / np.maximum(0.5 * np.bincount(cols, load[rows], n_cols), 1e-9)
    rate_t = 1 / np.maximum(0.5 * load.sum(), 1e-9)
    for _ in range(steps):
        score = np.bincount(rows, v[cols], n)
        edges = np.concatenate([[-np.inf], vt, [np.inf]])
        low, high = _sigmoid(score - edges[grade]), _sigmoid(score - edges[grade + 1])
        chance = np.maximum(low - high, 1e-12)
        d_low, d_high = low * (1 - low) / chance, high * (1 - high) / chance
        g = -weight * (d_low - d_high)
        gt = np.array([(weight * d_low)[grade == k].sum() - (weight * d_high)[grade == k - 1].sum() for k in range(1, top + 1)])
        step = v - rate * np.bincount(cols, g[rows], n_cols)
        new = np.sign(step) * np.maximum(np.abs(step) - rate * l1, 0)
        new_t = np.maximum.accumulate(vt - rate_t * gt + 1e-6 * np.arange(top))
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v, vt = new + (momentum - 1) / faster * (new - w), np.sort(new_t + (momentum - 1) / faster * (new_t - theta))
        w, theta, momentum = new, new_t, faster
    return w, theta


def grades(rows: np.ndarray, cols: np.ndarray, toxic: np.ndarray, steps: tuple[int, ...] = (2, 5), ratio: float = 8.0) -> np.ndarray:
    """0 for clean rows; for toxic ones 1, and one more for each number in ``steps`` of
    different marker words reached. A marker is held ``ratio`` times as often by toxic rows."""
    n = max(cols.max(initial=-1) + 1, 1)
    bad = (np.bincount(cols, toxic[rows], n) + 0.5) / (toxic.sum() + 1)
    good = (np.bincount(cols, 1 - toxic[rows], n) + 0.5) / ((1 - toxic).sum() + 1)
    held = np.bincount(rows, (bad / good >= ratio)[cols], len(toxic))
    return np.where(toxic == 1, 1 + sum((held >= s).astype(int) for s in steps), 0)


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = [sorted(set(words_of(t.as_py()))) for t in batch.column("text")]
        yield pa.record_batch([batch.column("toxic"), batch.column("row"), pa.array(held, pa.list_(pa.binary()))], ["toxic", "row", "words"])


def trained(
    docs: DataFrame, labels: DataFrame, sample_rows: int = 3000, n_features: int = 500, least_docs: int = 5,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> Model:
    """A model from at most ``sample_rows`` labelled documents of each class."""
    labelled = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).filter("id IS NOT NULL AND toxic IN (0, 1)")
    labelled = labelled.groupBy("id").agg(F.max("toxic").alias("toxic"))  # a document labelled both ways is toxic
    totals = {r.toxic: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return Model()
    chosen = [labelled.filter(F.col("toxic") == c).orderBy(F.xxhash64("id"), "id").limit(sample_rows) for c in (0, 1)]
    sample = chosen[0].unionByName(chosen[1]).withColumn("row", F.xxhash64("id"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    # At most 2 * sample_rows ids are broadcast, and that many documents stored.
    held = written(
        texts.join(F.broadcast(sample), "id").select("toxic", "row", "text").mapInArrow(_distinct_words, "toxic int, row long, words array<binary>"),
        "toxicity-sample",
    )
    n = {r.toxic: r["count"] for r in held.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return Model()
    share = lambda c: F.sum(F.expr(f"CASE WHEN toxic = {c} THEN 1 ELSE 0 END")) / n[c]
    features = (
        held.select("toxic", F.explode("words").alias("word")).groupBy("word")
        .agg(F.count("*").alias("n"), share(1).alias("bad"), share(0).alias("good")).filter(F.col("n") >= least_docs)
        .withColumn("z", F.expr("abs(bad - good) / sqrt((bad + good) / 2 + 1e-4)"))
        .orderBy(F.desc("z"), "word").limit(n_features).select("word").collect()
    )
    number = {bytes(r.word): i for i, r in enumerate(features)}
    listed = held.sparkSession.createDataFrame([(w, i) for w, i in number.items()], "word binary, i int")
    cells = (
        held.select("toxic", "row", F.explode_outer("words").alias("word"))
        .join(F.broadcast(listed), "word", "left").groupBy("row", "toxic").agg(F.collect_set("i").alias("i")).collect()
    )
    toxic = np.array([c.toxic for c in cells])
    rows = np.repeat(np.arange(len(cells)), [len(c.i) for c in cells])
    cols = np.array([i for c in cells for i in c.i], np.int64)
    weight = np.array([totals[c] / n[c] for c in toxic], float)
    weights, thresholds = fit(rows, cols, grades(rows, cols, toxic), weight, max(len(number), 1))
    return Model({w: float(weights[i]) for w, i in number.items() if weights[i]}, tuple(map(float, thresholds)))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: expected severity, likeliest grade, chance of any toxicity, and
    ``toxic`` where that chance is a half or more."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text"):
                chances = model.at_least(set(words_of(text.as_py())))
                each = np.diff([1.0, *chances, 0.0]) * -1
                out.append((sum(chances), int(np.argmax(each)), chances[0] if chances else 0.0))
            severity, grade, chance = zip(*out) if out else ((), (), ())
            yield pa.record_batch([
                batch.column("doc_id"), pa.array(severity, pa.float64()), pa.array(grade, pa.int64()), pa.array(chance, pa.float64()),
                pa.array([c >= 0.5 for c in chance], pa.bool_()),
            ], ["doc_id", "severity", "grade", "p_toxic", "toxic"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(score, "doc_id long, severity double, grade long, p_toxic double, toxic boolean")
