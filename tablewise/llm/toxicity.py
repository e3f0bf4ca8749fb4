"""Severity of toxicity by cumulative-link ordinal regression over sparse text features.

One weight vector serves all thresholds: P(grade > k) = sigmoid(w x - theta_k) with ordered theta. Labels that only say toxic or not are
graded first: words that go with the toxic label are found on the fitting rows, and toxic texts are graded by how many of them they
hold. The output is the expected grade."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.shared import bounded_broadcast, prepare
from tablewise.llm.tokens import U, raw, words

FIT_ROWS = 12000  # labelled documents the model is fitted on
BITS, GRADES = 18, 3  # hashed words; grades above 0
LEAST_ROWS, LEAST_Z, LEAST_RATIO = 5, 4.0, 3.0  # a word's feature needs so many rows and so clear a difference between the labels
ROUNDS, STEP, PENALTY = 2000, 0.05, 0.03

_LETTERS = np.full(256, 32, np.uint8)
for _c in [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]:
    _LETTERS[_c] = _c


def _ids(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of each text, punctuation taken as space."""
    data, bounds = raw(column)
    h, cut = words(_LETTERS[data], bounds)
    return (h >> U(64 - BITS)).astype(np.int64), cut


def _grade(rows: list[np.ndarray], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grades of the fitting rows, and which features tell the labels apart."""
    with_ = [np.zeros(1 << BITS) for _ in range(2)]
    for x, t in zip(rows, toxic, strict=True):
        with_[t][x] += 1
    n = np.array([max((toxic == 0).sum(), 1), max((toxic == 1).sum(), 1)])
    p = (with_[0] + with_[1]) / n.sum()  # over both labels
    z = (with_[1] / n[1] - with_[0] / n[0]) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n[0] + 1 / n[1]))
    share = [with_[k] / n[k] for k in range(2)]
    clear = (with_[0] + with_[1] >= LEAST_ROWS) & (np.abs(z) >= LEAST_Z) & (np.maximum(*share) > LEAST_RATIO * np.minimum(*share))
    telling = clear & (share[1] > share[0])
    many = np.array([telling[x].sum() for x in rows])
    of_toxic = many[toxic == 1]
    cuts = np.quantile(of_toxic, np.arange(1, GRADES) / GRADES) if len(of_toxic) else np.zeros(GRADES - 1)
    return np.where(toxic == 1, 1 + np.searchsorted(cuts, many, "left"), 0), clear


def fit_ordinal(row: np.ndarray, index: np.ndarray, grade: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds that maximise the cumulative-link likelihood, by full gradient, each weight's step scaled by its
    recent gradients."""
    w = np.zeros(size)
    theta = np.linspace(1, 3, GRADES)
    seen_w, seen_t = np.zeros(size), np.zeros(GRADES)
    n = max(len(grade), 1)
    for r in range(ROUNDS):
        s = np.bincount(row, w[index], len(grade))
        b = np.concatenate([np.full((len(grade), 1), -40.0), theta - s[:, None], np.full((len(grade), 1), 40.0)], 1)
        cdf = 1 / (1 + np.exp(-np.clip(b, -40, 40)))
        at = np.arange(len(grade))
        low, high = cdf[at, grade], cdf[at, grade + 1]
        p = np.maximum(high - low, 1e-9)
        g_s = (1 - low - high) / n
        g_w = np.bincount(index, g_s[row], size) + PENALTY * w / n
        g_t = np.zeros(GRADES + 2)
        np.add.at(g_t, grade + 1, -high * (1 - high) / p / n)
        np.add.at(g_t, grade, low * (1 - low) / p / n)
        seen_w = 0.95 * seen_w + 0.05 * g_w ** 2
        seen_t = 0.95 * seen_t + 0.05 * g_t[1:-1] ** 2
        step = STEP * (1 - r / ROUNDS)
        w -= step * g_w / np.sqrt(seen_w + 1e-12)
        theta = np.sort(theta - step * g_t[1:-1] / np.sqrt(seen_t + 1e-12))
    return w, theta


def score_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """docs with expected_severity (0 to GRADES), severity (the likeliest grade) and toxic (grade above 0 likelier than not).

    docs needs doc_id and text, other columns pass through (those with one of the new names are replaced); labels needs doc_id and
    toxic (0 or 1; null takes no part). The model is fitted on at most fit_rows labelled documents, those of the smallest doc_id
    hashes, and scores all. Null and empty texts have severity 0. Without labels of both kinds nothing can be told and every document
    has severity 0. Documents labelled twice are fitted twice. An empty table gives an empty result."""
    prepare(docs.sparkSession)
    made = ["expected_severity", "severity", "toxic"]
    docs = docs.drop(*made)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cut = _ids(batch.column("text"))
            index = [np.unique(ids[a:b]).astype(np.int32) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(np.diff(cut)), pa.array(index, pa.list_(pa.int32()))], ["toxic", "size", "index"])

    told = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = told.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(fit_rows)
    fit = docs.select("doc_id", "text").join(bounded_broadcast(chosen, fit_rows), "doc_id").select("text", "toxic")
    fit = fit.mapInArrow(features, "toxic int, size long, index array<int>").toPandas()
    w, theta = np.zeros(1 << BITS), np.full(GRADES, 40.0)
    if len(fit) and fit["toxic"].nunique() == 2:
        fit = fit.iloc[np.lexsort((fit["index"].map(lambda x: int(np.sum(x, dtype=np.int64))), fit["size"], fit["toxic"]))]  # the same order in every run
        rows, toxic = fit["index"].to_list(), fit["toxic"].to_numpy()
        grade, clear = _grade(rows, toxic)
        used = np.flatnonzero(clear)
        short = np.full(1 << BITS, -1)
        short[used] = np.arange(len(used))
        kept = [short[x][short[x] >= 0] for x in rows]
        row = np.repeat(np.arange(len(rows)), [len(x) for x in kept])
        some, theta = fit_ordinal(row, np.concatenate(kept) if kept else np.zeros(0, np.int64), grade, max(len(used), 1))
        w[used] = some[: len(used)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cut = _ids(batch.column("text"))
            doc = np.repeat(np.arange(batch.num_rows), np.diff(cut))
            told = w[ids] != 0
            pairs = np.unique(doc[told] << BITS | ids[told])
            s = np.bincount(pairs >> BITS, w[pairs & (1 << BITS) - 1], batch.num_rows)
            above = 1 / (1 + np.exp(-np.clip(s[:, None] - theta, -40, 40)))
            above[np.diff(cut) == 0] = 0
            each = -np.diff(np.concatenate([np.ones((len(s), 1)), above, np.zeros((len(s), 1))], 1), axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(above.sum(1), 9)), pa.array(each.argmax(1).astype(np.int32)), pa.array(above[:, 0] > 0.5)],
                                             [*batch.schema.names, *made])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + ["expected_severity double", "severity int", "toxic boolean"])
    return docs.mapInArrow(score, schema)
