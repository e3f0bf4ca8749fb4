"""Quality by weak supervision: heuristic labellers vote, expectation-maximisation estimates how far to trust each, and their posterior
labels train a hashed linear scorer over all words and word shapes.

The votes of all documents are counted by pattern (at most 3 to the number of labellers), so the estimation sees every document but only
a bounded table reaches the driver. The scorer is fitted on a bounded sample of documents; it scores every one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.shared import prepare
from tablewise.llm.tokens import U, mix, raw, words

FIT_ROWS = 6000  # documents the scorer is fitted on
BUCKETS = 1 << 15  # for words, and as many for shapes
ROUNDS, LEARNING, PENALTY = 150, 1.0, 1e-6
BLOCK = 1 << 18  # features of one block of rows, so that fitting needs little memory beside the features themselves
# Character classes: other, lower, upper, digit, and the marks that separate kinds of writing.
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 1
for _k, _c in enumerate(b".,!?|*#$%&@/\\{}[]()<>=+_^~;:'\"-"):
    _CLASS[_c] = 4 + _k
_SYMBOLS = np.isin(np.arange(256), list(b"|*#$%&@\\{}[]<>=+_^~"))


def _parts(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Per text: shares of characters and words that the labellers look at; per word: features."""
    def per_text(flags: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return run[bounds[1:]] - run[bounds[:-1]]

    h, cut = words(data, bounds)
    n = np.diff(cut)
    kind = _CLASS[data]
    letters = per_text((kind == 1) | (kind == 2))
    inner = kind == 2  # capitals after a capital
    inner[1:] &= kind[:-1] == 2
    inner[bounds[:-1][np.diff(bounds) > 0]] = False
    known = per_text((kind > 0) & ~_SYMBOLS[data])
    first = np.zeros(len(h), bool)
    first[cut[:-1][n > 0]] = True
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & ~first[1:]
    # Shapes: runs of one class collapse; a word's shape is the hash of its runs.
    change = np.ones(len(kind), bool)
    change[1:] = kind[1:] != kind[:-1]
    collapsed = np.where(change | (kind > 3), kind, 0).astype(U)
    space = np.isin(data, np.frombuffer(b"\x20\x09\x0a\x0b\x0c\x0d", np.uint8))
    begin = ~space
    begin[1:] &= space[:-1]
    begin[bounds[:-1][np.diff(bounds) > 0]] |= ~space[bounds[:-1][np.diff(bounds) > 0]]
    starts = np.flatnonzero(begin)
    mark = np.zeros(len(data), np.int64)
    mark[starts] = starts
    place = np.arange(len(data)) - np.maximum.accumulate(mark)
    weight = mix(np.minimum(place, 15).astype(U) * U(64) + collapsed)
    shape = np.add.reduceat(np.where(space | (collapsed == 0), U(0), weight), starts) if len(starts) else np.zeros(0, U)
    before = np.concatenate([np.zeros(min(1, len(shape)), U), shape[:-1]])
    before[first] = 0
    shape_id = mix(shape * U(3) + before * U(5) + again.astype(U)) >> U(64 - 15)
    unique = np.array([len(np.unique(h[a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True)], np.int64)
    safe = lambda x, y: x / np.maximum(y, 1)
    run = np.concatenate([[0], np.cumsum(again)])
    ends = per_text(np.isin(data, np.frombuffer(b".?!", np.uint8)))
    return {
        "h": h, "cut": cut, "n": n, "ids": np.stack([(h >> U(64 - 15)).astype(np.int64), shape_id.astype(np.int64) + BUCKETS]),
        "upper": safe(per_text(inner), letters), "symbols": safe(per_text(_SYMBOLS[data]), n), "shouts": safe(per_text(data == 33), n), "pipes": safe(per_text(data == 124), n),
        "again": safe(run[cut[1:]] - run[cut[:-1]], n), "unique": safe(unique, n), "plain": safe(known, per_text(~space)), "length": safe(per_text(~space), n), "sentences": safe(ends, n),
    }


def _votes(s: dict[str, np.ndarray]) -> np.ndarray:
    """One column per labeller: 2 for good, 0 for poor, 1 for no opinion."""
    n = s["n"]
    poor_if = [
        s["upper"] > 0.25, s["symbols"] > 0.25, s["shouts"] > 0.2, s["pipes"] > 0.2, s["again"] > 0.15,
        (n >= 40) & (s["unique"] < 4 / np.sqrt(np.maximum(n, 1)) * 0.5), s["plain"] < 0.85, n == 0,
    ]
    good_if = [
        (n > 0) & (s["upper"] < 0.1) & (s["symbols"] < 0.05), (n > 0) & (s["again"] < 0.04) & (s["plain"] > 0.95), (n > 0) & (s["sentences"] > 0.01) & (s["shouts"] < 0.05) & (s["pipes"] < 0.02),
    ]
    poor = [np.where(x, 0, 1) for x in poor_if]
    return np.stack(poor + [np.where(x, 2, 1) for x in good_if], 1)


LABELLERS = 11


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Posterior probability of good for each vote pattern. Labellers are taken as independent given the class; how often each votes what
    in either class is estimated. It starts from the votes' balance, which also decides which class is the good one."""
    if not len(counts):
        return np.zeros(0)
    balance = (patterns == 2).sum(1) - 3.0 * (patterns == 0).sum(1)
    post = 1 / (1 + np.exp(-balance))
    one_hot = (patterns[:, :, None] == np.arange(3)).astype(float)
    for _ in range(rounds):
        tables = []
        for w in (post * counts, (1 - post) * counts):
            t = np.einsum("p,plv->lv", w, one_hot) + 0.5
            tables.append(np.log(t / t.sum(1, keepdims=True)))
        prior = np.log((post @ counts + 1) / ((1 - post) @ counts + 1))
        post = 1 / (1 + np.exp(-np.clip(prior + np.einsum("plv,lv->p", one_hot, tables[0] - tables[1]), -50, 50)))
    return post


def _fit_linear(index: np.ndarray, value: np.ndarray, cut: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Logistic regression on soft labels by full gradient with per-weight step sizes; the last weight is the bias."""
    w, seen = np.zeros(2 * BUCKETS + 1), np.full(2 * BUCKETS + 1, 1e-8)
    weight = np.where(label < 0.5, 0.5 / max((label < 0.5).mean(), 1e-3), 0.5 / max((label >= 0.5).mean(), 1e-3))  # either class counts alike
    size = np.diff(cut)
    edge = np.unique(np.concatenate([[0], np.searchsorted(cut, np.arange(0, cut[-1], BLOCK)), [len(label)]]))  # rows are taken block by block
    for _ in range(ROUNDS):
        g, bias = PENALTY * w, 0.0
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            i, v, row = index[cut[a]: cut[b]], value[cut[a]: cut[b]], np.repeat(np.arange(b - a), size[a:b])
            score = np.bincount(row, v * w[i], b - a) + w[-1]
            error = weight[a:b] * (1 / (1 + np.exp(-score)) - label[a:b]) / len(label)
            g += np.bincount(i, error[row] * v, len(w))
            bias += error.sum()
        g[-1] = bias
        seen += g * g
        w -= LEARNING * g / np.sqrt(seen)
    return w


def _sparse(s: dict[str, np.ndarray], rows: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    index, value = [], []
    for r in rows:
        ids, c = np.unique(s["ids"][:, s["cut"][r]: s["cut"][r + 1]], return_counts=True)
        index.append(ids.astype(np.int32))
        value.append((c / max(s["n"][r], 1)).astype(np.float32))
    return index, value


def score_quality(docs: DataFrame, fit_rows: int = FIT_ROWS, least: float = 0.5) -> DataFrame:
    """docs with quality_vote (posterior of the labellers), quality (the scorer's probability of good) and keep (quality >= least).

    docs needs text; other columns pass through, columns with one of the new names are replaced. Null and empty texts and texts
    without words have no evidence but the labeller for empty texts: they score 0 and are not kept. Repeated rows score alike. The scorer
    is fitted on at most fit_rows documents, those of the smallest text hashes, the same in every run; estimation and scoring cover all.
    An empty table gives an empty result."""
    prepare(docs.sparkSession)
    made = ["quality_vote", "quality", "keep"]
    docs = docs.drop(*made)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _votes(_parts(*raw(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([pa.array(v @ 3 ** np.arange(LABELLERS))], ["pattern"])

    texts = docs.select("text")
    seen = sorted((r[0], r[1]) for r in texts.mapInArrow(look, "pattern long").groupBy("pattern").count().collect())  # at most 3^11 rows
    codes = np.array([p for p, _ in seen], np.int64)
    patterns = codes[:, None] // 3 ** np.arange(LABELLERS) % 3
    post = fit_labellers(patterns, np.array([c for _, c in seen], float))

    def posterior(s: dict[str, np.ndarray]) -> np.ndarray:
        return post[np.searchsorted(codes, _votes(s) @ 3 ** np.arange(LABELLERS))]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _parts(*raw(batch.column("text")))
            index, value = _sparse(s, np.arange(batch.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32())), pa.array(posterior(s))], ["index", "value", "label"])

    total = sum(c for _, c in seen)
    key = F.xxhash64("text")
    # Twice the share that is needed by hash, then exactly the smallest ones.
    near = key < F.lit(int(-(2 ** 63) + min(1.0, 2 * fit_rows / max(total, 1)) * (2 ** 64 - 1025)))
    sample = texts.where(F.col("text").isNotNull() & near).select("text", key.alias("k")).distinct().orderBy("k", "text").limit(fit_rows)
    rows = sample.select("text").mapInArrow(features, "index array<int>, value array<float>, label double").toArrow().combine_chunks()
    if rows.num_rows:
        lists, value = rows.column("index").combine_chunks(), rows.column("value").combine_chunks().flatten().to_numpy()
        cut = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        w = _fit_linear(lists.flatten().to_numpy(), value, cut, rows.column("label").to_numpy())
        rows = lists = value = None
    else:
        w = np.zeros(2 * BUCKETS + 1)
    w = w.astype(np.float32)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _parts(*raw(batch.column("text")))
            each = w[s["ids"]].sum(0, dtype=np.float64)
            run = np.concatenate([[0.0], np.cumsum(each)])
            q = 1 / (1 + np.exp(-np.clip((run[s["cut"][1:]] - run[s["cut"][:-1]]) / np.maximum(s["n"], 1) + w[-1], -50, 50)))
            q = np.round(np.where(s["n"] == 0, 0.0, q), 9)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(posterior(s)), pa.array(q), pa.array(q >= least)], [*batch.schema.names, *made])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + ["quality_vote double", "quality double", "keep boolean"])
    return docs.mapInArrow(score, schema)
