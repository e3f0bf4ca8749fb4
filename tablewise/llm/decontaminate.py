"""Benchmark leaks by the q-gram lemma.

A stretch of n characters within e edits of an item shares at least n + 1 - q (e + 1) of its q-grams with it, on diagonals (position in
the text minus position in the item) that differ by at most e. Shared q-grams are counted in diagonal bands that overlap by e; regions
that reach the bound inside n + e characters are kept and verified by a banded local alignment. A region is a leak if its matches
minus its edits reach n - 2 e, which every stretch within the budget does."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.shared import prepare
from tablewise.llm.tokens import raw

Q, LENGTH, EDITS, BAND = 8, 60, 0.08, 8  # gram length; characters of a stretch (an item's own length, if shorter); edits a character; diagonals
BLOCK_BYTES = 4 << 20  # benchmark text that is indexed at a time; more of it takes more passes over the documents
PIECE = 4 << 20
HITS = 1 << 20  # shared grams that are listed at a time
REACH = LENGTH + int(EDITS * LENGTH)  # characters that hold a stretch within its budget

# ASCII letters and digits (lower-cased) and all bytes of other characters stay; anything else separates.
_PLAIN = np.full(256, 32, np.uint8)
for _c in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _PLAIN[_c] = _c
_PLAIN[65:91] = np.arange(97, 123)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _normal(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes, separators in a row as one, and which source byte each is."""
    plain = _PLAIN[data]
    keep = plain != 32
    keep[1:] |= plain[:-1] != 32
    at = np.flatnonzero(keep)
    return plain[at], at


def _grams(plain: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number."""
    if len(plain) < Q:
        return np.zeros(0, np.uint64)
    plain = np.ascontiguousarray(plain)
    return np.ndarray((len(plain) - Q + 1,), "<u8", plain, strides=(1,))


class Index:
    """q-grams of benchmark items, sorted by value; a bit table rules out nearly all other grams first."""

    def __init__(self, texts: list[str]):
        self.items = [_normal(np.frombuffer(t.encode(), np.uint8))[0] for t in texts]
        self.n = np.array([min(LENGTH, len(t)) for t in self.items], np.int64)
        self.edits = (EDITS * self.n).astype(np.int64)
        grams = [_grams(t) for t in self.items]
        code = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(code, kind="stable")
        sizes = [len(g) for g in grams]
        self.code = code[order]
        self.item = np.repeat(np.arange(len(grams)), sizes)[order]
        self.place = np.concatenate([np.arange(k) for k in sizes] or [np.zeros(0, int)])[order]
        bits = max(16, int(np.ceil(np.log2(16 * max(1, len(code))))))
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[(self.code * _MULTIPLIER) >> self.shift] = True

    def shared(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions whose grams the items hold, where these begin in the index, and how many there are."""
        p = np.flatnonzero(self.table[(grams * _MULTIPLIER) >> self.shift])
        lo = np.searchsorted(self.code, grams[p], "left")
        count = np.searchsorted(self.code, grams[p], "right") - lo
        some = np.flatnonzero(count)
        return p[some], lo[some], count[some]

    def listed(self, p: np.ndarray, lo: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text position, item and item position of every shared gram."""
        k = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(p, count), self.item[k], self.place[k]


def _slices(p: np.ndarray, count: np.ndarray) -> Iterator[slice]:
    """Slices of positions with at most HITS shared grams, or those of 2 * REACH characters. Neighbours overlap so far that one of them
    holds whatever lies within REACH characters."""
    total = np.cumsum(count)
    a = 0
    while a < len(p):
        b = max(np.searchsorted(total, total[a] - count[a] + HITS, "right"), np.searchsorted(p, p[a] + 2 * REACH))
        yield slice(a, b)
        if b >= len(p):
            return
        a = np.searchsorted(p, p[b] - REACH)


def _joined(index: Index, regions: np.ndarray) -> np.ndarray:
    """Regions of a band that touch as one, as slices and pieces overlap."""
    regions = regions[np.lexsort(regions.T[[4, 3, 2, 1, 0]])]
    if len(regions) < 2:
        return regions
    new = np.ones(len(regions), bool)
    new[1:] = (regions[1:, :3] != regions[:-1, :3]).any(1) | (regions[1:, 3] > regions[:-1, 4] + index.n[regions[1:, 1]])
    begin = np.flatnonzero(new)
    return np.concatenate([regions[begin, :4], np.maximum.reduceat(regions[:, 4], begin)[:, None]], 1)


def _regions(index: Index, p: np.ndarray, item: np.ndarray, place: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows of doc, item, band, first and last text position: where a band reaches the bound of the lemma."""
    if not len(p):
        return np.zeros((0, 5), np.int64)
    e, n = index.edits[item], index.n[item]
    diagonal = p - place
    twice = np.flatnonzero(diagonal % BAND < e)  # the band before reaches so far, too
    rows = np.concatenate([np.arange(len(p)), twice])
    band = np.concatenate([diagonal // BAND, diagonal[twice] // BAND - 1])
    p, item, doc, n, e = p[rows], item[rows], doc[rows], n[rows], e[rows]
    order = np.lexsort((p, band, item, doc))
    p, item, doc, band, n, e = (x[order] for x in (p, item, doc, band, n, e))
    need = np.maximum(n + 1 - Q * (e + 1), 1)
    last = np.arange(len(p)) + need - 1
    ok = last < len(p)
    far = np.minimum(last, len(p) - 1)
    ok &= (doc[far] == doc) & (item[far] == item) & (band[far] == band) & (p[far] - p <= n + e - Q)
    first, far = np.flatnonzero(ok), far[ok]
    if not len(first):
        return np.zeros((0, 5), np.int64)
    new = np.ones(len(first), bool)  # windows of a band that touch are one region
    new[1:] = (doc[first[1:]] != doc[first[:-1]]) | (item[first[1:]] != item[first[:-1]]) | (band[first[1:]] != band[first[:-1]]) | (p[first[1:]] > p[far[:-1]] + n[first[1:]])
    begin = np.flatnonzero(new)
    return np.stack([doc[first[begin]], item[first[begin]], band[first[begin]], p[first[begin]], np.maximum.reduceat(p[far], begin)], 1)


def _align(index: Index, plain: np.ndarray, regions: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Banded local alignment of each region with its item, all regions a row at a time: score (matches minus edits), first and last
    text position. lo, hi: the text's own positions, which an alignment does not leave."""
    item, band, a, b = regions[:, 1], regions[:, 2], regions[:, 3], regions[:, 4]
    pad = 4
    left = band * BAND - pad  # lowest diagonal
    width = BAND + int(index.edits[item].max()) + 2 * pad
    sizes = np.array([len(index.items[i]) for i in item])
    top = np.maximum(a - left - width - LENGTH, 0)
    bottom = np.minimum(b - left + Q + LENGTH, sizes)
    steps = int((bottom - top).max())
    chars = np.zeros((len(item), steps), np.uint8)
    for r in range(len(item)):
        part = index.items[item[r]][top[r]: bottom[r]]
        chars[r, : len(part)] = part
    one = np.int64(1) << 32  # a cell holds the score above 32 bits, below them how early its alignment began
    cols = np.arange(width)
    early = np.int64(one - 1)
    state = np.full((len(item), width), -one)
    best, end = np.full(len(item), -one), np.zeros(len(item), np.int64)
    for s in range(steps):
        at = (top + s + left)[:, None] + cols
        inside = (at >= lo[:, None]) & (at < hi[:, None]) & (s < bottom - top)[:, None]
        equal = plain[np.clip(at, 0, len(plain) - 1)] == chars[:, s: s + 1]
        fresh = early - (at - lo[:, None])  # score 0, beginning here
        score = np.maximum(np.maximum(state, 0), fresh) + np.where(equal, one, -one)
        score[:, :-1] = np.maximum(score[:, :-1], state[:, 1:] - one)
        score = np.where(inside, score, -one)
        score = np.maximum.accumulate(score + cols * one, axis=1) - cols * one
        state = np.where(inside, score, -one)
        row = state.argmax(1)
        value = state[np.arange(len(item)), row]
        better = value > best
        end[better] = at[np.arange(len(item)), row][better]
        best = np.maximum(best, value)
    return np.stack([best >> 32, lo + early - (best & early), end], 1)


def _leaks(index: Index, data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Text number, item number, score, first and last byte (exclusive) of the best leak of each item in each text."""
    plain, at = _normal(data)
    cut = np.searchsorted(at, bounds)
    found = [np.zeros((0, 5), np.int64)]
    grams = _grams(plain)
    for begin in range(0, len(grams), PIECE):
        p, lo, count = index.shared(grams[begin: begin + PIECE + REACH])
        for some in _slices(p, count):
            at_p, item, place = index.listed(p[some] + begin, lo[some], count[some])
            doc = np.searchsorted(cut, at_p, "right") - 1
            whole = at_p + Q <= cut[doc + 1]
            found.append(_regions(index, at_p[whole], item[whole], place[whole], doc[whole]))
    regions = _joined(index, np.concatenate(found))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for k in range(0, len(regions), 256):
        part = regions[k: k + 256]
        aligned = _align(index, plain, part, cut[part[:, 0]], cut[part[:, 0] + 1])
        for (d, i, *_), (score, s, t) in zip(part.tolist(), aligned.tolist(), strict=True):
            if score >= index.n[i] - 2 * index.edits[i]:
                best[d, i] = max(best.get((d, i), (-1, 0, 0)), (score, -s, -t))
    return [(d, i, score, int(at[-s]), int(at[-t]) + 1) for (d, i), (score, s, t) in sorted(best.items())]


_LEAK = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
_LEAK_SQL = "array<struct<item_id:bigint,score:bigint,start:bigint,end:bigint>>"


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with leaks: for each benchmark item found in the text its item_id, score, and where (code points, end exclusive).

    docs needs text, benchmark item_id (integer) and text; other columns of docs pass through, one called leaks is replaced. Case,
    punctuation and spacing do not count. Null and empty texts have no leaks. Items of fewer than Q normalised characters, or without
    text, take no part; items of equal text are each reported; of equal leaks of an item in a text the first is. Repetitive texts share
    grams with repetitive items at very many places; these are listed in slices, so they take time and no memory. Rows are independent, so nothing is shuffled; repeated rows repeat
    their result. An empty benchmark gives empty arrays."""
    prepare(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name.lower() != "leaks"]
    out = docs.select([F.col(f"`{f.name}`") for f in kept]).withColumn("leaks", F.expr(f"cast(array() as {_LEAK_SQL})"))
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES)
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()  # one block: a bounded text
        ids, texts = [r[0] for r in rows], [r[1] for r in rows]

        def scan(batches: Iterator[pa.RecordBatch], ids=ids, texts=texts) -> Iterator[pa.RecordBatch]:
            index = Index(texts)
            for batch in batches:
                data, bounds = raw(batch.column("text"))
                new: list[list[dict]] = batch.column("leaks").to_pylist()
                for d, i, score, s, t in _leaks(index, data, bounds):
                    text = data[bounds[d]: bounds[d + 1]]
                    first = (text[: s - bounds[d]] & 0xC0) != 0x80
                    start = int(first.sum())
                    length = int(((text[s - bounds[d]: t - bounds[d]] & 0xC0) != 0x80).sum())
                    new[d].append({"item_id": ids[i], "score": score, "start": start, "end": start + length})
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(new, _LEAK)], batch.schema.names)

        if rows:
            out = out.mapInArrow(scan, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"leaks {_LEAK_SQL}"]))
    return out
