"""Ranked lexical search over a K2-treap of the term-document grid.

A point of the grid is a term (row) in a document (column) with its impact, what the term adds to that document's score. The grid is a
square cut into quarters again and again: a cell is kept only if a point lies in it, as four bits for its quarters and the place of its
first one, together with the largest impact inside. A query follows the paths of its terms' rows at once: its state is a range of
documents and, per term, the cell that holds the term's row over that range. The sum of these cells' maxima bounds the score of every
document of the range, and over one document it is the score. Ranges are expanded best first, a few hundred at a time, until all that
remain are bounded below the k-th score found.

Texts are read once for a block of items: each task keeps, per document, its length and the frequencies of the items' terms, so the grid
has the rows that are asked for and every document as a column. Corpus counts (documents, lengths, document frequencies) are sums over
that table. A task then builds the treaps of its documents, a bounded number of columns each, one after the other, and carries each
item's k best with it, so that later treaps are cut by what earlier ones gave."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewise.llm.shared import prepare, stash
from tablewise.llm.tokens import U, raw, words

COLUMNS, POINTS = 1 << 15, 4_000_000  # of one treap
ASKED = 4_000_000  # (item, term) rows of a block of items; each block is one pass over the texts
AT_ONCE = 256  # ranges that are expanded together

#: Bytes outside terms become spaces: all of ASCII but digits and letters.
_APART = np.arange(256, dtype=np.uint8)
_APART[[b for b in range(128) if not chr(b).isalnum()]] = 32
_ONES = np.array([bin(x).count("1") for x in range(16)], np.int32)
_LEAST = np.iinfo(np.int64).min


def terms_of(column) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all terms of a text column and the bounds between the texts."""
    data, bounds = raw(column)
    return words(_APART[data], bounds)


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of x moved to the even places."""
    x = x.astype(U)
    for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << U(shift))) & U(keep)
    return x


class Treap:
    """Cells level by level from the whole grid down to points: largest impact, quarters present, place of the first quarter. The last
    entry of each array stands for an empty cell."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray, side: int):
        self.height = max(0, int(side - 1).bit_length())
        code = (_spread(rows) << U(1)) | _spread(columns)
        order = np.argsort(code, kind="stable")
        code, peak = code[order], impacts[order]
        peaks, quarters, firsts = [peak], [np.zeros(len(code), np.uint8)], [np.zeros(len(code), np.int64)]
        for _ in range(self.height):
            parent = code >> U(2)
            begin = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
            quarters.append(np.bitwise_or.reduceat(np.left_shift(1, (code & U(3)).astype(np.uint8)).astype(np.uint8), begin))
            peak = np.maximum.reduceat(peak, begin)
            peaks.append(peak)
            firsts.append(begin)
            code = parent[begin]
        sizes = [len(p) for p in reversed(peaks)]  # of the levels from the top
        below = np.cumsum(sizes)
        self.peak = np.concatenate([*reversed(peaks), [0]]).astype(np.int64)
        self.quarters = np.concatenate([*reversed(quarters), [0]]).astype(np.uint8)
        self.first = np.concatenate([f + b for f, b in zip(reversed(firsts), below, strict=True)] + [[0]]).astype(np.int32)
        self.empty = len(self.peak) - 1

    def children(self, cells: np.ndarray, quarter: np.ndarray) -> np.ndarray:
        there = self.quarters[cells]
        before = _ONES[there & ((1 << quarter) - 1)]
        return np.where((there >> quarter) & 1, self.first[cells] + before, self.empty)

    def best(self, rows: np.ndarray, k: int, floor: int, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(columns, scores) of the k columns of the largest sums over rows, at least floor; equal sums by ascending tie[column]."""
        cells, begin, level = np.zeros((1, len(rows)), np.int32), np.zeros(1, np.int64), np.full(1, self.height)
        bound = self.peak[cells].sum(1)
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not self.height:
            return (begin, bound) if bound[0] >= floor else (found, scores)
        while len(bound):
            pick = np.argpartition(-bound, AT_ONCE)[:AT_ONCE] if len(bound) > AT_ONCE else np.arange(len(bound))
            stay = np.ones(len(bound), bool)
            stay[pick] = False
            down = level[pick] - 1
            quarter = ((rows >> down[:, None]) & 1) * 2
            halves = [self.children(cells[pick], quarter + half) for half in (0, 1)]
            under, sums = np.concatenate(halves), np.concatenate([self.peak[h].sum(1) for h in halves])
            at, down = np.concatenate([begin[pick], begin[pick] + (1 << down)]), np.concatenate([down, down])
            good = sums >= floor
            leaf = good & (down == 0)
            if leaf.any():
                found, scores = np.concatenate([found, at[leaf]]), np.concatenate([scores, sums[leaf]])
                order = np.lexsort((tie[found], -scores))[:k]
                found, scores = found[order], scores[order]
                if len(scores) == k:
                    floor = max(floor, int(scores[-1]))
            inner = (sums >= floor) & (down > 0)
            stay &= bound >= floor
            cells, begin = np.concatenate([cells[stay], under[inner]]), np.concatenate([begin[stay], at[inner]])
            level, bound = np.concatenate([level[stay], down[inner]]), np.concatenate([bound[stay], sums[inner]])
        return found, scores


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, cut = terms_of(batch.column("text"))
        rows = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(cut)))
        yield pa.RecordBatch.from_arrays([batch.column("item_id").take(rows), pa.array(h.view(np.int64))], ["item_id", "term"])


def _frequencies(batches: Iterator[pa.RecordBatch], asked: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per document its number of terms, and the rows and frequencies of the asked ones; asked: hashes in ascending order."""
    for batch in batches:
        h, cut = terms_of(batch.column("text"))
        n = np.diff(cut)
        row = np.minimum(np.searchsorted(asked, h), len(asked) - 1)
        hit = asked[row] == h
        point, times = np.unique(np.repeat(np.arange(len(n)), n)[hit] * len(asked) + row[hit], return_counts=True)
        ends = np.searchsorted(point, np.arange(len(n) + 1) * len(asked)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (point % len(asked), times)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), *lists], ["doc_id", "n", "rows", "times"])


class _Searcher:
    """The k best of every item over the documents given so far."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
        self.items, self.weights, self.n_docs, self.n_terms, self.k = items, weights, n_docs, n_terms, k
        self.row_of = np.empty(len(weights), np.int64)  # rows of like weight lie together, so that maxima are tight
        self.row_of[np.argsort(-weights, kind="stable")] = np.arange(len(weights))
        none = np.zeros(0, np.int64)
        self.top = [(none, none, np.zeros(0, bool)) for _ in items]  # ids, scores, id is null

    def add(self, table: pa.Table) -> None:
        ids, null = table["doc_id"].fill_null(0).to_numpy(), table["doc_id"].is_null().to_numpy()
        n, lists = table["n"].to_numpy(), table["rows"].combine_chunks()
        term, tf = lists.flatten().to_numpy(), table["times"].combine_chunks().flatten().to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy(zero_copy_only=False))
        # Documents of like length lie together, for the same reason; equal scores go by id, so each column keeps its place among the ids.
        column, tie = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
        by_length, by_id = np.lexsort((ids, null, n)), np.lexsort((ids, null))
        column[by_length] = np.arange(len(ids))
        tie[column[by_id]] = np.arange(len(ids))
        m = 50 + (50 * n * self.n_docs) // self.n_terms
        impact = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        some = impact > 0
        if not some.any():
            return
        treap = Treap(self.row_of[term[some]], column[doc[some]], impact[some], max(len(ids), len(self.weights)))
        for i, terms in enumerate(self.items):
            top_ids, top, top_null = self.top[i]
            where, scores = treap.best(self.row_of[terms], self.k, int(top[-1]) if len(top) == self.k else 1, tie)
            if len(where):
                at = by_length[where]
                top_ids, top, top_null = np.concatenate([top_ids, ids[at]]), np.concatenate([top, scores]), np.concatenate([top_null, null[at]])
                order = np.lexsort((top_ids, top_null, -top))[: self.k]
                self.top[i] = top_ids[order], top[order], top_null[order]


def _search(batches: Iterator[pa.RecordBatch], searcher) -> Iterator[pa.RecordBatch]:
    held, docs, points, s = [], 0, 0, searcher()
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            more = len(part.column("rows").flatten())
            if held and (docs + part.num_rows > COLUMNS or points + more > POINTS):
                s.add(pa.Table.from_batches(held))
                held, docs, points = [], 0, 0
            held, docs, points = [*held, part], docs + part.num_rows, points + more
    if held:
        s.add(pa.Table.from_batches(held))
    item = np.repeat(np.arange(len(s.items)), [len(t[1]) for t in s.top])
    ids, scores, null = (np.concatenate([t[j] for t in s.top]) if s.top else np.zeros(0, np.int64) for j in range(3))
    yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(scores, pa.int64())], ["item", "doc_id", "score"])


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank from 1, doc_id, score): each item's k documents of the highest score above 0, equal scores by ascending doc_id.

    docs needs doc_id (integer) and text, items need item_id (integer) and text; other columns are ignored. Terms are runs of ASCII
    letters and digits and of anything beyond ASCII, A-Z lower-cased. An item's score of a document is the sum over its distinct terms of
    floor(1000 ln((2N + 2) / (2 df + 1))) * ((10^9 tf) div (1000 tf + 20 m)) with m = 50 + (50 n N) div L, where N counts documents with
    a term and L their terms. Every row is a document, also repeated ones; a null doc_id comes last among equal scores. Rows that share
    an item_id are one item with the terms of all. Null or empty texts, and texts without a term, are in no result and not in N. Empty
    tables give an empty result. Terms are told apart by 64-bit hashes. Items go in blocks of ASKED (item, term) rows, and every block
    costs one pass over the texts; a benchmark of 200 questions is a fiftieth of a block."""
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    asked = stash(items.mapInArrow(_item_terms, "item_id long, term long").distinct(), "asked-terms")
    blocks = max(1, -(-asked.count() // ASKED))
    found = [_search_block(spark, docs, asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), k) for b in range(blocks)]
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _search_block(spark, docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    pairs = asked.toArrow()  # at most about ASKED rows of two numbers
    term = pairs["term"].to_numpy().view(U)
    vocabulary = np.unique(term)
    names = pairs["item_id"].combine_chunks()
    none, ids = names.is_null().to_numpy(zero_copy_only=False), names.fill_null(0).to_numpy()
    order = np.lexsort((ids, none))
    ids, none, rows = ids[order], none[order], np.searchsorted(vocabulary, term[order])
    begin = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (none[1:] != none[:-1])])) if len(ids) else np.zeros(0, np.int64)
    empty = spark.createDataFrame([], "item_id long, doc_id long, score long")
    if not len(begin):
        return empty
    held = spark.sparkContext.broadcast(vocabulary)
    grid = stash(docs.mapInArrow(lambda it: _frequencies(it, held.value), "doc_id long, n long, rows array<int>, times array<int>"), "frequencies")
    n_docs, n_terms = grid.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_terms:
        return empty
    df = grid.select(F.explode("rows").alias("row")).groupBy("row").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(F.log((F.lit(2.0) * n_docs + 2) / (2 * F.col("df") + 1)) * 1000).cast("long")
    weighed = df.select("row", weight.alias("w")).toArrow()  # at most one row for each asked term
    weights = np.zeros(len(vocabulary), np.int64)
    weights[weighed["row"].to_numpy()] = weighed["w"].to_numpy()
    work = spark.sparkContext.broadcast((np.split(rows, begin[1:]), weights))
    found = grid.where(F.size("rows") > 0).mapInArrow(lambda it: _search(it, lambda: _Searcher(*work.value, n_docs, n_terms, k)), "item long, doc_id long, score long")
    key = spark.createDataFrame(pa.table({"item": np.arange(len(begin)), "item_id": pa.array(ids[begin], pa.int64(), mask=none[begin])}))
    return found.join(F.broadcast(key), "item").select("item_id", "doc_id", "score")  # key: one row for each item of the block
