"""Hard negatives by exact integer products in residue number systems.

Vectors of integers are taken modulo several small primes. Residues, centred around zero, are small enough that a float32 matrix product
over INNER components is exact, so each prime costs one fast product; the residues of a score meet again by Chinese remaindering in
mixed radix digits. As many primes are taken as the largest possible score asks for, so the signed scores are exact.

Anchors are a stated set. They go in chunks of bounded bytes; for each chunk all rows are swept twice in blocks, nothing but each block's
few best leaves a task. The first sweep finds the nearest rows of the anchor's label, the second the first rows of other labels in the
score window that each of these positives opens."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewise.llm.shared import prepare, shared_folder, stash

BLOCK, TILE = 4096, 256  # rows of a block, anchors that are scored together
CHUNK_BYTES = 16 << 20  # of the anchors that a sweep carries
TASK_ROWS = 16_384
INNER = 1024  # components of one product: INNER * 125 ** 2 < 2 ** 24
LIMIT = 1 << 62


def primes(bound: int) -> list[int]:
    """Primes below 256 from the largest down, until their product exceeds 2 * bound."""
    out, product = [], 1
    for p in range(255, 2, -1):
        if product > 2 * bound:
            break
        if all(p % q for q in range(2, 16)):
            out.append(p)
            product *= p
    return out


def _residues(v: np.ndarray, p: int) -> np.ndarray:
    r = np.mod(v, p)
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def residue_products(a: np.ndarray, b: np.ndarray, bound: int) -> np.ndarray:
    """a @ b.T of integer matrices, exact for scores of at most bound in magnitude (below LIMIT)."""
    chosen = primes(bound)
    digits: list[np.ndarray] = []
    for i, p in enumerate(chosen):
        r = np.full((len(a), len(b)), bound % p, np.int32)  # scores are shifted by bound, so that they are not negative
        for at in range(0, a.shape[1], INNER):
            r = (r + (_residues(a[:, at: at + INNER], p) @ _residues(b[:, at: at + INNER], p).T).astype(np.int32)) % p
        for q, digit in zip(chosen[:i], digits, strict=True):  # the mixed radix digit for p
            r = (r - digit) * pow(q, -1, p) % p
        digits.append(r)
    out = np.zeros((len(a), len(b)), np.int64)
    for p, digit in zip(reversed(chosen), reversed(digits), strict=True):
        out = out * p + digit
    return out - bound


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))


class _Sweep:
    """One chunk's anchors of one length: their ids, labels and vectors, and in the second sweep the scores of their positives."""

    def __init__(self, anchors: pa.Table):
        self.ids, self.labels, self.vectors = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy(), _matrix(anchors["v"])
        self.positives = anchors["positives"].to_pylist() if "positives" in anchors.column_names else None

    def over(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, bound: int, k: int, low: tuple[int, int]) -> Iterator[tuple]:
        for at in range(0, len(self.ids), TILE):
            scores = residue_products(self.vectors[at: at + TILE], vectors, bound)
            for i, s in enumerate(scores, at):
                if self.positives is None:
                    at_rows = np.flatnonzero((labels == self.labels[i]) & (ids != self.ids[i]))
                    best = at_rows[_first(s[at_rows], ids[at_rows], k)]
                    yield self.ids[i], 0, ids[best], s[best]
                    continue
                other = np.flatnonzero(labels != self.labels[i])
                theirs = s[other]
                for positive in set(self.positives[i]):
                    floor = -(-low[0] * positive // low[1])
                    inside = other[(theirs >= floor) & (theirs <= positive)]
                    best = inside[_first(s[inside], ids[inside], k)]
                    yield self.ids[i], positive, ids[best], s[best]


def _swept(batches: Iterator[pa.RecordBatch], chunk: Callable[[], list[pa.Table]], bound: int, k: int, low: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    sweeps = {x.vectors.shape[1]: x for x in map(_Sweep, chunk())}

    def run(block: pa.Table) -> Iterator[pa.RecordBatch]:
        dims = block["dim"].to_numpy()
        for dim in np.unique(dims):
            if dim in sweeps:
                part = block.filter(pa.array(dims == dim))
                for a, p, ids, scores in sweeps[dim].over(part["vec_id"].to_numpy(), part["label"].to_numpy(), _matrix(part["v"]), bound, k, low):
                    out.append((np.full(len(ids), a), np.full(len(ids), p), ids, scores))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], ["anchor_id", "positive_score", "vec_id", "score"])
            out.clear()

    held, rows, out = [], 0, []
    for batch in batches:
        held, rows = [*held, batch], rows + batch.num_rows
        if rows >= BLOCK:
            yield from run(pa.Table.from_batches(held))
            held, rows = [], 0
    if rows:
        yield from run(pa.Table.from_batches(held))


def mine_hard_negatives(items: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: tuple[int, int] = (4, 5)) -> DataFrame:
    """(anchor_id, positive_id, rank from 1, negative_id, positive_score, negative_score), scores being integer inner products.

    An anchor's positives are its first rows of the same label other than its own; of each the negatives are the first rows of other
    labels whose score lies between low (a fraction) of the positive's and the positive's. Higher scores come first, ties by smaller
    vec_id. items and anchors hold vec_id, label and v (array of long); other columns are ignored. Rows with a null in vec_id, label, v
    or a component take no part. Rows of an anchor's vec_id are its own; other repeated rows count each. Of several anchors of one
    vec_id the smallest (vector, then label) stands. Only vectors of the anchor's length are compared; an empty vector scores 0. Empty
    tables give an empty result. Components so large that a score might reach 2^62 are an error."""
    spark = prepare(items.sparkSession)

    def valid(df: DataFrame) -> DataFrame:
        df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<bigint>").alias("v"))
        return df.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())).withColumn("dim", F.size("v"))

    n = items.count()
    rows = stash(valid(items).repartition(max(1, -(-n // TASK_ROWS))), "vectors")
    chosen = valid(anchors).groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("a")).select("vec_id", "a.label", "a.v", F.size("a.v").alias("dim"))
    chosen = stash(chosen, "anchors")
    size = lambda df: df.agg(F.count(F.lit(1)), F.max("dim"), F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()
    (n_rows, _, most), (n_anchors, dim, most_a) = size(rows), size(chosen)
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n_rows or not n_anchors:
        return spark.createDataFrame([], out)
    bound = max(1, (dim or 0) * (most or 0) * (most_a or 0))
    if bound >= LIMIT or min(most or 0, most_a or 0) < 0:
        raise ValueError(f"scores of vectors with components up to {most} and {most_a} may pass 2^62")
    chunks = max(1, -(-n_anchors * max(1, dim) * 8 // CHUNK_BYTES))
    folder = f"{shared_folder(spark)}/negatives-{uuid.uuid4().hex}"
    first = lambda by, k: Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")

    def sweep(asked: DataFrame, k: int, by: list[str]) -> DataFrame:
        """The first k rows by score for each of the keys in by, one sweep over all rows."""
        held = spark.sparkContext.broadcast([asked.where(F.col("dim") == d).drop("dim").toArrow() for (d,) in sorted(asked.select("dim").distinct().collect())])
        found = rows.select("vec_id", "label", "v", "dim").mapInArrow(lambda it: _swept(it, lambda: held.value, bound, k, low), "anchor_id long, positive_score long, vec_id long, score long")
        return found.withColumn("rank", F.row_number().over(first(by, k))).where(F.col("rank") <= k)

    for c in range(chunks):
        asked = chosen.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c)
        near = stash(sweep(asked, positives, ["anchor_id"]).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        opened = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set("positive_score").alias("positives"))
        far = sweep(asked.join(opened, "vec_id"), negatives, ["anchor_id", "positive_score"])
        part = near.join(far, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        part.write.option("compression", "zstd").parquet(f"{folder}/chunk={c}")
    return spark.read.schema(out).parquet(*[f"{folder}/chunk={c}" for c in range(chunks)])
