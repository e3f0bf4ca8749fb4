"""MinHash near-duplicates with tensored banding.

A table key needs 2 * HALF minhashes. Instead of m * m independent keys, ``m`` left and ``m`` right collections of HALF minhashes are
drawn and every (left i, right j) pair forms the key of table (i, j): m * m tables from 2 * m * HALF minhashes. A pair of sets with
similarity s meets in some table with probability (1 - (1 - s^HALF)^m)^2; with HALF = 2 and m = 10 a pair at 0.8 is missed with
probability below 1e-4, one at 0.9 below 1e-7.

Candidates of a bucket are verified in two steps, so that no group is expanded into pairs: first every member against the smallest one;
then the members of buckets that still span several components are put into blocks of bounded size, and blocks that meet in a bucket
are compared set by set inside one task, which hands on one link for any two components. Every pair that shares a table key has then
been compared or lies in one component, so components are exact for the candidates found."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.components import components
from tablewise.llm.shared import bounded_broadcast, prepare, stash
from tablewise.llm.tokens import U, mix, shingle_sets

HALF, SIDES = 2, 10
N_HASH = 2 * HALF * SIDES
BLOCK_ROWS, BLOCK_SHINGLES = 512, 400_000  # of the blocks that are compared with each other
COLUMNS = 16_384  # shingles of one matrix product


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    a = mix(np.arange(1, n + 1, dtype=U) * U(0xD1342543DE82EF95)) | U(1)
    return a, mix(a)


def _signatures(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    mul, add = _functions(N_HASH)
    for batch in batches:
        values, cut = shingle_sets(batch.column("text"), width)
        n = np.diff(cut)
        full = np.flatnonzero(n)
        sig = np.zeros((len(n), N_HASH), np.uint32)
        prints = np.zeros((2, len(n)), U)
        if len(full):
            starts = cut[:-1][full]
            for i in range(N_HASH):
                sig[full, i] = np.minimum.reduceat((values * mul[i] + add[i]) >> U(32), starts)
            for k, seed in enumerate((0x51ED270B, 0xABCD1234)):
                prints[k, full] = np.add.reduceat(mix(values + U(seed)), starts)
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array(n), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)),
            pa.array([x.tobytes() for x in sig], pa.binary())], ["doc_id", "n", "p", "q", "sig"])


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, N_HASH)


def _table_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = mix(np.arange(SIDES * SIDES, dtype=U) + U(77)).reshape(1, SIDES, SIDES)
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            if not part.num_rows:
                continue
            s = _matrix(part.column("sig")).astype(U).reshape(-1, 2, SIDES, HALF)
            side = mix((s * (np.arange(HALF, dtype=U) * U(2) + U(0x5851F42D4C957F2D))).sum(-1, dtype=U))
            keys = mix(side[:, 0, :, None] * U(3) + side[:, 1, None, :] * U(5) + table).reshape(len(s), -1)
            nodes = np.repeat(part.column("rep").to_numpy(zero_copy_only=False), SIDES * SIDES)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(nodes)], ["key", "node"])


def _likely(n_a, n_b, sig_a, sig_b, percent: int) -> np.ndarray:
    """Whether sizes allow a link and enough minhashes agree: an estimate 0.3 below the threshold (five standard deviations) is refused."""
    sized = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return sized & ((sig_a == sig_b).sum(-1) >= (percent - 30) * N_HASH // 100)


def _compare_signatures(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("a", "b", "n_a", "n_b")}
        ok = _likely(c["n_a"], c["n_b"], _matrix(batch.column("sig_a")), _matrix(batch.column("sig_b")), percent)
        yield pa.RecordBatch.from_arrays([pa.array(c["a"][ok]), pa.array(c["b"][ok])], ["a", "b"])


def _compare_sets(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        one, cut1 = shingle_sets(batch.column("text_a"), width)
        two, cut2 = shingle_sets(batch.column("text_b"), width)
        ok = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            x, y = one[cut1[i]: cut1[i + 1]], two[cut2[i]: cut2[i + 1]]
            common = len(np.intersect1d(x, y, assume_unique=True))
            ok[i] = common > 0 and 100 * common >= percent * (len(x) + len(y) - common)
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(ok)) for k in ("a", "b")], ["a", "b"])


def _common(cut_a, ids_a, cut_b, ids_b, size: int) -> np.ndarray:
    """Sizes of all intersections between two lists of sets of numbers below size, by blocks of columns."""
    out = np.zeros((len(cut_a) - 1, len(cut_b) - 1))
    for begin in range(0, size, COLUMNS):
        dense = []
        for cut, ids in ((cut_a, ids_a), (cut_b, ids_b)):
            m = np.zeros((len(cut) - 1, min(COLUMNS, size - begin)), np.float32)
            here = (ids >= begin) & (ids < begin + COLUMNS)
            m[np.repeat(np.arange(len(cut) - 1), np.diff(cut))[here], ids[here] - begin] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def _unit_links(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows of comparison units, unit by unit: one link, if there is any, for each two components between its two blocks. A unit holds two
    blocks of bounded size, so it fits in memory."""
    left: pa.Table | None = None

    def links(t: pa.Table) -> pa.RecordBatch:
        values, cut = shingle_sets(t.column("text"), width)
        node, component, block = (t.column(k).to_numpy() for k in ("node", "component", "block"))
        one, two = (np.flatnonzero(block == t.column(k)[0].as_py()) for k in ("ba", "bb"))
        distinct, ids = np.unique(values, return_inverse=True)
        shared = np.bincount(ids, minlength=len(distinct)) > 1  # a shingle of one set is in no intersection
        short = np.cumsum(shared) - 1
        n = np.diff(cut)

        def side(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            parts = [short[x[shared[x]]] for x in (ids[cut[r]: cut[r + 1]] for r in rows)]
            return np.concatenate([[0], np.cumsum([len(x) for x in parts])]), np.concatenate(parts) if parts else np.zeros(0, np.int64)

        common = _common(*side(one), *side(two), int(shared.sum()))
        linked = (common > 0) & (100 * common >= percent * (n[one][:, None] + n[two] - common)) & (component[one][:, None] != component[two])
        i, j = np.nonzero(linked)
        pairs = np.sort(np.stack([component[one][i], component[two][j]], 1), 1)
        _, first = np.unique(pairs, axis=0, return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(node[one][i[first]]), pa.array(node[two][j[first]])], ["a", "b"])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        left = t if left is None else pa.concat_tables([left, t]).combine_chunks()
        ba, bb = left.column("ba").to_numpy(), left.column("bb").to_numpy()
        begins = np.flatnonzero(np.concatenate([[True], (ba[1:] != ba[:-1]) | (bb[1:] != bb[:-1])])) if len(left) else []
        for s, e in zip(begins[:-1], begins[1:], strict=True):
            yield links(left.slice(s, e - s))
        if len(begins):
            left = left.slice(begins[-1])
    if left is not None and len(left):
        yield links(left)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id = component_id).

    docs needs doc_id (integer) and text; other columns are ignored. Texts of equal shingle sets are one class before anything is
    compared, so exact copies cost one row each however many there are. Null and empty texts, and texts without words, have an empty
    set and no links. Rows that repeat a doc_id count as one document with the links of all its rows. A null doc_id takes no part:
    its component_id is null and kept is true. An empty table gives an empty result."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stash(docs.mapInArrow(lambda it: _signatures(it, width), "doc_id long, n long, p long, q long, sig binary"), "signatures")
    reps = stash(rows.where("n > 0 and doc_id is not null").groupBy("n", "p", "q").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "classes")
    # A set of s shingles is linked with a different one only if s / (s + 1) reaches the threshold.
    keys = reps.where(F.lit(100) * F.col("n") >= F.lit(percent) * (F.col("n") + 1)).select("rep", "sig").mapInArrow(_table_keys, "key long, node long")
    buckets = stash(keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo != hi"), "buckets")
    large = buckets.where("size > 2")
    members = stash(keys.join(bounded_broadcast(large), "key").select("key", "node", "lo", "size"), "members")
    signed = reps.select(F.col("rep"), "n", "sig")

    def verified(pairs: DataFrame) -> DataFrame:
        one, two = (signed.select(F.col("rep").alias(k), F.col("n").alias(f"n_{k}"), F.col("sig").alias(f"sig_{k}")) for k in "ab")
        likely = stash(pairs.join(one, "a").join(two, "b").mapInArrow(lambda it: _compare_signatures(it, percent), "a long, b long").distinct(), "likely")
        wanted = likely.select(F.col("a").alias("doc_id")).union(likely.select(F.col("b").alias("doc_id"))).distinct()
        texts = docs.join(bounded_broadcast(wanted), "doc_id", "left_semi")
        both = likely.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(
            texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        return stash(both.mapInArrow(lambda it: _compare_sets(it, width, percent), "a long, b long").distinct(), "verified")

    star = buckets.where("size = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).union(
        members.where("node != lo").select(F.col("lo").alias("a"), F.col("node").alias("b"))).distinct()
    links = verified(star)
    found = components(links, "a", "b")
    placed = members.join(found, "node", "left").select("key", "node", "lo", F.coalesce("component", "node").alias("component"))
    open_ = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("key")
    placed = stash(placed.join(open_, "key"), "open")
    # A node's home is the smallest node it shares an open bucket with; homes are cut into blocks of bounded rows and shingles.
    # Two hops more, and a dense group has one home.
    home = placed.groupBy("node").agg(F.min("lo").alias("home"))
    for _ in range(2):
        nearest = placed.select("key", "node").join(home, "node").groupBy("key").agg(F.min("home").alias("home"))
        home = placed.select("key", "node").join(nearest, "key").groupBy("node").agg(F.min("home").alias("home"))
    nodes = placed.groupBy("node").agg(F.first("component").alias("component")).join(home, "node").join(reps.select(F.col("rep").alias("node"), "n"), "node")
    homes = nodes.groupBy("home").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    block = F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("parts")))
    nodes = stash(nodes.join(homes, "home").withColumn("block", block), "blocks")
    blocks = nodes.groupBy("home", "block").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    touching = placed.join(nodes.select("node", "home"), "node").select("key", "home").distinct()
    met = touching.withColumnRenamed("home", "ha").join(touching.withColumnRenamed("home", "hb"), "key").where("ha <= hb").select("ha", "hb").distinct()
    side = lambda k: blocks.select(F.col("home").alias(f"h{k}"), F.col("block").alias(f"b{k}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    units = met.join(side("a"), "ha").join(side("b"), "hb").where("(ha != hb or ba <= bb) and not (xa = ya and xb = yb and xa = xb)").select("ba", "bb").distinct()
    rows_of = units.withColumn("block", F.explode(F.array_distinct(F.array("ba", "bb")))).join(nodes.select("block", "node", "component"), "block")
    asked = nodes.select(F.col("node").alias("doc_id")).distinct()
    texts = docs.join(bounded_broadcast(asked), "doc_id", "left_semi").withColumnRenamed("doc_id", "node")
    filled = rows_of.join(texts, "node").repartition("ba", "bb").sortWithinPartitions("ba", "bb").select("ba", "bb", "block", "node", "component", "text")
    links = links.union(stash(filled.mapInArrow(lambda it: _unit_links(it, width, percent), "a long, b long").distinct(), "more-links"))
    # Rows that share a doc_id are one document: its classes hang together.
    named = rows.where("n > 0 and doc_id is not null").join(reps.select("n", "p", "q", "rep"), ["n", "p", "q"])
    links = links.union(named.where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    final = components(links, "a", "b").withColumnRenamed("node", "doc_id")
    out = rows.join(final, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (component.isNull() | (component == F.col("doc_id"))).alias("kept"))
