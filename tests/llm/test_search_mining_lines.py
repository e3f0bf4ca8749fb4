"""Hard negatives, line frequency and ranked search on small rows: brute force, ties, nulls, empties, repeats and clashing columns."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewise.llm import hardneg, linefreq, treap
from tablewise.llm.hardneg import mine_hard_negatives, primes, residue_products
from tablewise.llm.linefreq import rate_lines
from tablewise.llm.treap import Treap, rank_documents

VECTORS = "vec_id long, label int, v array<bigint>"


@pytest.mark.parametrize("size", [1, 100, 1 << 20, 1 << 28])
def test_residue_products_are_exact(size):
    rng = np.random.default_rng(size)
    a, b = rng.integers(-size, size + 1, (7, 30)), rng.integers(-size, size + 1, (11, 30))
    bound = 30 * size * size
    assert math.prod(primes(bound)) > 2 * bound and len(set(primes(bound))) == len(primes(bound))
    want = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
    assert residue_products(a, b, bound).tolist() == want


def test_residue_products_of_long_vectors():
    a = np.full((2, 5000), -125)
    assert residue_products(a, a, 5000 * 125 * 125).tolist() == [[5000 * 125 * 125] * 2] * 2
    assert residue_products(np.zeros((2, 0), np.int64), np.zeros((3, 0), np.int64), 1).tolist() == [[0] * 3] * 2


def brute_negatives(rows, anchors):
    fine = lambda rows: [r for r in rows if None not in r and None not in r[2]]
    chosen = {}
    for i, label, v in fine(anchors):
        chosen[i] = min(chosen.get(i, (v, label)), (v, label))
    out = []
    for a, (v, label) in chosen.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, n) for i, n, w in fine(rows) if i != a and len(w) == len(v))
        for s, i, _ in [x for x in scored if x[2] == label][:5]:
            inside = [x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s]
            out += [(a, i, r, x[1], -s, -x[0]) for r, x in enumerate(inside[:5], 1)]
    return sorted(out)


@pytest.mark.parametrize("chunk", [16 << 20, 200])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(hardneg, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(hardneg, "TASK_ROWS", 40)
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 3)), rng.integers(-3, 4, 4).tolist()) for i in range(150)]
    rows += [rows[3], rows[10], (10, 2, [9, 9, 9, 9]), (500, 1, None), (501, None, [1, 1, 1, 1]), (None, 1, [1, 1, 1, 1]), (502, 1, [1, None, 1, 1]), (503, 1, []), (504, 1, [5, 5])]
    df = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit("mine")).withColumn("dim", F.lit(0))
    asked = df.where("vec_id % 10 = 0")
    got = sorted(tuple(r) for r in mine_hard_negatives(df, asked).collect())
    assert got == brute_negatives(rows, [r for r in rows if r[0] is not None and r[0] % 10 == 0]) and len(got) > 100


def test_hard_negatives_of_nothing_and_of_huge_vectors(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert mine_hard_negatives(empty, empty).count() == 0
    one = spark.createDataFrame([(1, 1, [1])], VECTORS)
    assert mine_hard_negatives(one, one).count() == 0 and mine_hard_negatives(one, empty).count() == 0
    huge = spark.createDataFrame([(1, 1, [1 << 40]), (2, 1, [1 << 40])], VECTORS)
    with pytest.raises(ValueError):
        mine_hard_negatives(huge, huge)
    large = spark.createDataFrame([(1, 1, [1 << 29]), (2, 1, [-(1 << 29)]), (3, 1, [1 << 29]), (4, 2, [(1 << 29) - 1])], VECTORS)
    assert [tuple(r) for r in mine_hard_negatives(large, large.where("vec_id = 1")).collect()] == [(1, 3, 1, 4, 1 << 58, (1 << 58) - (1 << 29))]


def test_treap_sums_equal_a_dense_grid():
    rng = np.random.default_rng(8)
    grid = rng.integers(0, 6, (20, 130)) * (rng.random((20, 130)) < 0.3)
    r, c = np.nonzero(grid)
    t = Treap(r, c, grid[r, c], 130)
    tie = rng.permutation(130)
    for rows in (np.array([0]), np.array([3, 7, 11]), np.arange(20)):
        sums = grid[rows].sum(0)
        for k in (1, 10, 500):
            want = sorted((i for i in range(130) if sums[i] > 0), key=lambda i: (-sums[i], tie[i]))[:k]
            columns, scores = t.best(rows, k, 1, tie)
            assert columns.tolist() == want and scores.tolist() == sums[want].tolist()


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute_ranks(docs, items, k):
    bags = [(d, Counter(TERM.findall(lower(t or "")))) for d, t in docs]
    n_docs, length, df = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags), Counter(t for _, b in bags for t in b)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(TERM.findall(lower(t or "")))
    out = []
    for i, terms in asked.items():
        scored = []
        for d, b in bags:
            m = 50 + (50 * sum(b.values()) * n_docs) // max(length, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 20 * m)) for t in terms if b[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return out


def ranks(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


@pytest.mark.parametrize("asked", [4_000_000, 5])
def test_ranked_search_equals_brute_force(spark, monkeypatch, asked):
    monkeypatch.setattr(treap, "ASKED", asked)
    rng = np.random.default_rng(2)
    vocabulary = ["Alpha", "béta", "g4mma", "ДЕЛЬТА", "eps", "zeta", "eta", "theta", "x", "日本"]
    docs = [(int(i), "".join(str(rng.choice(vocabulary)) + str(rng.choice([" ", "-", "\n", "_", "."])) for _ in range(int(rng.integers(0, 30))))) for i in range(120)]
    docs += [docs[5], docs[5], (None, "alpha zeta"), (None, None), (300, None), (301, ""), (302, "-- !"), (7, "eta " * 50000), (303, "ALPHA")]
    items = [(1, "alpha x"), (2, "Alpha ALPHA alpha"), (3, "béta; дельта eps"), (4, None), (5, ""), (6, "unknown"), (None, "zeta"), (1, "eta"), (8, " ".join(vocabulary))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("n", F.lit(1)).withColumn("item_id", F.lit(3))
    asks = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    for k in (3, 50):
        assert ranks(rank_documents(frame, asks, k)) == sorted(brute_ranks(docs, items, k), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_ranked_search_of_empty_tables(spark):
    empty_docs, empty_items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    docs, items = spark.createDataFrame([(1, None)], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert all(rank_documents(d, i).count() == 0 for d in (empty_docs, docs) for i in (empty_items, items))


def test_searcher_keeps_the_best_over_several_treaps():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    n, grid = rng.integers(1, 20, 300), rng.integers(0, 4, (6, 300))
    n = np.maximum(n, grid.sum(0))
    ids = rng.permutation(300)
    items = [np.array([0, 2]), np.arange(6), np.array([5])]
    s = treap._Searcher(items, np.array([900, 20, 3, 700, 0, 50]), 300, int(n.sum()), 7)
    parts = []
    for at in range(0, 300, 64):
        sub = grid[:, at: at + 64]
        lists = [(np.flatnonzero(sub[:, j]).tolist(), sub[:, j][sub[:, j] > 0].tolist()) for j in range(sub.shape[1])]
        parts.append(pa.table({"doc_id": ids[at: at + 64], "n": n[at: at + 64], "rows": pa.array([x[0] for x in lists], pa.list_(pa.int32())), "times": pa.array([x[1] for x in lists], pa.list_(pa.int32()))}))
    for p in parts:
        s.add(p)
    m = 50 + 50 * n * 300 // int(n.sum())
    impact = np.array([900, 20, 3, 700, 0, 50])[:, None] * (10**9 * grid // np.maximum(1000 * grid + 20 * m, 1))
    for terms, (got, scores, _) in zip(items, s.top, strict=True):
        total = impact[terms].sum(0)
        want = sorted((j for j in range(300) if total[j] > 0), key=lambda j: (-total[j], ids[j]))[:7]
        assert got.tolist() == ids[want].tolist() and scores.tolist() == total[want].tolist()


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_lines(docs, max_docs, max_share, least_left):
    plain = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ").lower()
    held, hosts = defaultdict(set), defaultdict(set)
    for _, h, t in docs:
        hosts[h].add(t or "")
        for x in (t or "").split("\n"):
            if WORDS.search(x):
                held[h, plain(x)].add(t)
    gone = {k for k, v in held.items() if len(v) > max_docs and len(v) > max_share * len(hosts[k[0]])}
    out = []
    for d, h, t in docs:
        w = WORDS.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        places = {j for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
        failed = len(w) < 50 or 100 * len(places) > 50 * len(w)
        dropped = [x for x in lines if (h, plain(x)) in gone]
        left = len(w) - sum(len(WORDS.findall(x)) for x in dropped)
        text = t if not dropped else "\n".join(x for x in t.split("\n") if not (WORDS.search(x) and (h, plain(x)) in gone))
        out.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(places), failed, len(dropped), left, not failed and left >= least_left * len(w), text))
    return out


@pytest.fixture(scope="module")
def paged(spark):
    rng = np.random.default_rng(4)
    body = lambda n: " ".join("".join(rng.choice(list("abcdeé"), 4)) for _ in range(n))
    docs = [(i, ["a.org", "b.org", None][i % 3], f"Home  |  News\n{body(60)}\n{body(20)}\nHOME | news \n© 2020 #1") for i in range(40)]
    docs += [(100 + i, "a.org", "Home | News\n" + "buy one get one free now " * 12 + f"\n{i}") for i in range(9)]
    docs += [(200 + i, "c.org", "only copies\n" + "w1 w2 w3 w4 " * 20) for i in range(30)]
    docs += [(300, "a.org", None), (301, None, ""), (302, "", " \n\t\n"), (None, "a.org", "Home | News"), (303, "", "x"), docs[0], docs[1], (304, "a.org", "x " * 30000), (305, "a.org", "\n" * 500)]
    docs += [(306, "b.org", "p q r " + " ".join(f"t{i}" for i in range(60)) + " p q r s"), (307, "b.org", "𝒳𝒴 𝒵 " * 3)]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("h", F.lit("mine")).withColumn("_row", F.lit(-1)).withColumn("kept", F.lit("mine"))
    return docs, frame


@pytest.mark.parametrize("bound", [500_000, 1])
def test_line_frequency_equals_brute_force(paged, monkeypatch, bound):
    docs, frame = paged
    monkeypatch.setattr(linefreq, "BROADCAST_ROWS", bound)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_common_lines", "words_left", "kept", "text"]
    for max_docs, share in ((5, 0.001), (5, 0.9), (0, 0.0)):
        out = rate_lines(frame, max_docs=max_docs, max_share=share)
        assert set(out.columns) == {*frame.columns, *linefreq.MADE} and {r.h for r in out.select("h", "_row").collect()} == {"mine"}
        key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
        assert sorted([tuple(r) for r in out.select(names).collect()], key=key) == sorted(brute_lines(docs, max_docs, share, 0.5), key=key)


def test_line_frequency_keeps_hosts_apart_and_copies_whole(paged, spark):
    docs, frame = paged
    kept = {r.doc_id: r.n_common_lines for r in rate_lines(frame, max_docs=5, texts=False).collect()}
    assert kept[0] == 3 and kept[100] == 2 and kept[200] == 0 and kept[303] == 0
    assert rate_lines(frame.limit(0)).count() == 0
