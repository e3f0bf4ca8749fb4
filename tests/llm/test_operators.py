"""The training-data operators on small rows: brute force, planted cases, and nulls, empties, ties, repeats and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewise.llm import contextmix, decontaminate, mixing, neardup
from tablewise.llm.components import components
from tablewise.llm.contextmix import score_texts
from tablewise.llm.decontaminate import find_leaks
from tablewise.llm.mixing import mix_sources
from tablewise.llm.neardup import near_duplicates
from tablewise.llm.pii import _RULES, added_spans, disguised, find_pii, plain_spans, redacted, span_text
from tablewise.llm.preferences import format_branches, format_preferences, neighbour_pairs, plain_text
from tablewise.llm.quality import fit_labellers, score_quality
from tablewise.llm.shared import word_count
from tablewise.llm.topk import quantised, top_k
from tablewise.llm.toxicity import score_toxicity
from tablewise.llm.urlfilter import judge_urls

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "a b c d e f"), (5, "x " * 20000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("keep", F.lit("mine")).withColumn("size", F.lit(9)).withColumn("leaks", F.lit(1)).withColumn("n", F.lit(0))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))


def brute_components(sets, percent):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            if a < b:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: find(i) for i in sets}


def test_components_follow_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(10, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    got = dict(components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect())
    assert got == {i: 10 for i in range(10, 41)} | {100 + i: 100 for i in range(50)}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates_equal_brute_force(spark, documents, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    base = prose(rng, 60).split()
    near = [(1000 + k, " ".join(w if rng.random() > 0.04 else "zz" + w for w in base)) for k in range(25)]
    rows = [(r.doc_id, r.text) for r in documents.collect()] + near + [(2000, "only two"), (2001, "Only  TWO"), (2002, "word"), (2003, None), (2004, " ")]
    words = {i: (t or "").encode().lower().split() for i, t in rows}
    sets = {i: set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} if w else set() for i, w in words.items()}
    want = brute_components(sets, 80)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_near_duplicates_odd_rows(spark, odd):
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(odd).collect() if r.doc_id)
    assert got == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True), (5, 1, 5, True)]
    assert near_duplicates(odd.limit(0)).count() == 0


def test_leaks_exact_edited_partial_and_clean(spark):
    rng = np.random.default_rng(1)
    items = [prose(rng, 40), prose(rng, 30), "tiny"]
    words = items[0].split()
    edited = " ".join(w[:-1] + "Q" if k % 12 == 5 else w for k, w in enumerate(words))
    part = " ".join(words[10:25])
    docs = [(1, prose(rng, 200) + " " + items[0].upper().replace(" ", ", ") + " " + prose(rng, 50)), (2, prose(rng, 300)), (3, "é " * 40 + edited), (4, part + prose(rng, 20)), (5, None), (6, ""), (7, "tiny")]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(9, None)], "item_id long, text string")
    got = {r.doc_id: r for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert {i: [x.item_id for x in r.leaks] for i, r in got.items()} == {1: [0], 2: [], 3: [0], 4: [0], 5: [], 6: [], 7: []}
    leak = got[1].leaks[0]
    assert got[1].text[leak.start:leak.end].strip(", ") == items[0].upper().replace(" ", ", ")
    assert got[3].text[got[3].leaks[0].start:].strip().startswith(words[0])


def test_leaks_odd_rows(spark, odd):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r.leaks for r in find_leaks(odd, bench).collect()] == [[]] * len(ODD)


def test_quality_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("told"))
    got = score_quality(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id").select("told", "keep").collect()
    right = Counter((r.told, r.keep) for r in got)
    assert right[1, False] <= 0.02 * right[1, True] and right[0, True] <= 0.05 * right[0, False]


def test_labellers_and_odd_rows(spark, odd):
    patterns = np.array([[0, 1, 2], [0, 0, 1], [2, 2, 2], [1, 1, 2]])
    post = fit_labellers(patterns, np.array([5.0, 5, 50, 30]))
    assert post[1] < 0.5 < post[2] and len(fit_labellers(np.zeros((0, 3)), np.zeros(0))) == 0
    got = score_quality(odd).collect()
    assert len(got) == len(ODD) and all(r.keep is False for r in got if r.doc_id in (1, 2, 3)) and score_quality(odd.limit(0)).count() == 0


def test_context_mixing_contract_and_generalisation(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    texts = {r.doc_id: r.text for r in docs.collect()}
    count = Counter()
    for i, t in texts.items():
        if not held(i):
            count.update([*t.encode().lower().split(), b""])
    n, v = sum(count.values()), len(count)
    got = score_texts(docs, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2).collect()
    assert len(got) == len(texts)
    for r in got:
        tokens = [*texts[r.doc_id].encode().lower().split(), b""]
        base = sum(math.log10((count[w] + 1) / (n + 1 * (v + 1))) for w in tokens)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(tokens), sum(count[w] > 0 for w in tokens), n)
        assert math.isclose(base, r.base_score, rel_tol=1e-9)
    unseen = [r for r in got if r.held_out]
    bits = -sum(r.score for r in unseen) / math.log10(2) / sum(len(texts[r.doc_id].encode()) for r in unseen)
    assert bits < 2.6  # bits per byte on texts that nothing was learned from


def test_context_mixing_odd_rows(spark, odd):
    got = score_texts(odd, F.lit(None).cast("boolean")).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 1, 2, 2, 7, 20001] and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert score_texts(odd.limit(0), F.lit(False)).count() == 0


ODD_TEXTS = ["The  cat\tsat", "", "a b c d e f g", " x", None, "Über alles!\n", "nospaceatall", "ab", "the cat sat on the cat " * 3]


def plain_windows(text):
    """Each symbol of a text and the six before it, one by one."""
    line = bytes(6) + b"".join(w + b" " for w in (text or "").encode().lower().split()) + b"\n"
    return [int.from_bytes(line[k: k + 7], "big") for k in range(len(line) - 6)]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_contexts_are_the_true_last_bytes(size):
    import pyarrow as pa

    got = list(contextmix._grams(*contextmix.raw(pa.array(ODD_TEXTS)), iter(lambda: size, None)))
    want = [(i, g) for i, t in enumerate(ODD_TEXTS) for g in plain_windows(t)]
    assert [(r, g) for grams, rows in got for r, g in zip(rows.tolist(), grams.tolist(), strict=True)] == want
    assert list(contextmix._grams(*contextmix.raw(pa.array([], pa.string())), iter(lambda: size, None))) == []


def plain_mix(x):
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) % 2**64
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) % 2**64
    return x ^ x >> 31


def test_context_mixing_scores_equal_brute_force(spark):
    """Counts, inputs, gate, mixing and map one decision after the other; weights and map as they were learned."""
    docs = spark.createDataFrame([(i, t, i % 4 == 1) for i, t in enumerate(ODD_TEXTS + ["the dog sat", "abba ab"])], "doc_id long, text string, held boolean").coalesce(1)
    model, _ = contextmix.fit(docs.where("not held"))
    texts = [(r.doc_id, r.text, r.held) for r in docs.collect()]

    def nodes(gram):
        for order, bits in zip(contextmix.ORDERS, model.bits, strict=True):
            first = plain_mix((gram >> 8) % (1 << 8 * order) + (order << 56))
            second = plain_mix((first + (gram >> 4) % 16 + 1) % 2**64)
            for bit in range(8):
                half = (gram >> 4) % 16 if bit < 4 else gram % 16
                yield order, bit, ((first if bit < 4 else second) >> 64 - bits) ^ (1 << bit % 4 | half >> 4 - bit % 4), gram >> 7 - bit & 1

    count = Counter()
    for _, t, held in texts:
        count.update(n[:1] + n[2:] for g in plain_windows(t) if not held for n in nodes(g))
    got = {r.doc_id: r.score for r in score_texts(docs, F.col("held")).collect()}
    for i, t, _ in texts:
        bits = 0.0
        for g in plain_windows(t):
            inputs, known, one = [[] for _ in range(8)], [0] * 8, [0] * 8
            for order, bit, slot, value in nodes(g):
                n0, n1 = count[order, slot, 0], count[order, slot, 1]
                inputs[bit].append(round(math.log((n1 + 0.4) / (n0 + 0.4)) * 1024) / 1024)
                known[bit] += n0 + n1 >= 2
                one[bit] = value
            for bit in range(8):
                gate = known[bit] * 8 + bit
                z = sum(w * x for w, x in zip(model.weights[:, gate].tolist(), [*inputs[bit], 0.3], strict=True))
                place = (min(max(z, -8), 8) + 8) * 2
                low = min(int(place), 31)
                mapped = model.map[gate * 33 + low] * (low + 1 - place) + model.map[gate * 33 + low + 1] * (place - low)
                p = 0.5 * mapped + 0.5 / (1 + math.exp(-z))
                bits -= math.log2(p if one[bit] else 1 - p)
        assert math.isclose(-bits * math.log10(2), got[i], rel_tol=1e-4), i


def some_grams():
    return np.array([g for t in ODD_TEXTS for g in plain_windows(t)], np.uint64)


def test_orders_are_read_and_counted_one_after_the_other():
    """An order's four slots of a half come together, so that they are still in a core's cache; each is counted after it is read."""
    log = []

    class Seen(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray):
                log.append(len(self))
            return np.asarray(super().__getitem__(at))

    learner = contextmix._Learner([16, 17, 18, 19, 20])
    learner.tables = [t.view(Seen) for t in learner.tables]
    learner.learn(some_grams())
    assert log == [1 << b for b in (16, 17, 18, 19, 20) for _ in range(4)] * 2


@pytest.mark.parametrize("bits", [5, 16])
def test_learning_equals_brute_force(bits):
    """One slice, predicted and then counted bit after bit; small tables make contexts meet between two bits."""
    learner, grams = contextmix._Learner([bits] * 5), some_grams()
    learner.learn(grams)
    count, weights, hits = Counter(), np.full((6, 48), 0.3), np.zeros(2 * 48 * 33)
    for bit in range(8):
        seen = []
        for g, n in Counter(grams.tolist()).items():
            half, nodes = (g >> 4) % 16 if bit < 4 else g % 16, []
            for order in contextmix.ORDERS:
                h = plain_mix((g >> 8) % (1 << 8 * order) + (order << 56))
                h = h if bit < 4 else plain_mix((h + (g >> 4) % 16 + 1) % 2**64)
                nodes.append((order, h >> 64 - bits ^ (1 << bit % 4 | half >> 4 - bit % 4)))
            pairs = [(count[node, 0], count[node, 1]) for node in nodes]
            known = sum(a + b >= 2 for a, b in pairs)
            inputs = np.array([math.log((b + 0.4) / (a + 0.4)) for a, b in pairs] + [0.3])
            z = float(weights[:, known * 8 + bit] @ inputs)
            one = g >> 7 - bit & 1
            hits[(round(min(max(z, -8), 8) * 2 + 16) + (known * 8 + bit) * 33) * 2 + one] += n
            seen.append((known, n, one, n * (one - 1 / (1 + math.exp(-z))) * inputs, nodes))
        for known in {s[0] for s in seen}:
            level = [s for s in seen if s[0] == known]
            weights[:, known * 8 + bit] += 0.16 / math.sqrt(1 + 1e-3 / 50) / sum(s[1] for s in level) * sum(s[3] for s in level)
        for _, n, one, _, nodes in seen:
            count.update({(node, one): n for node in nodes})
    assert np.allclose(learner.weights, weights, rtol=1e-4, atol=1e-5)
    assert learner.hits.sum() == hits.sum() == 8 * len(grams) and np.abs(learner.hits - hits).sum() <= 0.01 * hits.sum()
    for order, table in zip(contextmix.ORDERS, learner.tables, strict=True):
        assert all(int(v) == count[(order, i), 0] + (count[(order, i), 1] << 32) for i, v in enumerate(table[: 1 << 12]))


def test_grams_turn_and_packed_counts_add_up():
    grams = some_grams()
    line = contextmix._suffix_first(grams)
    assert (contextmix._symbol_last(line) == grams).all()
    by_suffix = sorted(set(grams.tolist()), key=lambda g: ((g >> 8).to_bytes(6, "little"), g & 255))
    assert contextmix._symbol_last(np.unique(line)).tolist() == by_suffix
    slots = np.array([0, 1, 255, 256, 1 << 32, 7 << 32 | 70_000, (1 << 64) - 1], np.uint64)
    for some in (slots, slots[:3]):
        total = np.zeros((2, len(some)), np.int64)
        for _ in range(2):
            contextmix._add_packed(total, contextmix._pack(some))
        assert total.tolist() == [[2 * (v % 2**32) for v in some.tolist()], [2 * (v >> 32) for v in some.tolist()]]


def test_remembered_costs_are_the_computed_ones(monkeypatch):
    """A memo of two places, so that most grams take another's place over."""
    monkeypatch.setattr(contextmix, "MEMO_BITS", 1)
    memo, grams, asked = contextmix._Memo(), some_grams(), []

    def work(gram):
        asked.append(gram)
        return (gram % np.uint64(1009)).astype(np.float32)

    for _ in range(3):
        assert memo.costs(grams, work).tolist() == (grams % np.uint64(1009)).tolist()
    assert len(asked[0]) == len(set(grams.tolist()))


def test_context_tables_grow_with_the_input_and_sum_over_tasks(spark):
    assert [contextmix.table_bits(n)[-1] for n in (0, 10**6, 10**8, 10**9, 10**14)] == [18, 19, 23, 24, 25]
    texts = [(f"w{i} common words of row {i % 5}",) for i in range(400)]
    one, many = (contextmix.fit(spark.createDataFrame(texts, "text string").repartition(n)) for n in (1, 7))
    assert all((a == b).all() for a, b in zip(one[0].tables, many[0].tables, strict=True))
    assert sorted(one[1].collect()) == sorted(many[1].collect())


def test_context_mixing_sees_the_word_before(spark, monkeypatch):
    rng = np.random.default_rng(3)
    after = {"river": "bridge", "stone": "wall", "green": "leaf", "quiet": "house"}
    told = [" ".join(f"{w} {after[w]}" for w in rng.choice(list(after), 12)) for _ in range(60)]
    shuffled = [" ".join(rng.permutation(t.split())) for t in told]
    docs = spark.createDataFrame([(i, t, False) for i, t in enumerate(told)] + [(1000 + i, t, True) for i, t in enumerate(shuffled)] + [(2000, "", True), (2001, told[0].replace(" ", " \n"), True)], "doc_id long, text string, held boolean")
    got = {r.doc_id: r for r in score_texts(docs, F.col("held")).collect()}
    assert sum(got[i].score for i in range(60)) > 0.7 * sum(got[1000 + i].score for i in range(60))
    assert math.isclose(got[2001].score, got[0].score, rel_tol=1e-9)
    monkeypatch.setattr(contextmix, "FREQUENT", 0)  # all words are joined
    for r in score_texts(docs, F.col("held")).collect():
        assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(r, got[r.doc_id], strict=True))


def test_references_dashes_and_marked_words_are_read():
    for want in ("john&#64;example.com", "john&commat;example.com", "john&#x40;example&period;com", "john -at- example -dot- com", "john_at_example_dot_com", "john @ example.com",
                 "4111\u20131111\u20131111\u20131111", "4111\u20101111\u20111111\u22121111", "+49\u201330\u20131234567", "john@my\u2011host.example.com"):
        text = f"see {want}, then"
        assert [text[s:e] for _, s, e in added_spans(text, plain_spans(text))] == [want], want
    for clean in ("polka-dot-dress &amp; more", "from 1990\u20131995 \u2014 at home", "two @ 5.00 each", "one\u2014john@example.com", "look_at_me", "R&D; a &period; b"):
        assert added_spans(clean, plain_spans(clean)) == [], clean


def plain_within(window, text):
    """Fewest edits between a stretch and any part of a text."""
    row = [0] * (len(text) + 1)
    for a in window:
        new = [row[0] + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def plain_local(item, text):
    """Best local alignment: matches minus edits."""
    row, best = [0] * (len(text) + 1), 0
    for a in item:
        new = [0]
        for j, b in enumerate(text):
            new.append(max(0, row[j] + (1 if a == b else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, *new)
    return best


@pytest.mark.parametrize("hits", [1, 50, 1 << 20])
def test_leaks_equal_brute_force_in_slices_of_any_size(monkeypatch, hits):
    monkeypatch.setattr(decontaminate, "HITS", hits)
    rng = np.random.default_rng(11)
    letters = lambda k, n: "".join(rng.choice(list("abcdefgh"[:k]), n))
    items = [letters(8, 66), letters(8, 40), "ab" * 33, "a" * 64]
    texts = ["ab" * 90, "a" * 150, letters(2, 120), letters(8, 100)]
    for item in items[:2]:
        for edits in (0, 2, 4, 9):
            part = list(item)
            for at in rng.choice(len(part), edits, replace=False):
                part[at] = "" if rng.random() < 0.3 else "h"
            texts.append(letters(8, 30) + "".join(part) + letters(8, 20))
    index = decontaminate.Index(items)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    got = {(d, i) for d, i, *_ in decontaminate._leaks(index, data, np.cumsum([0, *map(len, texts)]))}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            n, e = int(index.n[i]), int(index.edits[i])
            if any(plain_within(item[a: a + n], text) <= e for a in range(0, len(item) - n + 1, 2)):
                assert (d, i) in got
            if (d, i) in got:
                assert plain_local(item, text) >= n - 2 * e
    assert {(0, 2), (1, 3)} <= got


def test_repetitive_texts_take_bounded_memory():
    import tracemalloc

    index = decontaminate.Index(["a" * 300, "a " * 40])
    text = np.frombuffer(b"a " * 50_000 + b"a" * 20_000, np.uint8)
    tracemalloc.start()
    leaks = decontaminate._leaks(index, text, np.array([0, len(text)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [i for _, i, *_ in leaks] == [0, 1] and peak < 500 << 20


def plain_targets(sizes, share=1.5):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, list(order), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def test_mixing_meets_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL", 16)
    rng = np.random.default_rng(5)
    rows = [(i, [None, "a", "b", "c", "d"][min(4, i % 9)], " ".join(["w"] * int(rng.integers(0, 60)))) for i in range(900)] + [(5000 + i, "a", "copy of one text") for i in range(300)]
    rows += [(7000, "b", None), (7000, "b", "x y"), (7000, "b", "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("target", F.lit("mine"))
    got = mix_sources(docs, word_count(F.col("text"))).collect()
    assert len(got) == len(rows) and sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in mix_sources(docs.repartition(3), word_count(F.col("text"))).collect())
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.copies * r.size
        assert 0 <= r.copies <= 2 and r.size == len((r.text or "").split())
    want = plain_targets(dict(sizes))
    for r in got:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9) and r.source_size == sizes[r.source]
    for s, w in want.items():
        assert abs(taken[s] - w) <= 3
    assert mix_sources(docs.limit(0), word_count(F.col("text"))).count() == 0


def test_top_k_equals_brute_force_with_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(400)] + [(1000 + i, [1.0] * 6) for i in range(40)]
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (50, rows[50][1])] + [rows[1], rows[1]]
    df = quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in top_k(df, df.where("vec_id % 50 = 0")).collect()}
    v = [(r.vec_id, np.array(r.v)) for r in df.collect()]  # repeated rows are candidates each
    for q, y in {i: x for i, x in v if i % 50 == 0}.items():
        best = sorted((-int(y @ x), i) for i, x in v if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]
    assert top_k(df.limit(0), df.limit(0)).count() == 0 and top_k(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0


def test_preferences(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "good <|end|>"), (1, 0, "user", "hi"), (1, 1, "assistant", "bad"), (1, 2, "user", "why"), (1, 2, "user", "why"),
             (2, 0, "user", "alone"), (4, 0, "user", "same"), (5, 0, "user", "same"), (None, 0, "user", "lost"), (6, None, None, None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("pair_id", F.lit("mine"))
    got = {r.pair_id: r for r in format_preferences(df, neighbour_pairs(df)).collect()}
    a = got[0]
    assert sorted(got) == [0, 1, 2, 3] and a.prompt == "<|user|>\nhi<|end|>\n" and a.prompt_turns == 1
    assert a.chosen == "<|assistant|>\ngood <\\|end|><|end|>\n" and a.rejected == "<|assistant|>\nbad<|end|>\n<|user|>\nwhy<|end|>\n"
    assert [a.chosen[s.start:s.end] for s in a.chosen_spans] == ["good <\\|end|><|end|>"] and [a.rejected[s.start:s.end] for s in a.rejected_spans] == ["bad<|end|>"]
    assert got[1].rejected == "" and got[1].prompt == "" and got[2].identical and got[2].chosen == got[2].rejected == "" and not got[1].identical


def test_turns_are_compared_as_they_are_and_escapes_can_be_undone(spark):
    texts = ["a<|b", "a< |b", "a<\\|b", "a<\\\\|b", "<||>", "<|end|>", "", "<", "|"]
    turns = [(2 * i, 0, "user", "a<|b") for i in range(len(texts))] + [(2 * i + 1, 0, "user", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in format_preferences(df, neighbour_pairs(df)).withColumn("back", plain_text("rejected")).collect()}
    assert [got[i].prompt_turns for i in range(len(texts))] == [1] + [0] * (len(texts) - 1)
    for i, t in enumerate(texts[1:], 1):
        assert got[i].rejected.count("<|") == 2 and got[i].rejected.endswith("<|end|>\n") and plain(got[i].rejected[len("<|user|>\n"):-len("<|end|>\n")]) == t


def plain(text):
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def test_pairs_that_branch(spark):
    turns = [(0, 0, "user", "q"), (0, 1, "assistant", "one"), (0, 2, "user", "more"), (0, 3, "assistant", "two"), (0, 4, "user", "thanks"), (1, 0, "user", "z"), (1, 1, "assistant", "other"),
             (2, 0, "user", "no answer"), (4, 0, "assistant", "alone"), (None, 0, "assistant", "lost"), (1, None, "assistant", "lost")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("other", F.lit(1))
    got = {r.pair_id: r for r in format_branches(df).collect()}
    assert sorted(got) == [-5, -2, -1] and got[-1].prompt_turns == 3 and got[-2].prompt_turns == 2
    assert got[-1].chosen == "<|assistant|>\ntwo<|end|>\n<|user|>\nthanks<|end|>\n" and got[-1].rejected == "<|assistant|>\nother<|end|>\n"
    assert got[-2].rejected == "<|assistant|>\ntwo<|end|>\n" and got[-5].rejected == "" and got[-5].chosen == "<|assistant|>\nalone<|end|>\n"
    assert format_branches(df.limit(0)).count() == 0


def test_url_rules_and_aliases(spark):
    rules = spark.createDataFrame([("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "bad.org", "/"), ("allow", "good.org", "/")], "action string, host string, path string")
    pages = [(1, "http://A.example.NET/en/x", None), (2, "http://example.net", None), (3, "http://example.net/de/", None), (4, None, None), (5, "no url", "<p>"),
             (6, "http://mirror.com/a", '<link rel="canonical" href="https://bad.org/1">'), (7, "http://mirror.com/b?q=1#x", "<LINK href='//mirror.com/a' REL=canonical>"),
             (8, "http://third.com/", '<meta http-equiv="refresh" content="0; url=http://bad.org/2">'), (9, "http://fourth.com/", None), (10, "http://free.com/", "<p>")]
    hops = spark.createDataFrame([("http://third.com/", "http://good.org/x"), ("http://fourth.com/", "http://third.com/"), (None, "http://bad.org/")], "source string, target string")
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("mine"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(df, rules, hops).collect()}
    assert got == {1: ("a.example.net", "/en/x", "example.net/en/", "allow"), 2: ("example.net", "", None, "allow"), 3: ("example.net", "/de/", "net/", "block"), 4: ("", "", None, "allow"),
                   5: ("", "", None, "allow"), 6: ("mirror.com", "/a", None, "block"), 7: ("mirror.com", "/b", None, "block"), 8: ("third.com", "/", None, "allow"),
                   9: ("fourth.com", "/", None, "allow"), 10: ("free.com", "/", None, "allow")}
    assert judge_urls(df.limit(0), rules).count() == 0


def test_url_aliases_on_real_html(spark):
    rules = spark.createDataFrame([("block", "bad.org", "/")], "action string, host string, path string")
    link = '<link rel="canonical" href="{}">'
    pages = [(1, "http://a.com/1", link.format("http://free.org/") + link.format("http://bad.org/x")), (2, "http://b.com/", link.format("http://bad.org/?a=1&amp;b=2")),
             (3, "http://c.com/s?a=1&b=2", '<meta http-equiv="refresh" content="0; url=http://bad.org/3">'), (4, "http://d.com/", link.format("http://c.com/s?a=1&amp;b=2")),
             (5, "http://e.com", link.format("http://bad.org/5")), (6, "http://e.com/", None), (7, "http://f.com/dir/page?p=2", link.format("http://bad.org/7")),
             (8, "http://f.com/dir/page", link.format("?p=2")), (9, "http://g.com/", '<meta http-equiv="refresh" content="0; url=http://c.com/s?a=1&#38;b=2">'),
             (10, "http://h.com/dir/page", link.format("#top")), (11, "http://h.com/dir/", link.format("http://bad.org/11")), (12, "http://free.org/", None), (13, "http://f.com/dir/?p=2", None)]
    got = {r.page_id: r.verdict for r in judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()}
    assert {i for i, v in got.items() if v == "allow"} == {10, 13} and len(got) == 13


def test_toxicity_finds_planted_words(spark):
    rng = np.random.default_rng(4)
    rows = [(i, prose(rng, 60) + (" scum, idiot!" if i % 7 == 0 else "") + (" moron LOSER stupid trash" if i % 14 == 0 else "")) for i in range(700)] + [(9001, None), (9002, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("mine"))
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(500)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in score_toxicity(docs, labels).collect()}
    assert all(got[i].toxic == (i % 7 == 0) for i in range(700)) and got[9001].expected_severity == got[9002].expected_severity == 0
    assert got[14].expected_severity > got[7].expected_severity > got[1].expected_severity
    assert not any(r.toxic for r in score_toxicity(docs, labels.where("toxic = 0")).collect())


def test_plain_spans_equal_the_plain_patterns(spark, documents):
    def base(t):
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = [int(c) for c in m[0] if c.isdigit()][::-1]
            if 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d)) % 10 == 0:
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
        return sorted(out, key=lambda s: (s[1], ("email", "ip", "card", "phone").index(s[0])))

    texts = [r.text for r in documents.collect()] + ["a@b@c.de@f.g", "@x.y a@.b a@b..c", "1.2.3.4.5.6.7.8 256.1.1.1 01.2.3.4", "4539 1488 0343 6467-1", "+1 (2) 3456 789.", "é +49 30 1234567 ü@ö.de", "", "a" * 5000 + "@"]
    rng = np.random.default_rng(0)
    texts += ["".join(rng.choice(list("aZ0159.@+-() é%_"), 60)) for _ in range(400)]
    assert [plain_spans(t) for t in texts] == [base(t) for t in texts]


def test_disguises_map_back_to_the_source():
    cases = {"write john (at) example [dot] com now": "john (at) example [dot] com", "é john at mail dot example dot org!": "john at mail dot example dot org", "ip 10 dot 0 dot 0 dot 7 x": "10 dot 0 dot 0 dot 7",
             "call plus four four two zero seven one two three four five six": "plus four four two zero seven one two three four five six", "jоhn@exаmple.com": "jоhn@exаmple.com", "１０.0.0.1": "１０.0.0.1"}
    for text, want in cases.items():
        found = added_spans(text, plain_spans(text))
        assert want in [text[s:e] for _, s, e in found], text
    for clean in ("It was at the dot of nine.", "one at a time", "met at noon (at home)", "the ex at work.It"):
        assert added_spans(clean, plain_spans(clean)) == []
    assert redacted("a@b.co and 1.2.3.4", plain_spans("a@b.co and 1.2.3.4")) == "[EMAIL] and [IP]"


def test_disguises_reach_beyond_plain_fragments():
    for whole in ("jоhn@example.com", "jo\u200bhn@example.com", "john@mail.exаmple.com", "john dot doe@example.com", "+49 30 123456 seven eight nine"):
        text = f"write ({whole}) now"
        base = plain_spans(text)
        added = added_spans(text, base)
        assert base and [text[s:e] for _, s, e in added] == [whole]
        assert redacted(text, base + added) == f"write ([{base[0][0].upper()}]) now"
    covered = "john@example.com and ip 10.0.0.1 (at) home"
    assert added_spans(covered, plain_spans(covered)) == []


def test_one_digit_word_or_plus_is_a_disguise():
    cases = {"ip 10.0.0.seven": "10.0.0.seven", "card 4111 1111 1111 111 one": "4111 1111 1111 111 one", "+49 30 five five five five five": "+49 30 five five five five five",
             "call plus 49 30 1234567": "plus 49 30 1234567", "call plus (49) 30 1234567": None, "ip 10.0.0.ſeven": "10.0.0.ſeven", "ip 10.0.0.fİve": "10.0.0.fİve"}
    for text, want in cases.items():
        assert disguised(text)
        for around in (text, f"my phone, my money. {text}", f"Seven of ten: {text}"):
            found = added_spans(around, plain_spans(around))
            assert want is None or want in [around[s:e] for _, s, e in found], around
    parts = ["one", "ſix", "nİne", "Two", "plus", "PLUſ", "dot", " at ", "(", ")", "[", "]", " ", " ", "-", "7", "a", "é", ".", "@", "\n"]
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(parts, 9)) for _ in range(5000)]
    assert all(disguised(t) for t in texts if _RULES.search(t)) and sum(bool(_RULES.search(t)) for t in texts) > 500
    for t in texts:
        added_spans(t, plain_spans(t))


def test_spelled_at_before_plain_dots():
    cases = {"write john at mail.example dot com now": "john at mail.example dot com", "x jane at a.b [dot] example.org": "jane at a.b [dot] example.org",
             "see john.doe at example.com": "john.doe at example.com", "see j_d at mail.example.com": "j_d at mail.example.com", "me7 at example.com": "me7 at example.com",
             "E-Mail: john at example.com": "john at example.com", "contact jane at example.org": "jane at example.org"}
    for text, want in cases.items():
        assert [text[s:e] for _, s, e in added_spans(text, plain_spans(text))] == [want], text
    for clean in ("meet at example.com", "we look at mail.example.com", "contact us. Look at example.com", "contact us at example.com", "in 2020 at example.com", "john at the.example dot"):
        assert added_spans(clean, plain_spans(clean)) == [], clean
    long = "a at " + "b." * 100_000 + " at  " * 50_000
    assert added_spans(long, plain_spans(long)) == []


def test_pii_odd_rows(spark, odd):
    got = find_pii(odd.withColumn("pii_base", F.lit("mine"))).select("doc_id", span_text(F.col("pii_base")).alias("s"), "pii_redacted", "keep").collect()
    assert len(got) == len(ODD) and all(r.s == "" and r.keep == "mine" for r in got) and [r.pii_redacted for r in got if r.doc_id == 1] == [None]
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]


def test_pipeline_stages_keep_columns_and_clean_rows(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    one = p.quality_stage(spark, docs, sf).cache()
    assert one.columns == docs.columns and not any(labels.get(r.doc_id) == 0 for r in one.collect())
    two = p.near_duplicate_stage(spark, one, sf).cache()
    assert two.columns == docs.columns and len({r.text for r in two.collect()}) == two.count()
    three = p.decontamination_stage(spark, two, sf).cache()
    gone = {r.doc_id for r in two.collect()} - {r.doc_id for r in three.collect()}
    assert gone == {r.doc_id for r in two.collect() if any(t in r.text for t in items)}
    four = p.pii_stage(spark, three, sf).cache()
    assert four.columns == docs.columns and four.count() == three.count() and not any("@" in r.text and re.search(r"\w@\w+\.\w", r.text) for r in four.collect())
    five = p.mixing_stage(spark, four, sf).collect()
    assert all(r.copies in (1, 2) for r in five) and len(p.STAGES) == 5
    one.unpersist(), two.unpersist(), three.unpersist(), four.unpersist()


def test_clashing_columns_pass_through(spark):
    """Columns with the names that operators use inside, or make, survive; stages give back the documents' own columns."""
    import corpus_pipeline as p

    mine = ["base", "due", "_part", "_none", "action", "inherited", "_node", "Leaks", "PII_Base", "keep", "quality", "key", "n"]
    rows = [(i, f"A plain sentence number {i} about the river and its bridges. It goes on for a while.", ["a", None][i % 2]) for i in range(30)] + [(None, None, None), (31, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *[F.lit(f"mine {c}").alias(c) for c in mine])
    kept = [f"mine {c}" for c in mine]
    mixed = mix_sources(docs, word_count(F.col("text"))).collect()
    assert len(mixed) == len(rows) and all([r[c] for c in mine] == kept for r in mixed)
    rules = spark.createDataFrame([("block", "net", "/")], "action string, host string, path string")
    pages = docs.withColumn("url", F.lit("http://a.net/x")).withColumn("html", F.lit('<link rel="canonical" href="http://b.org/">'))
    for df in (pages, pages.drop("html")):
        assert all([r[c] for c in mine] == kept and r.verdict == "block" for r in judge_urls(df, rules).collect())
    for _, stage in p.STAGES[:-1]:
        found = stage(spark, docs, SF)
        assert found.columns == docs.columns and found.count() > 0 and all([r[c] for c in mine] == kept for r in found.collect())
        assert stage(spark, docs.limit(0), SF).count() == 0
