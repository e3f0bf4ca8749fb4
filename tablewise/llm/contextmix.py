"""Language-model scores by online logistic context mixing.

A text is its words' bytes, each word closed by a space symbol, and one end symbol. A byte is eight binary decisions. For each, one bit
predictor per context order (the last 1, 2, 3, 4 and 6 bytes, over spaces into the words before; zeros stand before the text's start)
gives a probability from the counts in the slot that its context and the bits so far hash to. The predictors are mixed in the logistic
domain by weights that a gate selects (how many of the orders know the context, and which bit it is). An adaptive map from mixed to
observed probabilities refines the result.

Training reads the texts once. Each task walks its texts in order, piece by piece: a piece is predicted from what the task has counted
so far, weights and map move along its coding cost, then its bits are counted. Slots are summed over tasks by slot ranges, weights are
averaged, and a second pass scores all texts. Equal decisions of a piece (seven bytes) are predicted once.

Tables have 2^b slots, where b grows with the logarithm of the training bytes, half as fast, up to `MAX_BITS`. Every training byte is
counted at any size; beyond that bound contexts share slots more often. It keeps a task's tables under 400 MB and the broadcast ones
under 100 MB."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.llm.shared import prepare, stash
from tablewise.llm.tokens import _LOWER, _SPACE, U, mix, raw, words

ORDERS = (1, 2, 3, 4, 6)
SMALLER = (6, 5, 3, 2, 0)  # powers of two by which an order's table is smaller than the longest one's
MIN_BITS, MAX_BITS, LEAST_BITS = 18, 25, 16
SPACE, END = 0x20, 0x0A  # symbols that no word holds
TAIL = 6  # bytes of the longest context
PIECE, FIRST_PIECE = 8 << 20, 256 << 10  # bytes predicted together; training starts with the smaller ones
SCORED = 512 << 10  # bytes scored together; a task holds some sixty bytes for each
RANGE = 1 << 18  # slots that travel together
FREQUENT = 500_000  # words whose counts are broadcast to the texts
SLICE, RATE, PRIOR = 8_192, 0.16, 0.4
SUMMED = 2_048  # decisions that one product sums
MEMO_BITS = 22  # logarithm of how many grams' costs a task remembers
GATES, BINS = 6 * 8, 33
STEPS = 1024  # parts of one unit in a kept logit
WORD, TABLE, WEIGHT = 0, 1, 2  # kinds of rows that training gives
WEIGHT_PARTS = 64

_GRAM = U((1 << 8 * (TAIL + 1)) - 1)
_LOW = 0 if sys.byteorder == "little" else 1  # where the lower half of a slot lies
_END_HASH = U(1)  # stands for the end token among hashed words


def table_bits(train_bytes: int) -> list[int]:
    """Logarithms of the slots of each order's table."""
    longest = int(np.clip(np.floor(np.log2(max(train_bytes, 1)) / 2 + 10), MIN_BITS, MAX_BITS))
    return [max(longest - s, LEAST_BITS) for s in SMALLER]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together up to a piece, as larger pieces repeat more."""
    held, size, rows = [], 0, 0
    for batch in batches:
        if held and (size + batch.nbytes > PIECE or rows + len(batch) > 100_000):
            yield pa.Table.from_batches(held)
            held, size, rows = [], 0, 0
        held.append(batch)
        size += batch.nbytes
        rows += len(batch)
    if held:
        yield pa.Table.from_batches(held)


def _grams(data: np.ndarray, bounds: np.ndarray, sizes: Iterator[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces of the texts' symbols: each symbol with the six before it in its text (seven bytes, the symbol lowest), and its text's
    number. A piece may end anywhere; the next one goes on with the bytes before it."""
    head, a, text = np.zeros(TAIL + 1, np.uint8), 0, 0
    while text < len(bounds) - 1:
        b = min(a + next(sizes), len(data))
        part = data[a:b]
        kept = ~_SPACE[part]
        stop = int(np.searchsorted(bounds[1:], b, "right"))  # texts that end inside, empty ones included
        ends = (bounds[1 + text: 1 + stop] - a).astype(np.int64)
        last = kept.copy()
        last[:-1] &= ~kept[1:]
        if b < len(data):
            last[-1:] &= _SPACE[data[b]]
        inner = ends[ends > 0] - 1
        last[inner] |= kept[inner]
        given = np.zeros(len(part) + 1, np.int32)  # symbols before a byte, end symbols left out
        np.cumsum(kept.astype(np.int8) + last, out=given[1:])
        closed = np.cumsum(np.bincount(ends, minlength=len(part) + 1), dtype=np.int32)  # texts that ended before a byte
        line = np.full(len(head) + given[-1] + len(ends), SPACE, np.uint8)
        line[: len(head)] = head
        at = (given[:-1] + closed[:-1])[kept] + len(head)
        line[at] = _LOWER[part[kept]]
        end_at = given[ends] + np.arange(len(ends)) + len(head)
        line[end_at] = END
        size = len(line) - len(head)
        gram = _windows(line, size)
        for k in range(TAIL):
            early = end_at + 1 + k - len(head)
            early = early[(early < np.append(end_at[1:] + 1, len(line)) - len(head))] if len(end_at) else early
            gram[early] &= U((1 << 8 * (k + 1)) - 1)
        row = np.repeat(np.arange(text, text + len(ends) + 1, dtype=np.int32), np.diff(np.concatenate([[0], end_at + 1 - len(head), [size]])))
        yield gram, row
        head = line[-len(head):].copy()
        over = np.flatnonzero(head == END)
        if len(over):
            head[: over[-1] + 1] = 0
        a, text = b, stop


def _windows(line: np.ndarray, size: int) -> np.ndarray:
    """The seven bytes that end at each of the last size places; line has seven bytes before these."""
    return np.ndarray((size,), ">u8", np.ascontiguousarray(line), len(line) - size - 7, (1,)).astype(U) & _GRAM


def _stretch(zero: np.ndarray, one: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    one = one + np.float32(PRIOR)
    one /= zero + np.float32(PRIOR)
    return np.log(one, out=out)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _suffix_first(gram: np.ndarray) -> np.ndarray:
    """Grams so turned that sorting brings contexts together by their last bytes, which all orders share."""
    line = np.empty_like(gram)
    for a in range(0, len(gram), 1 << 16):  # a piece is large, so nothing else of its size is held beside it
        some = gram[a: a + (1 << 16)]
        line[a: a + (1 << 16)] = (some >> U(8)).byteswap() | (some & U(0xFF))
    return line


def _symbol_last(line: np.ndarray) -> np.ndarray:
    """The grams that were turned."""
    return (line & ~U(0xFFFF)).byteswap() << U(8) | (line & U(0xFF))


def _bases(gram: np.ndarray, order: int, bits: int) -> list[np.ndarray]:
    """For either half of the symbol the slot that its nodes are near: 16 slots belong together, shifted by the context's hash."""
    h = ((gram >> U(8)) & U((1 << 8 * order) - 1)) + U(order << 56)
    first = mix(h)
    second = mix(first + ((gram >> U(4)) & U(15)) + U(1))
    return [(x >> U(64 - bits)).astype(np.int64) for x in (first, second)]


def _decisions(gram: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """The four bits of a half of the symbols, a row each: the nodes they decide at (1 to 15) and their values."""
    symbol = (gram >> U(4) if half == 0 else gram).astype(np.int64) & 15
    return np.stack([1 << place | symbol >> 4 - place for place in range(4)]), np.stack([symbol >> 3 - place & 1 for place in range(4)])


def _logits(got: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Logits of slots, and whether (1 or 0) they know the context. Slots are counts (ones in the upper half) or kept logits."""
    if got.dtype == np.int16:
        np.multiply(got >> 1, np.float32(1 / STEPS), out=out)
        return (got & 1).astype(np.int8)
    both = got.view(np.uint32)
    zero, one = both[_LOW::2].astype(np.float32), both[1 - _LOW::2].astype(np.float32)
    known = zero + one >= 2
    _stretch(zero, one, out)
    return known.view(np.int8)


def _mixed(inputs: np.ndarray, known: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Inputs weighted by how many orders know the context, added up in their order."""
    total = np.empty_like(inputs)
    for row, w in zip(total, weights, strict=True):
        w.take(known, out=row, mode="clip")
    total *= inputs
    return np.add.reduce(total, axis=0)


def _place(x: np.ndarray) -> np.ndarray:
    """Where a mixed logit lies among the map's points."""
    return np.clip(x, -8, 8) * np.float32((BINS - 1) / 16) + np.float32((BINS - 1) / 2)


class _Learner:
    """What one task learns from its texts, in their order."""

    def __init__(self, bits: list[int]):
        self.bits = bits
        self.tables = [np.zeros(1 << b, U) for b in bits]
        self.weights, self.seen = np.full((len(ORDERS) + 1, GATES), 0.3, np.float32), np.full(GATES, 1e-3)
        self.hits, self.n = np.zeros(2 * GATES * BINS), 0

    def learn(self, gram: np.ndarray) -> None:
        line = _suffix_first(gram)
        line.sort()
        new = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        n = np.diff(new, append=len(line))
        line = line[new]
        gram = _symbol_last(line)
        deal = np.argsort(mix(gram))  # so that no slice holds neighbouring contexts only
        for a in range(0, len(gram), SLICE):
            some = np.sort(deal[a: a + SLICE])  # inside a slice neighbours lie together, as they share slots
            self._slice(gram[some], n[some])
        self.n += int(n.sum())

    def _slice(self, gram: np.ndarray, n: np.ndarray) -> None:
        """Each bit of a slice is predicted and then counted. Counts need no weights, so an order's slots of a half, which lie side by
        side, are read and counted bit after bit while they are in a core's cache; then the weights follow."""
        bases = [_bases(gram, order, bits) for order, bits in zip(ORDERS, self.bits, strict=True)]
        c, levels = n.astype(np.float64), np.eye(len(ORDERS) + 1)
        inputs = np.full((4, len(ORDERS) + 1, len(gram)), 0.3, np.float32)
        for half in range(2):
            nodes, ones = _decisions(gram, half)
            add, at = n.astype(U) << (ones << 5).astype(U), np.empty(len(gram), np.int64)
            known = np.zeros(nodes.shape, np.int8)
            for k, (table, base) in enumerate(zip(self.tables, bases, strict=True)):
                for place in range(4):
                    np.bitwise_xor(base[half], nodes[place], out=at)
                    got = table[at]
                    np.add.at(table, at, add[place])
                    known[place] += _logits(got, inputs[place, k])
            for place in range(4):
                self._bit(half * 4 + place, inputs[place], known[place], ones[place], c, levels)

    def _bit(self, bit: int, inputs: np.ndarray, known: np.ndarray, one: np.ndarray, c: np.ndarray, levels: np.ndarray) -> None:
        """Map and weights move along the coding cost of one bit."""
        known = known.astype(np.int64)
        z = _mixed(inputs, known, self.weights[:, bit::8])
        spot = np.rint(_place(z)).astype(np.int64)
        spot += known * (8 * BINS)
        spot *= 2
        spot += one
        self.hits[bit * 2 * BINS:] += np.bincount(spot, c, 2 * (GATES - bit) * BINS)
        total = np.bincount(known, c, len(levels))
        level = np.flatnonzero(total)
        hit = level * 8 + bit
        wrong = one.astype(np.float64)
        wrong -= _squash(z).astype(np.float64)
        wrong *= c
        moved = np.zeros((len(inputs), len(levels)))
        for a in range(0, len(c), SUMMED):
            part = inputs[:, a: a + SUMMED].astype(np.float64)
            part *= wrong[a: a + SUMMED]
            moved += part @ levels.take(known[a: a + SUMMED], axis=0)
        self.weights[:, hit] += RATE / np.sqrt(1 + self.seen[hit] / 50) / total[level] * moved[:, level]
        self.seen[hit] += 1


_LEARNED = "kind int, part int, key long, n long, data binary"
_LEARNED_NAMES = ["kind", "part", "key", "n", "data"]


def _row(kind: int, part: int, key: int, n: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([key], pa.int64()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], _LEARNED_NAMES)


class _WordCounts:
    """Counts of hashed words, handed on when there are many."""

    def __init__(self):
        self.key, self.n, self.more = np.zeros(0, U), np.zeros(0, np.int64), []

    def add(self, h: np.ndarray) -> None:
        self.more.append(np.unique(h, return_counts=True))
        if sum(len(k) for k, _ in self.more) > 1_000_000:
            self._merge()

    def _merge(self) -> None:
        keys = np.concatenate([self.key, *(k for k, _ in self.more)])
        n = np.concatenate([self.n, *(v for _, v in self.more)])
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.key, self.n, self.more = keys[new], (np.add.reduceat(n, new) if len(new) else n), []

    def flush(self, least: int) -> Iterator[pa.RecordBatch]:
        if least == 0:
            self._merge()
        if len(self.key) > least:
            m = len(self.key)
            zeros = pa.array(np.zeros(m, np.int32))
            yield pa.RecordBatch.from_arrays([zeros, zeros, pa.array(self.key.view(np.int64)), pa.array(self.n), pa.nulls(m, pa.binary())], _LEARNED_NAMES)
            self.key, self.n = np.zeros(0, U), np.zeros(0, np.int64)


def _pack(slots: np.ndarray) -> bytes:
    """Counts by the place of their bytes, as the upper ones are mostly zero."""
    planes, used = np.zeros((8, len(slots)), np.uint8), int(np.bitwise_or.reduce(slots))
    for k in range(8):
        if used >> 8 * k & 255:
            planes[k] = (slots >> U(8 * k)).astype(np.uint8)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _add_packed(total: np.ndarray, data: bytes) -> None:
    """Adds packed counts to the zeros and ones of their slots."""
    planes = np.frombuffer(pa.decompress(data, total.size * 4, codec="zstd", asbytes=True), np.uint8).reshape(8, -1)
    for k, plane in enumerate(planes):
        if plane.any():
            total[k // 4] += plane.astype(np.int64) << 8 * (k % 4)


def _trainer(bits: list[int]):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, counts, size, task = None, _WordCounts(), FIRST_PIECE, TaskContext.get().partitionId()

        def sizes() -> Iterator[int]:
            nonlocal size
            while True:
                yield size
                size = min(2 * size, PIECE)

        for table in _gathered(batches):
            learner = learner or _Learner(bits)
            data, bounds = raw(table.column("text"))
            for gram, _ in _grams(data, bounds, sizes()):
                if len(gram):
                    learner.learn(gram)
            h, _ = words(data, bounds)
            counts.add(np.concatenate([h, np.full(len(bounds) - 1, _END_HASH)]))
            yield from counts.flush(2_000_000)
        yield from counts.flush(0)
        if learner:
            for order, slots in enumerate(learner.tables):
                for at in range(0, len(slots), RANGE):
                    part = slots[at: at + RANGE]
                    if part.any():
                        yield _row(TABLE, order << 16 | at // RANGE, task, len(part), _pack(part))
            told = np.concatenate([learner.weights.ravel() * float(learner.n), learner.hits, [learner.n]])
            yield _row(WEIGHT, -1 - task % WEIGHT_PARTS, task, 1, told.tobytes())

    return train


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows of one part after the other: counts become kept logits, weights stay sums."""
    part, total = None, None

    def out() -> pa.RecordBatch:
        if part >= 0:
            zero, one = np.minimum(total[0], 2**32).astype(np.float32), np.minimum(total[1], 2**32).astype(np.float32)
            kept = np.rint(np.clip(_stretch(zero, one), -14, 14) * STEPS).astype(np.int16)
            data = (kept << 1 | (zero + one >= 2)).astype(np.int16).tobytes()
        else:
            data = total.tobytes()
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([data], pa.binary())], ["part", "data"])

    for batch in batches:
        for p, n, data in zip(batch["part"].to_pylist(), batch["n"].to_pylist(), batch["data"].to_pylist(), strict=True):
            if p != part:
                if part is not None:
                    yield out()
                part, total = p, np.zeros((2, n), np.int64) if p >= 0 else np.zeros(len(data) // 8)
            if p >= 0:
                _add_packed(total, data)
            else:
                total += np.frombuffer(data, np.float64)
    if part is not None:
        yield out()


class _Memo:
    """Costs of grams that a task has scored before, each in the one place that its hash names; later ones take the place over."""

    def __init__(self):
        self.gram, self.cost = np.full(1 << MEMO_BITS, ~U(0)), np.zeros(1 << MEMO_BITS, np.float32)

    def costs(self, gram: np.ndarray, work) -> np.ndarray:
        at = (mix(gram) >> U(64 - MEMO_BITS)).astype(np.int64)
        out = self.cost[at]
        new = np.flatnonzero(self.gram[at] != gram)
        if len(new):
            line, back = np.unique(_suffix_first(gram[new]), return_inverse=True)
            out[new] = work(_symbol_last(line))[back]
            self.gram[at[new]], self.cost[at[new]] = gram[new], out[new]
        return out


class Model:
    """Kept logits by slot, weights by gate and the adaptive map."""

    def __init__(self, bits: list[int], rows: list):
        self.bits = bits
        self.tables = [np.zeros(1 << b, np.int16) for b in bits]
        self.weights = np.full((len(ORDERS) + 1, GATES), 0.3, np.float32)
        told = np.zeros(self.weights.size + 2 * GATES * BINS + 1)
        for part, data in sorted((r.part, bytes(r.data)) for r in rows):
            if part < 0:
                told += np.frombuffer(data)
            else:
                slots = np.frombuffer(data, np.int16)
                at = (part & 0xFFFF) * RANGE
                self.tables[part >> 16][at: at + len(slots)] = slots
        if told[-1] > 0:
            self.weights = (told[: self.weights.size] / told[-1]).reshape(self.weights.shape).astype(np.float32)
        zero, one = told[self.weights.size: -1].reshape(-1, 2).T
        middle = _squash(np.tile(np.linspace(-8, 8, BINS), GATES))
        self.map = np.clip((one + 4 * middle) / (zero + one + 4), 1e-6, 1 - 1e-6).astype(np.float32)

    def bits_of(self, gram: np.ndarray) -> np.ndarray:
        """What coding each gram's symbol in its context costs."""
        cost = np.zeros(len(gram), np.float32)
        for a in range(0, len(gram), SLICE):  # small enough for a core's cache
            some = gram[a: a + SLICE]
            bases = [_bases(some, order, bits) for order, bits in zip(ORDERS, self.bits, strict=True)]
            inputs = np.full((4, len(ORDERS) + 1, len(some)), 0.3, np.float32)
            for half in range(2):
                nodes, ones = _decisions(some, half)
                known = np.zeros(nodes.shape, np.int8)
                for k, (table, base) in enumerate(zip(self.tables, bases, strict=True)):
                    for place in range(4):
                        known[place] += _logits(table[base[half] ^ nodes[place]], inputs[place, k])
                for place, one in enumerate(ones):
                    bit, level = half * 4 + place, known[place].astype(np.int64)
                    x = _mixed(inputs[place], level, self.weights[:, bit::8])
                    spot = _place(x)
                    low = np.minimum(spot.astype(np.int64), BINS - 2)
                    spot -= low.astype(np.float32)
                    low += level * (8 * BINS)
                    p = self.map[bit * BINS:].take(low, mode="clip")
                    p += (self.map[bit * BINS + 1:].take(low, mode="clip") - p) * spot
                    p += _squash(x)
                    p *= np.float32(0.5)
                    p = np.abs((1 - one).astype(np.float32) - p)  # of the bit as it is
                    np.maximum(p, np.float32(1e-7), out=p)
                    cost[a: a + SLICE] -= np.log2(p)
        return cost

    def text_bits(self, data: np.ndarray, bounds: np.ndarray, memo: _Memo) -> np.ndarray:
        total = np.zeros(len(bounds) - 1)
        for gram, row in _grams(data, bounds, iter(lambda: SCORED, None)):
            if not len(gram):
                continue
            cost = memo.costs(gram, self.bits_of)
            first, last = int(row[0]), int(row[-1])
            total[first: last + 1] += np.bincount(row - first, cost, last - first + 1)
        return total


def fit(train: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the texts of train (column text), and (key, c): counts of its hashed words and end tokens."""
    size = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = table_bits(size)
    learned = stash(train.select("text").mapInArrow(_trainer(bits), _LEARNED), "learned")
    vocabulary = stash(learned.where(F.col("kind") == WORD).groupBy("key").agg(F.sum("n").alias("c")), "vocabulary")
    ranges = sum(max(1, (1 << b) // RANGE) for b in bits)
    told = learned.where(F.col("kind") != WORD).select("part", "key", "n", "data").repartition(min(ranges, 200), "part").sortWithinPartitions("part", "key")
    merged = stash(told.mapInArrow(_merge, "part int, data binary"), "tables")
    return Model(bits, merged.collect()), vocabulary  # two bytes a slot, as many as MAX_BITS bounds


def score_texts(docs: DataFrame, held_out: Column) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (log10, unigrams with one added), score (log10 probability of the
    text), bits_per_byte.

    docs needs doc_id and text; other columns are ignored. held_out marks the rows that nothing is learned from; null counts as false.
    A-Z is lower-cased, words are what white space leaves, and each text ends with one end token, so null and empty texts score that
    token alone. Repeated rows are learned from repeatedly and score alike. An empty table gives an empty result; if all rows are held
    out, the model has no counts and every decision costs what its prior says. Weights are averaged over the tasks that read the
    training texts, so scores move a little with the way files are split; counts do not."""
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model, vocabulary = fit(docs.where(~F.col("held_out")))
    tokens, types = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("key")).first()
    return _score_rows(docs, model, vocabulary, tokens, types)


def _frequent(vocabulary: DataFrame) -> pd.DataFrame:
    """The most frequent words, as many whole count levels as fit the bound, by key."""
    level = F.floor(F.log("c") * 16).alias("level")
    room, least = FREQUENT, None
    for r in vocabulary.groupBy(level).count().orderBy(F.desc("level")).collect():  # a few hundred levels
        room -= r["count"]
        if room < 0:
            break
        least = r["level"]
    chosen = vocabulary.where(F.lit(False)) if least is None else vocabulary.where(level >= least)
    return chosen.select("key", "c").orderBy("key").toPandas()


def _score_rows(docs: DataFrame, model: Model, vocabulary: DataFrame, tokens: int, types: int) -> DataFrame:
    known = _frequent(vocabulary)
    scale = float(np.log10(float(tokens + types + 1)))  # one added to each known token and to the unknown one
    shared = docs.sparkSession.sparkContext.broadcast((model, known["key"].to_numpy(np.int64), known["c"].to_numpy(np.float64)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, key, count = shared.value
        memo = _Memo()
        for batch in _gathered(batches):
            data, bounds = raw(batch.column("text"))
            h, cut = words(data, bounds)
            n = np.diff(cut)
            # The end token follows each text's words.
            all_h = np.insert(h, cut[1:], _END_HASH).view(np.int64)
            row = np.repeat(np.arange(len(n)), n + 1)
            some, inverse = np.unique(all_h, return_inverse=True)
            spot = np.minimum(np.searchsorted(key, some), max(len(key) - 1, 0))
            hit = key[spot] == some if len(key) else np.zeros(len(some), bool)
            value = np.zeros(len(some))
            value[hit] = np.log10(count[spot[hit]] + 1.0)
            rare = np.flatnonzero(~hit[inverse])
            runs = np.concatenate([[0], np.cumsum(np.bincount(row[rare], minlength=len(n)))])
            out = pa.table({
                "doc_id": batch["doc_id"], "held_out": batch["held_out"], "rid": batch["rid"], "n_tokens": pa.array(n + 1),
                "n_known": pa.array(np.bincount(row, hit[inverse], len(n)).astype(np.int64)), "logs": pa.array(np.bincount(row, value[inverse], len(n))),
                "bits": pa.array(model.text_bits(data, bounds, memo)), "bytes": pa.array(np.diff(bounds)),
                "rare": pa.ListArray.from_arrays(pa.array(runs.astype(np.int32)), pa.array(all_h[rare]))})
            yield from out.combine_chunks().to_batches()

    kind = docs.schema["doc_id"].dataType.simpleString()
    part = stash(docs.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(
        look, f"doc_id {kind}, held_out boolean, rid long, n_tokens long, n_known long, logs double, bits double, bytes long, rare array<bigint>"), "rows")
    rare = part.select("rid", F.explode("rare").alias("key")).join(vocabulary, "key")  # words that training does not hold have no row
    rest = rare.groupBy("rid").agg(F.count("c").alias("k"), F.sum(F.log10(F.col("c") + 1.0)).alias("s"))
    out = part.drop("rare").join(rest, "rid", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("s", F.lit(0.0)) - F.col("n_tokens") * F.lit(scale)).alias("base_score"), (-F.col("bits") * float(np.log10(2.0))).alias("score"),
        (F.col("bits") / F.greatest(F.col("bytes"), F.lit(1))).alias("bits_per_byte"))
