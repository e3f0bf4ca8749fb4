"""Words and word shingles of a batch of texts as 64-bit hashes, computed over the whole batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tablewise.llm.shared import SPACES, texts_of

U = np.uint64
PIECE = 4 << 20  # bytes hashed at a time

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every other (the public SplitMix64 finaliser)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * _ODD)


def raw(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column and the n + 1 bounds between them."""
    a = texts_of(column)
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset: a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def _hash_piece(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in a piece that cuts no word, and where each begins. first: positions at which a text begins."""
    inside = ~_SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    start[first] = inside[first]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, U), np.zeros(0, np.int64)
    begins = np.flatnonzero(start[at])
    lengths = np.diff(begins, append=len(at))
    place = np.arange(len(at)) - np.repeat(begins, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _ODD, U))
    h = np.add.reduceat(_BYTE[_LOWER[data[at]]] * powers[place], begins)
    return mix(h + lengths.astype(U)), at[begins]


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased (A-Z) words and the n + 1 bounds between the texts. Long batches go piece by piece."""
    hashes, places, begin = [], [], 0
    while begin < len(data):
        end = min(begin + PIECE, len(data))
        while end < len(data) and not _SPACE[data[end]]:  # a word is never cut
            gap = np.flatnonzero(_SPACE[data[end: end + PIECE]])
            end = end + int(gap[0]) if len(gap) else min(end + PIECE, len(data))
        inner = bounds[(bounds >= begin) & (bounds < end)] - begin
        h, at = _hash_piece(data[begin:end], inner)
        hashes.append(h)
        places.append(at + begin)
        begin = end
    h = np.concatenate(hashes) if hashes else np.zeros(0, U)
    at = np.concatenate(places) if places else np.zeros(0, np.int64)
    return h, np.searchsorted(at, bounds)


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, one after the other, and the bounds. A text of fewer words than the width gives its whole
    sequence as one shingle; one without words gives none."""
    h, cut = words(*raw(column))
    rolled = np.zeros(max(len(h) - width + 1, 0), U)
    for k in range(width):
        rolled += h[k: len(h) - width + 1 + k] * U(2 * k + 0x1000193)
    rolled = mix(rolled + U(width))
    sets, sizes = [], np.zeros(len(cut) - 1, np.int64)
    for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        if b - a >= width:
            s = np.unique(rolled[a: b - width + 1])
        elif b > a:
            odd = np.arange(b - a, dtype=U) * U(2) + U(0x1000193)
            s = mix((h[a:b] * odd).sum(dtype=U, keepdims=True) + U(b - a))
        else:
            continue
        sets.append(s)
        sizes[i] = len(s)
    return (np.concatenate(sets) if sets else np.zeros(0, U)), np.concatenate([[0], np.cumsum(sizes)])
