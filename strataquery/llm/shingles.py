"""Word shingles of whole batches of texts, by array arithmetic on their UTF-8 bytes.

A word's hash runs over its bytes eight at a time, each eight mixed in by a bijection of 64 bits, so words of up to
eight bytes and equal length never collide and longer ones only by chance; words of more than `LONG` bytes are hashed by
xxh3. A shingle's hash combines those of its words. Texts are handled in blocks of about `BLOCK` bytes cut between
words, so memory doesn't follow a text's length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

BLOCK, LONG = 1 << 20, 64
_BASE = 0x9E3779B97F4A7C15
_MIX = (np.uint64(_BASE), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h + _MIX[0]
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


def _word_hashes(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a block; `first` marks the bytes at which a text begins."""
    word = ~_SPACE[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1] | first[1:]
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    s, e = np.flatnonzero(begin), np.flatnonzero(last) + 1
    low = np.concatenate((_LOWER[data], np.zeros(8, np.uint8)))
    eights = np.ndarray(len(data) + 1, "<u8", low, strides=(1,))  # the eight bytes from each byte on
    size = e - s
    h = mix(size.astype(np.uint64))
    for k in range(0, min(int(size.max(initial=0)), LONG), 8):
        i = np.flatnonzero((size > k) & (size <= LONG))
        h[i] = mix(h[i] ^ (eights[s[i] + k] & _KEEP[np.minimum(size[i] - k, 8)]))
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(low[s[i] : e[i]].tobytes())
    return s, h


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and each text's range of them. offsets: n + 1 places in data."""
    base, end = int(offsets[0]), int(offsets[-1])
    first = np.zeros(end - base + 1, bool)
    first[offsets - base] = True
    data, first = data[base:end], first[:-1]
    starts, hashes, at = [], [], 0
    while at < len(data):
        cut = min(at + BLOCK, len(data))
        while cut < len(data):  # on to the next white space or text
            free = np.flatnonzero(_SPACE[data[cut : cut + BLOCK]] | first[cut : cut + BLOCK])
            cut = min(len(data), cut + (int(free[0]) if len(free) else BLOCK))
            if len(free):
                break
        s, h = _word_hashes(data[at:cut], first[at:cut])
        starts.append(s + at)
        hashes.append(h)
        at = cut
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.searchsorted(s, offsets - base)


def shingle_sets(texts: pa.Array, n: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles (of all its words where there are fewer)."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    w, ranges = word_hashes(data, offsets)
    full = max(0, len(w) - n + 1)
    h = np.full(full, n, np.uint64)
    for i in range(n):
        h = h * _MIX[0] + w[i : full + i]
    h = mix(h)
    out = []
    for a, b in zip(ranges[:-1].tolist(), ranges[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(h[a : b - n + 1]))
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for x in w[a:b]:
                one = one * _MIX[0] + x
            out.append(mix(one))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def batches_of_sets(batches: Iterator[pa.RecordBatch], size: int = 4 * BLOCK) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, sets) of rows (id, text), in pieces of about `size` bytes of text."""
    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(1).cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        at = 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
            yield ids[at:to], shingle_sets(texts.slice(at, to - at))
            at = to
