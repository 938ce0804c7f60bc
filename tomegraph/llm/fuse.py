"""Static binary-fuse filters over 64-bit keys, 16-bit fingerprints: no false negatives, about 1.5e-5 false positives."""

from __future__ import annotations

import numpy as np

U = np.uint64
_M1, _M2 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser of the keys under a seed."""
    with np.errstate(over="ignore"):
        x = x + U(seed)
        x = (x ^ (x >> U(33))) * _M1
        x = (x ^ (x >> U(33))) * _M2
        return x ^ (x >> U(33))


def _shape(n: int) -> tuple[int, int]:
    """Segment length (a power of two) and number of segments for n keys."""
    length = 1 << int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))
    length = min(max(length, 4), 1 << 18)
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    capacity = int(np.ceil(n * factor)) + 8
    return length, max(-(-capacity // length), 3)


def _slots(h: np.ndarray, length: int, segments: int) -> np.ndarray:
    """The three slots of each hash, in three consecutive segments."""
    first = ((h >> U(32)) * U(segments - 2)) >> U(32)
    base = first.astype(np.int64) * length
    mask = U(length - 1)
    return np.stack([base + (h & mask).astype(np.int64), base + length + ((h >> U(13)) & mask).astype(np.int64), base + 2 * length + ((h >> U(26) ^ h >> U(45)) & mask).astype(np.int64)])


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> U(29))) & U(0xFFFF)).astype(np.uint16)


def build(keys: np.ndarray) -> bytes:
    """Filter of distinct uint64 keys: little-endian header (seed, length, segments), then fingerprints."""
    keys = np.unique(np.asarray(keys, np.uint64))
    length, segments = _shape(len(keys))
    for seed in range(1, 400):
        if seed % 20 == 0:
            segments += 1 + segments // 10
        h = mix(keys, seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        slots = _slots(h, length, segments)
        order = _peel(slots, len(keys), length * segments)
        if order is None:
            continue
        table = np.zeros(length * segments, np.uint16)
        prints = _prints(h)
        for idx, own in reversed(order):  # a layer's own slots are free of each other
            s = slots[:, idx]
            table[own] = 0
            table[own] = prints[idx] ^ table[s[0]] ^ table[s[1]] ^ table[s[2]]
        return np.array([seed, length, segments], "<u4").tobytes() + table.astype("<u2").tobytes()
    raise RuntimeError("no seed peels these keys")


def _peel(slots: np.ndarray, n: int, size: int):
    """Layers (key indices, the slot each key owns), or None when the keys don't peel."""
    count = np.bincount(slots.ravel(), minlength=size)
    xor = np.zeros(size, np.int64)
    for row in slots:
        np.bitwise_xor.at(xor, row, np.arange(n))
    layers, left = [], n
    ready = np.flatnonzero(count == 1)
    while len(ready):
        keys, pick = np.unique(xor[ready], return_index=True)
        own = ready[pick]
        layers.append((keys, own))
        left -= len(keys)
        touched = slots[:, keys]
        np.subtract.at(count, touched.ravel(), 1)
        np.bitwise_xor.at(xor, touched.ravel(), np.tile(keys, 3))
        near = np.unique(touched)
        ready = near[count[near] == 1]
    return None if left else layers


def contains(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """Boolean per key; true for every key the filter was built from."""
    seed, length, segments = (int(x) for x in np.frombuffer(blob, "<u4", 3))
    table = np.frombuffer(blob, "<u2", offset=12)
    h = mix(np.asarray(keys, np.uint64), seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    s = _slots(h, length, segments)
    return (table[s[0]] ^ table[s[1]] ^ table[s[2]]) == _prints(h)
