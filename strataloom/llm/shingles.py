"""Sets of word shingles of many texts at once, as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of text that are worked on at a time.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * C2
    x = (x ^ (x >> np.uint64(27))) * C3
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, A-Z lower-cased unless told not to, of all texts in a row, and where each text's words begin (one more)."""
    data = b"\n".join(texts)
    if fold:
        data = data.translate(_FOLD)
    raw = np.frombuffer(data + bytes(16), np.uint8)
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~_SPACE[raw[: len(data)]]
    edge = np.diff(solid)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    eights = np.ndarray((len(raw) - 7,), "<u8", raw.data, 0, (1,))
    left = ends - starts
    h = mix(left.astype(np.uint64) * C1)
    at, own = starts, np.arange(len(starts))
    while len(own):
        part = eights[at] & _MASK[np.minimum(left, 8)]
        h[own] = mix(h[own] ^ (part * C1 + C3))
        more = left > 8
        own, at, left = own[more], at[more] + 8, left[more] - 8
    text_starts = np.zeros(len(texts), np.int64)
    np.cumsum([len(t) + 1 for t in texts[:-1]], out=text_starts[1:])
    return h, np.append(np.searchsorted(starts, text_starts), len(starts))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its `width`-word shingles.

    A text of fewer words has its whole sequence as its one shingle; a text without words has none.
    """
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        stop, size = at + 1, len(texts[at])
        while stop < len(texts) and size + len(texts[stop]) <= SLICE:
            size += len(texts[stop])
            stop += 1
        h, bounds = word_hashes(texts[at:stop])
        s = mix(np.full(max(0, len(h) - width + 1), width, np.uint64) + C2)
        for k in range(width):
            s = mix(s * C1 + h[k : k + len(s)])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= width:
                own = np.sort(s[a : b - width + 1])
                out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
            elif b > a:
                one = mix(np.full(1, b - a, np.uint64) + C3)
                for k in range(a, b):
                    one = mix(one * C1 + h[k : k + 1])
                out.append(one)
            else:
                out.append(np.empty(0, np.uint64))
        at = stop
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    a, b = int(mix(s ^ C1).sum(dtype=np.uint64)), int(mix(mix(s) + C2).sum(dtype=np.uint64))
    return tuple(int(np.uint64(x).view(np.int64)) for x in (a, b))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted distinct arrays."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
