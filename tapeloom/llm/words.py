"""Word and shingle hashes of many texts at once, on the bytes of their UTF-8 form."""

from __future__ import annotations

import numpy as np

SPACE = tuple([0x20, *range(0x09, 0x0E)])
_MUL = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def separators(codes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(codes)] = True
    return out


def joined(texts: list[bytes | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array with a space after each, and where each begins."""
    parts = [t or b"" for t in texts]
    data = b" ".join(parts) + b" "
    if lower:
        data = data.lower()  # of bytes: A-Z only
    sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    return np.frombuffer(data, np.uint8), np.cumsum(sizes) - sizes


def word_hashes(data: np.ndarray, begins: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of its text). ``sep`` marks the bytes between words; a space must be one."""
    inside = ~sep[data]
    if not inside.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, lens = edges[::2], edges[1::2] - edges[::2]
    first = np.cumsum(lens) - lens
    place = np.arange(first[-1] + lens[-1]) - np.repeat(first, lens)
    powers = np.cumprod(np.full(int(lens.max()), _MUL))
    value = (data[inside].astype(np.uint64) + np.uint64(1)) * powers[place]
    hashes = mix(np.add.reduceat(value, first) + lens.astype(np.uint64) * _STEP)
    return hashes, np.searchsorted(begins, starts, side="right") - 1


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words, across text borders too: callers mask those."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(k))
    for j in range(k):
        out = out * _STEP + words[j:j + n]
    return mix(out)


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of pairs of words, as ``grams`` gives them for neighbours."""
    return mix((np.full(len(left), np.uint64(2)) * _STEP + left) * _STEP + right)


def shingle_sets(texts: list[bytes | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text, sorted: (hashes, offsets with one more entry than texts).

    A text of fewer words gives one shingle of all its words, a text without words none.
    """
    data, begins = joined(texts)
    words, owner = word_hashes(data, begins, separators(SPACE))
    count = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
    first = np.cumsum(count) - count
    g = grams(words, k)
    whole = owner[:len(g)] == owner[k - 1:] if len(g) else np.zeros(0, bool)
    hashes, own = [g[whole]], [owner[:len(g)][whole]]
    for n in range(1, k):
        short = np.flatnonzero(count == n)
        if len(short):
            h = np.full(len(short), np.uint64(n))
            for j in range(n):
                h = h * _STEP + words[first[short] + j]
            hashes.append(mix(h))
            own.append(short)
    hashes, own = np.concatenate(hashes), np.concatenate(own)
    order = np.lexsort((hashes, own))
    hashes, own = hashes[order], own[order]
    if len(hashes):
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (own[1:] != own[:-1])])
        hashes, own = hashes[new], own[new]
    return hashes, np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(texts)))]).astype(np.int64)
