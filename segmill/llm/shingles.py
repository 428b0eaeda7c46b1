"""Vectorised character bigrams and circulant MinHash signatures (NumPy, batch at a time)."""

from __future__ import annotations

import functools

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
UNIVERSE_BITS = 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def bigram_elements(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Multiset elements of every text: ``(hashes, offsets)``.

    An element is a bigram together with its occurrence number inside the text, so the Jaccard similarity
    of two element sets is that of the bigram multisets. Texts need two characters or more.
    """
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    pair = (points[:-1] << np.uint64(21)) | points[1:]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    keep = np.ones(len(points) - 1, bool)
    keep[starts[1:-1] - 1] = False  # bigrams across two texts
    pair = pair[keep]
    counts = sizes - 1
    offsets = np.concatenate(([0], np.cumsum(counts)))
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), counts)
    order = np.lexsort((pair, owner))
    sp, so = pair[order], owner[order]
    new = np.ones(len(sp), bool)
    new[1:] = (sp[1:] != sp[:-1]) | (so[1:] != so[:-1])
    run = np.flatnonzero(new)
    occurrence = np.arange(len(sp)) - np.repeat(run, np.diff(np.append(run, len(sp))))
    return _mixed(_mixed(sp) + occurrence.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), offsets


def element_slots(hashes: np.ndarray, bits: int = UNIVERSE_BITS) -> np.ndarray:
    """The place of every element in the universe of the permutations."""
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


@functools.cache
def _permutations(bits: int, coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_000_003)
    size = 1 << bits
    sigma = rng.permutation(size).astype(np.int64)
    pi = -np.log1p(-(rng.permutation(size) + 0.5) / size)  # the ranks of a permutation as exponential variates
    return sigma, np.concatenate((pi, pi[:coordinates])).astype(np.float32)


def signatures(hashes: np.ndarray, offsets: np.ndarray, coordinates: int, weights: np.ndarray | None = None, bits: int = UNIVERSE_BITS) -> np.ndarray:
    """Circulant MinHash: two permutations give all coordinates.

    The first permutation places an element, the second is read circularly from there: coordinate k is
    the least value of the second one shifted by k over the placed elements. All coordinates of an element
    are one contiguous slice. With ``weights`` (of every slot of the universe) the values are divided by
    the element's weight, so two sets agree with the probability of their weighted Jaccard similarity.
    """
    sigma, pi = _permutations(bits, coordinates)
    slots = element_slots(hashes, bits)
    placed = sigma[slots]
    slices = np.lib.stride_tricks.sliding_window_view(pi, coordinates)
    inverse = None if weights is None else (1.0 / weights[slots]).astype(np.float32)[:, None]
    out = np.empty((len(offsets) - 1, coordinates), np.float32)
    block = 64
    for i in range(0, len(out), block):
        j = min(i + block, len(out))
        lo, hi = offsets[i], offsets[j]
        values = slices[placed[lo:hi]]
        if inverse is not None:
            values *= inverse[lo:hi]
        np.minimum.reduceat(values, offsets[i:j] - lo, axis=0, out=out[i:j])
    return out.view(np.uint32)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of every band, the band's number mixed in: shape (texts, bands)."""
    part = signature[:, : bands * rows].astype(np.uint64).reshape(len(signature), bands, rows)
    key = np.broadcast_to(_mixed(np.arange(1, bands + 1, dtype=np.uint64)), (len(signature), bands)).copy()
    for r in range(rows):
        key = _mixed(key + part[:, :, r] * np.uint64(0xA0761D6478BD642F))
    return key


def shared_counts(left: list[str], right: list[str]) -> np.ndarray:
    """Number of shared bigrams, with multiplicity, of every pair of texts."""
    n = len(left)
    ha, oa = bigram_elements(left)
    hb, ob = bigram_elements(right)
    owners = np.concatenate((np.repeat(np.arange(n), np.diff(oa)), np.repeat(np.arange(n), np.diff(ob))))
    both = np.concatenate((ha, hb))
    order = np.lexsort((both, owners))
    s, o = both[order], owners[order]
    same = (s[1:] == s[:-1]) & (o[1:] == o[:-1])  # an element is at most once on each side
    return np.bincount(o[1:][same], minlength=n)


def bit_sketches(texts: list[str], words: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """``(bits, counts)``: of every text the bits its elements set in ``64 * words``, and their number."""
    hashes, offsets = bigram_elements(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    bit = (hashes & np.uint64(64 * words - 1)).astype(np.int64)
    out = np.zeros((len(texts), words), np.uint64)
    np.bitwise_or.at(out, (owner, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return out, np.diff(offsets)
