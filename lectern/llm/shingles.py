"""Vectorised word shingles: 64-bit hashes of every run of k words of a batch of texts.

Words are the runs without white space of the text with A-Z in lower case. A word's hash is its polynomial modulo two
primes of 31 bits (modulo a power of two there are words that collide whatever the base); a shingle's is a chain of its
words' hashes through a mixer. No Python loop runs over words, and beside the texts memory is bounded by a block of bytes.
"""

from __future__ import annotations

import numpy as np

PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (1_402_024_253, 918_273_645)
#: Bytes of words that are hashed together; a longer word is a block of its own.
BLOCK = 1 << 20
#: Bytes of a word up to which sums of terms below 2^40 fit 64 bits; beyond it terms are reduced first.
PLAIN = 1 << 23

_CACHE: dict[int, np.ndarray] = {}


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """The first n powers of ``base``; those of usual words are kept."""
    held = _CACHE.get(base, np.ones(1, dtype=np.uint64))
    while len(held) < n:
        held = np.concatenate([held, held * np.uint64(pow(base, len(held), prime)) % np.uint64(prime)])
    if len(held) <= BLOCK:
        _CACHE[base] = held
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word data[start:end], which depends on its bytes alone; words are in order and do not touch."""
    out = np.zeros(len(starts), dtype=np.uint64)
    block = starts // BLOCK
    edges = np.r_[np.flatnonzero(np.r_[True, block[1:] != block[:-1]]), len(starts)].tolist() if len(starts) else []
    for lo, hi in zip(edges, edges[1:], strict=False):
        first = starts[lo:hi] - starts[lo]
        size = ends[lo:hi] - starts[lo:hi]
        part = data[starts[lo] : ends[hi - 1]]
        extent = np.diff(np.r_[first, len(part)])
        place = np.arange(len(part)) - np.repeat(first, extent)
        # what stands between words counts nothing
        value = np.where(place < np.repeat(size, extent), part.astype(np.uint64) + np.uint64(1), np.uint64(0))
        for prime, base in zip(PRIMES, BASES, strict=True):
            term = value * _powers(base, prime, int(extent.max()))[place]
            if len(part) > PLAIN:
                term %= np.uint64(prime)
            out[lo:hi] = out[lo:hi] << np.uint64(32) | np.add.reduceat(term, first) % np.uint64(prime)
    return mix(out)


def shingle_sets(texts: list[bytes], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct shingle hashes of text i, ascending, are hashes[bounds[i]:bounds[i + 1]].

    A text with fewer than k words has its whole word sequence as one shingle; without words it has none.
    """
    bodies = [b" ".join(t.lower().split()) for t in texts]
    data = np.frombuffer(b" ".join(bodies) + b" ", dtype=np.uint8)
    lengths = np.fromiter(map(len, bodies), dtype=np.int64, count=len(bodies))
    offsets = np.cumsum(lengths + 1) - lengths - 1
    blank = data == 32
    ends = np.flatnonzero(blank & np.r_[False, ~blank[:-1]])
    starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    doc = np.searchsorted(offsets, starts, side="right") - 1
    each = word_hashes(data, starts, ends)
    words = np.bincount(doc, minlength=len(bodies))
    first = np.cumsum(words) - words
    count = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    owner = np.repeat(np.arange(len(bodies)), count)
    begin = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]
    size = np.minimum(words[owner], k)
    value = mix(size.astype(np.uint64))
    with np.errstate(over="ignore"):
        for j in range(k):
            more = size > j
            if more.all():
                value = mix(value + each[begin + j])
            else:
                value[more] = mix(value[more] + each[begin[more] + j])
    # sorted in place, document by document: owner is ascending already
    edges = np.r_[np.cumsum(count) - count, len(value)]
    for lo_, hi_ in zip(edges.tolist(), edges[1:].tolist(), strict=False):
        value[lo_:hi_].sort()
    new = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])] if len(value) else np.zeros(0, dtype=bool)
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(bodies) + 1))
