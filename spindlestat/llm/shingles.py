"""Word shingles of texts as sets of 64-bit hashes, and their HyperMinHash registers, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import Memo

#: Seeds, buckets of each seed, registers of a band. A band is BAND neighbouring registers of one seed.
SEEDS, BUCKETS, BAND = 10, 24, 6
REGISTERS = SEEDS * BUCKETS
BANDS = REGISTERS // BAND
#: A register: 0 for an empty bucket, else 1 + leading zeros (at most TOP_ZEROS) * 16 + the next 4 bits.
TOP_ZEROS, MANTISSA = 14, 16
U = np.uint64
SEED = (np.arange(1, SEEDS + 1, dtype=U) * U(0x9E3779B97F4A7C15))[:, None]
FIRST = (np.arange(SEEDS) * BUCKETS)[:, None]
#: Shingles that are hashed at a time.
CHUNK = 1 << 14


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


class Shingler:
    """Texts (UTF-8) to sorted arrays of distinct shingle hashes: words are runs of non-space bytes, A-Z lower-cased."""

    def __init__(self, words: int):
        self.words, self.ids = words, Memo(xxhash.xxh3_64_intdigest)
        self.factors = mix(np.arange(1, words + 1, dtype=U)) | U(1)

    def __call__(self, text: bytes) -> np.ndarray:
        """Empty without words; one shingle, the whole sequence, with fewer words than a shingle has."""
        words = text.lower().split()
        h = np.fromiter(map(self.ids.__getitem__, words), U, len(words))
        self.ids.trim()
        if not len(h):
            return h
        k = min(self.words, len(h))
        total = np.full(len(h) - k + 1, k, U)
        for i in range(k):
            total += mix(h[i : len(h) - k + 1 + i] ^ U(i)) * self.factors[i]
        return np.unique(mix(total))


def registers(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash: for each seed every shingle falls into a bucket; a bucket keeps its least hash, compressed."""
    out = np.zeros(REGISTERS, np.uint8)
    if not len(shingles):
        return out
    least = np.full(REGISTERS, np.iinfo(U).max, U)
    for at in range(0, len(shingles), CHUNK):
        h = mix(shingles[at : at + CHUNK] + SEED)
        bucket = ((h >> U(48)) * U(BUCKETS) >> U(16)).astype(np.int64) + FIRST
        np.minimum.at(least, bucket.ravel(), (h << U(16)).ravel())
    b = np.flatnonzero(least < np.iinfo(U).max)
    value = least[b]
    zeros = np.clip(63 - np.floor(np.log2(np.maximum(value.astype(np.float64), 1))), 0, TOP_ZEROS).astype(np.int64)
    mantissa = ((value << (zeros + 1).astype(U)) >> U(60)).astype(np.int64)
    out[b] = 1 + zeros * MANTISSA + mantissa
    return out


def collisions(n: int, m: int) -> float:
    """The share of registers that are equal by chance between sets without common shingles, for n and m shingles a bucket: a sum over register values."""
    values = np.arange(TOP_ZEROS + 2)
    high = 2.0 ** -values[:-1]
    low = np.concatenate([2.0 ** -values[1:-1], [0.0]])
    cut = low[:, None] + (high - low)[:, None] * np.arange(MANTISSA + 1) / MANTISSA
    at = lambda size: (1 - cut[:, :-1]) ** size - (1 - cut[:, 1:]) ** size
    return float((at(max(n, 1)) * at(max(m, 1))).sum())


def estimate(a: np.ndarray, b: np.ndarray, chance: float) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of one row of registers against many, corrected for chance collisions; and the registers each rests on."""
    used = (a > 0) | (b > 0)
    n = used.sum(axis=-1)
    equal = ((a == b) & used).sum(axis=-1)
    return (equal - n * chance) / np.maximum(n * (1 - chance), 1e-9), n
