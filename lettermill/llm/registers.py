"""HyperMinHash signatures of shingle sets: leading-zero counts plus mantissa bits, one register a bucket."""

from __future__ import annotations

import numpy as np
import xxhash

#: Registers of a signature, and how many of them make a band. A pair of sets with Jaccard similarity s shares
#: no band with probability (1 - s**ROWS) ** BANDS: 2e-8 at 0.85.
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
MANTISSA = 10
SHINGLE = 5
#: Words whose hashes a task remembers.
CACHE = 150_000

_u = np.uint64
_POWERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> _u(30))) * _u(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _u(27))) * _u(0x94D049BB133111EB)
    return x ^ (x >> _u(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's five-word shingles.

    Words are runs of bytes other than ASCII white space, A-Z in lower case. Fewer words than a shingle has: the
    whole sequence counts as one. No words or no text: empty.
    """
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    if n < SHINGLE:
        value = np.array([n], np.uint64)
        for i in range(n):
            value = mixed(value * _POWERS[0] + w[i : i + 1])
        return value
    m = n - SHINGLE + 1
    x = w[:m] * _POWERS[0]
    for j in range(1, SHINGLE):
        x = mixed(x) + w[j : j + m] * _POWERS[j]
    return np.unique(mixed(x))


def fingerprint(shingles: np.ndarray) -> bytes:
    """128 bits of the whole set; equal sets have equal ones."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def raw_registers(shingles: np.ndarray) -> np.ndarray:
    """One register a bucket: 1 + (leading zeros << MANTISSA | mantissa) of the bucket's least value; 0: empty."""
    out = np.zeros(REGISTERS, np.uint16)
    if len(shingles):
        bucket = ((shingles >> _u(32)) * _u(REGISTERS)) >> _u(32)  # ascending, as the shingles are
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        least = np.minimum.reduceat(mixed(shingles ^ _POWERS[1]), starts) >> _u(11)
        exponent = np.frexp(least.astype(np.float64))[1].astype(np.uint64)  # exact: 53 bits
        zeros = _u(53) - exponent
        mantissa = ((least << zeros) >> _u(52 - MANTISSA)) & _u((1 << MANTISSA) - 1)
        out[bucket[starts].astype(np.int64)] = (((zeros << _u(MANTISSA)) | mantissa) + _u(1)).astype(np.uint16)
    return out


def _probe(step: int) -> np.ndarray:
    """The bucket that each empty bucket looks at in the given step; the same for all sets."""
    x = mixed(np.arange(REGISTERS, dtype=np.uint64) + _u(step * REGISTERS + 1))
    return (((x >> _u(32)) * _u(REGISTERS)) >> _u(32)).astype(np.int64)


def densified(registers: np.ndarray) -> np.ndarray:
    """Rows of registers; an empty one borrows from the first filled bucket of its own probe sequence."""
    out = registers.copy()
    todo = np.flatnonzero((registers == 0).any(axis=1) & (registers != 0).any(axis=1))
    step = 0
    while len(todo):
        step += 1
        source, now = registers[todo][:, _probe(step)], out[todo]
        out[todo] = now = np.where(now == 0, source, now)
        todo = todo[(now == 0).any(axis=1)]
    return out


def band_keys(filled: np.ndarray) -> np.ndarray:
    """A 64-bit key for each row and band of filled registers; its low part is the band's number."""
    x = filled.reshape(len(filled), BANDS, ROWS).astype(np.uint64)
    packed = x[:, :, 0] | x[:, :, 1] << _u(16) | x[:, :, 2] << _u(32) | x[:, :, 3] << _u(48)
    keys = mixed(packed) * _u(BANDS) + np.arange(BANDS, dtype=np.uint64)
    return keys.view(np.int64)


#: Chance that two registers of unrelated sets agree: leading zeros are geometric, mantissas uniform.
CHANCE = sum(4.0**-z for z in range(1, 54)) / (1 << MANTISSA)


def estimated(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity estimated from filled registers, corrected for registers that agree by chance."""
    same = float(np.mean(a == b))
    return max(0.0, (same - CHANCE) / (1.0 - CHANCE))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, on whole sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int(np.count_nonzero(large[at] == small)) if len(large) else 0
    return 100 * both >= percent * (len(a) + len(b) - both)
