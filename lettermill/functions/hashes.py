"""FNV-1a and digests. Native tables use sha2 and xxhash64 in the JVM; FNV only serves the segment format."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: FNV-1a, 64 bits (fixed values).
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
#: The multiplier that the segment format's writers use (fixed value).
SEGMENT_PRIME = 0x1000000001B3
_MASK = (1 << 64) - 1


#: Bytes hashed at once.
_BLOCK = 1 << 16


@lru_cache
def _powers(prime: int) -> np.ndarray:
    """Powers of the multiplier from the block's size down to one, modulo 2**64."""
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.full(_BLOCK, prime & _MASK, np.uint64))[::-1]


def _inputs(block: np.ndarray, low: int, prime: int) -> np.ndarray:
    """The low byte of the state, mixed with each byte of the block, from the low byte before it.

    Bit k of the next state is bit k of what was mixed, changed by lower bits only (the multiplier is odd), so each bit
    is a running exclusive or, once the lower ones are known.
    """
    out, odd = np.zeros(len(block), np.uint8), np.uint16(prime & 0xFF)
    for k in range(8):
        change = ((out.astype(np.uint16) * odd) >> np.uint16(k)).astype(np.uint8) & np.uint8(1)
        bits = (block >> np.uint8(k)) & np.uint8(1)
        bits[1:] ^= change[:-1]
        bits[0] ^= low >> k & 1
        out |= np.bitwise_xor.accumulate(bits) << np.uint8(k)
    return out


def fnv64(data: bytes, prime: int = SEGMENT_PRIME) -> int:
    """The hash as the sum of (mixed low byte - low byte) times the powers of the multiplier, block by block."""
    value = FNV_OFFSET
    if len(data) < 256:
        for byte in data:
            value = (value ^ byte) * prime & _MASK
        return value
    held, powers = np.frombuffer(data, np.uint8), _powers(prime)
    for start in range(0, len(held), _BLOCK):
        block = held[start : start + _BLOCK]
        mixed = _inputs(block, value & 0xFF, prime)
        with np.errstate(over="ignore"):
            steps = (mixed.astype(np.int64) - (mixed ^ block)).astype(np.uint64)
            value = (value * pow(prime, len(block), 1 << 64) + int((steps * powers[_BLOCK - len(block) :]).sum(dtype=np.uint64))) & _MASK
    return value


@F.pandas_udf(StringType())
def fnv64_hex(data: pd.Series) -> pd.Series:
    """FNV of binary values in hexadecimal; null for null."""
    return data.map(lambda x: None if x is None else f"{fnv64(bytes(x)):016x}")
