"""Portable hashes: the same value in every engine and under every partitioning.

Random choices are an order by `order_key`; nothing depends on a generator's state or on
where a row sits. MinHash uses a 31-bit prime so that products stay below 2^62.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1
NUM_PERM = 128
SEED = 42


def order_key(row_id: Column | str, salt: str, seed: int = SEED) -> Column:
    """32 hex digits, uniformly distributed, that order rows independently of storage."""
    row_id = F.col(row_id) if isinstance(row_id, str) else row_id
    return F.md5(F.concat(F.lit(f"{salt}:{seed}:"), row_id.cast("string")))


def text_hash(text: Column) -> Column:
    """60 bits of md5 as a BIGINT."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def token_hash(token: Column) -> Column:
    """A token as a number below `PRIME`."""
    return text_hash(token) % F.lit(PRIME)


def _digest(text: str | bytes) -> int:
    return int(hashlib.md5(text.encode() if isinstance(text, str) else text).hexdigest()[:15], 16)


def token_hashes(tokens: pa.Array) -> np.ndarray:
    """`token_hash` of each token in an array, every different one hashed once."""
    coded = tokens.dictionary_encode()
    numbers = [_digest(t) % PRIME for t in coded.dictionary.cast(pa.binary()).to_pylist()]
    return np.array(numbers, dtype=np.int64)[coded.indices.to_numpy()]


def permutations(num_perm: int = NUM_PERM) -> list[tuple[int, int]]:
    """Multiplier and offset per permutation, derived from md5 of its number."""
    return [
        (1 + _digest(f"multiplier:{s}") % (PRIME - 1), _digest(f"offset:{s}") % PRIME)
        for s in range(num_perm)
    ]
