"""Deterministic pseudo-random numbers: a linear congruential sequence, and orders by hash.

The sequence is the compatibility mode (exact in 64-bit integers). Everything distributed orders
rows by the md5 of `id:seed` instead, which needs no positions and is the same in any partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The recurrence's multiplier, increment and mask, and the hash's start and prime.
MULTIPLIER, INCREMENT, MASK = 1664525, 1013904223, 0x7FFFFFFF
HASH_START, HASH_PRIME = 0x811C9DC5, 0x01000193


def lcg(seed: int) -> Callable[[], float]:
    """Numbers from 0 to 1 (both included) in sequence."""
    state = int(seed) & MASK

    def draw() -> float:
        nonlocal state
        state = (state * MULTIPLIER + INCREMENT) & MASK
        return state / MASK

    return draw


def shuffled(items: list, draw: Callable[[], float]) -> list:
    """A Fisher-Yates shuffle from the end."""
    out = list(items)
    for last in range(len(out) - 1, 0, -1):
        at = min(int(draw() * (last + 1)), last)
        out[last], out[at] = out[at], out[last]
    return out


def first_shuffled(items: list, k: int, draw: Callable[[], float]) -> list:
    """The first k of a shuffle, drawing k times."""
    out = list(items)
    n = len(out)
    for at in range(min(k, n)):
        other = min(at + int(draw() * (n - at)), n - 1)
        out[at], out[other] = out[other], out[at]
    return out[:k]


def hash_text(text: str) -> int:
    """31-bit multiplicative hash of a text's characters, in exact integers."""
    h = HASH_START
    for ch in text:
        h = ((h ^ ord(ch)) * HASH_PRIME) & MASK
    return h


#: What a seed is mixed from.
SEED_BASE, SEED_HASH, SEED_FOLD, SEED_MIX = 2654435761, 40503, 65537, 0x45D9F3B


def seed_for(candidate: str, fold: int, base: int) -> int:
    """The seed of one candidate on one fold."""
    mixed = (SEED_BASE * base + SEED_HASH * hash_text(candidate) + SEED_FOLD * fold) & MASK
    return ((mixed ^ mixed >> 16) * SEED_MIX) & MASK


def order_key(row_id: Column, seed: int | Column, *more: Column) -> Column:
    """The md5 that rows are ordered by: of id, seed and whatever else tells draws apart."""
    parts = [row_id.cast("string"), F.lit(":"), F.lit(seed).cast("string")]
    for m in more:
        parts += [F.lit(":"), m.cast("string")]
    return F.md5(F.concat(*parts).cast("binary"))
