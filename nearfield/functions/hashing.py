"""Deterministic pseudo-random columns.

Random reorderings and draws are functions of a seed and an id, so a recomputed task gives the
same rows again and the same expression can be written in SQL.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO32 = 1 << 32
_MULTIPLIER = 0x45D9F3B
# Odd steps per low and high word of a position, for the two words of a draw. They are small enough
# that a product with any 32-bit word fits a bigint.
_STEPS = ((625341585, 1664525), (1103515245, 22695477))
_OTHER_WORD = 2654435769


def shuffle_key(seed: int, id_col: Column) -> Column:
    """Sort key of a seeded random order: the md5 of ``seed:id``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string")))


def hash_draw(seed: int, id_col: Column, n: Column) -> Column:
    """An integer in ``[0, n)`` from the first 60 bits of the shuffle key."""
    head = F.conv(F.substring(shuffle_key(seed, id_col), 1, 15), 16, 10).cast("long")
    return F.pmod(head, n.cast("long"))


def mix32(x: Column) -> Column:
    """A 32-bit integer mixer in plain bigint arithmetic (stays inside generated code)."""
    for _ in range(2):
        x = (F.shiftright(x, 16).bitwiseXOR(x) * F.lit(_MULTIPLIER)) % F.lit(_TWO32)
    return F.shiftright(x, 16).bitwiseXOR(x)


def mix32_sql(x: str) -> str:
    """SQL text of :func:`mix32` for an engine with ``xor`` and ``>>``."""
    for _ in range(2):
        x = f"((xor(({x}) >> 16, {x}) * {_MULTIPLIER}) % {_TWO32})"
    return f"xor(({x}) >> 16, {x})"


def replicate_key(seed: int, replicate: Column) -> Column:
    return mix32((replicate + F.lit(seed)) % F.lit(_TWO32))


def replicate_key_sql(seed: int, replicate: str) -> str:
    return mix32_sql(f"(({replicate}) + {seed}) % {_TWO32}")


def replicate_draw(key: Column, i: Column, n: Column) -> Column:
    """The ``i``-th draw with replacement from ``[0, n)`` of the replicate with this key.

    Two mixed words make 63 bits, so that tables of any size are drawn from evenly.
    """
    low, high = i % F.lit(_TWO32), F.shiftright(i, 32)
    (a, b), (c, d) = _STEPS
    first = mix32((key + low * F.lit(a) + high * F.lit(b)) % F.lit(_TWO32))
    second = mix32((key + F.lit(_OTHER_WORD) + low * F.lit(c) + high * F.lit(d)) % F.lit(_TWO32))
    return (first * F.lit(1 << 31) + F.shiftright(second, 1)) % n


def _mix32_array(x: np.ndarray) -> np.ndarray:
    """:func:`mix32` of an array of unsigned 32-bit numbers, which is changed."""
    for _ in range(2):
        x ^= x >> np.uint32(16)
        x *= np.uint32(_MULTIPLIER)
    x ^= x >> np.uint32(16)
    return x


def replicate_keys(seed: int, replicate: np.ndarray) -> np.ndarray:
    """:func:`replicate_key` of a whole array."""
    return _mix32_array((replicate + seed).astype(np.uint32)).astype(np.int64)


def drawn_ranks(key: np.ndarray, i: np.ndarray, n: np.ndarray) -> np.ndarray:
    """:func:`replicate_draw` of whole arrays."""
    key, low = key.astype(np.uint32), i.astype(np.uint32)
    high = (i >> 32).astype(np.uint32)
    (a, b), (c, d) = _STEPS
    first = _mix32_array(key + low * np.uint32(a) + high * np.uint32(b))
    second = _mix32_array(key + np.uint32(_OTHER_WORD) + low * np.uint32(c) + high * np.uint32(d))
    word = (first.astype(np.uint64) << np.uint64(31)) + (second >> np.uint32(1))
    return (word % n.astype(np.uint64)).astype(np.int64)


def replicate_draw_sql(key: str, i: str, n: str) -> str:
    """SQL text of :func:`replicate_draw`."""
    low, high = f"(({i}) % {_TWO32})", f"(({i}) >> 32)"
    (a, b), (c, d) = _STEPS
    first = mix32_sql(f"(({key}) + {low} * {a} + {high} * {b}) % {_TWO32}")
    second = mix32_sql(f"(({key}) + {_OTHER_WORD} + {low} * {c} + {high} * {d}) % {_TWO32}")
    return f"((({first}) * {1 << 31} + (({second}) >> 1)) % ({n}))"
