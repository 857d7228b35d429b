"""Keyed random numbers.

Every random choice is a pure function of (seed, purpose, keys...): the first 32 bits
of md5 over ``seed|purpose|key1|key2...`` divided by 2**32. The value does not
depend on partitioning or task order, survives task retries unchanged, and the
same number can be computed in SQL (DuckDB) and in pandas, which is what lets the
oracles check the random operators exactly.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _key(seed, purpose: str, keys) -> Column:
    parts = [F.lit(str(seed)), F.lit(purpose)]
    for k in keys:
        parts.append(k.cast("string") if isinstance(k, Column) else F.lit(str(k)))
    return F.concat_ws("|", *parts)


def u(seed, purpose: str, *keys) -> Column:
    """Uniform draw in [0, 1) keyed by (seed, purpose, keys)."""
    return F.conv(F.substring(F.md5(_key(seed, purpose, keys)), 1, 8), 16, 10).cast("double") / F.lit(TWO_32)


def randint(lo, hi, seed, purpose: str, *keys) -> Column:
    """Uniform integer in [lo, hi] (both inclusive), like ``random.randint``."""
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    return (lo_c + F.floor(u(seed, purpose, *keys) * (hi_c - lo_c + 1))).cast("long")


def prefix(seed, purpose: str, *keys) -> Column:
    """The key text of (seed, purpose, keys) without the last key: computed once per
    row and extended per element with ``u_from_prefix`` / ``hex_from_prefix``."""
    return _key(seed, purpose, keys)


def hex_from_prefix(pre: Column, last) -> Column:
    """First 32 bits of the draw as 8 lowercase hex digits: comparing these strings
    orders draws exactly as comparing the numbers ``u`` would."""
    return F.substring(F.md5(F.concat(pre, F.lit("|"), last.cast("string"))), 1, 8)


def u_from_prefix(pre: Column, last) -> Column:
    return F.conv(hex_from_prefix(pre, last), 16, 10).cast("double") / F.lit(TWO_32)


def hex_threshold(p: float) -> str:
    """``u < p``  <=>  ``hex < hex_threshold(p)`` for the 8-hex-digit draw."""
    import math

    k = math.ceil(p * TWO_32)
    return format(min(k, 0xFFFFFFFF + 1), "08x") if k <= 0xFFFFFFFF else "g"


# Constants of a 32-bit integer mixer (xor-shift-multiply rounds).
MIX_GOLDEN = 2654435761
MIX_MULT = 73244475
TWO_32_INT = 4294967296


def h32(seed, purpose: str, *keys) -> Column:
    """One md5-based 32-bit integer per key (as long)."""
    return F.conv(F.substring(F.md5(_key(seed, purpose, keys)), 1, 8), 16, 10).cast("long")


def mix32(base: Column, p) -> Column:
    """A further 32-bit draw from an ``h32`` value and a small integer ``p`` with integer
    arithmetic only (all intermediates stay below 2**63, so ANSI mode never overflows).
    Used where one row needs a draw per array element."""
    x = base.bitwiseXOR(F.pmod((p + 1).cast("long") * F.lit(MIX_GOLDEN), F.lit(TWO_32_INT)))
    x = F.pmod(x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(MIX_MULT), F.lit(TWO_32_INT))
    x = F.pmod(x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(MIX_MULT), F.lit(TWO_32_INT))
    return x.bitwiseXOR(F.shiftright(x, 16))


def sql_h32(seed, purpose: str, *keys: str) -> str:
    return f"CAST(('0x' || substr(md5({sql_key(seed, purpose, *keys)}), 1, 8)) AS BIGINT)"


def sql_mix32(base: str, p: str) -> str:
    x = f"xor({base}, ((({p}) + 1) * {MIX_GOLDEN}) % {TWO_32_INT})"
    x = f"((xor({x}, ({x}) >> 16)) * {MIX_MULT}) % {TWO_32_INT}"
    x = f"((xor({x}, ({x}) >> 16)) * {MIX_MULT}) % {TWO_32_INT}"
    return f"xor({x}, ({x}) >> 16)"


def sort_key(seed, purpose: str, *keys) -> Column:
    """Full md5 hex string: a seeded total order (ties only on equal keys)."""
    return F.md5(_key(seed, purpose, keys))


# --- the same numbers in SQL text (used by the DuckDB oracles) -----------------

def sql_key(seed, purpose: str, *keys: str) -> str:
    parts = [f"'{seed}'", f"'{purpose}'"] + [f"CAST({k} AS VARCHAR)" for k in keys]
    return f"concat_ws('|', {', '.join(parts)})"


def sql_u(seed, purpose: str, *keys: str) -> str:
    return f"(CAST(('0x' || substr(md5({sql_key(seed, purpose, *keys)}), 1, 8)) AS BIGINT) / 4294967296.0)"


def sql_randint(lo: str, hi: str, seed, purpose: str, *keys: str) -> str:
    return f"CAST(({lo}) + floor({sql_u(seed, purpose, *keys)} * (({hi}) - ({lo}) + 1)) AS BIGINT)"


def sql_sort_key(seed, purpose: str, *keys: str) -> str:
    return f"md5({sql_key(seed, purpose, *keys)})"


# --- and in Python (per-group planners running inside pandas tasks) -----------

def py_u(seed, purpose: str, *keys) -> float:
    s = "|".join(map(str, (seed, purpose, *keys)))
    return int.from_bytes(hashlib.md5(s.encode("utf-8")).digest()[:4], "big") / TWO_32


def py_randint(lo: int, hi: int, seed, purpose: str, *keys) -> int:
    return int(lo + int(py_u(seed, purpose, *keys) * (hi - lo + 1)))
