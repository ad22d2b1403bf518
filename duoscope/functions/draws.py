"""Random numbers as a function of keys: the same on every partitioning, every run and in plain SQL.

A row's keys and the seed give two whole numbers a and b below the prime P (40 bits of an MD5 each). Draw number ``t`` of the
row is ``(a + t * b) mod P``: uniform, and any two draws of a row are independent of each other.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

P = 1099511627689
#: The multiple of b stays below 2^63.
MAX_DRAW = 1 << 22


def pair(seed: int, *keys: Column | str) -> tuple[Column, Column]:
    text = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("null")) for k in keys]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *text))

    def part(at: int) -> Column:
        return F.pmod(F.conv(F.substring(digest, at, 10), 16, 10).cast("bigint"), F.lit(P))

    return part(1), part(11)


def number(a: Column, b: Column, t: Column | int = 0) -> Column:
    """Draw ``t`` (below MAX_DRAW) of a row, from 0 to P - 1."""
    return a if isinstance(t, int) and t == 0 else F.pmod(a + (F.lit(t) if isinstance(t, int) else t).cast("bigint") * b, F.lit(P))


def limit(share: float) -> int:
    """Draws below this number have the given share."""
    return min(P, max(0, int(share * P)))


def pair_sql(seed: int, *keys: str) -> tuple[str, str]:
    """The same two numbers for the checking SQL."""
    text = ", ".join(f"coalesce(CAST({k} AS VARCHAR), 'null')" for k in keys)
    return tuple(f"(CAST('0x' || substr(md5(concat_ws('|', '{seed}', {text})), {at}, 10) AS BIGINT) % {P})" for at in (1, 11))
