"""Checksums and small numeric functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RISKS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
RESIDUAL = ("Low", "Medium", "High", "Unknown")



def valid_tckn(c: Column) -> Column:
    """Eleven digits, the first not 0; the tenth and eleventh are check digits."""
    d = lambda i: F.get(F.transform(F.split(c, ""), lambda x: x.try_cast("int")), F.lit(i - 1))
    odd = d(1) + d(3) + d(5) + d(7) + d(9)
    even = d(2) + d(4) + d(6) + d(8)
    tenth = F.pmod(odd * 7 - even, F.lit(10))
    return F.coalesce(F.when(c.rlike(r"^[1-9][0-9]{10}$"), (d(10) == tenth) & (d(11) == F.pmod(odd + even + d(10), F.lit(10)))), F.lit(False))


def valid_vkn(c: Column) -> Column:
    """Ten digits; each of the first nine, shifted by its place, is doubled as often as places remain, modulo 9."""

    def term(i: int) -> Column:
        t = F.pmod(F.substring(c, i, 1).try_cast("int") + (10 - i), F.lit(10))
        r = F.pmod(t * (1 << (10 - i)), F.lit(9))
        return F.when(t == 0, 0).when(r == 0, 9).otherwise(r)

    total = sum((term(i) for i in range(2, 10)), term(1))
    return F.coalesce(F.when(c.rlike(r"^[0-9]{10}$"), F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)) == F.substring(c, 10, 1).try_cast("int")), F.lit(False))


def safe_divide(a: Column, b: Column, places: int = 4) -> Column:
    return F.coalesce(F.round(a / F.nullif(b, F.lit(0)), places), F.lit(0.0))


def unit(c: Column) -> Column:
    """Clamped to 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def rank_of(c: Column, names: tuple[str, ...], other: int) -> Column:
    out = F.lit(other)
    for i, n in reversed(list(enumerate(names, 1))):
        out = F.when(c == n, i).otherwise(out)
    return out
