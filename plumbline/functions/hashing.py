"""Stable hashes that any engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def stable_hex(*parts: Column) -> Column:
    """First 8 bytes of sha256 over the parts joined by the unit separator, as 16 hex digits."""
    return F.substring(F.sha2(F.concat_ws(SEPARATOR, *parts), 256), 1, 16)


def hex_bound(rate: float) -> str:
    return format(min(int(rate * 2**64), 2**64 - 1), "016x")


def in_sample(key: Column, rate: float, salt: str) -> Column:
    """Fixed-width hex compares like the number it stands for."""
    if rate <= 0:
        return F.lit(False)
    return F.lit(True) if rate >= 1 else stable_hex(F.lit(salt), key) < hex_bound(rate)


def bucket(key: Column, salt: str, buckets: int = 1_000_000) -> Column:
    """Hash modulo ``buckets``."""
    return (F.conv(stable_hex(F.lit(salt), key), 16, 10).cast("decimal(20,0)") % buckets).cast("int")


def unit(*parts: Column) -> Column:
    """Hash as a fraction in [0, 1)."""
    return F.conv(F.substring(stable_hex(*parts), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def portable31(text: Column) -> Column:
    """28 bits of md5: a shingle hash that DuckDB can repeat."""
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")
