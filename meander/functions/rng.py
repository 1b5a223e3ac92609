"""A counter-based random source that any SQL engine with MD5 gives too: no state, no dependence on partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = 1 << 32


def u32(*parts: Column | int | str) -> Column:
    """A value below 2^32 from the MD5 of the parts joined by bars."""
    text = F.concat_ws("|", *((p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def below(u: Column, total: Column) -> Column:
    """The draw u scaled to 0 .. total-1; total is less than 2^31."""
    return F.shiftright(u * total, 32)


def u32_sql(*parts: str) -> str:
    return f"CAST(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8)) AS BIGINT)"
