"""Numbers read from binary columns, by 0-based offset."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns that are worked out once per row.

    Columns added by a projection are copied into every later filter and expression that reads them, which
    multiplies chains of byte reads. Those made by a generator (here of one row) are read as values.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[v.alias(n) for n, v in columns.items()]))))


def _at(data: Column, offset, n: int) -> Column:
    start = F.lit(offset) if isinstance(offset, int) else offset
    return F.conv(F.hex(F.substring(data, (start + 1).cast("int"), F.lit(n))), 16, 10).cast("long")


def u8(data: Column, offset) -> Column:
    return _at(data, offset, 1)


def u16(data: Column, offset) -> Column:
    return _at(data, offset, 2)


def u32(data: Column, offset) -> Column:
    return _at(data, offset, 4)


def bit(value: Column, mask: int) -> Column:
    return value.bitwiseAND(F.lit(mask)) != 0
