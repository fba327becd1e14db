"""Bit masks and validity. NULL is the mask: a masked value is NULL, and so is whatever is computed from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrastack.schemas import FLAG_HULL, FLAG_RANGE, QA_CLOUD, QA_SHADOW, QA_WATER


def bit_clear(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) == 0


def clear_sky(qa_pixel: Column) -> Column:
    """Neither cloud, nor cloud shadow, nor water."""
    return bit_clear(qa_pixel, QA_CLOUD | QA_SHADOW | QA_WATER)


def qa_valid(qa: Column) -> Column:
    """Inside the hull and in range; the non-vegetation bit informs and rejects nothing."""
    return bit_clear(qa, FLAG_HULL | FLAG_RANGE)


def masked(value: Column, keep: Column) -> Column:
    """`value` where `keep` holds, else NULL."""
    return F.when(keep, value)


def unmasked(value: Column, default: float | int) -> Column:
    return F.coalesce(value, F.lit(default))


def where_valid(old: Column, test: Column, value: Column) -> Column:
    """Overwrites `old` with `value` where `test` holds; a masked test or value keeps `old`."""
    return F.when(test & value.isNotNull(), value).otherwise(old)


def source_valid(nodata: float | None) -> Callable[[Column], Column]:
    """The default validity of a raw cell: finite, and not `nodata` if that is given."""

    def valid(x: Column) -> Column:
        finite = x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
        return finite if nodata is None else finite & (x != F.lit(nodata))

    return valid
