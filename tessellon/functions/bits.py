"""Morton codes: even bits ix, odd bits iy; as numpy and as Spark expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shift and mask of each doubling of the gaps between bits.
_STEPS = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]


def spread(x):
    x = np.asarray(x, np.int64)
    for shift, mask in _STEPS:
        x = (x | (x << shift)) & mask
    return x


def squeeze(x):
    x = np.asarray(x, np.int64) & 0x5555555555555555
    for k in range(4, 0, -1):
        x = (x | (x >> _STEPS[k][0])) & _STEPS[k - 1][1]
    return (x | (x >> 16)) & 0xFFFFFFFF


def morton_encode(ix, iy):
    return spread(ix) | (spread(iy) << 1)


def morton_decode(code):
    code = np.asarray(code, np.int64)
    return squeeze(code), squeeze(code >> 1)


def spread_col(x: Column) -> Column:
    """Binary digits read in base 4 stand two bits apart; x is used once, so expressions don't grow."""
    return F.conv(F.bin(x), 4, 10).cast("long")


def squeeze_col(x: Column) -> Column:
    """The even bits side by side: base-4 digits of them are 0 or 1, read as binary."""
    return F.conv(F.conv(x.bitwiseAND(F.lit(0x5555555555555555)).cast("string"), 10, 4), 2, 10).cast("long")


def morton_encode_col(ix: Column, iy: Column) -> Column:
    return spread_col(ix) + 2 * spread_col(iy)


def morton_decode_col(code: Column) -> tuple[Column, Column]:
    return squeeze_col(code), squeeze_col(F.shiftright(code, 1))
