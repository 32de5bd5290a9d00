"""Fixed-width integer values: widths, signs, and how bytes or longs become them. Every read widens to a long."""

from __future__ import annotations

from enum import Enum

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class ValueType(Enum):
    """(bytes, signed) of a big-endian value; ``LONG128`` only orders, by its signed high and then its signed low half."""

    BYTE = ("i8", 1, True)
    UNSIGNED_BYTE = ("u8", 1, False)
    SHORT = ("i16", 2, True)
    UNSIGNED_SHORT = ("u16", 2, False)
    INT = ("i32", 4, True)
    UNSIGNED_INT = ("u32", 4, False)
    LONG = ("i64", 8, True)
    LONG128 = ("u128", 16, True)

    def __init__(self, label: str, width: int, signed: bool):
        self.label, self.width, self.signed = label, width, signed

    @property
    def dtype(self) -> np.dtype:
        """The NumPy type of the stored bytes."""
        if self is ValueType.LONG128:
            return np.dtype([("hi", ">i8"), ("lo", ">i8")])
        return np.dtype(f">{'i' if self.signed else 'u'}{self.width}")

    @property
    def spark(self) -> str:
        """The widened type that queries see."""
        return "struct<hi:bigint,lo:bigint>" if self is ValueType.LONG128 else "bigint"


def fold(value: Column, kind: ValueType) -> Column:
    """A long cut to the width of ``kind`` and widened again: sign- or zero-extended. Null stays null."""
    if kind.width >= 8:
        return value.cast("bigint")
    bits = 64 - 8 * kind.width
    if kind.signed:
        return F.shiftright(F.shiftleft(value.cast("bigint"), bits), bits)
    return value.cast("bigint").bitwiseAND(F.lit((1 << (8 * kind.width)) - 1).cast("bigint"))


def decode(record: Column, offset: int, kind: ValueType) -> Column:
    """The value at a byte offset of a binary record, without Python."""
    if kind is ValueType.LONG128:
        return F.struct(decode(record, offset, ValueType.LONG).alias("hi"), decode(record, offset + 8, ValueType.LONG).alias("lo"))
    raw = F.conv(F.hex(F.substring(record, offset + 1, kind.width)), 16, -10 if kind.width == 8 else 10).cast("bigint")
    return fold(raw, kind)


def encode(value: Column, kind: ValueType) -> Column:
    """The big-endian bytes of a long."""
    if kind is ValueType.LONG128:
        return F.concat(encode(value["hi"], ValueType.LONG), encode(value["lo"], ValueType.LONG))
    return F.substring(F.unhex(F.lpad(F.hex(value.cast("bigint")), 16, "0")), 9 - kind.width, kind.width)
