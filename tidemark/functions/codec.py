"""Order-preserving key bytes: big-endian, with the sign turned so that negative numbers come first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SIGN = -(1 << 63)


def encode_key(key: Column) -> Column:
    return F.unhex(F.lpad(F.hex(key.bitwiseXOR(F.lit(_SIGN))), 16, "0"))


def decode_key(code: Column) -> Column:
    """The number of an encoded key: its unsigned value less 2^63."""
    high = F.conv(F.hex(F.substring(code, 1, 4)), 16, 10).cast("long") - F.lit(1 << 31)
    return F.shiftleft(high, 32).bitwiseOR(F.conv(F.hex(F.substring(code, 5, 4)), 16, 10).cast("long"))
