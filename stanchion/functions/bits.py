"""64-bit fingerprints as signed integers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def sign_bits(values: Column, first: int, count: int) -> Column:
    """Bits of which of `count` values from `first` (1-based) are positive; bit 0 is the first's."""
    bits = (F.when(F.get(values, F.lit(first - 1 + i)) > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in range(count))
    return reduce(lambda x, y: x.bitwiseOR(y), bits)


def gradient_hash(grey: Column) -> Column:
    """Difference hash of a 9 x 8 grey image as 72 values in row order: 64 bits, first pixel pair highest."""
    rises = [F.when(F.get(grey, F.lit(9 * r + c + 1)) > F.get(grey, F.lit(9 * r + c)), F.lit(1)).otherwise(F.lit(0)).cast("long") for r in range(8) for c in range(8)]
    return reduce(lambda x, y: x.bitwiseOR(y), (F.shiftleft(b, 63 - i) for i, b in enumerate(rises)))


def bands(hash_: Column, radius: int, width: int = 64) -> Column:
    """radius + 1 pieces of the fingerprint as (number, bits): of two within the radius, one piece is equal."""
    n = radius + 1
    cut = [round(i * width / n) for i in range(n + 1)]
    return F.array(*(F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(hash_, a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 63 else -1)).alias("bits")) for i, (a, b) in enumerate(zip(cut, cut[1:]))))
