"""Space-filling keys and identities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 16
# Names that a file system keeps for devices.
DEVICES = ["CON", "PRN", "AUX", "NUL", *[f"COM{i}" for i in range(1, 10)], *[f"LPT{i}" for i in range(1, 10)]]


def quantised(value: Column, low: float, high: float) -> Column:
    """value in [low, high] as a whole number of 16 bits; halves go away from zero."""
    top = (1 << BITS) - 1
    return F.least(F.greatest(F.floor((value - low) / (high - low) * top + 0.5), F.lit(0)), F.lit(top)).cast("long")


def _spread(v: Column) -> Column:
    """The bits of v at the even places."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton(x: Column, y: Column) -> Column:
    """Interleaved bits of two 16-bit numbers, x at the even places."""
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))


def hilbert(x: Column, y: Column) -> Column:
    """The place of a cell on the Hilbert curve over 2^16 x 2^16, by one fold over the bits from the highest."""

    def turn(s: Column, k: Column) -> Column:
        h = F.shiftleft(F.lit(1).cast("long"), k) if isinstance(k, int) else F.pow(F.lit(2.0), k).cast("long")
        x, y, d = s["x"], s["y"], s["d"]
        rx, ry = (x >= h).cast("long"), (y >= h).cast("long")
        return F.struct(
            F.when((rx == 0) & (ry == 0), y).when((rx == 0) & (ry == 1), x).when((rx == 1) & (ry == 1), x - h).otherwise(h - 1 - y).alias("x"),
            F.when((rx == 0) & (ry == 0), x).when((rx == 0) & (ry == 1), y - h).when((rx == 1) & (ry == 1), y - h).otherwise(h - 1 - (x - h)).alias("y"),
            (d + h * h * ((3 * rx).bitwiseXOR(ry))).alias("d"),
        )

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))
    return F.aggregate(F.sequence(F.lit(BITS - 1), F.lit(0)), start, turn, lambda s: s["d"])


def valid_basin_id(name: Column) -> Column:
    """Whether a text may name a basin: 1 to 128 bytes of letters, digits, dot, dash and underscore; no dot at the end,
    and not the name of a device."""
    return (F.octet_length(name) <= 128) & name.rlike(r"^[A-Za-z0-9._-]+\z") & ~name.endswith(".") & ~F.upper(name).isin(*DEVICES)
