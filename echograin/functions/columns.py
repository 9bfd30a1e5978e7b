"""Column functions: bins, scaling, recoding, flags, angles, boxes. All run in the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import RANGES, Extent, Grid, ScalingError


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def row_of(y: Column | str, g: Grid) -> Column:
    return F.floor((F.lit(g.y_max) - _c(y)) / F.lit(g.size))


def column_of(x: Column | str, g: Grid) -> Column:
    return F.floor((_c(x) - F.lit(g.x_min)) / F.lit(g.size))


def in_box(x: Column | str, y: Column | str, e: Extent) -> Column:
    """The half-open rule: west and north edges in. Plain comparisons, which reach the Parquet scan."""
    return (_c(x) >= e.x_min) & (_c(x) < e.x_max) & (_c(y) > e.y_min) & (_c(y) <= e.y_max)


def snapped(x: Column | str, anchor: float, step: float, way: str = "nearest") -> Column:
    cells = (_c(x) - F.lit(anchor)) / F.lit(step)
    whole = {"nearest": lambda: F.floor(cells + F.lit(0.5)), "less": lambda: F.floor(cells), "greater": lambda: F.ceil(cells)}[way]()
    return F.lit(anchor) + F.lit(step) * whole


def scale_encode(x: Column | str, gain: float, offset: float, kind: str = "UINT32", strict: bool = True) -> Column:
    """round-half-even((x - offset) * gain); outside the type's range an error, or null if not strict."""
    if kind not in RANGES:
        raise ScalingError(f"unknown type {kind}")
    low, high = RANGES[kind]
    raw = (_c(x) - F.lit(offset)) * F.lit(gain)
    # The range is tested before rounding.
    bad = (raw < float(low)) | (raw > float(high))
    stored = F.rint(raw).cast("long")
    if strict:
        return F.when(bad, F.raise_error(F.lit(f"value outside {kind} after scaling")).cast("long")).otherwise(stored)
    return F.when(~bad, stored)


def scale_decode(stored: Column | str, gain: float, offset: float) -> Column:
    return _c(stored) / F.lit(gain) + F.lit(offset)


def null_of(x: Column | str, sentinel: float) -> Column:
    return F.nullif(_c(x), F.lit(sentinel))


def recoded(code: Column | str, pairs: dict[int, int]) -> Column:
    """All codes mapped at once; those without a pair stay."""
    out = None
    for a, b in pairs.items():
        out = F.when(_c(code) == a, b) if out is None else out.when(_c(code) == a, b)
    return _c(code) if out is None else out.otherwise(_c(code))


def flag_ignored(flags: Column | str, ignore: Column | str, bit: int = 1) -> Column:
    return F.when(_c(ignore) != 0, _c(flags).bitwiseOR(F.lit(bit))).otherwise(_c(flags))


def has_flag(flags: Column | str, bit: int) -> Column:
    return _c(flags).bitwiseAND(F.lit(bit)) != 0


def direction(zenith: Column, azimuth: Column) -> tuple[Column, Column, Column]:
    """Unit vector of a beam; angles in degrees, azimuth from north."""
    z, a = F.radians(zenith), F.radians(azimuth)
    return F.sin(z) * F.sin(a), F.sin(z) * F.cos(a), F.cos(z)


def zenith_of(dx: Column, dy: Column, dz: Column) -> Column:
    norm = F.sqrt(dx * dx + dy * dy + dz * dz)
    return F.when(norm > 0, F.degrees(F.acos(dz / norm)))


def azimuth_of(dx: Column, dy: Column) -> Column:
    turn = F.degrees(F.atan2(dx, dy))
    return F.when(turn < 0, turn + 360.0).otherwise(turn)


def transformed(x: Column, y: Column, z: Column, matrix: Sequence[Sequence[float]], w: float = 1.0) -> tuple[Column, ...]:
    """A 4 x 4 matrix applied; w = 1 for points, 0 for directions."""
    return tuple(F.lit(float(r[0])) * x + F.lit(float(r[1])) * y + F.lit(float(r[2])) * z + F.lit(float(r[3]) * w) for r in matrix[:3])


def rotation(yaw: float, pitch: float, roll: float) -> np.ndarray:
    """Yaw, then pitch, then roll, in radians, as a 4 x 4 matrix; an unknown yaw counts as none."""
    y = 0.0 if math.isnan(yaw) else yaw
    c, s = np.cos, np.sin
    about_z = np.array([[c(y), -s(y), 0, 0], [s(y), c(y), 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]])
    about_y = np.array([[c(pitch), 0, s(pitch), 0], [0, 1, 0, 0], [-s(pitch), 0, c(pitch), 0], [0, 0, 0, 1]])
    about_x = np.array([[1, 0, 0, 0], [0, c(roll), -s(roll), 0], [0, s(roll), c(roll), 0], [0, 0, 0, 1]])
    return about_z @ about_y @ about_x


def linear_power(db: Column | str) -> Column:
    return F.pow(F.lit(10.0), _c(db) / 10.0)


def nanoseconds(seconds: Column | str) -> Column:
    return F.floor(_c(seconds) * 1e9 + 0.5)


def gradient(y: Column, step: float, window) -> Column:
    """Central differences; one-sided at both ends."""
    before, after = F.lag(y).over(window), F.lead(y).over(window)
    first, last = F.lag(F.lit(1)).over(window).isNull(), F.lead(F.lit(1)).over(window).isNull()
    return F.when(first, (after - y) / step).when(last, (y - before) / step).otherwise((after - before) / (2 * step))
