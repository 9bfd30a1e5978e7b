"""Grids, extents, table columns, standard scalings and errors."""

from __future__ import annotations

import math
from dataclasses import dataclass


class PointCloudError(Exception):
    """Any error of this library."""


class FormatNotUnderstood(PointCloudError):
    pass


class DriverNotFound(PointCloudError):
    pass


class InvalidData(PointCloudError):
    pass


class InvalidSetting(PointCloudError):
    pass


class ColumnError(PointCloudError):
    pass


class ScalingError(PointCloudError):
    pass


class WritingNotSupported(PointCloudError):
    pass


class FunctionUnsupported(PointCloudError):
    pass


class SpatialIndexMissing(PointCloudError):
    pass


class PulseIndexUnsupported(PointCloudError):
    pass


class NonSpatialProcessing(PointCloudError):
    pass


@dataclass(frozen=True)
class Extent:
    """A box; west and north edges belong to it, east and south edges don't."""

    x_min: float
    x_max: float
    y_min: float
    y_max: float

    def union(self, other: Extent) -> Extent:
        return Extent(min(self.x_min, other.x_min), max(self.x_max, other.x_max), min(self.y_min, other.y_min), max(self.y_max, other.y_max))

    def intersection(self, other: Extent) -> Extent:
        e = Extent(max(self.x_min, other.x_min), min(self.x_max, other.x_max), max(self.y_min, other.y_min), min(self.y_max, other.y_max))
        if e.x_min >= e.x_max or e.y_min >= e.y_max:
            raise InvalidSetting("the extents have nothing in common")
        return e


def snap(value: float, anchor: float, step: float, way: str = "nearest") -> float:
    """value moved onto the grid through anchor: nearest, less or greater."""
    cells = (value - anchor) / step
    return anchor + step * {"nearest": lambda c: math.floor(c + 0.5), "less": math.floor, "greater": math.ceil}[way](cells)


@dataclass(frozen=True)
class Grid:
    """Square cells; row 0 is the north edge."""

    x_min: float
    y_max: float
    size: float
    rows: int
    columns: int

    @staticmethod
    def over(e: Extent, size: float, keep_edge: bool = False) -> Grid:
        """Cells over an extent: rounded, or, with keep_edge, enough to hold points on the far edges."""
        if keep_edge:
            return Grid(e.x_min, e.y_max, size, math.floor((e.y_max - e.y_min) / size) + 1, math.floor((e.x_max - e.x_min) / size) + 1)
        return Grid(e.x_min, e.y_max, size, round((e.y_max - e.y_min) / size), round((e.x_max - e.x_min) / size))

    @property
    def extent(self) -> Extent:
        return Extent(self.x_min, self.x_min + self.columns * self.size, self.y_max - self.rows * self.size, self.y_max)


def working_grid(extents: list[Extent], size: float, footprint: str = "union", reference: Extent | None = None, anchor: tuple[float, float] = (0.0, 0.0)) -> Grid:
    """The grid of several inputs: union, intersection or bounds of a reference, snapped outward to an anchor."""
    if footprint == "reference":
        if reference is None:
            raise InvalidSetting("no reference given")
        e = reference
    elif footprint in ("union", "intersection"):
        e = extents[0]
        for other in extents[1:]:
            e = e.union(other) if footprint == "union" else e.intersection(other)
    else:
        raise InvalidSetting(f"unknown footprint {footprint}")
    x, y = anchor
    e = Extent(snap(e.x_min, x, size, "less"), snap(e.x_max, x, size, "greater"), snap(e.y_min, y, size, "less"), snap(e.y_max, y, size, "greater"))
    return Grid.over(e, size)


#: Public classification codes.
CLASSES = {
    "created": 0, "unclassified": 1, "ground": 2, "low_vegetation": 3, "medium_vegetation": 4, "high_vegetation": 5, "building": 6,
    "low_point": 7, "high_point": 8, "water": 9, "rail": 10, "road": 11, "bridge": 12, "wire_guard": 13, "wire_conductor": 14,
    "tower": 15, "insulator": 16, "trunk": 100, "foliage": 101, "branch": 102,
}

#: Standard gain and offset of fixed-point columns.
SCALINGS = {
    "X": (100.0, 0.0), "Y": (100.0, 0.0), "Z": (100.0, -100.0), "HEIGHT": (100.0, -100.0), "RANGE": (100.0, 0.0), "INTENSITY": (1.0, 0.0),
    "AMPLITUDE_RETURN": (1.0, 0.0), "RHO_APP": (10000.0, 0.0), "X_ORIGIN": (100.0, 0.0), "Y_ORIGIN": (100.0, 0.0), "Z_ORIGIN": (100.0, -100.0),
    "AZIMUTH": (100.0, 0.0), "ZENITH": (100.0, 0.0), "X_IDX": (100.0, 0.0), "Y_IDX": (100.0, 0.0),
}


def scalings(overrides: dict[str, tuple[float, float] | str] | None = None) -> dict[str, tuple[float, float]]:
    """Standard scalings with some replaced; "default" asks for the standard one."""
    out = dict(SCALINGS)
    for name, pair in (overrides or {}).items():
        if pair == "default":
            if name not in SCALINGS:
                raise InvalidSetting(f"{name} has no standard scaling")
        else:
            out[name] = (float(pair[0]), float(pair[1]))
    return out


def fitted_scaling(low: float, high: float, bits: int = 32) -> tuple[float, float]:
    """Gain and offset that spread low to high over unsigned integers of so many bits."""
    if high < low:
        raise ScalingError("high is below low")
    return ((2.0**bits - 1) / (high - low) if high > low else 1.0, low)


#: Range of the integer types that columns are stored in.
RANGES = {f"{'U' * u}INT{b}": (0 if u else -(2 ** (b - 1)), 2 ** (b - (not u)) - 1) for b in (8, 16, 32, 64) for u in (0, 1)}
