"""Translation into the canonical store: ranges, constants, nulls, recoding, scaling, pulse index, layout."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import recoded
from ..model import SCALINGS, ColumnError, DriverNotFound, Grid, InvalidData
from ..operators.grid import outside
from ..operators.pulses import pulse_index
from ..sources import store
from ..sources.text import TYPES


@dataclass
class Options:
    """range: limits of columns, both ends in. constants: (type, value). nulls: sentinels. classes: codes, mapped at once."""

    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    constants: dict[str, tuple[str, float]] = field(default_factory=dict)
    nulls: dict[str, float] = field(default_factory=dict)
    classes: dict[int, int] = field(default_factory=dict)
    scalings: dict[str, store.Scaling] = field(default_factory=dict)
    index: str = "first"
    grid: Grid | None = None
    block: int = 64


#: What the model's columns are called elsewhere; what isn't listed keeps its name.
NAMES = {
    "store": {"x": "X", "y": "Y", "z": "Z", "classification": "CLASSIFICATION", "intensity": "INTENSITY", "return_number": "RETURN_NUMBER", "pulse_id": "PULSE_ID", "gps_time": "GPS_TIME", "azimuth": "AZIMUTH", "zenith": "ZENITH", "scanline": "SCANLINE", "scanline_idx": "SCANLINE_IDX", "number_of_returns": "NUMBER_OF_RETURNS"},
    "third": {"x": "X", "y": "Y", "z": "Z", "classification": "CLASSIFICATION", "intensity": "AMPLITUDE_RETURN", "return_number": "RETURN_ID", "pulse_id": "PULSE_ID", "gps_time": "GPS_TIME", "azimuth": "AZIMUTH", "zenith": "ZENITH", "scanline": "SCANLINE", "scanline_idx": "SCANLINE_IDX", "number_of_returns": "NUMBER_OF_RETURNS"},
    "scan": {"intensity": "RHO_APP", "gps_time": "TIMESTAMP", "amplitude": "AMPLITUDE_RETURN"},
    "footprint": {"x": "LON0", "y": "LAT0", "z": "Z0", "gps_time": "LVISTIME", "pulse_id": "SHOTNUMBER", "zenith": "INCIDENTANGLE", "azimuth": "AZIMUTH"},
}


def renamed(df: DataFrame, source: str, target: str) -> DataFrame:
    """df with columns called as in another format; "model" is what this package calls them. No name may come twice."""
    for f in (source, target):
        if f != "model" and f not in NAMES:
            raise DriverNotFound(f"no names for format {f}")
    back = {v: k for k, v in NAMES.get(source, {}).items()}
    names = [NAMES.get(target, {}).get(own := back.get(c, c), own) for c in df.columns]
    if len(set(names)) < len(names):
        raise ColumnError(f"two columns would be called {next(n for n in names if names.count(n) > 1)}")
    return df.toDF(*names)


def check_ranges(df: DataFrame, limits: dict[str, tuple[float, float]]) -> None:
    """Raises if a column is missing or a value lies outside; one pass over the data."""
    missing = set(limits) - set(df.columns)
    if missing:
        raise ColumnError(f"no such columns: {sorted(missing)}")
    bad = [f"{r['column']} ({r['low']} to {r['high']})" for r in outside(df, limits).collect() if r["bad"]] if limits else []
    if bad:
        raise InvalidData("outside their range: " + ", ".join(bad))


def with_constants(df: DataFrame, constants: dict[str, tuple[str, float]]) -> DataFrame:
    for name, (kind, _) in constants.items():
        if kind not in TYPES:
            raise ColumnError(f"{name}: unknown type {kind}")
    return df.withColumns({n: F.lit(float(v)).cast(TYPES[k]) for n, (k, v) in constants.items()}) if constants else df


def translate(pulses: DataFrame, points: DataFrame, path: str, o: Options) -> None:
    """Writes both tables under path."""
    check_ranges(points, o.ranges)
    points = with_constants(points, o.constants)
    points = points.withColumns({n: F.nullif(F.col(n), F.lit(v)) for n, v in o.nulls.items()}) if o.nulls else points
    if o.classes:
        points = points.withColumn("classification", recoded("classification", o.classes))
    pulses = pulses.drop("x_idx", "y_idx").join(pulse_index(points, o.index), "pulse_id", "left")
    given = {n: store.Scaling(*SCALINGS[n.upper()]) for n in points.columns if n.upper() in SCALINGS and points.schema[n].dataType.simpleString() == "double"} | o.scalings
    scaled = {n: s for n, s in given.items() if n in points.columns}
    for n, v in o.nulls.items():
        if n in scaled:
            scaled[n].null = v
    layouts = {"points": store.Layout({n: s for n, s in scaled.items() if o.grid is None or n not in ("x", "y")}, o.grid, o.block), "pulses": store.Layout({}, o.grid, o.block, "x_idx", "y_idx")}
    store.write({"pulses": pulses, "points": points}, path, layouts)
