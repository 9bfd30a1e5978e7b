"""Vertical profiles: gap fraction by zenith ring, and plant area by three models."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import gradient
from .raster import running


@dataclass(frozen=True)
class Rings:
    """Zenith rings and height bins, in degrees and metres; a ring's upper edge belongs to it."""

    zenith_min: float = 35.0
    zenith_max: float = 70.0
    zenith_step: float = 5.0
    height_step: float = 0.5
    height_max: float = 50.0
    height_min: float = 0.0
    azimuth_min: float = 0.0
    azimuth_max: float = 360.0

    @property
    def count(self) -> int:
        return math.ceil((self.zenith_max - self.zenith_min - self.zenith_step / 2) / self.zenith_step)

    @property
    def bottom(self) -> float:
        return min(0.0, self.height_min)

    @property
    def heights(self) -> int:
        return math.ceil((self.height_max - self.bottom) / self.height_step)

    def ring(self):
        """The ring of a zenith, by arithmetic rather than a range join."""
        return (F.ceil((F.col("zenith") - self.zenith_min) / self.zenith_step) - 1).cast("long")

    def centre(self):
        return F.lit(self.zenith_min + self.zenith_step / 2) + F.col("ring") * self.zenith_step


def _beams(pulses: DataFrame, r: Rings) -> DataFrame:
    inside = pulses.where(F.col("azimuth").between(r.azimuth_min, r.azimuth_max)).withColumn("ring", r.ring())
    return inside.where((F.col("ring") >= 0) & (F.col("ring") < r.count))


def ring_pulses(pulses: DataFrame, r: Rings) -> DataFrame:
    return _beams(pulses, r).groupBy("ring").agg(F.count("*").alias("pulses"))


def ring_counts(pulses: DataFrame, points: DataFrame, r: Rings, weighted: bool = True, excluded: tuple[int, ...] = (), height: str = "z") -> DataFrame:
    """ring, hbin, weight: of returns, one over their pulse's number of returns, or of first returns alone."""
    beams = _beams(pulses, r).select("pulse_id", "ring")
    if weighted:
        n = points.groupBy("pulse_id").agg(F.count("*").alias("n"))
        seen = points.join(n, "pulse_id").withColumn("w", F.lit(1.0) / F.col("n"))
    else:
        seen = points.where("return_number = 1").withColumn("w", F.lit(1.0))
    if excluded:
        seen = seen.where(~F.col("classification").isin(*excluded))
    seen = seen.where(F.col(height) > r.height_min).withColumn("hbin", F.floor((F.col(height) - r.bottom) / r.height_step))
    return seen.where((F.col("hbin") >= 0) & (F.col("hbin") < r.heights)).join(beams, "pulse_id").groupBy("ring", "hbin").agg(F.sum("w").alias("weight"))


def gap_profile(pulses: DataFrame, points: DataFrame, r: Rings, weighted: bool = True, excluded: tuple[int, ...] = (), height: str = "z") -> DataFrame:
    """ring, hbin, height, pgap for every ring with pulses and every bin: rings times bins rows."""
    every = ring_pulses(pulses, r).withColumn("hbin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(r.heights - 1).cast("long"))))
    dense = every.join(ring_counts(pulses, points, r, weighted, excluded, height), ["ring", "hbin"], "left")
    cover = running(F.coalesce("weight", F.lit(0.0)), "ring", order="hbin")
    return dense.withColumn("pgap", F.lit(1.0) - cover / F.col("pulses")).select("ring", "hbin", (F.col("hbin") * r.height_step + r.bottom).alias("height"), "pgap")


def _with_density(df: DataFrame, r: Rings) -> DataFrame:
    return df.withColumn("pavd", gradient(F.col("pai"), r.height_step, Window.orderBy("hbin")))


def _log(x):
    return F.when(x > 0, F.log(x))


def hinge(profile: DataFrame, r: Rings) -> DataFrame:
    """hbin, pai, pavd from the ring nearest the hinge angle; no gap left gives null."""
    far = F.abs(F.radians(r.centre()) - math.atan(math.pi / 2))
    best = profile.select("ring").distinct().orderBy(far, "ring").limit(1)
    out = profile.join(best, "ring").select("hbin", (F.lit(-1.1) * _log(F.col("pgap"))).alias("pai"))
    return _with_density(out, r)


def linear(profile: DataFrame, r: Rings) -> DataFrame:
    """hbin, pai, pavd, mla: least squares of -ln(gap) on the ring's leaf projection, with vertical or horizontal leaves alone where a share is negative."""
    x = F.abs(F.lit(2.0) * F.tan(F.radians(r.centre())) / math.pi)
    rows = profile.withColumns({"x": x, "y": -_log(F.col("pgap"))}).where("y is not null")
    fit = rows.groupBy("hbin").agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("cut"), F.avg("y").alias("mean"), F.avg(F.col("y") / F.col("x")).alias("ratio"))
    enough = F.col("n") > 2
    v, h = F.col("slope"), F.col("cut")
    vertical = F.when(enough & (h < 0), F.col("ratio")).when(enough & (v < 0), 0.0).when(enough, v).otherwise(0.0)
    flat = F.when(enough & (h < 0), 0.0).when(enough & (v < 0), F.col("mean")).when(enough, h).otherwise(0.0)
    # Bins without a fit are there too, with nothing.
    bins = profile.select("hbin").distinct()
    out = bins.join(fit.select("hbin", vertical.alias("pv"), flat.alias("ph")), "hbin", "left").fillna(0.0, ["pv", "ph"])
    return _with_density(out.select("hbin", (F.col("pv") + F.col("ph")).alias("pai"), F.degrees(F.atan2("pv", "ph")).alias("mla")), r)


def solid_angle(profile: DataFrame, r: Rings, total: float) -> DataFrame:
    """hbin, pai, pavd: rings weighted by solid angle, each as its share of its own final value, scaled to `total`."""
    last = profile.where(F.col("hbin") == r.heights - 1).select("ring", F.col("pgap").alias("end")).where((F.col("end") < 1) & (F.col("end") > 0))
    w = F.lit(2 * math.pi * math.radians(r.zenith_step)) * F.sin(F.radians(r.centre()))
    weights = last.withColumn("w", w).withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy()))
    rows = profile.join(weights, "ring").groupBy("hbin").agg((F.lit(total) * F.sum(F.col("share") * _log(F.col("pgap")) / F.log("end"))).alias("pai"))
    return _with_density(rows, r)


def wide(profile: DataFrame, r: Rings) -> DataFrame:
    """One row per height, a column for each ring: the file's shape."""
    return profile.groupBy("height").pivot("ring", list(range(r.count))).agg(F.first("pgap")).orderBy("height")


def minimum_grid(points: DataFrame, half: float, size: float) -> DataFrame:
    """The lowest point of each cell of a square around the origin: row, col, x, y, z."""
    inside = points.where((F.abs("x") < half) & (F.abs("y") < half))
    cell = inside.withColumns({"row": F.floor((F.lit(half) - F.col("y")) / size), "col": F.floor((F.col("x") + half) / size)})
    best = F.min_by(F.struct("x", "y", "z"), F.struct("z", "x", "y"))
    return cell.groupBy("row", "col").agg(best.alias("p")).select("row", "col", "p.x", "p.y", "p.z")


def huber_plane(x: np.ndarray, y: np.ndarray, z: np.ndarray, bend: float = 1.345, rounds: int = 100) -> dict[str, float]:
    """z = a + b x + c y by Huber's weights, scaled by the median absolute deviation; slope and aspect in degrees."""
    a = np.column_stack([np.ones(len(x)), x, y])
    w = np.ones(len(x))
    p = np.linalg.lstsq(a, z, rcond=None)[0]
    for _ in range(rounds):
        rest = z - a @ p
        scale = np.median(np.abs(rest)) / 0.6744897501960817
        if scale < 1e-12:
            break
        far = np.abs(rest) / scale
        w = np.where(far <= bend, 1.0, bend / np.maximum(far, 1e-12))
        new = np.linalg.lstsq(a * np.sqrt(w)[:, None], z * np.sqrt(w), rcond=None)[0]
        done = np.max(np.abs(new - p)) < 1e-10
        p = new
        if done:
            break
    return {"intercept": float(p[0]), "dx": float(p[1]), "dy": float(p[2]), "slope": float(np.degrees(np.arctan(np.hypot(p[1], p[2])))), "aspect": float(np.degrees(np.arctan2(p[1], p[2])))}


def plane_of(points: DataFrame, half: float, size: float) -> dict[str, float]:
    """The plane through the lowest points of a grid around the origin, which is as large as its cells are many."""
    rows = minimum_grid(points, half, size).orderBy("row", "col").collect()
    return huber_plane(*(np.array([r[c] for r in rows], float) for c in ("x", "y", "z")))
