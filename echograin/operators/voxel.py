"""Rays through voxels: hits, misses, occlusion; cover and classes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NULL = 9999.0


@dataclass(frozen=True)
class Voxels:
    x: float
    y: float
    z: float
    size: float
    nx: int
    ny: int
    nz: int

    @property
    def low(self) -> np.ndarray:
        return np.array([self.x, self.y, self.z])

    @property
    def counts(self) -> np.ndarray:
        return np.array([self.nx, self.ny, self.nz])

    def index(self, i, j, k):
        return i + self.nx * j + self.nx * self.ny * k


def cell_of(df: DataFrame, v: Voxels, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """df with vidx; what lies outside goes."""
    cell = {n: F.floor((F.col(c) - lo) / v.size) for n, c, lo in (("vi", x, v.x), ("vj", y, v.y), ("vk", z, v.z))}
    inside = df.withColumns(cell).where((F.col("vi") >= 0) & (F.col("vi") < v.nx) & (F.col("vj") >= 0) & (F.col("vj") < v.ny) & (F.col("vk") >= 0) & (F.col("vk") < v.nz))
    return inside.withColumn("vidx", v.index(F.col("vi"), F.col("vj"), F.col("vk"))).drop("vi", "vj", "vk")


def trace(origin: np.ndarray, heading: np.ndarray, v: Voxels, reach: float = 1.0) -> list[tuple[np.ndarray, np.ndarray]]:
    """The voxels that rays pass, all rays a step at a time: (rays, voxel of each) per step.

    A ray that misses the box passes none. It enters where it meets the box, or begins; a start on the far face counts to
    the cell before it. On a tie of next borders, z goes before x and y, and y before x.
    """
    low, high = v.low, v.low + v.counts * v.size
    with np.errstate(divide="ignore", invalid="ignore"):
        inverse = np.where(heading == 0, 1.0, 1.0 / heading)
        near, far = (low - origin) * inverse, (high - origin) * inverse
    flat = heading == 0
    outside = (flat & ((origin < low) | (origin >= high))).any(1)
    near, far = np.where(flat, -np.inf, near), np.where(flat, np.inf, far)
    near, far = np.minimum(near, far), np.maximum(near, far)
    enter, leave = near.max(1), far.min(1)
    rays = np.flatnonzero(~outside & (enter <= leave) & (leave >= 0))
    begin = np.maximum(enter[rays], 0.0)
    start = origin[rays] + begin[:, None] * heading[rays]
    cell = np.floor((start - low) / v.size).astype(np.int64)
    cell = np.where(cell == v.counts, cell - 1, cell)
    fine = ((cell >= 0) & (cell < v.counts)).all(1)
    rays, cell = rays[fine], cell[fine]
    way = np.sign(heading[rays]).astype(np.int64)
    with np.errstate(divide="ignore", invalid="ignore"):
        border = low + (cell + (way > 0)) * v.size
        upcoming = np.where(way == 0, np.inf, (border - origin[rays]) / heading[rays])
        step = np.where(way == 0, np.inf, v.size / np.abs(heading[rays]))
    out = []
    while len(rays):
        out.append((rays, v.index(cell[:, 0], cell[:, 1], cell[:, 2])))
        x, y, z = upcoming.T
        axis = np.where((x < y) & (x < z), 0, np.where((y <= x) & (y < z), 1, 2))
        k = np.arange(len(rays))
        cell[k, axis] += way[k, axis]
        upcoming[k, axis] += step[k, axis]
        on = ((cell >= 0) & (cell < v.counts)).all(1)
        rays, cell, way, upcoming, step = rays[on], cell[on], way[on], upcoming[on], step[on]
    return out


def account(origin: np.ndarray, zenith: np.ndarray, azimuth: np.ndarray, returns: list[np.ndarray], v: Voxels, ground: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Voxels passed and, for each, hits, misses and occlusion summed over rays. returns: each ray's voxels of returns, -1 outside."""
    zen, az = np.radians(zenith), np.radians(azimuth)
    heading = np.column_stack([np.sin(zen) * np.sin(az), np.sin(zen) * np.cos(az), np.cos(zen)])
    n = len(zenith)
    counts = np.array([len(r) for r in returns], np.int64)
    share = np.maximum(counts, 1)  # whole numbers until the end: what is left of a ray is nought, not nearly so
    total = v.nx * v.ny * v.nz
    # How many returns each ray has in a voxel, found by one number for the two.
    flat = np.concatenate(returns) if n else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(n), counts)
    keys, many = np.unique((owner * total + flat)[flat >= 0], return_counts=True)
    met, below = np.zeros(n, np.int64), np.zeros(n, bool)
    cells, sums = [], []
    for rays, cell in trace(origin, heading, v):
        if ground is not None:
            below[rays] |= ground[cell]
        key = rays * total + cell
        at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
        k = np.where(keys[at] == key, many[at], 0) if len(keys) else np.zeros(len(rays), np.int64)
        clear = ~below[rays]
        hit = k * clear
        met[rays] += hit
        cells.append(cell)
        whole = share[rays]
        sums.append(np.column_stack([hit / whole, np.where(clear, (whole - met[rays]) / whole, 0.0), np.where(clear, met[rays] / whole, 1.0)]))
    if not cells:
        return np.zeros(0, np.int64), np.zeros((0, 3))
    cell, per = np.concatenate(cells), np.concatenate(sums)
    different, at = np.unique(cell, return_inverse=True)
    return different, np.column_stack([np.bincount(at, per[:, c], len(different)) for c in range(3)])


def traverse(pulses: DataFrame, points: DataFrame, v: Voxels, by: str | None = None, ground: np.ndarray | None = None) -> DataFrame:
    """vidx, hits, miss, occl (and the column `by`, one scan each). Pulses without a return count as misses all along.

    Rays of a batch go together in numpy; voxels are summed in the batch before they are shuffled.
    """
    nested = points.withColumn("vidx", _cell_or_none(v)).groupBy("pulse_id").agg(F.collect_list("vidx").alias("cells"))
    scan = F.col(by) if by else F.lit(0)
    rows = pulses.join(nested, "pulse_id", "left").select(scan.cast("long").alias("scan"), "x_origin", "y_origin", "z_origin", "zenith", "azimuth", F.coalesce("cells", F.array().cast("array<bigint>")).alias("cells"))

    def kernel(batches):
        for batch in batches:
            scans = batch.column(0).to_numpy(zero_copy_only=False)
            numbers = [batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(1, 6)]
            cells = [np.asarray(c, np.int64) for c in batch.column(6).to_pylist()]
            for s in np.unique(scans):
                at = np.flatnonzero(scans == s)
                where, sums = account(np.column_stack(numbers[:3])[at], numbers[3][at], numbers[4][at], [cells[i] for i in at], v, ground)
                yield pa.RecordBatch.from_pydict({"scan": np.full(len(where), s), "vidx": where, "hits": sums[:, 0], "miss": sums[:, 1], "occl": sums[:, 2]})

    out = rows.mapInArrow(kernel, "scan long, vidx long, hits double, miss double, occl double")
    keys = ["scan", "vidx"] if by else ["vidx"]
    return out.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("hits", "miss", "occl")])


def _cell_or_none(v: Voxels):
    i, j, k = (F.floor((F.col(c) - lo) / v.size) for c, lo in (("x", v.x), ("y", v.y), ("z", v.z)))
    inside = (i >= 0) & (i < v.nx) & (j >= 0) & (j < v.ny) & (k >= 0) & (k < v.nz)
    return F.when(inside, v.index(i, j, k)).otherwise(F.lit(-1).cast("long"))


def scan_metrics(counts: DataFrame) -> DataFrame:
    """counts with pgap (9999: no shot) and the scan's weight."""
    shots = F.col("miss") + F.col("hits")
    return counts.withColumn("pgap", F.when(shots > 0, F.col("miss") / shots).otherwise(NULL)).withColumn("w", F.when(shots > 0, shots / (shots + F.col("occl"))).otherwise(0.0))


def class_of():
    """5 hit, 4 empty, 3 hidden, 2 unobserved."""
    hits, miss, occl = F.col("hits"), F.col("miss"), F.col("occl")
    return F.when(hits > 0, 5).when(miss > 0, 4).when(occl > 0, 3).otherwise(2)


def summary(counts: DataFrame) -> DataFrame:
    """Over scans: vidx, scans that shot there, cover, class."""
    m = scan_metrics(counts).withColumns({"seen": F.when(F.col("miss") + F.col("hits") > 0, 1).otherwise(0), "cls": class_of()})
    part = F.when(F.col("seen") == 1, (F.lit(1.0) - F.col("pgap")) * F.col("w")).otherwise(0.0)
    out = m.groupBy("vidx").agg(F.sum("seen").alias("scans"), F.sum(part).alias("part"), F.sum("w").alias("wtot"), F.max("cls").alias("class"))
    return out.select("vidx", "scans", F.when(F.col("wtot") > 0, F.col("part") / F.col("wtot")).otherwise(0.0).alias("cover"), "class")


def cover_from_above(cover: DataFrame, v: Voxels, ground: DataFrame | None = None) -> DataFrame:
    """Every voxel's cover given that of those above it, p + (1 - p) q; 9999 at ground voxels and below them.

    A column of voxels, nz numbers, is folded as an array: no log, so a cover of 1 is as good as any.
    """
    flat = v.nx * v.ny
    cells = cover.select((F.col("vidx") % flat).alias("column"), F.floor(F.col("vidx") / flat).alias("k"), F.col("cover"), F.lit(False).alias("solid"))
    if ground is not None:
        cells = cells.unionByName(ground.select((F.col("vidx") % flat).alias("column"), F.floor(F.col("vidx") / flat).alias("k"), F.lit(0.0).alias("cover"), F.lit(True).alias("solid")))
    columns = cells.groupBy("column").agg(F.map_from_entries(F.collect_list(F.when(~F.col("solid"), F.struct("k", "cover")))).alias("at"), F.max(F.when(F.col("solid"), F.col("k"))).alias("top"))
    layers = F.sequence(F.lit(v.nz - 1).cast("long"), F.lit(0).cast("long"), F.lit(-1).cast("long"))
    empty = F.array().cast("array<double>")
    fold = F.aggregate(layers, empty, lambda acc, k: F.concat(acc, F.array(_over(F.when(F.size(acc) > 0, F.element_at(acc, -1)).otherwise(0.0), F.coalesce(F.try_element_at("at", k), F.lit(0.0))))))
    rows = columns.select("column", "top", F.posexplode(fold).alias("i", "cover")).withColumn("k", F.lit(v.nz - 1) - F.col("i"))
    return rows.select((F.col("column") + flat * F.col("k")).alias("vidx"), F.when(F.col("k") <= F.coalesce("top", F.lit(-1)), NULL).otherwise(F.col("cover")).alias("cover"))


def _over(above, here):
    return above + (F.lit(1.0) - above) * here
