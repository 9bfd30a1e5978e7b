"""Rasters as rows (row, col, value): look-ups, ground, focal operations, morphology."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import column_of, row_of
from ..model import Grid, InvalidSetting
from .grid import cells


def look_up(points: DataFrame, raster: DataFrame, g: Grid, value: str, outside: str = "null", x: str = "x", y: str = "y") -> DataFrame:
    """points with the raster's value at their cell. outside: "null", or "clamp" to the nearest edge cell.

    Whether the raster is broadcast is left to its size as the optimizer knows it.
    """
    r, c = row_of(y, g), column_of(x, g)
    if outside == "clamp":
        r = F.least(F.greatest(r, F.lit(0).cast("long")), F.lit(g.rows - 1).cast("long"))
        c = F.least(F.greatest(c, F.lit(0).cast("long")), F.lit(g.columns - 1).cast("long"))
    elif outside != "null":
        raise InvalidSetting(f"outside is null or clamp, not {outside}")
    return points.withColumns({"row": r, "col": c}).join(raster.select("row", "col", value), ["row", "col"], "left")


def height_above(points: DataFrame, raster: DataFrame, g: Grid, value: str = "ground", outside: str = "null", z: str = "z") -> DataFrame:
    return look_up(points, raster, g, value, outside).withColumn("height", F.col(z) - F.col(value))


def classify_ground(points: DataFrame, raster: DataFrame, g: Grid, threshold: float, value: str = "ground", code: int = 2, reset: int = 0) -> DataFrame:
    """Points near the surface get the ground code; those that had it and aren't lose it."""
    found = look_up(points, raster, g, value)
    near = F.coalesce(F.abs(F.col("z") - F.col(value)) < threshold, F.lit(False))
    cls = F.when(near, F.lit(code)).when(F.col("classification") == code, F.lit(reset)).otherwise(F.col("classification"))
    return found.withColumn("classification", cls)


def nearest_fill(raster: DataFrame, g: Grid, value: str, reach: int | None = None) -> DataFrame:
    """Empty cells take the value of the nearest filled one, within `reach` cells if that is given; ties to the lower row, then column.

    Squared distances separate: windows find the nearest filled cell of each cell's own column, and tasks that hold some rows
    each find the best of those along the row. Work and shuffle are a few times the cells, however far away the filled ones are.
    Cells stay null where there is nothing to take.
    """
    full = cells(raster, g).join(raster.select("row", "col", F.col(value).cast("double").alias("v")), ["row", "col"], "left")
    filled = F.when(F.col("v").isNotNull(), F.struct(F.col("row").alias("r"), "v"))
    above, below = (F.last(filled, True).over(Window.partitionBy("col").orderBy(o).rowsBetween(Window.unboundedPreceding, 0)) for o in (F.asc("row"), F.desc("row")))
    sided = full.select("row", "col", above.alias("a"), below.alias("b"))
    nearer = F.when(F.col("b").isNull() | (F.col("row") - F.col("a.r") <= F.col("b.r") - F.col("row")), F.col("a")).otherwise(F.col("b"))
    own = sided.select("row", "col", nearer.alias("n")).where("n is not null").select("row", "col", F.col("n.r").alias("r"), F.col("n.v").alias("v"))
    most = -1 if reach is None else reach * reach

    def band(t: pa.Table) -> pa.Table:
        row, col, r, v = (t[c].to_numpy() for c in ("row", "col", "r", "v"))
        rows, at = np.unique(row, return_inverse=True)
        have, place = np.unique(col, return_inverse=True)  # a column has a filled cell for all rows or for none
        source, values = np.zeros((len(rows), len(have)), np.int64), np.zeros((len(rows), len(have)))
        source[at, place], values[at, place] = r, v
        far, pick = _nearest_in_rows(rows, source, have, g.columns)
        found = np.take_along_axis(values, pick, 1).ravel()
        return pa.table({"row": np.repeat(rows, g.columns), "col": np.tile(np.arange(g.columns), len(rows)), "v": pa.array(found, mask=(far.ravel() > most) if most >= 0 else None)})

    deep = max(1, (1 << 18) // g.columns)
    best = own.groupBy(F.floor(F.col("row") / deep)).applyInArrow(lambda t: band(t), "row long, col long, v double")
    out = full.select("row", "col").join(best, ["row", "col"], "left")
    return out.select("row", "col", F.col("v").cast(raster.schema[value].dataType).alias(value))


def _nearest_in_rows(rows: np.ndarray, source: np.ndarray, have: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column: the squared distance to the nearest of the cells (source[row, k], have[k]), and its k.

    The best k never falls as the column grows, so columns halve between those that are settled, all rows at once.
    """
    n, last = len(rows), len(have) - 1
    own = (rows[:, None] - source) ** 2
    far, pick = np.zeros((n, columns), np.int64), np.zeros((n, columns), np.int64)
    step = 1 << columns.bit_length()
    while step:
        p = np.arange(step - 1, columns, 2 * step)
        if len(p):
            low = np.where(p >= step, pick[:, np.maximum(p - step, 0)], 0)
            high = np.where(p + step < columns, pick[:, np.minimum(p + step, columns - 1)], last)
            many = (high - low + 1).ravel()
            begins = np.cumsum(many) - many
            k = np.arange(begins[-1] + many[-1]) - np.repeat(begins - low.ravel(), many)
            line, at = np.repeat(np.repeat(np.arange(n), len(p)), many), np.repeat(np.tile(p, n), many)
            away = own[line, k] + (at - have[k]) ** 2
            least = np.minimum.reduceat(away, begins)
            # Of equals, the lower row, then the lower column.
            tied = np.where(away == np.repeat(least, many), source[line, k] * columns + have[k], np.iinfo(np.int64).max)
            first = np.flatnonzero(tied == np.repeat(np.minimum.reduceat(tied, begins), many))
            far[:, p], pick[:, p] = least.reshape(n, -1), k[first].reshape(n, -1)
        step >>= 1
    return far, pick


#: Cells of a disk up to which a focal operation is a shuffle of moved cells; larger disks go over tiles.
SMALL_DISK = 32


def focal(raster: DataFrame, value: str, radius: float, reduce: str, tile: int = 1024) -> DataFrame:
    """The min or max over the disk around each cell that is there; both ways of doing it give the same."""
    if reduce not in ("min", "max"):
        raise InvalidSetting(f"reduce is min or max, not {reduce}")
    n = int(radius)
    disk = [(d, e) for d in range(-n, n + 1) for e in range(-n, n + 1) if d * d + e * e <= radius * radius]
    if len(disk) > SMALL_DISK:
        return _focal_by_tiles(raster, value, radius, reduce, tile)
    moves = F.explode(F.array(*[F.struct(F.lit(d).alias("dr"), F.lit(e).alias("dc")) for d, e in disk]))
    spread = raster.select("row", "col", value, moves.alias("m")).select((F.col("row") + F.col("m.dr")).alias("row"), (F.col("col") + F.col("m.dc")).alias("col"), value)
    out = spread.groupBy("row", "col").agg((F.min if reduce == "min" else F.max)(value).alias(value))
    return out.join(raster.select("row", "col"), ["row", "col"], "left_semi")


def _tiles(raster: DataFrame, tile: int, margin: int) -> DataFrame:
    """raster with each cell in every tile (tr, tc) that has it within `margin` cells."""

    def reach(c: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(c) - margin) / tile), F.floor((F.col(c) + margin) / tile)))

    return raster.withColumn("tr", reach("row")).withColumn("tc", reach("col"))


def _focal_by_tiles(raster: DataFrame, value: str, radius: float, reduce: str, tile: int) -> DataFrame:
    n, best, none = int(radius), (np.minimum, np.maximum)[reduce == "max"], np.inf if reduce == "min" else -np.inf

    def one(t: pa.Table) -> pa.Table:
        row, col, v = (t[c].to_numpy() for c in ("row", "col", "v"))
        top, left = row.min(), col.min()
        z = np.full((row.max() - top + 1 + 2 * n, col.max() - left + 1 + 2 * n), none)
        z[row - top + n, col - left + n] = np.where(np.isnan(v), none, v)
        out = _over_disk(z, n, _widths(radius), best)
        core = (row // tile == t["tr"][0].as_py()) & (col // tile == t["tc"][0].as_py())
        found = out[row[core] - top, col[core] - left]
        return pa.table({"row": row[core], "col": col[core], "v": pa.array(found, mask=found == none)})

    spread = _tiles(raster.select("row", "col", F.col(value).cast("double").alias("v")), tile, n)
    out = spread.groupBy("tr", "tc").applyInArrow(lambda t: one(t), "row long, col long, v double")
    return out.select("row", "col", F.col("v").cast(raster.schema[value].dataType).alias(value))


def opening(raster: DataFrame, value: str, radius: float) -> DataFrame:
    return focal(focal(raster, value, radius, "min"), value, radius, "max")


# Progressive morphological filter --------------------------------------------------


def windows(initial: int = 1, most: int = 12, step: int = 1, exponential: bool = False) -> list[int]:
    """Window sizes, growing by line or by power, up to `most` steps."""
    ks = range(0, most, step)
    return [(2 * initial) ** k + 1 if exponential else 2 * k * initial + 1 for k in ks]


def _widths(radius: float) -> list[int]:
    """How far a disk reaches to either side, row by row."""
    n = int(radius)
    return [int(np.sqrt(radius * radius - d * d) + 1e-9) for d in range(-n, n + 1)]


def _over_disk(padded: np.ndarray, n: int, widths: list[int], best: np.ufunc) -> np.ndarray:
    """The best over a disk for all but the outer n cells: row by row of the disk, each from two overlapping powers of two."""
    rows, columns = padded.shape[0] - 2 * n, padded.shape[1] - 2 * n
    powers = [padded]
    while 2 ** len(powers) <= 2 * max(widths) + 1:
        half = 2 ** (len(powers) - 1)
        powers.append(best(powers[-1][:, :-half], powers[-1][:, half:]))
    out = None
    for i, w in enumerate(widths):
        k = (2 * w + 1).bit_length() - 1
        a, b = n - w, n + w + 1 - 2**k
        line = best(powers[k][i : i + rows, a : a + columns], powers[k][i : i + rows, b : b + columns])
        out = line if out is None else best(out, line, out=out)
    return out


def _slide(a: np.ndarray, radius: int, erode: bool, raised: bool) -> np.ndarray:
    """Erosion or dilation by a flat disk, or by a disk of height 1 in a square of height 0; edges are mirrored."""
    best, sign = (np.minimum, -1.0) if erode else (np.maximum, 1.0)
    padded = np.pad(a, radius, mode="symmetric")
    out = _over_disk(padded, radius, _widths(radius), best)
    if not raised:
        return out
    square = _along(_along(padded, radius, best).T, radius, best).T
    return best(square, out + sign)


def _along(a: np.ndarray, radius: int, best: np.ufunc) -> np.ndarray:
    """The best of 2 radius + 1 neighbours along each row; the outer cells go."""
    have, y, want = 1, a, 2 * radius + 1
    while 2 * have <= want:
        y = best(y[:, : y.shape[1] - have], y[:, have:])
        have *= 2
    return best(y[:, : a.shape[1] - 2 * radius], y[:, want - have : want - have + a.shape[1] - 2 * radius])


def filled(z: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """As nearest_fill, of an array."""
    rows, columns = z.shape
    r = np.arange(rows)[:, None]
    above = np.maximum.accumulate(np.where(valid, r, -1), axis=0)
    below = np.minimum.accumulate(np.where(valid, r, 2 * rows)[::-1], axis=0)[::-1]
    source = np.where((above >= 0) & ((r - above <= below - r) | (below == 2 * rows)), above, below)
    have = np.flatnonzero(valid.any(0))
    _, pick = _nearest_in_rows(np.arange(rows), source[:, have], have, columns)
    return z[np.take_along_axis(source[:, have], pick, 1), have[pick]]


def morphological_filter(z: np.ndarray, valid: np.ndarray, cell: float, sizes: list[int], slope: float = 0.3, least: float = 0.3, most: float = 5.0, keep: float = 0.5, legacy: bool = True) -> np.ndarray:
    """Ground surface of a grid by openings with growing windows.

    legacy: radii lag one window behind, the structure is a disk of height 1 in a square of height 0, and every opening
    replaces the surface. Otherwise disks are flat, radii are those of their windows, and the surface is replaced where it
    drops by more than the window's threshold, which slope and cell make and `most` caps.
    """
    if not valid.any():
        return np.full(z.shape, np.nan)
    surface = z if valid.all() else filled(z, valid)
    before, last = surface, 0
    for size in sizes:
        radius = last if legacy else size
        opened = _slide(_slide(surface, radius, True, legacy), radius, False, legacy)
        if legacy:
            surface = np.where(opened < surface, opened, surface)
        else:
            limit = min(least if size <= 3 else slope * (size - last) * cell + least, most)
            surface = np.where(surface - opened > limit, opened, surface)
        last = size
    return np.where(np.abs(before - surface) <= keep, before, surface)


def ground_surface(raster: DataFrame, g: Grid, value: str, sizes: list[int], tile: int = 1024, **options) -> DataFrame:
    """morphological_filter over tiles with a halo: row, col, ground, for every cell of the grid.

    Empty cells are filled over the whole raster first. The halo is twice the sum of the radii, as far as a chain of openings
    reaches, so the size of tiles changes nothing. A tile and its halo are what one task holds. An empty raster gives null ground.
    """
    radii = sizes[:-1] if options.get("legacy", True) else sizes
    margin = min(2 * sum(radii) + 1, max(g.rows, g.columns))
    full = nearest_fill(raster.select("row", "col", F.col(value).cast("double").alias("z")), g, "z")
    spread = _tiles(full, tile, margin).where((F.col("tr") >= 0) & (F.col("tr") <= (g.rows - 1) // tile) & (F.col("tc") >= 0) & (F.col("tc") <= (g.columns - 1) // tile))

    def one(t: pa.Table) -> pa.Table:
        row, col, v = (t[c].to_numpy() for c in ("row", "col", "z"))
        top, left = row.min(), col.min()
        z = np.full((row.max() - top + 1, col.max() - left + 1), np.nan)
        z[row - top, col - left] = v
        out = morphological_filter(z, ~np.isnan(z), g.size, sizes, **options)
        core = (row // tile == t["tr"][0].as_py()) & (col // tile == t["tc"][0].as_py())
        found = out[row[core] - top, col[core] - left]
        return pa.table({"row": row[core], "col": col[core], "ground": pa.array(found, mask=np.isnan(found))})

    return spread.groupBy("tr", "tc").applyInArrow(lambda t: one(t), "row long, col long, ground double")


def stretch(df: DataFrame, value: str, way: str = "linear") -> DataFrame:
    """df with stretched: 0 to 1 between the extremes, or between mean -/+ 2 standard deviations ("legacy": -/+ 2 means)."""
    s = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd")).first()
    if s["lo"] is None:
        return df.withColumn("stretched", F.lit(None).cast("double"))
    low, high = {"linear": (s["lo"], s["hi"]), "stddev": (s["mean"] - 2 * s["sd"], s["mean"] + 2 * s["sd"]), "legacy": (s["mean"] - 2 * s["mean"], s["mean"] + 2 * s["mean"])}[way]
    part = (F.col(value) - F.lit(float(low))) / F.lit(float(high - low) or 1.0)
    return df.withColumn("stretched", F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0)))


def running(column: Column | str, *by: str, order: str, descending: bool = False) -> Column:
    """The sum over the rows so far, by order."""
    w = Window.partitionBy(*by).orderBy(F.col(order).desc() if descending else F.col(order))
    return F.sum(column).over(w.rowsBetween(Window.unboundedPreceding, 0))
