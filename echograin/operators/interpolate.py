"""From scattered points to grid cells: nearest, inverse distance, and linear over triangles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import column_of, row_of
from ..model import Grid, InvalidSetting
from ..session import scratch


def _offers(points: DataFrame, g: Grid, reach: int, value: str) -> DataFrame:
    """points, each at every cell within `reach` cells of its own, with the distance to that cell's centre."""
    steps = F.array(*[F.struct(F.lit(d).alias("dr"), F.lit(e).alias("dc")) for d in range(-reach, reach + 1) for e in range(-reach, reach + 1)])
    at = points.select("x", "y", value, row_of("y", g).alias("r"), column_of("x", g).alias("c"), F.explode(steps).alias("s"))
    at = at.select("x", "y", value, (F.col("r") + F.col("s.dr")).alias("row"), (F.col("c") + F.col("s.dc")).alias("col"))
    at = at.where((F.col("row") >= 0) & (F.col("row") < g.rows) & (F.col("col") >= 0) & (F.col("col") < g.columns))
    dx = F.col("x") - (F.lit(g.x_min + g.size / 2) + F.col("col") * g.size)
    dy = F.col("y") - (F.lit(g.y_max - g.size / 2) - F.col("row") * g.size)
    return at.withColumn("far", dx * dx + dy * dy).where(F.col("far") <= (reach * g.size) ** 2)


def nearest(points: DataFrame, g: Grid, reach: int, value: str = "z") -> DataFrame:
    """row, col, value of the nearest point within `reach` cells of the centre; ties to the least x, y, value."""
    best = F.min_by(value, F.struct("far", "x", "y", value))
    return _offers(points, g, reach, value).groupBy("row", "col").agg(best.alias(value))


def inverse_distance(points: DataFrame, g: Grid, reach: int, value: str = "z", power: float = 2.0, least: float = 1e-6) -> DataFrame:
    """row, col, value weighted by distance to the power, over points within `reach` cells."""
    w = F.lit(1.0) / F.pow(F.greatest(F.sqrt("far"), F.lit(least)), F.lit(power))
    out = _offers(points, g, reach, value).withColumn("w", w)
    return out.groupBy("row", "col").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias(value))


def _tilt(x: np.ndarray, y: np.ndarray, scale: float) -> np.ndarray:
    """A tiny number for each place, which depends on the place alone: it settles which way squares are cut, everywhere alike."""
    h = (x + 0.0).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (y + 0.0).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(11)).astype(float) * 2.0**-53 * 1e-9 * scale * scale


def triangles(x: np.ndarray, y: np.ndarray, scale: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Delaunay triangles of different places, and each one's circle (x, y, radius), by insertion from west to east.

    A triangle whose circle ends west of the point that comes next is finished, so few are looked at for each point.
    """
    n = len(x)
    span = max(np.ptp(x), np.ptp(y), 1.0) * 1e3
    px, py = np.append(x, [x.mean() - span, x.mean() + span, x.mean()]), np.append(y, [y.mean() - span, y.mean() - span, y.mean() + span])
    tilt = np.append(_tilt(x, y, scale), [0.0] * 3)

    def circles(t: np.ndarray) -> np.ndarray:
        ax, ay = px[t[:, 0]], py[t[:, 0]]
        bx, by, cx, cy = px[t[:, 1]] - ax, py[t[:, 1]] - ay, px[t[:, 2]] - ax, py[t[:, 2]] - ay
        with np.errstate(divide="ignore", invalid="ignore"):
            d = 2 * (bx * cy - by * cx)
            ux, uy = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
        return np.column_stack([ax + ux, ay + uy, np.hypot(ux, uy)])

    tri = np.array([[n, n + 1, n + 2]])
    round_ = circles(tri)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    for k, p in enumerate(np.lexsort((y, x)).tolist()):
        if k % 32 == 0:
            past = round_[:, 0] + round_[:, 2] < px[p] - 1e-4 * scale
            if past.any():
                done.append((tri[past], round_[past]))
                tri, round_ = tri[~past], round_[~past]
        a, b, c = tri.T
        ax, ay, bx, by, cx, cy = px[a] - px[p], py[a] - py[p], px[b] - px[p], py[b] - py[p], px[c] - px[p], py[c] - py[p]
        za, zb, zc = ax * ax + ay * ay + tilt[a] - tilt[p], bx * bx + by * by + tilt[b] - tilt[p], cx * cx + cy * cy + tilt[c] - tilt[p]
        hit = za * (bx * cy - cx * by) - zb * (ax * cy - cx * ay) + zc * (ax * by - bx * ay) > 0
        if not hit.any():
            continue
        sides = {side for t in tri[hit].tolist() for side in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))}
        new = np.array([(u, v, p) for u, v in sides if (v, u) not in sides])
        tri, round_ = np.concatenate([tri[~hit], new]), np.concatenate([round_[~hit], circles(new)])
    tri, round_ = np.concatenate([*(t for t, _ in done), tri]), np.concatenate([*(r for _, r in done), round_])
    own = (tri < n).all(1)
    return tri[own], round_[own]


def _linear(x: np.ndarray, y: np.ndarray, z: np.ndarray, tx: np.ndarray, ty: np.ndarray, scale: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Values at targets, nan outside the triangles, and the circle of the triangle that each lies in."""
    out, around = np.full(len(tx), np.nan), np.full((len(tx), 3), np.nan)
    tri, round_ = triangles(x, y, scale)
    if len(tri) == 0 or len(tx) == 0:
        return out, around
    xs, ys = x[tri], y[tri]
    slack = 1e-9 * scale
    near = (xs.max(1) >= tx.min() - slack) & (xs.min(1) <= tx.max() + slack) & (ys.max(1) >= ty.min() - slack) & (ys.min(1) <= ty.max() + slack)
    for (a, b, c), circle in zip(tri[near].tolist(), round_[near]):
        d = (y[b] - y[c]) * (x[a] - x[c]) + (x[c] - x[b]) * (y[a] - y[c])
        if abs(d) < 1e-12:
            continue
        u = ((y[b] - y[c]) * (tx - x[c]) + (x[c] - x[b]) * (ty - y[c])) / d
        v = ((y[c] - y[a]) * (tx - x[c]) + (x[a] - x[c]) * (ty - y[c])) / d
        hit = (u >= -1e-9) & (v >= -1e-9) & (u + v <= 1 + 1e-9)
        out[hit] = u[hit] * z[a] + v[hit] * z[b] + (1 - u[hit] - v[hit]) * z[c]
        around[hit] = circle
    return out, around


def linear_at(x: np.ndarray, y: np.ndarray, z: np.ndarray, tx: np.ndarray, ty: np.ndarray) -> np.ndarray:
    """Linear over Delaunay triangles; nan outside the hull. At least four points are needed, at different places."""
    if len(x) < 4:
        raise InvalidSetting("interpolation needs at least 4 points")
    return _linear(x, y, z, tx, ty)[0]


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The corners of the convex hull, against the clock."""
    points = np.unique(np.column_stack([x, y]), axis=0)
    if len(points) < 3:
        return points

    def half(order: np.ndarray) -> list[np.ndarray]:
        chain: list[np.ndarray] = []
        for p in order:
            while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) <= 0:
                chain.pop()
            chain.append(p)
        return chain[:-1]

    return np.array(half(points) + half(points[::-1]))


def _hull_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros((0, 2))
    for batch in batches:
        x, y = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        held = hull(np.append(held[:, 0], x), np.append(held[:, 1], y))
    yield pa.RecordBatch.from_arrays([pa.array(held[:, 0].copy()), pa.array(held[:, 1].copy())], ["x", "y"])


def linear(points: DataFrame, g: Grid, tile: int = 16, margin: int = 2, value: str = "z") -> DataFrame:
    """row, col, value of each cell whose centre lies within the hull of all points: linear over the triangles of all points.

    Points at one place count as the lowest of them. A tile of cells takes the points within `margin` cells of it; a cell is settled if the
    circle of its triangle lies where all points are known, for then no point elsewhere changes the triangle. Tiles with
    cells that aren't go round again with twice the margin. So tiles and margins change nothing but the work: a task holds a tile
    and as much around it as its triangles reach. Squares of points are cut the same way wherever they are met.
    """
    spark = points.sparkSession
    places = points.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col("x").cast("double")) & ~F.isnan(F.col("y").cast("double")))
    places = places.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col(value).cast("double").alias("z")).groupBy("x", "y").agg(F.min("z").alias("z"))
    path = scratch(spark, "places")
    places.withColumns({"r": row_of("y", g), "c": column_of("x", g)}).write.parquet(path)
    places = spark.read.parquet(path)
    # A hull for each partition, of which the corners reach the driver.
    corners = places.select("x", "y").mapInArrow(_hull_kernel, "x double, y double").toArrow()
    rim = hull(corners["x"].to_numpy(), corners["y"].to_numpy())
    shape = f"row long, col long, `{value}` double"
    if len(rim) < 3:
        return spark.createDataFrame([], shape)
    (x_low, y_low), (x_high, y_high) = rim.min(0), rim.max(0)

    def inside(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ok = np.ones(len(x), bool)
        for (x1, y1), (x2, y2) in zip(rim, np.roll(rim, -1, axis=0)):
            ok &= (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) >= 0
        return ok

    def task(wide: int) -> Callable[[tuple, pa.Table], pa.Table]:
        def one(key: tuple, t: pa.Table) -> pa.Table:
            tr, tc = key[0].as_py(), key[1].as_py()
            r, c = np.meshgrid(np.arange(tr * tile, min(g.rows, (tr + 1) * tile)), np.arange(tc * tile, min(g.columns, (tc + 1) * tile)), indexing="ij")
            r, c = r.ravel(), c.ravel()
            tx, ty = g.x_min + g.size * (c + 0.5), g.y_max - g.size * (r + 0.5)
            within = inside(tx, ty)
            r, c, tx, ty = r[within], c[within], tx[within], ty[within]
            left, right = g.x_min + g.size * (tc * tile - wide), g.x_min + g.size * ((tc + 1) * tile + wide)
            top, bottom = g.y_max - g.size * (tr * tile - wide), g.y_max - g.size * ((tr + 1) * tile + wide)
            x, y, z = (t[k].to_numpy() for k in "xyz")
            out, circle = _linear(x, y, z, tx, ty, g.size) if len(x) > 2 else (np.full(len(tx), np.nan), np.full((len(tx), 3), np.nan))
            whole = left <= x_low and right > x_high and bottom < y_low and top >= y_high
            cx, cy, radius = circle.T
            far = radius * (1 + 1e-6) + 1e-6 * g.size
            known = ((cx - far >= left) | (left <= x_low)) & ((cx + far < right) | (right > x_high)) & ((cy - far > bottom) | (bottom < y_low)) & ((cy + far <= top) | (top >= y_high))
            final = np.full(len(tx), whole) | (known & ~np.isnan(out))
            if not final.all():
                return pa.table({"tr": [tr], "tc": [tc], "row": pa.array([None], pa.int64()), "col": pa.array([None], pa.int64()), "v": pa.array([None], pa.float64())})
            at = ~np.isnan(out)
            own = [np.append(r[at], -1), np.append(c[at], -1), np.append(out[at], 0.0)]  # the last row says that the tile is done
            return pa.table({"tr": np.full(len(own[0]), tr), "tc": np.full(len(own[0]), tc), "row": own[0], "col": own[1], "v": own[2]})

        return one

    across = -(-g.columns // tile)
    pending = spark.range(-(-g.rows // tile) * across).select(F.floor(F.col("id") / across).alias("tr"), (F.col("id") % across).alias("tc"))
    found: list[DataFrame] = []
    while True:

        def reach(k: str, n: int, wide: int = margin) -> Column:
            low = F.greatest(F.floor((F.col(k) - wide) / tile), F.lit(0).cast("long"))
            high = F.least(F.floor((F.col(k) + wide) / tile), F.lit((n - 1) // tile).cast("long"))
            return F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>")))

        spread = places.withColumn("tr", reach("r", g.rows)).withColumn("tc", reach("c", g.columns)).join(pending, ["tr", "tc"], "left_semi")
        path = scratch(spark, "interpolated")
        spread.select("tr", "tc", "x", "y", "z").groupBy("tr", "tc").applyInArrow(task(margin), "tr long, tc long, row long, col long, v double").write.parquet(path)
        told = spark.read.parquet(path)
        found.append(told.where("row >= 0"))
        path = scratch(spark, "pending")
        # Tiles without a point in reach told nothing; they go on until all points are.
        pending.join(told.where("row is not null").select("tr", "tc").distinct(), ["tr", "tc"], "left_anti").write.parquet(path)
        pending = spark.read.parquet(path)
        reached = g.size * margin
        all_known = g.x_min - reached <= x_low and g.x_min + g.size * g.columns + reached > x_high and g.y_max + reached >= y_high and g.y_max - g.size * g.rows - reached < y_low
        all_known = all_known and margin >= max(g.rows, g.columns)
        if all_known or pending.limit(1).count() == 0:
            break
        margin *= 2
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("row", "col", F.col("v").alias(value))


METHODS = {"nearest": nearest, "idw": inverse_distance, "linear": linear}


def interpolate(points: DataFrame, g: Grid, method: str, **options) -> DataFrame:
    if method not in METHODS:
        raise InvalidSetting(f"unknown interpolation {method}; there are {', '.join(METHODS)}")
    return METHODS[method](points, g, **options)
