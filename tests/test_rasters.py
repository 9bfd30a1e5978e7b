"""Rasters, polygons and pulses of ordinary size, against plain computations."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from echograin.model import Grid, InvalidSetting
from echograin.operators import grid, interpolate, pulses, raster, vector
from echograin.plans import blocks


def frame(spark, z, valid):
    r, c = np.nonzero(valid)
    return spark.createDataFrame(pa.table({"row": r, "col": c, "v": z[r, c]}))


def array(df, shape, name="v"):
    t = df.toArrow()
    out = np.full(shape, np.nan)
    out[t["row"].to_numpy(), t["col"].to_numpy()] = t[name].to_numpy()
    return out


def brute_fill(z, valid):
    r, c = np.nonzero(valid)
    rr, cc = np.indices(z.shape)
    far = (rr[..., None] - r) ** 2 + (cc[..., None] - c) ** 2
    return z[r, c][far.argmin(-1)], far.min(-1)


@pytest.mark.parametrize("share", [0.003, 0.05, 0.6])
def test_nearest_fill(spark, share):
    rng = np.random.default_rng(1)
    z, valid = rng.integers(0, 1000, (41, 67)).astype(float), rng.random((41, 67)) < share
    valid[7, 3] = True
    want, far = brute_fill(z, valid)
    assert np.array_equal(raster.filled(z, valid), want)
    g = Grid(0.0, 41.0, 1.0, 41, 67)
    assert np.array_equal(array(raster.nearest_fill(frame(spark, z, valid), g, "v"), z.shape), want)
    near = array(raster.nearest_fill(frame(spark, z, valid), g, "v", reach=3), z.shape)
    assert np.array_equal(near, np.where(far <= 9, want, np.nan), equal_nan=True)


def test_fill_of_nothing(spark):
    g = Grid(0.0, 4.0, 1.0, 4, 5)
    none = spark.createDataFrame([], "row long, col long, v double")
    assert raster.nearest_fill(none, g, "v").where("v is null").count() == 20
    assert raster.ground_surface(none, g, "v", [1, 3]).where("ground is null").count() == 20


def slow_slide(a, heights, erode):
    n = heights.shape[0] // 2
    padded = np.pad(a, n, mode="symmetric")
    out = np.full(a.shape, np.inf if erode else -np.inf)
    for i in range(2 * n + 1):
        for j in range(2 * n + 1):
            if np.isfinite(heights[i, j]):
                moved = padded[i : i + a.shape[0], j : j + a.shape[1]]
                out = np.minimum(out, moved - heights[i, j]) if erode else np.maximum(out, moved + heights[i, j])
    return out


@pytest.mark.parametrize("radius", [0, 1, 2, 5, 9])
@pytest.mark.parametrize("raised", [False, True])
def test_sliding_windows(radius, raised):
    a = np.random.default_rng(radius).normal(size=(23, 31))
    x = np.arange(-radius, radius + 1)
    disk = x[:, None] ** 2 + x**2 <= radius**2
    heights = disk.astype(float) if raised else np.where(disk, 0.0, np.nan)
    for erode in (True, False):
        assert np.array_equal(raster._slide(a, radius, erode, raised), slow_slide(a, heights, erode))


@pytest.mark.parametrize("legacy", [True, False])
def test_ground_of_several_tiles(spark, legacy):
    rng = np.random.default_rng(4)
    z, valid = rng.normal(50, 4, (150, 170)), rng.random((150, 170)) < 0.4
    valid[30:110, 40:130] = False  # a gap wider than the halo
    g = Grid(0.0, 150.0, 1.0, 150, 170)
    sizes = raster.windows(1, 4)
    want = raster.morphological_filter(z, valid, 1.0, sizes, legacy=legacy)
    for tile in (31, 64, 1024):
        got = array(raster.ground_surface(frame(spark, z, valid), g, "v", sizes, tile=tile, legacy=legacy), z.shape, "ground")
        assert np.allclose(got, want)


def test_default_filter_of_a_large_tile():
    """The default windows over 2,000 x 2,000 cells, which one task can hold with its halo."""
    z = np.random.default_rng(5).normal(50, 4, (2000, 2000))
    valid = np.random.default_rng(6).random(z.shape) < 0.3
    out = raster.morphological_filter(z, valid, 1.0, raster.windows(1, 5))
    assert out.shape == z.shape and np.isfinite(out).all() and (out <= raster.filled(z, valid)).all()


@pytest.mark.parametrize("reduce", ["min", "max"])
def test_focal_over_tiles(spark, reduce):
    rng = np.random.default_rng(2)
    z, valid = rng.integers(0, 50, (30, 40)).astype(float), rng.random((30, 40)) < 0.5
    df = frame(spark, z, valid)
    for radius in (3.5, 6):
        cells = array(raster._focal_by_tiles(df, "v", radius, reduce, 11), z.shape)
        r, c = np.nonzero(valid)
        near = (r[:, None] - r) ** 2 + (c[:, None] - c) ** 2 <= radius**2
        want = np.full(z.shape, np.nan)
        want[r, c] = np.where(near, z[r, c], np.inf if reduce == "min" else -np.inf).__getattribute__(reduce)(1)
        assert np.array_equal(cells, want, equal_nan=True)


def winding(x, y, ring):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * ((x2 - x1) / (y2 - y1)):
            odd = not odd
    return odd


@pytest.mark.parametrize("edges", [7, 5000])
def test_polygons_of_many_edges(spark, edges):
    rng = random.Random(edges)
    ring = [(50 + (30 + 9 * rng.random()) * math.cos(2 * math.pi * k / edges), 50 + (30 + 9 * rng.random()) * math.sin(2 * math.pi * k / edges)) for k in range(edges)]
    hole = [(45.0, 45.0), (55.0, 45.0), (55.0, 55.0), (45.0, 55.0)]
    points = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(400)] + [(400, None, 5.0), (401, 50.0, None), (402, float("nan"), 50.0), (403, 50.0, 50.0)]
    df = spark.createDataFrame(points, "i int, x double, y double")
    got = {r["i"]: r["inside"] for r in vector.inside_rings(df, [ring, hole]).collect()}
    assert len(got) == len(points)
    for i, x, y in points:
        known = x is not None and y is not None and x == x
        assert got[i] == (known and (winding(x, y, ring) or winding(x, y, hole)))
    assert vector.inside_rings(df, []).where("inside").count() == 0


def test_polygons_beyond_a_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(2.0, 2.0), (9.0, 9.0)], "x double, y double")
    monkeypatch.setattr(vector, "BROADCAST", 0)
    got = vector.inside_rings(df, [[(0.0, 0.0), (5.0, 0.0), (5.0, 5.0), (0.0, 5.0)]])
    assert sorted(tuple(r) for r in got.collect()) == [(2.0, 2.0, True), (9.0, 9.0, False)]


def test_strict_pulses_of_any_records(spark):
    rng = random.Random(9)
    rows = [(f, at, rng.choice([0, 1, 2, 3, 7, 40, None])) for f, n in (("a", 400), ("b", 1), (None, 90)) for at in range(n)]
    want = {}
    for f in ("a", "b", None):
        pulse, left, nth = -1, 0, 0
        for g, at, n in rows:
            if g == f:
                if left <= 0:
                    pulse, left, nth = pulse + 1, max(1, n or 1), 0
                nth += 1
                left -= 1
                want[f, at] = (pulse, nth)
    df = spark.createDataFrame(rows, "file string, at long, n int")
    for block in (1, 16, 1 << 16):
        got = {(r["file"], r["at"]): (r["pulse"], r["nth"]) for r in pulses.build_pulses_strictly(df, "at", "n", "file", block).collect()}
        assert got == want


def test_sums_of_cells_and_functions(spark):
    df = spark.createDataFrame([(0.5, 3.5, 1.0), (0.6, 3.4, 4.0), (2.5, 0.5, 2.0)], "x double, y double, z double")
    g = Grid(0.0, 4.0, 1.0, 4, 4)
    assert sorted(tuple(r) for r in grid.bin_index(df, g).collect()) == [(0, 0, 2, 0), (3, 2, 1, 2)]
    assert sorted(tuple(r) for r in grid.rasterize_by(df, g, lambda z: z.max() - z.min(), "z", "my span").collect()) == [(0, 0, 3.0), (3, 2, 0.0)]


def test_settings_of_the_session(spark):
    spark.conf.set("spark.echograin.window", "12")
    try:
        assert blocks.Controls.of(spark).window == 12 and blocks.Controls.of(spark, window=5).window == 5
        spark.conf.set("spark.echograin.window", "wide")
        with pytest.raises(InvalidSetting):
            blocks.Controls.of(spark)
    finally:
        spark.conf.unset("spark.echograin.window")


@pytest.mark.parametrize("lattice", [False, True])
def test_linear_over_tiles(spark, lattice):
    """Over tiles of any size as over one whole triangulation, on scattered points with a gap and on squares of points."""
    rng = np.random.default_rng(8)
    x, y = (rng.integers(0, 40, (2, 900)) / 2.0) if lattice else rng.uniform(-2, 22, (2, 300))
    gap = (np.abs(x - 10) < 4) & (np.abs(y - 9) < 3)
    x, y = x[~gap], y[~gap]
    z = rng.normal(size=len(x))
    order = np.lexsort((z, y, x))
    x, y, z = x[order], y[order], z[order]
    first = np.append(True, (np.diff(x) != 0) | (np.diff(y) != 0))
    g = Grid(-1.0, 21.0, 1.0, 22, 22)
    c, r = np.meshgrid(np.arange(22), np.arange(22))
    want = interpolate._linear(x[first], y[first], z[first], -1 + c.ravel() + 0.5, 21 - r.ravel() - 0.5)[0].reshape(22, 22)
    df = spark.createDataFrame(pa.table({"x": x, "y": y, "z": z}))
    for tile, margin in ((5, 1), (11, 2), (64, 64)):
        got = array(interpolate.linear(df, g, tile, margin), (22, 22), "z")
        # A cell that the hull's own edge passes may count to it or not.
        both = ~np.isnan(got) & ~np.isnan(want)
        assert both.sum() >= 0.98 * max((~np.isnan(got)).sum(), (~np.isnan(want)).sum()) and np.allclose(got[both], want[both], atol=1e-6)


def test_triangles_are_delaunay():
    rng = np.random.default_rng(11)
    x, y = rng.uniform(0, 10, (2, 120))
    tri, circle = interpolate.triangles(x, y)
    far = np.hypot(x[None, :] - circle[:, :1], y[None, :] - circle[:, 1:2])
    assert (far >= circle[:, 2:] - 1e-6).all() and len(tri) >= 2 * len(x) - 2 - len(interpolate.hull(x, y)) - 4


def test_linear_of_few_points(spark):
    g = Grid(0.0, 4.0, 1.0, 4, 4)
    for points in ([], [(1.0, 1.0, 2.0)], [(0.0, 0.0, 1.0), (4.0, 4.0, 2.0)], [(None, 1.0, 1.0), (1.0, float("nan"), 1.0)]):
        assert interpolate.linear(spark.createDataFrame(points, "x double, y double, z double"), g).count() == 0
    flat = spark.createDataFrame([(0.0, 0.0, 3.0), (4.0, 0.0, 3.0), (0.0, 4.0, 3.0), (4.0, 4.0, 3.0)], "x double, y double, z double")
    assert sorted({round(r["z"], 9) for r in interpolate.linear(flat, g, tile=2, margin=1).collect()}) == [3.0]
