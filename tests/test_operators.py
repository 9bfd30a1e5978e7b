import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from echograin import model
from echograin.functions import columns as C
from echograin.model import Extent, Grid
from echograin.operators import grid, interpolate, profile, pulses, raster, vector, voxel
from echograin.plans import blocks, catalogue, catalogue_files


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_box_edges(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 1.0), (0.0, 0.0), (0.5, 0.5)], "x double, y double")
    assert rows(df.where(C.in_box("x", "y", Extent(0, 1, 0, 1))), "x", "y") == [(0.0, 1.0), (0.5, 0.5)]
    g = Grid(0.0, 1.0, 1.0, 1, 1)
    assert grid.binned(df, g).count() == 2


def test_scaling_rounds_half_to_even_and_checks_range(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (-1.0,)], "v double")
    assert [r[0] for r in df.select(C.scale_encode("v", 1.0, 0.0, "UINT32", strict=False)).collect()] == [2, 4, None]
    with pytest.raises(Exception, match="outside UINT32"):
        df.select(C.scale_encode("v", 1.0, 0.0).alias("s")).collect()


def test_recode_is_simultaneous(spark):
    df = spark.createDataFrame([(2,), (3,), (9,)], "c int")
    assert [r[0] for r in df.select(C.recoded("c", {2: 3, 3: 2})).collect()] == [3, 2, 9]


def test_rotation_and_angles():
    m = C.rotation(math.pi / 2, 0.0, 0.0)
    assert np.allclose(m @ [1, 0, 0, 1], [0, 1, 0, 1])
    assert np.allclose(C.rotation(float("nan"), 0, 0), np.eye(4))


def test_working_grid():
    a, b = Extent(0.2, 10, 0, 10), Extent(5, 20, 5, 20)
    assert model.working_grid([a, b], 1.0, "intersection").extent == Extent(5, 10, 5, 10)
    assert model.working_grid([a, b], 1.0).extent == Extent(0, 20, 0, 20)
    with pytest.raises(model.InvalidSetting):
        Extent(0, 1, 0, 1).intersection(Extent(2, 3, 2, 3))


@pytest.mark.parametrize("block", [1, 64, 4096, 1 << 16])
def test_totals_and_runs_do_not_depend_on_blocks(spark, sf, block):
    n = spark.range(1000).select(F.col("id").alias("pulse_id"), (F.col("id") % 7).alias("n"))
    got = dict(rows(pulses.start_index(n, block=block), "pulse_id", "start"))
    total = 0
    for k in range(1000):
        assert got[k] == total
        total += k % 7
    e = catalogue.fixtures.records(spark, sf).limit(500)
    found = rows(pulses.runs(e, "event_id", ["event_type"], block=block), "event_id", "run", "event_type")
    found.sort()
    run = 0
    for a, b in zip(found, found[1:]):
        run += a[2] != b[2]
        assert b[1] == run


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_places_in_runs_that_cross_blocks(spark, block):
    rng = np.random.default_rng(5)
    at = np.cumsum(rng.integers(1, 4, 300)).tolist()  # with gaps, whole blocks among them
    at = at[:150] + [a + 50 for a in at[150:]]
    key = [None if k == 3 else int(k) for k in np.repeat(rng.integers(0, 4, 60), rng.integers(1, 30, 60))[:300]]
    df = spark.createDataFrame(list(zip(at, key)), "at long, k int").repartition(3)
    run, place, want = 0, 0, []
    for i, k in enumerate(key):
        run, place = (run + 1, 1) if i and k != key[i - 1] else (run, place + 1)
        want.append((at[i], run, place, k))
    found = pulses.runs(df, "at", ["k"], block, nth="place").select("at", "run", "place", "k")
    assert sorted(map(tuple, found.collect())) == want
    assert max(w[2] for w in want) > 14


def test_strict_pulse_building(spark):
    df = spark.createDataFrame([("f", 0, 2), ("f", 1, 2), ("f", 2, 3), ("f", 3, 1), ("f", 4, 1), ("f", 5, 1)], "file string, at long, number_of_returns int")
    got = pulses.build_pulses_strictly(df, "at", "number_of_returns", "file")
    assert [r[1] for r in rows(got, "at", "pulse")] == [0, 0, 1, 1, 1, 2]


def test_halo_blocks_give_what_one_block_gives(spark, sf):
    low = catalogue._low(spark, sf)
    once = rows(raster.focal(low, "v", 2, "min"), "row", "col", "v")
    pts = low.select((F.col("col") * 5 + 2.5).alias("x"), (F.lit(60.0) - F.col("row") * 5 - 2.5).alias("y"), "v")

    def smallest(pdf):
        r, c, v = (pdf[k].to_numpy() for k in ("row", "col", "v"))
        near = (r[:, None] - r) ** 2 + (c[:, None] - c) ** 2 <= 4
        return pdf.assign(v=np.where(near, v, np.inf).min(1))[pdf["core"]][["row", "col", "v"]]

    for window in (3, 50):
        got = blocks.process(pts, smallest, "row long, col long, v double", blocks.Controls(window, 2, catalogue.G5))
        assert rows(got, "row", "col", "v") == once


def test_crowded_blocks_come_in_pieces(spark, sf, monkeypatch):
    pts = catalogue.P(spark, sf).select("x", "y", "z")

    def told(pdf):
        return type(pdf)({"tile_row": [pdf["tile_row"].iloc[0]], "tile_col": [pdf["tile_col"].iloc[0]], "n": [len(pdf)], "most": [len(pdf)], "low": [pdf["z"].min()]})

    shape, controls = "tile_row long, tile_col long, n long, most int, low double", blocks.Controls(4, 2, catalogue.G5)
    whole = rows(blocks.process(pts, told, shape, controls), "tile_row", "tile_col", "n", "low")
    monkeypatch.setattr(blocks, "PIECE", 70)
    pieces = blocks.process(pts, told, shape, controls, {"n": "sum", "most": "max", "low": "min"})
    assert rows(pieces, "tile_row", "tile_col", "n", "low") == whole and pieces.schema["most"].dataType.typeName() == "integer"
    assert max(r["most"] for r in pieces.collect()) <= 70 < max(n for _, _, n, _ in whole)
    with pytest.raises(model.FunctionUnsupported):
        blocks.process(pts, told, shape, controls, {"n": "median"})

    query = catalogue_files.block_function(spark, sf)
    assert "FlatMapGroups" not in query._jdf.queryExecution().toString()
    assert sorted((r["tile_row"], r["tile_col"], r["n"]) for r in query.collect()) == [w[:3] for w in whole]


def test_ground_surface_does_not_depend_on_tiles(spark, sf):
    g = catalogue.G2
    low = grid.rasterize(catalogue.P(spark, sf), g, {"low": ("min", "z")}).where("low < 40")
    want = rows(raster.ground_surface(low, g, "low", [1, 3], tile=1000), "row", "col", "ground")
    z, valid = np.zeros((g.rows, g.columns)), np.zeros((g.rows, g.columns), bool)
    for r in low.collect():
        z[r["row"], r["col"]], valid[r["row"], r["col"]] = r["low"], True
    direct = raster.morphological_filter(z, valid, g.size, [1, 3])
    assert all(abs(direct[r, c] - v) < 1e-9 for r, c, v in want)


def test_flat_filter_removes_a_spike():
    z = np.zeros((15, 15))
    z[7, 7] = 9.0
    out = raster.morphological_filter(z, np.ones_like(z, bool), 1.0, [1, 3], legacy=False)
    assert out[7, 7] == 0.0 and np.all(out == 0)


def brute_trace(o, d, v):
    """Voxels in which a fine march along the ray lies."""
    seen = []
    for t in np.arange(0, 60, 0.001):
        c = np.floor((o + t * d - v.low) / v.size)
        if ((c >= 0) & (c < v.counts)).all():
            k = int(v.index(*c))
            if not seen or seen[-1] != k:
                seen.append(k)
    return seen


def test_trace_against_marching():
    v = voxel.Voxels(-5.0, -5.0, 0.0, 1.0, 10, 10, 10)
    rng = np.random.default_rng(1)
    o = rng.uniform(-8, 8, (20, 3))
    d = rng.normal(size=(20, 3))
    d /= np.linalg.norm(d, axis=1)[:, None]
    path = {i: [] for i in range(20)}
    for rays, cell in voxel.trace(o, d, v):
        for r, c in zip(rays, cell):
            path[r].append(int(c))
    for i in range(20):
        want = brute_trace(o[i], d[i], v)
        # A march may step over a corner that is cut very short.
        assert set(want) <= set(path[i]) and len(path[i]) - len(want) <= 1


def test_account_of_one_ray():
    v = voxel.Voxels(0.0, 0.0, 0.0, 1.0, 1, 1, 4)
    cells, sums = voxel.account(np.array([[0.5, 0.5, 0.0]]), np.array([0.0]), np.array([0.0]), [np.array([1, 2])], v)
    assert cells.tolist() == [0, 1, 2, 3]
    assert sums.tolist() == [[0, 1, 0], [0.5, 0.5, 0.5], [0.5, 0, 1], [0, 0, 1]]
    cells, sums = voxel.account(np.array([[0.5, 0.5, 0.0]]), np.array([0.0]), np.array([0.0]), [np.array([], int)], v)
    assert sums.tolist() == [[0, 1, 0]] * 4


def test_cover_of_one_is_no_trouble(spark):
    v = voxel.Voxels(0, 0, 0, 1.0, 1, 1, 3)
    got = dict(rows(voxel.cover_from_above(spark.createDataFrame([(2, 1.0), (1, 0.5), (0, 0.25)], "vidx long, cover double"), v), "vidx", "cover"))
    assert got == {2: 1.0, 1: 1.0, 0: 1.0}


def test_interpolation(spark):
    x, y = (a.ravel().astype(float) for a in np.meshgrid(np.arange(6), np.arange(6)))
    x = x + 0.01 * y * y
    z = 2 * x - y + 3
    tx, ty = np.array([1.3, 2.7, 4.1]), np.array([1.1, 3.3, 2.2])
    assert np.allclose(interpolate.linear_at(x, y, z, tx, ty), 2 * tx - ty + 3)
    with pytest.raises(model.InvalidSetting):
        interpolate.linear_at(x[:3], y[:3], z[:3], tx, ty)
    with pytest.raises(model.InvalidSetting):
        interpolate.interpolate(None, None, "kriging")


def test_huber_plane_ignores_outliers():
    rng = np.random.default_rng(0)
    x, y = rng.uniform(-10, 10, (2, 200))
    z = 1 + 0.1 * x - 0.2 * y + rng.normal(0, 0.01, 200)
    z[:10] += 50
    fit = profile.huber_plane(x, y, z)
    assert abs(fit["dx"] - 0.1) < 0.01 and abs(fit["dy"] + 0.2) < 0.01


def test_polygons_from_wkb():
    import struct

    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]
    one = struct.pack("<BII", 1, 3, 1) + struct.pack("<I", 4) + b"".join(struct.pack("<2d", *p) for p in ring)
    assert vector.rings_of_wkb(one) == [ring[:-1]]
    many = struct.pack("<BII", 1, 6, 2) + one + one
    assert len(vector.rings_of_wkb(many)) == 2


def test_rasterize_by_function_and_unknown_name(spark, sf):
    p = catalogue.P(spark, sf)
    by = rows(grid.rasterize_by(p, catalogue.G10, np.median, "z"), "row", "col", "value")
    assert by == rows(grid.rasterize(p, catalogue.G10, {"value": ("median", "z")}), "row", "col", "value")
    with pytest.raises(model.FunctionUnsupported):
        grid.rasterize(p, catalogue.G10, {"v": ("eval", "z")})


def test_checksum_is_free_of_order(spark, sf):
    p = catalogue.P(spark, sf)
    assert rows(grid.checksum(p, ["z"]), "column", "digest") == rows(grid.checksum(p.orderBy(F.desc("z")).repartition(7), ["z"]), "column", "digest")
