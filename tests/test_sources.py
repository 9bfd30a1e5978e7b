import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from echograin import cli, model
from echograin.model import Extent, Grid
from echograin.operators import pulses
from echograin.plans import catalogue, translate
from echograin.sources import las, lidar_formats, raster_files, store, text
from echograin.streaming import tiles


def test_text_with_runs(spark, tmp_path):
    lines = ["# t x y z", "1.5 0 0 1", "1.5,0 1\t2", "", "2.5 1 1 3", "1.5 5 5 5"]
    with gzip.open(tmp_path / "a.txt.gz", "wt") as f:
        f.write("\n".join(lines))
    columns = [("t", "FLOAT64"), ("x", "UINT8"), ("y", "UINT8"), ("z", "INT16")]
    pulses, points = text.read_pulses(spark, str(tmp_path / "a.txt.gz"), columns, ["t"])
    assert sorted((r["t"], r["number_of_returns"]) for r in pulses.collect()) == [(1.5, 1), (1.5, 2), (2.5, 1)]
    assert sorted((r["return_number"], r["z"]) for r in points.collect()) == [(1, 1), (1, 3), (1, 5), (2, 2)]


def test_pulses_of_a_long_file_are_built_in_blocks(spark, tmp_path, monkeypatch):
    # Pulses of 1 to 5 records; those at the borders of files are alike, and one crosses the border of blocks.
    each = np.repeat(np.arange(47000), np.arange(47000) % 5 + 1)
    for name, times in (("a", each[each < 25000]), ("b", np.concatenate([[24999] * 3, each[each >= 25000]]))):
        with gzip.open(tmp_path / f"{name}.txt.gz", "wt") as f:
            f.writelines(f"{t},{i}\n" + "# note\n" * (i % 1000 == 0) for i, t in enumerate(times))
    seen = []

    def runs(df, order, key, block=pulses.BLOCK, **more):
        seen.append((df, order, block))
        return pulses.runs(df, order, key, block, **more)

    monkeypatch.setattr(text, "runs", runs)
    beams, points = text.read_pulses(spark, str(tmp_path), [("t", "INT64"), ("i", "INT64")], ["t"])
    (df, order, block), = seen
    assert df.groupBy(F.floor(F.col(order) / block)).count().agg(F.max("count")).first()[0] <= 1 << 16 < df.count()
    assert not [n for n, kind in df.dtypes if kind == "string"]  # no path in what is sorted
    got = sorted((r["t"], r["number_of_returns"]) for r in beams.collect())
    assert got == sorted([(t, t % 5 + 1) for t in range(47000)] + [(24999, 3)])
    firsts = points.where("return_number = 1").count()
    assert firsts == len(got) and points.agg(F.sum("return_number")).first()[0] == sum(n * (n + 1) // 2 for _, n in got)
    late = points.groupBy("pulse_id").agg((F.max("i") - F.min("i") + 1).alias("n"), F.max("return_number").alias("last"), F.max(F.struct("i", "return_number"))["return_number"].alias("at_last"))
    assert late.where("n <> last OR last <> at_last").count() == 0


def test_text_errors(spark, tmp_path):
    (tmp_path / "b.txt").write_text("1 2\n1\n300 1\n")
    columns = [("a", "UINT8"), ("b", "INT8")]
    with pytest.raises(Exception, match="short row"):
        text.read_text(spark, str(tmp_path / "b.txt"), columns).collect()
    rows = text.read_text(spark, str(tmp_path / "b.txt"), columns, strict=False).orderBy("record_number").collect()
    assert [(r["a"], r["b"]) for r in rows] == [(1, 2), (1, None), (None, 1)]
    with pytest.raises(model.ColumnError):
        text.read_text(spark, str(tmp_path / "b.txt"), [("a", "FLOAT16")])


def test_las_round_trip(spark, tmp_path):
    n = 500
    rng = np.random.default_rng(2)
    p = {a: np.round(rng.uniform(0, 100, n), 2) for a in "xyz"} | {"return_number": np.tile([1, 2], n // 2), "number_of_returns": np.full(n, 2), "classification": rng.integers(0, 9, n), "gps_time": np.arange(n) / 10}
    (tmp_path / "a.las").write_bytes(las.las_bytes(p))
    got = las.read_las(spark, str(tmp_path)).orderBy("record_number").toPandas()
    assert np.allclose(got[["x", "y", "z", "gps_time"]], np.column_stack([p["x"], p["y"], p["z"], p["gps_time"]]))
    assert (got["classification"] == p["classification"]).all() and (got["return_number"] == p["return_number"]).all()
    written = las.write_las(las.read_las(spark, str(tmp_path)).select("x", "y", "z", "classification", "return_number", "number_of_returns"), str(tmp_path / "out"))
    assert sum(r["n"] for r in written.collect()) == n
    with pytest.raises(model.FormatNotUnderstood):
        las.header(b"nothing")


def test_store_scales_prunes_and_keeps_nulls(spark, sf, tmp_path):
    p = catalogue.P(spark, sf).withColumn("h", F.when(F.col("z") < 25, F.col("z")))
    g = Grid(0.0, 60.0, 5.0, 12, 20)
    layout = store.Layout({"z": store.Scaling(100.0, -100.0), "h": store.Scaling(10.0, 0.0, null=999.0)}, g, 4)
    store.write_table(p, str(tmp_path / "t"), layout)
    back = store.read_table(spark, str(tmp_path / "t"), ["pulse_id", "x", "y", "z", "h", "z_U"])
    assert back.agg(F.sum("z"), F.count("h"), F.count("*")).first() == p.agg(F.sum("z"), F.count("h"), F.count("*")).first()
    assert back.where(F.col("z_U") != (F.col("z") + 100) * 100).count() == 0
    box = Extent(12, 33, 7, 22)
    near = store.read_table(spark, str(tmp_path / "t"), ["z"], box, g, 4)
    want = p.where("x >= 12 AND x < 33 AND y > 7 AND y <= 22")
    assert near.agg(F.count("*"), F.sum("z")).first() == want.agg(F.count("*"), F.sum("z")).first()
    assert "tile_row" in near._jdf.queryExecution().toString()
    assert set(store.scaling_columns(str(tmp_path / "t"), spark)) == {"z", "h"}
    with pytest.raises(model.ColumnError):
        store.read_table(spark, str(tmp_path / "t"), ["nope"])
    store.update(spark, str(tmp_path / "t"), str(tmp_path / "t2"), lambda df: df.withColumn("note", F.lit(1)))
    assert "note" in spark.read.parquet(str(tmp_path / "t2")).columns


def test_translate(spark, sf, tmp_path):
    p, u = catalogue.P(spark, sf), catalogue.U(spark, sf)
    o = translate.Options(ranges={"z": (0, 100)}, constants={"scanner": ("UINT8", 3)}, classes={2: 3, 3: 2}, grid=Grid(0.0, 60.0, 5.0, 12, 20), block=4)
    translate.translate(u, p, str(tmp_path / "s"), o)
    t = store.read(spark, str(tmp_path / "s"))
    assert t["points"].count() == p.count() and t["points"].agg(F.min("scanner")).first()[0] == 3
    assert t["points"].where("classification = 3").count() == p.where("classification = 2").count()
    with pytest.raises(model.InvalidData, match="z"):
        translate.check_ranges(p, {"z": (10, 20)})
    with pytest.raises(model.ColumnError):
        translate.check_ranges(p, {"nope": (10, 20)})


def test_raster_files(spark, sf, tmp_path):
    r = catalogue.grid_min_z(spark, sf).select("row", "col", "min_z")
    raster_files.write_raster(r, catalogue.G5, str(tmp_path / "r"))
    back, g = raster_files.read_raster(spark, str(tmp_path / "r"))
    assert g == catalogue.G5 and back.count() == r.count()
    raster_files.write_ascii(r, g, "min_z", str(tmp_path / "a"))
    lines = [x["value"] for x in spark.read.text(str(tmp_path / "a")).collect()]
    assert lines[0] == "ncols 20" and len(lines) == 18 and all(len(x.split()) == 20 for x in lines[6:])


def test_profile_file(spark, sf, tmp_path):
    from echograin.operators import profile

    text.write_profile(profile.wide(catalogue._gaps(spark, sf), catalogue.R), str(tmp_path / "p"))
    assert spark.read.option("header", True).csv(str(tmp_path / "p")).count() == 100
    (tmp_path / "m.txt").write_text("1 0\n0 1\n")
    assert text.read_matrix(spark, str(tmp_path / "m.txt")) == [[1.0, 0.0], [0.0, 1.0]]


def test_adapters(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "pulse_id long, LON0 double, LAT0 double, Z0 double")
    _, pts = lidar_formats.footprint_lidar(df)
    assert pts.first().asDict() == {"pulse_id": 1, "return_number": 1, "x": 2.0, "y": 3.0, "z": 4.0, "classification": 0}
    b = spark.createDataFrame([("BEAM0101", [1, 0]), ("BEAM0000", [0, 0])], "beam string, surface_type array<int>")
    assert lidar_formats.beams(b).first()["surface_type_land"] == 1
    raw = np.zeros(3, [("id", "<i4"), ("z", "<f8")])
    raw["id"], raw["z"] = [1, 2, 3], [0.5, 1.5, 2.5]
    (tmp_path / "x.bin").write_bytes(raw.tobytes())
    got = lidar_formats.read_structs(spark, str(tmp_path / "x.bin"), [("id", "<i4"), ("z", "<f8")], "id int, z double")
    assert sorted(tuple(r) for r in got.collect()) == [(0, 1, 0.5), (1, 2, 1.5), (2, 3, 2.5)]
    assert lidar_formats.sniff(b"LASF....") == "las"
    with pytest.raises(model.DriverNotFound):
        lidar_formats.sniff(bytes([0, 1, 2]))
    with pytest.raises(model.InvalidSetting):
        lidar_formats.chosen_point(df, "middle")


def test_stream_of_tiles(spark, sf, tmp_path):
    p = catalogue.P(spark, sf).select("x", "y", "z")
    p.repartition(3).write.parquet(str(tmp_path / "in"))
    s = tiles.tile_statistics(tiles.points_stream(spark, str(tmp_path / "in"), p.schema, 1), catalogue.G5, 4)
    q = s.writeStream.format("memory").queryName("tiles").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["tile_row"], r["tile_col"], r["n"], r["low"]) for r in spark.table("tiles").collect())
    assert got == sorted((r["tile_row"], r["tile_col"], r["n"], r["low"]) for r in catalogue.tile_assign(spark, sf).collect())


def test_command_line(spark, sf, tmp_path, capsys):
    p = catalogue.P(spark, sf)
    store.write({"points": p, "pulses": catalogue.U(spark, sf)}, str(tmp_path / "s"))
    cli.main(["rasterize", str(tmp_path / "s"), str(tmp_path / "r"), "--attribute", "min:z", "--binsize", "5"])
    assert raster_files.read_raster(spark, str(tmp_path / "r"))[0].count() > 0
    cli.main(["info", str(tmp_path / "s")])
    assert "classification" in capsys.readouterr().out
    cli.main(["canopy", str(tmp_path / "s"), str(tmp_path / "c"), "--weighted"])
    cli.main(["tile", str(tmp_path / "s"), str(tmp_path / "t"), "--binsize", "5"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == p.count()

    s = str(tmp_path / "s")
    for kind in ("cartesian", "spherical", "cylindrical", "scan"):
        out = str(tmp_path / kind)
        cli.main(["index", s, out, "--type", kind, "--binsize", "20", "--method", "last"])
        beams, points = (spark.read.parquet(f"{out}/{t}") for t in ("pulses", "points"))
        assert points.count() == p.count() and beams.select("tile_row", "tile_col").distinct().count() >= 1
        assert beams.count() == (p.select("pulse_id").distinct().count() if kind in ("cartesian", "cylindrical") else catalogue.U(spark, sf).count())
    for model_ in ("hinge", "linear", "solid_angle"):
        cli.main(["canopy", s, str(tmp_path / model_), "--model", model_, "--weighted", "--exclude", "7", "--zenith", "35", "70", "5"])
        assert spark.read.option("header", True).csv(str(tmp_path / model_)).count() == 100
    cli.main(["rasterize", s, str(tmp_path / "dem"), "--binsize", "10"])
    dem, g = raster_files.read_raster(spark, str(tmp_path / "dem"))
    raster_files.write_raster(dem.withColumnRenamed("min_z", "ground"), g, str(tmp_path / "ground"))
    cli.main(["canopy", s, str(tmp_path / "above"), "--dem", str(tmp_path / "ground")])
    cli.main(["canopy", s, str(tmp_path / "plane"), "--plane"])
    cli.main(["canopy", s, str(tmp_path / "voxels"), "--metric", "voxel", "--voxelsize", "10", "--bounds", "-3.37", "-2.61", "-0.23", "106.63", "67.39", "59.77"])
    layers = spark.read.parquet(str(tmp_path / "voxels"))
    assert layers.count() == layers.select("row", "col", "layer").distinct().count() > 0
    with pytest.raises(model.InvalidSetting):
        cli.main(["canopy", s, str(tmp_path / "x"), "--plane", "--dem", "y"])


def test_translating_las_files(spark, tmp_path):
    """Two files, of which one is cut off within a pulse, by the count of returns."""
    (tmp_path / "in").mkdir()
    for name, returns in (("a", [2, 2, 3, 3]), ("b", [1, 2, 2, 1])):
        n = len(returns)
        points = {"x": np.arange(n) + 0.5, "y": np.arange(n) * 1.0, "z": np.ones(n), "return_number": np.ones(n, int), "number_of_returns": np.array(returns), "classification": np.full(n, 2)}
        (tmp_path / "in" / f"{name}.las").write_bytes(las.las_bytes(points))
    cli.main(["translate", str(tmp_path / "in"), str(tmp_path / "out"), "--format", "las"])
    tables = store.read(spark, str(tmp_path / "out"))
    assert sorted((r["pulse_id"], r["number_of_returns"]) for r in tables["pulses"].collect()) == [(0, 2), (1, 2), (2, 1), (3, 2), (4, 1)]
    assert sorted((r["pulse_id"], r["return_number"]) for r in tables["points"].collect()) == [(0, 1), (0, 2), (1, 1), (1, 2), (2, 1), (3, 1), (3, 2), (4, 1)]


def test_records_of_large_footprints(spark, tmp_path):
    for version, n in (("1.00", 468), ("1.01", 476), ("1.02", 484), ("1.03", 576), ("1.04", 1368)):
        record = lidar_formats.lvis_record("lgw", version)
        kind = np.dtype(record)
        assert kind.itemsize > 432 and all(np.dtype(k).str[0] in ">|" for _, k, *_ in record)
        data = np.zeros(5, kind)
        data["rxwave"] = np.arange(5)[:, None]
        (tmp_path / f"w{version}.bin").write_bytes(b"head" + data.tobytes() + b"rest")
        got = lidar_formats.read_structs(spark, str(tmp_path / f"w{version}.bin"), record, header=4).orderBy("record_number").collect()
        assert [r["rxwave"][7] for r in got] == [0, 1, 2, 3, 4] and len(got[0]["rxwave"]) == data["rxwave"].shape[1]
    with pytest.raises(model.DriverNotFound):
        lidar_formats.lvis_record("lgx", "1.03")


def test_names_of_other_formats(spark):
    df = spark.createDataFrame([(1.0, 2)], "x double, other int")
    assert translate.renamed(df, "model", "footprint").columns == ["LON0", "other"]
    assert translate.renamed(translate.renamed(df, "model", "store"), "store", "model").columns == ["x", "other"]
    with pytest.raises(model.DriverNotFound):
        translate.renamed(df, "model", "none")
    with pytest.raises(model.ColumnError):
        translate.renamed(spark.createDataFrame([(1, 2)], "x int, X int").toDF("x", "LON0"), "model", "footprint")
