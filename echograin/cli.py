"""Command line: python -m echograin.cli rasterize|index|tile|info|canopy|translate ..."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .model import Extent, Grid, InvalidSetting
from .operators import grid, profile, pulses, raster, voxel
from .plans import translate
from .sources import las, raster_files, store, text


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="echograin")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("rasterize")
    r.add_argument("store"), r.add_argument("output")
    r.add_argument("--attribute", action="append", default=[], help="aggregate:column")
    r.add_argument("--binsize", type=float, default=1.0), r.add_argument("--background", type=float)
    t = sub.add_parser("tile")
    t.add_argument("store"), t.add_argument("output"), t.add_argument("--binsize", type=float, default=1.0), t.add_argument("--block", type=int)
    i = sub.add_parser("info")
    i.add_argument("store")
    n = sub.add_parser("index")
    n.add_argument("store"), n.add_argument("output"), n.add_argument("--binsize", type=float, default=1.0), n.add_argument("--block", type=int)
    n.add_argument("--type", choices=sorted(pulses.INDEXES), default="cartesian"), n.add_argument("--method", choices=["first", "last"], default="first")
    n.add_argument("--extent", type=float, nargs=4, metavar=("XMIN", "XMAX", "YMIN", "YMAX"))
    c = sub.add_parser("canopy")
    c.add_argument("store"), c.add_argument("output"), c.add_argument("--metric", choices=["PAVD", "voxel"], default="PAVD"), c.add_argument("--weighted", action="store_true")
    c.add_argument("--model", choices=["gap", "hinge", "linear", "solid_angle"], default="gap"), c.add_argument("--total-pai", type=float, default=1.0)
    c.add_argument("--zenith", type=float, nargs=3, metavar=("MIN", "MAX", "STEP")), c.add_argument("--heights", type=float, nargs=3, metavar=("MIN", "MAX", "STEP"))
    c.add_argument("--azimuth", type=float, nargs=2), c.add_argument("--exclude", type=int, action="append", default=[])
    c.add_argument("--dem", help="a raster with a layer ground; heights are taken above it"), c.add_argument("--plane", action="store_true", help="take heights above a plane through the lowest points")
    c.add_argument("--voxelsize", type=float, default=1.0), c.add_argument("--bounds", type=float, nargs=6, default=[-50, -50, 0, 50, 50, 50])
    x = sub.add_parser("translate")
    x.add_argument("input"), x.add_argument("output"), x.add_argument("--format", choices=["las", "text"], required=True)
    x.add_argument("--column", action="append", default=[], help="name:TYPE"), x.add_argument("--pulse-column", action="append", default=[])
    x.add_argument("--range", action="append", default=[], help="name:low:high"), x.add_argument("--constant", action="append", default=[], help="name:TYPE:value")
    x.add_argument("--class", dest="classes", action="append", default=[], help="from:to")
    return p


def main(argv: list[str] | None = None) -> None:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "translate":
        if a.format == "las":
            records = las.read_las(spark, a.input)
            # File by file, whatever its records: a pulse takes as many as its first one announces.
            keyed = records.withColumn("__file", F.col("file"))
            rows = pulses.build_pulses_strictly(keyed, "record_number", "number_of_returns", "__file").drop("return_number")
            first = pulses.start_index(rows.groupBy("file").agg((F.max("pulse") + 1).alias("n")).withColumn("at", F.dense_rank().over(Window.orderBy("file"))), "at").select("file", "start")
            rows = rows.join(first, "file").withColumn("pulse_id", F.col("pulse") + F.col("start")).withColumnRenamed("nth", "return_number").drop("pulse", "start", "__file", "file")
            points = rows.drop("record_number", "number_of_returns")
            found = rows.groupBy("pulse_id").count().withColumnRenamed("count", "number_of_returns")
        else:
            found, points = text.read_pulses(spark, a.input, [tuple(c.split(":")) for c in a.column], a.pulse_column)
        o = translate.Options({n: (float(lo), float(hi)) for n, lo, hi in (r.split(":") for r in a.range)}, {n: (k, float(v)) for n, k, v in (c.split(":") for c in a.constant)}, classes={int(f): int(t) for f, t in (c.split(":") for c in a.classes)})
        translate.translate(found, points, a.output, o)
        return
    points = store.read_table(spark, f"{a.store}/points")
    if a.command == "info":
        grid.header(points, [f.name for f in points.schema if f.dataType.simpleString() not in ("string", "boolean")]).show(200, False)
    elif a.command == "rasterize":
        g = Grid.over(grid.extent_of(points), a.binsize, keep_edge=True)
        layers = {s.replace(":", "_"): tuple(s.split(":")) for s in a.attribute or ["min:z"]}
        raster_files.write_raster(grid.rasterize(points, g, layers, a.background), g, a.output)
    elif a.command == "tile":
        e = grid.extent_of(points)
        g = Grid.over(e, a.binsize, keep_edge=True)
        store.write_table(points, a.output, store.Layout({}, g, a.block or grid.default_block(e, a.binsize)))
    elif a.command == "index":
        beams = pulses.index_place(store.read_table(spark, f"{a.store}/pulses"), points, a.type, a.method)
        placed = beams.where(F.col("x_idx").isNotNull() & F.col("y_idx").isNotNull())
        e = Extent(*a.extent) if a.extent else grid.extent_of(placed, "x_idx", "y_idx")
        g = Grid.over(e, a.binsize, keep_edge=not a.extent)
        block = a.block or grid.default_block(e, a.binsize)
        inside = grid.binned(placed, g, "x_idx", "y_idx").drop("row", "col")
        own = points.join(inside.select("pulse_id", "x_idx", "y_idx"), "pulse_id")
        store.write_table(inside, f"{a.output}/pulses", store.Layout({}, g, block, "x_idx", "y_idx"))
        store.write_table(own, f"{a.output}/points", store.Layout({}, g, block, "x_idx", "y_idx"))
    else:
        _canopy(spark, a, points)


def _canopy(spark: SparkSession, a: argparse.Namespace, points: DataFrame) -> None:
    beams = store.read_table(spark, f"{a.store}/pulses")
    height = "z"
    if a.dem and a.plane:
        raise InvalidSetting("heights are above an elevation raster or a plane, not both")
    if a.dem:
        surface, g = raster_files.read_raster(spark, a.dem)
        points, height = raster.height_above(points, surface, g), "height"
    elif a.plane:
        p = profile.plane_of(points, 50.0, 5.0)
        points, height = points.withColumn("height", F.col("z") - (F.lit(p["intercept"]) + F.lit(p["dx"]) * F.col("x") + F.lit(p["dy"]) * F.col("y"))), "height"
    if a.metric == "voxel":
        low, high = a.bounds[:3], a.bounds[3:]
        v = voxel.Voxels(*low, a.voxelsize, *(max(1, round((h - lo) / a.voxelsize)) for lo, h in zip(low, high)))
        seen = voxel.summary(voxel.traverse(beams.withColumn("scan", F.lit(0)), points, v, by="scan"))
        out = seen.select("vidx", "class", F.col("cover").alias("own")).join(voxel.cover_from_above(seen, v), "vidx", "right")
        flat = v.nx * v.ny
        # A layer of voxels is a raster, its rows from the north.
        out.select((F.lit(v.ny - 1) - F.floor(F.col("vidx") % flat / v.nx)).alias("row"), (F.col("vidx") % v.nx).alias("col"), F.floor(F.col("vidx") / flat).alias("layer"), "cover", F.coalesce("class", F.lit(2)).alias("class")).write.parquet(a.output)
        return
    given = dict(zip(("zenith_min", "zenith_max", "zenith_step"), a.zenith or ())) | dict(zip(("height_min", "height_max", "height_step"), a.heights or ())) | dict(zip(("azimuth_min", "azimuth_max"), a.azimuth or ()))
    r = profile.Rings(**given)
    gaps = profile.gap_profile(beams, points, r, a.weighted, tuple(a.exclude), height)
    tables = {"gap": lambda: profile.wide(gaps, r), "hinge": lambda: profile.hinge(gaps, r), "linear": lambda: profile.linear(gaps, r), "solid_angle": lambda: profile.solid_angle(gaps, r, a.total_pai)}
    text.write_profile(tables[a.model](), a.output)


if __name__ == "__main__":
    main()
