"""The registered queries over the fixture views, each with its SQL where SQL can express it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..model import Extent, Grid
from ..operators import colour, grid, interpolate, profile, pulses, raster, vector, voxel, waveform
from ..sources import fixtures

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: What the SQL of all queries begins with: the fixture views.
VIEWS = """
WITH p AS (
    SELECT l_orderkey AS pulse_id,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS return_number,
           CAST(l_partkey % 800 AS DOUBLE) * 0.125 AS x,
           CAST(l_suppkey % 100 AS DOUBLE) * 0.5 + CAST(l_linenumber AS DOUBLE) * 0.125 AS y,
           l_quantity AS z, l_linenumber AS classification, l_extendedprice AS intensity
    FROM lineitem
), u AS (
    SELECT o_orderkey AS pulse_id, CAST(o_custkey % 720 AS DOUBLE) * 0.5 AS azimuth, CAST(o_orderkey % 240 AS DOUBLE) * 0.375 AS zenith,
           CAST(floor(o_orderkey / 100) AS BIGINT) AS scanline, o_orderkey % 100 AS scanline_idx
    FROM orders
), b AS (
    SELECT *, CAST(floor((60 - y) / 5) AS BIGINT) AS "row", CAST(floor(x / 5) AS BIGINT) AS col
    FROM p WHERE x >= 0 AND x < 100 AND y > 0 AND y <= 60
), dem AS (
    SELECT CAST(floor((60 - y) / 10) AS BIGINT) AS "row", CAST(floor(x / 10) AS BIGINT) AS col, min(z) AS ground
    FROM p WHERE classification = 2 AND x >= 0 AND x < 100 AND y > 0 AND y <= 60 GROUP BY ALL
)
"""

G5 = Grid(0.0, 60.0, 5.0, 12, 20)
G10 = Grid(0.0, 60.0, 10.0, 6, 10)
G2 = Grid(0.0, 60.0, 2.0, 30, 50)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            # A statement of its own is taken as it is; otherwise the views come first.
            ORACLE[f.__name__] = VIEWS + sql
        return f

    return add


def P(s: SparkSession, d: str) -> DataFrame:
    return fixtures.points(s, d)


def U(s: SparkSession, d: str) -> DataFrame:
    return fixtures.pulses(s, d)


def dem(s: SparkSession, d: str) -> DataFrame:
    return grid.rasterize(P(s, d).where("classification = 2"), G10, {"ground": ("min", "z")})


# Rasters ------------------------------------------------------------------------


@query('SELECT "row", col, min(z) AS min_z, count(*) AS n FROM b GROUP BY ALL')
def grid_min_z(s, d):
    return grid.rasterize(P(s, d), G5, {"min_z": ("min", "z"), "n": ("count", "z")})


@query('SELECT "row", col, min(z) AS lo, max(z) AS hi, round(avg(z), 6) AS mean, median(z) AS mid, round(stddev_pop(z), 6) AS sd, sum(z) AS total FROM b GROUP BY ALL')
def grid_stats(s, d):
    r = grid.rasterize(P(s, d), G5, {"lo": ("min", "z"), "hi": ("max", "z"), "mean": ("mean", "z"), "mid": ("median", "z"), "sd": ("std", "z"), "total": ("sum", "z")})
    return r.withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


@query("""SELECT r."row", c.col, coalesce(g.min_z, 0.0) AS min_z FROM (SELECT unnest(range(12)) AS "row") r CROSS JOIN (SELECT unnest(range(20)) AS col) c
LEFT JOIN (SELECT "row", col, min(z) AS min_z FROM b WHERE classification = 2 AND z > 45 GROUP BY ALL) g ON g."row" = r."row" AND g.col = c.col""")
def grid_background_fill(s, d):
    return grid.rasterize(P(s, d).where("classification = 2 AND z > 45"), G5, {"min_z": ("min", "z")}, background=0.0)


@query('SELECT "row", col, min(z) AS low, max(intensity) AS bright, round(var_pop(z), 6) AS spread FROM b GROUP BY ALL')
def grid_multi_attribute(s, d):
    return grid.rasterize(P(s, d), G5, {"low": ("min", "z"), "bright": ("max", "intensity"), "spread": ("var", "z")}).withColumn("spread", F.round("spread", 6))


@query("""SELECT CAST(floor((60 - y) / 5) AS BIGINT) AS "row", CAST(floor(x / 5) AS BIGINT) AS col, count(*) AS n FROM p
WHERE return_number = 1 AND x >= 0 AND x < 100 AND y > 0 AND y <= 60 GROUP BY ALL""")
def grid_pulse_type(s, d):
    return grid.rasterize(pulses.pulse_index(P(s, d)), G5, {"n": ("count", "pulse_id")}, x="x_idx", y="y_idx")


@query("""SELECT "row", col, x, y, z, pulse_id, return_number FROM (SELECT *, row_number() OVER (PARTITION BY "row", col ORDER BY z, pulse_id, return_number) AS k FROM b) WHERE k = 1""")
def grid_argmin_point(s, d):
    # The extra column return_number keeps its window: the key must be total.
    return grid.lowest(grid.binned(P(s, d), G5), ["row", "col"], ["z", "pulse_id", "return_number"], ["x", "y", "z", "pulse_id", "return_number"]).withColumn("return_number", F.col("return_number").cast("long"))


@query("""SELECT pulse_id, return_number, CAST(CASE WHEN k = 1 THEN 2 ELSE classification END AS BIGINT) AS classification
FROM (SELECT *, row_number() OVER (PARTITION BY "row", col ORDER BY z, pulse_id, return_number) AS k FROM b)""")
def mark_lowest_ground(s, d):
    b = grid.binned(P(s, d), G5)
    low = grid.lowest(b, ["row", "col"], ["z", "pulse_id", "return_number"], ["pulse_id", "return_number"]).select("pulse_id", "return_number", F.lit(True).alias("low"))
    out = b.join(low, ["pulse_id", "return_number"], "left")
    return out.select("pulse_id", F.col("return_number").cast("long").alias("return_number"), F.when(F.col("low"), 2).otherwise(F.col("classification")).cast("long").alias("classification"))


@query('SELECT "row", col, n, CAST(coalesce(sum(n) OVER (ORDER BY "row", col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT "row", col, count(*) AS n FROM b GROUP BY ALL)')
def grid_count_index(s, d):
    return grid.bin_index(P(s, d), G5)


@query('SELECT "row", col, CAST(floor(z / 5) AS BIGINT) AS hbin, count(*) AS n FROM b GROUP BY ALL')
def height_bins_3d(s, d):
    return grid.height_bins(P(s, d), G5, 5.0)


@query("""SELECT CAST(floor((60 - y) / 3) AS BIGINT) AS "row", CAST(floor(x / 3) AS BIGINT) AS col, min(z) AS min_z, count(*) AS n FROM p
WHERE x >= 0 AND x < 99 AND y > 0 AND y <= 60 GROUP BY ALL""")
def two_file_union_grid(s, d):
    even, odd = P(s, d).where("pulse_id % 2 = 0"), P(s, d).where("pulse_id % 2 = 1")
    return grid.rasterize(even.unionByName(odd), Grid(0.0, 60.0, 3.0, 20, 33), {"min_z": ("min", "z"), "n": ("count", "z")})


def _halves(s, d):
    return P(s, d).where("classification <= 4 AND x < 70"), P(s, d).where("classification > 2 AND x > 20 AND y < 45")


_HALVES = """, h1 AS (SELECT * FROM p WHERE classification <= 4 AND x < 70), h2 AS (SELECT * FROM p WHERE classification > 2 AND x > 20 AND y < 45),
e AS (SELECT {0}(a.x0, c.x0) AS x0, {1}(a.x1, c.x1) AS x1, {0}(a.y0, c.y0) AS y0, {1}(a.y1, c.y1) AS y1
      FROM (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM h1) a, (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM h2) c)
SELECT count(*) AS n, sum(z) AS total FROM p, e WHERE x >= x0 AND x < x1 AND y > y0 AND y <= y1"""


@query(_HALVES.format("greatest", "least"))
def extent_intersection(s, d):
    a, b = _halves(s, d)
    e = grid.extent_of(a).intersection(grid.extent_of(b))
    return P(s, d).where(C.in_box("x", "y", e)).agg(F.count("*").alias("n"), F.sum("z").alias("total"))


@query(_HALVES.format("least", "greatest"))
def extent_union(s, d):
    a, b = _halves(s, d)
    e = grid.extent_of(a).union(grid.extent_of(b))
    return P(s, d).where(C.in_box("x", "y", e)).agg(F.count("*").alias("n"), F.sum("z").alias("total"))


@query("""SELECT 0.25 + 2 * floor((x - 0.25) / 2 + 0.5) AS nearest, 0.25 + 2 * floor((x - 0.25) / 2) AS less, 0.25 + 2 * ceil((x - 0.25) / 2) AS greater, count(*) AS n FROM p GROUP BY ALL""")
def snap_grid(s, d):
    ways = {w: C.snapped("x", 0.25, 2.0, w) for w in ("nearest", "less", "greater")}
    return P(s, d).select(*[v.alias(k) for k, v in ways.items()]).groupBy(*ways).agg(F.count("*").alias("n"))


@query('SELECT CAST(floor("row" / 4) AS BIGINT) AS tile_row, CAST(floor(col / 4) AS BIGINT) AS tile_col, count(*) AS n, min(z) AS low FROM b GROUP BY ALL')
def tile_assign(s, d):
    return grid.tiled(P(s, d), G5, 4).groupBy("tile_row", "tile_col").agg(F.count("*").alias("n"), F.min("z").alias("low"))


@query('SELECT CAST(count(*) AS BIGINT) AS tiles FROM (SELECT DISTINCT floor("row" / 4), floor(col / 4) FROM b WHERE z > 49)')
def tile_nonempty(s, d):
    return grid.tiled(P(s, d).where("z > 49"), G5, 4).select("tile_row", "tile_col").distinct().agg(F.count("*").alias("tiles"))


@query("""SELECT t.tr AS tile_row, t.tc AS tile_col, count(*) AS n, CAST(sum(CASE WHEN floor("row" / 4) = t.tr AND floor(col / 4) = t.tc THEN 1 ELSE 0 END) AS BIGINT) AS core
FROM b JOIN (SELECT r.tr, c.tc FROM (SELECT unnest(range(3)) AS tr) r, (SELECT unnest(range(5)) AS tc) c) t
ON "row" BETWEEN t.tr * 4 - 1 AND t.tr * 4 + 4 AND col BETWEEN t.tc * 4 - 1 AND t.tc * 4 + 4 GROUP BY ALL""")
def overlap_block_read(s, d):
    return grid.with_halo(P(s, d), G5, 4, 1).groupBy("tile_row", "tile_col").agg(F.count("*").alias("n"), F.count_if("core").alias("core"))


# Pulses and points ----------------------------------------------------------------


@query("""SELECT u.pulse_id, count(p.z) AS n, coalesce(sum(p.z), 0.0) AS total, min(CASE WHEN return_number = 1 THEN z END) AS first_z, arg_max(z, return_number) AS last_z
FROM u LEFT JOIN p ON p.pulse_id = u.pulse_id GROUP BY u.pulse_id""")
def points_by_pulse(s, d):
    n = pulses.points_by_pulse(U(s, d).select("pulse_id"), P(s, d), ["z"])
    zs = F.transform("points", lambda p: p["z"])
    return n.select("pulse_id", F.size("points").cast("long").alias("n"), F.aggregate(zs, F.lit(0.0), lambda a, z: a + z).alias("total"), F.try_element_at(zs, F.lit(1)).alias("first_z"), F.try_element_at(zs, F.lit(-1)).alias("last_z"))


@query("SELECT p.pulse_id, p.return_number, round(sqrt(x * x + y * y + (z - 1.5) * (z - 1.5)), 6) AS range, scanline FROM p JOIN u ON u.pulse_id = p.pulse_id")
def pulse_repeat_to_points(s, d):
    j = pulses.to_points(U(s, d), P(s, d), ["x_origin", "y_origin", "z_origin", "scanline"])
    dx, dy, dz = (F.col(a) - F.col(f"{a}_origin") for a in "xyz")
    return j.select("pulse_id", F.col("return_number").cast("long").alias("return_number"), F.round(F.sqrt(dx * dx + dy * dy + dz * dz), 6).alias("range"), "scanline")


@query("SELECT u.pulse_id, count(p.pulse_id) AS n FROM u LEFT JOIN p ON p.pulse_id = u.pulse_id GROUP BY u.pulse_id")
def returns_per_pulse(s, d):
    return pulses.returns_per_pulse(U(s, d), P(s, d))


@query("SELECT pulse_id, x AS x_idx, y AS y_idx FROM p WHERE return_number = 1")
def first_return_index(s, d):
    return pulses.pulse_index(P(s, d), "first")


@query("SELECT pulse_id, arg_max(x, return_number) AS x_idx, arg_max(y, return_number) AS y_idx FROM p GROUP BY pulse_id")
def last_return_index(s, d):
    return pulses.pulse_index(P(s, d), "last")


@query("SELECT pulse_id, return_number, x, y, z FROM p")
def return_number(s, d):
    return P(s, d).select("pulse_id", F.col("return_number").cast("long").alias("return_number"), "x", "y", "z")


@query("SELECT pulse_id, n, CAST(sum(n) OVER (ORDER BY pulse_id) - n AS BIGINT) AS start FROM (SELECT u.pulse_id, count(p.pulse_id) AS n FROM u LEFT JOIN p ON p.pulse_id = u.pulse_id GROUP BY u.pulse_id)")
def pulse_start_idx(s, d):
    return pulses.start_index(pulses.returns_per_pulse(U(s, d), P(s, d))).select("pulse_id", "n", "start")


@query("""SELECT run, min(event_id) AS first_id, count(*) AS n, any_value(event_type) AS event_type FROM (
SELECT *, CAST(sum(change) OVER (ORDER BY event_id) AS BIGINT) AS run FROM (
SELECT event_id, event_type, CASE WHEN lag(event_type) OVER (ORDER BY event_id) <> event_type THEN 1 ELSE 0 END AS change FROM events)) GROUP BY run""")
def run_pulses(s, d):
    r = pulses.runs(fixtures.records(s, d), "event_id", ["event_type"], block=4096)
    return r.groupBy("run").agg(F.min("event_id").alias("first_id"), F.count("*").alias("n"), F.first("event_type").alias("event_type"))


@query(""", r AS (SELECT row_number() OVER (ORDER BY pulse_id, return_number) AS id, return_number, z FROM p)
SELECT id - return_number + 1 AS pulse, count(*) AS n, sum(z) AS total FROM r GROUP BY ALL""")
def record_regroup(s, d):
    n = P(s, d).groupBy("pulse_id").agg(F.count("*").alias("n"))
    starts = pulses.start_index(n).select("pulse_id", "start")
    records = P(s, d).join(starts, "pulse_id").select((F.col("start") + F.col("return_number")).alias("id"), F.col("return_number").alias("target_index"), "z")
    return pulses.regroup(records).groupBy("pulse").agg(F.count("*").alias("n"), F.sum("z").alias("total"))


@query("SELECT pulse_id, scanline, row_number() OVER (PARTITION BY scanline ORDER BY pulse_id) - 1 AS idx FROM u")
def scanline_index(s, d):
    w = Window.partitionBy("scanline").orderBy("pulse_id")
    return U(s, d).select("pulse_id", "scanline", (F.row_number().over(w) - 1).cast("long").alias("idx"))


@query("SELECT pulse_id, azimuth, zenith FROM u WHERE pulse_id >= 1000 AND pulse_id < 5000")
def pulse_range(s, d):
    return pulses.in_range(U(s, d), 1000, 5000).select("pulse_id", "azimuth", "zenith")


@query("SELECT pulse_id, return_number, x, y, z FROM p WHERE classification = 2 AND x >= 10 AND x < 40 AND y > 5 AND y <= 30")
def class_filter_box(s, d):
    return P(s, d).where((F.col("classification") == 2) & C.in_box("x", "y", Extent(10, 40, 5, 30))).select("pulse_id", F.col("return_number").cast("long").alias("return_number"), "x", "y", "z")


# Columns ------------------------------------------------------------------------

#: Internal and public codes of the canonical store.
TO_PUBLIC = {1: 1, 3: 2, 4: 3, 5: 4, 6: 5, 7: 6}


@query("""SELECT classification AS internal, CASE classification WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 4 WHEN 6 THEN 5 WHEN 7 THEN 6 ELSE classification END AS public,
CASE classification WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 WHEN 5 THEN 6 WHEN 6 THEN 7 ELSE classification END AS back, count(*) AS n FROM p GROUP BY ALL""")
def recode_class(s, d):
    rows = P(s, d).select(F.col("classification").alias("internal"), C.recoded("classification", TO_PUBLIC).alias("public"), C.recoded("classification", {v: k for k, v in TO_PUBLIC.items()}).alias("back"))
    return rows.groupBy("internal", "public", "back").agg(F.count("*").alias("n"))


@query("SELECT pulse_id, return_number, CAST(round_even((x - (-1.0625)) * 100, 0) AS BIGINT) AS x_stored, CAST(round_even((z - (-100)) * 100, 0) AS BIGINT) AS z_stored FROM p")
def scale_encode(s, d):
    return P(s, d).select("pulse_id", F.col("return_number").cast("long").alias("return_number"), C.scale_encode("x", 100.0, -1.0625).alias("x_stored"), C.scale_encode("z", 100.0, -100.0).alias("z_stored"))


@query("SELECT classification, round(sum(round_even((z + 100) * 100, 0) / 100 - 100), 6) AS total, count(*) AS n FROM p GROUP BY ALL")
def scale_decode(s, d):
    z = C.scale_decode(C.scale_encode("z", 100.0, -100.0), 100.0, -100.0)
    return P(s, d).groupBy("classification").agg(F.round(F.sum(z), 6).alias("total"), F.count("*").alias("n"))


@query("SELECT classification, count(nullif(z, 50.0)) AS known, count(*) - count(nullif(z, 50.0)) AS missing, sum(coalesce(nullif(z, 50.0), -1.0)) AS total FROM p GROUP BY ALL")
def null_sentinel(s, d):
    z = C.null_of("z", 50.0)
    return P(s, d).groupBy("classification").agg(F.count(z).alias("known"), (F.count("*") - F.count(z)).alias("missing"), F.sum(F.coalesce(z, F.lit(-1.0))).alias("total"))


@query("""SELECT 'z' AS "column", count(*) FILTER (z < 5 OR z > 45) AS bad, min(z) AS low, max(z) AS high FROM p
UNION ALL SELECT 'x', count(*) FILTER (x < 0 OR x > 99), min(x), max(x) FROM p""")
def range_check_report(s, d):
    return grid.outside(P(s, d), {"z": (5.0, 45.0), "x": (0.0, 99.0)})


@query("SELECT classification, CAST(7 AS BIGINT) AS scanner, 1.5 AS weight, count(*) AS n FROM p GROUP BY ALL".replace("1.5 AS", "CAST(1.5 AS DOUBLE) AS"))
def const_column(s, d):
    return P(s, d).withColumns({"scanner": F.lit(7).cast("long"), "weight": F.lit(1.5)}).groupBy("classification", "scanner", "weight").agg(F.count("*").alias("n"))


@query("SELECT pulse_id % 4 | CASE WHEN z > 40 THEN 1 ELSE 0 END AS flags, count(*) AS n, count(*) FILTER (((pulse_id % 4 | CASE WHEN z > 40 THEN 1 ELSE 0 END) & 1) <> 0) AS ignored FROM p GROUP BY ALL")
def ignore_flag(s, d):
    f = P(s, d).select(C.flag_ignored(F.col("pulse_id") % 4, F.when(F.col("z") > 40, 1).otherwise(0)).alias("flags"))
    return f.groupBy("flags").agg(F.count("*").alias("n"), F.count_if(C.has_flag("flags", 1)).alias("ignored"))


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high, count({c}) AS n FROM p""" for c in ("x", "y", "z", "classification")))
def header_stats(s, d):
    return grid.header(P(s, d), ["x", "y", "z", "classification"])


@query("""SELECT pulse_id, round(sin(radians(zenith)) * sin(radians(azimuth)), 9) AS dx, round(sin(radians(zenith)) * cos(radians(azimuth)), 9) AS dy, round(cos(radians(zenith)), 9) AS dz FROM u""")
def beam_direction(s, d):
    dx, dy, dz = C.direction(F.col("zenith"), F.col("azimuth"))
    return U(s, d).select("pulse_id", *[F.round(v, 9).alias(n) for v, n in ((dx, "dx"), (dy, "dy"), (dz, "dz"))])


@query("""SELECT pulse_id, return_number, round(degrees(acos((z - 1.5) / sqrt(x * x + y * y + (z - 1.5) * (z - 1.5)))), 6) AS zenith,
round(CASE WHEN degrees(atan2(x, y)) < 0 THEN degrees(atan2(x, y)) + 360 ELSE degrees(atan2(x, y)) END, 6) AS azimuth FROM p""")
def angles_from_direction(s, d):
    dz = F.col("z") - 1.5
    return P(s, d).select("pulse_id", F.col("return_number").cast("long").alias("return_number"), F.round(C.zenith_of(F.col("x"), F.col("y"), dz), 6).alias("zenith"), F.round(C.azimuth_of(F.col("x"), F.col("y")), 6).alias("azimuth"))


@query("SELECT pulse_id, return_number, -y + 10 AS x, x + 0.5 AS y, z - 2 AS z FROM p")
def rotate_points(s, d):
    x, y, z = C.transformed(F.col("x"), F.col("y"), F.col("z"), [[0, -1, 0, 10], [1, 0, 0, 0.5], [0, 0, 1, -2], [0, 0, 0, 1]])
    return P(s, d).select("pulse_id", F.col("return_number").cast("long").alias("return_number"), x.alias("x"), y.alias("y"), z.alias("z"))


@query("SELECT pulse_id, round(pow(10, -azimuth / 100), 9) AS power, CAST(floor(zenith / 1000 * 1e9 + 0.5) AS BIGINT) AS ns FROM u")
def db_and_time_units(s, d):
    return U(s, d).select("pulse_id", F.round(C.linear_power(-F.col("azimuth") / 10), 9).alias("power"), C.nanoseconds(F.col("zenith") / 1000).alias("ns"))


# Raster joins ---------------------------------------------------------------------

_AT10 = 'CAST(floor((60 - p.y) / 10) AS BIGINT) = dem."row" AND CAST(floor(p.x / 10) AS BIGINT) = dem.col'


@query(f"SELECT pulse_id, return_number, z - ground AS height FROM p LEFT JOIN dem ON {_AT10}")
def dem_height(s, d):
    return raster.height_above(P(s, d), dem(s, d), G10).select("pulse_id", F.col("return_number").cast("long").alias("return_number"), "height")


@query("""SELECT pulse_id, return_number, z - ground AS height FROM p LEFT JOIN dem
ON least(greatest(CAST(floor((60 - (p.y - 20)) / 10) AS BIGINT), 0), 5) = dem."row" AND least(greatest(CAST(floor((p.x * 1.5 - 20) / 10) AS BIGINT), 0), 9) = dem.col""")
def dem_height_clamped(s, d):
    moved = P(s, d).withColumns({"mx": F.col("x") * 1.5 - 20, "my": F.col("y") - 20})
    out = raster.look_up(moved, dem(s, d), G10, "ground", outside="clamp", x="mx", y="my")
    return out.select("pulse_id", F.col("return_number").cast("long").alias("return_number"), (F.col("z") - F.col("ground")).alias("height"))


@query(f"""SELECT CAST(CASE WHEN coalesce(abs(z - ground) < 5, false) THEN 2 WHEN classification = 2 THEN 0 ELSE classification END AS BIGINT) AS cls, count(*) AS n FROM p LEFT JOIN dem ON {_AT10} GROUP BY ALL""")
def classify_ground(s, d):
    return raster.classify_ground(P(s, d), dem(s, d), G10, 5.0).groupBy(F.col("classification").cast("long").alias("cls")).agg(F.count("*").alias("n"))


_SPARSE = """, sparse AS (SELECT "row", col, min(z) AS v FROM b WHERE classification = 2 AND z > 44 GROUP BY ALL)"""


def _sparse(s, d):
    return grid.rasterize(P(s, d).where("classification = 2 AND z > 44"), G5, {"v": ("min", "z")})


@query(_SPARSE + """, cell AS (SELECT r."row", c.col FROM (SELECT unnest(range(12)) AS "row") r, (SELECT unnest(range(20)) AS col) c)
SELECT cell."row", cell.col, arg_min(v, (k.far, k.r, k.c)) AS v FROM cell LEFT JOIN (
SELECT cell."row", cell.col, s.v, s."row" AS r, s.col AS c, (s."row" - cell."row") * (s."row" - cell."row") + (s.col - cell.col) * (s.col - cell.col) AS far FROM cell, sparse s) k
ON k."row" = cell."row" AND k.col = cell.col AND k.far <= 16 GROUP BY ALL""")
def nearest_fill(s, d):
    return raster.nearest_fill(_sparse(s, d), G5, "v", 4)


_NEAREST = """, cell AS (SELECT r."row", c.col FROM (SELECT unnest(range(12)) AS "row") r, (SELECT unnest(range(20)) AS col) c)
SELECT cell."row", cell.col, arg_min(s.v, ((s."row" - cell."row") * (s."row" - cell."row") + (s.col - cell.col) * (s.col - cell.col), s."row", s.col)) AS v FROM cell, sparse s GROUP BY ALL"""


@query(_SPARSE + _NEAREST)
def nearest_fill_all(s, d):
    return raster.nearest_fill(_sparse(s, d), G5, "v")


_FOCAL = 'SELECT a."row", a.col, {f}(c.v) AS v FROM {t} a JOIN {t} c ON (a."row" - c."row") * (a."row" - c."row") + (a.col - c.col) * (a.col - c.col) <= 4 GROUP BY ALL'
_LOW = ', low AS (SELECT "row", col, min(z) AS v FROM b WHERE classification = 3 GROUP BY ALL)'


def _low(s, d):
    return grid.rasterize(P(s, d).where("classification = 3"), G5, {"v": ("min", "z")})


@query(_LOW + " " + _FOCAL.format(f="min", t="low"))
def focal_min(s, d):
    return raster.focal(_low(s, d), "v", 2, "min")


@query(_LOW + ", eroded AS (" + _FOCAL.format(f="min", t="low") + ") " + _FOCAL.format(f="max", t="eroded"))
def focal_opening(s, d):
    return raster.opening(_low(s, d), "v", 2)


@query(_LOW + " " + _FOCAL.format(f="max", t="low").replace("<= 4", "<= 20.25"))
def focal_wide(s, d):
    return raster.focal(_low(s, d), "v", 4.5, "max", tile=7)


def _pmf_sql() -> str:
    """Fill, then openings one after the other, by joins of all cells with their neighbours; edges are mirrored."""
    mirror = "CASE WHEN {0} < 0 THEN -1 - ({0}) WHEN {0} >= {1} THEN 2 * {1} - 1 - ({0}) ELSE {0} END"
    low = """, low2 AS (SELECT CAST(floor((60 - y) / 2) AS BIGINT) AS r, CAST(floor(x / 2) AS BIGINT) AS c, min(z) AS v FROM p WHERE x >= 0 AND x < 100 AND y > 0 AND y <= 60 GROUP BY ALL),
cell AS (SELECT r, c FROM (SELECT unnest(range(30)) AS r), (SELECT unnest(range(50)) AS c)),
s0 AS MATERIALIZED (SELECT cell.r, cell.c, coalesce(any_value(o.v), arg_min(l.v, ((l.r - cell.r) * (l.r - cell.r) + (l.c - cell.c) * (l.c - cell.c), l.r, l.c))) AS v
FROM cell CROSS JOIN low2 l LEFT JOIN low2 o ON o.r = cell.r AND o.c = cell.c GROUP BY cell.r, cell.c)"""
    out, now = low, "s0"
    for k, n in enumerate([0, *raster.windows(1, 5)[:-1]]):
        near = f"(SELECT a.r, a.c, {{0}}(b.v {{1}} CASE WHEN dr * dr + dc * dc <= {n * n} THEN 1 ELSE 0 END) AS v FROM {{2}} a, (SELECT unnest(range(-{n}, {n} + 1)) AS dr), (SELECT unnest(range(-{n}, {n} + 1)) AS dc), {{2}} b WHERE b.r = {mirror.format('a.r + dr', 30)} AND b.c = {mirror.format('a.c + dc', 50)} GROUP BY a.r, a.c)"
        out += f", e{k} AS MATERIALIZED {near.format('min', '-', now)}, d{k} AS MATERIALIZED {near.format('max', '+', f'e{k}')}, s{k + 1} AS MATERIALIZED (SELECT r, c, least(x.v, y.v) AS v FROM {now} x JOIN d{k} y USING (r, c))"
        now = f"s{k + 1}"
    return out + f' SELECT r AS "row", c AS col, CASE WHEN abs(x.v - y.v) <= 0.5 THEN x.v ELSE y.v END AS ground FROM s0 x JOIN {now} y USING (r, c)'


@query(_pmf_sql())
def pmf_ground(s, d):
    return raster.ground_surface(grid.rasterize(P(s, d), G2, {"low": ("min", "z")}), G2, "low", raster.windows(1, 5), tile=16)


_OFFERS = """, cell AS (SELECT r."row", c.col FROM (SELECT unnest(range(12)) AS "row") r, (SELECT unnest(range(20)) AS col) c),
off AS (SELECT cell."row", cell.col, x, y, z, (x - (2.5 + col * 5)) * (x - (2.5 + col * 5)) + (y - (57.5 - "row" * 5)) * (y - (57.5 - "row" * 5)) AS far FROM cell, p)"""


@query(_OFFERS + ' SELECT "row", col, arg_min(z, (far, x, y, z)) AS z FROM off WHERE far <= 100 GROUP BY ALL')
def interp_nearest(s, d):
    return interpolate.interpolate(P(s, d).select("x", "y", "z"), G5, "nearest", reach=2)


@query(_OFFERS + ' SELECT "row", col, round(sum(z / pow(greatest(sqrt(far), 1e-6), 2)) / sum(1 / pow(greatest(sqrt(far), 1e-6), 2)), 6) AS z FROM off WHERE far <= 100 GROUP BY ALL')
def interp_idw(s, d):
    return interpolate.interpolate(P(s, d).select("x", "y", "z"), G5, "idw", reach=2).withColumn("z", F.round("z", 6))


@query()
def interp_linear(s, d):
    return interpolate.interpolate(P(s, d).select("x", "y", "z"), G5, "linear", tile=1, margin=1)


# Profiles -----------------------------------------------------------------------

R = profile.Rings()

_RINGS = """, beam AS (SELECT pulse_id, CAST(ceil((zenith - 35) / 5) - 1 AS BIGINT) AS ring FROM u WHERE azimuth BETWEEN 0 AND 360 AND ceil((zenith - 35) / 5) - 1 BETWEEN 0 AND 6),
shots AS (SELECT ring, count(*) AS pulses FROM beam GROUP BY ring), n AS (SELECT pulse_id, count(*) AS n FROM p GROUP BY pulse_id),
cnt AS (SELECT ring, CAST(floor(z / 0.5) AS BIGINT) AS hbin, sum(1.0::DOUBLE / n) AS weight FROM p JOIN n USING (pulse_id) JOIN beam USING (pulse_id) WHERE z > 0 AND floor(z / 0.5) < 100 GROUP BY ALL),
gap AS (SELECT s.ring, h.hbin, h.hbin * 0.5::DOUBLE AS height, 1 - sum(coalesce(weight, 0)) OVER (PARTITION BY s.ring ORDER BY h.hbin) / pulses AS pgap
        FROM shots s CROSS JOIN (SELECT unnest(range(100)) AS hbin) h LEFT JOIN cnt ON cnt.ring = s.ring AND cnt.hbin = h.hbin),
g AS (SELECT *, CASE WHEN pgap > 0 THEN ln(pgap) END AS lg, tan(radians(37.5 + ring * 5)) * 2 / pi() AS xt FROM gap)
"""


def _gaps(s, d):
    return profile.gap_profile(U(s, d), P(s, d), R)


@query(_RINGS + "SELECT ring, pulses FROM shots")
def pulse_ring_counts(s, d):
    return profile.ring_pulses(U(s, d), R)


@query(_RINGS + "SELECT ring, hbin, height, round(pgap, 8) AS pgap FROM gap")
def pgap_profile(s, d):
    return _gaps(s, d).withColumn("pgap", F.round("pgap", 8))


@query(_RINGS.replace("sum(1.0::DOUBLE / n) AS weight FROM p JOIN n USING (pulse_id)", "sum(1.0::DOUBLE) AS weight FROM p").replace("WHERE z > 0", "WHERE return_number = 1 AND classification NOT IN (6, 7) AND z > 0") + "SELECT ring, hbin, height, round(pgap, 8) AS pgap FROM gap")
def pgap_first_returns(s, d):
    return profile.gap_profile(U(s, d), P(s, d), R, weighted=False, excluded=(6, 7)).withColumn("pgap", F.round("pgap", 8))


_GRAD = """SELECT hbin, round(pai, 6) AS pai{more}, round(CASE WHEN hbin = 0 THEN (lead(pai) OVER w - pai) / 0.5 WHEN hbin = 99 THEN (pai - lag(pai) OVER w) / 0.5 ELSE (lead(pai) OVER w - lag(pai) OVER w) / 1.0 END, 6) AS pavd FROM t WINDOW w AS (ORDER BY hbin)"""


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(_RINGS + ", t AS (SELECT hbin, -1.1 * lg AS pai FROM g WHERE ring = 4) " + _GRAD.format(more=""))
def hinge_pai(s, d):
    return _rounded(profile.hinge(_gaps(s, d), R), "pai", "pavd").select("hbin", "pai", "pavd")


@query(_RINGS + """, fit AS (SELECT hbin, count(*) AS n, regr_slope(-lg, xt) AS v, regr_intercept(-lg, xt) AS h, avg(-lg) AS m, avg(-lg / xt) AS q FROM g WHERE lg IS NOT NULL GROUP BY hbin),
par AS (SELECT hbin, CASE WHEN n > 2 AND h < 0 THEN q WHEN n > 2 AND v < 0 THEN 0.0 WHEN n > 2 THEN v ELSE 0.0 END AS pv, CASE WHEN n > 2 AND h < 0 THEN 0.0 WHEN n > 2 AND v < 0 THEN m WHEN n > 2 THEN h ELSE 0.0 END AS ph FROM fit),
t AS (SELECT b.hbin, coalesce(pv, 0) + coalesce(ph, 0) AS pai, degrees(atan2(coalesce(pv, 0), coalesce(ph, 0))) AS mla FROM (SELECT DISTINCT hbin FROM g) b LEFT JOIN par ON par.hbin = b.hbin) """ + _GRAD.format(more=", round(mla, 4) AS mla"))
def linear_pai(s, d):
    out = profile.linear(_gaps(s, d), R)
    return out.select("hbin", F.round("pai", 6).alias("pai"), F.round("mla", 4).alias("mla"), F.round("pavd", 6).alias("pavd"))


@query(_RINGS + """, last AS (SELECT ring, pgap AS e, sin(radians(37.5 + ring * 5)) AS w FROM gap WHERE hbin = 99 AND pgap < 1 AND pgap > 0), tot AS (SELECT sum(w) AS s FROM last),
t AS (SELECT hbin, 1.5 * sum(w / s * lg / ln(e)) AS pai FROM g JOIN last USING (ring), tot GROUP BY hbin) """ + _GRAD.format(more=""))
def solid_angle_pai(s, d):
    return _rounded(profile.solid_angle(_gaps(s, d), R, 1.5), "pai", "pavd").select("hbin", "pai", "pavd")


@query("""SELECT "row", col, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY "row", col ORDER BY z, x, y) AS k FROM (
SELECT x - 50 AS x, y - 25 AS y, z, CAST(floor((25 - (y - 25)) / 5) AS BIGINT) AS "row", CAST(floor((x - 50 + 25) / 5) AS BIGINT) AS col FROM p WHERE abs(x - 50) < 25 AND abs(y - 25) < 25)) WHERE k = 1""")
def plane_grid(s, d):
    return profile.minimum_grid(P(s, d).withColumns({"x": F.col("x") - 50, "y": F.col("y") - 25}), 25.0, 5.0)


@query()
def plane_fit_huber(s, d):
    fit = profile.plane_of(P(s, d).withColumns({"x": F.col("x") - 50, "y": F.col("y") - 25}), 25.0, 5.0)
    return s.createDataFrame([tuple(fit.values())], ", ".join(f"{k} double" for k in fit))


# Voxels -------------------------------------------------------------------------

#: A box that no ray's corner cases fall on.
T = voxel.Voxels(-3.37, -2.61, -0.23, 10.0, 11, 7, 6)

_SLAB = """CASE WHEN d{a} <> 0 THEN {least}(({lo} + 10 * {i} - {o}) / d{a}, ({lo} + 10 * {i} + 10 - {o}) / d{a}) WHEN {o} >= {lo} + 10 * {i} AND {o} < {lo} + 10 * {i} + 10 THEN {free} ELSE {none} END"""


def _slab(least: str) -> str:
    ends = ("-1e300", "1e300") if least == "least" else ("1e300", "-1e300")
    return ", ".join(_SLAB.format(a=a, least=least, lo=f"({lo}::DOUBLE)", i=i, o=f"({o}::DOUBLE)", free=ends[0], none=ends[1]) for a, lo, i, o in (("x", T.x, "i", 0.0), ("y", T.y, "j", 0.0), ("z", T.z, "k", 1.5)))


# Every ray against every voxel.
_VOX = f""", ray AS (SELECT pulse_id, pulse_id % 3 AS scan, sin(radians(zenith)) * CASE WHEN azimuth = 0 THEN 0 ELSE sin(radians(azimuth)) END AS dx, sin(radians(zenith)) * cos(radians(azimuth)) AS dy, cos(radians(zenith)) AS dz FROM u),
box AS (SELECT i, j, k, i + 11 * j + 77 * k AS vidx FROM (SELECT unnest(range(11)) AS i), (SELECT unnest(range(7)) AS j), (SELECT unnest(range(6)) AS k)),
via AS (SELECT pulse_id, scan, vidx, greatest({_slab("least")}, 0.0) AS t0, least({_slab("greatest")}) AS t1 FROM ray, box),
own AS (SELECT pulse_id, CAST(floor((x - (-3.37)) / 10) + 11 * floor((y - (-2.61)) / 10) + 77 * floor((z - (-0.23)) / 10) AS BIGINT) AS vidx, count(*) AS k FROM p
        WHERE x >= -3.37 AND x < 106.63 AND y >= -2.61 AND y < 67.39 AND z >= -0.23 AND z < 59.77 GROUP BY ALL),
many AS (SELECT pulse_id, count(*) AS n FROM p GROUP BY pulse_id),
met AS (SELECT v.pulse_id, v.scan, v.vidx, coalesce(k, 0) AS k, coalesce(n, 0) AS n, greatest(coalesce(n, 0), 1) AS share, sum(coalesce(k, 0)) OVER (PARTITION BY v.pulse_id ORDER BY t0) AS upto
        FROM via v LEFT JOIN own ON own.pulse_id = v.pulse_id AND own.vidx = v.vidx LEFT JOIN many ON many.pulse_id = v.pulse_id WHERE t0 < t1),
cnt AS (SELECT scan, vidx, sum(k / share) AS hits, sum((share - upto) / share) AS miss, sum(upto / share) AS occl FROM met GROUP BY ALL),
m AS (SELECT *, miss + hits AS shots FROM cnt),
sm AS (SELECT vidx, CAST(sum(CASE WHEN shots > 0 THEN 1 ELSE 0 END) AS BIGINT) AS scans, sum(CASE WHEN shots > 0 THEN (1 - miss / nullif(shots, 0)) * (shots / nullif(shots + occl, 0)) ELSE 0 END) AS part,
       sum(CASE WHEN shots > 0 THEN shots / nullif(shots + occl, 0) ELSE 0 END) AS wtot, max(CASE WHEN hits > 0 THEN 5 WHEN miss > 0 THEN 4 WHEN occl > 0 THEN 3 ELSE 2 END) AS class FROM m GROUP BY vidx),
su AS (SELECT vidx, scans, CASE WHEN wtot > 0 THEN part / wtot ELSE 0 END AS cover, CAST(class AS BIGINT) AS class FROM sm) """


def _counts(s, d):
    return voxel.traverse(U(s, d).withColumn("scan", F.col("pulse_id") % 3), P(s, d), T, by="scan")


_SIX = "round(hits, 6) AS hits, round(miss, 6) AS miss, round(occl, 6) AS occl"


@query(_VOX + f"SELECT scan, vidx, {_SIX} FROM cnt")
def voxel_hits(s, d):
    return _rounded(_counts(s, d), "hits", "miss", "occl")


@query(_VOX + "SELECT scan, vidx, round(CASE WHEN shots > 0 THEN miss / shots ELSE 9999 END, 6) AS pgap, round(CASE WHEN shots > 0 THEN shots / (shots + occl) ELSE 0 END, 6) AS w FROM m")
def voxel_scan_metrics(s, d):
    return voxel.scan_metrics(_counts(s, d)).select("scan", "vidx", F.round("pgap", 6).alias("pgap"), F.round("w", 6).alias("w"))


@query(_VOX + "SELECT vidx, scans, round(cover, 6) AS cover FROM su")
def voxel_summary(s, d):
    return voxel.summary(_counts(s, d)).select("vidx", "scans", F.round("cover", 6).alias("cover"))


@query(_VOX + "SELECT class, count(*) AS n FROM su GROUP BY class")
def voxel_class(s, d):
    return voxel.summary(_counts(s, d)).groupBy(F.col("class").cast("long").alias("class")).agg(F.count("*").alias("n"))


@query(_VOX + """, cell AS (SELECT a.i, k.k FROM (SELECT DISTINCT vidx % 77 AS i FROM su) a, (SELECT unnest(range(6)) AS k) k), q AS (SELECT i, k, coalesce(cover, 0.0) AS q FROM cell LEFT JOIN su ON su.vidx = i + 77 * k),
top AS (SELECT CAST(floor((x - (-3.37)) / 10) + 11 * floor((y - (-2.61)) / 10) AS BIGINT) AS i, max(CAST(floor((z - (-0.23)) / 10) AS BIGINT)) AS k FROM p WHERE classification = 2 GROUP BY ALL)
SELECT q.i + 77 * q.k AS vidx, round(CASE WHEN q.k <= coalesce(top.k, -1) THEN 9999 ELSE 1 - (SELECT product(1 - o.q) FROM q o WHERE o.i = q.i AND o.k >= q.k) END, 6) AS cover FROM q LEFT JOIN top ON top.i = q.i""")
def voxel_cover(s, d):
    solid = voxel.cell_of(P(s, d).where("classification = 2"), T).select("vidx").distinct()
    seen = voxel.summary(_counts(s, d))
    # Columns with ground alone aren't in the comparison.
    solid = solid.withColumn("c", F.col("vidx") % 77).join(seen.select((F.col("vidx") % 77).alias("c")).distinct(), "c", "left_semi")
    return voxel.cover_from_above(seen, T, solid).select("vidx", F.round("cover", 6).alias("cover"))


@query(_VOX + f", every AS (SELECT vidx, sum(hits) AS hits, sum(miss) AS miss, sum(occl) AS occl FROM cnt GROUP BY vidx) SELECT vidx, {_SIX} FROM every")
def voxel_traverse(s, d):
    return _rounded(voxel.traverse(U(s, d), P(s, d), T), "hits", "miss", "occl")


# Polygons, waveforms, colours --------------------------------------------------------

POLYGONS = [[(10.0, 5.0), (60.0, 12.0), (40.0, 45.0)], [(70.0, 10.0), (95.0, 10.0), (95.0, 40.0), (82.0, 20.0), (70.0, 40.0)]]


@query(""", e AS (SELECT * FROM (VALUES """ + ", ".join(f"({k}, {x1}::DOUBLE, {y1}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)" for k, x1, y1, x2, y2 in vector.edges(POLYGONS)) + """) t(poly, x1, y1, x2, y2)),
hit AS (SELECT pulse_id, return_number, poly, count(*) AS k FROM p JOIN e ON ((y1 > y) <> (y2 > y)) AND x < x1 + (y - y1) * ((x2 - x1) / nullif(y2 - y1, 0)) GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT count(DISTINCT (pulse_id, return_number)) AS n FROM hit""")
def point_in_polygon(s, d):
    return vector.inside_rings(P(s, d), POLYGONS).where("inside").agg(F.count("*").alias("n"))


@query(" SELECT vec_id AS pulse_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda e: CAST(e AS DOUBLE) / 4 - 1)), 6) AS total FROM embeddings")
def wave_decode(s, d):
    w = fixtures.waveforms(s, d).withColumn("v", waveform.decode(F.col("received"), F.col("gain"), F.col("offset")))
    return w.select("pulse_id", F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(" SELECT vec_id AS pulse_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS place, CAST(list_max(embedding) AS DOUBLE) AS value FROM embeddings")
def wave_peak(s, d):
    w = fixtures.waveforms(s, d).withColumn("p", waveform.peak(F.col("received")))
    return w.select("pulse_id", F.col("p.place").cast("long").alias("place"), F.col("p.value").cast("double").alias("value"))


@query(" SELECT vec_id AS pulse_id, i - 1 AS sample_number, CAST(floor((CAST(embedding[i] AS DOUBLE) + 1) * 4) AS BIGINT) AS sample FROM embeddings, range(1, 65) t(i)")
def wave_flatten(s, d):
    w = fixtures.waveforms(s, d).select("pulse_id", waveform.encode(F.col("received"), F.col("gain"), F.col("offset")).alias("stored"))
    return waveform.flattened(w, "stored").withColumn("sample_number", F.col("sample_number").cast("long"))


@query(" SELECT DISTINCT label AS channel, len(embedding) AS n FROM embeddings")
def wave_descriptors(s, d):
    w = s.read.parquet(f"{d}/embeddings.parquet").select(F.col("label").alias("channel"), F.size("embedding").cast("long").alias("n"))
    return waveform.descriptors(w, ["channel", "n"])


@query(""", t AS (SELECT pulse_id, CAST(return_number - 1 AS BIGINT) AS channel, z AS t FROM p WHERE return_number <= 4)
SELECT a.pulse_id, a.channel, (a.t - r.t) * 0.15 / 2 AS start_range FROM t a LEFT JOIN t r ON r.pulse_id = a.pulse_id AND r.channel = 3 WHERE a.channel IN (0, 1)""".replace("0.15 / 2", "CAST(0.15 AS DOUBLE) / 2"))
def wave_range_to_start(s, d):
    t = P(s, d).where("return_number <= 4").select("pulse_id", (F.col("return_number") - 1).cast("long").alias("channel"), F.col("z").alias("t"))
    return waveform.range_to_start(t, 0.15).select("pulse_id", "channel", "start_range")


@query(" SELECT classification, r, g, b, point_size, count(*) AS n FROM (SELECT p.classification, coalesce(c.r, 1.0) AS r, coalesce(c.g, 1.0) AS g, coalesce(c.b, 1.0) AS b, coalesce(c.s, 1.0) AS point_size FROM p LEFT JOIN (VALUES " + ", ".join(f"({k}, {r}::DOUBLE, {g}::DOUBLE, {b}::DOUBLE, {z}::DOUBLE)" for k, (r, g, b, z) in colour.PALETTE.items()) + ") c(k, r, g, b, s) ON c.k = p.classification) GROUP BY ALL")
def colour_by_class(s, d):
    return colour.by_class(P(s, d)).groupBy("classification", "r", "g", "b", "point_size").agg(F.count("*").alias("n"))


@query(" SELECT pulse_id, return_number, round((z - (SELECT min(z) FROM p)) / ((SELECT max(z) FROM p) - (SELECT min(z) FROM p)), 9) AS z, round((x - (SELECT min(x) FROM p)) / ((SELECT max(x) FROM p) - (SELECT min(x) FROM p)), 9) AS x FROM p")
def rescale_rgb(s, d):
    out = colour.rescaled(P(s, d), ["z", "x"])
    return out.select("pulse_id", F.col("return_number").cast("long").alias("return_number"), F.round("z", 9).alias("z"), F.round("x", 9).alias("x"))


@query(", k AS (SELECT avg(z) - 2 * stddev_pop(z) AS lo, avg(z) + 2 * stddev_pop(z) AS hi FROM p) SELECT z, round(least(greatest((z - lo) / (hi - lo), 0.0), 1.0), 6) AS stretched, count(*) AS n FROM p, k GROUP BY ALL")
def stretch(s, d):
    return raster.stretch(P(s, d), "z", "stddev").groupBy("z", F.round("stretched", 6).alias("stretched")).agg(F.count("*").alias("n"))


@query(", k AS (SELECT max(x) - min(x) AS wx, max(y) - min(y) AS wy, max(z) - min(z) AS wz, median(x) AS mx, median(y) AS my, median(z) AS mz FROM p) SELECT pulse_id, return_number, round((x - mx) / greatest(wx, wy, wz), 9) AS x, round((y - my) / greatest(wx, wy, wz), 9) AS y, round((z - mz) / greatest(wx, wy, wz), 9) AS z FROM p, k")
def view_normalise(s, d):
    out = colour.centred(P(s, d), ["x", "y", "z"])
    return out.select("pulse_id", F.col("return_number").cast("long").alias("return_number"), *[F.round(a, 9).alias(a) for a in "xyz"])


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", CAST(sum(CAST('0x' || substr(md5({w}), 1, 8) AS BIGINT)) AS BIGINT) AS digest, count(*) AS n FROM p""" for c, w in [*((c, f"format('{{:.16e}}', {c})") for c in "xyz"), *((c, f"CAST({c} AS VARCHAR)") for c in ("classification", "return_number"))]))
def column_checksum(s, d):
    return grid.checksum(P(s, d), ["x", "y", "z", "classification", "return_number"])


@query(" SELECT DISTINCT classification FROM p")
def distinct_classes(s, d):
    return P(s, d).select("classification").distinct()


@query(' SELECT count(*) AS n, sum(z) AS total FROM p WHERE NOT EXISTS (SELECT 1 FROM dem WHERE CAST(floor((60 - p.y) / 10) AS BIGINT) = dem."row" AND CAST(floor(p.x / 10) AS BIGINT) = dem.col AND dem.ground >= p.z)')
def non_ground_anti(s, d):
    at = P(s, d).withColumns({"row": C.row_of("y", G10), "col": C.column_of("x", G10)})
    under = dem(s, d)
    keys = (at["row"] == under["row"]) & (at["col"] == under["col"]) & (under["ground"] >= at["z"])
    return at.join(under, keys, "left_anti").agg(F.count("*").alias("n"), F.sum("z").alias("total"))


@query(" SELECT p.pulse_id, return_number, z, azimuth, zenith, n FROM p JOIN u USING (pulse_id) JOIN (SELECT pulse_id, count(*) AS n FROM p GROUP BY pulse_id) k USING (pulse_id)")
def return_records(s, d):
    n = P(s, d).groupBy("pulse_id").agg(F.count("*").alias("n"))
    out = pulses.to_points(U(s, d), P(s, d), ["azimuth", "zenith"]).join(n, "pulse_id")
    return out.select("pulse_id", F.col("return_number").cast("long").alias("return_number"), "z", "azimuth", "zenith", "n")


@query(" SELECT pulse_id, classification AS first_class FROM p WHERE return_number = 1")
def pulse_record_class(s, d):
    return P(s, d).groupBy("pulse_id").agg(F.min_by("classification", "return_number").alias("first_class"))


@query(" SELECT classification, round(avg(z), 6) AS mean, count(*) AS n FROM p GROUP BY ALL")
def global_average(s, d):
    return P(s, d).groupBy("classification").agg(F.round(F.avg("z"), 6).alias("mean"), F.count("*").alias("n"))
