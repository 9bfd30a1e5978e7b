"""Registered queries that go through files, user functions, translation or a stream; they join those of the catalogue.

What they write goes to the shared folder under a name of its own; each reads back what it wrote, over the whole table.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import columns as C
from ..model import Extent, fitted_scaling, scalings
from ..operators import grid, profile, pulses, vector, waveform
from ..session import scratch
from ..sources import fixtures, las, lidar_formats, raster_files, store, text
from ..streaming import tiles
from . import blocks, translate
from .catalogue import G5, POLYGONS, P, R, U, _RINGS, query

# Files ------------------------------------------------------------------------------


@query("""SELECT CAST(pulse_id AS DOUBLE) AS gps_time, least(return_number, 7) AS return_number, x, y, z, classification, pulse_id % 60000 AS intensity FROM p""")
def las_round_trip(s, d):
    folder = scratch(s, "las")
    returns = F.least("return_number", F.lit(7)).alias("return_number")
    rows = P(s, d).select("x", "y", "z", returns, F.lit(1).alias("number_of_returns"), F.col("classification").cast("int"), (F.col("pulse_id") % 60000).cast("int").alias("intensity"), F.col("pulse_id").cast("double").alias("gps_time"))
    las.write_las(rows, folder, gain=(8.0, 8.0, 8.0)).write.parquet(scratch(s, "las-files"))
    found = las.read_las(s, folder)
    return found.select("gps_time", *[F.col(c).cast("long").alias(c) for c in ("return_number", "classification", "intensity")], "x", "y", "z")


@query("SELECT pulse_id, return_number, x, y, z, classification FROM p")
def text_round_trip(s, d):
    path = scratch(s, "text")
    P(s, d).select(F.concat_ws(" ", "pulse_id", "return_number", "x", "y", "z", "classification").alias("line")).write.text(path)
    found = text.read_text(s, path, [("pulse_id", "INT64"), ("return_number", "UINT8"), ("x", "FLOAT64"), ("y", "FLOAT64"), ("z", "FLOAT64"), ("classification", "UINT8")])
    return found.select("pulse_id", F.col("return_number").cast("long").alias("return_number"), "x", "y", "z", F.col("classification").cast("long").alias("classification"))


@query("SELECT pulse_id AS gps_time, count(*) AS n, sum(z) AS total, max(return_number) AS last FROM p GROUP BY pulse_id")
def text_pulses(s, d):
    path = scratch(s, "text-pulses")
    rows = P(s, d).repartitionByRange("pulse_id").sortWithinPartitions("pulse_id", "return_number")
    rows.select(F.concat_ws(",", "pulse_id", "x", "y", "z").alias("line")).write.text(path, compression="gzip")
    beams, points = text.read_pulses(s, path, [("gps_time", "INT64"), ("x", "FLOAT64"), ("y", "FLOAT64"), ("z", "FLOAT64")], ["gps_time"])
    sums = points.groupBy("pulse_id").agg(F.sum("z").alias("total"), F.max("return_number").cast("long").alias("last"))
    return beams.join(sums, "pulse_id").select("gps_time", F.col("number_of_returns").alias("n"), "total", "last")


@query("SELECT pulse_id, x, y, z, classification FROM p WHERE x >= 12 AND x < 47 AND y > 8 AND y <= 33")
def store_box(s, d):
    path = scratch(s, "store")
    rows = P(s, d).where(C.in_box("x", "y", G5.extent)).select("pulse_id", "x", "y", "z", "classification")
    store.write_table(rows, path, store.Layout({"z": store.Scaling(100.0, -100.0)}, G5, 4))
    return store.read_table(s, path, ["pulse_id", "x", "y", "z", "classification"], Extent(12, 47, 8, 33), G5, 4)


@query("SELECT pulse_id, return_number, z, CAST(round_even((z + 100) * 100, 0) AS BIGINT) AS \"z_U\" FROM p")
def store_scaled_and_raw(s, d):
    path = scratch(s, "scaled")
    rows = P(s, d).select("pulse_id", F.col("return_number").cast("long").alias("return_number"), "z")
    store.write_table(rows, path, store.Layout({"z": store.Scaling(*scalings({"Z": "default"})["Z"])}))
    return store.read_table(s, path, ["pulse_id", "return_number", "z", "z_U"])


@query("SELECT pulse_id, x AS x_idx, y AS y_idx, 1 AS checked FROM p WHERE return_number = 1")
def store_update(s, d):
    old, new = scratch(s, "old"), scratch(s, "new")
    store.write_table(pulses.pulse_index(P(s, d)), old)
    # An update that would move the cell columns doesn't.
    store.update(s, old, new, lambda df: df.withColumn("checked", F.lit(1).cast("long")).withColumn("x_idx", F.col("x_idx") + 1))
    return store.read_table(s, new, ["pulse_id", "x_idx", "y_idx", "checked"])


@query('SELECT "row", col, min(z) AS low, max(z) AS high FROM b GROUP BY ALL')
def raster_round_trip(s, d):
    path = scratch(s, "raster")
    raster_files.write_raster(grid.rasterize(P(s, d), G5, {"low": ("min", "z"), "high": ("max", "z")}), G5, path)
    found, g = raster_files.read_raster(s, path)
    assert g == G5
    return found


@query("""SELECT r."row", c.col, coalesce(g.v, -9999.0) AS v FROM (SELECT unnest(range(12)) AS "row") r CROSS JOIN (SELECT unnest(range(20)) AS col) c
LEFT JOIN (SELECT "row", col, min(z) AS v FROM b WHERE classification = 2 GROUP BY ALL) g ON g."row" = r."row" AND g.col = c.col""")
def raster_ascii(s, d):
    path = scratch(s, "ascii")
    raster_files.write_ascii(grid.rasterize(P(s, d).where("classification = 2"), G5, {"v": ("min", "z")}), G5, "v", path)
    found, g = raster_files.read_ascii(s, path)
    assert g == G5
    return found


@query("""SELECT "row", col, min(z) AS low FROM b WHERE "row" BETWEEN 2 AND 9 AND col BETWEEN 3 AND 12 GROUP BY ALL
UNION ALL SELECT r."row", c.col, NULL FROM (SELECT unnest(range(2, 10)) AS "row") r CROSS JOIN (SELECT unnest(range(3, 13)) AS col) c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b."row" = r."row" AND b.col = c.col)""")
def raster_block(s, d):
    path = scratch(s, "raster-block")
    raster_files.write_raster(grid.rasterize(P(s, d), G5, {"low": ("min", "z")}), G5, path)
    return raster_files.read_block(s, path, "low", 3, 4, 6, 8, margin=1)


@query("SELECT min(lo) AS lo, max(hi) AS hi, round(avg(lo), 6) AS mean, round(stddev_pop(lo), 6) AS sd, count(*) AS n FROM (SELECT min(z) AS lo, min(z) AS hi FROM b GROUP BY \"row\", col)")
def raster_statistics(s, d):
    out = raster_files.statistics(grid.rasterize(P(s, d), G5, {"low": ("min", "z")}), "low")
    return out.select("lo", "hi", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "n")


@query(_RINGS + "SELECT CAST(ring AS INTEGER) AS ring, CAST(pulses AS DOUBLE) / 2 AS half FROM shots")
def profile_csv(s, d):
    path = scratch(s, "profile")
    text.write_profile(profile.ring_pulses(U(s, d), R).select("ring", (F.col("pulses") / 2).alias("half")), path)
    return s.read.schema("ring int, half double").option("header", True).csv(path)


@query("SELECT pulse_id, return_number, -y + 10 AS x, x + 0.5 AS y, z - 2 AS z FROM p")
def matrix_file(s, d):
    path = scratch(s, "matrix")
    lines = [(" ".join(map(str, r)),) for r in ([0.0, -1.0, 0.0, 10.0], [1.0, 0.0, 0.0, 0.5], [0.0, 0.0, 1.0, -2.0], [0.0, 0.0, 0.0, 1.0])]
    s.createDataFrame(lines, "value string").coalesce(1).write.text(path)
    x, y, z = C.transformed(F.col("x"), F.col("y"), F.col("z"), text.read_matrix(s, path))
    return P(s, d).select("pulse_id", F.col("return_number").cast("long").alias("return_number"), x.alias("x"), y.alias("y"), z.alias("z"))


def _wkb(rings: list) -> bytes:
    body = b"".join(struct.pack("<I", len(r) + 1) + b"".join(struct.pack("<2d", *p) for p in [*r, r[0]]) for r in rings)
    return struct.pack("<BII", 1, 3, len(rings)) + body


@query(""", e AS (SELECT * FROM (VALUES """ + ", ".join(f"({k}, {x1}::DOUBLE, {y1}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)" for k, x1, y1, x2, y2 in vector.edges(POLYGONS)) + """) t(poly, x1, y1, x2, y2)),
hit AS (SELECT pulse_id, return_number, poly, count(*) AS k FROM p JOIN e ON ((y1 > y) <> (y2 > y)) AND x < x1 + (y - y1) * ((x2 - x1) / nullif(y2 - y1, 0)) GROUP BY ALL HAVING count(*) % 2 = 1),
inside AS (SELECT DISTINCT pulse_id, return_number FROM hit)
SELECT p.pulse_id, p.return_number, inside.pulse_id IS NOT NULL AS inside FROM p LEFT JOIN inside ON inside.pulse_id = p.pulse_id AND inside.return_number = p.return_number""")
def wkb_polygons(s, d):
    out = vector.inside_rings(P(s, d), [r for p in POLYGONS for r in vector.rings_of_wkb(_wkb([p]))])
    return out.select("pulse_id", F.col("return_number").cast("long").alias("return_number"), "inside")


@query("SELECT pulse_id AS shotnumber, pulse_id % 7 AS lfid, azimuth, zenith AS incidentangle, CAST(scanline AS DOUBLE) AS lvistime FROM u")
def lvis_records(s, d):
    folder, record = scratch(s, "lvis"), lidar_formats.lvis_record("lce", "1.03")
    zero = F.lit(0.0)
    rows = U(s, d).select((F.col("pulse_id") % 7).alias("lfid"), F.col("pulse_id").alias("shotnumber"), "azimuth", F.col("zenith").alias("incidentangle"), zero.alias("range"), F.col("scanline").cast("double").alias("lvistime"), zero.alias("tlon"), zero.alias("tlat"), zero.alias("zt"))
    lidar_formats.write_structs(rows, folder, record).write.parquet(scratch(s, "lvis-files"))
    found = lidar_formats.read_structs(s, folder, record)
    return found.select("shotnumber", "lfid", F.col("azimuth").cast("double").alias("azimuth"), F.col("incidentangle").cast("double").alias("incidentangle"), "lvistime")


@query("SELECT vec_id AS shotnumber, CAST(list_sum(list_transform(embedding, lambda e: CAST(floor((CAST(e AS DOUBLE) + 1) * 4) AS BIGINT))) AS BIGINT) AS total FROM embeddings")
def lvis_waveforms(s, d):
    folder, record = scratch(s, "lvis-waves"), [("shotnumber", ">u4"), ("rxwave", ">u2", 64)]
    rows = fixtures.waveforms(s, d).select(F.col("pulse_id").alias("shotnumber"), waveform.encode(F.col("received"), F.col("gain"), F.col("offset")).alias("rxwave"))
    lidar_formats.write_structs(rows, folder, record).write.parquet(scratch(s, "lvis-wave-files"))
    return lidar_formats.read_structs(s, folder, record).select("shotnumber", F.aggregate("rxwave", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


# Layouts of other formats -----------------------------------------------------------


@query("SELECT pulse_id AS record_number, azimuth AS x, azimuth + zenith AS y, zenith - azimuth AS z FROM u")
def zipped_point_choice(s, d):
    u = U(s, d)
    canopy = u.select(F.col("pulse_id").alias("record_number"), *[F.lit(0.0).alias(f"top_{a}") for a in "xyz"])
    ground = u.select(F.col("pulse_id").alias("record_number"), F.col("azimuth").alias("ground_x"), (F.col("azimuth") + F.col("zenith")).alias("ground_y"), (F.col("zenith") - F.col("azimuth")).alias("ground_z"))
    return lidar_formats.chosen_point(lidar_formats.zipped([canopy, ground]), "ground").select("record_number", "x", "y", "z")


@query("SELECT vec_id AS shot, label AS surface_type_land, label + 1 AS surface_type_ocean, label + 2 AS surface_type_sea_ice, NULL::BIGINT AS surface_type_land_ice, NULL::BIGINT AS surface_type_inland_water FROM embeddings WHERE vec_id % 2 = 1")
def beam_surface_types(s, d):
    t = s.read.parquet(f"{d}/embeddings.parquet")
    label = F.col("label").cast("long")
    rows = t.select(F.col("vec_id").alias("shot"), F.when(F.col("vec_id") % 2 == 1, "BEAM0101").otherwise("BEAM0110").alias("beam"), F.array(label, label + 1, label + 2).alias("surface_type"))
    return lidar_formats.beams(rows).drop("beam")


@query("SELECT pulse_id, 1 AS return_number, azimuth AS x, zenith AS y, 1.5::DOUBLE AS z FROM u")
def anchored_points(s, d):
    rows = U(s, d).select("pulse_id", F.col("azimuth").alias("target_x"), F.col("zenith").alias("target_y"), F.col("z_origin").alias("target_z"))
    return lidar_formats.anchored(rows)


@query("SELECT pulse_id, 1 AS return_number, azimuth AS x, zenith AS y, 1.5::DOUBLE AS z, 0 AS classification FROM u")
def footprint_points(s, d):
    rows = U(s, d).select("pulse_id", F.col("azimuth").alias("LON0"), F.col("zenith").alias("LAT0"), F.col("z_origin").alias("Z0"))
    return lidar_formats.footprint_lidar(rows)[1]


@query("""SELECT u.pulse_id, round(degrees(radians(azimuth)), 6) AS azimuth, p.return_number, p.x, CAST(p.z AS FLOAT) AS z FROM p JOIN u ON u.pulse_id = p.pulse_id""")
def third_version_store(s, d):
    n = pulses.start_index(pulses.returns_per_pulse(U(s, d), P(s, d)))
    beams = U(s, d).join(n, "pulse_id").select(F.col("pulse_id").alias("PULSE_ID"), F.radians("azimuth").alias("AZIMUTH"), F.col("start").alias("PTS_START_IDX"), F.col("n").alias("NUMBER_OF_RETURNS"))
    records = P(s, d).join(n, "pulse_id").select((F.col("start") + F.col("return_number") - 1).alias("record_number"), F.col("x").alias("X"), F.col("z").alias("Z"))
    beams, points = lidar_formats.third_version(beams, records)
    return pulses.to_points(beams, points, ["azimuth"]).select("pulse_id", F.round("azimuth", 6).alias("azimuth"), F.col("return_number").cast("long").alias("return_number"), "x", "z")


@query("SELECT vec_id AS pulse_id, i - 1 AS sample_number, 100 + i - 1 AS time, CAST(floor((CAST(embedding[i] AS DOUBLE) + 1) * 4) AS BIGINT) * 0.25::DOUBLE - 1 AS value FROM embeddings, range(1, 65) t(i)")
def waveform_segments(s, d):
    w = fixtures.waveforms(s, d).select("pulse_id", F.lit(0).alias("channel"), F.lit(1).alias("segment"), F.lit(100).alias("start"), waveform.encode(F.col("received"), F.col("gain"), F.col("offset")).alias("samples"))
    return lidar_formats.segments(w, -1.0, 0.25).select("pulse_id", F.col("sample_number").cast("long").alias("sample_number"), F.col("time").cast("long").alias("time"), "value")


@query('SELECT pulse_id AS "PULSE_ID", CAST(return_number AS BIGINT) AS "RETURN_ID", x AS "X", intensity AS "AMPLITUDE_RETURN" FROM p')
def renamed_columns(s, d):
    rows = P(s, d).select("pulse_id", F.col("return_number").cast("long").alias("return_number"), "x", "intensity")
    return translate.renamed(translate.renamed(rows, "model", "store"), "store", "third")


# Pulses from records, functions, translation, streams ---------------------------------


@query(", r AS (SELECT row_number() OVER (ORDER BY pulse_id, return_number) - 1 AS id, return_number, z FROM p) SELECT CAST(sum(CASE WHEN return_number = 1 THEN 1 ELSE 0 END) OVER (ORDER BY id) - 1 AS BIGINT) AS pulse, id, z FROM r")
def pulses_of_records(s, d):
    starts = pulses.start_index(P(s, d).groupBy("pulse_id").agg(F.count("*").alias("n"))).select("pulse_id", "start")
    records = P(s, d).join(starts, "pulse_id").select((F.col("start") + F.col("return_number") - 1).alias("id"), "return_number", "z")
    return pulses.build_pulses(records, "id").select("pulse", "id", "z")


@query(""", e AS (SELECT CAST(floor(event_id / 500) AS BIGINT) AS file, event_id, 1 + (event_id * 7919) % 5 AS announced, row_number() OVER (PARTITION BY CAST(floor(event_id / 500) AS BIGINT) ORDER BY event_id) AS k FROM events),
jump AS (SELECT file, k, event_id, k + announced AS following FROM e), start AS (
    WITH RECURSIVE walk(file, k, pulse) AS (SELECT DISTINCT file, CAST(1 AS BIGINT), CAST(0 AS BIGINT) FROM e UNION ALL SELECT w.file, j.following, w.pulse + 1 FROM walk w JOIN jump j ON j.file = w.file AND j.k = w.k WHERE EXISTS (SELECT 1 FROM jump n WHERE n.file = w.file AND n.k = j.following))
    SELECT * FROM walk)
SELECT event_id, pulse, k - first + 1 AS nth FROM (SELECT e.event_id, e.k, max(start.pulse) OVER w AS pulse, max(start.k) OVER w AS first FROM e LEFT JOIN start ON start.file = e.file AND start.k = e.k WINDOW w AS (PARTITION BY e.file ORDER BY e.k))""")
def pulses_as_announced(s, d):
    records = fixtures.records(s, d).select("event_id", F.floor(F.col("event_id") / 500).alias("file"), (1 + (F.col("event_id") * 7919) % 5).alias("announced"))
    return pulses.build_pulses_strictly(records, "event_id", "announced", "file", block=64).select("event_id", "pulse", "nth")


@query('SELECT "row", col, max(z) - min(z) AS span FROM b GROUP BY ALL')
def rasterize_by_function(s, d):
    return grid.rasterize_by(P(s, d), G5, lambda z: z.max() - z.min(), "z", "span")


@query("""SELECT t.tr AS tile_row, t.tc AS tile_col, count(*) AS n, CAST(sum(CASE WHEN floor("row" / 4) = t.tr AND floor(col / 4) = t.tc THEN 1 ELSE 0 END) AS BIGINT) AS core, t.tc * 20 + 2.5::DOUBLE AS x0, 60 - t.tr * 20 - 2.5::DOUBLE AS y0
FROM b JOIN (SELECT r.tr, c.tc FROM (SELECT unnest(range(3)) AS tr) r, (SELECT unnest(range(5)) AS tc) c) t
ON "row" BETWEEN t.tr * 4 - 2 AND t.tr * 4 + 5 AND col BETWEEN t.tc * 4 - 2 AND t.tc * 4 + 5 GROUP BY ALL""")
def block_function(s, d):
    def count(pdf, block):
        return type(pdf)({"tile_row": [block.row // 4], "tile_col": [block.column // 4], "n": [len(pdf)], "core": [int(pdf["core"].sum())], "x0": [block.x[0]], "y0": [block.y[0]]})

    # A few tiles hold all points, however many: they are counted piece by piece.
    merge = {"n": "sum", "core": "sum", "x0": "min", "y0": "min"}
    return blocks.process(P(s, d).select("x", "y"), count, "tile_row long, tile_col long, n long, core long, x0 double, y0 double", blocks.Controls(4, 2, G5), merge)


@query("SELECT CAST(floor(pulse_id / 1024) AS BIGINT) AS block, count(*) AS n, max(zenith) AS top FROM u GROUP BY ALL")
def block_function_of_pulses(s, d):
    def count(pdf):
        return type(pdf)({"block": [int(pdf["block"].iloc[0])], "n": [len(pdf)], "top": [pdf["zenith"].max()]})

    return blocks.process(U(s, d), count, "block long, n long, top double", blocks.Controls(32))


@query("SELECT pulse_id, return_number, x, y, z, CASE classification WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE classification END AS classification, 3 AS source FROM p WHERE x >= 0 AND x < 100 AND y > 0 AND y <= 60")
def translated_store(s, d):
    path = scratch(s, "translated")
    rows = P(s, d).where(C.in_box("x", "y", G5.extent)).select("pulse_id", F.col("return_number").cast("long").alias("return_number"), "x", "y", "z", "classification")
    o = translate.Options(ranges={"z": (1.0, 50.0), "classification": (1, 7)}, constants={"source": ("INT32", 3)}, classes={1: 2, 2: 1}, grid=G5, block=4)
    translate.translate(U(s, d), rows, path, o)
    found = store.read(s, path)["points"]
    return found.select("pulse_id", "return_number", "x", "y", "z", F.col("classification").cast("long").alias("classification"), "source")


@query("SELECT CAST((4294967295.0::DOUBLE) / (max(z) - min(z)) AS DOUBLE) AS gain, min(z) AS offset FROM p")
def fitted_scaling_of_z(s, d):
    r = grid.header(P(s, d), ["z"]).first()
    gain, offset = fitted_scaling(r["low"], r["high"])
    return s.createDataFrame(pa.table({"gain": [gain], "offset": [offset]}))


@query("""SELECT * FROM (VALUES ('x', true), ('y', true), ('z', false), ('classification', true)) t("column", same)""")
def checksum_compare(s, d):
    path = scratch(s, "checked")
    P(s, d).select("x", "y", (F.col("z") + F.when(F.col("pulse_id") == 1, 0.5).otherwise(0.0)).alias("z"), "classification").write.parquet(path)
    return grid.differing(P(s, d), s.read.parquet(path), ["x", "y", "z", "classification"])


@query('SELECT CAST(floor("row" / 4) AS BIGINT) AS tile_row, CAST(floor(col / 4) AS BIGINT) AS tile_col, count(*) AS n, min(z) AS low, max(z) AS high FROM b GROUP BY ALL')
def stream_tiles(s, d):
    source = s.readStream.schema(s.read.parquet(f"{d}/lineitem.parquet").schema).option("pathGlobFilter", "lineitem.parquet").option("maxFilesPerTrigger", 1).parquet(d)
    points = source.select(((F.col("l_partkey") % 800) * 0.125).alias("x"), ((F.col("l_suppkey") % 100) * 0.5 + F.col("l_linenumber") * 0.125).alias("y"), F.col("l_quantity").alias("z"))
    out = scratch(s, "stream-tiles")
    stream = tiles.tile_statistics(points, G5, 4).writeStream.outputMode("complete").option("checkpointLocation", scratch(s, "stream-state")).trigger(availableNow=True)
    # Every batch has all tiles, and the last one stays.
    stream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return s.read.parquet(out)
