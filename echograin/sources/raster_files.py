"""Rasters in files: Parquet rows with their grid in the metadata, and ESRI ASCII."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Grid, InvalidData, InvalidSetting
from ..operators.grid import cells
from ..operators.pulses import start_index


def write_raster(layers: DataFrame, g: Grid, path: str) -> None:
    """Rows (row, col, layers ...), the grid in the metadata of row."""
    meta = {"x_min": g.x_min, "y_max": g.y_max, "size": g.size, "rows": g.rows, "columns": g.columns}
    values = [c for c in layers.columns if c not in ("row", "col")]
    if not values or len({layers.schema[c].dataType.simpleString() for c in values}) > 1:
        raise InvalidData("a raster's layers have one type")
    layers.select(F.col("row").alias("row", metadata=meta), "col", *values).write.parquet(path)


def read_raster(spark: SparkSession, path: str) -> tuple[DataFrame, Grid]:
    df = spark.read.parquet(path)
    return df, Grid(**df.schema["row"].metadata)


def write_ascii(raster: DataFrame, g: Grid, value: str, path: str, nodata: float = -9999.0) -> None:
    """One line per grid row, in order; a line's cells meet in one task, no more."""
    full = cells(raster, g).join(raster.select("row", "col", value), ["row", "col"], "left")
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", F.coalesce(F.col(value), F.lit(nodata)).alias("v")))), lambda s: s["v"].cast("string")), " ")
    head = [f"ncols {g.columns}", f"nrows {g.rows}", f"xllcorner {g.x_min}", f"yllcorner {g.y_max - g.rows * g.size}", f"cellsize {g.size}", f"NODATA_value {nodata}"]
    top = raster.sparkSession.createDataFrame([(k - len(head), h) for k, h in enumerate(head)], "row long, line string")
    body = full.groupBy("row").agg(line.alias("line"))
    top.unionByName(body).repartitionByRange("row").sortWithinPartitions("row").select("line").coalesce(1).write.text(path)


def read_ascii(spark: SparkSession, path: str) -> tuple[DataFrame, Grid]:
    """(row, col, v) and the grid of an ESRI ASCII raster, one file or a folder with one; lines are numbered by their place in it."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
    head = {r["value"].split()[0].lower(): r["value"].split()[1] for r in lines.where("value rlike '^\\\\s*[A-Za-z]'").collect()}
    size, rows, columns = float(head["cellsize"]), int(head["nrows"]), int(head["ncols"])
    g = Grid(float(head["xllcorner"]), float(head["yllcorner"]) + rows * size, size, rows, columns)
    # Identifiers rise with the place; a running count of lines in blocks, of few lines as these are long, gives the row.
    numbered = start_index(lines.where("value not rlike '^\\\\s*[A-Za-z]'").withColumn("one", F.lit(1)), "at", "one", block=1 << 10)
    cell = F.posexplode(F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double"))).alias("col", "v")
    return numbered.select(F.col("start").alias("row"), cell).withColumn("col", F.col("col").cast("long")), g


def read_block(spark: SparkSession, path: str, layer: str, row: int, column: int, rows: int, columns: int, margin: int = 0) -> DataFrame:
    """A block of a raster and `margin` cells around it, as far as the grid goes: row, col, layer, null where there is no data."""
    df, g = read_raster(spark, path)
    if not (0 <= row < g.rows and 0 <= column < g.columns):
        raise InvalidSetting("the block begins outside the raster")
    top, left = max(0, row - margin), max(0, column - margin)
    bottom, right = min(g.rows, row + rows + margin) - 1, min(g.columns, column + columns + margin) - 1
    wide = right - left + 1
    every = spark.range((bottom - top + 1) * wide).select((F.floor(F.col("id") / wide) + top).alias("row"), (F.col("id") % wide + left).alias("col"))
    return every.join(df.where(F.col("row").between(top, bottom) & F.col("col").between(left, right)).select("row", "col", layer), ["row", "col"], "left")


def statistics(raster: DataFrame, layer: str) -> DataFrame:
    """One row: lo, hi, mean, sd and n of a layer's cells that hold a value."""
    return raster.agg(F.min(layer).alias("lo"), F.max(layer).alias("hi"), F.avg(layer).alias("mean"), F.stddev_pop(layer).alias("sd"), F.count(layer).alias("n"))
