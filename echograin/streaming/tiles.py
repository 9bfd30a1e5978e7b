"""Point files as a stream: aggregates of tiles, kept up to date. An addition; the model knows no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..model import Grid
from ..operators.grid import tiled


def points_stream(spark: SparkSession, path: str, schema: StructType, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def tile_statistics(points: DataFrame, g: Grid, block: int, time: str | None = None, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """tile_row, tile_col, n, low, high; with an event time by window too, and state of windows older than `late` dropped."""
    keys = ["tile_row", "tile_col"]
    if time:
        points = points.withWatermark(time, late)
        return tiled(points, g, block).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("n"), F.min("z").alias("low"), F.max("z").alias("high"))
    return tiled(points, g, block).groupBy(*keys).agg(F.count("*").alias("n"), F.min("z").alias("low"), F.max("z").alias("high"))
