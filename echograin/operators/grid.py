"""Binning: rasters, counts, tiles, halos, extents, headers."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.columns import column_of, in_box, row_of
from ..model import Extent, FunctionUnsupported, Grid
from .pulses import start_index

#: Aggregates that a raster can ask for by name.
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "min": F.min, "max": F.max, "mean": F.avg, "sum": F.sum, "count": F.count, "median": F.median, "std": F.stddev_pop, "var": F.var_pop,
}


def binned(df: DataFrame, g: Grid, x: str = "x", y: str = "y") -> DataFrame:
    """df with row and col; what lies outside the grid goes. The box reaches the scan where x and y are plain columns."""
    return df.withColumns({"row": row_of(y, g), "col": column_of(x, g)}).where(in_box(x, y, g.extent)).where((F.col("row") >= 0) & (F.col("row") < g.rows) & (F.col("col") >= 0) & (F.col("col") < g.columns))


def cells(df: DataFrame, g: Grid) -> DataFrame:
    """Every cell of the grid, made in parallel."""
    n = df.sparkSession.range(g.rows * g.columns)
    return n.select(F.floor(F.col("id") / g.columns).alias("row"), (F.col("id") % g.columns).alias("col"))


def rasterize(df: DataFrame, g: Grid, layers: dict[str, tuple[str, str]], background: float | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """One row per cell: row, col, and a column per layer, {name: (aggregate, attribute)}.

    With a background every cell of the grid is there, empty ones with it.
    """
    unknown = [f for f, _ in layers.values() if f not in AGGREGATES]
    if unknown:
        raise FunctionUnsupported(f"no aggregate named {unknown[0]}; see also rasterize_by")
    out = binned(df, g, x, y).groupBy("row", "col").agg(*[AGGREGATES[f](F.col(a)).alias(name) for name, (f, a) in layers.items()])
    if background is None:
        return out
    full = cells(df, g).join(out, ["row", "col"], "left")
    return full.select("row", "col", *[F.coalesce(F.col(name), F.lit(background)).alias(name) for name in layers])


def rasterize_by(df: DataFrame, g: Grid, reduce: Callable, attribute: str, name: str = "value", x: str = "x", y: str = "y") -> DataFrame:
    """As rasterize, by a function of a pandas Series; a cell's values go to one task."""

    def one(key: tuple, cell: pa.Table) -> pa.Table:
        return pa.table({"row": [key[0].as_py()], "col": [key[1].as_py()], name: [float(reduce(cell["__v"].to_pandas()))]})

    out = binned(df, g, x, y).select("row", "col", F.col(attribute).cast("double").alias("__v"))
    return out.groupBy("row", "col").applyInArrow(one, StructType([StructField("row", LongType()), StructField("col", LongType()), StructField(name, DoubleType())]))


def lowest(df: DataFrame, by: list[str], key: list[str], keep: list[str]) -> DataFrame:
    """For each group the row with the least key, a total order: partial aggregation, no sort."""
    best = F.min_by(F.struct(*keep), F.struct(*key))
    return df.groupBy(*by).agg(best.alias("best")).select(*by, *[F.col(f"best.{c}").alias(c) for c in keep])


def bin_index(df: DataFrame, g: Grid, x: str = "x", y: str = "y") -> DataFrame:
    """row, col, n, start: where each cell's items begin once sorted by cell. Cells are added up in blocks."""
    counts = binned(df, g, x, y).groupBy("row", "col").agg(F.count("*").alias("n")).withColumn("__cell", F.col("row") * g.columns + F.col("col"))
    return start_index(counts, "__cell").select("row", "col", "n", "start")


def height_bins(df: DataFrame, g: Grid, step: float, bottom: float = 0.0, z: str = "z") -> DataFrame:
    return binned(df, g).withColumn("hbin", F.floor((F.col(z) - bottom) / step)).groupBy("row", "col", "hbin").agg(F.count("*").alias("n"))


def tiled(df: DataFrame, g: Grid, block: int, x: str = "x", y: str = "y") -> DataFrame:
    """df, binned, with tile_row and tile_col: block x block cells."""
    b = binned(df, g, x, y)
    return b.withColumns({"tile_row": F.floor(F.col("row") / block), "tile_col": F.floor(F.col("col") / block)})


def default_block(e: Extent, size: float, most: float = 200.0) -> int:
    """Cells of a tile's side: half the shorter axis, but no more than `most`, in whole cells."""
    side = min((e.x_max - e.x_min) / 2, (e.y_max - e.y_min) / 2, most)
    return max(1, -int(-side // size))


def with_halo(df: DataFrame, g: Grid, block: int, margin: int, x: str = "x", y: str = "y") -> DataFrame:
    """df copied to each tile that has the cell within `margin` cells; core tells the tile's own. Copies are at most (2 ceil(margin / block) + 1) squared."""
    b = binned(df, g, x, y)

    def reach(c: str, n: int) -> Column:
        low, high = F.floor((F.col(c) - margin) / block), F.floor((F.col(c) + margin) / block)
        return F.explode(F.sequence(F.greatest(low, F.lit(0).cast("long")), F.least(high, F.lit((n - 1) // block).cast("long"))))

    out = b.withColumn("tile_row", reach("row", g.rows)).withColumn("tile_col", reach("col", g.columns))
    core = (F.floor(F.col("row") / block) == F.col("tile_row")) & (F.floor(F.col("col") / block) == F.col("tile_col"))
    return out.withColumn("core", core)


def extent_of(df: DataFrame, x: str = "x", y: str = "y") -> Extent:
    r = df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    return Extent(*map(float, r))


def header(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per column: its minimum, maximum and count, in one pass."""
    stats = df.agg(*[F.struct(F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"), F.count(c).alias("n")).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}.low").alias("low"), F.col(f"{c}.high").alias("high"), F.col(f"{c}.n").alias("n")) for c in columns]))
    return stats.select(pairs.alias("s")).select("s.*")


def checksum(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per column: an order-free digest of its values, nulls included.

    A value is written in full (numbers with fractions as %.16e), and the first 32 bits of its MD5 are added up.
    """

    def written(c: str) -> Column:
        number = df.schema[c].dataType.typeName() in ("double", "float")
        return F.format_string("%.16e", F.col(c).cast("double")) if number else F.col(c).cast("string")

    sums = df.agg(*[F.sum(F.conv(F.substring(F.md5(F.when(F.col(c).isNull(), "null").otherwise(written(c)).cast("binary")), 1, 8), 16, 10).cast("long")).alias(c) for c in columns], F.count("*").alias("__n"))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("digest"), F.col("__n").alias("n")) for c in columns]))
    return sums.select(pairs.alias("s")).select("s.*")


def differing(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """A row per column of two tables: are their digests and counts the same?"""
    one, other = checksum(a, columns), checksum(b, columns)
    joined = one.join(other.select("column", F.col("digest").alias("__d"), F.col("n").alias("__n")), "column")
    return joined.select("column", ((F.col("digest").eqNullSafe(F.col("__d"))) & (F.col("n") == F.col("__n"))).alias("same"))


def outside(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """A row per column: how many values lie outside its limits, and its extremes."""
    stats = df.agg(*[F.struct(F.count_if((F.col(c) < low) | (F.col(c) > high)).alias("bad"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high")).alias(c) for c, (low, high) in limits.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}.bad").alias("bad"), F.col(f"{c}.low").alias("low"), F.col(f"{c}.high").alias("high")) for c in limits]))
    return stats.select(pairs.alias("s")).select("s.*")
