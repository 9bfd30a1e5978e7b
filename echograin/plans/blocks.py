"""User functions over blocks: a pandas function applied to tiles with a margin, or to ranges of pulses."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Extent, FunctionUnsupported, Grid, NonSpatialProcessing
from ..operators.grid import with_halo
from ..session import setting

#: Rows of the pieces that a function takes whose answers can be merged.
PIECE = 1 << 17
#: How answers over the pieces of a block can be merged.
MERGES = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass
class Controls:
    """window: cells of a tile's side, or the root of pulses in a range; overlap: cells around a tile."""

    window: int = 256
    overlap: int = 0
    grid: Grid | None = None

    @staticmethod
    def of(spark: SparkSession, **given) -> Controls:
        """Controls with the session's defaults, spark.echograin.window and spark.echograin.overlap, where nothing is given."""
        defaults = {"window": setting(spark, "window", int, 256), "overlap": setting(spark, "overlap", int, 0)}
        return Controls(**(defaults | given))


@dataclass(frozen=True)
class Block:
    """What a function that takes two arguments is told of its block: its cells, its extent, and the coordinates of its cells' centres."""

    row: int
    column: int
    rows: int
    columns: int
    extent: Extent
    x: np.ndarray
    y: np.ndarray

    @staticmethod
    def of(g: Grid, window: int, tile_row: int, tile_column: int) -> Block:
        row, column = tile_row * window, tile_column * window
        rows, columns = min(window, g.rows - row), min(window, g.columns - column)
        x0, y1 = g.x_min + column * g.size, g.y_max - row * g.size
        e = Extent(x0, x0 + columns * g.size, y1 - rows * g.size, y1)
        return Block(row, column, rows, columns, e, x0 + g.size * (np.arange(columns) + 0.5), y1 - g.size * (np.arange(rows) + 0.5))


def process(df: DataFrame, function: Callable, schema: str, controls: Controls | None = None, merge: dict[str, str] | None = None) -> DataFrame:
    """function(pandas frame) for every block; frames have tile_row, tile_col and core when there is a grid, else block.

    With a grid, a function of two arguments gets the Block as the second.

    A block is what one task holds. The window bounds its cells or pulses, but not how many points lie in them. Where a block's answer follows from answers
    over its parts, merge tells how, {column of the answer: sum, min or max}; the other columns tell whose answers belong together. The function then takes
    pieces of a block, PIECE rows at most, where they are read, and only answers are regrouped. For what needs no state over a block, use column functions.
    """
    c = controls or Controls()
    if c.grid is not None:
        g, window = c.grid, c.window
        if len(inspect.signature(function).parameters) > 1:
            plain = function
            function = lambda pdf: plain(pdf, Block.of(g, window, int(pdf["tile_row"].iloc[0]), int(pdf["tile_col"].iloc[0])))
        blocked, keys = with_halo(df, c.grid, c.window, c.overlap), ["tile_row", "tile_col"]
    else:
        if c.overlap:
            raise NonSpatialProcessing("an overlap needs a grid")
        blocked, keys = df.withColumn("block", F.floor(F.col("pulse_id") / (c.window * c.window))), ["block"]
    if merge is None:
        return blocked.groupBy(*keys).applyInPandas(function, schema)
    unknown = [how for how in merge.values() if how not in MERGES]
    if unknown:
        raise FunctionUnsupported(f"answers can't be merged by {unknown[0]}, but by {', '.join(MERGES)}")
    parts = blocked.mapInPandas(_in_pieces(function, keys, PIECE), schema)
    merged = parts.groupBy(*[n for n in parts.columns if n not in merge]).agg(*[MERGES[how](n).cast(parts.schema[n].dataType).alias(n) for n, how in merge.items()])
    return merged.select(*parts.columns)


def _in_pieces(function: Callable, keys: list[str], piece: int) -> Callable:
    """The function over a task's rows: a piece of them at a time, block by block."""

    def answers(held: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat([function(block.reset_index(drop=True)) for _, block in pd.concat(held).groupby(keys, dropna=False)])

    def kernel(frames):
        held, n = [], 0
        for frame in frames:
            for at in range(0, len(frame), piece):
                part = frame[at : at + piece]
                if n + len(part) > piece:
                    yield answers(held)
                    held, n = [], 0
                held.append(part)
                n += len(part)
        if held:
            yield answers(held)

    return kernel
