"""The canonical store: Parquet tables pulses, points and waveforms, laid out by tile, fixed-point columns with their scaling.

Stored whole numbers carry gain, offset, type and null sentinel in the column's metadata. A read decodes them; `name_U` asks for
the stored value. A box becomes a filter on tiles, which prunes directories, beside the exact one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import column_of, in_box, row_of, scale_decode, scale_encode
from ..model import ColumnError, Extent, Grid, InvalidSetting

TABLES = ("pulses", "points", "waveforms")
ESSENTIAL = ("x", "y", "z", "classification")


@dataclass
class Scaling:
    gain: float
    offset: float
    kind: str = "UINT32"
    null: float | None = None


@dataclass
class Layout:
    """How a table is stored: scalings by column, tiles of `block` cells of `grid`."""

    scalings: dict[str, Scaling] = field(default_factory=dict)
    grid: Grid | None = None
    block: int = 64
    x: str = "x"
    y: str = "y"


def write_table(df: DataFrame, path: str, layout: Layout | None = None, mode: str = "error") -> None:
    """df as Parquet. With a grid, rows go to the directory of their tile, sorted by cell; one shuffle does it."""
    layout = layout or Layout()
    out = df
    tile = None
    if layout.grid is not None:
        g = layout.grid
        r, c = row_of(layout.y, g), column_of(layout.x, g)
        out = out.withColumns({"cell_row": r, "cell_col": c, "tile_row": F.floor(r / layout.block), "tile_col": F.floor(c / layout.block)})
        tile = {"x_min": g.x_min, "y_max": g.y_max, "size": g.size, "rows": g.rows, "columns": g.columns, "block": layout.block, "x": layout.x, "y": layout.y}
    columns = []
    for name in out.columns:
        if s := layout.scalings.get(name):
            value = F.col(name) if s.null is None else F.coalesce(F.col(name), F.lit(s.null))
            meta = {"gain": s.gain, "offset": s.offset, "kind": s.kind, "null": s.null}
            columns.append(scale_encode(value, s.gain, s.offset, s.kind).alias(name, metadata=meta))
        elif name == layout.x and tile:
            columns.append(F.col(name).alias(name, metadata={"tile": tile}))
        else:
            columns.append(F.col(name))
    out = out.select(*columns)
    if tile:
        # Range partitioning by tile, then cell: even tasks, few files a tile.
        out = out.repartitionByRange("tile_row", "tile_col", "cell_row", "cell_col").sortWithinPartitions("tile_row", "tile_col", "cell_row", "cell_col").drop("cell_row", "cell_col")
        out.write.mode(mode).partitionBy("tile_row", "tile_col").parquet(path)
    else:
        out.write.mode(mode).parquet(path)


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, box: Extent | None = None, grid: Grid | None = None, block: int = 64, x: str = "x", y: str = "y") -> DataFrame:
    """The named columns, decoded. With the grid it was written by, a box prunes tiles."""
    df = spark.read.option("mergeSchema", False).parquet(path)
    if box is not None:
        if grid is not None and "tile_row" in df.columns:
            top, bottom = int((grid.y_max - box.y_max) // grid.size) // block, int((grid.y_max - box.y_min) // grid.size) // block
            left, right = int((box.x_min - grid.x_min) // grid.size) // block, int((box.x_max - grid.x_min) // grid.size) // block
            df = df.where(F.col("tile_row").between(top, bottom) & F.col("tile_col").between(left, right))
    fields = {f.name: f for f in df.schema}

    def decoded(name: str):
        raw = name.endswith("_U") and name[:-2] in fields
        own = name[:-2] if raw else name
        if own not in fields:
            raise ColumnError(f"no column {name}")
        m = fields[own].metadata
        if raw or "gain" not in m:
            return F.col(own).alias(name)
        value = scale_decode(own, m["gain"], m["offset"])
        return (value if m["null"] is None else F.nullif(value, F.lit(m["null"]))).alias(name)

    names = columns or [c for c in df.columns if c not in ("tile_row", "tile_col")]
    if box is not None:
        xs, ys = decoded(x), decoded(y)
        df = df.where(in_box(xs, ys, box))
    return df.select(*[decoded(n) for n in names])


def scaling_columns(df_or_path: DataFrame | str, spark: SparkSession | None = None) -> dict[str, dict]:
    """The scaling of each fixed-point column."""
    df = spark.read.parquet(df_or_path) if isinstance(df_or_path, str) else df_or_path
    return {f.name: dict(f.metadata) for f in df.schema if "gain" in f.metadata}


def write(tables: dict[str, DataFrame], path: str, layouts: dict[str, Layout] | None = None, mode: str = "error") -> None:
    unknown = set(tables) - set(TABLES)
    if unknown:
        raise InvalidSetting(f"no such tables: {sorted(unknown)}")
    if "points" in tables and (lacking := set(ESSENTIAL) - {c.lower() for c in tables["points"].columns}):
        raise ColumnError(f"points lack {sorted(lacking)}")
    for name, df in tables.items():
        write_table(df, f"{path}/{name}", (layouts or {}).get(name), mode)


def read(spark: SparkSession, path: str, tables: tuple[str, ...] = ("pulses", "points")) -> dict[str, DataFrame]:
    return {t: read_table(spark, f"{path}/{t}") for t in tables}


def _attribute(df: DataFrame, name: str) -> str | None:
    """What tells a column that was passed on from one that was computed."""
    output = df._jdf.queryExecution().analyzed().output()
    return next((output.apply(i).exprId().toString() for i in range(output.size()) if output.apply(i).name() == name), None)


def update(spark: SparkSession, path: str, new_path: str, change) -> None:
    """A new version of a table: change(df) written beside the old one, the cell columns x_idx and y_idx kept as they were."""
    old = spark.read.parquet(path)
    new = change(old)
    kept = [c for c in ("x_idx", "y_idx") if c in old.columns]
    if kept and any(_attribute(new, c) != _attribute(old, c) for c in kept):
        new = new.drop(*kept).join(old.select("pulse_id", *kept), "pulse_id")
    new.write.parquet(new_path)
