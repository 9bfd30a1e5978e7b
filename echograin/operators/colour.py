"""Colours of points, without a viewer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Class: red, green, blue, size.
PALETTE = {1: (0.6, 0.6, 0.6, 1.0), 2: (0.5, 0.3, 0.1, 1.0), 3: (0.4, 0.8, 0.4, 1.5), 4: (0.2, 0.6, 0.2, 1.5), 5: (0.0, 0.4, 0.0, 2.0), 6: (0.9, 0.2, 0.2, 2.0), 9: (0.1, 0.3, 0.9, 1.0)}


def by_class(df: DataFrame, palette: dict[int, tuple[float, ...]] = PALETTE, code: str = "classification") -> DataFrame:
    """df with r, g, b, point_size; classes without a colour are white."""
    table = df.sparkSession.createDataFrame([(k, *v) for k, v in palette.items()], f"{code} int, r double, g double, b double, point_size double")
    # The palette is a few rows of this module.
    return df.join(F.broadcast(table), code, "left").fillna(1.0, ["r", "g", "b", "point_size"])


def rescaled(df: DataFrame, bands: list[str], eight_bit: bool = False) -> DataFrame:
    """Each band over 255, or from its minimum to its maximum, as 0 to 1."""
    if eight_bit:
        return df.withColumns({b: F.col(b) / 255.0 for b in bands})
    s = df.agg(*[F.min(b).alias(f"lo_{b}") for b in bands], *[F.max(b).alias(f"hi_{b}") for b in bands]).first()

    def part(b: str):
        low, high = s[f"lo_{b}"], s[f"hi_{b}"]
        return (F.col(b) - F.lit(low)) / F.lit(float(high - low) or 1.0) if low is not None else F.col(b)

    return df.withColumns({b: part(b) for b in bands})


def centred(df: DataFrame, axes: list[str]) -> DataFrame:
    """Axes less their minimum, around their median, over the widest range."""
    s = df.agg(*[F.struct(F.min(a).alias("lo"), F.max(a).alias("hi"), F.median(a).alias("mid")).alias(a) for a in axes]).first()
    if s[axes[0]]["lo"] is None:
        return df
    wide = max(s[a]["hi"] - s[a]["lo"] for a in axes) or 1.0
    return df.withColumns({a: (F.col(a) - F.lit(float(s[a]["mid"]))) / F.lit(float(wide)) for a in axes})


