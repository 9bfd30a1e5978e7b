"""Waveforms: samples as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decode(samples: Column, gain: Column, offset: Column) -> Column:
    return F.transform(samples, lambda s: s.cast("double") / gain + offset)


def encode(samples: Column, gain: Column, offset: Column) -> Column:
    """Stored whole numbers, cut off rather than rounded."""
    return F.transform(samples, lambda s: F.floor((s.cast("double") - offset) * gain))


def flattened(df: DataFrame, samples: str) -> DataFrame:
    """One row per sample: all other columns, and sample_number and sample."""
    rest = [c for c in df.columns if c != samples]
    return df.select(*rest, F.posexplode(samples).alias("sample_number", "sample"))


def peak(samples: Column) -> Column:
    """The largest sample's place, the first of equals, and value."""
    top = F.array_max(samples)
    return F.struct((F.array_position(samples, top) - 1).alias("place"), top.alias("value"))


def descriptors(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).distinct()


def range_to_start(blocks: DataFrame, group_velocity: float) -> DataFrame:
    """Of blocks(pulse_id, channel, t): those of channels 0 and 1, with the range to where they begin, from channel 3's time."""
    reference = F.max(F.when(F.col("channel") == 3, F.col("t"))).over(Window.partitionBy("pulse_id"))
    out = blocks.withColumn("start_range", (F.col("t") - reference) * group_velocity / 2)
    return out.where(F.col("channel").isin(0, 1))
