"""Delimited text of points, plain or gzip, and pulses built from consecutive records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import RANGES, ColumnError, InvalidData
from ..operators.pulses import runs

#: Declared type: Spark type.
TYPES = {"INT8": "smallint", "UINT8": "smallint", "INT16": "int", "UINT16": "int", "INT32": "bigint", "UINT32": "bigint", "INT64": "bigint", "UINT64": "decimal(20,0)", "FLOAT32": "float", "FLOAT64": "double"}


def read_text(spark: SparkSession, path: str, columns: list[tuple[str, str]], comment: str = "#", strict: bool = True) -> DataFrame:
    """Rows of space, comma or tab separated numbers; columns are (name, declared type).

    A short row is an error, or, if not strict, dropped to nulls. Integers outside their type are null. Adds record_number, the
    place in the file's order: files by name, lines as they come. Blank lines and comments are skipped.
    """
    for name, kind in columns:
        if kind not in TYPES:
            raise ColumnError(f"{name}: unknown type {kind}")
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    lines = lines.where((F.length("line") > 0) & ~F.col("line").startswith(comment))
    parts = lines.withColumn("parts", F.split("line", r"\s*,\s*|\s+"))
    short = F.size("parts") < len(columns)
    if strict:
        parts = parts.withColumn("parts", F.when(short, F.raise_error(F.concat(F.lit("short row: "), F.col("line"))).cast("array<string>")).otherwise(F.col("parts")))

    def value(i: int, kind: str):
        x = F.try_element_at("parts", F.lit(i + 1))
        if kind in RANGES:
            low, high = RANGES[kind]
            number = x.try_cast("decimal(20,0)")
            return F.when((number >= low) & (number <= high), number).cast(TYPES[kind])
        return x.try_cast(TYPES[kind])

    return parts.select("file", F.col("at").alias("record_number"), *[value(i, kind).alias(name) for i, (name, kind) in enumerate(columns)])


def read_pulses(spark: SparkSession, path: str, columns: list[tuple[str, str]], pulse_columns: list[str], sequential: bool = True, **options) -> tuple[DataFrame, DataFrame]:
    """(pulses, points): consecutive rows equal in all pulse columns are a pulse; not sequential: each row is one."""
    rows = read_text(spark, path, columns, **options)
    missing = set(pulse_columns) - {n for n, _ in columns}
    if missing:
        raise InvalidData(f"no such columns: {sorted(missing)}")
    if sequential:
        # A run never crosses a file, which 128 bits stand for in the key: a path in every row would be most of what is sorted.
        slim = rows.withColumns({"__file": F.xxhash64("file"), "__also": F.xxhash64(F.lit(1), "file")}).drop("file")
        rows = runs(slim, "record_number", ["__file", "__also", *pulse_columns], nth="__place")
    else:
        rows = rows.withColumns({"run": F.col("record_number"), "__place": F.lit(1)})
    rows = rows.withColumnRenamed("run", "pulse_id")
    points = rows.select("pulse_id", F.col("__place").cast("int").alias("return_number"), *[n for n, _ in columns if n not in pulse_columns])
    pulses = rows.groupBy("pulse_id").agg(*[F.first(c).alias(c) for c in pulse_columns], F.count("*").alias("number_of_returns"))
    return pulses, points


def write_profile(df: DataFrame, path: str, places: int = 4) -> None:
    """A profile, a few rows, as CSV with a header and so many decimals."""
    numbers = {f.name for f in df.schema if f.dataType.simpleString() == "double"}
    df.select(*[F.format_string(f"%.{places}f", c).alias(c) if c in numbers else F.col(c) for c in df.columns]).coalesce(1).write.option("header", True).csv(path)


def read_matrix(spark: SparkSession, path: str) -> list[list[float]]:
    """A small matrix, such as a 4 x 4 transform, of blank separated numbers."""
    rows = [[float(x) for x in r["value"].split()] for r in spark.read.text(path).limit(1000).collect() if r["value"].strip()]
    if len({len(r) for r in rows}) > 1:
        raise InvalidData("rows of the matrix differ in length")
    return rows
