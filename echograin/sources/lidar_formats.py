"""Adapters from other layouts onto pulses and points, for tables that hold their columns, and files of binary records."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import DriverNotFound, InvalidSetting
from ..session import file_system


def footprint_lidar(df: DataFrame, point: tuple[str, str, str] = ("LON0", "LAT0", "Z0")) -> tuple[DataFrame, DataFrame]:
    """Every scalar column is the pulse's; the point is three chosen ones; a class that isn't there is 0."""
    numbered = df if "pulse_id" in df.columns else df.withColumn("pulse_id", F.monotonically_increasing_id())
    cls = F.col("CLASSIFICATION") if "CLASSIFICATION" in df.columns else F.lit(0)
    points = numbered.select("pulse_id", F.lit(1).alias("return_number"), *[F.col(c).alias(a) for c, a in zip(point, "xyz")], cls.alias("classification"))
    return numbered, points


def beams(df: DataFrame, beam: str = "BEAM0101", surface: str = "surface_type") -> DataFrame:
    """One beam's rows; the array of surface types becomes a column each."""
    names = ("land", "ocean", "sea_ice", "land_ice", "inland_water")
    return df.where(F.col("beam") == beam).withColumns({f"{surface}_{n}": F.try_element_at(surface, F.lit(i + 1)) for i, n in enumerate(names)}).drop(surface)


def anchored(df: DataFrame, point: str = "target") -> DataFrame:
    """One return per pulse: its anchor or its target."""
    if point not in ("anchor", "target"):
        raise InvalidSetting(f"a pulse's point is its anchor or target, not {point}")
    return df.select("pulse_id", F.lit(1).alias("return_number"), *[F.col(f"{point}_{a}").alias(a) for a in "xyz"])


def zipped(tables: list[DataFrame], key: str = "record_number") -> DataFrame:
    """Sibling tables put side by side, record by record."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, key)
    return out


def chosen_point(df: DataFrame, source: str) -> DataFrame:
    """x, y, z of one of the four points a sibling record offers: top, ground, start or end of the waveform."""
    if source not in ("top", "ground", "start", "end"):
        raise InvalidSetting(f"no such point: {source}")
    return df.withColumns({a: F.col(f"{source}_{a}") for a in "xyz"})


#: Records that one task reads.
RECORDS = 1 << 20

_SHOT = {"id": [("lfid", ">u4"), ("shotnumber", ">u4")], "time": [("lvistime", ">f8")], "ray": [("azimuth", ">f4"), ("incidentangle", ">f4"), ("range", ">f4")]}
_POINT = {
    "lce": [("tlon", ">f8"), ("tlat", ">f8"), ("zt", ">f4")],
    "lge": [("glon", ">f8"), ("glat", ">f8"), ("zg", ">f4"), ("rh25", ">f4"), ("rh50", ">f4"), ("rh75", ">f4"), ("rh100", ">f4")],
}


def lvis_record(kind: str, version: str) -> list[tuple]:
    """The fields of a canopy (lce), ground (lge) or waveform (lgw) record of large-footprint lidar, versions 1.00 to 1.04.

    Identifiers came with 1.01, time with 1.02, the ray with 1.03; the waveform grew, and got a transmitted one.
    """
    minor = int(version.split(".")[1])
    if kind not in ("lce", "lge", "lgw") or not version.startswith("1.") or minor > 4:
        raise DriverNotFound(f"no layout {kind} {version}")
    head = _SHOT["id"] * (minor >= 1) + _SHOT["ray"] * (minor >= 3) + _SHOT["time"] * (minor >= 2)
    if kind != "lgw":
        return head + _POINT[kind]
    last = 527 if minor == 4 else 431
    place = [("lon0", ">f8"), ("lat0", ">f8"), ("z0", ">f4"), (f"lon{last}", ">f8"), (f"lat{last}", ">f8"), (f"z{last}", ">f4"), ("sigmean", ">f4")]
    waves = {4: [("txwave", ">u2", 120), ("rxwave", ">u2", 528)], 3: [("txwave", "u1", 80), ("rxwave", "u1", 432)]}
    return head + place + waves.get(minor, [("rxwave", "u1", 432)])


_NUMBERS = {"u1": "int", "i1": "int", "u2": "int", "i2": "int", "u4": "long", "i4": "int", "i8": "long", "f4": "float", "f8": "double"}


def columns_of(record: list[tuple]) -> str:
    """The Spark columns of a record's fields; a field that repeats is an array."""
    kinds = [(n, _NUMBERS[np.dtype(k).str[1:]], bool(rest)) for n, k, *rest in record]
    return ", ".join(f"`{n}` array<{k}>" if many else f"`{n}` {k}" for n, k, many in kinds)


def read_structs(spark: SparkSession, path: str, record: list[tuple], columns: str | None = None, header: int = 0, file: str | None = None) -> DataFrame:
    """Files of fixed records: (name, numpy type, and how often, if not once) in order, after a header of so many bytes.

    A task reads RECORDS records of a file at most; an incomplete last record is passed over. Adds record_number, the
    place in its file, and, under the name `file` if that is given, the file.
    """
    kind = np.dtype(record)
    files, name = file_system(path)
    info = files.get_file_info(name)
    found = [info] if info.is_file else sorted((f for f in files.get_file_info(fs.FileSelector(name)) if f.is_file), key=lambda f: f.path)
    parts = [(f.path, k, min(RECORDS, (f.size - header) // kind.itemsize - k)) for f in found for k in range(0, max(0, (f.size - header) // kind.itemsize), RECORDS)]
    columns = columns or columns_of(record)
    shape = "record_number long, " + columns + (f", `{file}` string" if file else "")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = file_system(path)
        for batch in batches:
            for part in batch.to_pylist():
                with files.open_input_file(part["name"]) as f:
                    f.seek(header + part["first"] * kind.itemsize)
                    for at in range(0, part["n"], 1 << 14):
                        n = min(1 << 14, part["n"] - at)
                        raw = np.frombuffer(f.read(n * kind.itemsize), kind)
                        own = [pa.array(part["first"] + at + np.arange(n)), *(_arrow(raw[c]) for c in kind.names)]
                        where = [pa.array([part["name"]] * n, pa.string())] if file else []
                        yield pa.RecordBatch.from_arrays(own + where, ["record_number", *kind.names, *([file] if file else [])])

    table = pa.table({"name": pa.array([p[0] for p in parts], pa.string()), "first": pa.array([p[1] for p in parts], pa.int64()), "n": pa.array([p[2] for p in parts], pa.int64())})
    typed = spark.createDataFrame(table).repartition(max(1, len(parts)), "name", "first")
    return typed.mapInArrow(kernel, shape)


def _arrow(values: np.ndarray) -> pa.Array:
    plain = values.astype(values.dtype.newbyteorder("="))
    kind = {"u1": np.int32, "i1": np.int32, "u2": np.int32, "i2": np.int32, "u4": np.int64}.get(values.dtype.str[1:])
    plain = plain.astype(kind) if kind else plain
    if plain.ndim == 1:
        return pa.array(plain)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(plain) + 1, dtype=np.int32) * plain.shape[1]), pa.array(plain.ravel()))


def write_structs(df: DataFrame, folder: str, record: list[tuple]) -> DataFrame:
    """df's columns of the record's names as files of fixed records, one for each batch; returns (path, n)."""
    kind = np.dtype(record)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, name = file_system(folder)
        files.create_dir(name, recursive=True)
        for batch in batches:
            raw = np.zeros(batch.num_rows, kind)
            for i, (c, *rest) in enumerate(record):
                column = batch.column(i)
                raw[c] = np.array(column.to_pylist()) if len(rest) > 1 and batch.num_rows else column.to_numpy(zero_copy_only=False)
            path = f"{name}/{uuid.uuid4().hex}.bin"
            with files.open_output_stream(path) as out:
                out.write(raw.tobytes())
            yield pa.RecordBatch.from_pydict({"path": [path], "n": [batch.num_rows]})

    return df.select(*[c for c, *_ in record]).mapInArrow(kernel, "path string, n long")


#: Columns of the third version of the store, a row for each pulse with places of its points, and what they are here.
SPD3_PULSES = {"PULSE_ID": "long", "GPS_TIME": "long", "X_ORIGIN": "double", "Y_ORIGIN": "double", "H_ORIGIN": "float", "X_IDX": "double", "Y_IDX": "double", "AZIMUTH": "double", "ZENITH": "double", "NUMBER_OF_RETURNS": "smallint", "SCANLINE": "long", "SCANLINE_IDX": "int"}
SPD3_POINTS = {"RETURN_ID": "smallint", "GPS_TIME": "double", "X": "double", "Y": "double", "Z": "float", "HEIGHT": "float", "RANGE": "float", "AMPLITUDE_RETURN": "float", "WIDTH_RETURN": "float", "RED": "int", "GREEN": "int", "BLUE": "int", "CLASSIFICATION": "smallint"}


def third_version(pulses: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pulses(PULSE_ID, PTS_START_IDX, NUMBER_OF_RETURNS, ...) and points(record_number, ...) as tables of this model.

    A point belongs to the pulse that begins at or before its record and takes it in. Each pulse tells its records' numbers, and
    a join finds them; angles, in radians there, become degrees; known columns get their declared type.
    """
    cast = lambda df, kinds: df.withColumns({c: F.col(c).cast(k) for c, k in kinds.items() if c in df.columns})
    pulses, points = cast(pulses, SPD3_PULSES), cast(points, SPD3_POINTS)
    pulses = pulses.withColumns({c: F.degrees(c) for c in ("AZIMUTH", "ZENITH") if c in pulses.columns})
    taken = pulses.where("NUMBER_OF_RETURNS > 0").select(F.col("PULSE_ID").alias("pulse_id"), F.posexplode(F.sequence(F.col("PTS_START_IDX").cast("long"), F.col("PTS_START_IDX").cast("long") + F.col("NUMBER_OF_RETURNS") - 1)).alias("nth", "record_number"))
    owned = points.join(taken, "record_number").withColumn("return_number", F.col("nth") + 1).drop("nth", "record_number")
    low = lambda df: df.toDF(*[c.lower() for c in df.columns])
    return low(pulses.drop("PTS_START_IDX")), low(owned)


def segments(samples: DataFrame, offset: float = 0.0, gain: float = 1.0) -> DataFrame:
    """Waveform segments, rows (pulse_id, channel, segment, start, samples), as one row per sample with its time and decoded value."""
    flat = samples.select("pulse_id", "channel", "segment", "start", F.posexplode("samples").alias("sample_number", "stored"))
    return flat.select("pulse_id", "channel", "segment", "sample_number", (F.col("start") + F.col("sample_number")).alias("time"), (F.col("stored") * F.lit(gain) + F.lit(offset)).alias("value"))


def sniff(data: bytes) -> str:
    """The format that a file's first bytes tell of."""
    if data[:4] == b"LASF":
        return "las"
    if data[:4] == b"PAR1":
        return "parquet"
    if data[:2] == b"\x1f\x8b" or all(32 <= b < 127 or b in (9, 10, 13) for b in data[:256]):
        return "text"
    raise DriverNotFound("no reader understands this file")
