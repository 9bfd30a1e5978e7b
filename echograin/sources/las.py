"""Uncompressed LAS files, record formats 0 to 3 and 6 to 8, as a Python data source, and a writer of format 1."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..model import FormatNotUnderstood
from ..session import file_system

#: Records that one task reads.
RECORDS = 1_000_000
SCHEMA = (
    "record_number long, x double, y double, z double, intensity int, return_number int, number_of_returns int, classification int, "
    "synthetic int, keypoint int, withheld int, scan_angle double, user_data int, point_source_id int, gps_time double, red int, green int, blue int, file string"
)
_HEAD = struct.Struct("<4sHHIHH8sBB32s32sHHHIIBHI5I12d")


def header(data: bytes) -> dict:
    """The public header block."""
    if data[:4] != b"LASF" or len(data) < _HEAD.size:
        raise FormatNotUnderstood("no LAS file")
    h = _HEAD.unpack_from(data)
    out = {"version": (h[7], h[8]), "offset": h[14], "vlrs": h[15], "format": h[16] & 0x3F, "length": h[17], "count": h[18], "scale": h[24:27], "shift": h[27:30], "max": h[30::2], "min": h[31::2]}
    if h[16] & 0x80:
        raise FormatNotUnderstood("compressed records are not supported")
    if out["version"] >= (1, 4) and len(data) >= 255:
        out["count"] = struct.unpack_from("<Q", data, 247)[0] or out["count"]
    return out


def _record(kind: int, length: int) -> np.dtype:
    base = [("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2")]
    if kind in (0, 1, 2, 3):
        base += [("bits", "u1"), ("cls", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2")]
        base += [("time", "<f8")] * (kind in (1, 3)) + [("rgb", "<u2", 3)] * (kind in (2, 3))
    elif kind in (6, 7, 8):
        base += [("bits", "u1"), ("flags", "u1"), ("cls", "u1"), ("user", "u1"), ("angle", "<i2"), ("source", "<u2"), ("time", "<f8")]
        base += [("rgb", "<u2", 3)] * (kind > 6) + [("nir", "<u2")] * (kind == 8)
    else:
        raise FormatNotUnderstood(f"record format {kind}")
    size = np.dtype(base).itemsize
    if length < size:
        raise FormatNotUnderstood("records are too short for their format")
    return np.dtype(base + [("extra", f"V{length - size}")] * (length > size))


def decode(raw: np.ndarray, h: dict, first: int, file: str = "") -> pa.RecordBatch:
    new = h["format"] >= 6
    n = len(raw)
    bits, cls = raw["bits"].astype(np.int32), raw["cls"].astype(np.int32)
    flags = raw["flags"].astype(np.int32) if new else cls >> 5
    nothing = pa.nulls(n, pa.int32())
    rgb = [pa.array(raw["rgb"][:, k].astype(np.int32)) for k in range(3)] if "rgb" in raw.dtype.names else [nothing] * 3
    columns = [
        pa.array(np.arange(first, first + n)),
        *(pa.array(raw[a] * s + o) for a, s, o in zip("xyz", h["scale"], h["shift"])),
        pa.array(raw["intensity"].astype(np.int32)),
        pa.array(bits & (15 if new else 7)),
        pa.array((bits >> 4) if new else (bits >> 3) & 7),
        pa.array(cls if new else cls & 31),
        *(pa.array((flags >> k) & 1) for k in range(3)),
        pa.array(raw["angle"] * (0.006 if new else 1.0)),
        pa.array(raw["user"].astype(np.int32)),
        pa.array(raw["source"].astype(np.int32)),
        pa.array(raw["time"]) if "time" in raw.dtype.names else pa.nulls(n, pa.float64()),
        *rgb,
        pa.array([file] * n, pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SCHEMA.split(", ")])


class _Part(InputPartition):
    def __init__(self, path: str, first: int, count: int) -> None:
        self.path, self.first, self.count = path, first, count


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def partitions(self) -> list[_Part]:
        from pyarrow import fs

        files, name = file_system(self.path)
        info = files.get_file_info(name)
        names = [name] if info.is_file else sorted(f.path for f in files.get_file_info(fs.FileSelector(name)) if f.path.lower().endswith(".las"))
        parts = []
        for n in names:
            with files.open_input_file(n) as f:
                h = header(f.read(375))
            parts += [_Part(n, k, min(RECORDS, h["count"] - k)) for k in range(0, h["count"], RECORDS)]
        return parts

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        files, _ = file_system(self.path)
        with files.open_input_file(part.path) as f:
            h = header(f.read(375))
            kind = _record(h["format"], h["length"])
            step = 1 << 16
            for k in range(part.first, part.first + part.count, step):
                n = min(step, part.first + part.count - k)
                f.seek(h["offset"] + k * h["length"])
                yield decode(np.frombuffer(f.read(n * h["length"]), kind), h, k, part.path)


class LasSource(DataSource):
    """spark.dataSource.register(LasSource); spark.read.format("las").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options)


def read_las(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(LasSource)
    return spark.read.format("las").load(path)


def las_bytes(points: dict[str, np.ndarray], gain: tuple[float, float, float] = (100.0,) * 3, shift: tuple[float, float, float] = (0.0,) * 3) -> bytes:
    """A file of format 1: every return a record. points: x, y, z and, if need be, the other columns of SCHEMA."""
    n = len(points["x"])
    raw = np.zeros(n, _record(1, 28))
    for a, g, o in zip("xyz", gain, shift):
        raw[a] = np.rint((points[a] - o) * g)
    get = lambda c, d=0: np.asarray(points.get(c, np.full(n, d)))
    raw["bits"] = get("return_number", 1) | get("number_of_returns", 1) << 3
    raw["cls"] = get("classification")
    raw["intensity"], raw["time"], raw["source"], raw["user"] = get("intensity"), get("gps_time"), get("point_source_id"), get("user_data")
    box = [v for a in "xyz" for v in ((float(points[a].max()), float(points[a].min())) if n else (0.0, 0.0))]
    counts = np.bincount(get("return_number", 1), minlength=6)[1:6] if n else np.zeros(5, int)
    head = _HEAD.pack(b"LASF", 0, 0, 0, 0, 0, b"", 1, 2, b"", b"echograin", 1, 2020, _HEAD.size, _HEAD.size, 0, 1, 28, n, *counts.tolist(), *(1 / g for g in gain), *shift, *box)
    return head + raw.tobytes()


def write_las(points: DataFrame, folder: str, **scaling) -> DataFrame:
    """points as files of RECORDS records at most; returns (path, n).

    Files are written under names of their own, so that a retried task does no harm: those that the result names count.
    """

    def write(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(tables)
        files, name = file_system(folder)
        files.create_dir(name, recursive=True)
        path = f"{name}/{uuid.uuid4().hex}.las"
        with files.open_output_stream(path) as out:
            out.write(las_bytes({c: t[c].to_numpy() for c in t.column_names}, **scaling))
        return pa.RecordBatch.from_pydict({"path": [path], "n": [t.num_rows]})

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if n and n + batch.num_rows > RECORDS:
                yield write(held)
                held, n = [], 0
            held.append(batch)
            n += batch.num_rows
        if n:
            yield write(held)

    return points.mapInArrow(kernel, "path string, n long")
