"""Points in polygons: crossing parity of each ring, rings joined by or."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Ring = list[tuple[float, float]]


#: Bytes of an edge table up to which it is broadcast; beyond, it is joined by slab without a hint.
BROADCAST = 8 << 20
#: Entries of the edge table for each edge, about: edges that are high lie in many slabs.
ENTRIES = 4


def slabs(rings: list[Ring]) -> tuple[float, float, int]:
    """(lowest y, height, number) of the horizontal slabs that edges are filed under."""
    ys = [p[1] for ring in rings for p in ring]
    low, span = min(ys), max(ys) - min(ys)
    spans = sum(abs(y2 - y1) for _, _, y1, _, y2 in edges(rings))
    many = sum(map(len, rings))
    number = max(1, min(many, int((ENTRIES - 1) * many * span / spans) if spans else 1))
    return low, (span / number) or 1.0, number


def inside_rings(points: DataFrame, rings: list[Ring], x: str = "x", y: str = "y", flag: str = "inside") -> DataFrame:
    """points with a flag: in any of the rings, by the parity of edges that a ray to the east crosses; holes are rings of their own.

    Edges are filed under horizontal slabs, a row for each slab with its edges ring by ring. A point meets the edges of its own slab
    alone, in one join that neither multiplies nor regroups points. A point with a null coordinate is outside.
    """
    rings = [r for r in rings if len(r) > 2]
    if not rings:
        return points.withColumn(flag, F.lit(False))
    low, height, number = slabs(rings)
    filed: dict[int, dict[int, list[dict]]] = {}
    n = 0
    for ring, x1, y1, x2, y2 in edges(rings):
        if y1 != y2:
            edge = {"x1": x1, "y1": y1, "y2": y2, "slope": (x2 - x1) / (y2 - y1)}
            for slab in range(math.floor((min(y1, y2) - low) / height), math.floor((max(y1, y2) - low) / height) + 1):
                filed.setdefault(slab, {}).setdefault(ring, []).append(edge)
                n += 1
    kind = pa.struct([(c, pa.float64()) for c in ("x1", "y1", "y2", "slope")])
    table = pa.table({"__slab": pa.array(list(filed), pa.int64()), "__rings": pa.array([list(r.values()) for r in filed.values()], pa.list_(pa.list_(kind)))})
    edge_table = points.sparkSession.createDataFrame(table)
    if 32 * n <= BROADCAST:
        edge_table = F.broadcast(edge_table)
    px, py = F.col(x), F.col(y)

    def crossed(odd: Column, e: Column) -> Column:
        spans = (e["y1"] > py) != (e["y2"] > py)
        return odd != (spans & (px < e["x1"] + (py - e["y1"]) * e["slope"]))

    hit = F.exists("__rings", lambda ring: F.aggregate(ring, F.lit(False), crossed))
    found = points.withColumn("__slab", F.floor((py - low) / height)).join(edge_table, "__slab", "left")
    return found.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("__slab", "__rings")


def rings_of_wkb(data: bytes) -> list[Ring]:
    """The rings of a well-known-binary geometry: polygons, multi-polygons and collections, with or without z; the rest has none."""

    def read(at: int) -> tuple[list[Ring], int]:
        order = "<" if data[at] else ">"
        (kind,) = struct.unpack_from(order + "I", data, at + 1)
        wide = 3 if kind & 0x80000000 or 1000 <= kind % 0x10000 < 2000 else 2
        kind, at = kind % 1000 if kind < 0x80000000 else kind & 0xFF, at + 5

        def path(at: int) -> tuple[Ring, int]:
            (n,) = struct.unpack_from(order + "I", data, at)
            flat = struct.unpack_from(f"{order}{n * wide}d", data, at + 4)
            return list(zip(flat[::wide], flat[1::wide])), at + 4 + 8 * n * wide

        if kind == 1:
            return [], at + 8 * wide
        if kind == 2:
            return [], path(at)[1]
        (n,) = struct.unpack_from(order + "I", data, at)
        at, rings = at + 4, []
        for _ in range(n):
            if kind == 3:
                ring, at = path(at)
                rings.append(ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring)
            else:
                more, at = read(at)
                rings += more
        return rings, at

    return read(0)[0]


def edges(rings: list[Ring]) -> Iterator[tuple[int, float, float, float, float]]:
    for k, ring in enumerate(rings):
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            yield k, x1, y1, x2, y2
