"""Relations between pulses, points and ordered records."""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..model import PulseIndexUnsupported

#: Identifiers to a block, where a running total or a run crosses the whole table.
BLOCK = 1 << 16
#: Records that a pulse announces at most.
MOST = 256


def points_by_pulse(pulses: DataFrame, points: DataFrame, fields: list[str]) -> DataFrame:
    """pulses with an array of their points, in order of return; empty where there is none."""
    nested = points.groupBy("pulse_id").agg(F.sort_array(F.collect_list(F.struct("return_number", *fields))).alias("points"))
    return pulses.join(nested, "pulse_id", "left").withColumn("points", F.coalesce("points", F.array().cast(nested.schema["points"].dataType)))


def to_points(pulses: DataFrame, points: DataFrame, fields: list[str]) -> DataFrame:
    """points with fields of their pulse."""
    return points.join(pulses.select("pulse_id", *fields), "pulse_id")


def returns_per_pulse(pulses: DataFrame, points: DataFrame) -> DataFrame:
    """pulse_id and n, those without a return too. Points are counted before they meet the pulses."""
    n = points.groupBy("pulse_id").agg(F.count("*").alias("n"))
    return pulses.select("pulse_id").join(n, "pulse_id", "left").select("pulse_id", F.coalesce("n", F.lit(0)).alias("n"))


def pulse_index(points: DataFrame, method: str = "first") -> DataFrame:
    """pulse_id, x_idx, y_idx: where the first or last return is."""
    if method not in ("first", "last"):
        raise PulseIndexUnsupported(f"no pulse index by {method} return")
    pick = F.min_by if method == "first" else F.max_by
    return points.groupBy("pulse_id").agg(pick(F.struct("x", "y"), "return_number").alias("p")).select("pulse_id", F.col("p.x").alias("x_idx"), F.col("p.y").alias("y_idx"))


#: Kinds of spatial index, and the columns that a pulse's place in them is made of.
INDEXES = {"cartesian": ("x_idx", "y_idx"), "spherical": ("azimuth", "zenith"), "cylindrical": ("azimuth", "z"), "scan": ("scanline_idx", "scanline")}


def index_place(pulses: DataFrame, points: DataFrame, kind: str = "cartesian", method: str = "first") -> DataFrame:
    """pulses with x_idx and y_idx, their place in a spatial index: the first or last return, the angles, the azimuth and the height of that return, or
    the place in the scan. A pulse without return has no place in the two kinds that ask for one."""
    if kind not in INDEXES:
        raise PulseIndexUnsupported(f"no spatial index {kind}; there are {', '.join(INDEXES)}")
    out = pulses.drop("x_idx", "y_idx")
    if kind == "cartesian":
        return out.join(pulse_index(points, method), "pulse_id", "left")
    if kind == "cylindrical":
        if method not in ("first", "last"):
            raise PulseIndexUnsupported(f"no pulse index by {method} return")
        pick = F.min_by if method == "first" else F.max_by
        out = out.join(points.groupBy("pulse_id").agg(pick("z", "return_number").alias("__z")), "pulse_id", "left")
        return out.withColumns({"x_idx": F.col("azimuth").cast("double"), "y_idx": F.col("__z").cast("double")}).drop("__z")
    x, y = INDEXES[kind]
    return out.withColumns({"x_idx": F.col(x).cast("double"), "y_idx": F.col(y).cast("double")})


def start_index(counts: DataFrame, key: str = "pulse_id", n: str = "n", block: int = BLOCK) -> DataFrame:
    """counts with start: the sum of n over all smaller keys.

    Blocks of keys are summed first; only the blocks' sums meet in one task.
    """
    b = counts.withColumn("__block", F.floor(F.col(key) / block))
    sums = b.groupBy("__block").agg(F.sum(n).alias("__sum"))
    sums = sums.select("__block", (F.sum("__sum").over(Window.orderBy("__block")) - F.col("__sum")).alias("__base"))
    inner = F.sum(n).over(Window.partitionBy("__block").orderBy(key)) - F.col(n)
    return b.withColumn("__in", inner).join(sums, "__block").withColumn("start", F.col("__in") + F.col("__base")).drop("__block", "__in", "__base")


def runs(df: DataFrame, order: str, key: list[str], block: int = BLOCK, nth: str | None = None) -> DataFrame:
    """df with run: the number, from 0, of the stretch of consecutive rows that are equal in key; if asked for, nth: the row's place in it, from 1.

    Blocks find their own changes; their borders are compared with one row per block.
    """
    # Rows in order compress so well that tasks put together by bytes would hold too many: their number stays as set.
    b = df.withColumn("__block", F.floor(F.col(order) / block)).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__block")
    w = Window.partitionBy("__block").orderBy(order)
    other = reduce(or_, [~F.lag(c).over(w).eqNullSafe(F.col(c)) for c in key])
    inner = b.withColumn("__change", (other & F.lag(F.lit(1)).over(w).isNotNull()).cast("long")).withColumn("__nth", F.sum("__change").over(w))
    if nth is not None:
        row = F.row_number().over(w)
        inner = inner.withColumn("__row", row.cast("long")).withColumn("__begin", F.max(F.when(F.col("__change") == 1, F.col("__row"))).over(w))
    value = F.struct(*key)
    ends = [F.max("__row").alias("__rows"), F.max("__begin").alias("__begun")] if nth is not None else []
    edges = inner.groupBy("__block").agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"), F.sum("__change").alias("__n"), *ends)
    across = Window.orderBy("__block")
    joint = (~F.lag("last").over(across).eqNullSafe(F.col("first")) & F.lag(F.lit(1)).over(across).isNotNull()).cast("long")
    base = edges.withColumn("__joint", joint).withColumn("__base", F.sum("__joint").over(across) + F.sum("__n").over(across) - F.col("__n"))
    dropped = ["__block", "__change", "__nth", "__base"]
    if nth is not None:
        # Rows before the block; where its first run begins, in it or in one before; places are those in the whole table.
        base = base.withColumn("__before", F.sum("__rows").over(across) - F.col("__rows"))
        opens = F.when((F.col("__joint") == 1) | (F.col("__before") == 0), F.col("__before") + 1)
        base = base.withColumn("__opens", opens).withColumn("__latest", F.coalesce(F.col("__before") + F.col("__begun"), F.col("__opens")))
        earlier = F.max("__latest").over(across.rowsBetween(Window.unboundedPreceding, -1))
        base = base.withColumn("__opened", F.coalesce("__opens", earlier)).select("__block", "__base", "__before", "__opened")
        dropped += ["__row", "__begin", "__before", "__opened"]
    else:
        base = base.select("__block", "__base")
    out = inner.join(base, "__block").withColumn("run", F.col("__nth") + F.col("__base"))
    if nth is not None:
        begins = F.coalesce(F.col("__before") + F.col("__begin"), F.col("__opened"))
        out = out.withColumn(nth, F.col("__before") + F.col("__row") - begins + 1)
    return out.drop(*dropped)


def build_pulses(records: DataFrame, order: str, returns: str = "return_number", block: int = BLOCK) -> DataFrame:
    """records with pulse: a new one begins wherever the first return does. Well-formed records only."""
    starts = records.withColumn("__start", (F.col(returns) == 1).cast("long"))
    return start_index(starts, order, "__start", block).withColumn("pulse", F.col("start") + F.col("__start") - 1).drop("start", "__start")


def build_pulses_strictly(records: DataFrame, order: str, returns: str, group: str, block: int = BLOCK) -> DataFrame:
    """As build_pulses for records of any kind, file by file: a pulse takes as many records as its first one announces.

    Adds pulse (from 0, file by file) and nth (from 1). Records come in blocks of `order`. Each block tells, for any number of records that
    it may owe to the pulse before it, how many pulses begin in it and how many records it leaves owing; a file's blocks are
    then put end to end by those answers, a few numbers each, and each block is numbered with what it does owe.
    An announcement of less than 1, or null, counts as 1, of more than MOST as MOST.
    """
    names = {n: f"__{n}" for n in ("block", "owed", "base", "done")}
    blocked = records.withColumn(names["block"], F.floor(F.col(order) / block))
    slim = blocked.select(F.col(group).alias("g"), F.col(names["block"]).alias("b"), F.col(order).alias("o"), F.greatest(F.lit(1), F.least(F.lit(MOST), F.coalesce(F.col(returns).cast("int"), F.lit(1)))).alias("n"))

    def answers(t: pa.Table) -> pa.Table:
        take = t["n"].to_numpy()[np.argsort(t["o"].to_numpy(), kind="stable")]
        size = len(take)
        at = np.arange(size + MOST)  # places beyond the block are what it leaves owing
        to, begun, last = at.copy(), np.zeros(len(at), np.int64), np.full(len(at), -1)
        to[:size] += take
        begun[:size], last[:size] = 1, at[:size]
        for _ in range(size.bit_length()):
            begun = begun + begun[to]
            last = np.where(last[to] >= 0, last[to], last)
            to = to[to]
        owing = np.arange(MOST)
        return pa.table({"g": t["g"][:1], "b": t["b"][:1], "size": [size], "left": [(to[owing] - size).clip(0).tolist()], "begun": [begun[owing].tolist()], "since": [np.where(last[owing] >= 0, size - last[owing], -1).tolist()]})

    kind = records.schema[group].dataType
    shape = StructType([StructField("g", kind), StructField("b", LongType()), StructField("size", LongType()), *(StructField(c, ArrayType(LongType())) for c in ("left", "begun", "since"))])
    told = slim.groupBy("g", "b").applyInArrow(lambda t: answers(t), shape)

    def chain(t: pa.Table) -> pa.Table:
        t = t.sort_by("b")
        owed, base, done, out = 0, 0, 0, []
        for size, left, begun, since in zip(*(t[c].to_pylist() for c in ("size", "left", "begun", "since"))):
            out.append((owed, base, done))
            if owed >= size:
                owed, done = owed - size, done + size
            else:
                done = since[owed] if since[owed] >= 0 else done + size
                owed, base = left[owed], base + begun[owed]
        columns = [pa.array(list(c), pa.int64()) for c in zip(*out)]
        return pa.table([t["g"], t["b"], *columns], ["g", "b", "owed", "base", "done"])

    starts = told.groupBy("g").applyInArrow(lambda t: chain(t), StructType([StructField("g", kind), *(StructField(c, LongType()) for c in ("b", "owed", "base", "done"))]))

    def number(t: pa.Table, known: pa.Table) -> pa.Table:
        if t.num_rows == 0:
            return pa.table([t["g"], t["o"], pa.array([], pa.int64()), pa.array([], pa.int64())], ["g", "o", "pulse", "nth"])
        t = t.sort_by("o")
        size, owed, base, done = t.num_rows, *(known[c][0].as_py() for c in ("owed", "base", "done"))
        jumps = [np.append(np.minimum(np.arange(size) + t["n"].to_numpy(), size), size)]
        while len(jumps) < size.bit_length():
            jumps.append(jumps[-1][jumps[-1]])
        begins = np.zeros(size + 1, bool)
        begins[min(owed, size)] = True
        for jump in reversed(jumps):
            begins[jump[begins]] = True
        begins = begins[:size]
        at = np.arange(size)
        since = np.maximum.accumulate(np.where(begins, at, -1))
        return pa.table([t["g"], t["o"], pa.array(base - 1 + np.cumsum(begins)), pa.array(np.where(since >= 0, at - since + 1, done + at + 1))], ["g", "o", "pulse", "nth"])

    out = StructType([StructField("g", kind), StructField("o", records.schema[order].dataType), StructField("pulse", LongType()), StructField("nth", LongType())])
    numbered = slim.groupBy("g", "b").cogroup(starts.groupBy("g", "b")).applyInArrow(lambda a, b: number(a, b), out)
    same = records[group].eqNullSafe(numbered["g"]) & (records[order] == numbered["o"])
    return records.join(numbered, same).drop("g", "o")


def regroup(records: DataFrame, ident: str = "id", target: str = "target_index") -> DataFrame:
    """records with the pulse they belong to, whatever their order: its first record's identifier."""
    return records.withColumn("pulse", F.col(ident) - F.col(target) + 1)


def in_range(pulses: DataFrame, begin: int, end: int, key: str = "pulse_id") -> DataFrame:
    """Pulses begin to end, the latter not included."""
    return pulses.where((F.col(key) >= begin) & (F.col(key) < end))
