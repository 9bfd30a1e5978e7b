"""Best-fit packing by linear grouping.

Lengths are whole numbers up to the capacity, so everything the scheme decides depends
on the count of each length alone, a table that can't outgrow the capacity. Only that
table reaches the driver. There, large lengths are cut, in order, into
groups of equal cardinality and rounded up to each group's largest; the few rounded
sizes give a configuration programme, solved by column generation; each rounded place is
given an actual length of its own group, and the gap after the last, if a small length fills it, that
small one; and what is left is placed by best fit, longest first, into the gaps.
The outcome is a plan over ranks: "of length 310, ranks
9000 to 9999 go to sequences 71000 to 71999 at offset 1500". Pieces get
ranks among those of equal length in a distributed way, and look their place up in the plan.

Nulls and odd cases: a null or empty text has the end id alone; a null identifier packs
like any other; repeated rows are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, store
from .tokens import Encoder, by_length

#: Rounded sizes that the configuration programme works with.
GROUPS = 48
#: Lengths above this share of the capacity are large. A configuration's sequence is opened if its gap is as wide, or closed.
LARGE = 1 / 4
#: Small lengths up to this share are kept for the best fit at the end, which they make exact.
LEAST = 1 / 16
#: Tokens that a gap may have and count as closed.
SLACK = 1
#: Rows of one length that one task ranks, about.
RANKED = 1_000_000
#: Bytes of texts that a worker encodes at once, about: what that takes comes on top of the chunks it keeps.
AT_ONCE = 500_000
#: Different chunks that a worker keeps; two workers of an executor may have little memory beside a heap that earlier stages widened.
KEPT_CHUNKS = 500_000


def configurations(sizes: list[int], counts: list[int], capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, float]]:
    """Fractional optimum of the configuration programme: (places for each size, how often).

    Revised simplex steps; the inverse of the basis is kept up. The most valuable configuration is an unbounded
    knapsack over whole lengths, solved place by place for all lengths and sizes at once.
    """
    k = len(sizes)
    need, size = np.array(counts, float), np.array(sizes)
    basis = np.diag(capacity // size).astype(float)
    inverse = np.linalg.inv(basis)
    room = np.arange(capacity + 1)
    rest = room[:, None] - size
    fits, rest = rest >= 0, np.maximum(rest, 0)
    for r in range(1, rounds + 1):
        worth = inverse.sum(0)
        best, picks = np.zeros(capacity + 1), []
        for _ in range(capacity // int(size.min())):
            options = np.where(fits, best[rest] + worth, -1.0)
            top = options.argmax(1)
            more = options[room, top] > best + 1e-12
            if not more.any():
                break
            picks.append(np.where(more, top, -1))
            best = np.where(more, options[room, top], best)
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        for pick in reversed(picks):
            if pick[c] >= 0:
                column[pick[c]] += 1
                c -= int(size[pick[c]])
        move, level = inverse @ column, inverse @ need
        ratio = np.where(move > 1e-9, level / np.where(move > 1e-9, move, 1.0), np.inf)
        leaves = int(ratio.argmin())
        if not np.isfinite(ratio[leaves]):
            break
        basis[:, leaves] = column
        if r % 50:
            row = inverse[leaves] / move[leaves]
            inverse -= np.outer(move, row)
            inverse[leaves] = row
        else:
            inverse = np.linalg.inv(basis)
    level = np.linalg.inv(basis) @ need
    return [(basis[:, j].astype(int), float(level[j])) for j in range(k) if level[j] > 1e-9]


class _Plan:
    """Rows (length, lo, hi, per, seq, off), and what is left of each length."""

    def __init__(self, left: dict[int, int], capacity: int) -> None:
        self.left, self.capacity = dict(left), capacity
        self.next = dict.fromkeys(left, 0)
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0
        self.gaps: list[int] = []  # in order; each is a key of bins
        self.bins: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, how many)

    def put(self, length: int, many: int, per: int, seq: int, off: int) -> None:
        lo = self.next[length]
        self.rows.append((length, lo, lo + many, per, seq, off))
        self.next[length] = lo + many
        self.left[length] -= many

    def open(self, many: int) -> int:
        self.sequences += many
        return self.sequences - many

    def spare(self, gap: int, seq: int, many: int) -> None:
        if gap and many:
            if gap not in self.bins:
                insort(self.gaps, gap)
                self.bins[gap] = []
            self.bins[gap].append((seq, many))

    def best_fit(self) -> None:
        for length in sorted(self.left, reverse=True):
            while self.left[length]:
                at = bisect_left(self.gaps, length)
                if at == len(self.gaps):
                    per = self.capacity // length
                    many = -(-self.left[length] // per)
                    self.spare(self.capacity, self.open(many), many)
                    continue
                gap = self.gaps[at]
                seq, many = self.bins[gap].pop()
                if not self.bins[gap]:
                    del self.bins[gap], self.gaps[at]
                per = min(gap // length, self.left[length])
                filled = min(many, self.left[length] // per)
                self.put(length, filled * per, per, seq, self.capacity - gap)
                self.spare(gap - per * length, seq, filled)
                self.spare(gap, seq + filled, many - filled)


def plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Places for histogram[length] pieces of each length, and how many sequences they take."""
    p = _Plan({k: n for k, n in histogram.items() if n}, capacity)
    if p.left.get(capacity):
        p.put(capacity, p.left[capacity], 1, p.open(p.left[capacity]), 0)
    large = [(k, p.left[k]) for k in sorted(p.left, reverse=True) if LARGE * capacity < k < capacity and p.left[k]]
    if large:
        _group_and_substitute(p, large, groups)
    p.best_fit()
    return p.rows, p.sequences


def _group_and_substitute(p: _Plan, large: list[tuple[int, int]], groups: int) -> list[tuple[int, int]]:
    """Places large lengths by the configurations of their rounded sizes; returns (rounded, actual) of each place that was filled.

    Each place takes a length of its own group: the longest there is, but for the last place the longest with which the sequence is
    closed, by a small length if need be, or stays wide open. Where there is none, the lengths chosen so far stay for best fit.
    """
    share = -(-sum(n for _, n in large) // groups)
    members: list[list[int]] = []  # per group: its lengths, longest first
    counts: list[int] = []
    for length, n in large:
        if not counts or counts[-1] >= share:
            members.append([])
            counts.append(0)
        members[-1].append(length)
        counts[-1] += n
    wide, least = int(LARGE * p.capacity), int(LEAST * p.capacity)
    free, filled = dict(large), []

    def filler(gap: int) -> int | None:
        """The small length for a gap, 0 if it needs none; None if nothing closes it."""
        if gap <= SLACK or gap >= wide:
            return 0
        return next((k for k in range(gap, max(least, gap - SLACK - 1), -1) if p.left.get(k)), None)

    for places, often in sorted(configurations([m[0] for m in members], counts, p.capacity), key=lambda x: -x[1]):
        many = int(often + 1e-6)
        slots = [g for g, n in enumerate(places) for _ in range(n)]
        while many:
            chosen: list[int] = []
            for g in slots[:-1]:
                chosen += [k for k in members[g] if free[k] > chosen.count(k)][:1]
            if len(chosen) < len(slots) - 1:
                break
            room = p.capacity - sum(chosen)
            last = next(((k, f) for k in members[slots[-1]] if free[k] > chosen.count(k) and (f := filler(room - k)) is not None), None)
            if last is None and not chosen:
                break
            taken = Counter([*chosen, last[0]] if last else chosen)
            step = min([many, *(free[k] // n for k, n in taken.items())])
            if last:
                if last[1]:
                    step = min(step, p.left[last[1]])
                seq, off = p.open(step), 0
                for k, n in [*taken.items(), *([(last[1], 1)] if last[1] else [])]:
                    p.put(k, n * step, n, seq, off)
                    off += n * k
                p.spare(p.capacity - off, seq, step)
                filled += [(members[g][0], k) for g, k in zip(slots, [*chosen, last[0]])]
            for k, n in taken.items():
                free[k] -= n * step
            many -= step
    return filled


def _piece_kernel(tokenizer: str, capacity: int, end_id: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer, KEPT_CHUNKS)
        for batch in batches:
            for some in by_length(pc.binary_length(batch.column(1)).fill_null(0).to_pylist(), AT_ONCE):
                texts = batch.column(1).slice(some.start, some.stop - some.start).fill_null("").to_pylist()
                ids, offsets = encoder.encode_ended(texts, end_id)
                pieces = -(-np.diff(offsets) // capacity)
                doc = np.repeat(np.arange(len(pieces)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                begin = offsets[doc] + start
                end = np.minimum(begin + capacity, offsets[doc + 1])
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                sums = [zlib.crc32(raw[4 * b : 4 * e]) for b, e in zip(begin.tolist(), end.tolist())]
                columns = [batch.column(0).slice(some.start, len(pieces)).take(pa.array(doc)), pa.array(piece), pa.array(start), pa.array(end - begin), pa.array(sums, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, end[-1:]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
                give_back()

    return kernel


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, groups: int = GROUPS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    docs has doc_id and text. A text's ids, and end_id after them, are one piece; longer ones
    are cut into pieces of `capacity`, the last of which may be shorter.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    shape = "doc_id long, piece long, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    pieces = store(rows.mapInArrow(_piece_kernel(tokenizer, capacity, end_id, with_ids), shape), "pieces")
    # At most `capacity` rows, whatever the input.
    counts = pieces.groupBy("length").agg(F.count("*").alias("n"), F.ceil(F.count("*") / RANKED).alias("shares"))
    histogram = {r["length"]: r["n"] for r in counts.collect()}
    places, _ = plan(histogram, capacity, groups)
    spark = docs.sparkSession
    table = spark.createDataFrame(places, "length long, lo long, hi long, per long, seq long, off long")
    shares = spark.createDataFrame([(k, -(-n // RANKED)) for k, n in histogram.items()], "length long, shares long")
    salted = pieces.join(F.broadcast(shares), "length").withColumn("share", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "shares")).drop("shares")
    before = Window.partitionBy("length").orderBy("share")
    first = salted.groupBy("length", "share").count().select("length", "share", (F.sum("count").over(before) - F.col("count")).alias("first"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(first, ["length", "share"]).withColumn("rank", F.col("rank") + F.col("first"))
    # The plan has a few rows for each length at most; see the module's text.
    placed = ranked.alias("r").join(F.broadcast(table.alias("t")), (F.col("r.length") == F.col("t.length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    kept = [F.col(f"r.{c}") for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
    where = [(F.col("seq") + F.floor(nth / F.col("per"))).alias("sequence_id"), (F.col("off") + nth % F.col("per") * F.col("r.length")).alias("offset")]
    return placed.select(*kept, *where, *[F.col("r.ids")] * with_ids)
