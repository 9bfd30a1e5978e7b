"""Removal of repeated passages: 50 bytes that an earlier document holds too.

Which strings can repeat is found by anchors. Every string of L bytes holds an anchor, the k-gram of least
hash among its L - k + 1; an equal string elsewhere holds the same one at the same place. So only the
surroundings (contexts) of anchors that come more than once need comparing, and all equal
strings meet in one bucket, that of their anchor.

There, contexts that are equal throughout are folded into one. Those that share an anchor but differ are
joined up, and their Burrows-Wheeler transform is built. On it, intervals of suffixes
are extended backwards by one character at a time, breadth first, from those of the last prefix length below L that the
sort passes through: an interval of strings of length l + 1 whose right end has no value yet puts the common prefix there at l.
Values so come in increasing order, and the search stops at L: ends without value are common prefixes of L or more.

Texts don't move. They are written once, bucketed by chunk (some megabytes of consecutive rows);
hashes go from chunks to buckets, one bit for each comes back; contexts of repeated anchors
go to buckets, one mask for each comes back.

An anchor with more different contexts than one transform takes is settled window by window, by sorting
hashes and comparing bytes, which gives the same.

Nulls and odd cases: a null text counts as empty; a null identifier ranks above all others, so it removes nothing; rows
that repeat an identifier are one document to each other, from which nothing is removed; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, new_path, store, text_bytes

#: Bytes of a chunk, about, and symbols of one transform.
CHUNK, TRANSFORM = 2 << 20, 1 << 17
#: Bytes of the table, as stored, whose anchors one bucket takes, about; there are as many buckets as shuffle partitions at least.
BUCKET_BYTES = 256 << 20
#: Bits of a hash that are compared within a bucket.
_BITS = 34
_BLOCK = 1 << 15
_BASE = 0x9E3779B97F4A7C15 | 1
_LAST = (1 << 63) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Anchors:
    """Where the anchors of texts are, for strings of `length` bytes."""

    def __init__(self, length: int) -> None:
        self.length = length
        self.gram = length // 2 + 1
        self.window = length - self.gram + 1
        self.reach = self.window - 1  # bytes of a context before its anchor
        self.context = self.reach + length
        n = _BLOCK + 4 * length
        self.power, self.inverse = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)

    def _slide(self, x: np.ndarray, best: np.ufunc) -> np.ndarray:
        """The best of each `window` neighbours."""
        have, y = 1, x
        while 2 * have <= self.window:
            y = best(y[: len(y) - have], y[have:])
            have *= 2
        more = self.window - have
        return best(y[: len(y) - more], y[more:]) if more else y

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all anchors and their hashes."""
        # A window is whole if it ends in the text that it begins in.
        places, hashes = [], []
        for begin in range(0, len(data), _BLOCK):
            a, b = max(0, begin - self.length), min(len(data), begin + _BLOCK + self.length)
            if b - a < self.length:
                continue
            part = data[a:b].astype(np.uint64)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * self.power[: b - a], dtype=np.uint64)])
            n = b - a - self.gram + 1
            h = _mix((sums[self.gram :] - sums[:n]) * self.inverse[:n]) | np.uint64(1)
            least = self._slide(h, np.minimum)  # of the window at each place
            texts = slice(np.searchsorted(offsets, a, side="right") - 1, np.searchsorted(offsets, b) + 1)
            bounds = np.clip(offsets[texts], a, b)
            stop = np.repeat(bounds[1:], np.diff(bounds))[: len(least)]
            least[np.arange(a, a + len(least)) + self.length > stop] = 0
            padded = np.concatenate([np.zeros(self.reach, np.uint64), least, np.zeros(self.reach, np.uint64)])
            anchor = self._slide(padded, np.maximum) == h
            found = np.flatnonzero(anchor)
            found = found[(found + a >= begin) & (found + a < begin + _BLOCK)]
            places.append(found + a)
            hashes.append(h[found])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(places), np.concatenate(hashes)

    def hash_at(self, contexts: np.ndarray) -> np.ndarray:
        """The hash of the anchor that each context is around."""
        own = contexts[:, self.reach : self.reach + self.gram].astype(np.uint64)
        return _mix((own * self.power[: self.gram]).sum(1, dtype=np.uint64)) | np.uint64(1)


def row_hash(rows: np.ndarray) -> np.ndarray:
    """A hash of each row of bytes."""
    power = _powers(0xC2B2AE3D27D4EB4F, rows.shape[1])
    out = np.zeros(len(rows), np.uint64)
    for at in range(0, len(rows), 1 << 14):
        out[at : at + (1 << 14)] = ((rows[at : at + (1 << 14)].astype(np.uint64) + np.uint64(1)) * power).sum(1, dtype=np.uint64)
    return _mix(out)


def equal_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal rows are neighbours, and where there a new one begins.

    Hashes bring them together; bytes are compared. Within equal rows the order is that of the input.
    """
    marks = row_hash(rows)
    order = np.argsort(marks, kind="stable")
    begins = np.ones(len(rows), bool)
    if len(rows) > 1:
        begins[1:] = (rows[order[1:]] != rows[order[:-1]]).any(1)
        clash = ~(marks[order[1:]] != marks[order[:-1]]) & begins[1:]
        if clash.any():  # different rows of one hash: sorted by their bytes
            order = np.lexsort((*rows.T[::-1], marks))
            begins[1:] = (rows[order[1:]] != rows[order[:-1]]).any(1)
    return order, begins


class Chunk:
    """A chunk's texts, anchors and, once it is known which of these repeat, contexts."""

    def __init__(self, anchors: Anchors, data: np.ndarray, offsets: np.ndarray, docs: np.ndarray, buckets: int) -> None:
        self.a, self.data, self.offsets, self.docs = anchors, data, offsets, docs
        self.places, hashes = anchors.find(data, offsets)
        # Anchors are chosen for their low hashes; only after another mix do they spread evenly over buckets.
        hashes = _mix(hashes * np.uint64(_BASE))
        self.low = 64 - _BITS - (buckets.bit_length() - 1)
        self.keys, self.key_of, self.counts = np.unique(hashes >> np.uint64(self.low), return_inverse=True, return_counts=True)
        self.cuts = np.searchsorted(self.keys, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(_BITS))

    def fold(self, repeated: np.ndarray) -> None:
        """Contexts of repeated anchors, equal ones folded: rows of bytes, by bucket.

        A row ends with the first and last place of the context that lie in its text.
        """
        mine = repeated[self.key_of]
        self.at = self.places[mine]
        bucket = np.searchsorted(self.cuts, self.key_of[mine], side="right") - 1
        text = np.searchsorted(self.offsets, self.at, side="right") - 1
        first = self.at - self.a.reach
        lo = np.maximum(self.offsets[text] - first, 0)
        hi = np.minimum(self.offsets[text + 1] - first, self.a.context)
        step = np.arange(self.a.context)
        rows = np.zeros((len(self.at), self.a.context + 2), np.uint8)
        for at in range(0, len(self.at), 1 << 14):
            some = slice(at, at + (1 << 14))
            inside = (step >= lo[some, None]) & (step < hi[some, None])
            spots = np.clip(first[some, None] + step, 0, max(0, len(self.data) - 1))
            rows[some, :-2] = np.where(inside, self.data[spots], 0)
        rows[:, -2], rows[:, -1] = lo, hi
        order, begins = equal_rows(rows)
        group = np.cumsum(begins) - 1
        docs = self.docs[text]
        least = np.minimum.reduceat(docs[order], np.flatnonzero(begins)) if len(order) else docs
        kept = order[begins]
        by_bucket = np.argsort(bucket[kept], kind="stable")
        rank = np.empty(len(kept), np.int64)
        rank[by_bucket] = np.arange(len(kept))
        self.context_of = np.empty(len(order), np.int64)
        self.context_of[order] = rank[group]
        self.rows, self.least = rows[kept[by_bucket]], least[by_bucket]
        self.ends = np.searchsorted(bucket[kept[by_bucket]], np.arange(len(self.cuts)))
        # Documents after the least one of a folded context lose all of it.
        self.later = docs > self.least[self.context_of]
        self.span = np.stack([lo, hi - self.a.length])  # places at which windows of the context begin

    def removed(self, masks: np.ndarray) -> np.ndarray:
        """Of each byte: is it removed? masks: of each context, the windows that an earlier document holds."""
        begins = np.zeros(len(self.data) + 1, np.int32)
        whole = self._window_bits(self.span[0], self.span[1])
        bits = np.where(self.later, whole, masks[self.context_of])
        for o in range(self.a.window):
            begins[self.at[(bits >> np.uint64(o)) & np.uint64(1) == 1] - self.a.reach + o] = 1
        total = np.cumsum(begins[:-1], dtype=np.int32)
        total[self.a.length :] -= total[: -self.a.length].copy() if len(total) > self.a.length else 0
        return total > 0

    @staticmethod
    def _window_bits(lo: np.ndarray, last: np.ndarray) -> np.ndarray:
        one = np.uint64(1)
        return (one << (last + 1).astype(np.uint64)) - (one << lo.astype(np.uint64))


def transform_prefixes(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rotations in order of their first `length` symbols (0 to 256) or more, and where a common prefix is shorter.

    The second array tells of each rotation whether it shares fewer than `length` symbols with the one before it.
    Symbols past the end are those from the beginning; texts that are joined up with separators don't notice.
    """
    n = len(symbols)
    round_ = np.resize(symbols.astype(np.int64), n + 7)
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = key << 9 | round_[j : j + n]
    have, seed, seeds = 7, 0, np.zeros(n, np.int64)
    while True:
        order = np.argsort(key)
        new = np.ones(n, bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if have >= length:
            break
        seed, seeds = have, rank
        key = rank * (n + 1) + np.roll(rank, -have)
        have *= 2
    first = symbols[order]
    bwt = symbols[order - 1]
    forward = np.empty(n, np.int64)
    forward[np.argsort(bwt, kind="stable")] = np.arange(n)
    # The sort has told apart prefixes of `seed` symbols; their intervals are where the extension sets out.
    seeds = seeds[order]
    set_at = np.ones(n + 1, bool)
    set_at[1:n] = seeds[1:] != seeds[:-1]
    lo = np.flatnonzero(set_at[:-1])
    hi = np.append(lo[1:], n)
    owner = np.zeros(n, np.int64)
    hit = np.zeros(n, bool)
    for _ in range(seed, length):
        sizes = hi - lo
        ends = np.cumsum(sizes)
        inner = np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - (ends - sizes), sizes)
        to = forward[inner]
        owner[to] = np.repeat(np.arange(len(lo)), sizes)
        hit[to] = True
        rows = np.flatnonzero(hit) if 8 * len(to) > n else np.sort(to)
        hit[to] = False
        if len(rows) == 0:
            break
        begin = np.ones(len(rows), bool)
        begin[1:] = (rows[1:] != rows[:-1] + 1) | (owner[rows[1:]] != owner[rows[:-1]]) | (first[rows[1:]] != first[rows[:-1]])
        at = np.flatnonzero(begin)
        lo, hi = rows[at], rows[np.append(at[1:], len(rows)) - 1] + 1
        fresh = ~set_at[hi]
        set_at[hi[fresh]] = True
        lo, hi = lo[fresh], hi[fresh]
    return order, set_at[:-1]


def compare(rows: np.ndarray, docs: np.ndarray, a: Anchors) -> np.ndarray:
    """For each of different contexts, the windows (a bit each) that a document before its own holds too."""
    masks = np.zeros(len(rows), np.uint64)
    anchor = a.hash_at(rows[:, :-2])
    order = np.argsort(anchor, kind="stable")
    # An anchor with one context repeats nothing but that context. A window of L bytes around an anchor holds
    # the anchor and half the context's reach on one side: a context that shares neither half shares no window.
    middle = a.reach // 2
    halves = np.zeros(len(rows), bool)
    for s, e in ((middle, a.reach + a.gram), (a.reach, middle + a.length)):
        _, place, many = np.unique(row_hash(rows[:, s:e]), return_inverse=True, return_counts=True)
        halves |= many[place] > 1
    order = order[halves[order]]
    cuts = np.flatnonzero(np.append(True, anchor[order][1:] != anchor[order][:-1])) if len(order) else order
    sizes = np.diff(np.append(cuts, len(order)))
    shared = np.repeat(sizes > 1, sizes)
    group = np.repeat(np.arange(len(sizes)), sizes)[shared]
    order = order[shared]
    limit = max(1, TRANSFORM // (a.context + 1))
    at = 0
    while at < len(order):
        stop = min(len(order), at + limit)
        if stop < len(order):
            stop = int(np.searchsorted(group, group[stop], side="left"))
        if stop <= at:  # one anchor alone is more
            stop = int(np.searchsorted(group, group[at], side="right"))
            masks[order[at:stop]] = _compare_windows(rows[order[at:stop]], docs[order[at:stop]], a)
        else:
            masks[order[at:stop]] = _compare_by_transform(rows[order[at:stop]], docs[order[at:stop]], a)
        at = stop
    return masks


def _compare_by_transform(rows: np.ndarray, docs: np.ndarray, a: Anchors) -> np.ndarray:
    n, width = len(rows), a.context
    lo, hi = rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64)
    step = np.arange(width + 1)
    inside = (step >= lo[:, None]) & (step < hi[:, None])
    grid = np.zeros((n, width + 1), np.int16)
    grid[:, :width] = rows[:, :-2].astype(np.int16) + 1
    grid[~inside] = 0
    used = inside | (step == hi[:, None])  # a zero ends each context
    owner, place = np.nonzero(used)
    order, begins = transform_prefixes(grid[used], a.length)
    who, where = owner[order], place[order]
    whole = where + a.length <= hi[who]
    own = np.where(whole, docs[who], _LAST)
    least = np.minimum.reduceat(own, np.flatnonzero(begins))[np.cumsum(begins) - 1]
    lost = whole & (least < docs[who])
    masks = np.zeros(n, np.uint64)
    np.bitwise_or.at(masks, who[lost], np.uint64(1) << where[lost].astype(np.uint64))
    return masks


def _compare_windows(rows: np.ndarray, docs: np.ndarray, a: Anchors) -> np.ndarray:
    lo, hi = rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64)
    masks = np.zeros(len(rows), np.uint64)
    for o in range(a.window):
        fit = np.flatnonzero((lo <= o) & (o + a.length <= hi))
        if len(fit) < 2:
            continue
        order, begins = equal_rows(rows[fit, o : o + a.length])
        at = fit[order]
        least = np.minimum.reduceat(docs[at], np.flatnonzero(begins))[np.cumsum(begins) - 1]
        masks[at[least < docs[at]]] |= np.uint64(1 << o)
    return masks


# Tasks --------------------------------------------------------------------------


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of doc_id and text get the number of their chunk, and theirs in it."""
    chunk, held, rows = uuid.uuid4().int >> 65, 0, 0
    for batch in batches:
        sizes = np.diff(text_bytes(batch.column(1))[1])
        chunks, places = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int32)
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > CHUNK:
                chunk, held, rows = uuid.uuid4().int >> 65, 0, 0
            chunks[i], places[i] = chunk, rows
            held, rows = held + size + 64, rows + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunks), pa.array(places)], ["doc_id", "text", "chunk", "row"])


def _chunk(a: Anchors, texts: pa.Table, buckets: int) -> tuple[Chunk, pa.Array]:
    give_back()
    texts = texts.sort_by("row")
    ids = texts["doc_id"].combine_chunks()
    data, offsets = text_bytes(texts["text"])
    return Chunk(a, data, offsets, ids.fill_null(_LAST).to_numpy(zero_copy_only=False), buckets), ids


def _hash_task(length: int, buckets: int) -> Callable[[pa.Table], pa.Table]:
    a = Anchors(length)

    def task(texts: pa.Table) -> pa.Table:
        c, _ = _chunk(a, texts, buckets)
        own = [slice(s, e) for s, e in zip(c.cuts, c.cuts[1:])]
        keys = [np.diff(c.keys[s] & np.uint64((1 << _BITS) - 1), prepend=np.uint64(0)) for s in own]
        # Differences of sorted keys nearly always fit in four bytes.
        blobs = [k.astype("<u4").tobytes() if len(k) == 0 or k.max() < 1 << 32 else b"8" + k.astype("<u8").tobytes() for k in keys]
        twice = [np.packbits(c.counts[s] > 1).tobytes() for s in own]
        some = [b for b in range(buckets) if blobs[b]]
        return pa.table(
            {
                "bucket": pa.array(some, pa.int32()),
                "chunk": pa.array([texts["chunk"][0].as_py()] * len(some), pa.int64()),
                "keys": pa.array([blobs[b] for b in some], pa.binary()),
                "twice": pa.array([twice[b] for b in some], pa.binary()),
            }
        )

    return task


def _unpack_keys(blob: bytes) -> np.ndarray:
    deltas = np.frombuffer(blob[1:], "<u8") if len(blob) % 4 else np.frombuffer(blob, "<u4")
    return np.cumsum(deltas, dtype=np.uint64)


def _repeat_task(hashes: pa.Table) -> pa.Table:
    """Which keys of a bucket come twice or more: a bit each, back to the chunks."""
    keys = [_unpack_keys(b) for b in hashes["keys"].to_pylist()]
    twice = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(k)) for b, k in zip(hashes["twice"].to_pylist(), keys)]
    every = np.sort(np.concatenate([*keys, *(k[t > 0] for k, t in zip(keys, twice))]))
    again = np.unique(every[1:][every[1:] == every[:-1]])
    bits = []
    for k in keys:
        at = np.minimum(np.searchsorted(again, k), max(0, len(again) - 1))
        bits.append(np.packbits(again[at] == k).tobytes() if len(again) else bytes(-(-len(k) // 8)))
    return pa.table({"chunk": hashes["chunk"], "bucket": hashes["bucket"], "kind": pa.array([0] * len(keys), pa.int32()), "blob": pa.array(bits, pa.binary())})


def _folded(a: Anchors, texts: pa.Table, replies: pa.Table, buckets: int) -> tuple[Chunk, pa.Array]:
    c, ids = _chunk(a, texts, buckets)
    repeated = np.zeros(len(c.keys), bool)
    for kind, bucket, blob in zip(replies["kind"].to_pylist(), replies["bucket"].to_pylist(), replies["blob"].to_pylist()):
        if kind == 0:
            s, e = c.cuts[bucket], c.cuts[bucket + 1]
            repeated[s:e] = np.unpackbits(np.frombuffer(blob, np.uint8), count=e - s)
    c.fold(repeated)
    return c, ids


def _context_task(length: int, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    a = Anchors(length)

    def task(texts: pa.Table, replies: pa.Table) -> pa.Table:
        out: dict[str, list] = {"bucket": [], "chunk": [], "rows": [], "docs": []}
        if texts.num_rows:
            c, _ = _folded(a, texts, replies, buckets)
            for b in range(buckets):
                s, e = c.ends[b], c.ends[b + 1]
                if s < e:
                    out["bucket"].append(b)
                    out["chunk"].append(texts["chunk"][0].as_py())
                    out["rows"].append(pa.compress(np.ascontiguousarray(c.rows[s:e]), "zstd", asbytes=True))
                    out["docs"].append(c.least[s:e].astype("<i8").tobytes())
        return pa.table(out, pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("rows", pa.binary()), ("docs", pa.binary())]))

    return task


def _compare_task(length: int) -> Callable[[pa.Table], pa.Table]:
    a = Anchors(length)

    def task(contexts: pa.Table) -> pa.Table:
        give_back()
        docs = [np.frombuffer(b, "<i8") for b in contexts["docs"].to_pylist()]
        sizes = [len(d) for d in docs]
        width = a.context + 2
        rows = np.concatenate([np.frombuffer(pa.decompress(b, n * width, "zstd", asbytes=True), np.uint8).reshape(n, width) for b, n in zip(contexts["rows"].to_pylist(), sizes)])
        docs = np.concatenate(docs)
        order, begins = equal_rows(rows)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(begins) - 1
        kept = order[begins]
        least = np.minimum.reduceat(docs[order], np.flatnonzero(begins))
        rows = rows[kept]
        whole = Chunk._window_bits(rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64) - length)
        masks = np.where(docs > least[group], whole[group], compare(rows, least, a)[group])
        parts = np.split(masks, np.cumsum(sizes)[:-1])
        blobs = [pa.compress(np.ascontiguousarray(p, "<u8"), "zstd", asbytes=True) for p in parts]
        return pa.table({"chunk": contexts["chunk"], "bucket": contexts["bucket"], "kind": pa.array([1] * len(blobs), pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return task


def _remove_task(length: int, buckets: int, with_text: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    a = Anchors(length)
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + [("kept", pa.binary())] * with_text)

    def task(texts: pa.Table, replies: pa.Table) -> pa.Table:
        if texts.num_rows == 0:
            return schema.empty_table()
        c, ids = _folded(a, texts, replies, buckets)
        masks = np.zeros(len(c.rows), np.uint64)
        for kind, bucket, blob in zip(replies["kind"].to_pylist(), replies["bucket"].to_pylist(), replies["blob"].to_pylist()):
            if kind == 1:
                s, e = c.ends[bucket], c.ends[bucket + 1]
                masks[s:e] = np.frombuffer(pa.decompress(blob, 8 * (e - s), "zstd", asbytes=True), "<u8")
        gone = c.removed(masks)
        sizes = np.diff(c.offsets)
        lost = np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(gone)])[c.offsets])
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        starts = c.offsets[:-1][sizes > 0]
        first[starts] = gone[starts]
        spans = np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(first)])[c.offsets])
        kept = [c.data[s:e][~gone[s:e]].tobytes() if n else c.data[s:e].tobytes() for s, e, n in zip(c.offsets.tolist(), c.offsets[1:].tolist(), lost.tolist())]
        columns = [ids, pa.array(sizes), pa.array(lost), pa.array(spans), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
        return pa.Table.from_arrays(columns + [pa.array(kept, pa.binary())] * with_text, schema=schema)

    return task


def _stored_bytes(df: DataFrame) -> int:
    """The size of the tables that df reads, as far as it is known."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 62)


def remove_repeats(docs: DataFrame, length: int = 50, with_text: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left).

    A byte is removed if a string of `length` bytes (8 to 64) covers it that also begins in a document with a smaller doc_id.
    """
    if not 8 <= length <= 64:
        raise ValueError("length is 8 to 64")
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-_stored_bytes(docs) // BUCKET_BYTES), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))))
    buckets = 1 << max(0, (parts - 1).bit_length())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    numbered = rows.mapInArrow(_number, "doc_id long, text string, chunk long, row int")
    name = f"echograin_{uuid.uuid4().hex}"
    try:
        numbered.write.bucketBy(parts, "chunk").option("path", new_path(spark, "chunks")).option("compression", "zstd").saveAsTable(name)
        texts = spark.table(name)
        by_chunk = texts.groupBy("chunk")
        # One bucket a task: neither fewer, larger tasks nor uneven ones.
        hashes = by_chunk.applyInArrow(_hash_task(length, buckets), "bucket int, chunk long, keys binary, twice binary")
        replies = store(hashes.repartitionById(buckets, F.col("bucket")).groupBy("bucket").applyInArrow(_repeat_task, "chunk long, bucket int, kind int, blob binary"), "repeats")
        contexts = by_chunk.cogroup(replies.groupBy("chunk")).applyInArrow(_context_task(length, buckets), "bucket int, chunk long, rows binary, docs binary")
        masks = store(contexts.repartitionById(buckets, F.col("bucket")).groupBy("bucket").applyInArrow(_compare_task(length), "chunk long, bucket int, kind int, blob binary"), "masks")
        shape = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
        removed = by_chunk.cogroup(replies.unionByName(masks).groupBy("chunk")).applyInArrow(_remove_task(length, buckets, with_text), shape)
        return removed
    finally:
        # The files stay where they are; only the catalogue's entry goes.
        spark.sql(f"DROP TABLE IF EXISTS {name}")
