"""Files of token ids with keyed access through a minimal perfect hash.

A shard holds, in ascending doc_id order:

    raw ids | identifiers | first id of each document | seeds | slots | fingerprints | directory | its length | magic

Ids are little-endian, 2 bytes wide if the vocabulary allows. The hash sends each of the n different
identifiers to a slot of its own among n: an identifier's bucket has a seed, seed and identifier give the
slot, the slot holds the document's place and 32 bits of fingerprint, by which an identifier that the shard
doesn't hold is told apart. A look-up is thus three reads, however many documents there are.

Nulls and odd cases: a null or empty text has the end id alone; rows with a null identifier come first
and have no key; rows that repeat an identifier lie side by side, and the key leads to the first of them;
an empty table gives no shards, or empty ones.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, new_path, open_files, store
from .tokens import Encoder, by_size

MAGIC = b"EGTOKID1"
_TAIL = struct.Struct("<Q8s")
#: Identifiers per bucket on average, and seeds tried at once.
_BUCKET, _TRIES = 4, 128
#: Bytes of ids that a reader holds at once, about.
_READ = 8 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BUCKET_SALT, _PRINT_SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _slot(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    return (_mix(keys + seeds.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(n)).astype(np.int64)


def build_hash(keys: np.ndarray) -> np.ndarray:
    """Seeds of a minimal perfect hash of different keys (uint64).

    A seed below zero is the slot itself, -1 - slot, of a bucket's only key.
    """
    n = len(keys)
    seeds = np.zeros(max(1, n // _BUCKET), np.int64)
    if n == 0:
        return seeds
    bucket = (_mix(keys ^ _BUCKET_SALT) % np.uint64(len(seeds))).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=len(seeds))
    ends = np.cumsum(sizes)
    taken = np.zeros(n, bool)
    by_size_order = np.argsort(-sizes, kind="stable")
    for b in by_size_order[: np.count_nonzero(sizes > 1)].tolist():
        own = keys[order[ends[b] - sizes[b] : ends[b]]]
        first = 1
        while True:
            tries = np.arange(first, first + _TRIES)
            slots = np.sort(_slot(own[None, :], tries[:, None], n), axis=1)
            good = ~taken[slots].any(1) & (slots[:, 1:] != slots[:, :-1]).all(1)
            if good.any():
                hit = int(good.argmax())
                seeds[b] = tries[hit]
                taken[slots[hit]] = True
                break
            first += _TRIES
    single = np.flatnonzero(sizes == 1)
    seeds[single] = -1 - np.flatnonzero(~taken)
    return seeds


def hash_slots(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """The slot of each key."""
    seed = seeds[(_mix(keys ^ _BUCKET_SALT) % np.uint64(len(seeds))).astype(np.int64)]
    return np.where(seed < 0, -1 - seed, _slot(keys, np.maximum(seed, 0), n))


def key_prints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys ^ _PRINT_SALT) >> np.uint64(32)).astype("<u4")


class ShardWriter:
    def __init__(self, path: str, width: np.dtype) -> None:
        files, name = open_files(path)
        files.create_dir(name.rsplit("/", 1)[0], recursive=True)
        self.out, self.width = files.open_output_stream(name), width
        self.keys: list[np.ndarray] = []
        self.void = 0  # rows without identifier
        self.lengths: list[np.ndarray] = []
        self.at = 0

    def add(self, keys: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> None:
        self.void += keys.null_count
        self.keys.append(keys.fill_null(0).to_numpy(zero_copy_only=False))
        self.lengths.append(np.diff(offsets))
        self._write(ids.astype(self.width))

    def _write(self, values: np.ndarray) -> list:
        raw = np.ascontiguousarray(values)
        self.out.write(raw.tobytes())
        place = [self.at, len(raw), raw.dtype.str]
        self.at += raw.nbytes
        return place

    def close(self) -> tuple[int, int]:
        keys = np.concatenate(self.keys or [np.zeros(0, np.int64)])
        lengths = np.concatenate(self.lengths or [np.zeros(0, np.int64)])
        firsts = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        named = np.arange(self.void, len(keys))
        own = named[np.append(True, keys[named][1:] != keys[named][:-1])] if len(named) else named
        hashed = keys[own].astype(np.uint64)
        seeds = build_hash(hashed)
        slots = np.zeros(len(own), np.int64)
        prints = np.zeros(len(own), "<u4")
        at = hash_slots(hashed, seeds, len(own)) if len(own) else own
        slots[at], prints[at] = own, key_prints(hashed)
        parts = {"ids": [0, int(firsts[-1]), self.width.str], "void": self.void}
        for name, values in (("keys", keys.astype("<i8")), ("firsts", firsts.astype("<i8")), ("seeds", seeds.astype("<i8")), ("slots", slots.astype("<u4")), ("prints", prints)):
            parts[name] = self._write(values)
        directory = json.dumps(parts).encode()
        self.out.write(directory + _TAIL.pack(len(directory), MAGIC))
        self.out.close()
        return len(keys), int(firsts[-1])


class Shard:
    """A shard's file, read as needed."""

    def __init__(self, path: str) -> None:
        files, name = open_files(path)
        self.file = files.open_input_file(name)
        size = self.file.size()
        length, magic = _TAIL.unpack(self.file.read_at(_TAIL.size, size - _TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard of token ids")
        self.parts = json.loads(self.file.read_at(length, size - _TAIL.size - length))
        self.n = self.parts["slots"][1]

    def part(self, name: str, begin: int = 0, end: int | None = None) -> np.ndarray:
        at, count, kind = self.parts[name]
        width = np.dtype(kind)
        end = count if end is None else end
        return np.frombuffer(self.file.read_at((end - begin) * width.itemsize, at + begin * width.itemsize), width)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Each key's first row here, or -1; the index is read once, for many keys."""
        if self.n == 0:
            return np.full(len(keys), -1)
        hashed = keys.astype(np.uint64)
        slots = hash_slots(hashed, self.part("seeds"), self.n)
        rows = self.part("slots")[slots].astype(np.int64)
        known = (self.part("prints")[slots] == key_prints(hashed)) & (self.part("keys")[rows] == keys)
        return np.where(known, rows, -1)

    def get(self, key: int) -> np.ndarray | None:
        """The ids of one document, by a constant number of small reads."""
        if self.n == 0:
            return None
        hashed = np.array([key], np.int64).astype(np.uint64)
        b = int(_mix(hashed ^ _BUCKET_SALT)[0] % np.uint64(self.parts["seeds"][1]))
        slot = int(hash_slots_one(hashed, int(self.part("seeds", b, b + 1)[0]), self.n))
        if self.part("prints", slot, slot + 1)[0] != key_prints(hashed)[0]:
            return None
        row = int(self.part("slots", slot, slot + 1)[0])
        if self.part("keys", row, row + 1)[0] != key:
            return None
        begin, end = self.part("firsts", row, row + 2).tolist()
        return self.part("ids", begin, end)

    def close(self) -> None:
        self.file.close()


def hash_slots_one(key: np.ndarray, seed: int, n: int) -> int:
    return -1 - seed if seed < 0 else int(_slot(key, np.array([seed]), n)[0])


def _write_kernel(folder: str, tokenizer: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        part = TaskContext.get().partitionId()
        # A name of its own for each attempt: only the manifest says which attempt counts.
        path = f"{folder}/{part:06d}-{uuid.uuid4().hex}.ids"
        writer = ShardWriter(path, encoder.width)
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            for some in by_size(texts):
                ids, offsets = encoder.encode_ended(texts[some], end_id)
                writer.add(batch.column(0).slice(some.start, some.stop - some.start), ids, offsets)
            give_back()
        docs, tokens = writer.close()
        yield pa.RecordBatch.from_pydict({"shard": [part], "path": [path], "n_docs": [docs], "n_tokens": [tokens]})

    return kernel


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Encodes docs(doc_id, text) into shards under folder; returns the manifest.

    The manifest has a row per shard: shard, path, n_docs, n_tokens, and base, the ids in all shards before it.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    # The text's beginning spreads rows without identifier, or that share one, over shards.
    ordered = rows.repartitionByRange("doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    written = store(ordered.mapInArrow(_write_kernel(folder, tokenizer, end_id), "shard long, path string, n_docs long, n_tokens long"), "manifest")
    # One row a shard, so that one task can add them up.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _read_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard(row["path"])
            keys, firsts, void = shard.part("keys"), shard.part("firsts"), shard.parts["void"]
            # Through the index: each key's first row, then those that repeat it.
            named = keys[void:]
            repeats = np.arange(len(named)) - np.searchsorted(named, named)
            rows = np.concatenate([np.arange(void), shard.places(named) + repeats])
            begins, ends = firsts[rows], firsts[rows + 1]
            at = 0
            while at < len(rows):
                stop = max(at + 1, int(np.searchsorted(ends, begins[at] + _READ // 2, side="right")))
                ids = shard.part("ids", int(begins[at]), int(ends[stop - 1])).astype("<u4")
                raw, zero = memoryview(ids).cast("B"), int(begins[at])
                sums = [zlib.crc32(raw[4 * (b - zero) : 4 * (e - zero)]) for b, e in zip(begins[at:stop].tolist(), ends[at:stop].tolist())]
                named_here = pa.array(keys[at:stop], pa.int64(), mask=np.arange(at, stop) < void)
                yield pa.RecordBatch.from_arrays(
                    [named_here, pa.array(begins[at:stop] + row["base"]), pa.array(ends[at:stop] - begins[at:stop]), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )
                at = stop
            shard.close()


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document, read from the shards: doc_id, start, n_tokens, ids_crc32."""
    shards = max(1, manifest.count())
    return manifest.repartition(shards, "shard").mapInArrow(_read_kernel, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digest(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes docs to files in the shared folder and returns what reading them back gives."""
    folder = new_path(docs.sparkSession, "token-ids")
    return read_token_files(write_token_files(docs, folder, tokenizer, end_id))
