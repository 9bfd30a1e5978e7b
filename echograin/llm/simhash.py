"""SimHash near-duplicates by multi-index hashing.

A document's fingerprint holds, bit by bit, the majority among the hashes of its word
shingles. Fingerprints are cut into segments. Two fingerprints that differ in at most R
bits differ, in some segment i, in at most r_i bits, if the r_i + 1 add up to R + 1.
So each fingerprint looks up the small Hamming ball around each of its
segments in a table of segments, and the matches' complete distance is verified.

Equal fingerprints are folded into one before anything is paired, so copies cost
nothing here. A segment value that very many different fingerprints share is not paired within
itself: those fingerprints look up every neighbour in reach by its complete
fingerprint, which is exact and linear in their number.

Nulls and odd cases: a null text counts as empty; a text without words has fingerprint
zero, linked like any other; a null identifier never names a component, unless all its
identifiers are null; repeated rows each give a row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, quoted, start_bare, store, text_bytes
from .components import components

SEED = 42
#: Different fingerprints in one segment value beyond which they are looked up by complete fingerprint.
CROWD = 1024
#: Shingles whose bits are counted at once.
_BLOCK = 1 << 16


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of every shingle of `size` words, repeats included, A-Z in lower case.

    With fewer words, the whole sequence is the one shingle; without words there is none.
    """
    words = text.lower().split()  # of bytes: only ASCII letters and ASCII white space
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if n <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[size - 1 :].tolist())), np.uint64, n - size + 1)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes, as a signed long."""
    if len(hashes) == 0:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        block = np.ascontiguousarray(hashes[at : at + _BLOCK])
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def _fingerprint_kernel(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_bare()
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            raw = memoryview(data)
            at = offsets.tolist()
            marks = [majority(shingle_hashes(bytes(raw[s:e]), size)) for s, e in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64())], ["doc_id", "mark"])
            give_back()

    return kernel


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, mark) for each row of docs."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(_fingerprint_kernel(words), "doc_id long, mark long")


def segments(radius: int) -> list[tuple[int, int, int]]:
    """(lowest bit, width, radius within it): as few segments as give balls of one bit at most."""
    count = (radius + 2) // 2
    ones = radius + 1 - count
    cuts = [64 * i // count for i in range(count + 1)]
    return [(cuts[i], cuts[i + 1] - cuts[i], 1 if i < ones else 0) for i in range(count)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _reach(low: int, width: int, inner: int, radius: int) -> list[int]:
    """Masks of 1 to radius bits of which at most `inner` lie within the segment."""
    return [_signed(sum(1 << b for b in bits)) for k in range(1, radius + 1) for bits in combinations(range(64), k) if sum(low <= b < low + width for b in bits) <= inner]


def near_pairs(marks: DataFrame, radius: int, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b) of different fingerprints of marks(mark) at most `radius` bits apart.

    marks holds each fingerprint once. A pair may come twice, and either way round.
    """
    pieces = segments(radius)

    def value(low: int, width: int):
        return F.shiftrightunsigned("mark", low).bitwiseAND(F.lit(_signed((1 << width) - 1)))

    table = marks.select("mark", F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), value(low, width).alias("part")) for i, (low, width, _) in enumerate(pieces)])).alias("s")).select(
        "s.seg", "s.part", "mark"
    )
    # Beyond two bits, a complete fingerprint has too many neighbours to look up: there, a crowded segment value
    # is compared pair by pair, over as many tasks as the skew join makes of it.
    some = False
    if radius <= 2:
        crowded = store(table.groupBy("seg", "part").count().where(F.col("count") > crowd).select("seg", "part"), "crowded")
        some = crowded.limit(1).count() > 0
    calm = table.join(crowded, ["seg", "part"], "left_anti") if some else table
    probes = []
    for i, (low, width, inner) in enumerate(pieces):
        here = value(low, width)
        ball = F.array(here)
        if inner:
            # A pair that differs in one bit of the segment is found by the side on which it is 0.
            flips = F.filter(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)), lambda m: here.bitwiseAND(m) == 0)
            ball = F.concat(ball, F.transform(flips, lambda m: here.bitwiseOR(m)))
        probes.append(marks.select(F.lit(i).alias("seg"), F.explode(ball).alias("part"), F.col("mark").alias("a"), here.alias("own")))
    probe = probes[0]
    for more in probes[1:]:
        probe = probe.unionByName(more)
    found = probe.join(calm.withColumnRenamed("mark", "b"), ["seg", "part"])
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    found = found.where((apart <= radius) & (apart > 0) & ((F.col("own") != F.col("part")) | (F.col("a") < F.col("b")))).select("a", "b")
    if some:
        for i, (low, width, inner) in enumerate(pieces):
            dense = table.where(F.col("seg") == i).join(crowded, ["seg", "part"], "left_semi")
            looked = dense.select(F.col("mark").alias("a"), F.explode(F.lit(_reach(low, width, inner, radius))).alias("m"))
            looked = looked.select("a", F.col("a").bitwiseXOR(F.col("m")).alias("b"))
            found = found.unionByName(looked.join(marks.select(F.col("mark").alias("b")), "b").select("a", "b"))
    return found


def near_duplicate_components(docs: DataFrame, words: int = 5, radius: int = 2, crowd: int = CROWD) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that can be reached over links, a link being two
    fingerprints that differ in at most `radius` bits.
    """
    prints = store(fingerprints(docs, words), "fingerprints")
    marks = store(prints.groupBy("mark").agg(F.min("doc_id").alias("least")), "marks")
    roots = components(near_pairs(marks.select("mark"), radius, crowd))
    placed = marks.join(roots.withColumnRenamed("node", "mark"), "mark", "left").select("mark", F.coalesce("root", "mark").alias("root"), "least")
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.select("mark", "root").join(names, "root").select("mark", "component_id")
    return prints.join(named, "mark").select("doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")


# Near-duplicates by similarity ------------------------------------------------------
#
# Documents whose fingerprints are near, found by multi-index hashing as above, are compared first, and verified links make groups. Of
# equal fingerprints each is compared with one, and of near ones those two, so that this never takes more comparisons than there are
# documents and pairs of fingerprints.
#
# Fingerprints of similar sets may lie further apart, so all other pairs are found by the shingles themselves.
# Two sets of shingles of Jaccard similarity s share most of their elements, so that in any one order of all shingles their beginnings
# share some: that of a set of n is its first n - ceil(s n) + 1. Documents that share none are never compared, and none that are similar
# enough escape, unless they are in one group already. The order only decides how many are compared: shingles that a sample finds in many documents come last.

#: The least Jaccard similarity, as a fraction.
SIMILARITY = (4, 5)
#: One document in SAMPLE is looked at for common shingles: those of at least OFTEN documents of it, COMMON of them at most.
SAMPLE, OFTEN, COMMON = 16, 3, 100_000


def _hashes(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    """The shingle hashes of each text, repeats included."""
    data, offsets = text_bytes(batch.column(1))
    raw, at = memoryview(data), offsets.tolist()
    return (shingle_hashes(bytes(raw[s:e]), size) for s, e in zip(at, at[1:]))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays]), pa.int64()))


def _set_kernel(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_bare()
        for batch in batches:
            sets = list(map(np.unique, _hashes(batch, size)))
            nodes = [xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.uint64).view(np.int64)), _lists([s.view(np.int64) for s in sets])], ["node", "shingles"])
            give_back()

    return kernel


def _beginning_kernel(size: int, common: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each document's set, as its hash, its fingerprint, its size and its beginning. common: hashes, the rarest first."""
    by_hash = np.argsort(common)
    high, low = SIMILARITY[1], SIMILARITY[0]

    def key(hashes: np.ndarray) -> np.ndarray:
        """Where a shingle stands in the order of all."""
        keys = (hashes >> np.uint64(2)).astype(np.int64)
        if len(common):
            at = by_hash[np.minimum(np.searchsorted(common, hashes, sorter=by_hash), len(common) - 1)]
            keys = np.where(common[at] == hashes, (1 << 62) + at, keys)
        return np.sort(keys)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_bare()
        for batch in batches:
            nodes, marks, sizes, begins = [], [], [], []
            for hashes in _hashes(batch, size):
                s = np.unique(hashes)
                nodes.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                marks.append(majority(hashes))
                sizes.append(len(s))
                begins.append(key(s)[: len(s) + 1 + (-low * len(s) // high)] if len(s) else np.zeros(0, np.int64))
            columns = [batch.column(0), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(marks, pa.int64()), pa.array(sizes, pa.int64()), _lists(begins)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "mark", "n", "begin"])
            give_back()

    return kernel


def _common(rows: DataFrame, words: int) -> np.ndarray:
    """Hashes of shingles that many documents hold, the rarest first: a bounded number, of a sample."""
    some = rows.where(F.abs(F.xxhash64("doc_id")) % SAMPLE == 0)
    counts = some.mapInArrow(_set_kernel(words), "node long, shingles array<long>").select(F.explode("shingles").alias("s")).groupBy("s").count()
    most = counts.where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "s").limit(COMMON).select("s").toArrow()
    return most.column("s").to_numpy()[::-1].astype(np.int64).view(np.uint64)


def _similar(shared, n, m):
    """Do sets of n and m elements that share so many reach the similarity? Over integers."""
    low, high = SIMILARITY
    return (low + high) * shared >= low * (n + m)


def _near_marks(prints: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of nodes of prints(node, mark, n) to compare, by their fingerprints: one of each fingerprint with
    the others of it, and with that of each fingerprint at most `radius` bits away."""
    held = prints.where("n > 0").select("mark", "node").distinct()
    marks = store(held.groupBy("mark").agg(F.min("node").alias("head")), "marks")
    a, b = (marks.select(F.col("mark").alias(k), F.col("head").alias(f"head_{k}")) for k in "ab")
    across = near_pairs(marks.select("mark"), radius).join(a, "a").join(b, "b").select("head_a", "head_b")
    both = held.join(marks, "mark").select(F.col("head").alias("head_a"), F.col("node").alias("head_b")).unionByName(across)
    return both.where("head_a <> head_b").select(F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b")).distinct()


def _candidates(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes(node, n, begin) whose beginnings don't rule out that they are similar, but those of one group of roots(node, root)."""
    low, high = SIMILARITY
    keys = nodes.select("node", F.posexplode("begin").alias("pos", "key"))
    # Most shingles are of one document: they go before anything is joined.
    many = keys.withColumn("docs", F.count("*").over(Window.partitionBy("key"))).where("docs > 1").select("node", "pos", "key")
    sizes = nodes.select("node", "n", F.element_at("begin", -1).alias("last"), F.size("begin").alias("p")).where("n > 0")
    sizes = sizes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keys = store(many.join(sizes, "node"), "shingles")
    x, y = (keys.select("key", *(F.col(c).alias(f"{c}_{k}") for c in ("node", "root", "n", "p", "pos", "last"))) for k in "ab")
    met = x.join(y, "key").where((F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & (high * F.least("n_a", "n_b") >= low * F.greatest("n_a", "n_b")))
    found = met.groupBy("node_a", "node_b").agg(F.count("*").alias("shared"), *(F.first(f"{c}_{k}").alias(f"{c}_{k}") for k in "ab" for c in ("n", "p", "last")), *(F.max(f"pos_{k}").alias(f"pos_{k}") for k in "ab"))
    # All that is shared up to the end of the beginning that ends first has been counted; what else is shared comes later in both.
    rest_a = F.col("n_a") - F.when(F.col("last_a") <= F.col("last_b"), F.col("p_a")).otherwise(F.col("pos_a") + 1)
    rest_b = F.col("n_b") - F.when(F.col("last_b") <= F.col("last_a"), F.col("p_b")).otherwise(F.col("pos_b") + 1)
    return found.where(_similar(F.col("shared") + F.least(rest_a, rest_b), F.col("n_a"), F.col("n_b"))).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def _verified(pairs: DataFrame, rows: DataFrame, prints: DataFrame, words: int) -> DataFrame:
    """Those of pairs(a, b) of nodes whose sets are similar."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    owners = prints.join(asked, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    owners = store(owners.select("doc_id").distinct(), "owners")
    texts = rows.join(owners, "doc_id", "left_semi")
    sets = store(texts.mapInArrow(_set_kernel(words), "node long, shingles array<long>").dropDuplicates(["node"]), "sets")
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("t")), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")), "a")
    return both.where(_similar(F.size(F.array_intersect("s", "t")), F.size("s"), F.size("t"))).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 5, radius: int = 2) -> DataFrame:
    """(doc_id, component_id) of every document that isn't the smallest of its group of near-duplicates.

    Two documents are linked if the Jaccard similarity of their sets of shingles is SIMILARITY at least, and links make groups. Documents
    whose fingerprints differ in at most `radius` bits are looked at first; all other pairs that can be similar follow, so that the
    result doesn't depend on the radius. Each pair is verified by its sets. Equal sets are folded into one before anything is paired. Rows
    without identifier are passed over; rows that repeat an identifier share one fate.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = store(rows.mapInArrow(_beginning_kernel(words, _common(rows, words)), "doc_id long, node long, mark long, n long, begin array<long>"), "beginnings")
    roots = components(_verified(store(_near_marks(prints, radius), "near-marks"), rows, prints, words))
    nodes = prints.groupBy("node").agg(F.first("n").alias("n"), F.first("begin").alias("begin"))
    rest = _verified(store(_candidates(nodes, roots), "candidates"), rows, prints, words)
    near = rest.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    # A document is linked to the smallest of its set, and those of similar sets to each other.
    least = store(prints.groupBy("node").agg(F.min("doc_id").alias("least")), "least")
    same = prints.join(least, "node").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    near = near.join(least.select(F.col("node").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("node").alias("b"), F.col("least").alias("y")), "b")
    return components(same.unionByName(near.select(F.col("x").alias("a"), F.col("y").alias("b")))).select(F.col("node").alias("doc_id"), F.col("root").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """docs with one document of each group of near-duplicates, that of the smallest identifier."""
    gone = store(near_duplicates(docs, words).select("doc_id").distinct(), "near-duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(*map(quoted, docs.columns))
