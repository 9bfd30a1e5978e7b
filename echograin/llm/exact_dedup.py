"""Exact deduplication by content sort.

Sampled splitters over (first characters, content hash, identifier) range-partition
the texts, an external sort places equal texts next to one another, and
neighbouring texts are compared in full. The identifier is part of the splitters, so a
text that a third of all rows share is spread over many tasks. A run of equal texts
that touches the first or last row of a partition may go on in the next one; there are
at most two such runs a partition, and they are brought together by their whole text.

Nulls and odd cases: a null text counts as empty; a null identifier ranks below every
other one when the largest is kept, and above it when the smallest is kept; of rows that repeat both text
and identifier exactly one stays; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import quoted, start_bare, store

#: Characters of a text that enter the splitters. The content hash follows them, so
#: texts with a common beginning are still spread.
SPLITTER_CHARS = 16


def content_sorted(rows: DataFrame, text: str, ident: str, keep: str) -> DataFrame:
    """rows, range-partitioned and sorted so that equal texts are neighbours."""
    by_id = F.col(ident).asc_nulls_first() if keep == "largest" else F.col(ident).asc_nulls_last()
    keyed = rows.withColumns({"__head": F.substring(text, 1, SPLITTER_CHARS), "__hash": F.xxhash64(text)})
    return (
        keyed.repartitionByRange("__head", "__hash", by_id)
        .sortWithinPartitions("__head", "__hash", text, by_id)
        .drop("__head", "__hash")
    )


def _runs(texts: pa.Array, before: pa.Scalar | None) -> np.ndarray:
    """For each text: does a run begin here? Compared in full with the text before it."""
    begins = np.ones(len(texts), bool)
    if len(texts) > 1:
        begins[1:] = ~pc.equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
    if before is not None:
        begins[0] = texts[0] != before
    return begins


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


_GROUPS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("keep_id", pa.int64()),
        ("group_size", pa.int64()),
        ("kept", pa.bool_()),
        ("sha", pa.binary()),
        ("frag", pa.int64()),
        ("frag_text", pa.string()),
    ]
)


def _group_kernel(keep: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    last = keep == "largest"

    def emit(ids: pa.Array, starts: np.ndarray, texts: list[pa.Scalar], frag: int | None) -> pa.RecordBatch:
        n = len(ids)
        sizes = np.diff(np.append(starts, n))
        winner = starts + sizes - 1 if last else starts
        kept = np.zeros(n, bool)
        kept[winner] = True
        sha = pa.array([hashlib.sha256(t.as_buffer()).digest() for t in texts], pa.binary())
        run = pa.array(np.repeat(np.arange(len(starts)), sizes))
        frags = pa.nulls(n, pa.int64()) if frag is None else pa.array(np.full(n, frag))
        once = pa.nulls(n, pa.string())
        if frag is not None:
            once = pa.concat_arrays([pa.array([texts[0].as_py()], pa.string()), pa.nulls(n - 1, pa.string())])
        columns = [ids, ids.take(pa.array(winner)).take(run), pa.array(np.repeat(sizes, sizes)), pa.array(kept), sha.take(run), frags, once]
        return pa.RecordBatch.from_arrays(columns, schema=_GROUPS)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_bare()
        part = TaskContext.get().partitionId()
        held: list[pa.Array] = []  # identifiers of the run that is still open
        text: pa.Scalar | None = None
        edges = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids, texts = _column(batch, "doc_id"), _column(batch, "__text")
            starts = np.flatnonzero(_runs(texts, text))
            if text is None:
                text = texts[0]
            elif len(starts) == 0:
                held.append(ids)
                continue
            elif starts[0] > 0 or held:
                held.append(ids[: starts[0]])
                whole = pa.concat_arrays(held)
                yield emit(whole, np.zeros(1, np.int64), [text], part << 1 if edges == 0 else None)
                edges += 1
            if len(starts) > 1:
                first, end = starts[0], starts[-1]
                if edges == 0:
                    yield emit(ids[first : starts[1]], np.zeros(1, np.int64), [texts[int(first)]], part << 1)
                    edges, first, rest = 1, starts[1], starts[1:-1]
                else:
                    rest = starts[:-1]
                if len(rest):
                    yield emit(ids[first:end], rest - first, [texts[int(i)] for i in rest], None)
            held, text = [ids[starts[-1] :]], texts[int(starts[-1])]
        if held:
            yield emit(pa.concat_arrays(held), np.zeros(1, np.int64), [text], part << 1 | 1)

    return kernel


def _last_choice(ident: Column, keep: str) -> Column:
    """An ordering key that puts a null identifier behind all others, for the least or the greatest to be taken."""
    return ident.isNotNull() if keep == "largest" else ident.isNull()


def duplicate_groups(docs: DataFrame, keep: str = "smallest", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    keep: which identifier of equal texts stays, "smallest" or "largest".
    normalise: an expression applied to the text before it is compared.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (normalise(text) if normalise else text).alias("__text"))
    found = content_sorted(rows, "__text", "doc_id", keep).mapInArrow(
        _group_kernel(keep),
        "doc_id long, keep_id long, group_size long, kept boolean, sha binary, frag long, frag_text string",
    )
    found = store(found, "content-sort")
    inner = found.where("frag is null").select("doc_id", "keep_id", "group_size", "kept", "sha")
    best = (F.max if keep == "largest" else F.min)(
        F.struct(_last_choice(F.col("keep_id"), keep).alias("void"), "keep_id", "frag")
    )
    # As many rows as there are runs at partition borders: two a partition at most.
    border = (
        found.where("frag_text is not null")
        .groupBy("frag_text")
        .agg(F.sum("group_size").alias("n"), best.alias("best"), F.collect_list("frag").alias("frags"))
        .select(F.explode("frags").alias("frag"), "n", "best")
    )
    outer = found.where("frag is not null").join(border, "frag")
    outer = outer.select(
        "doc_id",
        F.col("best.keep_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("kept") & (F.col("frag") == F.col("best.frag"))).alias("kept"),
        "sha",
    )
    return inner.unionByName(outer).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def _keep_kernel(keep: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    last = keep == "largest"

    def edged(batch: pa.RecordBatch, edge: bool) -> pa.RecordBatch:
        return batch.append_column("__edge", pa.array(np.full(batch.num_rows, edge)))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_bare()
        held: pa.RecordBatch | None = None  # the row that stays of the run that is still open
        first = True
        for batch in batches:
            if batch.num_rows == 0:
                continue
            texts = _column(batch, "__text")
            starts = np.flatnonzero(_runs(texts, None if held is None else _column(held, "__text")[0]))
            ends = np.append(starts[1:], batch.num_rows) - 1 if len(starts) else starts
            if held is not None and (len(starts) == 0 or starts[0] > 0) and last:
                held = batch.slice((starts[0] if len(starts) else batch.num_rows) - 1, 1)
            if len(starts) == 0:
                continue
            if held is not None:
                yield edged(held, first)
                first = False
            rows = ends if last else starts
            if len(rows) > 1:
                done = rows[:-1]
                if first:
                    yield edged(batch.slice(int(done[0]), 1), True)
                    first, done = False, done[1:]
                if len(done):
                    yield edged(batch.take(pa.array(done)), False)
            held = batch.slice(int(rows[-1]), 1)
        if held is not None:
            yield edged(held, True)

    return kernel


def drop_duplicates(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """docs with one row of each group of equal texts, all columns as they were.

    The rows travel through the content sort once; runs at partition borders, two a
    partition at most, are settled afterwards.
    """
    columns = docs.columns
    rows = docs.select(
        F.struct(*[docs[quoted(c)].alias(c) for c in columns]).alias("__row"),
        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("__text"),
        docs["doc_id"].cast("long").alias("__id"),
    )
    # The text is in __row too; it is taken out there and put back at the end.
    slim = rows.withColumns({"__void": F.col("__row.text").isNull(), "__row": F.col("__row").dropFields("text")})
    shape = StructType([*slim.schema, StructField("__edge", BooleanType())])
    found = store(content_sorted(slim, "__text", "__id", keep).mapInArrow(_keep_kernel(keep), shape), "content-kept")
    whole = F.struct(*[F.col(c) for c in slim.columns])
    order = F.struct(_last_choice(F.col("__id"), keep), F.col("__id"))
    pick = (F.max_by if keep == "largest" else F.min_by)(whole, order)
    outer = found.where("__edge").groupBy("__text").agg(pick.alias("__one")).select("__one.*")
    text = F.when(~F.col("__void"), F.col("__text"))
    kept = found.where("not __edge").select(*slim.columns).unionByName(outer)
    return kept.select(*[text.cast(docs.schema[c].dataType).alias(c) if c == "text" else F.col("__row").getField(c).alias(c) for c in columns])
