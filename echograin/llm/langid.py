"""Language identification by rank-order profiles.

A profile lists the most frequent letter n-grams of a language, most frequent first. A
text's own most frequent n-grams are compared with each profile by
how far each is out of place; an n-gram that a profile lacks counts as far as can be. The nearest
profile names the language.

Profiles are learnt from at most about TRAIN_DOCS documents of each language, taken by a hash of the
identifier, so that the sample is the same whenever it is drawn. Prediction looks at the whole text and at nothing else.

Nulls and odd cases: a text that is null or has no letter is "und" with score 0; so is everything if there
is nothing to learn from; a null identifier isn't held out; equal distances go to the language that is first by name;
repeated rows each give a row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import give_back, map_rows, start_bare

#: Documents of each language that profiles are learnt from, about.
TRAIN_DOCS = 2000
#: Length of a profile, and of a text's list.
TOP = 400

UNKNOWN = "und"
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngrams(text: str) -> np.ndarray:
    """All 1-, 2- and 3-grams of the text's letters, in lower case, words set off by one blank.

    Each is a number of its own: 21 bits a character, and the length in the top bits.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    points = np.where(_is_letter()[points], points, 0).astype(np.uint64)
    points = np.concatenate([np.zeros(1, np.uint64), points, np.zeros(1, np.uint64)])
    points = points[np.append(True, (points[1:] != 0) | (points[:-1] != 0))]
    if len(points) < 3:
        return np.zeros(0, np.uint64)
    s = np.uint64(21)
    two = (points[:-1] << s) | points[1:]
    three = (two[:-1] << s) | points[2:]
    one = points[points != 0] | np.uint64(3 << 62)
    return np.concatenate([one, two | np.uint64(1 << 63), three])


def ranked(grams: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by number."""
    values, counts = np.unique(grams, return_counts=True)
    return values[np.argsort(-counts, kind="stable")[:top]]


class Profiles:
    """Languages in order of name, and each n-gram's rank in each of them."""

    def __init__(self, ranks: dict[str, list[int]], top: int = TOP) -> None:
        self.languages, self.top = sorted(ranks), top
        self.grams = np.unique(np.array([g for lang in self.languages for g in ranks[lang]], np.uint64))
        self.places = np.full((len(self.grams) + 1, len(self.languages)), -1, np.int64)  # the last row: unknown
        for k, lang in enumerate(self.languages):
            self.places[np.searchsorted(self.grams, np.array(ranks[lang], np.uint64)), k] = np.arange(len(ranks[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranked(ngrams(text), self.top) if text and self.languages else ()
        if len(own) == 0:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, own)
        at[self.grams[np.minimum(at, len(self.grams) - 1)] != own] = len(self.grams)
        places = self.places[at]
        far = np.where(places < 0, self.top, np.abs(places - np.arange(len(own))[:, None])).sum(0) / (self.top * len(own))
        best = int(far.argmin())
        return self.languages[best], float(1 - far[best])


def _count_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    start_bare()
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        texts = batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            values, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            for i in np.flatnonzero(langs == lang).tolist():  # a text at a time: few different n-grams, however many
                own, times = np.unique(ngrams(texts[i]), return_counts=True)
                both, at = np.unique(np.concatenate([values, own]), return_inverse=True)
                values, counts = both, np.bincount(at, np.concatenate([counts, times]), len(both)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])


def learn(labelled: DataFrame, train_docs: int = TRAIN_DOCS, top: int = TOP) -> Profiles:
    """Profiles from labelled(doc_id, text, lang); rows without text or language are passed over."""
    rows = labelled.where("text is not null and lang is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    # One row for each language there is.
    rates = {r["lang"]: train_docs / r["count"] for r in rows.groupBy("lang").count().collect()}
    if not rates:
        return Profiles({}, top)
    rate = F.create_map(*[F.lit(x) for pair in sorted(rates.items()) for x in pair])[F.col("lang")]
    draw = F.pmod(F.xxhash64("doc_id", F.lit("profile")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = rows.where(draw < rate).select("lang", "text")
    counts = sample.mapInArrow(_count_kernel, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    # At most `top` rows for each language.
    chosen = counts.withColumn("place", place).where(F.col("place") <= top).orderBy("lang", "place").collect()
    ranks: dict[str, list[int]] = {}
    for r in chosen:
        ranks.setdefault(r["lang"], []).append(r["gram"] & (1 << 64) - 1)
    return Profiles(ranks, top)


def _predict_kernel(profiles: Profiles, text: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_bare()
        for batch in batches:
            found = [profiles.predict(t) for t in batch.column(text).to_pylist()]
            langs = pa.array([lang for lang, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, langs, pa.array([s for _, s in found], pa.float64())], [*batch.schema.names, "lang_pred", "score"])
            give_back()

    return kernel


def predict(rows: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """rows with two columns more: lang_pred and score, 0 to 1."""
    shape = StructType([*rows.schema, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return map_rows(rows, _predict_kernel(profiles, rows.columns.index(text)), shape)


def held_out(doc_id: str = "doc_id"):
    """Is the remainder by 4 of the CRC-32 of the identifier, as text, 2?"""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def language_of(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score."""
    profiles = learn(docs.where(~held_out()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return predict(rows, profiles).drop("text")
