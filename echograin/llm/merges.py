"""SentencePiece encoding with seeded merge dropout, and decoding.

The text is cut into words, a word taking the spaces before it, and line ends into chunks of
their own; no piece of the vocabulary reaches across. Within a word, characters are merged
by agenda: the best-scored pair of neighbours first, the leftmost of equals. A candidate merge that
enters the agenda is skipped for good if a hash of (seed, document, which word of it, left piece, right piece, place) falls below the
rate. So every occurrence of a word is segmented on its own, and always alike for the same seed, document and place.

Short words of about one size go through the agenda together, one merge each a round, in numpy; long ones
by a heap. What a word gives without skips and the candidates it meets are kept, up to a bound, for the worker's life: an
occurrence that skips none of them has that result, any other goes through the agenda on its own.

What no piece covers is spelt in byte pieces, as is the sign that stands for the space, so that decoding
returns the text. Nulls and odd cases: a null or empty text has no pieces; a null identifier is a document like
any other; repeated rows come out alike; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, kept, text_bytes
from .tokens import _Chunks, _Ragged, by_size

RATE = 0.1
#: Characters of a word beyond which it goes by the heap.
LONG = 48
#: Words that go through the agenda together.
_ROUND = 8192
#: Words that a worker keeps at most, about, and occurrences looked at together.
KEPT_WORDS, _LOOK = 1_000_000, 1 << 16
SPACE = "▁"
_NONE = np.int64(1) << 62
_SHIFT = 20
_PLACES = 1 << _SHIFT
#: In a table of symbols, what stands where there is none.
_GONE = np.int64(-1) << 32
#: Slots among which pairs are spread by a hash, as a power of two.
_SLOT_BITS = 19

_models: dict[tuple[str, float, int], Merger] = {}
kept.append(_models)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slots(key: np.ndarray) -> np.ndarray:
    return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of ranges, end to end."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Merger:
    def __init__(self, path: str, rate: float = RATE, seed: int = 0) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.seed = np.uint64(seed & (1 << 64) - 1)
        self.bar = int(rate * (1 << 53))
        n = model.get_piece_size()
        self.bytes = np.zeros(256, np.int64)
        names = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
        spelt = []
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.bytes[int(name[1:-1], 16)] = i
                spelt.append(bytes([int(name[1:-1], 16)]))
            else:
                spelt.append(b"" if special[i] else name.replace(SPACE, " ").encode())
        self.spelt = _Ragged(np.uint8)
        self.spelt.add(np.frombuffer(b"".join(spelt), np.uint8), np.array([len(s) for s in spelt]))
        #: Symbols: pieces by their id; then characters that only occur within pieces; beyond, -1 - character.
        known = {name: i for i, name in enumerate(names) if not special[i]}
        inner = sorted({c for name in known for c in name} - known.keys())
        self.symbols = known | {c: n + k for k, c in enumerate(inner)}
        self.wide = n + len(inner)
        # Of pairs, the better-scored comes first.
        rank = {name: r for r, name in enumerate(sorted(known, key=lambda s: (-model.get_score(known[s]), known[s])))}
        pairs = {}
        for name in known:
            for cut in range(1, len(name)):
                left, right = self.symbols.get(name[:cut]), self.symbols.get(name[cut:])
                if left is not None and right is not None:
                    pairs[left * self.wide + right] = rank[name]
        self.pairs = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[p] for p in self.pairs.tolist()], np.int64)
        self.of_rank = np.array([known[name] for name in rank], np.int64)
        #: Of each slot: where its pair stands (none: anywhere), or -1 if it has several.
        self.slots = np.zeros(1 << _SLOT_BITS, np.int32)
        slot, first, count = np.unique(_slots(self.pairs), return_index=True, return_counts=True)
        self.slots[slot] = np.where(count == 1, first, -1)
        self.of_char = np.full(0x110000, -1, np.int64)
        for name, i in self.symbols.items():
            if len(name) == 1:
                self.of_char[ord(name)] = i
        self.of_char[0x20] = self.of_char[ord(SPACE)]
        self.of_char[ord(SPACE)] = -1  # in a text, it is no space
        self._clear()

    @staticmethod
    def of(path: str, rate: float, seed: int) -> Merger:
        key = (path, rate, seed)
        if key not in _models:
            _models[key] = Merger(*key)
        return _models[key]

    def _clear(self, salt: int = 0) -> None:
        #: Of each word: its pieces without skips, the candidates that this meets (pair and place in one number), and whether it is long.
        self.words, self.rows, self.met, self.long = _Chunks(salt), _Ragged(), _Ragged(np.int64), np.zeros(0, bool)

    # Agenda ----------------------------------------------------------------------

    def _value(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, mark: np.ndarray | None) -> np.ndarray:
        """Of candidate merges: rank and place in one number (none: very large). mark: of the occurrence; without, none is skipped."""
        key = np.where((left >= 0) & (right >= 0), left * self.wide + right, -1)
        at = self._find(key)
        value = np.where(self.pairs[at] == key, self.ranks[at] * _PLACES + np.minimum(place, _PLACES - 1), _NONE)
        if self.bar and mark is not None:
            some = np.flatnonzero(value < _NONE)
            value[some[self._skipped(key[some], place[some], mark[some])]] = _NONE
        return value

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Where in `pairs` each key stands, if it does."""
        slot = _slots(key)
        at = self.slots[slot]
        more = np.flatnonzero(at < 0)  # several pairs have this slot
        if len(more):
            at[more] = np.minimum(np.searchsorted(self.pairs, key[more]), len(self.pairs) - 1)
        return at

    def _skipped(self, key: np.ndarray, place: np.ndarray, mark: np.ndarray) -> np.ndarray:
        drawn = _mix(key.astype(np.uint64) ^ _mix(mark.astype(np.uint64) + place.astype(np.uint64)))
        return (drawn >> np.uint64(11)).astype(np.int64) < self.bar

    def _together(self, symbols: np.ndarray, sizes: np.ndarray, marks: np.ndarray | None, met: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of words that lie end to end, and how many each has. met gets the candidates: word, pair and place.

        In the tables, a row is a place and a column a word: a piece stands where its first character does. Only what a merge
        touches is written; the best candidates of all words are one pass over `value`.
        """
        n, high = len(sizes), max(1, int(sizes.max()))
        word = np.repeat(np.arange(n), sizes)
        place = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        table = np.full(high * n, _GONE)
        table[place * n + word] = symbols
        after = np.repeat(np.arange(1, high + 1), n)
        after[np.maximum(sizes - 1, 0) * n + np.arange(n)] = high
        before = np.repeat(np.arange(-1, high - 1), n)
        value = np.full((high, n), _NONE)

        def enter(left: np.ndarray, right: np.ndarray, word: np.ndarray, column: np.ndarray) -> None:
            """Candidates of the pieces at two places of each word."""
            a, b = table[left * n + word], table[right * n + word]
            found = self._value(a, b, left, None if marks is None else marks[word])
            value.reshape(-1)[left * value.shape[1] + column] = found
            if met is not None:
                some = found < _NONE
                met.append((word[some], (a[some] * self.wide + b[some]) * (LONG + 1) + left[some]))

        pair = np.flatnonzero(word[:-1] == word[1:])
        enter(place[pair], place[pair] + 1, word[pair], word[pair])
        words = np.arange(n)  # of the columns of value
        while True:
            least = value.min(0)
            live = np.flatnonzero(least < _NONE)
            if len(live) == 0:
                break
            least = least[live]
            if 4 * len(live) < 3 * len(words):
                value, words, live = value.take(live, 1), words[live], np.arange(len(live))
            here, own = least & (_PLACES - 1), words[live]
            cell = here * n + own
            gone = after[cell]
            cut = gone * n + own
            then = after[cut]
            table[cell], table[cut], after[cell] = self.of_rank[least >> _SHIFT], _GONE, then
            flat = value.reshape(-1)
            flat[here * len(words) + live] = flat[gone * len(words) + live] = _NONE
            has = np.flatnonzero(then < high)
            before[then[has] * n + own[has]] = here[has]
            ahead = before[cell]
            led = np.flatnonzero(ahead >= 0)
            both = np.concatenate([led, has])
            enter(np.concatenate([ahead[led], here[has]]), np.concatenate([here[led], then[has]]), own[both], live[both])
        left = table.reshape(high, n).T
        stays = left != _GONE
        return left[stays], stays.sum(1)

    def _by_heap(self, symbols: np.ndarray, mark: np.ndarray | None) -> np.ndarray:
        """The pieces of one word, by a heap of candidates."""
        n = len(symbols)
        sym = symbols.tolist()
        before, after, age = list(range(-1, n - 1)), [*range(1, n), -1], [0] * n

        def candidates(places: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
            if places:
                p = np.array(places)
                right = np.array([after[i] for i in places])
                value = self._value(np.array([sym[i] for i in places]), np.array([sym[i] for i in right]), p, None if mark is None else np.broadcast_to(mark, p.shape))
                for v, i, j in zip(value.tolist(), places, right.tolist()):
                    if v < _NONE:
                        yield v >> _SHIFT, i, j, int(self.of_rank[v >> _SHIFT]), age[i] + age[j]

        heap = list(candidates(list(range(n - 1))))
        heapq.heapify(heap)
        while heap:
            _, i, j, m, when = heapq.heappop(heap)
            if sym[i] is None or after[i] != j or age[i] + age[j] != when:
                continue
            sym[i], sym[j] = m, None
            age[i] += age[j] + 1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for c in candidates([k for k in (before[i], i) if k >= 0 and after[k] >= 0]):
                heapq.heappush(heap, c)
        return np.array([s for s in sym if s is not None], np.int64)

    def segment(self, words: list[str], marks: np.ndarray | None, met: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of each word, whose occurrence has that mark, end to end, and their lengths. Without marks, nothing is skipped.

        met gets the candidates of short words: the word, and pair and place in one number.
        """
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        return self._segment(points, np.fromiter(map(len, words), np.int64, len(words)), marks, met)

    def _segment(self, points: np.ndarray, sizes: np.ndarray, marks: np.ndarray | None, met: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """As segment(), of the characters of words, end to end, and how many each has."""
        points = points.astype(np.int64)
        symbols = self.of_char[points]
        symbols = np.where(symbols < 0, -1 - points, symbols)
        long = sizes > LONG
        flat, counts = np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
        which = np.flatnonzero(~long)
        if len(which):
            # Words of about one size go together.
            which = which[np.argsort(sizes[which], kind="stable")]
            starts, parts = np.cumsum(sizes) - sizes, []
            for w in range(0, len(which), _ROUND):
                some = which[w : w + _ROUND]
                here: list | None = None if met is None else []
                part, counts[some] = self._together(symbols[_ranges(starts[some], sizes[some])], sizes[some], None if marks is None else marks[some], here)
                parts.append(part)
                if here:
                    met += [(some[k], c) for k, c in here]
            begins = np.zeros(len(sizes), np.int64)
            begins[which] = np.cumsum(counts[which]) - counts[which]
            flat = np.concatenate(parts)[_ranges(begins, counts)]
        if long.any():
            parts = np.split(flat, np.cumsum(counts)[:-1])
            ends = np.cumsum(sizes)
            for w in np.flatnonzero(long).tolist():
                parts[w] = self._by_heap(symbols[ends[w] - sizes[w] : ends[w]], None if marks is None else marks[w : w + 1])
                counts[w] = len(parts[w])
            flat = np.concatenate(parts)
        odd = np.flatnonzero((flat < 0) | (flat >= self.spelt.rows))
        if len(odd):  # spelt in bytes
            inner = {i: ord(c) for c, i in self.symbols.items() if i >= self.spelt.rows}
            spelt = [self.bytes[list(chr(inner.get(s, -1 - s)).encode("utf-8", "surrogatepass"))] for s in flat[odd].tolist()]
            wide = np.ones(len(flat), np.int64)
            wide[odd] = [len(s) for s in spelt]
            of_word = np.repeat(np.arange(len(sizes)), counts)
            counts = np.bincount(of_word, weights=wide, minlength=len(sizes)).astype(np.int64)
            full = np.repeat(flat, wide)
            full[np.repeat(np.isin(np.arange(len(flat)), odd), wide)] = np.concatenate(spelt)
            flat = full
        return flat.astype(np.uint32), counts

    # Texts -----------------------------------------------------------------------

    @staticmethod
    def _cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin, and each text's first word. A space begins one unless a space is before it; a line end is one."""
        space, line = data == 32, data == 10
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        begins = first[:-1].copy()
        if len(data):
            begins[1:] |= (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        starts = np.flatnonzero(begins)
        return starts, np.searchsorted(starts, offsets)

    def encode(self, texts: list[str], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All piece ids of texts, end to end, and len(texts) + 1 offsets. docs: a number of each document."""
        if len(self.words) > KEPT_WORDS:
            self._clear()
        data, offsets = text_bytes(pa.array([" " + t if t else "" for t in texts], pa.large_string()))
        starts, first = self._cut(data, offsets)
        ends = np.append(starts, len(data))
        chunks = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        different = chunks.dictionary_encode()
        while (found := self.words.find(different.dictionary)) is None:
            self._clear(self.words.salt + 1)
        codes = found[0][different.indices.to_numpy()]
        self._learn()
        nth = np.arange(len(codes)) - np.repeat(first[:-1], np.diff(first))
        marks = _mix(_mix(self.seed ^ np.repeat(docs.astype(np.uint64), np.diff(first))) + nth.astype(np.uint64))
        parts = [self._occurrences(codes[w : w + _LOOK], marks[w : w + _LOOK]) for w in range(0, len(codes), _LOOK)]
        ids = np.concatenate([np.zeros(0, np.uint32), *(p for p, _ in parts)])
        lengths = np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)])
        return ids, np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])[first]

    def _spelled(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The characters of words, end to end, and how many each has."""
        raw, sizes = self.words.rows.take(codes)
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4")
        if len(points) < len(raw):  # a character begins at each byte that continues none
            begun = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
            sizes = np.diff(begun[np.append(0, np.cumsum(sizes))])
        return points, sizes

    def _learn(self) -> None:
        """What words that came new give without skips."""
        new = np.arange(self.rows.rows, len(self.words))
        if len(new) == 0:
            return
        points, sizes = self._spelled(new)
        met: list = []
        self.rows.add(*self._segment(points, sizes, None, met))
        word = np.concatenate([np.zeros(0, np.int64), *(w for w, _ in met)])
        self.met.add(np.concatenate([np.zeros(0, np.int64), *(c for _, c in met)])[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(new)))
        self.long = np.append(self.long, sizes > LONG)

    def _occurrences(self, codes: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of occurrences of words, end to end, and their lengths."""
        if not self.bar:
            return self.rows.take(codes)
        met, counts = self.met.take(codes)
        of = np.repeat(np.arange(len(codes)), counts)
        own = self.long[codes]
        own[of[self._skipped(met // (LONG + 1), met % (LONG + 1), marks[of])]] = True
        plain, plain_lengths = self.rows.take(codes[~own])
        if not own.any():
            return plain, plain_lengths
        cut, cut_lengths = self._segment(*self._spelled(codes[own]), marks[own])
        lengths = np.zeros(len(codes), np.int64)
        lengths[own], lengths[~own] = cut_lengths, plain_lengths
        ids, inside = np.zeros(lengths.sum(), np.uint32), np.repeat(own, lengths)
        ids[inside], ids[~inside] = cut, plain
        return ids, lengths

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts that pieces spell."""
        raw, lengths = self.spelt.take(ids)
        at = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])[offsets].tolist()
        view = memoryview(np.ascontiguousarray(raw))
        return [bytes(view[s + 1 : e]).decode("utf-8", "surrogatepass") if e > s else "" for s, e in zip(at, at[1:])]


def _kernel(model: str, rate: float, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger.of(model, rate, seed)
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            for some in by_size(texts):
                docs = batch.column(0).slice(some.start, some.stop - some.start)
                own = texts[some]
                ids, offsets = merger.encode(own, docs.fill_null(-1).to_numpy(zero_copy_only=False))
                fine = pa.array([a == b for a, b in zip(merger.decode(ids, offsets), own)], pa.bool_())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([docs, pa.array(np.diff(offsets)), fine, lists], ["doc_id", "n_pieces", "lossless", "ids"])
            give_back()

    return kernel


def encode(docs: DataFrame, model: str, rate: float = RATE, seed: int = 0) -> DataFrame:
    """One row per row of docs: doc_id, n_pieces, lossless (does decoding give the text?), ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_kernel(model, rate, seed), "doc_id long, n_pieces long, lossless boolean, ids array<int>")


def _decode_kernel(model: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger.of(model, 0.0, 0)
        for batch in batches:
            lists = batch.column(1)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            texts = merger.decode(ids, np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return kernel


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_decode_kernel(model), "doc_id long, text string")
