"""Encoding whole texts with a public tokenizer of the tokenizers library.

The library cuts a text at white space, and between letters and marks, before it merges anything, and
what it makes of a chunk depends on that chunk alone. So a text is cut into chunks, a chunk of letters
and marks into the two, and the library is given each different one once; its ids
are kept, up to a bound, for the worker's life, and numpy puts the texts' ids together. Texts with control
characters that Python and the library class differently go to the library whole, and so do
texts with the string of an added token, which the library finds before it cuts anything.
"""

from __future__ import annotations

import gc
import itertools
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept, text_bytes

#: Different chunks, and their characters, that a worker keeps at most.
KEPT_CHUNKS, KEPT_CHARS = 900_000, 24_000_000
#: Strings given to the library at once: what it returns of each takes far more memory than its ids.
GIVEN = 4096

#: White space beyond ASCII, and characters that not all libraries count as white space.
_DOUBTFUL = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Latin letters, then marks: two chunks to the library, whatever its tables of characters.
_MARKS = ".,;:!?#$%&*"
_STEM = "^ ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+$"
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True

_encoders: dict[str, Encoder] = {}
kept.append(_encoders)


class _Ragged:
    """Rows of numbers, end to end, that rows are added to."""

    def __init__(self, kind: type = np.uint32) -> None:
        self.ids = np.zeros(1 << 16, kind)
        self.starts = np.zeros(1 << 12, np.int64)  # of row k; that of k + 1 ends it
        self.rows = 0

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        used, rows = int(self.starts[self.rows]), self.rows + len(lengths)
        if used + len(ids) > len(self.ids):
            self.ids = self._wider(self.ids, used, 2 * (used + len(ids)))
        self.ids[used : used + len(ids)] = ids
        if rows >= len(self.starts):
            self.starts = self._wider(self.starts, self.rows + 1, 2 * rows + 1)
        self.starts[self.rows + 1 : rows + 1] = used + np.cumsum(lengths)
        self.rows = rows

    @staticmethod
    def _wider(numbers: np.ndarray, used: int, size: int) -> np.ndarray:
        """A copy with room at its end, which takes no memory until it is written to."""
        wide = np.empty(size, numbers.dtype)
        wide[:used] = numbers[:used]
        return wide

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of these rows, end to end, and their lengths."""
        begins = self.starts[rows]
        lengths = self.starts[rows + 1] - begins
        ends = np.cumsum(lengths)
        return self.ids[np.repeat(begins - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)], lengths


class _Chunks:
    """Numbers for byte strings, found many at a time by hash and then compared byte by byte."""

    def __init__(self, salt: int = 0) -> None:
        self.salt = salt
        self.base = (0x9E3779B97F4A7C15 + 2 * salt) | 1
        self.power, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)
        self.hashes, self.codes = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # in order of hash
        self.rows = _Ragged(np.uint8)

    def __len__(self) -> int:
        return self.rows.rows

    @property
    def chars(self) -> int:
        """Bytes of all strings."""
        return int(self.rows.starts[len(self)])

    def _hash(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        if len(self.power) < n:
            for name, base in (("power", self.base), ("inverse", pow(self.base, -1, 1 << 64))):
                table = np.full(2 * n, np.uint64(base))
                table[0] = 1
                setattr(self, name, np.cumprod(table, dtype=np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], dtype=np.uint64)])
        h = (sums[offsets[1:]] - sums[offsets[:-1]]) * self.inverse[offsets[:-1]]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))

    def find(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray] | None:
        """The number of each of different strings, and which came new; None if two share a hash."""
        data, offsets = text_bytes(strings)
        h = self._hash(data, offsets)
        at = np.searchsorted(self.hashes, h)
        known = np.zeros(len(h), bool)
        if len(self.hashes):
            known = self.hashes[np.minimum(at, len(self.hashes) - 1)] == h
        codes = np.empty(len(h), np.int64)
        codes[known] = self.codes[at[known]]
        lengths = np.diff(offsets)
        same, sizes = self.rows.take(codes[known])
        if not np.array_equal(sizes, lengths[known]) or not np.array_equal(same, data[np.repeat(known, lengths)]):
            return None
        new = np.flatnonzero(~known)
        if len(new):
            order = new[np.argsort(h[new], kind="stable")]
            if (h[order[1:]] == h[order[:-1]]).any():
                return None
            codes[new] = len(self) + np.arange(len(new))
            self.rows.add(data[np.repeat(~known, lengths)], lengths[new])
            self.hashes = np.insert(self.hashes, at[order], h[order])
            self.codes = np.insert(self.codes, at[order], codes[order])
        return codes, new


def _edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each byte: is it white, is the next one in its text, is the one before; outside a text all is white."""
    white = _WHITE[data]
    after, before = np.ones(len(data), bool), np.ones(len(data), bool)
    after[:-1], before[1:] = white[1:], white[:-1]
    filled = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[filled] = True
    after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = True
    return white, after, before


def cut_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between white space: their bytes end to end, their offsets, and each text's first word."""
    white, _, before = _edges(data, offsets)
    starts = np.flatnonzero(~white & before)
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(~white)])
    return data[~white], np.append(at[starts], at[-1]), np.searchsorted(starts, offsets)


def cut_spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, each with a space right before it, and the rest of white space; all bytes are kept.

    White space before a word gives up its last character: to the word if that is a
    space, else as a chunk of its own.
    """
    white, after, before = _edges(data, offsets)
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    spaced = np.zeros(len(data), bool)
    spaced[1:] = data[:-1] == 32
    inner = ~first[:-1]
    run = white & (~before | ~inner | ~after)
    word = ~white & (~inner | (before & ~spaced))
    starts = np.flatnonzero(run | word)
    return data, np.append(starts, len(data)), np.searchsorted(starts, offsets)


class Encoder:
    def __init__(self, path: str) -> None:
        self.most = KEPT_CHUNKS
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # With a normaliser, white space is dropped and letters are lowered; without, a chunk takes the space before it.
        self.lowers = self.library.normalizer is not None
        self.cut = cut_words if self.lowers else cut_spaced
        self.normalizer = self.library.normalizer
        # In any case of letters: a token may be looked for after the text was lowered.
        added = [t.content for t in self.library.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        #: What all of them begin with, up to the first letter: most texts don't hold it, which is soon seen.
        self.opening = os.path.commonprefix([re.match(r"[^\w]*", t).group() for t in added])
        self.width = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self._clear()
        self._clear_atoms()

    @staticmethod
    def of(path: str, most: int = KEPT_CHUNKS) -> Encoder:
        """The worker's own encoder for this file, which from now on keeps `most` chunks, about."""
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        _encoders[path].most = most
        return _encoders[path]

    def _has_added(self, text: str) -> bool:
        return self.added is not None and self.opening in text and self.added.search(text) is not None

    def _clear(self, salt: int = 0) -> None:
        self.chunks, self.of_chunk = _Chunks(salt), _Ragged()
        self.chars = 0

    def _clear_atoms(self, salt: int = 0) -> None:
        self.atoms, self.of_atom = _Chunks(salt), _Ragged()

    def _learn(self, chunks: pa.Array) -> None:
        """Ids for the chunks that came new: those of a stem and of the marks after it, or of the whole."""
        self.chars += pc.sum(pc.binary_length(chunks)).as_py()
        stems = pc.utf8_rtrim(chunks, characters=_MARKS)
        plain = pc.match_substring_regex(stems, _STEM)
        marks = pc.replace_substring_regex(chunks.filter(plain), f"(?s)^.*?([{_MARKS}]*)$", "\\1")
        stems = stems.filter(plain)
        plain = plain.to_numpy(zero_copy_only=False)
        # The first is what a whole has for marks. Row `known` + k is the k-th whole's; wholes come once, so their rows go again.
        atoms = self._atoms(pa.concat_arrays([pa.array([""], chunks.type), pc.utf8_lower(stems) if self.lowers else stems, marks]))
        known = self.of_atom.rows
        whole = chunks.filter(pa.array(~plain))
        pairs = np.empty((len(chunks), 2), np.int64)
        pairs[plain] = atoms[1:].reshape(2, -1).T
        pairs[~plain, 0], pairs[~plain, 1] = known + np.arange(len(whole)), atoms[0]
        self._add(whole)
        ids, lengths = self.of_atom.take(pairs.reshape(-1))
        self.of_atom.rows = known
        self.of_chunk.add(ids, lengths.reshape(-1, 2).sum(1))

    def _atoms(self, strings: pa.Array) -> np.ndarray:
        """The row of each string in of_atom; each different one is looked up once."""
        different = strings.dictionary_encode()
        while (found := self.atoms.find(different.dictionary)) is None:
            self._clear_atoms(self.atoms.salt + 1)
        codes, new = found
        self.library.normalizer = None  # stems are lowered already
        try:
            self._add(different.dictionary.take(pa.array(new)))
        finally:
            if self.lowers:
                self.library.normalizer = self.normalizer
        return codes[different.indices.to_numpy()]

    def _add(self, strings: pa.Array) -> None:
        """Rows of of_atom for strings."""
        collecting = gc.isenabled()
        gc.disable()  # very many small lists, of which none is part of a cycle
        try:
            for at in range(0, len(strings), GIVEN):
                found = [e.ids for e in self.library.encode_batch_fast(strings.slice(at, GIVEN).to_pylist(), add_special_tokens=False)]
                lengths = np.fromiter(map(len, found), np.int64, len(found))
                self.of_atom.add(np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths)
        finally:
            if collecting:
                gc.enable()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts, end to end, and len(texts) + 1 offsets."""
        # Apart: atoms, which are the library's work, outlast the chunks that were put together from them.
        if len(self.chunks) > self.most or self.chars > KEPT_CHARS:
            self._clear()
        if len(self.atoms) > self.most or self.atoms.chars > KEPT_CHARS:
            self._clear_atoms()
        odd = [i for i, t in enumerate(texts) if _DOUBTFUL.search(t) or self._has_added(t)]
        usual = texts
        if odd:
            usual = list(texts)
            for i in odd:
                usual[i] = ""
        data, ends, first = self.cut(*text_bytes(pa.array(usual, pa.large_string())))
        chunks = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        different = chunks.dictionary_encode()
        while (found := self.chunks.find(different.dictionary)) is None:
            self._clear(self.chunks.salt + 1)
        codes, new = found
        if len(new):
            self._learn(different.dictionary.take(pa.array(new)))
        ids, lengths = self.of_chunk.take(codes[different.indices.to_numpy()])
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])[first]
        if odd:
            parts = np.split(ids, offsets[1:-1])
            for i in odd:
                parts[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.uint32)
            ids = np.concatenate(parts)
            offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(p) for p in parts])])
        return ids, offsets

    def encode_ended(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), with end_id after each text's ids."""
        ids, offsets = self.encode(texts)
        return np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))


def public(name: str) -> str:
    """Where the vocabulary file of a public tokenizer is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def by_size(texts: list[str], chars: int = 3_000_000) -> Iterator[slice]:
    """Slices of texts of about `chars` characters; a longer text is a slice of its own."""
    return by_length(map(len, texts), chars)


def by_length(lengths: Iterable[int], most: int) -> Iterator[slice]:
    """Slices of about `most` in sum; what is longer is a slice of its own."""
    begin = held = end = 0
    for end, n in enumerate(lengths, 1):
        if held and held + n > most:
            yield slice(begin, end - 1)
            begin, held = end - 1, 0
        held += n
    if begin < end:
        yield slice(begin, end)
