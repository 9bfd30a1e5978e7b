"""Personal data: base patterns, and a linear-chain conditional random field that adds to them.

The base patterns find e-mail addresses, IP addresses, payment cards and telephone numbers that are
written in the usual way. The field finds others by the shape of their words and by the words around them: it was trained by
maximum likelihood on the small table in pii_table, and Viterbi decodes it, for many
runs of words at once, in numpy. Words without a digit, an @ or a bracketed "at" or "dot" can't be part of personal data in
this model. A run is made of words that aren't plain in this sense, and of BEFORE plain words before
and AFTER after each of them, so what lies outside of runs can't change a label. What the
field proposes counts if it passes the checks of its kind and touches no base span.

Nulls and odd cases: a null text counts as empty and has no span; a null identifier stays null; repeated
rows each give a row; an empty table gives an empty result. Positions count code points.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import give_back, map_rows, start_bare
from .pii_table import LINES

KINDS = ("email", "ip", "card", "phone")

Span = tuple[int, int, int]  # start, kind, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number begins where no digit precedes it: a match from further left would have taken that in.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done = 0  # where the last match ended
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            done = found.end()
            yield start, 0, done
        at = text.find("@", max(at + 1, done))


def _ok_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in text.split("."))


def _ok_card(text: str) -> bool:
    digits = _NO_DIGIT.sub("", text)
    return 14 <= len(digits) <= 19 and luhn(digits)


def _ok_phone(text: str) -> bool:
    return 10 <= len(_NO_DIGIT.sub("", text)) <= 15


def base_spans(text: str) -> list[Span]:
    """The base patterns' spans by start, then kind; leftmost and apart within each kind."""
    found = list(_emails(text))
    for kind, pattern, ok in ((1, _IP, _ok_ip), (2, _CARD, _ok_card), (3, _PHONE, _ok_phone)):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if ok(m.group())]
    return sorted(found)


# The field -----------------------------------------------------------------------

#: Outside; then beginning and inside of each kind.
LABELS = 1 + 2 * len(KINDS)
_CUE = re.compile(r"[0-9@]|[\[(](?:at|dot)[\])]", re.I)
_SPACE, _WORD = re.compile(r"\s"), re.compile(r"\S+")
_STRIP_L, _STRIP_R = "\"'*#$%&|<{[,;:=", ".,;:!?\"'*#$%&|>}="
_LETTERS, _DIGITS = re.compile("[^\\W\\d_]+"), re.compile("[0-9]")


def _core(word: str) -> tuple[int, int]:
    """The word without punctuation around it; a bracket goes if it closes none within."""
    begin, end = 0, len(word)
    while begin < end and word[begin] in _STRIP_L:
        begin += 1
    while begin < end:
        last = word[end - 1]
        opening = {")": "(", "]": "["}.get(last)
        if last not in _STRIP_R and not (opening and word.count(opening, begin, end) < word.count(last, begin, end)):
            break
        end -= 1
    return begin, end


#: Plain words that a run has before and after each word that isn't.
BEFORE, AFTER = 2, 1


def _own(word: str) -> tuple[list[str], str]:
    """What the field sees of a word alone: its shape, exactly and roughly, and its digits; and how its neighbours see it."""
    begin, end = _core(word)
    core = word[begin:end]
    if not _CUE.search(word):
        name = core.lower() if len(core) <= 24 else "long"
        return ["bias", "plain", "word " + name], name
    exact = _DIGITS.sub("d", _LETTERS.sub("x", core))
    rough = re.sub("d+", "d", exact)
    frame = re.sub("[xd._%+-]+", "w", exact)
    digits = exact.count("d")
    return [
        "bias",
        "exact " + (exact if len(exact) <= 24 else "long"),
        "rough " + (rough if len(rough) <= 24 else "long"),
        "frame " + (frame if len(frame) <= 24 else "long"),
        f"digits {min(digits, 20)}",
        "obfuscated" if re.search(r"[\[(](?:at|dot|\.)[\])]", core, re.I) else "usual",
        "hex" if digits and re.search("[a-fA-F]", core) else "decimal",
    ], "#"


def features(words: list[str]) -> list[list[str]]:
    """What the field sees of each word of a run: the word itself, the two before it and the one after it."""
    own = [_own(w) for w in words]
    names = ["^", "^", *(n for _, n in own), "$"]
    out = []
    for t, (seen, name) in enumerate(own):
        around = [f"before {names[t + 1]}", f"two before {names[t]}", f"after {names[t + 3]}"]
        # Context tells of words that may be personal data; plain ones are outside anyway.
        out.append(seen + around if name == "#" else seen)
    return out


def _candidates(text: str) -> list[tuple[int, int]]:
    """The words, as positions, that hold a digit, an @ or a bracketed at or dot."""
    found, at = [], 0
    while hit := _CUE.search(text, at):
        begin = hit.start()
        while begin > at and not text[begin - 1].isspace():
            begin -= 1
        stop = _SPACE.search(text, hit.end())
        at = stop.start() if stop else len(text)
        found.append((begin, at))
    return found


def _runs(text: str, words: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """The words, with those around them, in runs that have nothing but white space between their words."""
    runs: list[list[tuple[int, int]]] = []
    for k, (begin, end) in enumerate(words):
        # Up to where the word before ends, or what its run took after it.
        floor = runs[-1][-1][1] if runs else 0
        ahead: list[tuple[int, int]] = []
        at = begin
        while len(ahead) < BEFORE and (found := _word_before(text, at, floor)):
            ahead.insert(0, found)
            at = found[0]
        if runs and text[floor:at].isspace():
            runs[-1] += [*ahead, (begin, end)]
        else:
            runs.append([*ahead, (begin, end)])
        ceiling = words[k + 1][0] if k + 1 < len(words) else len(text)
        at = end
        for _ in range(AFTER):
            if found := _word_after(text, at, ceiling):
                runs[-1].append(found)
                at = found[1]
    return runs


def _word_before(text: str, end: int, floor: int) -> tuple[int, int] | None:
    while end > floor and text[end - 1].isspace():
        end -= 1
    begin = end
    while begin > floor and not text[begin - 1].isspace():
        begin -= 1
    return (begin, end) if begin < end else None


def _word_after(text: str, begin: int, ceiling: int) -> tuple[int, int] | None:
    found = _WORD.search(text, begin, ceiling)
    return found.span() if found else None


def _labelled_runs() -> list[tuple[list[str], list[int]]]:
    """The table as runs of words with labels."""
    rows = []
    for line in LINES:
        text, marks = "", []
        for plain, kind, value in re.findall(r"(.*?)(?:\[(email|ip|card|phone):((?:\[[^\]]*\]|[^\]])*)\]|$)", line):
            text += plain
            if kind:
                marks.append((len(text), KINDS.index(kind), len(text) + len(value)))
                text += value
        for run in _runs(text, _candidates(text)):
            labels = []
            for begin, end in run:
                label = 0
                for s, kind, e in marks:
                    if begin < e and s < end:
                        label = 1 + 2 * kind + (labels[-1:] in ([1 + 2 * kind], [2 + 2 * kind]) and begin > s)
                labels.append(label)
            rows.append(([text[b:e] for b, e in run], labels))
    return rows


def _allowed() -> np.ndarray:
    """Which label may follow which; row LABELS: which may come first."""
    ok = np.ones((LABELS + 1, LABELS), bool)
    for kind in range(len(KINDS)):
        ok[:, 2 + 2 * kind] = False
        ok[[1 + 2 * kind, 2 + 2 * kind], 2 + 2 * kind] = True
    return ok


class Field:
    """Weights: of each feature for each label, and of each label after each other one."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, step: np.ndarray) -> None:
        self.index, self.emit, self.step = index, emit, step

    def scores(self, words: list[str]) -> np.ndarray:
        """The weight of each label for each word of a run."""
        out = np.zeros((len(words), LABELS))
        for t, seen in enumerate(features(words)):
            known = [self.index[f] for f in seen if f in self.index]
            out[t] = self.emit[known].sum(0)
        return out

    def decode(self, runs: list[list[str]]) -> list[np.ndarray]:
        """The best labels of each run, all runs at once, step by step."""
        if not runs:
            return []
        lengths = np.array([len(r) for r in runs])
        order = np.argsort(-lengths, kind="stable")
        longest = int(lengths.max())
        alive = [int((lengths >= t + 1).sum()) for t in range(longest)]
        scores = [self.scores(r) for r in runs]
        best = np.zeros((len(runs), LABELS))
        back: list[np.ndarray] = []
        for t in range(longest):
            n = alive[t]
            emitted = np.array([scores[i][t] for i in order[:n]])
            if t == 0:
                best[:n] = emitted + self.step[LABELS]
                back.append(np.zeros((n, LABELS), np.int8))
            else:
                ways = best[:n, :, None] + self.step[:LABELS]
                back.append(ways.argmax(1).astype(np.int8))
                best[:n] = ways.max(1) + emitted
        labels: list[np.ndarray] = [np.zeros(0, np.int64)] * len(runs)
        path = best.argmax(1)
        out = [np.zeros(int(k), np.int64) for k in lengths[order]]
        for t in range(longest - 1, -1, -1):
            n = alive[t]
            for k in range(n):
                out[k][t] = path[k]
            path[:n] = back[t][np.arange(n), path[:n]]
        for k, i in enumerate(order.tolist()):
            labels[i] = out[k]
        return labels


@functools.cache
def train(rounds: int = 300, penalty: float = 0.02) -> Field:
    """Maximum likelihood with a quadratic penalty, by gradient steps on the whole table."""
    rows = _labelled_runs()
    seen = [features(words) for words, _ in rows]
    index: dict[str, int] = {}
    for word in (f for run in seen for f in run):
        for f in word:
            index.setdefault(f, len(index))
    longest = max(len(w) for w, _ in rows)
    # The features of each word, filled up with one that has no weight.
    x = np.full((len(rows), longest, max(len(f) for run in seen for f in run)), len(index))
    y = np.full((len(rows), longest), -1)
    for i, (_, labels) in enumerate(rows):
        for t, word in enumerate(seen[i]):
            x[i, t, : len(word)] = [index[f] for f in word]
            y[i, t] = labels[t]
    barred = np.where(_allowed(), 0.0, -1e4)
    emit, step = np.zeros((len(index), LABELS)), np.zeros((LABELS + 1, LABELS))
    moments = [np.zeros_like(emit), np.zeros_like(emit), np.zeros_like(step), np.zeros_like(step)]
    live = y >= 0
    gold = np.zeros((*y.shape, LABELS))
    gold[live, y[live]] = 1

    def log_sum(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis, keepdims=True)
        return np.log(np.exp(a - top).sum(axis)) + top.squeeze(axis)

    for r in range(1, rounds + 1):
        score, move = np.vstack([emit, np.zeros(LABELS)])[x].sum(2), step + barred
        ahead = [score[:, 0] + move[LABELS]]
        for t in range(1, longest):
            on = log_sum(ahead[-1][:, :, None] + move[None, :LABELS], 1) + score[:, t]
            ahead.append(np.where(live[:, t, None], on, ahead[-1]))
        total = log_sum(ahead[-1], 1)
        behind = [np.zeros((len(rows), LABELS))]
        for t in range(longest - 1, 0, -1):
            on = log_sum(move[None, :LABELS] + (score[:, t] + behind[0])[:, None, :], 2)
            behind.insert(0, np.where(live[:, t, None], on, behind[0]))
        chance = np.stack([np.exp(ahead[t] + behind[t] - total[:, None]) for t in range(longest)], 1) * live[..., None]
        miss = np.repeat((gold - chance).reshape(-1, LABELS), x.shape[2], axis=0)
        d_emit = np.stack([np.bincount(x.ravel(), miss[:, k], len(index) + 1)[:-1] for k in range(LABELS)], 1) - penalty * emit
        d_step = -penalty * step
        d_step[LABELS] += (gold[:, 0] - chance[:, 0]).sum(0)
        for t in range(1, longest):
            both = np.exp(ahead[t - 1][:, :, None] + move[None, :LABELS] + (score[:, t] + behind[t])[:, None, :] - total[:, None, None])
            d_step[:LABELS] += (np.einsum("ij,ik->ijk", gold[:, t - 1], gold[:, t]) - both * live[:, t, None, None]).sum(0)
        for k, (w, g) in enumerate(((emit, d_emit), (step, d_step))):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += 0.1 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return Field(index, emit, step + barred)


_SEPARATORS = re.compile(r"[\[(](?:at|dot|\.)[\])]", re.I)
_FILLED = {"(at)": "@", "[at]": "@", "(dot)": ".", "[dot]": ".", "[.]": ".", "(.)": "."}


def _passes(kind: int, text: str) -> bool:
    """Would the text be of its kind, written in the usual way?"""
    if kind == 0:
        usual = _SEPARATORS.sub(lambda m: _FILLED[m.group().lower()], text)
        return [(s, e) for s, _, e in _emails(usual)] == [(0, len(usual))]
    if kind == 1:
        usual = _SEPARATORS.sub(".", text)
        return bool(_IP.fullmatch(usual)) and _ok_ip(usual)
    return _ok_card(text) if kind == 2 else _ok_phone(text)


def added_spans(texts: list[str], base: list[list[Span]], field: Field) -> list[list[Span]]:
    """What the field adds to each text's base spans."""
    where: list[tuple[int, list[tuple[int, int]]]] = []
    for i, text in enumerate(texts):
        where += [(i, run) for run in _runs(text, _candidates(text))]
    found: list[list[Span]] = [[] for _ in texts]
    for at in range(0, len(where), 4096):
        part = where[at : at + 4096]
        for (i, run), labels in zip(part, field.decode([[texts[i][b:e] for b, e in run] for i, run in part])):
            for t in np.flatnonzero(labels % 2 == 1).tolist():
                last = t
                while last + 1 < len(run) and labels[last + 1] == labels[t] + 1:
                    last += 1
                (b, e), (b2, e2) = run[t], run[last]
                start, end = b + _core(texts[i][b:e])[0], b2 + _core(texts[i][b2:e2])[1]
                kind = int(labels[t]) // 2
                if start < end and _passes(kind, texts[i][start:end]) and not any(s < end and start < x for s, _, x in base[i]):
                    found[i].append((start, kind, end))
    return found


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def spans_of(texts: list[str], field: Field) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans, and all spans, of each text."""
    base = [base_spans(t) for t in texts]
    return base, [sorted(b + a) for b, a in zip(base, added_spans(texts, base, field))]


def _span_kernel(field: Field) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_bare()
        for batch in batches:
            base, every = spans_of(batch.column(1).fill_null("").to_pylist(), field)
            counts = np.zeros((len(base), len(KINDS)), np.int64)
            for i, spans in enumerate(base):
                for _, k, _ in spans:
                    counts[i, k] += 1
            sums = [hashlib.sha256(_joined(s).encode()).hexdigest() for s in base]
            columns = [batch.column(0), *(pa.array(counts[:, k].copy()) for k in range(len(KINDS))), pa.array(sums, pa.string()), pa.array([_joined(s) for s in every], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return kernel


def find(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, the base spans' count by kind and digest, and all spans."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(_span_kernel(train()), f"doc_id long, {counts}, base_sha256 string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or spans that overlap, replaced by the first one's kind in angle brackets."""
    parts, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            parts += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _redact_kernel(field: Field, column: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_bare()
        for batch in batches:
            texts = batch.column(column).to_pylist()
            _, every = spans_of([t or "" for t in texts], field)
            clean = [redacted(t, s) if s else t for t, s in zip(texts, every)]
            columns = list(batch.columns)
            columns[column] = pa.array(clean, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)
            give_back()

    return kernel


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data in the text replaced; all other columns as they were."""
    shape = StructType([StructField(f.name, StringType() if f.name == text else f.dataType) for f in docs.schema])
    return map_rows(docs, _redact_kernel(train(), docs.columns.index(text)), shape)
