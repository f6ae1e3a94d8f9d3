"""Secrets in texts: three patterns, and a linear-chain conditional random field that adds to them.

Texts become tokens: runs of letters, digits and ``_ + / -``, and every other visible
character by itself. Each token is tagged as the begin of a secret, inside one or outside,
by the best path of a chain whose scores sum weights of the token's shape, the words
around it, features of the whole file and the tags' transitions.

The field learns from windows of tokens in a sample of at most about ``sample`` documents,
marked with what the patterns find there; windows without a finding centre on tokens with
digits, long ones and random ones. Copies without their neighbouring words, and with those of
other windows, teach it shapes. All texts
are tagged in full where they stand, without a shuffle: the weights are a table of fixed size.

Decoding is exact without walking every token. Where outside beats both other tags by more
than transitions can give back, the best path is outside; between such tokens it does not
depend on what lies beyond them. So scores are worked out for whole arrays of tokens, and
Viterbi runs over the stretches in doubt, with an outside tag at either end.

A finding of a pattern spans its whole match, key word included; a match too short is dropped
and the search goes on behind it. A tagged secret that touches no such finding is added as
kind ``field``. Nulls and empty texts hold nothing. Very long texts are whole: characters are
read in pieces that end at white space, tags run over the whole text. Rows that repeat are
judged one by one; a null id is kept. An empty table, or one whose sample holds no finding,
has no field. Offsets count code points, ends exclusive; ties in score go to outside, then
to begin. Other columns of the table are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filegrain.llm.common import map_arrow, unit_hash
from filegrain.session import ship_package

KINDS = ("assign", "access", "hex", "field")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KEY_WORDS = ("password", "passwd", "secret", "token", "api")
LEAST = {"assign": 12, "access": 18}

#: Bounds of what is learned from: documents, windows of a document, windows in all; one in PLAIN documents without a finding.
SAMPLE, WINDOWS, FITTED, PLAIN = 10_000, 4, 6_000, 8
REACH = 12  # tokens on either side of a window's centre
PIECE = 1 << 20  # characters
BLOCK = 1 << 18  # tokens

OUTSIDE, BEGIN, INSIDE = range(3)

# ---- tokens -------------------------------------------------------------------------------

SPACE, SMALL, CAPITAL, DIGIT, JOINER, FOREIGN, MARK = range(7)
_KIND = np.full(129, MARK, np.uint8)
_KIND[:33] = SPACE
_KIND[[*range(97, 123)]] = SMALL
_KIND[[*range(65, 91)]] = CAPITAL
_KIND[[*range(48, 58)]] = DIGIT
_KIND[[ord(c) for c in "_+/-"]] = JOINER
_KIND[128] = FOREIGN
_IS_HEX = np.zeros(129, np.int32)
_IS_HEX[[*range(48, 58), *range(97, 103)]] = 1

_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Upper bounds of lengths, of shares in sixteenths.
_LENGTH = np.digitize(np.arange(130), [2, 3, 4, 6, 8, 10, 12, 14, 16, 18, 20, 24, 32, 40, 64, 128]).astype(np.int32)
_ROUGH_LENGTH = np.digitize(np.arange(130), [8, 12]).astype(np.int32)
_CHANGES = np.digitize(np.arange(17), [1, 2, 4, 7]).astype(np.int32)
_SHARE = np.digitize(np.arange(17), [1, 3, 6, 10, 14]).astype(np.int32)

WORDS = 4096
LENGTHS, COMPOSITIONS, SHARES = 17, 32, 6
#: Where each group of features begins in the table of weights; the last entry is the table's size.
_SIZES = {
    "rough": 30, "shape": LENGTHS * COMPOSITIONS, "mix": SHARES * SHARES * LENGTHS, "mark": 3 * 129, "before": WORDS, "before2": WORDS, "before3": WORDS, "behind": WORDS,
    "shape_before": COMPOSITIONS, "shape_behind": COMPOSITIONS, "file": 64, "none": 1,
}
AT = dict(zip(_SIZES, np.cumsum([0, *_SIZES.values()]).tolist()))
FEATURES = sum(_SIZES.values())
NONE = AT["none"]
NEIGHBOURS = ("before", "before2", "before3", "behind", "shape_before", "shape_behind")


@dataclass
class Tokens:
    """Of some texts joined: where each token starts and ends, its own features, its word's place among WORDS."""

    start: np.ndarray
    end: np.ndarray
    rough: np.ndarray
    shape: np.ndarray
    mix: np.ndarray
    mark: np.ndarray
    word: np.ndarray
    doc: np.ndarray
    file: np.ndarray

    def __len__(self) -> int:
        return len(self.start)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of an odd number and its inverse modulo 2^64; places in a text weigh its characters' codes."""
    return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x)])) for x in (_STEP, _STEP_BACK))


def _read(text: str) -> tuple[np.ndarray, ...]:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    plain = np.minimum(codes, 128)
    kinds = _KIND[plain]
    inner = (kinds != SPACE) & (kinds != MARK)
    edge = np.diff(inner.astype(np.int8), prepend=0, append=0)
    marks = kinds == MARK
    begins = (edge[:-1] == 1) | marks
    start = np.flatnonzero(begins)
    end = np.flatnonzero((edge[1:] == -1) | marks) + 1
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    length = end - start
    of_kind = {k: np.add.reduceat(kinds == k, start, dtype=np.int32) for k in (SMALL, CAPITAL, DIGIT, JOINER, FOREIGN)}
    changed = np.zeros(len(kinds), bool)
    changed[1:] = (kinds[1:] != kinds[:-1]) & inner[1:] & inner[:-1]
    changes = np.add.reduceat(changed, start, dtype=np.int32)
    composition = sum((of_kind[k] > 0).astype(np.int32) << i for i, k in enumerate(of_kind))
    long = _LENGTH[np.minimum(length, 129)]
    mix = (_SHARE[16 * of_kind[DIGIT] // length] * SHARES + _SHARE[np.minimum(16, 16 * changes // length)]) * LENGTHS + long
    rough = (_CHANGES[np.minimum(changes, 16)] * 3 + _ROUGH_LENGTH[np.minimum(length, 129)]) * 2 + (of_kind[DIGIT] > 0)
    hexed = np.add.reduceat(_IS_HEX[plain], start) == length
    mark = np.where(marks[start], plain[start], 129 + np.where(hexed, 129 + np.minimum(length, 128), np.minimum(length, 128))).astype(np.int32)
    powers, back = (p[: len(codes)] for p in _powers(max(PIECE, 1 << (len(codes) - 1).bit_length())))
    lower = codes.astype(np.uint64) + np.where(kinds == CAPITAL, np.uint64(32), np.uint64(0))
    word = np.add.reduceat(np.where(kinds == SPACE, np.uint64(0), lower * powers), start) * back[start]
    word = ((word ^ (word >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(52)
    return start, end, rough, long * COMPOSITIONS + composition, mix, mark, word.astype(np.int32)


def tokens_of(texts: list[str]) -> Tokens:
    """The texts' tokens, starts counted from the first text's begin; behind every text one place is left free."""
    joined = "\n".join([*texts, ""])
    parts, at = [], 0
    while at < len(joined):
        end = at + PIECE
        while end < len(joined) and joined[end] not in "\n ":
            end += 1
        start, stop, *rest = _read(joined[at:end])
        parts.append((start + at, stop + at, *rest))
        at = end
    start, end, rough, shape, mix, mark, word = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64) for _ in range(7))
    firsts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    doc = np.searchsorted(firsts, start, "right") - 1
    n = len(texts)
    total = np.maximum(np.bincount(doc, minlength=n), 1)

    def quarter(hit: np.ndarray, bounds: list[float]) -> np.ndarray:
        return np.digitize(np.bincount(doc, hit, n) / total, bounds)

    file = quarter(mark < 129, [0.05, 0.15, 0.3]) * 16 + quarter((mark == ord("=")) | (mark == ord(":")), [0.001, 0.01, 0.05]) * 4 + quarter((shape % COMPOSITIONS) & 4 > 0, [0.005, 0.03, 0.1])
    return Tokens(start, end, rough, shape, mix, mark, word, doc, file)


def features(t: Tokens, at: np.ndarray) -> np.ndarray:
    """The features of the tokens at the given places, a row for each kind; NONE where there is no neighbour."""
    rows = [AT["rough"] + t.rough[at], AT["shape"] + t.shape[at], AT["mix"] + t.mix[at], AT["mark"] + t.mark[at], AT["file"] + t.file[t.doc[at]]]
    for name, step in (("before", -1), ("before2", -2), ("before3", -3), ("behind", 1), ("shape_before", -1), ("shape_behind", 1)):
        near = np.clip(at + step, 0, len(t) - 1)
        there = (t.doc[near] == t.doc[at]) & (near == at + step)
        rows.append(np.where(there, AT[name] + (t.shape[near] % COMPOSITIONS if name.startswith("shape") else t.word[near]), NONE))
    return np.array(rows, dtype=np.int32)


# ---- the patterns -------------------------------------------------------------------------


def matches(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, where the secret itself starts) of each finding, in order."""
    found = [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    low = text.lower()
    if any(w in low for w in KEY_WORDS):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    return sorted(found)


# ---- the field ----------------------------------------------------------------------------


@dataclass
class Field:
    weights: np.ndarray  # FEATURES x 3
    moves: np.ndarray  # 3 x 3, from a tag to the next

    def scores(self, t: Tokens, at: np.ndarray) -> np.ndarray:
        rows = features(t, at)
        out = self.weights[rows[0]]
        for row in rows[1:]:
            out += self.weights[row]
        return out

    @property
    def slack(self) -> float:
        """The most that a tag other than outside can gain by the transitions around it."""
        m = self.moves
        return float(max((m[p, y] + m[y, n] - m[p, OUTSIDE] - m[OUTSIDE, n]) for y in (BEGIN, INSIDE) for p in range(3) for n in range(3)))

    def best_path(self, scores: np.ndarray) -> list[int]:
        """Tags of a stretch with an outside tag at either end."""
        value = self.moves[OUTSIDE] + scores[0]
        back = []
        for row in scores[1:]:
            ways = value[:, None] + self.moves
            back.append(ways.argmax(0))
            value = ways.max(0) + row
        path = [int((value + self.moves[:, OUTSIDE]).argmax())]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        return path[::-1]

    def tags(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """(place, tag) of the tokens that are not outside."""
        doubtful, scored = [], []
        slack = self.slack
        for a in range(0, len(t), BLOCK):
            at = np.arange(a, min(a + BLOCK, len(t)))
            scores = self.scores(t, at)
            open_ = scores[:, OUTSIDE] - np.maximum(scores[:, BEGIN], scores[:, INSIDE]) <= slack
            doubtful.append(at[open_])
            scored.append(scores[open_])
        if not doubtful or not len(places := np.concatenate(doubtful)):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        scores = np.concatenate(scored).astype(np.float64)
        apart = (np.diff(places) != 1) | (np.diff(t.doc[places]) != 0)
        bounds = [0, *(np.flatnonzero(apart) + 1).tolist(), len(places)]
        tags = np.concatenate([self.best_path(scores[a:b]) for a, b in zip(bounds, bounds[1:])])
        return places[tags != OUTSIDE], tags[tags != OUTSIDE]

    def spans(self, t: Tokens) -> Iterator[tuple[int, int, int]]:
        """(doc, start, end): a begin, or an inside without one, and the insides that follow."""
        places, tags = self.tags(t)
        if not len(places):
            return
        new = np.ones(len(places), bool)
        new[1:] = (tags[1:] == BEGIN) | (np.diff(places) != 1) | (np.diff(t.doc[places]) != 0)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(places)) - 1
        yield from zip(t.doc[places[first]].tolist(), t.start[places[first]].tolist(), t.end[places[last]].tolist())


def fit(rows: np.ndarray, labels: np.ndarray, steps: int = 80, rate: float = 0.15, decay: float = 2e-4) -> Field:
    """By the likelihood of whole windows. ``rows``: window x token x feature; ``labels``: -1 beyond a text's end."""
    n, size, _ = rows.shape
    weights, moves = np.zeros((FEATURES, 3)), np.zeros((3, 3))
    weights[:, OUTSIDE] = 0.05
    empty = labels < 0
    wanted = np.eye(3)[np.where(empty, OUTSIDE, labels)]
    ends = np.zeros((n, 1), np.int64)
    path = np.concatenate([ends, np.where(empty, OUTSIDE, labels), ends], axis=1)
    moved = np.bincount((path[:, :-1] * 3 + path[:, 1:]).ravel(), minlength=9).reshape(3, 3)
    flat = rows.reshape(n * size, -1)
    first, second = [np.zeros_like(weights), np.zeros_like(moves)], [np.zeros_like(weights), np.zeros_like(moves)]

    def total(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))

    for step in range(1, steps + 1):
        scores = weights[flat].sum(1).reshape(n, size, 3)
        scores[empty] = (0.0, -50.0, -50.0)
        ahead, behind = np.empty((size, n, 3)), np.empty((size, n, 3))
        ahead[0] = moves[OUTSIDE] + scores[:, 0]
        for k in range(1, size):
            ahead[k] = total(ahead[k - 1][:, :, None] + moves, 1) + scores[:, k]
        behind[-1] = moves[:, OUTSIDE]
        for k in range(size - 2, -1, -1):
            behind[k] = total(moves + (behind[k + 1] + scores[:, k + 1])[:, None, :], 2)
        whole = total(ahead[-1] + behind[-1], 1)
        chance = np.exp(ahead + behind - whole[:, None]).transpose(1, 0, 2)
        steps_taken = sum(
            np.exp(ahead[k - 1][:, :, None] + moves + (behind[k] + scores[:, k])[:, None, :] - whole[:, None, None]).sum(0) for k in range(1, size)
        )
        steps_taken[OUTSIDE] += chance[:, 0].sum(0)
        steps_taken[:, OUTSIDE] += chance[:, -1].sum(0)
        off = (chance - wanted)
        off[empty] = 0
        slope = np.stack([np.bincount(flat.ravel(), np.repeat(off[..., y].ravel(), flat.shape[1]), FEATURES) for y in range(3)], axis=1)
        for i, (value, gradient) in enumerate(((weights, slope / n + decay * weights), (moves, (steps_taken - moved) / n + decay * moves))):
            first[i] = 0.9 * first[i] + 0.1 * gradient
            second[i] = 0.999 * second[i] + 0.001 * gradient**2
            value -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        weights[NONE] = 0
    return Field(weights.astype(np.float32), moves)


def _windows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(features, labels) of some windows of each text: around findings, around odd tokens, and anywhere."""
    out_rows, out_labels = [], []
    for text in batch["text"].to_pylist():
        if not text or not len(t := tokens_of([text])):
            continue
        labels = np.zeros(len(t), np.int8)
        centres = []
        for _, _, end, secret in matches(text):
            covered = np.flatnonzero((t.start < end) & (t.end > secret))
            labels[covered] = INSIDE
            labels[covered[:1]] = BEGIN
            centres += covered[:1].tolist()
        draw = np.random.default_rng(len(text))
        if centres:
            centres = draw.permutation(centres)[:WINDOWS].tolist()
        elif draw.random() < 1 / PLAIN or len(text) < 200:
            odd = np.flatnonzero(((t.shape % COMPOSITIONS) & 4 > 0) | (t.end - t.start >= 14) | (t.mark == ord("=")))
            centres = [*draw.permutation(odd)[: WINDOWS - 1].tolist(), int(draw.integers(len(t)))]
        for centre in centres:
            places = np.arange(centre - REACH, centre + REACH + 1)
            there = (places >= 0) & (places < len(t))
            inside = np.clip(places, 0, len(t) - 1)
            label = np.where(there, labels[inside], -1)
            if label[0] > 0 or (there[-1] and places[-1] + 1 < len(t) and labels[places[-1] + 1] == INSIDE):
                continue  # a secret would cross the window's edge
            out_rows.append(np.where(there, features(t, inside), NONE).T.astype(np.int32).tobytes())
            out_labels.append(label.astype(np.int8).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(out_rows, pa.binary()), pa.array(out_labels, pa.binary())], ["features", "labels"])


def with_other_surroundings(rows: np.ndarray, labels: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows, and the marked ones twice more: with neighbours of nothing, and with those of any other window. So a
    shape counts by itself, and among words that no finding had around it."""
    alone = rows[marked].copy()
    alone[:, :, -len(NEIGHBOURS):] = NONE
    moved = rows[marked].copy()
    moved[:, :, -len(NEIGHBOURS):] = rows[np.random.default_rng(1).integers(0, len(rows), len(moved))][:, :, -len(NEIGHBOURS):]
    return np.concatenate([rows, alone, moved]), np.concatenate([labels, labels[marked], labels[marked]])


def learned(docs: DataFrame, key: str, text: str, sample: int = SAMPLE) -> Field | None:
    """A field from at most about ``sample`` documents, chosen by their ids' hashes."""
    n = docs.count()
    chosen = docs.where(F.col(key).isNotNull() & (unit_hash(F.col(key), 11) < F.lit(min(1.0, sample / max(n, 1))))).select(F.col(text).alias("text"))
    windows = map_arrow(chosen, _windows, "features binary, labels binary").toArrow()
    if not windows.num_rows:
        return None
    labels = np.array([np.frombuffer(x.as_py(), np.int8) for x in windows["labels"]])
    if not (labels == BEGIN).any():
        return None
    rows = np.array([np.frombuffer(x.as_py(), np.int32) for x in windows["features"]]).reshape(*labels.shape, -1)
    chosen = np.random.default_rng(0).permutation(len(rows))[:FITTED]
    rows, labels = rows[chosen], labels[chosen]
    marked = (labels > 0).any(1)
    if not marked.any():
        return None
    return fit(*with_other_surroundings(rows, labels, marked))


# ---- all texts ----------------------------------------------------------------------------


def spans_of(texts: list[str], field: Field | None) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) of each text, by start, then kind."""
    found = [[(k, a, b) for a, k, b, _ in matches(text)] for text in texts]
    if field is not None:
        firsts = np.cumsum([0, *(len(x) + 1 for x in texts)]).tolist()
        for doc, start, end in field.spans(tokens_of(texts)):
            start, end = start - firsts[doc], end - firsts[doc]
            if all(b <= start or end <= a for k, a, b in found[doc] if k < 3):
                found[doc].append((3, start, end))
    return [sorted(x, key=lambda s: (s[1], s[0], s[2])) for x in found]


def _scan(field: Field | None, batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = [x or "" for x in batch["text"].to_pylist()]
    out: list[list[tuple[int, int, int]]] = []
    at = 0
    while at < len(texts):  # about PIECE characters at a time, a longer text by itself
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) < PIECE:
            size += len(texts[end])
            end += 1
        out += spans_of(texts[at:end], field)
        at = end
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    spans = pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in x] for x in out], pa.list_(kind))
    return pa.RecordBatch.from_arrays([batch["key"], spans], ["key", "spans"])


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(key, spans) of each row: kind, start and end of each secret in its text."""
    ship_package()
    field = learned(docs, key, text, sample)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    found = map_arrow(rows, partial(_scan, field), f"key {docs.schema[key].dataType.simpleString()}, spans {spans}")
    return found.withColumnRenamed("key", key)


def secret_digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, the checksum of the patterns' spans and the list of all spans, from (key, spans)."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return found.select(
        key, *[number(k).alias(f"n_{k}") for k in KINDS], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, mask: str = "[secret]") -> DataFrame:
    """The rows with each secret replaced. Spans are joined to nothing: they are found and cut where the text stands."""
    ship_package()
    field = learned(docs, key, text, sample)
    names = docs.columns

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch[text].to_pylist()
        out = []
        for value in texts:
            if value:
                parts, at = [], 0
                for _, a, b in spans_of([value], field)[0]:
                    if a >= at:
                        parts += [value[at:a], mask]
                    at = max(at, b)
                value = "".join([*parts, value[at:]])
            out.append(value)
        return pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == text else batch[n] for n in names], names)

    return map_arrow(docs, cut, docs.schema)
