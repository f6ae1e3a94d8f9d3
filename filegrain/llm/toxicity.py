"""Toxicity by a factorization machine over hashed terms.

score = logistic(bias + sum of term weights + sum over pairs of terms of the dot
product of their factors): a pair such as an insult with a group mention can weigh
more than its two words do. Terms are the distinct words of the whole text in
lower case and the beginnings of longer words, hashed into ``BUCKETS``.

A null or empty text has no terms and gets the score of the bias. Long texts are read
in pieces, whole. Learning uses at most about ``per_label`` rows of each label, and of a
sampled row's pairs those of ``PAIR_TERMS`` of its terms; every row is scored, with all its
terms. Terms carry weight if sampled rows show that they tell something of the label, by
themselves or together with another one: what matters only in company is kept.
A row that repeats is scored as often; of two labels of one id the toxic one counts. An empty
table gives no rows; without labelled rows all scores are 0. A score of exactly one half is
toxic. Other columns of the tables are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filegrain.llm.common import bounded_sample, held_out, map_arrow

BUCKETS = 1 << 18
FACTORS = 4
#: Lengths of word beginnings that are terms too: insults take endings.
STEMS = (4, 6)
#: Rows that must hold a term, or a pair, and standard errors by which its share of toxic rows must differ.
LEAST_ROWS, LEAST_Z = 3, 3.0
PAIR_ROWS, PAIR_Z = 12, 6.0
#: Terms of a sampled row whose pairs are counted, and the counters that sort out most pairs before they are counted exactly.
PAIR_TERMS, PAIR_COUNTERS = 128, 1 << 21
#: Kinds of pairs, and pairs that wait to be counted, that are held at once.
PAIRS_AT_ONCE = 1 << 20
PIECE = 1 << 20
WORD = re.compile(r"[^\W\d_]+")


def pieces(text: str) -> Iterator[str]:
    """A long text in parts that end at a blank, so that no word is cut."""
    at = 0
    while at < len(text):
        end = text.find(" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def terms(text: str | None) -> np.ndarray:
    """The hashed distinct words, sorted."""
    words: set[str] = set()
    for piece in pieces(text or ""):
        words.update(WORD.findall(piece.lower()))
    words |= {w[:n] + "-" for w in words for n in STEMS if len(w) > n}
    return np.unique(np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words)) % BUCKETS)


def _surprise(bad: np.ndarray, n: np.ndarray, share: np.ndarray | float) -> np.ndarray:
    """By how many standard errors the toxic rows among ``n`` differ from ``share``."""
    share = np.clip(share, 1e-3, 1 - 1e-3)
    return (bad - n * share) / np.sqrt(np.maximum(n, 1) * share * (1 - share))


def _counts(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the sampled rows that hold it, and the toxic ones."""
    def count(some: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(BUCKETS, np.int64)
        for at in range(0, len(some), 256):
            out += np.bincount(np.concatenate(some[at : at + 256]), minlength=BUCKETS)
        return out

    return count(rows), count([r for r, v in zip(rows, y, strict=True) if v == 1])


def telling(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Which buckets tell something of the label by themselves."""
    n, bad = _counts(rows, y)
    return (n >= LEAST_ROWS) & (np.abs(_surprise(bad, n, y.mean())) >= LEAST_Z)


def _counter(codes: np.ndarray) -> np.ndarray:
    """The counter that a pair shares with others."""
    return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)


def _tallied(marks: np.ndarray, times: np.ndarray, waiting: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct marks and how often they came, with those that waited."""
    fresh, n = np.unique(np.concatenate(waiting), return_counts=True)
    marks, where = np.unique(np.concatenate([marks, fresh]), return_inverse=True)
    return marks, np.bincount(where, np.concatenate([times, n]), len(marks)).astype(np.int64)


def _exact_counts(pairs: Callable[[], Iterable[tuple[float, np.ndarray]]], out: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, rows, toxic rows) of all pairs whose counter is in ``out``, in parts. Where there are more kinds of pairs than
    are held at once, half of the counters wait for another reading of the pairs."""
    todo = [(0, len(out))]
    while todo:
        low, high = todo.pop()
        if not out[low:high].any():
            continue
        marks, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting, n = [marks], 0
        for v, codes in pairs():
            at = _counter(codes)
            waiting.append(codes[out[at] & (at >= low) & (at < high)] * 2 + int(v == 1))
            n += len(waiting[-1])
            if n < PAIRS_AT_ONCE:
                continue
            marks, times = _tallied(marks, times, waiting)
            waiting, n = [marks[:0]], 0
            while len(marks) > PAIRS_AT_ONCE and high - low > 1:
                todo.append(((low + high) // 2, high))
                high = (low + high) // 2
                stay = _counter(marks >> 1) < high
                marks, times = marks[stay], times[stay]
        marks, times = _tallied(marks, times, waiting)
        codes, where = np.unique(marks >> 1, return_inverse=True)
        yield codes, np.bincount(where, times, len(codes)), np.bincount(where, times * (marks & 1), len(codes))


def telling_together(rows: list[np.ndarray], y: np.ndarray, seed: int = 3) -> np.ndarray:
    """Which buckets do so in a pair: one that differs from all rows, and from the rows of either of its two terms.

    Pairs are counted twice: all of them in a fixed number of counters, several to a
    counter, then exactly those whose counter stands out, so many kinds at once as fit."""
    n, bad = _counts(rows, y)
    rng = np.random.default_rng(seed)

    def drawn(r: np.ndarray) -> np.ndarray:
        r = r[n[r] >= PAIR_ROWS].astype(np.int64)
        return np.sort(rng.choice(r, PAIR_TERMS, replace=False)) if len(r) > PAIR_TERMS else r

    common = [drawn(r) for r in rows]

    def pairs() -> Iterator[tuple[float, np.ndarray]]:
        for r, v in zip(common, y, strict=True):
            i, j = np.triu_indices(len(r), 1)
            yield v, r[i] * BUCKETS + r[j]

    held, toxic = np.zeros(PAIR_COUNTERS, np.int32), np.zeros(PAIR_COUNTERS, np.int32)
    for v, codes in pairs():  # a row's pairs are distinct, but several may share a counter
        at, times = np.unique(_counter(codes), return_counts=True)
        held[at] += times.astype(np.int32)
        if v == 1:
            toxic[at] += times.astype(np.int32)
    out = np.zeros(PAIR_COUNTERS, bool)
    for at in range(0, PAIR_COUNTERS, 1 << 17):  # the driver holds little beside the counters
        some = slice(at, at + (1 << 17))
        out[some] = (held[some] >= PAIR_ROWS) & (np.abs(_surprise(toxic[some], held[some], y.mean())) >= PAIR_Z / 2)
    del held, toxic
    buckets = np.zeros(BUCKETS, bool)
    share = lambda t: bad[t] / np.maximum(n[t], 1)
    for codes, both, worse in _exact_counts(pairs, out):
        one, other = codes // BUCKETS, codes % BUCKETS
        least = np.min([np.abs(_surprise(worse, both, x)) for x in (np.full(len(codes), y.mean()), share(one), share(other))], axis=0)
        kept = (both >= PAIR_ROWS) & (least >= PAIR_Z)
        buckets[one[kept]] = buckets[other[kept]] = True
    return buckets


@dataclass
class FactorizationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(rows), self.bias)
        for i, idx in enumerate(rows):
            if len(idx):
                v = self.factors[idx]
                out[i] += self.linear[idx].sum() + 0.5 * (v.sum(0) ** 2 - (v * v).sum(0)).sum()
        return out

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margins(rows), -30, 30)))

    @classmethod
    def fit(cls, rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 20, batch: int = 64, rate: float = 0.2, decay: float = 2e-4, seed: int = 7) -> FactorizationMachine:
        """Logistic loss, adaptive gradient steps over shuffled batches, decay on every touched parameter."""
        rng = np.random.default_rng(seed)
        held = telling(rows, y) | telling_together(rows, y)
        rows = [r[held[r]] for r in rows]
        share = float(np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3))
        bias, linear = float(np.log(share / (1 - share))), np.zeros(BUCKETS)
        factors = rng.normal(0, 0.05, (BUCKETS, FACTORS)) * held[:, None]
        grown_l, grown_v, grown_b = np.full(BUCKETS, 1e-2), np.full((BUCKETS, FACTORS), 1e-2), 1e-2
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                take = order[at : at + batch]
                idx = np.concatenate([rows[i] for i in take])
                of = np.repeat(np.arange(len(take)), [len(rows[i]) for i in take])
                v = factors[idx]
                sums = np.stack([np.bincount(of, v[:, f], len(take)) for f in range(FACTORS)], 1)
                squares = np.bincount(of, (v * v).sum(1), len(take))
                margin = bias + np.bincount(of, linear[idx], len(take)) + 0.5 * ((sums**2).sum(1) - squares)
                error = (1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30))) - y[take]) * weight[take] / len(take)
                touched, where = np.unique(idx, return_inverse=True)
                g = np.bincount(where, error[of], len(touched)) + decay * linear[touched]
                grown_l[touched] += g * g
                linear[touched] -= rate * g / np.sqrt(grown_l[touched])
                pair = error[of, None] * (sums[of] - v)
                for f in range(FACTORS):
                    g = np.bincount(where, pair[:, f], len(touched)) + decay * factors[touched, f]
                    grown_v[touched, f] += g * g
                    factors[touched, f] -= 0.3 * rate * g / np.sqrt(grown_v[touched, f])
                grown_b += error.sum() ** 2
                bias -= 0.1 * rate * error.sum() / np.sqrt(grown_b)
        return cls(bias, linear, factors)


def learn(docs: DataFrame, labels: DataFrame, per_label: int = 6000) -> FactorizationMachine | None:
    """None where there are no labelled rows. Learns only from ids that are not held out.

    The sample is drawn from the labels; at most about 2 * ``per_label`` ids meet the
    documents, as a broadcast of that bound, so texts stay where they are. Rows of one
    label weigh what they weigh in the whole table of labels.
    """
    marks = (
        labels.select(F.col("doc_id").alias("k"), F.col("toxic").cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & ~held_out(F.col("k"))).groupBy("k").agg(F.max("y").alias("y"))
    )
    counts = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    drawn_ids = F.broadcast(bounded_sample(marks, "y", "k", per_label))
    drawn_rows = docs.select(F.col("doc_id").alias("k"), F.col("text").alias("t")).join(drawn_ids, "k").select("t", "y")

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([terms(t).astype(np.int32).tobytes() for t in batch["t"].to_pylist()], pa.binary()), batch["y"]], ["x", "y"])

    got = [(bytes(r.x), r.y) for r in map_arrow(drawn_rows, features, "x binary, y int").collect()]
    if not got:
        return None
    got.sort()  # the same model however the rows arrive
    y = np.array([r[1] for r in got], dtype=float)
    drawn = {v: max((y == v).sum(), 1) for v in (0, 1)}
    weight = np.array([counts[int(v)] / drawn[int(v)] for v in y])
    return FactorizationMachine.fit([np.frombuffer(r[0], np.int32) for r in got], y, weight / weight.mean())


def _scores(model: FactorizationMachine | None, texts: list[str | None]) -> np.ndarray:
    return model.scores([terms(t) for t in texts]) if model else np.zeros(len(texts))


def score_texts(docs: DataFrame, model: FactorizationMachine | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of each row; 0 everywhere where nothing could be learned."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch[key], pa.array(_scores(model, batch[text].to_pylist()))], [key, "score"])

    return map_arrow(docs.select(key, text), run, f"`{key}` {kind}, score double")


def toxicity_table(docs: DataFrame, labels: DataFrame, per_label: int = 6000) -> DataFrame:
    """(doc_id, held_out, score, predicted): learned from labelled rows that are not held out, scored for all."""
    model = learn(docs, labels, per_label)
    return score_texts(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose text scores below one half, judged where they stand; all columns stay as they are."""
    model = learn(docs, labels)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(_scores(model, batch["text"].to_pylist()) < 0.5))

    return map_arrow(docs, keep, docs.schema)
