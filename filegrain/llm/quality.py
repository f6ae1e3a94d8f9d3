"""Document quality by co-training.

Two classifiers see the same documents from two sides: one the characters of the
text, one the page's metadata (source, language, length, line layout). Both learn
from the labelled rows; then, round by round, each labels the unlabelled rows it is
surest of for the other to learn from. At the end each view is calibrated on labelled
rows that no round has trained on, and the calibrated views are combined.

Learning uses at most about ``per_label`` labelled rows of each label. All unlabelled rows
take part: each round is a pass over them that scores both views where the rows stand,
and the ``EXCHANGED`` surest of all are handed over. Every row is scored at the end.

A null or empty text, and null metadata, are values like others. Very long texts are read in
pieces, whole. Repeated rows are scored one by one; of rows of one id that a round picks one is
learned from. Ties in sureness go to the smaller id; of two labels of one id the lower one
counts. An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import operator
import zlib
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filegrain.llm.common import bounded_sample, held_out, map_arrow, written

TEXT_DIMENSIONS, PAGE_DIMENSIONS = 2048, 256
PIECE = 1 << 20
#: So many character groups halve a vector's squared length; shares of repeated words and lines that count.
SHORT_GRAMS, REPETITION_BINS = 300, (0.05, 0.2, 0.5)
ROUNDS, SURE, EXCHANGED = 5, 0.9, 400
CALIBRATION_PART = 4  # one labelled row in four
COSTS = {"text": 200.0, "page": 20.0}


def repetition(text: str) -> tuple[float, float]:
    """Share of words that repeat the word before, and of lines that repeat the line before."""
    out = []
    for parts in (text.split(), text.split("\n")):
        out.append(sum(map(operator.eq, parts, islice(parts, 1, None))) / max(len(parts), 1))
    return out[0], out[1]


def text_features(text: str | None) -> np.ndarray:
    """Square-rooted counts of hashed groups of one to three characters, case and signs included, and bins of
    repetition. Vectors of long texts have length 1; those of a few words are shorter, as they say less."""
    counts = np.zeros(TEXT_DIMENSIONS, dtype=np.float64)
    text = text or ""
    for at in range(0, len(text), PIECE):
        c = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        one = c * np.uint64(0x9E3779B97F4A7C15)
        two = one[:-1] + c[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        three = two[:-1] + c[2:] * np.uint64(0x165667B19E3779F9)
        for salt, group in ((1, one), (2, two), (3, three)):
            group = (group ^ (group >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * salt)
            counts += np.bincount((group >> np.uint64(53)).astype(np.int64), minlength=TEXT_DIMENSIONS)
    grams = np.sqrt(counts) / np.sqrt(counts.sum() + SHORT_GRAMS)
    bins = np.array([share >= least for share in repetition(text) for least in REPETITION_BINS])
    return np.concatenate([grams, 0.3 * bins]).astype(np.float32)


def page_features(text: str | None, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Hashed source and language, bins of length, of the number of lines and of the mean line length."""
    size = n_chars if n_chars is not None else len(text or "")
    lines = (text or "").count("\n") + 1
    bins = (f"s{source}", f"l{lang}", f"n{int(2 * np.log2(1 + max(size, 0)))}", f"r{int(2 * np.log2(lines))}", f"m{int(2 * np.log2(1 + max(size, 0) / lines))}")
    out = np.zeros(PAGE_DIMENSIONS, dtype=np.float32)
    for b in bins:
        out[zlib.crc32(b.encode("utf-8", "surrogatepass")) % PAGE_DIMENSIONS] += 0.45
    return out


@dataclass
class Logistic:
    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, cost: float, rounds: int = 150) -> Logistic:
        """Accelerated gradient descent. The bias is the labels' log odds, not learned: a text that says little
        is judged by the rule, not by what the long ones need as a counterweight."""
        good = np.clip(y.mean(), 1e-2, 1 - 1e-2)
        w, v, b = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), float(np.log(good / (1 - good)))
        step = 1.0 / (1.0 + 0.5 * cost)
        for k in range(rounds):
            ahead = w + k / (k + 3.0) * v
            error = ((logistic(x @ ahead + b) - y) / max(len(y), 1)).astype(np.float32)
            new = (ahead - step * (ahead + cost * (error @ x))).astype(np.float32)
            v, w = new - w, new
        return cls(w, b)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Scale and shift of the margin by Newton steps on a lightly penalised logistic loss, labels at their shares."""
        margin = x @ self.weights + self.bias
        a = np.array([1.0, 0.0])
        z = np.stack([margin, np.ones_like(margin)], 1).astype(np.float64)
        for _ in range(30):
            p = 1.0 / (1.0 + np.exp(-np.clip(z @ a, -30, 30)))
            hessian = (z * (p * (1 - p))[:, None]).T @ z + np.eye(2)
            a = a - np.clip(np.linalg.solve(hessian, z.T @ (p - y) + (a - [1.0, 0.0])), -2, 2)
        self.scale, self.shift = max(float(a[0]), 1e-3), float(a[1])

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.scale * (x @ self.weights + self.bias) + self.shift


def logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class CoTrained:
    text: Logistic
    page: Logistic
    mix: np.ndarray  # weight of the text's margin, of the page's margin, intercept

    def scores(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, p = self.text.margin(text), self.page.margin(page)
        return logistic(self.mix[0] * t + self.mix[1] * p + self.mix[2]), logistic(t), logistic(p)


@dataclass
class Lesson:
    """What both views learn from: labelled rows, some of them set aside for calibration, and what the other view has told."""

    views: dict[str, np.ndarray]
    y: np.ndarray
    told: dict[str, list[tuple[object, np.ndarray, int]]]  # id, features, label

    @property
    def aside(self) -> np.ndarray:
        return np.arange(len(self.y)) % CALIBRATION_PART == 0

    def models(self) -> dict[str, Logistic]:
        out = {}
        for view, x in self.views.items():
            told = self.told[view]
            rows = np.concatenate([x[~self.aside], np.array([t[1] for t in told], np.float32).reshape(-1, x.shape[1])])
            out[view] = Logistic.fit(rows, np.concatenate([self.y[~self.aside], [t[2] for t in told]]).astype(np.float32), COSTS[view])
            out[view].calibrate(x[self.aside], self.y[self.aside])
        return out

    def combined(self) -> CoTrained:
        models, y = self.models(), self.y[self.aside]
        z = np.stack([*(models[v].margin(self.views[v][self.aside]) for v in ("text", "page")), np.ones(len(y))], 1)
        mix = np.array([0.5, 0.5, 0.0])
        for _ in range(30):
            p = logistic(z @ mix)
            mix = mix - np.clip(np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.eye(3), z.T @ (p - y) + (mix - [0.5, 0.5, 0.0])), -1, 1)
        return CoTrained(models["text"], models["page"], mix)


COLUMNS = ("text", "lang", "source", "n_chars")


def _features(batch: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray]]:
    rows = list(zip(*[batch[c].to_pylist() for c in COLUMNS], strict=True))
    return [text_features(r[0]) for r in rows], [page_features(*r) for r in rows]


def _rows_of(docs: DataFrame, ids: DataFrame) -> list:
    """(k, features of both views, y) of the rows of some ids, as bounded as these, in an order of their own."""
    rows = docs.select(F.col("doc_id").alias("k"), *COLUMNS).join(F.broadcast(ids), "k")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        text, page = _features(batch)
        return pa.RecordBatch.from_arrays(
            [batch["k"], pa.array([v.tobytes() for v in text], pa.binary()), pa.array([v.tobytes() for v in page], pa.binary()), batch["y"]], ["k", "text", "page", "y"]
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = map_arrow(rows, run, f"k {kind}, text binary, page binary, y int").collect()
    return sorted(got, key=lambda r: (zlib.crc32(str(r.k).encode()), r.k))  # the same model however the rows arrive


def surest(docs: DataFrame, labels: DataFrame, lesson: Lesson) -> list[tuple[str, object, int]]:
    """(view to be told, id, label): what each view is surest of among all unlabelled rows that are not held out."""
    models = lesson.models()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        text, page = map(np.array, _features(batch))
        sure = [logistic(models[v].margin(x)).astype(np.float64) if len(x) else np.zeros(0) for v, x in (("text", text), ("page", page))]
        return pa.RecordBatch.from_arrays([batch["k"], *map(pa.array, sure)], ["k", "text", "page"])

    rows = docs.select(F.col("doc_id").alias("k"), *COLUMNS).where(~held_out(F.col("k")))
    known = labels.select(F.col("doc_id").alias("k"))
    scored = written(map_arrow(rows, run, f"k {kind}, text double, page double").join(known, "k", "left_anti"), "quality-round")
    good = float(np.clip(lesson.y.mean(), 0.02, 0.98))
    out = []
    for view, other in (("text", "page"), ("page", "text")):
        told = docs.sparkSession.createDataFrame([(t[0],) for t in lesson.told[other]], f"k {kind}")
        fresh = scored.join(F.broadcast(told), "k", "left_anti")
        for label, chance, quota in ((1, F.col(view), good), (0, 1 - F.col(view), 1 - good)):
            first = fresh.groupBy("k").agg(F.max(chance).alias("sure")).where(F.col("sure") >= SURE).orderBy(F.desc("sure"), "k")
            out += [(other, r.k, label) for r in first.limit(max(1, int(EXCHANGED * quota))).collect()]
    return out


def learn(docs: DataFrame, labels: DataFrame, per_label: int = 2000) -> CoTrained | None:
    """None unless both labels occur. Labelled rows are drawn by id; a bounded broadcast of ids meets the documents."""
    marks = (
        labels.select(F.col("doc_id").alias("k"), F.col("quality").cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & ~held_out(F.col("k"))).groupBy("k").agg(F.min("y").alias("y"))
    )
    drawn = _rows_of(docs, bounded_sample(marks, "y", "k", per_label))
    y = np.array([r.y for r in drawn])
    if len(set(y[::CALIBRATION_PART])) < 2 or len(set(np.delete(y, np.s_[::CALIBRATION_PART]))) < 2:
        return None
    lesson = Lesson({v: np.array([np.frombuffer(r[v], np.float32) for r in drawn]) for v in COSTS}, y, {v: [] for v in COSTS})
    kind = docs.schema["doc_id"].dataType.simpleString()
    for _ in range(ROUNDS):
        chosen = surest(docs, labels, lesson)
        ids = docs.sparkSession.createDataFrame([(k, -1) for k in {k for _, k, _ in chosen}], f"k {kind}, y int")
        found = {r.k: r for r in _rows_of(docs, ids)}
        for view, k, label in chosen:
            lesson.told[view].append((k, np.frombuffer(found[k][view], np.float32), label))
    return lesson.combined()


def quality_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, text_score, page_score, keep); scores are 0.5 where nothing could be learned."""
    model = learn(docs, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if model is None or not batch.num_rows:
            scores = [np.full(batch.num_rows, 0.5)] * 3
        else:
            scores = model.scores(*map(np.array, _features(batch)))
        return pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(np.asarray(s, dtype=np.float64)) for s in scores]], ["doc_id", "score", "text_score", "page_score"])

    scored = map_arrow(docs.select("doc_id", *COLUMNS), run, f"doc_id {kind}, score double, text_score double, page_score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "text_score", "page_score", (F.col("score") >= 0.5).alias("keep"))
