"""Language identification by hierarchical discrimination.

First the language family is predicted, then linear support vector machines,
one for each pair of languages, separate the members of that family. Both steps
see hashed counts of one to three letters of the whole text.

Nulls and texts without a letter get ``und`` and score 0. Learning uses a sample
of at most about ``per_language`` rows of each language; every row is scored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filegrain.llm.common import bounded_sample, held_out, map_arrow

UNKNOWN = "und"
# ISO 639-1 codes by language family. A language that is not
# listed forms a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "semitic": "ar he mt am",
    "indo-aryan": "hi ur bn mr gu pa ne si",
    "iranian": "fa ku ps tg",
    "celtic": "ga gd cy br",
    "baltic": "lt lv",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

DIMENSIONS = 2048
PIECE = 1 << 20
LETTERS = re.compile(r"[^\W\d_]+")
NOT_LETTERS = re.compile(r"[\W\d_]+")


def has_letter(text: str) -> bool:
    """A character of the letter categories; the pattern alone takes fractions and numerals in circles as well."""
    return any(c.isalpha() for m in LETTERS.finditer(text) for c in m[0])


def family_of(language: str) -> str:
    return FAMILY_OF.get(language.lower(), language)


def letter_counts(text: str) -> np.ndarray:
    """Unit vector of square-rooted counts of hashed letter groups. Long texts are counted piece by piece."""
    counts = np.zeros(DIMENSIONS)
    for at in range(0, len(text), PIECE):
        clean = " " + NOT_LETTERS.sub(" ", text[at : at + PIECE].lower()) + " "
        c = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        one = c * np.uint64(0x9E3779B97F4A7C15)
        two = one[:-1] + c[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        three = two[:-1] + c[2:] * np.uint64(0x165667B19E3779F9)
        for salt, group in ((1, one), (2, two), (3, three)):
            mixed = (group ^ (group >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * salt)
            counts += np.bincount((mixed >> np.uint64(53)).astype(np.int64), minlength=DIMENSIONS)
    counts = np.sqrt(counts)
    return (counts / max(np.linalg.norm(counts), 1e-12)).astype(np.float32)


@dataclass
class Machine:
    """A linear support vector machine with a logistic link from margin to probability."""

    weights: np.ndarray
    bias: float
    slope: float

    @classmethod
    def fit(cls, x: np.ndarray, positive: np.ndarray, cost: float = 50.0, rounds: int = 120) -> Machine:
        """Squared hinge loss by accelerated gradient descent; the two sides weigh the same."""
        y = np.where(positive, 1.0, -1.0).astype(np.float32)
        share = np.where(positive, 0.5 / max(positive.sum(), 1), 0.5 / max((~positive).sum(), 1)).astype(np.float32)
        w, b, vw, vb = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0
        step = 1.0 / (1.0 + 4.0 * cost)
        for k in range(rounds):
            m = k / (k + 3.0)
            lw, lb = w + np.float32(m) * vw, b + m * vb
            slack = np.maximum(0.0, 1.0 - y * (x @ lw + np.float32(lb))) * y * share
            nw, nb = lw - np.float32(step) * (lw - np.float32(2 * cost) * (slack @ x)), lb + step * 2 * cost * float(slack.sum())
            vw, vb, w, b = nw - w, nb - b, nw, nb
        margin = y * (x @ w + b)
        slope = 1.0
        for _ in range(50):  # one-parameter calibration; the bias is balanced already
            p = 1.0 / (1.0 + np.exp(-np.clip(slope * margin, -30, 30)))
            slope += np.clip((share * (1 - p) * margin).sum() / ((share * p * (1 - p) * margin**2).sum() + 1e-3), -2, 2)
        return cls(w, float(b), float(np.clip(slope, 0.5, 20.0)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * (x @ self.weights + self.bias), -30, 30)))


def duels(x: np.ndarray, names: np.ndarray) -> tuple[list[str], dict[tuple[int, int], Machine]]:
    """One machine for each pair of names."""
    values = sorted(set(names))
    machines = {}
    for i, j in combinations(range(len(values)), 2):
        rows = (names == values[i]) | (names == values[j])
        machines[i, j] = Machine.fit(x[rows], names[rows] == values[i])
    return values, machines


def settle(x: np.ndarray, values: list[str], machines: dict[tuple[int, int], Machine]) -> np.ndarray:
    """Probabilities of the names: the mean of what each one's duels say, brought to sum 1."""
    p = np.ones((len(x), len(values)))
    if len(values) > 1:
        p[:] = 0
        for (i, j), machine in machines.items():
            won = machine.probability(x)
            p[:, i] += won
            p[:, j] += 1 - won
        p /= p.sum(1, keepdims=True)
    return p


@dataclass
class Hierarchy:
    families: tuple[list[str], dict]
    members: dict[str, tuple[list[str], dict]]

    @classmethod
    def fit(cls, x: np.ndarray, languages: np.ndarray) -> Hierarchy:
        family = np.array([family_of(v) for v in languages])
        return cls(
            duels(x, family),
            {f: duels(x[family == f], languages[family == f]) for f in sorted(set(family))},
        )

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        names, score = np.empty(len(x), dtype=object), np.zeros(len(x))
        p = settle(x, *self.families)
        chosen = p.argmax(1)
        for k, family in enumerate(self.families[0]):
            rows = np.flatnonzero(chosen == k)
            if len(rows):
                q = settle(x[rows], *self.members[family])
                best = q.argmax(1)
                names[rows] = np.array(self.members[family][0], dtype=object)[best]
                score[rows] = p[rows, k] * q[np.arange(len(rows)), best]
        return list(names), score


def learn(labelled: DataFrame, key: str, text: str, language: str, per_language: int = 800) -> Hierarchy | None:
    """None where there is nothing to learn from."""
    rows = bounded_sample(
        labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(language).alias("l"))
        .where(F.col("t").isNotNull() & F.col("l").isNotNull()),
        "l", "k", per_language,
    ).select("t", "l")

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors = [letter_counts(t).tobytes() if has_letter(t) else None for t in batch["t"].to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(vectors, pa.binary()), batch["l"]], ["x", "l"])

    got = [(r.x, r.l) for r in map_arrow(rows, features, "x binary, l string").collect() if r.x is not None]
    if not got:
        return None
    got.sort(key=lambda r: (r[1], bytes(r[0])))  # the same model however the rows arrive
    return Hierarchy.fit(np.array([np.frombuffer(r[0], np.float32) for r in got]), np.array([r[1] for r in got]))


def identify(docs: DataFrame, model: Hierarchy | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of each row."""
    kind = docs.schema[key].dataType.simpleString()

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch[text].to_pylist()
        known = [i for i, t in enumerate(texts) if model is not None and t and has_letter(t)]
        names, values = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if known:
            got, p = model.predict(np.array([letter_counts(texts[i]) for i in known]))
            for i, name, v in zip(known, got, p, strict=True):
                names[i], values[i] = name, min(max(float(v), 0.0), 1.0)
        return pa.RecordBatch.from_arrays([batch[key], pa.array(names, pa.string()), pa.array(values)], [key, "lang_pred", "score"])

    return map_arrow(docs.select(key, text), score, f"`{key}` {kind}, lang_pred string, score double")


def language_table(docs: DataFrame, per_language: int = 800) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the rows that are not held out, predicted for all."""
    learnable = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")))
    model = learn(learnable, "doc_id", "text", "lang", per_language)
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def with_known_language(docs: DataFrame) -> DataFrame:
    """The rows whose text has a language; the others (null, no letter) go. All columns stay as they are.

    The model judges each row where it stands, so no join brings judgement and row together.
    """
    learnable = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")))
    model = learn(learnable, "doc_id", "text", "lang")

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch["text"].to_pylist()
        known = [i for i, t in enumerate(texts) if model is not None and t and has_letter(t)]
        names = model.predict(np.array([letter_counts(texts[i]) for i in known]))[0] if known else []
        mask = np.zeros(len(texts), dtype=bool)
        mask[known] = [n != UNKNOWN for n in names]
        return batch.filter(pa.array(mask))

    return map_arrow(docs, keep, docs.schema)
