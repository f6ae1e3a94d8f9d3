"""Sentence changes between two versions of a section.

``multiset_delta`` counts changes with array expressions and is exact for
order-free comparison. ``align`` keeps sentence order: longest common blocks, then best
matches inside rewritten blocks. The order-bound part needs one pair's two
sentence lists at a time and runs in Arrow batches; it returns positions only,
texts are looked up again in the JVM.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.rows import row_by_row
from ..functions.scoring import change_magnitude
from ..functions.text import clip
from ..session import ship_package
from .blocks import common_blocks

KINDS = ("unchanged", "rewritten", "removed", "added")
_STEP = pa.struct([("kind", pa.int8()), ("old", pa.int32()), ("new", pa.int32()), ("sim", pa.float64())])
_WORD = re.compile(r"\b[a-z]{3,}\b")


def _words(sentence: str) -> frozenset[str]:
    return frozenset(_WORD.findall(sentence.lower()))


class _Free:
    """New sentences by their sets of words: equal sets are compared once and leave in order."""

    def __init__(self, sentences: list[str]):
        self.places: dict[frozenset[str], list[int]] = {}
        for j, s in enumerate(sentences):
            self.places.setdefault(_words(s), []).append(j)
        where: dict[str, list[int]] = {}
        for k, words in enumerate(self.places):
            for w in words:
                where.setdefault(w, []).append(k)
        self.where = {w: np.array(ks, dtype=np.int64) for w, ks in where.items()}
        self.sizes = np.array([len(w) for w in self.places], dtype=np.float64)
        self.queues = [iter(js[1:]) for js in self.places.values()]
        self.next = np.array([js[0] for js in self.places.values()], dtype=np.float64)
        self.left = len(sentences)

    def similarities(self, words: frozenset[str]) -> np.ndarray:
        """Jaccard with every set. Shared words are counted over lists of the sets each word is in, so memory stays linear."""
        hits = [self.where[w] for w in words if w in self.where]
        shared = np.bincount(np.concatenate(hits), minlength=len(self.sizes)) if hits else np.zeros(len(self.sizes))
        union = len(words) + self.sizes - shared
        return np.where(union > 0, shared / np.maximum(union, 1.0), 1.0)

    def take(self, row: np.ndarray) -> tuple[int, float] | None:
        """The first nearly identical free sentence, else the first of the most similar ones."""
        row = np.where(np.isinf(self.next), -1.0, row)
        near = row >= fv.SAME_SIMILARITY
        chosen = near if near.any() else row == row.max()
        k = int(np.where(chosen, self.next, np.inf).argmin())
        if row[k] < fv.REWRITE_SIMILARITY:
            return None
        j = int(self.next[k])
        self.next[k] = next(self.queues[k], np.inf)
        self.left -= 1
        return j, round(float(row[k]), 3)


#: Up to so many new sentences are compared one by one.
FEW = 8


def _few_rewrites(old: list[str], new: list[str]) -> dict[int, tuple[int, float]]:
    """``_rewrites`` without lists of words, which cost more than they save where few sentences are compared."""
    free = [(j, _words(s)) for j, s in enumerate(new)]
    out: dict[int, tuple[int, float]] = {}
    for i, sentence in enumerate(old):
        if not free:
            break
        words = _words(sentence)
        best, most = 0, -1.0
        for place, (_, other) in enumerate(free):
            shared = len(words & other)
            union = len(words) + len(other) - shared
            alike = shared / union if union else 1.0
            if alike > most:
                best, most = place, alike
            if alike >= fv.SAME_SIMILARITY:
                best, most = place, alike
                break
        if most >= fv.REWRITE_SIMILARITY:
            out[i] = free.pop(best)[0], round(most, 3)
    return out


def _rewrites(old: list[str], new: list[str]) -> dict[int, tuple[int, float]]:
    """old position → (new position, similarity), greedily in old order."""
    if len(new) <= FEW:
        return _few_rewrites(old, new)
    free = _Free(new)
    rows = lru_cache(maxsize=256)(free.similarities)
    out: dict[int, tuple[int, float]] = {}
    for i, sentence in enumerate(old):
        if not free.left:
            break
        if (taken := free.take(rows(_words(sentence)))) is not None:
            out[i] = taken
    return out


def _steps(old: list[str] | None, new: list[str] | None) -> list[dict] | None:
    if old is None or new is None:
        return None
    out: list[dict] = []

    def add(kind, i, j, sim):
        out.append({"kind": kind, "old": i, "new": j, "sim": sim})

    i1 = j1 = 0
    for i2, j2, size in [*common_blocks(old, new), (len(old), len(new), 0)]:
        pairs = _rewrites(old[i1:i2], new[j1:j2]) if i1 < i2 and j1 < j2 else {}
        for i in range(i2 - i1):
            if i in pairs:
                add(1, i1 + i, j1 + pairs[i][0], pairs[i][1])
            else:
                add(2, i1 + i, None, 0.0)
        taken = {j for j, _ in pairs.values()}
        for j in range(j2 - j1):
            if j not in taken:
                add(3, None, j1 + j, 0.0)
        for k in range(size):
            add(0, i2 + k, j2 + k, 1.0)
        i1, j1 = i2 + size, j2 + size
    return out


def align(older: Column, newer: Column) -> Column:
    """Ordered steps ``array<struct<kind,old,new,sim>>`` turning the older
    sentence array into the newer one; positions are 0-based."""
    ship_package()

    @F.arrow_udf("array<struct<kind:tinyint,old:int,new:int,sim:double>>")
    def steps(old: pa.Array, new: pa.Array) -> pa.Array:
        return row_by_row(_steps, pa.list_(_STEP), old, new)

    # never pushed or copied by the optimizer: each pair is aligned once
    return steps.asNondeterministic()(older, newer)


def change_rows(steps: Column, older: Column, newer: Column) -> Column:
    """Steps with names and texts: ``array<struct<type,older,newer,similarity>>``."""
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"].cast("int") + 1)
    return F.transform(steps, lambda s: F.struct(
        kind(s).alias("type"),
        F.get(older, s["old"]).alias("older"),
        F.get(newer, s["new"]).alias("newer"),
        s["sim"].alias("similarity"),
    ))


def counts(steps: Column) -> list[Column]:
    return [_count(steps, i).alias(f"{name}_count") for i, name in enumerate(KINDS)]


def _count(steps: Column, kind: int) -> Column:
    return F.coalesce(F.size(F.filter(steps, lambda s: s["kind"] == kind)), F.lit(0))


def changed_text(steps: Column, newer: Column) -> Column:
    """Text of the added and rewritten sentences."""
    return F.array_join(
        F.transform(F.filter(steps, lambda s: s["kind"].isin(1, 3)), lambda s: F.get(newer, s["new"])), " "
    )


def top_changes(changes: Column, n: int = 50, chars: int = 300) -> Column:
    """The changes among the first ``n`` steps, texts shortened for display."""
    shown = lambda t: clip(F.coalesce(t, F.lit("")), chars)
    return F.transform(
        F.filter(F.slice(changes, 1, n), lambda c: c["type"] != "unchanged"),
        lambda c: F.struct(
            c["type"].alias("type"), shown(c["older"]).alias("older"),
            shown(c["newer"]).alias("newer"), c["similarity"].alias("similarity"),
        ),
    )


def with_change_summary(df: DataFrame, older_n: Column, newer_n: Column) -> DataFrame:
    """pct_changed and magnitude from the four counts."""
    changed = F.col("added_count") + F.col("removed_count") + F.col("rewritten_count")
    longest = F.greatest(older_n, newer_n, F.lit(1))
    return (
        df.withColumn("pct_changed", F.round(changed / longest, 4))
        .withColumn("magnitude", change_magnitude(changed, longest))
    )


def missing_side(older: Column, newer: Column) -> Column:
    """Why two texts cannot be compared; NULL when they can."""
    gone = lambda c: F.coalesce(c == "", F.lit(True))
    return (
        F.when(gone(older) & gone(newer), "Both older and newer text are missing")
        .when(gone(older), "Older filing text missing — cannot compare")
        .when(gone(newer), "Newer filing text missing — cannot compare")
    )


def multiset_counts(older: Column, newer: Column) -> Column:
    """Struct of unchanged, removed and added counts of two sentence arrays,
    order ignored and repeats counted.

    Both sides are sorted together and read once: older copies of a sentence
    come first and wait for newer ones. Nothing is exploded or exchanged.
    """
    tagged = lambda c, side: F.transform(c, lambda x: F.struct(x.alias("s"), F.lit(side).alias("side")))
    start = F.struct(
        F.lit(None).cast("string").alias("s"), *[F.lit(0).alias(c) for c in ("waiting", "unchanged", "removed", "added")]
    )

    def step(acc: Column, x: Column) -> Column:
        same = acc["s"].eqNullSafe(x["s"])
        waiting = F.when(same, acc["waiting"]).otherwise(0)
        old, pairs_up = x["side"] == 0, waiting > 0
        return F.struct(
            x["s"].alias("s"),
            (waiting + F.when(old, 1).when(pairs_up, -1).otherwise(0)).alias("waiting"),
            (acc["unchanged"] + F.when(~old & pairs_up, 1).otherwise(0)).alias("unchanged"),
            (acc["removed"] + F.when(same, 0).otherwise(acc["waiting"])).alias("removed"),
            (acc["added"] + F.when(~old & ~pairs_up, 1).otherwise(0)).alias("added"),
        )

    return F.aggregate(
        F.array_sort(F.concat(tagged(older, 0), tagged(newer, 1))), start, step,
        lambda acc: F.struct(acc["unchanged"], (acc["removed"] + acc["waiting"]).alias("removed"), acc["added"]),
    )


def multiset_delta(pairs: DataFrame, older: str, newer: str) -> DataFrame:
    """Pairs with unchanged, removed and added counts, share and magnitude."""
    out = (
        pairs.withColumn("_m", multiset_counts(F.col(older), F.col(newer)))
        .withColumn("unchanged_count", F.col("_m.unchanged")).withColumn("removed_count", F.col("_m.removed"))
        .withColumn("added_count", F.col("_m.added")).withColumn("rewritten_count", F.lit(0))
        .withColumn("older_sentences", F.size(older)).withColumn("newer_sentences", F.size(newer))
    )
    out = with_change_summary(out, F.col("older_sentences"), F.col("newer_sentences"))
    return out.drop("_m", "rewritten_count")
