"""Collocations against a plain count, with groups of few leaves, hot words and runs cut short."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pyarrow as pa
import pytest

from filegrain.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top=2000):
    """rows: (lang, text) -> {(lang, rank): (phrase, a, l, r, n, score)}."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for size in range(1, 5):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = {}
    for lang, f in counts.items():
        candidates = [p for p, a in f.items() if len(p) > 1 and a >= least]
        around = Counter()
        for p in candidates:
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        around[p[i:j]] = max(around[p[i:j]], f[p])
        ranked = []
        for p in candidates:
            if 100 * around[p] >= 80 * f[p]:
                continue
            score, k = min((Fraction(2000000 * f[p], f[p[:k]] + f[p[k:]]).__floor__(), k) for k in range(1, len(p)))
            ranked.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out[lang, rank] = (phrase.decode(), -a, left, right, totals[lang], -score)
    return out


def found(spark, rows, **options):
    docs = spark.createDataFrame([(i, text, lang, "clash") for i, (lang, text) in enumerate(rows)], "doc_id long, text string, lang string, n string")
    got = collocations.collocations(docs, **options).collect()
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    words = ["of", "the", "Ünder", "New", "York", "a\xa0b", "x", "y", "z", "w"]
    out = [(rng.choice(["en", "de", None]), " ".join(rng.choices(words, [9, 9, 3, 3, 3, 2, 1, 1, 1, 1], k=40)) + rng.choice([".", "!\t", "\n", ""])) for _ in range(150)]
    out += [("en", "In New York, in new york; the state of new york")] * 40 + [("en", None), (None, ""), ("fr", "..."), ("und", "the x the x the x")]
    return out


@pytest.mark.parametrize("budget", [8, 400, 1 << 20])
def test_against_plain_counts(spark, rows, budget):
    """With a small budget all words are hot and groups many: nodes are summed over groups."""
    want = plain(rows, 5)
    assert found(spark, rows, least=5, budget=budget) == want and len(want) > 100
    assert found(spark, rows, least=5, top=3, budget=budget) == {k: v for k, v in want.items() if k[1] <= 3}


def test_long_texts_and_runs_cut_anywhere(monkeypatch):
    """Suffixes run on over the ends of what is split and sorted at a time."""
    text = ("one two three " * 500 + "one two, three four five six ") * 3
    want = Counter()
    for piece in text.split(","):
        w = piece.split()
        want.update(tuple(w[i : i + 4]) for i in range(len(w) - 1))
    monkeypatch.setattr(collocations, "SPLIT_BYTES", 11)
    monkeypatch.setattr(collocations, "SORTED_WORDS", 100)
    everything = b"\xff" * 512
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], ["lang", "text"])
    rows = [r for b in collocations._send(1, everything, bytes(512), iter([batch])) for r in b.to_pylist()]
    got = Counter()
    for r in rows:
        names, columns, totals = collocations.unpacked(r["n_words"], r["n_leaves"], r["word_bytes"], r["packed"])
        for row, total in zip(columns.T, totals):
            got[tuple(names[i - 1].decode() for i in row if i)] += int(total)
    assert got == want and len(rows) > 20


def test_a_passage_of_a_third_of_all_rows(spark):
    rows = [("en", "alpha beta gamma delta epsilon")] * 3000 + [("en", f"w{i} alpha beta v{i % 40}") for i in range(600)]
    assert found(spark, rows, budget=64) == plain(rows, 30)


def test_nothing(spark):
    assert found(spark, []) == {} and found(spark, [(None, None), ("en", " . ")]) == {}


def test_scores_beyond_64_bits(spark):
    """Products of counts and scale pass 64 bits."""
    big = 1 << 61
    phrases = spark.createDataFrame([("en", "a b", 2, big)], "lang string, phrase string, size int, n long")
    words = spark.createDataFrame([("en", "a", big + 1), ("en", "b", big + 5)], "lang string, word string, n long")
    row = collocations.cut_scores(phrases, words).first()
    assert row.score == 2000000 * big // (2 * big + 6)
