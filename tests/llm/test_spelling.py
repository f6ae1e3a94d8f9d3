"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from filegrain.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def plain(rows):
    """rows: (doc_id, text) -> {word: (form, root, n, n_near, form_n)}."""
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


def found(spark, rows):
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, id int, word string")
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs).collect()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    base = ["aabbcc", "letter", "ÉÈstimé", "aaaaaaa", "colour", "committee"]
    words = set(base)
    for _ in range(500):
        w = rng.choice(sorted(words))
        i = rng.randrange(len(w))
        c = rng.choice("abcàÿ×")
        words.add(rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]]))
    words = sorted(words)
    out = []
    for doc in range(60):
        some = rng.choices(words, [1 / (1 + k % 97) for k in range(len(words))], k=300)
        out.append((doc if doc % 20 else None, " ".join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in some) + "1 _x"))
    return out


def test_against_all_pairs(spark, rows):
    want = plain(rows)
    assert found(spark, rows) == want
    assert len(want) > 150 and sum(v[3] > 3 for v in want.values()) > 30 and any(v[0] for v in want.values())


def test_edges(spark):
    long = "ab" * 30_000
    rows = [(1, None), (2, ""), (3, "12 ..."), (4, "abc " * 9), (5, f"{long} {long}x"), (5, f"{long} {long}x")] + [(9, f"lonely {long} {long}x")] * 3
    got = found(spark, rows)
    assert got == plain(rows) and "lonely" not in got
    assert got[long][3] == 1 and found(spark, []) == {} and found(spark, [(None, None)]) == {}


def test_a_word_of_a_third_of_all_rows(spark):
    rows = [(i, "the common writing commonn") for i in range(400)] + [(i, f"writin{chr(97 + i % 26)} writings") for i in range(400)]
    assert found(spark, rows) == plain(rows)


def test_chains_of_forms(spark):
    n = {"aaaaaa": 8000, "aaaaab": 1500, "aaaabb": 250, "aaabbb": 45, "aabbbb": 6}
    docs = [(7, " ".join([w] * c)) for w, c in n.items()]
    got = found(spark, docs)
    assert got == plain(docs) and {got[w][1] for w in n} == {"aaaaaa"}


def test_node_numbers_come_from_parents():
    a, b = spelling.trie_numbers([1, 2, 3]), spelling.trie_numbers([1, 2, 4])
    assert a[:3] == b[:3] and a[3] != b[3] and len({*a, *b}) == 5
