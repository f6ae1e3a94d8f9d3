"""Alignment by its rules, thresholds and counts."""

import difflib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from filegrain.operators import alignment as al
from filegrain.operators.blocks import common_blocks


def similarity(a, b):
    x, y = (set(re.findall(r"\b[a-z]{3,}\b", s.lower())) for s in (a, b))
    if not x and not y:
        return 1.0
    return len(x & y) / len(x | y) if x and y else 0.0


def between_unchanged(changes):
    """Runs of changes between unchanged sentences: what was compared with what."""
    block = []
    for c in [*changes, None]:
        if c is None or c["type"] == "unchanged":
            yield block
            block = []
        else:
            block.append(c)


def check(old, new, changes):
    """What an alignment must be, whatever way it was found."""
    unchanged = [c["older"] for c in changes if c["type"] == "unchanged"]
    assert [c["older"] for c in changes if c["older"] is not None] == old  # every old sentence once, in order
    assert sorted(c["newer"] for c in changes if c["newer"] is not None) == sorted(new)  # every new one once
    at = iter(new)
    assert all(s in at for s in unchanged)  # the unchanged ones keep their order in the new text
    for block in between_unchanged(changes):
        taken = []
        free = [c["newer"] for c in block if c["newer"] is not None]
        for c in block:
            if c["type"] == "added":
                continue
            left = [similarity(c["older"], s) for s in free]
            if c["type"] == "removed":
                assert c["newer"] is None and max(left, default=0) < 0.40
                continue
            assert c["type"] == "rewritten"
            sim = similarity(c["older"], c["newer"])
            assert sim >= 0.40 and c["similarity"] == round(sim, 3)
            assert sim >= 0.95 or sim == max(left)
            taken.append(c["newer"])
            free.remove(c["newer"])
        assert sorted(free) == sorted(c["newer"] for c in block if c["type"] == "added")


def sentences(rng, n):
    words = "risk cash loss market debt growth cloud tariff fraud audit board share".split()
    return [" ".join(rng.choices(words, k=rng.randint(3, 9))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(8))
def test_alignment_keeps_its_rules(spark, seed):
    rng = random.Random(seed)
    old = sentences(rng, 40)
    new = [s if rng.random() < 0.6 else s + " " + rng.choice(["again", "now"]) for s in old if rng.random() > 0.15]
    new += sentences(rng, 5)
    rng.random() < 0.5 and new.insert(3, "12 ab")
    df = spark.createDataFrame([(old, new)], "o array<string>, n array<string>").withColumn("s", al.align(F.col("o"), F.col("n")))
    got = df.select(al.change_rows(F.col("s"), F.col("o"), F.col("n")).alias("c")).first()["c"]
    check(old, new, got)


def test_thresholds(spark):
    base = "alpha beta gamma delta epsilon"
    cases = [("alpha beta zeta theta", "removed"), ("alpha beta gamma zeta", "rewritten"), (base, "unchanged")]
    for new, expected in cases:
        df = spark.createDataFrame([([base], [new])], "o array<string>, n array<string>").withColumn("s", al.align(F.col("o"), F.col("n")))
        assert df.select(al.change_rows(F.col("s"), F.col("o"), F.col("n"))[0]["type"]).first()[0] == expected


def test_a_large_rewritten_block_is_compared_whole(spark):
    old = [f"old{i} shared word number {'abcdefghij'[i % 10] * 3} token {'xyz'[i % 3] * 4}" for i in range(900)]
    new = [s.replace("old", "new") + " tail" for s in old]
    df = spark.createDataFrame([(old, new)], "o array<string>, n array<string>").withColumn("s", al.align(F.col("o"), F.col("n")))
    row = df.select(*al.counts(F.col("s"))).first()
    assert row["rewritten_count"] == 900 and row["removed_count"] == row["added_count"] == 0


def test_multiset_delta_counts_repeats(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b"], ["a", "b", "b", "c"]), (2, ["a"], ["a"]), (3, [], [])], "id int, o array<string>, n array<string>")
    rows = {r["id"]: r for r in al.multiset_delta(df, "o", "n").collect()}
    assert (rows[1]["unchanged_count"], rows[1]["removed_count"], rows[1]["added_count"]) == (2, 1, 2)
    assert (rows[2]["magnitude"], rows[2]["pct_changed"]) == ("none", 0.0)
    assert rows[3]["magnitude"] == "none"


@pytest.mark.parametrize("seed", range(4))
def test_multiset_delta_equals_counters(spark, seed):
    from collections import Counter

    rng = random.Random(seed)
    pairs = [(i, rng.choices("abcdef", k=rng.randint(0, 12)), rng.choices("abcdef", k=rng.randint(0, 12))) for i in range(30)]
    df = spark.createDataFrame(pairs, "id int, o array<string>, n array<string>")
    for r in al.multiset_delta(df, "o", "n").collect():
        o, n = Counter(r["o"]), Counter(r["n"])
        assert (r["unchanged_count"], r["removed_count"], r["added_count"]) == (
            sum((o & n).values()), sum((o - n).values()), sum((n - o).values()))


def joined(blocks):
    out = []
    for i, j, size in blocks:
        if out and (out[-1][0] + out[-1][2], out[-1][1] + out[-1][2]) == (i, j):
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + size)
        else:
            out.append((i, j, size))
    return out


@pytest.mark.parametrize("kinds", [1, 2, 3, 5, 20, 100])
def test_blocks_follow_the_rule_of_the_standard_library(kinds):
    rng = random.Random(kinds)
    for _ in range(300):
        old = [rng.randrange(kinds) for _ in range(rng.randint(0, 40))]
        new = [x for x in old if rng.random() < 0.8] if rng.random() < 0.4 else [rng.randrange(kinds) for _ in range(rng.randint(0, 40))]
        want = [o for o in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes() if o[0] == "equal"]
        assert joined(common_blocks(old, new)) == [(i1, j1, i2 - i1) for _, i1, i2, j1, _ in want]


def test_twenty_thousand_repeated_sentences():
    rng = random.Random(1)
    lines = ["page intentionally left blank", "see note", "risk of loss in the market", "none", "not applicable to the company"]
    cases = [
        ([rng.choice(lines) for _ in range(20_000)], [rng.choice(lines) for _ in range(20_000)]),
        ([f"item {i}" if i % 2 else "same words here" for i in range(20_000)], [f"item {i}" if i % 2 else "other words here" for i in range(20_000)]),
        (["one sentence"] * 20_000, ["another sentence"] * 19_000),
    ]
    for old, new in cases:
        start = time.perf_counter()
        steps = al._steps(old, new)
        assert time.perf_counter() - start < 20
        assert [s["old"] for s in steps if s["old"] is not None] == list(range(20_000))
        assert sorted(s["new"] for s in steps if s["new"] is not None) == list(range(len(new)))


@pytest.mark.parametrize("seed", range(6))
def test_repeated_sentences_keep_the_rules(spark, seed):
    rng = random.Random(100 + seed)
    kinds = sentences(rng, 6)
    old, new = rng.choices(kinds, k=30), rng.choices([*kinds, *(k + " more" for k in kinds)], k=30)
    df = spark.createDataFrame([(old, new)], "o array<string>, n array<string>").withColumn("s", al.align(F.col("o"), F.col("n")))
    check(old, new, df.select(al.change_rows(F.col("s"), F.col("o"), F.col("n")).alias("c")).first()["c"])


def test_shorter_ways_find_the_same(monkeypatch):
    """Sequences whose common items keep their order, and few sentences, are settled without ranks and lists of words."""
    import random

    from filegrain.operators import alignment, blocks

    rng = random.Random(3)
    cases = []
    for _ in range(1500):
        words = [a + b + "o" for a in "klmn" for b in "aeiou"]
        old = [" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(rng.randint(0, 14))]
        new = [" ".join(w for w in s.split() if rng.random() > 0.2) if rng.random() < 0.3 else s for s in old if rng.random() > 0.2]
        new += rng.choices(old, k=rng.randint(0, 2)) if old and rng.random() < 0.3 else []
        if rng.random() < 0.3:
            rng.shuffle(new)
        cases.append((old, new))
    short = [alignment._steps(*c) for c in cases]
    asked = sum(blocks._in_order(*c) is not None for c in cases)
    with monkeypatch.context() as long:
        long.setattr(blocks, "_in_order", lambda old, new: None)
        long.setattr(alignment, "FEW", -1)
        assert [alignment._steps(*c) for c in cases] == short
    assert 300 < asked < 1500

    def never(*_):
        raise AssertionError("ranks of items that keep their order")

    monkeypatch.setattr(blocks, "Ranks", never)
    assert blocks.common_blocks(list("abcdxef"), list("abyycdef")) == [(0, 0, 2), (2, 4, 2), (5, 6, 2)]


def test_few_rows_of_a_batch_are_python_objects_at_a_time():
    import pyarrow as pa

    from filegrain.functions.rows import AT_ONCE, row_by_row

    asked = []

    class Column:
        def __init__(self, values):
            self.values = values

        def __len__(self):
            return len(self.values)

        def slice(self, at, rows):
            return Column(self.values[at : at + rows])

        def to_pylist(self):
            asked.append(len(self.values))
            return self.values

    made = row_by_row(lambda a, b: None if a is None else a + b, pa.string(), Column(["x", None] * 15), Column(["y"] * 30))
    assert made.to_pylist() == ["xy", None] * 15 and max(asked) == AT_ONCE and sum(asked) == 60
    assert row_by_row(len, pa.int32(), pa.array([], pa.string())).to_pylist() == []
