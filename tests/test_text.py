import pytest
from pyspark.sql import functions as F

from filegrain.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_sentences_split_on_openers_only(spark):
    text = 'First sentence is here. second stays with it! "Third" one is quoted? (Fourth in brackets is here.)'
    assert one(spark, T.sentences(F.col("t")), t=text) == [
        "First sentence is here. second stays with it!", '"Third" one is quoted?', "(Fourth in brackets is here.)",
    ]


def test_sentences_drop_short_and_cap_only_when_asked(spark):
    text = " ".join(f"This is sentence number {i} of many." for i in range(700)) + " Too short."
    assert len(one(spark, T.sentences(F.col("t")), t=text)) == 700
    assert len(one(spark, T.sentences(F.col("t"), max_sentences=600), t=text)) == 600


def test_non_breaking_space_separates_sentences(spark):
    assert len(one(spark, T.sentences(F.col("t")), t="A first sentence of text. A second sentence of text.")) == 2


@pytest.mark.parametrize("a,b,expected", [
    ("", "", 1.0), ("the cat sat", "", 0.0), ("one two three", "one two four", 0.5), ("ab cd", "ef", 1.0),
])
def test_jaccard(spark, a, b, expected):
    assert one(spark, T.jaccard(T.token_set(F.col("a")), T.token_set(F.col("b"))), a=a, b=b) == expected


def test_tokens_inside_longer_words_do_not_count(spark):
    assert one(spark, T.token_set(F.col("t")), t="naïve cats, cats_2 and Dogs 3dogs") == ["cats", "and", "dogs"]


def test_match_spans_equal_finditer(spark):
    import re

    text = "Item 1.01 a ITEM 2.02 b item 9.99"
    got = one(spark, T.match_spans(F.col("t"), r"(?i)item\s+(\d\.\d{2})\b"), t=text)
    assert [(r["first"], r["past"]) for r in got] == [m.span() for m in re.finditer(r"(?i)item\s+(\d\.\d{2})\b", text)]
    assert one(spark, T.match_spans(F.col("t"), "zzz"), t=text) == []


def test_strip_markup(spark):
    html = "<style>p{}</style><script>if (a<b) x('</p>')</script><p> A &#233;&#x41;&amp;lt; </p><!-- <p>no</p> --><div>B<br>C</div> &nbsp; "
    assert one(spark, T.strip_markup(F.col("h"), "|"), h=html) == "A éA&lt;|B|C"


@pytest.mark.parametrize("text,expected", [("1,234.5", 1234.5), ("x", None), ("", None), ("-3", -3.0)])
def test_number(spark, text, expected):
    assert one(spark, T.number(F.col("t")), t=text) == expected


@pytest.mark.parametrize("value", [0.5, 1.5, 2.5, 54.55, 0.25, -1234.5, 1e9, 0.0, 999.95])
def test_number_formats_match_python(spark, value):
    assert one(spark, T.fixed(F.col("v"), 1), v=value) == f"{value:.1f}"
    assert one(spark, T.whole(F.col("v")), v=value) == f"{value:,.0f}"
    assert one(spark, T.signed_whole(F.col("v")), v=value) == f"{value:+,.0f}"


def test_let_computes_once_per_row(spark):
    # a nondeterministic value would differ if it were computed per element
    got = one(spark, T.let(F.rand(), lambda v: F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda i: v)))
    assert len(set(got)) == 1


def test_blank_runs_become_one_blank_and_single_blanks_are_not_written_again(spark):
    text = "A first\tsentence  of \t text.\t\tA second \n\n\n\n sentence \tof text. "
    assert one(spark, T.sentences(F.col("t"), normalise=True), t=text) == ["A first sentence of text.", "A second \n\n sentence of text."]
    plan = spark.createDataFrame([("a",)], ["t"]).select(T.sentences(F.col("t"), normalise=True))._jdf.queryExecution().optimizedPlan().toString()
    assert ", [ \\t]+," not in plan


def test_runs_of_characters_are_numbers_and_no_arrays_of_strings(spark):
    from filegrain.functions import scoring

    assert [len(scoring._runs("abcab", sizes)) for sizes in ([1], [2], [4], [5], [6], [1, 2, 4], [])] == [3, 3, 2, 1, 0, 8, 0]
    assert scoring._runs("xéß𝒳", [2])[0] in scoring._runs("éß", [2]) or scoring._runs("éß", [2])[0] in scoring._runs("xéß𝒳", [2])
    texts = spark.createDataFrame([(1, "A𝒳yz ÉSS"), (2, ""), (3, None), (4, "going concern"), (5, "a\n b")], "id int, text string")
    entries = ["𝒳", "𝒳yz é", "a", "Going", "going concern now", "\n b", "", "ncer"]
    lexicon = spark.createDataFrame([(s, 1, i) for i, s in enumerate(entries)], "signal string, tier int, ord int")
    hits = scoring.lexicon_table_hits(texts, lexicon, ["id"])
    assert sorted((r.id, r.ord) for r in hits.collect()) == [(1, 0), (1, 1), (1, 2), (4, 3), (4, 7), (5, 2), (5, 5)]
    assert "split(" not in hits._jdf.queryExecution().optimizedPlan().toString()
    assert scoring.lexicon_table_hits(texts, lexicon.limit(0), ["id"]).isEmpty()


@pytest.mark.parametrize("seed", range(40))
def test_phrases_of_a_batch_are_those_that_plain_search_finds(seed, monkeypatch):
    """Blocks of a few bytes, phrases of none to nine characters, nulls, slices of a batch."""
    import random

    import pyarrow as pa

    from filegrain.functions import phrases

    monkeypatch.setattr(phrases, "BLOCK", 7)
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("ab é") for _ in range(r.randrange(n)))
    for _ in range(50):
        wanted, texts = [word(10) for _ in range(r.randrange(6))], [None if r.random() < 0.1 else word(40) for _ in range(r.randrange(7))]
        cut = r.randrange(len(texts) + 1)
        found = phrases.Phrases(wanted).found(pa.array(texts, pa.string()).slice(cut)).to_pylist()
        assert found == [[i for i, p in enumerate(wanted) if t is not None and p in t] for t in texts[cut:]]


def test_a_text_is_read_once_for_all_phrases(spark):
    """No search for each phrase in the plan, and the text of a section is made once, not in the search's argument."""
    from filegrain.functions.scoring import find_hits

    df = spark.createDataFrame([("Going CONCERN, material weakness",), (None,), ("",)], ["t"]).repartition(2)
    hits = df.select("t", find_hits(T.let(F.col("t"), lambda t: F.concat(t, F.lit("; Default")))).alias("h"))
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "contains(" not in plan.lower() and plan.count("ArrowEvalPython") == 1
    assert {r["t"]: [h["signal"] for h in r["h"]] for r in hits.collect()} == {
        "Going CONCERN, material weakness": ["going concern", "material weakness", "default"], None: [], "": ["default"],
    }


def test_whether_there_is_a_text_is_no_count_of_its_characters(spark):
    from pyspark.sql import functions as F

    from filegrain.functions.scoring import score_text
    from filegrain.operators.alignment import missing_side

    df = spark.createDataFrame([("a fraud", ""), ("", None), (None, "x"), ("x", "y")], "t string, o string")
    got = [r[0] for r in df.select(missing_side(F.col("o"), F.col("t"))).collect()]
    assert got == ["Older filing text missing — cannot compare", "Both older and newer text are missing", "Newer filing text missing — cannot compare", None]
    plan = score_text(df, text="t", older="o")._jdf.queryExecution().optimizedPlan().toString()
    assert "length(" not in plan
