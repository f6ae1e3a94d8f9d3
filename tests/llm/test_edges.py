"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import json

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from filegrain.llm import decontaminate, html_text, langid, mixing, neardup, quality, quotes, toxicity, urls, vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
ITEMS = "item_id long, text string"
CLASHES = "score held_out words id set_name bands row_hash doc start shingle mix_slot _chosen _doc _hash k y t source_ n centre a b".split()

LONG = "lorem ipsum dolor sit amet " * 60_000
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again", "en", "a", 49), (2, None, "en", None, None), (3, "", None, "a", 0), (4, "12 34 !!", "de", "b", 8),
    (5, LONG, "en", "b", len(LONG)), (6, "the quick brown fox jumps over the lazy dog again", "en", "a", 49), (6, "the quick brown fox jumps over the lazy dog again", "en", "a", 49),
    (None, "nameless words stay in the table", None, "a", 10), (8, "le renard brun saute par dessus le chien", "fr", "b", 40), (9, "x", None, None, 1),
]
MARKS = [(1, 1, 0), (5, 1, 0), (6, 0, 1), (8, 1, 1), (9, None, None), (None, 0, 1), (77, 0, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, DOCS)
    for name in CLASHES:
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(MARKS, LABELS).withColumn("text", F.lit("clash"))


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "QUICK brown fox"), (2, None), (3, ""), (None, "lazy dog"), (4, "quick brown fox"), (4, "quick brown fox")], ITEMS).withColumn("length", F.lit(0))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS), spark.createDataFrame([], ITEMS)


def by_id(df, key="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append(r)
    return out


def test_decontamination(docs, items):
    got = by_id(decontaminate.contaminated(docs, items))
    assert sum(map(len, got.values())) == len(ROWS) and len(got[6]) == 2
    assert (got[1][0].n_words, got[1][0].n_hit, got[1][0].n_items) == (10, 5, 2)  # the nameless item hits, unlisted
    assert got[6][0] == got[6][1] and got[6][0].contaminated
    assert (got[2][0].n_words, got[3][0].n_words, got[4][0].n_words) == (0, 0, 2) and not got[5][0].contaminated
    kept = by_id(decontaminate.without_contaminated(docs, items))
    assert set(kept) == {2, 3, 4, 5, None, 8, 9} and kept[5][0].start == "start"


def test_decontamination_of_empty_tables(docs, items, nothing):
    assert decontaminate.contaminated(nothing[0], items).count() == 0
    got = decontaminate.contaminated(docs, nothing[2])
    assert got.count() == len(ROWS) and got.where("contaminated").count() == 0


def test_near_duplicates(docs, nothing):
    got = by_id(neardup.near_duplicates(docs))
    assert sum(map(len, got.values())) == len(ROWS)
    assert {r.component_id for r in got[6]} == {1} and got[1][0].kept and not got[6][0].kept
    assert [got[i][0].n_shingles for i in (2, 3, 4, 9)] == [0, 0, 1, 1] and all(got[i][0].kept for i in (2, 3, 4, 5, 9))
    assert got[None][0].kept and got[5][0].n_shingles == 5
    assert neardup.near_duplicates(nothing[0]).count() == 0
    kept = by_id(neardup.one_of_each(docs))
    assert set(kept) == {1, 2, 3, 4, 5, None, 8, 9} and all(len(v) == 1 for v in kept.values())


def test_trained_models(docs, labels, nothing):
    for table, columns in (
        (langid.language_table(docs), "lang_pred score"), (toxicity.toxicity_table(docs, labels), "score predicted"), (quality.quality_table(docs, labels), "score keep"),
    ):
        got = table.collect()
        assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r[c] is not None for r in got for c in columns.split())
        assert [r.held_out for r in got if r.doc_id is None] == [True]
    predicted = by_id(langid.language_table(docs))
    assert [predicted[i][0].lang_pred for i in (2, 3, 4)] == ["und"] * 3
    assert langid.language_table(nothing[0]).count() == toxicity.toxicity_table(nothing[0], labels).count() == quality.quality_table(nothing[0], labels).count() == 0
    assert toxicity.toxicity_table(docs, nothing[1]).where("predicted = 1").count() == 0
    assert quality.quality_table(docs, nothing[1]).where("score = 0.5").count() == len(ROWS)


def test_mixing(docs, nothing):
    got = mixing.mixed(docs, rows_per_block=1).collect()
    assert sorted(r.mix_position for r in got) == list(range(len(ROWS)))
    assert mixing.mixed(nothing[0]).count() == 0
    assert mixing.mixed(docs, {"a": 3.0}, rows_per_block=1).where("source is null or source = 'b'").agg(F.min("mix_phase")).first()[0] == 1


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme/x"), (4, "HTTP://Sub.Example.NET/en/1"), (5, "x://net?q=1#f"), (6, "x://evilnet/a"), (7, "x://a.org/fr/" + "s/" * 3000), (7, "x://a.org/fr/1"), (None, "x://b.example.com/de/?a")]
    got = by_id(urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))), "page_id")
    assert [(got[i][0].host, got[i][0].path, got[i][0].rule) for i in (1, 2, 3)] == [("", "", None)] * 3
    assert (got[4][0].host, got[4][0].rule, got[4][0].verdict) == ("sub.example.net", "example.net/en/", "allow")
    assert (got[5][0].host, got[5][0].path, got[5][0].rule) == ("net", "", None) and got[6][0].rule is None
    assert [r.rule for r in got[7]] == ["org/fr/"] * 2 and got[None][0].verdict == "block"
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>a &amp; b<p>c"), (3, "u", "<article>" + "<p>w</p>" * 20_000), (3, "u", "<script>x"), (4, "u", "<div " * 5000)]
    got = by_id(html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))), "page_id")
    assert got[1][0].text == got[2][0].text == "" and got[None][0].text == "a & b\n\nc"
    assert {r.n_chars for r in got[3]} == {0, 20_000 * 3 - 2} and got[4][0].text == ""
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there. How are\nyou today?"), (1, 1, "assistant", "> Hello there.\nHi. I am fine."),
        (1, 2, "user", "On Monday, X wrote:\n> > hello  there.\n> Hi. I am\n> fine.\nGood to hear!\n\nBye."),
        (1, 3, "assistant", "> Good to hear!\n>> Hi. I am fine.\n>>> Hello there.\nIndeed."), (1, 4, "user", None), (2, 0, None, ""), (None, 1, "user", "> x"),
        (2, None, "user", "> x"), (2, 1, "assistant", "> Hello there.\nno such"), (3, 0, "user", "w " * 200_000), (1, 3, "assistant", "> Good to hear!\nTwice."),
    ]
    got = quotes.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit(1))).collect()
    at = {(r.conv_id, r.turn, r.text[:7]): r for r in got}
    assert len(got) == len(rows)
    assert [(at[1, t, x].parent_turn, at[1, t, x].thread_turn, at[1, t, x].depth) for t, x in ((0, "Hello t"), (1, "Hi. I a"), (2, "Good to"), (3, "Indeed."), (3, "Twice."))] == [
        (None, 0, 0), (0, 0, 1), (1, 0, 2), (2, 0, 3), (2, 0, 3)
    ]
    assert at[1, 2, "Good to"].text == "Good to hear!\n\nBye." and at[1, 3, "Indeed."].max_level == 3
    assert at[2, 1, "no such"].n_linked == 0 and at[2, None, ""].n_quoted == 0
    assert quotes.linked(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, []), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    got = by_id(vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(0)).withColumn("near", F.lit(0))), "vec_id")
    assert {i: (v[0].n_links, v[0].component_id) for i, v in got.items() if v[0].n_links} == {1: (2, 1), 2: (2, 1), 9: (2, 1)} and len(got[9]) == 2
    assert all(v[0].component_id == i and v[0].kept for i, v in got.items() if i not in (2, 9))
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pipeline_stages(spark, docs, labels, items, nothing, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (docs, nothing[0]):
        table = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, table, str(tmp_path))
            assert after.columns == start.columns, name
            assert json.loads(after.schema.json())["fields"][0]["type"] == "long"
            table = spark.createDataFrame(after.collect(), after.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path)).count() == table.count()


def test_messages_are_taken_apart_once(spark):
    """Rows of sentences are made by an outer generator: no filter below it takes the messages apart once more."""
    from filegrain.llm import quotes as q

    kept = []
    real = q.written
    q.written = lambda df, name: kept.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or real(df, name)
    try:
        rows = [(1, 1, "a", "One is said. Two is said."), (1, 2, "b", "> One is said.\n> Two is said.\n>> Zero.\nAgreed."), (None, 1, "a", "> x"), (1, None, "a", "y")]
        got = q.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(2)).collect()
    finally:
        q.written = real
    said = [plan for name, plan in kept if name == "quotes-said"]
    assert len(said) == 1 and said[0].count("Generate") == 1
    assert not any("size(" in line for line in said[0].split("\n") if "Filter" in line)
    assert {(r["conv_id"], r["turn"]): (r["n_quoted"], r["n_linked"], r["max_level"], r["parent_turn"]) for r in got if r["conv_id"] and r["turn"]} == {
        (1, 1): (0, 0, 0, None), (1, 2): (3, 2, 2, 1),
    }
