import datetime as dt
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from filegrain.functions import fixed_values as fv
from filegrain.functions.text import match_spans
from filegrain.operators import recency
from filegrain.operators import sections as S
from filegrain.operators.insider import form4_transactions, transaction_rows
from filegrain.operators.items import event_items
from filegrain.operators.nodes import _outline_of, outline
from filegrain.plans import compare, report, trends
from filegrain.plans.score import score_sections
from filegrain.sources import landed

RISK = "Our business could be harmed by a data breach, and we may face litigation over our disclosures. "
MDA = "Revenue and operating income increased compared with the prior year while net expense fell. "


def page(risk, mda, first="Item 1A. Risk Factors", second="Item 7. Management's Discussion", ids=("item1a", "item7")):
    return (
        f'<html><body><div id="{ids[0]}"><div style="font-weight:bold">{first}</div><p>{risk}</p></div>'
        f'<div><div style="font-weight:bold">Item 1B. Staff</div><p>None</p></div>'
        f'<div id="{ids[1]}"><div style="font-weight:bold">{second}</div><p>{mda}</p></div>'
        '<div><div style="font-weight:bold">Item 8. Statements</div><p>None</p></div></body></html>'
    )


def filings(spark, rows):
    return spark.createDataFrame(rows, "accession_number string, form_type string, html string")


def test_sections_by_anchor(spark):
    row = S.extract(filings(spark, [("a", "10-K", page(RISK * 8, MDA * 8))])).first()
    assert row["risk_factors"]["method"] == "anchor_href" and row["mda"]["item_label"] == "Item 7"
    assert row["risk_factors"]["text"].startswith("Item 1A. Risk Factors\nOur business")
    assert "Staff" not in row["risk_factors"]["text"] and row["both_succeeded"]


def test_anchor_label_does_not_run_on(spark):
    html = page(RISK * 8, MDA * 8, ids=("item1a", "item7a"))
    assert S.extract(filings(spark, [("a", "10-K", html)])).first()["mda"]["method"] == "ixbrl_div"


def test_table_of_contents_entry_is_no_heading(spark):
    html = f"<h2>Item 1A. Risk Factors 12</h2><p>x</p><h2>Item 1A. Risk Factors</h2><p>{RISK * 8}</p><h2>Item 2. Properties</h2>"
    text = S.extract(filings(spark, [("a", "10-K", html)])).first()["risk_factors"]["text"]
    assert text.startswith("Our business") and "Properties" not in text


def words(out, mark):
    return out["plain"][mark["plain_at"]:mark["plain_past"]]


def test_unclosed_tags_do_not_swallow_the_document():
    out = _outline_of("<p><b>Head<br><p>one<p>two<table><tr><td>x<td>y<tr><td>z</table><h2>End</h2>")
    assert out["text"] == "Head\none\ntwo\nx\ny\nz\nEnd"
    bold = next(m for m in out["marks"] if m["tag"] == "b")
    assert words(out, bold) == "head" and bold["parent"] == "p" and bold["parent_chars"] == bold["chars"]


def test_compatibility_characters_in_headings():
    out = _outline_of("<h2>Item 1A. Risk Factors ﬁnal</h2>")
    assert words(out, out["marks"][0]) == "item 1a. risk factors final"


def test_outline_of_nested_marks_is_as_long_as_the_page():
    for n in (200, 2000):
        page = "<b>risk " * n + "end" + "</b>" * n + "<i></u>" * n
        out = _outline_of(page)
        assert len(out["text"]) + len(out["plain"]) < 3 * len(page) and len(out["marks"]) == n
        assert words(out, out["marks"][n - 2]) == "risk risk end" and words(out, out["marks"][0]).count("risk") == n


def test_words_of_runs_that_change_length():
    out = _outline_of("<p>a\u00a8b</p><h3>\u00a8 \u2003 Ａ½ <b>ﬃ</b></h3><h4>\u0307</h4><h4> </h4>")
    assert [words(out, m) for m in out["marks"]] == ["\u0308 a1\u20442 ffi", "ffi", "\u0307", ""]
    assert out["plain"] == " ".join(unicodedata.normalize("NFKD", out["text"]).lower().split())


def test_start_patterns_in_nested_and_cut_words(spark):
    """A match that runs beyond a mark does not count for it; one inside does, however deep."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("<b>item <i>1a</i></b><b>risk</b><h2>x item 1a. risk factors</h2>",)], "html string").withColumn("o", outline(F.col("html")))
    pattern = r"(?i)(?:item\s*1a\.?\s*risk)"
    got = df.select(F.transform("o.marks", lambda m: S._holds(F.col("o.plain"), m, match_spans(F.col("o.plain"), pattern), pattern)).alias("x")).first()["x"]
    assert got == [False, False, True]


def test_quarterly_pointer_is_a_failure(spark):
    risk = (
        "The information is incorporated by reference from our Annual Report on Form 10-K for the fiscal year, Part I, Item 1A. "
        "See that report for a full discussion of risks that could materially affect our business and results. " * 3
    )
    html = page(risk, MDA * 8, second="Item 2. Management's Discussion", ids=("item1a", "item2"))
    row = S.extract(filings(spark, [("a", "10-Q", html)])).first()
    assert not row["risk_factors"]["extraction_success"] and row["risk_factors"]["confidence_score"] == 0.0
    assert row["mda"]["item_label"] == "Item 2"


def test_missing_body_stays_as_a_row(spark):
    row = S.extract(filings(spark, [("a", "10-K", None)])).first()
    assert not row["readable"] and row["risk_factors"]["method"] == "raw_fallback" and row["full_doc_char_count"] == 0


def index(spark, rows):
    return spark.createDataFrame(
        rows, "ticker string, cik string, form_type string, accession_number string, filing_date date, index_pos int")


D = dt.date


def test_compare_end_to_end(spark):
    idx = index(spark, [
        ("AA", "1", "10-K", "new", D(2024, 1, 1), 0), ("AA", "1", "10-K", "old", D(2023, 1, 1), 1), ("AA", "1", "10-K", "older", D(2022, 1, 1), 2),
        ("BB", "2", "10-K", "lone", D(2024, 1, 1), 0), ("CC", "3", "10-K", "c2", D(2024, 1, 1), 0), ("CC", "3", "10-K", "c1", D(2023, 1, 1), 1),
    ])
    numbered = lambda s, n: " ".join(f"Point {i}: {s}" for i in range(n))
    old = page(numbered(RISK, 40), numbered(MDA, 90))
    new = page(numbered(RISK, 40) + " There is substantial doubt and going concern language here now.", numbered(MDA, 90))
    bodies = spark.createDataFrame([("new", new), ("old", old), ("lone", old), ("c2", new)], "accession_number string, html string")
    rows = {(r["ticker"], r["section_name"]): r for r in compare.compare_filings(idx, bodies).collect()}
    risk = rows["AA", "risk_factors"]
    assert risk["pipeline_success"] and risk["magnitude"] == "minor" and risk["added_count"] == 1
    assert [h["signal"] for h in risk["new_signals"]] == ["going concern", "substantial doubt"]
    # 12 + 6 for new signals, bases, in-change bonuses and 2 for a minor change
    assert risk["raw_score"] == pytest.approx(1 * 2 + 0.5 * 2 + 0.1 * 2 + 1.5 + 0.75 + 18 + 2, abs=0.5)
    assert rows["AA", "mda"]["magnitude"] == "none" and rows["AA", "mda"]["unchanged_count"] > 0
    assert "Only 1 10-K filing(s) found for BB" in rows["BB", "mda"]["failure_reason"]
    assert rows["CC", "mda"]["failure_reason"].startswith("older HTML")
    top = compare.overall(compare.compare_filings(idx, bodies).where("pipeline_success"), ["ticker"]).first()
    assert top["top_signals"][0] == "substantial doubt [risk_factors]"


def test_report_uses_facts_and_keeps_ratio_decimals(spark):
    idx = index(spark, [("AA", "1", "10-K", "new", D(2024, 1, 1), 0), ("AA", "1", "10-K", "old", D(2023, 1, 1), 1)])
    bodies = spark.createDataFrame([("new", page(RISK * 30, MDA * 80)), ("old", page(RISK * 30, MDA * 80))], "accession_number string, html string")
    facts = spark.createDataFrame(
        [("1", "AssetsCurrent", 0, "2024", 30.0), ("1", "LiabilitiesCurrent", 0, "2024", 20.0), ("1", "Revenues", 0, "2024", 1234567.0)],
        "cik string, tag string, pos int, end string, val double")
    row = report.executive_reports(idx, bodies, facts, F.lit("2024-03-04").cast("date")).first()
    assert row["pipeline_success"] and "  • Current Ratio: 1.50" in row["report"] and "  • Revenue: 1,234,567" in row["report"]
    assert "Generated March 04, 2024" in row["report"] and "unchanged (0% of sentences affected)" in row["report"]


@pytest.mark.parametrize("tiers,level", [((7, 2, 0), "moderate"), ((19, 2, 0), "high"), ((7, 1, 4), "low"), ((7, 1, 5), "moderate")])
def test_score_cut_offs_are_exact(spark, tiers, level):
    from filegrain.functions.scoring import Lexicon

    words = {t: [f"w{t}x{i:02d}y" for i in range(n)] for t, n in zip((1, 2, 3), tiers)}
    text = " ".join(w for ws in words.values() for w in ws)
    df = spark.createDataFrame([(text,)], "text string")
    assert score_sections(df, lexicon=Lexicon.of(words)).first()["materiality"] == level


def test_trend_with_one_filing(spark):
    pts = spark.createDataFrame(
        [("AA", "10-K", D(2024, 1, 1), 1, "a", 3.0, "low", ["x"])],
        "ticker string, form_type string, filing_date date, rn int, accession_number string, risk_raw_score double, risk_materiality string, signal_set array<string>")
    row = trends.trend_summary(pts).first()
    assert row["trajectory"] == "single_point" and row["total_new_signals"] == 0
    assert trends.signal_transitions(pts).count() == 0


def test_event_items(spark):
    text = "Item 1.01 first part Item 5.06 unknown part item 1.01 again Item 9.01 " + "x " * 1500
    got = spark.createDataFrame([(text,)], "t string").select(event_items(F.col("t")).alias("i")).first()["i"]
    assert [(i["item_number"], i["excerpt"][:12]) for i in got] == [("1.01", "first part"), ("9.01", "x x x x x x ")]
    assert len(got[1]["excerpt"]) == 300


def test_form4_edges(spark):
    xml = (
        "<ownershipDocument><rptOwnerName>A &amp; B</rptOwnerName><isDirector>1</isDirector><isTenPercentOwner>1</isTenPercentOwner>"
        "<nonDerivativeTransaction><transactionCode>P</transactionCode><transactionShares><value>1,000</value></transactionShares></nonDerivativeTransaction>"
        "<nonDerivativeTransaction><transactionShares><value>5</value></transactionShares></nonDerivativeTransaction>"
        "<nonDerivativeTransaction><transactionCode>Z</transactionCode></nonDerivativeTransaction></ownershipDocument>"
    )
    table = "<table><tr><td>a</td><td>S</td><td>2,500</td><td>d</td></tr><tr><td>S</td><td>1</td></tr></table>"
    df = spark.createDataFrame([("x", xml, None), ("t", "<broken", table), ("n", None, None)], "accession_number string, xml string, rendered_html string")
    parsed = form4_transactions(df)
    rows = [tuple(r) for r in transaction_rows(parsed).select("accession_number", "code", "shares", "insider_name", "insider_title", "transaction_type").collect()]
    assert sorted(rows, key=repr) == sorted([
        ("x", "P", 1000.0, "A & B", "Director, 10% Owner", "Open market purchase"),
        ("x", "Z", None, "A & B", "Director, 10% Owner", "Other"),
        ("t", "S", 2500.0, "Unknown insider", "Insider", "Open market sale"),
    ], key=repr)


def test_previous_row_crosses_buckets(spark):
    rows = [(k, i, i * 10) for k in ("a", "b") for i in range(0, 50, 3)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = recency.previous_row(df, ["k"], ["i"], F.floor(F.col("i") / 7), "v", "before").collect()
    assert all(r["before"] == (r["i"] - 3) * 10 if r["i"] else r["before"] is None for r in got) and len(got) == len(rows)


def test_newest_limits_before_the_exchange(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "A").otherwise("B").alias("ticker"), F.lit("10-K").alias("form_type"), F.col("id").alias("index_pos"), F.lit(None).cast("date").alias("filing_date"))
    plan = recency.newest(df, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert sorted(r["index_pos"] for r in recency.newest(df, 3).collect()) == [0, 1, 2, 900, 901, 902]


def test_short_date_arrays_and_viewer_links(spark):
    page_json = '{"form":["4","8-K"],"accessionNumber":["0-1","0-2"],"filingDate":["2024-01-02"],"primaryDocument":[]}'
    rows = landed.submission_rows(spark.createDataFrame([(0, page_json)], "page int, json string")).orderBy("pos").collect()
    assert [(r["accession_number"], r["filing_date"], r["primary_document"]) for r in rows] == [("01", D(2024, 1, 2), ""), ("02", None, "")]
    url = F.lit("https://www.sec.gov/ix?doc=/Archives/edgar%2Fa.htm")
    assert spark.range(1).select(landed.unwrapped_url(url)).first()[0] == "https://www.sec.gov/Archives/edgar/a.htm"


def test_history_page_filters_and_pages(spark):
    from filegrain.operators.accounts import history_page, owned_by

    rows = [(i, "u1" if i % 2 else "u2", "AA" if i < 6 else "BB", "report", D(2024, 1, 1 + i)) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, user_id string, ticker string, tool_name string, created_at date")
    page = history_page(owned_by(df, F.lit("u1")), ["id", "created_at"], limit=2, offset=1, ticker="aa")
    assert [r["id"] for r in page.collect()] == [3, 1]


def test_landed_bodies_stay_where_they_are(spark, tmp_path):
    """With bodies bucketed by accession and nothing small enough to broadcast, only narrow rows are exchanged."""
    rows = [(f"A{i}", f"<p>{'text ' * 50}{i}</p>") for i in range(400)]
    bodies = landed.land_bodies(spark.createDataFrame(rows, "accession_number string, html string"), "landed_bodies", 4, f"{tmp_path}/bodies")
    index = spark.createDataFrame(
        [(f"T{i % 40}", "10-K", f"A{i}", i) for i in range(420)], "ticker string, form_type string, accession_number string, index_pos int"
    ).withColumn("filing_date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("index_pos") % 300))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = recency.with_bodies(recency.newest(index, 2), bodies)
        got = joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
        depth = lambda line: len(line) - len(line.lstrip(" :+-*|"))
        scans = [at for at, line in enumerate(plan) if "Scan parquet" in line and "html" in line]
        assert scans
        for at in scans:
            level, above = depth(plan[at]), []
            for up in reversed(plan[:at]):
                if depth(up) < level:
                    level = depth(up)
                    above.append(up)
            between = above[: ["Join" in u for u in above].index(True)]
            assert not any("Exchange" in u or "Sort" in u for u in between), "\n".join(plan)
        assert len(got) == 80 and sum(r["html"] is None for r in got) == sum(int(r["accession_number"][1:]) >= 400 for r in got)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE landed_bodies")


def test_form4_with_comments_and_cdata(spark):
    from filegrain.operators.insider import form4_transactions

    xml = (
        "<ownershipDocument><!-- <nonDerivativeTransaction><transactionCode>S</transactionCode></nonDerivativeTransaction> -->"
        "<rptOwnerName><![CDATA[Doe & Sons]]></rptOwnerName><nonDerivativeTransaction><transactionCode>P</transactionCode>"
        "<transactionShares><!-- in units --><value>1,200</value></transactionShares></nonDerivativeTransaction></ownershipDocument>"
    )
    row = form4_transactions(spark.createDataFrame([(xml, None)], "xml string, rendered_html string")).first()
    assert row["insider_name"] == "Doe & Sons" and [(t["code"], t["shares"]) for t in row["transactions"]] == [("P", 1200.0)]


@pytest.mark.parametrize("name", ["compare_filings", "trend_summary", "categorize_risks"])
def test_registered_analyses_move_no_bodies(spark, sf_dir, name):
    """With broadcasts off nothing above a scan of ``html`` exchanges or sorts it before the join that needs it."""
    import __spark_entry__ as entry_point

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = entry_point.queries()[name](spark, sf_dir)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*|"))
    scans = [at for at, line in enumerate(plan) if "Scan parquet" in line and "html" in line]
    assert scans
    for at in scans:
        level, above = depth(plan[at]), []
        for up in reversed(plan[:at]):
            if depth(up) < level:
                level = depth(up)
                above.append(up)
        between = above[: ["Join" in u for u in above].index(True)]
        assert not any("Exchange" in u or "Sort" in u for u in between), "\n".join(plan)


def test_bare_tags_are_known_without_the_tolerant_search(monkeypatch):
    """The library reads tags with attributes and scripts; results are those of its reading of every tag."""
    from html.parser import HTMLParser

    from filegrain.operators import nodes

    page = "<p>One</p><b>two</b><script>a<p>b</script><h2>é ½</h2><td>x</p ><DIV id='a'>y</DIV></p><!-- <p> --><p" * 50
    monkeypatch.setattr(nodes, "_BARE_TAG", re.compile("(?!)"), raising=False)
    whole = _outline_of(page)
    monkeypatch.undo()
    calls = []
    for name in ("parse_starttag", "parse_endtag"):
        read = getattr(HTMLParser, name)
        monkeypatch.setattr(HTMLParser, name, lambda self, i, read=read: calls.append(i) or read(self, i))
    assert _outline_of(page) == whole
    calls.clear()
    assert len(_outline_of("<h2>Item 1</h2>" + "<p>A sentence.</p>" * 1000)["text"]) > 9000 and not calls


def test_common_beginnings_of_patterns_are_looked_for_once():
    for form in fv.SECTION_SPECS.values():
        for patterns in [p for spec in form for p in (spec[S._STARTS], spec[S._ENDS])]:
            joined, plain = S._either(patterns), re.compile("(?i)(?:" + "|".join(patterns) + ")")
            assert joined.count(r"item\s+") == 1
            text = " x ".join(f"{i}{gap}{n}{tail}" for i in ("Item", "item") for gap in (" ", "\n  ", "") for n in ("1A", "1b", "2", "3.d", "3 . D", "3", "4", "5", "6", "7", "7a", "8")
                              for tail in ("", ". Risk  Factors", " - management", ". Discussion", " MD&A", ". Operating and financial", " quantitative", "x"))
            assert [m.span() for m in re.finditer(joined, text)] == [m.span() for m in plain.finditer(text)] != []


def test_paragraphs_without_markup_are_taken_in_one_go(monkeypatch):
    """No call for their tags; what is found is what the library finds by reading every tag."""
    import random

    from filegrain.operators import nodes

    bits = ["<p>one</p>", "<p> </p>\n", "<p>a &amp; b</p>", "<p>", "</p>", "<div id='x'>", "<div>", "</div>", "<b>", "</b>", "<h2>", "</h2>", "Item 7", "<td>",
            "<script>", "</script>", "<br>", "&#65;", "<", "<a name='q'>", "</a>", "<li>", "<title>", "</title>", "<!--", "-->", "<p>é ½</p>"]
    pages = ["".join(random.Random(seed).choices(bits, k=20)) for seed in range(2000)]
    fast = [_outline_of(p) for p in pages]
    with monkeypatch.context() as plain:
        plain.setattr(nodes, "_BARE_TAG", re.compile("(?!)"))
        assert [_outline_of(p) for p in pages] == fast
    calls = []
    read = nodes._Outline.handle_starttag
    monkeypatch.setattr(nodes._Outline, "handle_starttag", lambda self, tag, attrs: calls.append(tag) or read(self, tag, attrs))
    assert len(_outline_of("<h2>Item 1</h2>\n" + "<p>A sentence.</p>\n" * 1000)["text"]) > 9000 and calls == ["h2"]


def test_only_words_of_possible_headings_are_kept_plain():
    """A mark has the words that it has in the whole plain text; the words of other runs do not come back."""
    import random

    bits = ["<p>one</p>", "<p>a &amp; b</p>", "<div id='x'>", "<div style='font-weight:bold'>", "</div>", "<b>", "</b>", "<h2>", "</h2>", "Item 7", "<h3/>", "<td>",
            "<a href='#q'>", "<a name='q'>", "</a>", "ﬃ ½", "¨", "<li>", "<br>", "<strong>", "</strong>", "Item 1A. Risk"]
    for seed in range(3000):
        page = "".join(random.Random(seed).choices(bits, k=25))
        whole, some = _outline_of(page), _outline_of(page, whole=False)
        told = lambda out: [{k: v for k, v in m.items() if k not in ("plain_at", "plain_past")} | {"words": m["plain_at"] is not None and words(out, m)} for m in out["marks"]]
        assert told(some) == told(whole) and some["text"] == whole["text"] and some["size"] == len(some["text"])
        count = lambda n: len((some["text"] + "\n")[:n].encode())
        assert some["bytes"] == len(some["text"].encode())
        assert all(m["byte"] == count(m["at"]) and m["body_byte"] == count(m["body_at"]) for m in some["marks"])
        assert all(w in " ".join(words(whole, m) for m in whole["marks"] if m["plain_at"] is not None) for w in some["plain"].split())
    assert _outline_of("<h2>Item 1</h2>" + "<p>A sentence.</p>" * 1000, whole=False)["plain"] == "item 1"


def test_bodies_are_places_until_one_is_chosen(spark):
    """No text is cut for the sections that are not taken; lengths are differences of places."""
    html = f"<p>é½ ü</p><h2>Item 1A. Risk Factors</h2><p>{RISK}</p><h2>Item 1B. None</h2><h3>Item 1A. Risk Factors</h3><p> {RISK * 8}</p>\n<h2>Item 2. Properties</h2><p>é</p>"
    df = spark.createDataFrame([(html,)], "html string").select(outline(F.col("html")).alias("o"))
    marks = F.transform("o.marks", lambda m: F.struct(m["body_at"], m["at"], m["body_byte"], m["byte"], (m["tag"] == "h2").alias("ends")))
    places = S._bodies(F.col("o.size"), F.col("o.bytes"), marks, marks)
    row = df.select(places.alias("b"), "o.text", F.transform(places, lambda b: S._cut(F.col("o.text"), b)["text"]).alias("cut")).first()
    cut = [row["text"][b["at"] : b["at"] + b["chars"]] for b in row["b"]]
    assert cut == [RISK.strip(), "Item 1A. Risk Factors\n" + (RISK * 8).strip(), (RISK * 8).strip(), "é"] == row["cut"]
    assert row["b"][2]["chars"] == len((RISK * 8).strip())


@pytest.mark.parametrize("text,good", [("risk " * 50, False), ("risk " * 50 + "could", True), ("could risk", False), (None, None)])
def test_plausible_needs_two_words_and_length(spark, text, good):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(S.plausible(F.col("t"), ("risk", "zebra", "could"))).first()[0] == good
    assert df.select(S.plausible(F.col("t"), ("zebra", "could", "risk"), F.length("t"))).first()[0] == good


@pytest.mark.parametrize("name", ["extraction_gate", "compare_gate", "compare_extraction"])
def test_texts_nobody_asks_for_stay_behind(spark, sf_dir, name):
    """What a gate says needs lengths and methods; the sections' texts are in no exchange."""
    import __spark_entry__ as entry_point

    plan = entry_point.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    paired = [line for line in plan.splitlines() if "Aggregate [" in line and "collect_list" in line]
    assert len(paired) == 1 and paired[0].count("collect_list") == 1 and ".text" not in paired[0]


def test_bodies_are_made_in_their_buckets(spark, tmp_path):
    """Only what bodies are made of moves; they are written unsorted, one file a bucket, and so that repeats cost little."""
    import glob

    import pyarrow.parquet as pq

    said = "a sentence of a filing that stands in it again and again, "
    rows = spark.range(300).select(F.col("id").cast("string").alias("accession_number"))
    grown = lambda df: df.select("accession_number", F.repeat(F.concat(F.lit(said), "accession_number"), 200).alias("html"))
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    try:
        out = landed.land_bodies(rows, "grown_bodies", 4, f"{tmp_path}/bodies", finish=grown)
        files = glob.glob(f"{tmp_path}/bodies/*.parquet")
        meta = [pq.ParquetFile(f).metadata for f in files]
        assert len(files) == 4 and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
        assert {m.row_group(0).column(1).compression for m in meta} == {"ZSTD"}
        for key in ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch"):
            assert int(spark.conf.get(key)) <= 256
        assert out.where(F.length("html") == 200 * (len(said) + F.length("accession_number"))).count() == 300
    finally:
        spark.sql("DROP TABLE grown_bodies")
