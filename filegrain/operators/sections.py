"""Locate the risk-factor and discussion sections of periodic reports.

One row per filing goes in, one row per (filing, section) comes out, with no
exchange. Strategies are tried from the most to the least trustworthy; each is
an expression over the outline's marks and text, evaluated only when the ones
before it gave nothing plausible.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import groupby
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import let, match_spans, string_array, strip
from .nodes import heading, outline

_METHODS = ("anchor_href", "heading_tag", "ixbrl_div", "toc_link", "pattern_match")


def _spec(form: str, section: int) -> tuple:
    return fv.SECTION_SPECS[form][section]


_LABEL, _DISPLAY, _STARTS, _ENDS, _NEXT, _KEYWORDS, _LEAST = range(1, 8)


def _by_form(form: Column, section: int, field: int, make: Callable[[Any], Column] = F.lit) -> Column:
    """A spec field as a column for the row's form. Forms without a layout of
    their own use the annual report's; equal fields share one branch."""
    usual = _spec("10-K", section)[field]
    out = None
    for name in fv.SECTION_SPECS:
        own = _spec(name, section)[field]
        if own != usual:
            out = F.when(form == name, make(own)) if out is None else out.when(form == name, make(own))
    return make(usual) if out is None else out.otherwise(make(usual))


#: What most patterns begin with; none goes on with white space.
_LEAD = r"item\s+"


def _either(patterns: Sequence[str]) -> str:
    """One of the patterns, the first that fits. Their common beginning is looked for once, the rest only behind it."""
    parts = []
    for led, some in groupby(patterns, lambda p: p.startswith(_LEAD)):
        parts += [f"{_LEAD}(?:" + "|".join(p.removeprefix(_LEAD) for p in some) + ")"] if led else list(some)
    return f"(?i){parts[0]}" if len(parts) == 1 else "(?i)(?:" + "|".join(parts) + ")"


def plausible(text: Column, keywords: Sequence[str], chars: Column | None = None) -> Column:
    """Long enough and using at least two of the section's words: none is looked for once two are found.
    ``chars``: the text's length, where it is known."""
    words, later = string_array(keywords), len(keywords)
    used = let(
        F.lower(text),
        lambda t: F.exists(
            F.transform(words, lambda k, i: F.struct(k.alias("k"), i.alias("i"))),
            lambda x: F.contains(t, x["k"]) & F.exists(F.slice(words, x["i"] + 2, F.lit(later)), lambda k: F.contains(t, k)),
        ),
    )
    return ((F.length(text) if chars is None else chars) >= fv.PLAUSIBLE_CHARS) & used


def toc_entry(plain: Column, mark: Column) -> Column:
    """A short line ending in a page number."""
    return F.when(mark["chars"] < 80, F.coalesce(heading(plain, mark), F.lit("")).rlike(r"\d{1,3}\s*$")).otherwise(F.lit(False))


def standalone_heading(mark: Column) -> Column:
    tag = mark["tag"]
    bold_block = (
        tag.isin("div", "span") & mark["bold"] & (mark["chars"] < 150)
        & ~F.coalesce(mark["parent"], F.lit("")).isin("p", "li", "span")
    )
    whole_paragraph = (
        tag.isin("b", "strong") & (mark["parent"] == "p") & (mark["parent_chars"] == mark["chars"])
    )
    return tag.isin("h1", "h2", "h3", "h4") | bold_block | F.coalesce(whole_paragraph, F.lit(False))


def pointer(text: Column, rule: tuple[int, Sequence[str]], chars: Column | None = None) -> Column:
    """A short text that only refers to another filing. ``chars``: its length, where it is known."""
    limit, phrases = rule
    return F.coalesce(
        ((F.length(text) if chars is None else chars) < limit)
        & let(F.lower(text), lambda t: F.exists(string_array(phrases), lambda p: F.contains(t, p))),
        F.lit(False),
    )


def _anchor_pattern(item_label: str) -> str:
    """The item label inside an id, not running on into a longer label."""
    compact = item_label.lower().replace(" ", "").replace(".", r"\.")
    return compact + "(?![a-z0-9])"


def _holds(plain: Column, mark: Column, spans: Column, pattern: str) -> Column:
    """Whether a mark's words hold a match. ``spans`` are the matches in the whole text: one inside is enough, none near is
    too; only words that cut through one are searched by themselves, so nested marks are not read again and again."""
    within = F.exists(spans, lambda s: (s["first"] >= mark["plain_at"]) & (s["past"] <= mark["plain_past"]))
    cut = F.exists(spans, lambda s: (s["first"] < mark["plain_past"]) & (s["past"] > mark["plain_at"]))
    return F.coalesce(F.when(within, F.lit(True)).when(cut, heading(plain, mark).rlike(pattern)), F.lit(False))


def _annotate(plain: Column, marks: Column, form: Column, section: int) -> Column:
    """Marks with what they can be for this section: start, end, anchor."""

    def one(m: Column, spans: Column) -> Column:
        compact_ids = F.regexp_replace(F.lower(F.coalesce(m["ids"], F.lit(""))), r"[\s\-_]", "")
        next_items = lambda items: let(
            heading(plain, m, max(map(len, items))), lambda h: F.coalesce(F.exists(string_array(items), lambda p: F.startswith(h, p)), F.lit(False))
        )
        return F.struct(
            m["tag"].alias("tag"), m["bold"].alias("bold"), m["ids"].alias("ids"), m["href"].alias("href"),
            *[m[c].alias(c) for c in ("at", "body_at", "byte", "body_byte")], toc_entry(plain, m).alias("toc"),
            _by_form(form, section, _STARTS, lambda p: _holds(plain, m, spans, _either(p))).alias("starts"),
            _by_form(form, section, _LABEL, lambda label: compact_ids.rlike(_anchor_pattern(label))).alias("anchors"),
            (standalone_heading(m) & _by_form(form, section, _NEXT, next_items)).alias("ends"),
        )

    starts = _by_form(form, section, _STARTS, lambda p: F.lit(_either(p)))
    return let(match_spans(plain, starts), lambda spans: F.transform(marks, lambda m: one(m, spans)))


def _bodies(size: Column, count: Column, marks: Column, starts: Column) -> Column:
    """Where the text from each start to the next ending heading (or the end) begins and how long it is, in characters and
    in bytes; ``size`` and ``count`` are the whole text's. Marks stand where a run of text begins, and runs have no white
    space around them: what lies before a mark ends with one break."""

    def body(s: Column, stop: Column) -> Column:
        length = lambda place, start, whole: F.greatest(F.coalesce(stop[place] - 1, whole) - s[start], F.lit(0))
        return F.struct(
            s["body_at"].alias("at"), length("at", "body_at", size).alias("chars"),
            s["body_byte"].alias("byte"), length("byte", "body_byte", count).alias("bytes"),
        )

    return let(
        F.transform(F.filter(marks, lambda m: m["ends"]), lambda m: F.struct(m["at"], m["byte"])),
        lambda stops: F.transform(
            starts, lambda s: let(F.array_min(F.filter(stops, lambda e: e["at"] >= s["body_at"])), lambda stop: body(s, stop)),
        ),
    )


def _cut(text: Column, place: Column) -> Column:
    """The text of a place as struct of ``text`` and ``chars``: only a chosen one is copied, by its bytes, so that no
    characters are counted."""
    cut = lambda b: F.substring(text.cast("binary"), b["byte"] + 1, b["bytes"]).cast("string")
    return let(place, lambda b: F.when(b.isNotNull(), F.struct(cut(b).alias("text"), b["chars"].alias("chars"))))


def _first_long(bodies: Column) -> Column:
    return F.get(F.filter(bodies, lambda b: b["chars"] >= fv.MIN_SECTION_CHARS), F.lit(0))


def _first_long_or_longest(bodies: Column) -> Column:
    def pick(b: Column) -> Column:
        longest = F.array_max(F.transform(
            F.filter(b, lambda x: x["chars"] > 0),
            lambda x, i: F.struct(x["chars"].alias("n"), (-i).alias("i"), x.alias("x")),
        ))["x"]
        return F.coalesce(_first_long(b), longest)

    return let(bodies, pick)


def _by_tag_order(marks: Column) -> Column:
    """Heading starts: all h1, then all h2, … then b and strong."""
    return F.concat(*[_of_tag(marks, tag) for tag in ("h1", "h2", "h3", "h4", "b", "strong")])


def _of_tag(marks: Column, tag: str) -> Column:
    return F.filter(marks, lambda m: (m["tag"] == tag) & m["starts"] & ~m["toc"])


def _toc_target(marks: Column) -> Column:
    """The element that the first matching table-of-contents link points to."""
    link = F.get(F.filter(marks, lambda m: m["href"].isNotNull() & m["starts"]), F.lit(0))["href"]
    return let(
        link,
        lambda name: F.slice(
            F.filter(marks, lambda m: F.array_contains(F.split(m["ids"], r"\|"), name)), 1, 1
        ),
    )


def pattern_section(
    text: Column, starts: str | Column, ends: str | Column, min_chars: int | Column, open_end_chars: int | None = None,
    size: Column | None = None,
) -> Column:
    """Plain-text strategy: the first start whose span to the next end match is
    long enough. Without an end match the span runs to the end of the text, or
    ``open_end_chars`` characters. Patterns may differ by row. ``size``: the text's length, where it is known."""

    def find(v: Column) -> Column:
        def body(s: Column) -> Column:
            stop = F.array_min(F.filter(v["e"], lambda e: e >= s["past"]))
            open_stop = v["n"] if open_end_chars is None else s["first"] + open_end_chars
            return F.struct(s["first"].alias("at"), (F.coalesce(stop, open_stop) - s["first"]).alias("chars"))

        # what is too short with the white space around it is not copied
        long = F.filter(F.transform(v["s"], body), lambda b: b["chars"] >= min_chars)
        stripped = F.transform(long, lambda b: strip(F.substring(v["t"], b["at"] + 1, b["chars"])))
        return F.get(F.filter(stripped, lambda b: F.length(b) >= min_chars), F.lit(0))

    return let(
        F.struct(
            text.alias("t"), (F.length(text) if size is None else size).alias("n"),
            match_spans(text, starts).alias("s"),
            F.transform(match_spans(text, ends), lambda m: m["first"]).alias("e"),
        ),
        find,
    )


def _section(section: int, form: Column, text: Column, size: Column, count: Column, plain: Column, marks: Column) -> Column:
    """The best body of one section with its length and the method that found it."""
    keywords = lambda b: _by_form(form, section, _KEYWORDS, lambda words: plausible(b["text"], words, b["chars"]))

    def located(m: Column) -> Column:
        placed = lambda starts, choose=_first_long: _cut(text, choose(_bodies(size, count, m, starts)))
        bodies = {
            "anchor_href": placed(F.filter(m, lambda x: x["anchors"])),
            "heading_tag": placed(_by_tag_order(m)),
            "ixbrl_div": placed(F.filter(
                m,
                lambda x: x["tag"].isin("div", "span", "p", "td") & x["bold"] & x["starts"] & ~x["toc"],
            ), _first_long_or_longest),
            "toc_link": placed(_toc_target(m)),
            "pattern_match": let(pattern_section(
                text,
                _by_form(form, section, _STARTS, lambda p: F.lit(_either(p))),
                _by_form(form, section, _ENDS, lambda p: F.lit(_either(p))),
                _by_form(form, section, _LEAST), size=size,
            ), lambda b: F.struct(b.alias("text"), F.length(b).alias("chars"))),
        }
        return F.coalesce(
            *[_attempt(bodies[method], method, keywords) for method in _METHODS],
            F.struct(text.alias("text"), size.alias("chars"), F.lit("raw_fallback").alias("method")),
        )

    return let(_annotate(plain, marks, form, section), located)


def _attempt(body: Column, method: str, keywords) -> Column:
    return let(
        body,
        lambda b: F.when(keywords(b), F.struct(b["text"].alias("text"), b["chars"].alias("chars"), F.lit(method).alias("method"))),
    )


def _result(i: int, form: Column, url: Column | None) -> Column:
    """What is known about one section of a filing, as a struct."""
    name = _spec("10-K", i)[0]
    text, chars, method = F.col(f"_s{i}.text"), F.col(f"_s{i}.chars"), F.col(f"_s{i}.method")
    label = _by_form(form, i, _LABEL)
    display = _by_form(form, i, _DISPLAY)
    found = method != "raw_fallback"
    points_away = F.lit(False)
    if name == "risk_factors":
        points_away = found & (form == "10-Q") & pointer(text, fv.EXTRACTION_POINTER, chars)
    confidence = F.lit(None).cast("double")
    for strategy, value in fv.METHOD_CONFIDENCE.items():
        confidence = F.when(method == strategy, F.lit(value)).otherwise(confidence)
    reason = F.when(points_away, F.lit(
        "Risk Factors section in this 10-Q incorporates by reference from the annual 10-K filing."
    )).when(~found, F.concat(F.lit("All extraction strategies failed for "), display))
    gap = F.when(points_away, F.lit(
        "Risk Factors section in this 10-Q references the 10-K; "
        "no material Q-over-Q comparison possible. "
        "Use the annual 10-K filings to compare Risk Factors year-over-year."
    )).when(~found, F.format_string(
        "%s (%s) could not be isolated from accession %s. Returning full document text as fallback.",
        display, label, F.col("accession_number"),
    ))
    reference = F.lit(None).cast("string") if url is None else F.when(
        F.length(url) > 0, F.concat(url, F.lit("#"), F.replace(label, F.lit(" "), F.lit("")))
    )
    return F.struct(
        F.lit(name).alias("section_name"),
        label.alias("item_label"),
        text.alias("text"),
        method.alias("method"),
        (found & ~points_away).alias("extraction_success"),
        F.when(points_away, F.lit(0.0)).otherwise(confidence).alias("confidence_score"),
        chars.alias("char_count"),
        reason.alias("failure_reason"),
        gap.alias("coverage_gap_note"),
        reference.alias("source_reference"),
    )


def extract(filings: DataFrame) -> DataFrame:
    """``filings(accession_number, form_type, html, …)`` with structs
    ``risk_factors`` and ``mda``, the document's size, whether there was a body
    to read, the known gaps and the success flags. Other columns pass through;
    ``html`` does not."""
    keep = [c for c in filings.columns if c != "html"]
    form = F.col("form_type")
    url = F.col("document_url") if "document_url" in keep else None
    return (
        filings.withColumn("_outline", outline(F.col("html")))
        .withColumn("_text", F.coalesce(F.col("_outline.text"), F.lit("")))
        .withColumn("_size", F.coalesce(F.col("_outline.size"), F.lit(0)))
        .withColumn("_count", F.coalesce(F.col("_outline.bytes"), F.lit(0)))
        .select(
            *keep,
            F.col("_outline").isNotNull().alias("readable"),
            F.col("_size").alias("full_doc_char_count"),
            *[_section(i, form, F.col("_text"), F.col("_size"), F.col("_count"), F.coalesce(F.col("_outline.plain"), F.lit("")), F.col("_outline.marks")).alias(f"_s{i}") for i in (0, 1)],
        )
        .select(
            *keep, "readable", "full_doc_char_count",
            _result(0, form, url).alias("risk_factors"), _result(1, form, url).alias("mda"),
        )
        .withColumn("known_gaps", known_gaps(F.col("risk_factors"), F.col("mda"), F.col("full_doc_char_count")))
        .withColumn("both_succeeded", F.col("risk_factors.extraction_success") & F.col("mda.extraction_success"))
        .withColumn("any_succeeded", F.col("risk_factors.extraction_success") | F.col("mda.extraction_success"))
    )


def section_rows(extracted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per (filing, section)."""
    return extracted.select(*keys, "full_doc_char_count", F.inline(F.array("risk_factors", "mda")))


def known_gaps(risk: Column, mda: Column, full_chars: Column) -> Column:
    missing = lambda s, shown: F.when(
        ~s["extraction_success"],
        F.concat(F.lit(f"{shown} could not be isolated (method: "), s["method"], F.lit(")")),
    )
    return F.filter(
        F.array(
            missing(risk, "Risk Factors"),
            missing(mda, "MD&A"),
            F.when(full_chars < fv.STUB_CHARS, F.lit("Filing HTML is unusually short — may be a stub or redirect")),
            F.when(full_chars > fv.HUGE_CHARS, F.lit("Filing HTML is very large (>2MB) — extraction may have boundary errors")),
        ),
        lambda g: g.isNotNull(),
    )


def extraction_issues(label: str, risk: Column, mda: Column, form: Column) -> list[Column]:
    """Reasons why one side of a comparison is unreliable (NULL when fine)."""
    strict = form.isin("10-K", "20-F")
    return [
        F.when(~mda["extraction_success"], F.format_string(
            label + " MD&A: extraction failed (method=%s, %d chars) — full document used as fallback.",
            mda["method"], mda["char_count"],
        )).when(mda["char_count"] < fv.GATE_MDA_CHARS, F.format_string(
            label + f" MD&A: only %d chars extracted (minimum {fv.GATE_MDA_CHARS}) — likely a fragment.",
            mda["char_count"],
        )),
        F.when(strict & ~risk["extraction_success"], F.format_string(
            label + " Risk Factors: extraction failed (method=%s, %d chars).", risk["method"], risk["char_count"],
        )).when(strict & (risk["char_count"] < fv.GATE_RISK_CHARS), F.format_string(
            label + f" Risk Factors: only %d chars extracted (minimum {fv.GATE_RISK_CHARS}).", risk["char_count"],
        )),
    ]


def extraction_gate(newer: Column, older: Column, form: Column) -> Column:
    """NULL when both sides are good enough, else the joined reasons. The
    arguments are structs with ``risk_factors`` and ``mda``."""
    issues = F.concat_ws(
        " | ",
        *extraction_issues("newer", newer["risk_factors"], newer["mda"], form),
        *extraction_issues("older", older["risk_factors"], older["mda"], form),
    )
    return F.when(issues != "", F.concat(
        F.lit("Extraction quality below threshold — comparison unreliable. "), issues
    ))
