"""Ten-domain risk taxonomy with ranked evidence, and its short form.

A document's evidence is bounded by the document, so everything is worked out
on its row: no text crosses an exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.scoring import signals
from ..functions.text import clip, int_array, let, positions, sentences, string_array

Taxonomy = Sequence[tuple[str, str, int, Sequence[str]]]


def _present(text: Column, taxonomy: Taxonomy) -> Column:
    """Keywords of the taxonomy that occur anywhere in the text."""
    words = [(d, kw) for d, (_, _, _, kws) in enumerate(taxonomy) for kw in kws]
    domain, shown = int_array(d for d, _ in words), string_array(kw for _, kw in words)
    needles = [kw.lower() for _, kw in words]
    needle = string_array(needles)
    return F.transform(positions(text, needles), lambda i: F.struct(
        F.get(domain, i).alias("domain"), F.get(shown, i).alias("keyword"), F.get(needle, i).alias("needle"),
    ))


def _evidence(text: Column, taxonomy: Taxonomy) -> Column:
    """Sentences with the keywords they hold. Keywords absent from the whole
    text are dropped before any sentence is looked at."""

    def per_sentence(v: Column) -> Column:
        return F.filter(
            F.transform(v["sents"], lambda s, i: F.struct(
                s.alias("text"), i.alias("pos"),
                let(F.lower(s), lambda low: F.filter(v["present"], lambda k: F.contains(low, k["needle"]))).alias("kws"),
            )),
            lambda e: F.size(e["kws"]) > 0,
        )

    return let(F.struct(sentences(text).alias("sents"), _present(text, taxonomy).alias("present")), per_sentence)


def _domain(evidence: Column, d: int, row: tuple, top: int, chars: int) -> Column:
    domain, label, tier, _ = row
    own = F.filter(
        F.transform(evidence, lambda e: F.struct(
            e["text"].alias("text"), e["pos"].alias("pos"),
            F.filter(e["kws"], lambda k: k["domain"] == d).alias("kws"),
        )),
        lambda e: F.size(e["kws"]) > 0,
    )

    def describe(e: Column) -> Column:
        found = F.array_sort(F.array_distinct(F.flatten(F.transform(
            e, lambda x: F.transform(x["kws"], lambda k: k["keyword"])
        ))))
        ranked = F.array_sort(F.transform(e, lambda x: F.struct(
            (-F.size(x["kws"])).alias("score"), F.length(x["text"]).alias("n"),
            x["pos"].alias("pos"), x["text"].alias("text"),
        )))
        excerpts = F.slice(F.array_distinct(F.transform(ranked, lambda x: x["text"])), 1, top)
        return F.when(F.size(e) > 0, F.struct(
            F.lit(domain).alias("category"), F.lit(label).alias("label"), F.lit(tier).alias("tier"),
            F.size(found).alias("signal_count"), found.alias("matched_signals"),
            F.transform(excerpts, lambda s: clip(s, chars)).alias("excerpts"),
        ))

    return let(own, describe)


def categorise(
    text: Column,
    taxonomy: Taxonomy = fv.RISK_TAXONOMY,
    top: int = fv.EXCERPTS_PER_DOMAIN,
    chars: int = fv.EXCERPT_CHARS,
) -> Column:
    """Domains found in the text, most severe tier first, then most signals,
    then taxonomy order: ``array<struct<category,label,tier,signal_count,
    matched_signals,excerpts>>``. Matched signals are sorted by name."""

    def by_domain(e: Column) -> Column:
        found = F.array(*[_domain(e, d, row, top, chars) for d, row in enumerate(taxonomy)])
        keyed = F.filter(
            F.transform(found, lambda c, i: F.struct(
                c["tier"].alias("tier"), (-c["signal_count"]).alias("less"), i.alias("i"), c.alias("c"),
            )),
            lambda x: x["c"].isNotNull(),
        )
        return F.transform(F.array_sort(keyed), lambda x: x["c"])

    return let(_evidence(text, taxonomy), by_domain)


def category_summary(df: DataFrame, categories: str, ticker: Column, form: Column, filed: Column) -> DataFrame:
    """Totals over the category array and the narrative."""
    c = F.col(categories)
    names = lambda a, f: F.transform(a, f)
    tier1 = F.filter(c, lambda x: x["tier"] == 1)
    top = F.slice(c, 1, 5)
    first = F.get(c, F.lit(0))
    total = F.aggregate(c, F.lit(0), lambda acc, x: acc + x["signal_count"])
    with_count = lambda x: F.concat(x["label"], F.lit(" ("), x["signal_count"].cast("string"), F.lit(" signals)"))
    narrative = F.concat_ws(
        " ",
        F.format_string("This report categorizes risks from %s's %s filing (filed %s).", ticker, form, filed),
        F.format_string(
            "A total of %d distinct risk domains were identified, "
            "with %d signal matches across the Risk Factors section.",
            F.size(c), total,
        ),
        F.when(F.size(tier1) > 0, F.concat(
            F.lit("Critical (Tier 1) risk domains include: "),
            F.array_join(names(tier1, lambda x: x["label"]), ", "), F.lit("."),
        )),
        F.when(F.size(c) > 0, F.concat(
            F.lit("The most prominent risk areas by signal density are: "),
            F.array_join(names(top, with_count), "; "), F.lit("."),
        )),
        F.when(F.size(c) > 0, F.format_string(
            "The dominant risk theme is %s, highlighted by %d signals, such as: %s.",
            first["label"], first["signal_count"],
            F.array_join(F.slice(first["matched_signals"], 1, 5), ", "),
        )).otherwise(F.lit("No specific risk categories were identified in the filing.")),
    )
    return (
        df.withColumn("total_domains_identified", F.size(c))
        .withColumn("total_signals", total)
        .withColumn("tier1_domain_count", F.size(tier1))
        .withColumn("top_domains", names(top, lambda x: x["category"]))
        .withColumn("executive_summary", narrative)
    )


def quick_categories(text: Column, taxonomy: Sequence[tuple[str, Sequence[str]]] = fv.QUICK_TAXONOMY) -> Column:
    """``array<struct<category,signals>>``, most signals first, taxonomy order
    on ties, empty domains left out. Keywords are compared as written with the
    lower-cased text, so upper-case ones never count."""
    words = [(d, kw) for d, (_, kws) in enumerate(taxonomy) for kw in kws]
    domain, word = int_array(d for d, _ in words), string_array(kw for _, kw in words)
    every, names = int_array(range(len(words))), string_array(name for name, _ in taxonomy)

    def count(t: Column) -> Column:
        found = F.transform(F.filter(every, lambda i: F.contains(t, F.get(word, i))), lambda i: F.get(domain, i))
        counted = let(found, lambda ds: F.transform(names, lambda name, i: F.struct(
            (-F.size(F.filter(ds, lambda x: x == i))).alias("less"), i.alias("i"), name.alias("category"),
        )))
        return F.transform(
            F.array_sort(F.filter(counted, lambda x: x["less"] < 0)),
            lambda x: F.struct(x["category"].alias("category"), (-x["less"]).alias("signals")),
        )

    return let(F.lower(F.coalesce(text, F.lit(""))), count)


def highlight_sentences(text: Column, hits: Column, keywords: Sequence[str] = fv.MDA_KEYWORDS, top: int = 5) -> Column:
    """Telling sentences of a discussion section: one point per keyword, two
    per signal of ``hits``; best first, first of equal openings kept."""

    def pick(v: Column) -> Column:
        def score(low: Column) -> Column:
            words = F.size(F.filter(string_array(keywords), lambda k: F.contains(low, k)))
            named = F.size(F.filter(v["names"], lambda n: F.contains(low, n)))
            return words + named * 2

        sized = F.filter(v["sents"], lambda s: F.length(s) <= fv.HIGHLIGHT_MAX_CHARS)
        ranked = F.array_sort(F.filter(
            F.transform(sized, lambda s, i: F.struct(
                (-let(F.lower(s), score)).alias("less"), i.alias("i"), s.alias("text"),
            )),
            lambda x: x["less"] < 0,
        ))
        opening = lambda t: clip(t, fv.HIGHLIGHT_KEY_CHARS)
        # one pass that remembers what it keeps, ``top`` sentences at most
        kept = F.aggregate(
            ranked, F.array().cast("array<string>"),
            lambda acc, x: F.when(
                (F.size(acc) < top) & ~F.exists(acc, lambda t: opening(t) == opening(x["text"])), F.concat(acc, F.array(x["text"])),
            ).otherwise(acc),
        )
        return F.transform(kept, lambda t: clip(t, fv.HIGHLIGHT_SHOWN_CHARS))

    return let(
        F.struct(
            sentences(text, openers="A-Z", min_chars=fv.HIGHLIGHT_MIN_CHARS).alias("sents"),
            F.transform(signals(hits), F.lower).alias("names"),
        ),
        pick,
    )
