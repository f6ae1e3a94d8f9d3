"""Sentences and lines of the executive report, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scoring import signals
from .text import clip, fixed

# fixed values: words shown in reports
RATING_MARKS = {"low": "🟢", "moderate": "🟡", "high": "🟠", "critical": "🔴"}
MAGNITUDE_WORDS = {
    "none": "unchanged", "minor": "minor changes",
    "moderate": "moderate changes", "major": "significant changes",
}
OPENINGS = {
    "critical": "%s's most recent %s filing (%s) presents a CRITICAL risk profile, demanding immediate attention.",
    "high": "%s's most recent %s filing (%s) indicates a HIGH risk rating, with several key areas requiring close monitoring.",
    "moderate": "%s's most recent %s filing (%s) reveals a MODERATE risk profile, suggesting a need for vigilance in specific areas.",
    "low": "%s's most recent %s filing (%s) shows a LOW risk profile, with no significant new concerns identified.",
}
RISK_CHANGES = {
    "major": "The Risk Factors section underwent significant revisions, with %s%% of sentences affected compared to the prior filing (%s).",
    "moderate": "There were moderate changes in the Risk Factors section, with %s%% of sentences updated from the prior filing (%s).",
    None: "The Risk Factors section remained largely stable, with only %s%% of sentences changed from the prior filing (%s).",
}
MDA_TONES = {
    "critical": "It highlights critical financial stress signals.",
    "high": "It reveals elevated financial stress signals.",
    "moderate": "It indicates areas of financial caution.",
    None: "It reflects stable financial performance.",
}


def choose(key: Column, table: dict, value=lambda v: F.lit(v)) -> Column:
    """CASE over a table; the ``None`` entry is the default."""
    out = None
    for k, v in table.items():
        if k is not None:
            out = F.when(key == k, value(v)) if out is None else out.when(key == k, value(v))
    return out.otherwise(value(table[None])) if None in table else out


def quoted(hits: Column, n: int) -> Column:
    return F.array_join(F.transform(F.slice(signals(hits), 1, n), lambda s: F.concat(F.lit('"'), s, F.lit('"'))), ", ")


def verdict(ticker: Column, form: Column, rating: Column, risk: Column, mda: Column, newer: Column, older: Column) -> Column:
    """The paragraph under the rating. ``risk`` and ``mda`` are structs with
    compared, pct_changed, magnitude, new_hits, removed_hits, materiality."""
    period = F.when(form == "10-K", "annual").otherwise("quarterly")
    opening = choose(rating, OPENINGS, lambda t: F.format_string(t, ticker, period, newer))
    risk_change = F.when(
        risk["compared"],
        choose(risk["magnitude"], RISK_CHANGES, lambda t: F.format_string(t, fixed(risk["pct_changed"] * 100, 0), older)),
    ).otherwise(F.lit("Risk Factor comparison was not available (e.g., 10-Q incorporating 10-K by reference)."))
    moved = F.concat_ws(
        " ",
        F.when(F.size(risk["new_hits"]) > 0, F.concat(
            F.lit("Notably, new risk signals emerged, including "), quoted(risk["new_hits"], 3), F.lit("."))),
        F.when(F.size(risk["removed_hits"]) > 0, F.concat(
            F.lit("Conversely, previously flagged risks such as "), quoted(risk["removed_hits"], 2),
            F.lit(" are no longer present."))),
    )
    mda_change = F.when(mda["compared"], F.format_string(
        "The Management's Discussion and Analysis (MD&A) section saw %s changes, with %s%% of sentences affected. ",
        choose(mda["magnitude"], MAGNITUDE_WORDS), fixed(mda["pct_changed"] * 100, 0),
    )).otherwise(F.lit("MD&A comparison was not available. "))
    return F.concat_ws(" ", opening, risk_change, moved, F.concat(mda_change, choose(mda["materiality"], MDA_TONES)))


def rule(width: int, char: str = "─") -> Column:
    return F.lit(char * width)


def heading(title: str) -> list[Column]:
    return [F.lit(title), rule(40)]


def bullet_signals(hits: Column, new_hits: Column, n: int, with_context: bool) -> Column:
    """Lines for signals, new ones tagged, with a quote when asked for."""
    new_names = signals(new_hits)

    def line(h: Column) -> Column:
        tag = F.when(F.array_contains(new_names, h["signal"]), F.lit(" [NEW]")).otherwise(F.lit(""))
        first = F.concat(F.lit("  • "), h["signal"], tag)
        if not with_context:
            return F.array(first)
        return F.array(first, F.concat(F.lit("    "), clip(h["context"], 120)))

    return F.flatten(F.transform(F.slice(hits, 1, n), line))


def block(condition: Column, *parts: Column | list[Column]) -> Column:
    """Lines shown when the condition holds, followed by an empty line."""
    return F.when(condition, lines(*parts, F.lit(""))).otherwise(F.array().cast("array<string>"))


def lines(*parts: Column | list[Column]) -> Column:
    """Lines from columns and lists of columns; arrays go through ``F.concat``."""
    flat: list[Column] = []
    for p in parts:
        flat.extend(p if isinstance(p, list) else [p])
    return F.array(*flat)
