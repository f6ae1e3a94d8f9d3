"""Governance language of proxy statements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.scoring import tier_names
from ..functions.text import around, clip, fixed, int_array, let, squeeze, string_array


def governance_signals(text: Column, phrases: Sequence[tuple[str, int]] = fv.GOVERNANCE_PHRASES) -> Column:
    """Phrases found, in list order, with points and an excerpt:
    ``array<struct<signal,tier,materiality,points,excerpt>>``."""
    before, after, shown = fv.GOVERNANCE_EXCERPT
    signal, needle = string_array(p for p, _ in phrases), string_array(p.lower() for p, _ in phrases)
    tier, points = int_array(t for _, t in phrases), int_array(fv.GOVERNANCE_POINTS.get(t, 0) for _, t in phrases)
    every = int_array(range(len(phrases)))

    def found(t: Column) -> Column:
        def describe(i: Column) -> Column:
            word = F.get(needle, i)
            cut = around(t["raw"], F.instr(t["low"], word), F.length(word), before, after)
            return F.struct(
                F.get(signal, i).alias("signal"), F.get(tier, i).alias("tier"),
                tier_names(F.get(tier, i)).alias("materiality"), F.get(points, i).alias("points"),
                clip(squeeze(cut), shown).alias("excerpt"),
            )

        return F.transform(F.filter(every, lambda i: F.contains(t["low"], F.get(needle, i))), describe)

    return let(F.struct(text.alias("raw"), F.lower(text).alias("low")), found)


def governance_score(found: Column) -> Column:
    return F.aggregate(found, F.lit(0), lambda acc, s: acc + s["points"])


def governance_summary(ticker: Column, filed: Column, found: Column, score: Column) -> Column:
    tier1 = F.transform(F.filter(found, lambda s: s["tier"] == 1), lambda s: s["signal"])
    text = F.concat_ws(
        " ",
        F.format_string("%s's proxy statement (%s) governance risk score: %s.", ticker, filed, fixed(score, 1)),
        F.when(F.size(tier1) > 0, F.concat(
            F.lit("Critical governance flags: "), F.array_join(tier1, ", "), F.lit("."),
        )),
        F.format_string("%d total governance signals detected.", F.size(found)),
    )
    return F.when(F.size(found) > 0, text).otherwise(F.format_string(
        "%s's proxy statement (%s) shows no elevated governance signals.", ticker, filed,
    ))
