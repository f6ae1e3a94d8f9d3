"""Score single texts and single filings, without a prior filing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.scoring import RISK_LEXICON, Lexicon, find_hits, materiality, of_tier, points, score_text, signals

SECTIONS = (("risk_factors", "risk"), ("mda", "mda"))


def score_sections(sections: DataFrame, text: str = "text", lexicon: Lexicon = RISK_LEXICON) -> DataFrame:
    """Sections with score, rating and capped hit lists per tier. The score uses
    every hit, the lists are display caps."""
    out = score_text(sections, text=text, lexicon=lexicon)
    for tier, cap in fv.HIT_CAPS.items():
        out = out.withColumn(f"tier{tier}_hits", F.slice(of_tier(F.col("hits"), tier), 1, cap))
    return out.drop("new_hits", "removed_hits")


def filing_scores(filings: DataFrame, lexicon: Lexicon = RISK_LEXICON) -> DataFrame:
    """Filings with both sections' points and ratings and the set of all tier 1–2
    signals found. Only ``top_signals``, which is shown, is cut."""
    # both sections of a batch in one pass
    out = filings.withColumns({f"_{short}": find_hits(F.col(f"{name}.text"), lexicon) for name, short in SECTIONS})
    listed: list[Column] = []
    top: list[Column] = []
    for name, short in SECTIONS:
        total = points(F.col(f"_{short}"), "base")
        out = (
            out.withColumn(f"{short}_raw_score", total / 100.0)
            .withColumn(f"{short}_materiality", materiality(total))
            .withColumn(f"{short}_char_count", F.coalesce(F.col(f"{name}.char_count"), F.lit(0)))
        )
        for tier in (1, 2):
            hits = of_tier(F.col(f"_{short}"), tier)
            listed.append(signals(hits))
            if tier == 1:
                top.append(signals(F.slice(hits, 1, 3)))
    return (
        out.withColumn("signal_set", F.array_sort(F.array_distinct(F.concat(*listed))))
        .withColumn("top_signals", F.slice(F.array_sort(F.array_distinct(F.concat(*top))), 1, 6))
        .drop("_risk", "_mda")
    )
