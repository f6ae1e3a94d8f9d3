"""Lexicon hits and scores as columns over one row: no exchange, no copies of
the text."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from . import fixed_values as fv
from .phrases import phrases_in
from .text import around, fixed, int_array, let, string_array, strip


HITS = (
    "array<struct<signal:string,needle:string,tier:int,weight:int,ord:int,base:int,bonus:int,fresh:int>>"
)


@dataclass(frozen=True)
class Lexicon:
    """Tiered phrases with the points each tier earns (hundredths)."""

    entries: tuple[tuple[str, int], ...]
    base: Mapping[int, int]
    in_change: Mapping[int, int]
    fresh: Mapping[int, int]

    @classmethod
    def of(
        cls,
        tiers: Mapping[int, Iterable[str]],
        base: Mapping[int, int] = fv.BASE_HUNDREDTHS,
        in_change: Mapping[int, int] = fv.IN_CHANGE_HUNDREDTHS,
        fresh: Mapping[int, int] = fv.NEW_HUNDREDTHS,
    ) -> Lexicon:
        seen: dict[str, int] = {}
        for tier in sorted(tiers):
            for phrase in tiers[tier]:
                seen.setdefault(phrase, tier)
        return cls(tuple(seen.items()), base, in_change, fresh)

    def found_in(self, text: Column) -> Column:
        """Entries contained in the text, in lexicon order, as hit structs."""
        phrases = [p for p, _ in self.entries]
        tiers = [t for _, t in self.entries]
        shown, needles = string_array(phrases), string_array(p.lower() for p in phrases)
        tier = int_array(tiers)
        weight, base, bonus, fresh = (
            int_array(table.get(t, 0) for t in tiers)
            for table in (fv.SIGNAL_WEIGHT, self.base, self.in_change, self.fresh)
        )
        return F.transform(
            phrases_in(text, [p.lower() for p in phrases]),
            lambda i: F.struct(
                F.get(shown, i).alias("signal"), F.get(needles, i).alias("needle"), F.get(tier, i).alias("tier"),
                F.get(weight, i).alias("weight"), i.alias("ord"), F.get(base, i).alias("base"),
                F.get(bonus, i).alias("bonus"), F.get(fresh, i).alias("fresh"),
            ),
        )

    def rows(self) -> list[tuple[str, int, int, int]]:
        return [(p, t, fv.SIGNAL_WEIGHT.get(t, 0), i) for i, (p, t) in enumerate(self.entries)]


RISK_LEXICON = Lexicon.of({1: fv.TIER1_SIGNALS, 2: fv.TIER2_SIGNALS, 3: fv.TIER3_SIGNALS})


def find_hits(text: Column, lexicon: Lexicon = RISK_LEXICON) -> Column:
    """Lexicon entries contained in the text (substring, case ignored), in
    lexicon order. Empty for NULL or empty text."""
    # the text is named twice, so that the optimizer leaves what it is made by in a projection of its own
    return F.when(text != "", lexicon.found_in(text)).otherwise(F.array().cast(HITS))


def signals(hits: Column) -> Column:
    return F.transform(hits, lambda h: h["signal"])


def of_tier(hits: Column, *tiers: int) -> Column:
    return F.filter(hits, lambda h: h["tier"].isin(*tiers))


def points(hits: Column, field: str) -> Column:
    """Exact sum of one of the hundredths fields."""
    return F.aggregate(hits, F.lit(0), lambda acc, h: acc + h[field])


def except_named(hits: Column, other: Column) -> Column:
    """Hits whose signal is not in the array ``other``."""
    return let(other, lambda o: F.filter(hits, lambda h: ~F.array_contains(o, h["signal"])))


def with_context(hits: Column, text: Column, window: int = 120) -> Column:
    """Hits with their context, the text lowered once per row."""
    half = window // 2

    def show(t: Column) -> Column:
        def one(h: Column) -> Column:
            cut = around(t["raw"], F.instr(t["low"], h["needle"]), F.length(h["needle"]), half, half)
            line = strip(F.replace(cut, F.lit("\n"), F.lit(" ")))
            return F.struct(
                h["signal"].alias("signal"), h["tier"].alias("tier"), h["weight"].alias("weight"),
                F.concat(F.lit("..."), line, F.lit("...")).alias("context"),
            )

        return F.transform(hits, one)

    return let(F.struct(text.alias("raw"), F.lower(text).alias("low")), show)


def materiality(hundredths: Column) -> Column:
    out = None
    for name, floor in fv.MATERIALITY_FLOORS:
        out = F.when(hundredths >= floor, name) if out is None else out.when(hundredths >= floor, name)
    return out.otherwise("low")


def materiality_rank(level: Column) -> Column:
    out = None
    for name, rank in fv.MATERIALITY_RANK.items():
        out = F.when(level == name, rank) if out is None else out.when(level == name, rank)
    return out.otherwise(-1)


def change_magnitude(changed: Column, longest: Column) -> Column:
    """none / minor / moderate / major from the share of changed sentences."""
    share = changed / F.greatest(longest, F.lit(1))
    out = F.when(changed == 0, "none")
    for name, below in fv.CHANGE_BELOW:
        out = out.when(share < below, name)
    return out.otherwise("major")


def magnitude_bonus(magnitude: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for name, bonus in fv.MAGNITUDE_HUNDREDTHS.items():
        out = out.when(magnitude == name, bonus)
    return out.otherwise(0)


def listed(hits: Column, n: int) -> Column:
    return F.array_join(signals(F.slice(hits, 1, n)), ", ")


def score_text(
    df: DataFrame,
    *,
    text: str,
    lexicon: Lexicon = RISK_LEXICON,
    older: str | None = None,
    changed: str | None = None,
    magnitude: str | None = None,
) -> DataFrame:
    """Add the score of ``text`` to each row.

    ``older`` gives new and removed signals, ``changed`` the text of changed
    sentences, ``magnitude`` the change bucket (NULL when nothing was compared).
    Added: hits, new_hits, removed_hits, hundredths, raw_score, materiality.
    """
    no_hits = F.array().cast(HITS)
    found = {"_found": find_hits(F.col(text), lexicon)}
    if older:
        found["_older"] = find_hits(F.col(older), lexicon)
    out = df.withColumns(found)
    if changed:
        # only what the text holds is looked for in its changed part
        in_change = let(
            F.lower(F.col(changed)),
            lambda low: F.transform(
                F.col("_found"),
                lambda h: h.withField("in_change", F.coalesce(F.contains(low, h["needle"]), F.lit(False))),
            ),
        )
    else:
        in_change = F.transform(F.col("_found"), lambda h: h.withField("in_change", F.lit(False)))
    out = out.withColumn("hits", in_change)
    if older:
        comparable = (F.col(older) != "") & (F.col(text) != "")
        out = out.withColumn(
            "new_hits",
            F.when(comparable, except_named(F.col("_found"), signals(F.col("_older")))).otherwise(no_hits),
        ).withColumn(
            "removed_hits",
            F.when(comparable, except_named(F.col("_older"), signals(F.col("_found")))).otherwise(no_hits),
        ).drop("_older")
    else:
        out = out.withColumn("new_hits", no_hits).withColumn("removed_hits", no_hits)
    bonus = magnitude_bonus(F.col(magnitude)) if magnitude else F.lit(0)
    has_text = F.col(text) != ""
    total = (
        points(F.col("_found"), "base")
        + points(F.filter(F.col("hits"), lambda h: h["in_change"]), "bonus")
        + points(F.col("new_hits"), "fresh")
        + F.when(has_text, bonus).otherwise(0)
    )
    return (
        out.withColumn("hundredths", total)
        .withColumn("raw_score", F.col("hundredths") / 100.0)
        .withColumn("materiality", materiality(F.col("hundredths")))
        .drop("_found")
    )


def analyst_note(section: Column, pct_changed: Column, magnitude: Column, has_text: Column) -> Column:
    """One line over the columns added by :func:`score_text`. ``magnitude`` is
    NULL when the section was not compared."""
    label = F.when(section == "risk_factors", "Risk Factors").otherwise("MD&A")
    tier1 = of_tier(F.col("hits"), 1)
    sentence = lambda lead, hits: F.when(
        F.size(hits) > 0, F.concat(F.lit(lead), listed(hits, 5), F.lit("."))
    )
    note = F.concat_ws(
        " ",
        F.concat(label, F.lit(" materiality: "), F.upper("materiality"), F.lit(".")),
        sentence("Critical signals present: ", tier1),
        sentence("NEW vs prior filing: ", F.col("new_hits")),
        sentence("Removed vs prior filing: ", F.col("removed_hits")),
        F.when(
            magnitude.isNotNull(),
            F.format_string("Section changed %s%% by sentence (magnitude: %s).", fixed(pct_changed * 100, 1), magnitude),
        ),
    )
    return F.when(has_text, note).otherwise(
        F.concat(F.lit("No text available for "), section, F.lit(" — scoring skipped."))
    )


def top_signals(sections: Sequence[tuple[str, Column, Column]], n: int = 10, severity_first: bool = False) -> Column:
    """Leading signals over sections given as ``(name, new hits, tier-1 hits)``.

    Five new ones per section, then three of tier 1, sorted by tier from the
    ambient end (``severity_first`` turns that round), first mention kept.
    """
    groups = [(s, new, 5) for s, new, _ in sections] + [(s, t1, 3) for s, _, t1 in sections]
    sign = 1 if severity_first else -1

    def entry(group: int, section: str):
        return lambda h, i: F.struct(
            (h["tier"] * sign).alias("k1"), (-h["weight"]).alias("k2"),
            (i + group * 100).alias("k3"), h["signal"].alias("signal"), F.lit(section).alias("section"),
        )

    entries = F.concat(*[
        F.transform(F.slice(hits, 1, cap), entry(g, section))
        for g, (section, hits, cap) in enumerate(groups)
    ])
    ordered = let(
        F.array_sort(entries),
        lambda e: F.filter(
            e, lambda x, i: F.array_position(F.transform(e, lambda y: y["signal"]), x["signal"]) == i + 1
        ),
    )
    return F.transform(
        F.slice(ordered, 1, n),
        lambda x: F.concat(x["signal"], F.lit(" ["), x["section"], F.lit("]")),
    )


def lexicon_table(spark, lexicon: Lexicon = RISK_LEXICON) -> DataFrame:
    return spark.createDataFrame(lexicon.rows(), "signal string, tier int, weight int, ord int")


def tier_names(tier: Column) -> Column:
    out = None
    for t, name in fv.TIER_NAMES.items():
        out = F.when(tier == t, name) if out is None else out.when(tier == t, name)
    return out


GRAM = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _runs(text: str, sizes: list[int]) -> np.ndarray:
    """Distinct numbers of the text's runs of so many characters: equal runs have equal numbers."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    found = [np.zeros(0, np.uint64)]
    for size in sizes:
        if len(chars) >= size:
            numbers = np.full(len(chars) - size + 1, size, np.uint64)
            for k in range(size):
                numbers = numbers * _MIX + chars[k : k + len(numbers)]
            found.append(np.unique(numbers))
    return np.concatenate(found).view(np.int64)


def _grams(text: Column, sizes: Column) -> Column:
    """Distinct numbers of the runs of each of the sizes, all runs of a text in one go."""
    ship_package()

    @F.arrow_udf("array<bigint>")
    def runs(texts: pa.Array, sizes: pa.Array) -> pa.Array:
        found = [_runs(t or "", s) for t, s in zip(texts.to_pylist(), sizes.to_pylist())]
        ends = np.cumsum([0, *map(len, found)], dtype=np.int64).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))

    # never copied by the optimizer: each text is cut once
    return runs.asNondeterministic()(text, sizes)


def lexicon_table_hits(texts: DataFrame, lexicon: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Hits of a lexicon of any size, held as rows ``(signal, tier, ord)``: one row per text and entry it contains.

    An entry's first characters are its key; distinct character runs of the texts, without
    the texts, meet the keys in an equi-join; the texts come to what is left, and
    ``contains`` decides. Entries shorter than a run are keyed by all they have; only the
    lengths that occur are taken from the texts. ``keys`` name a row.
    """
    entries = lexicon.where(F.length("signal") > 0).withColumn("_needle", F.lower("signal"))
    entries = entries.withColumn("_size", F.least(F.length("_needle"), F.lit(GRAM)))
    entries = entries.withColumn("_gram", _grams(F.substring("_needle", F.lit(1), F.col("_size")), F.array("_size"))[0])
    sizes = F.broadcast(entries.agg(F.array_sort(F.collect_set("_size")).alias("_sizes")))  # GRAM at most
    low = texts.select(*keys, F.lower(text).alias("_low"))
    met = low.crossJoin(sizes).select(*keys, _grams(F.col("_low"), F.col("_sizes")).alias("_runs"))
    met = met.select(*keys, F.explode("_runs").alias("_gram")).join(entries.drop("_size"), "_gram")
    return met.join(low, list(keys)).where(F.contains("_low", F.col("_needle"))).select(*keys, "signal", "tier", "ord")
