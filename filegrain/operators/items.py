"""Numbered items of event reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.scoring import tier_names
from ..functions.text import clip, int_array, let, pieces_between, squeeze, string_array


def event_items(text: Column, items: Sequence[tuple[str, str, int]] = fv.EVENT_ITEMS) -> Column:
    """Known items in text order, the first mention of each:
    ``array<struct<item_number,label,tier,materiality,excerpt>>``.

    An item's text runs to the next item of any number; the last item's is
    shown from its first 2000 characters.
    """
    table = string_array(number for number, _, _ in items)
    labels, tiers = string_array(label for _, label, _ in items), int_array(tier for _, _, tier in items)

    def known(parts: Column) -> Column:
        # one pass that remembers the places of what it keeps, one for each known item at most
        places = F.aggregate(
            F.transform(parts, lambda p, i: F.struct(p["key"].alias("key"), i.alias("i"))), F.array().cast("array<struct<key:string,i:int>>"),
            lambda acc, p: F.when(
                F.array_contains(table, p["key"]) & ~F.exists(acc, lambda k: k["key"] == p["key"]), F.concat(acc, F.array(p)),
            ).otherwise(acc),
        )
        firsts = F.transform(places, lambda k: F.get(parts, k["i"]))
        at = lambda p: (F.array_position(table, p["key"]) - 1).cast("int")
        return F.transform(firsts, lambda p: F.struct(
            p["key"].alias("item_number"),
            F.get(labels, at(p)).alias("label"),
            F.get(tiers, at(p)).alias("tier"),
            tier_names(F.get(tiers, at(p))).alias("materiality"),
            clip(squeeze(
                F.when(p["last"], clip(p["body"], fv.EVENT_LAST_ITEM_CHARS)).otherwise(p["body"])
            ), fv.EVENT_EXCERPT_CHARS).alias("excerpt"),
        ))

    return let(pieces_between(text, fv.EVENT_ITEM_PATTERN, 1), known)
