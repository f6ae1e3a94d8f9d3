"""Mixing sources to target weights by Pfair scheduling.

Documents of a source, in the order of their ids' hashes, form blocks. Block k of a
source with share w of the slots may not come before slot floor(k / w) and is due
before slot ceil((k + 1) / w); in every slot the released block that is due first
goes out. So after any number of slots every source has had its share to within less
than one block.

Shares are whole numbers of slots in a period, so the schedule repeats: it is worked
out for one period and any block finds its slot by division, wherever it is. When a
source has no blocks left, a new phase begins in which the others share its slots in
proportion; no document is dropped or repeated.

A null source is a source. Sources without a positive weight come last, sharing
evenly. Rows that repeat an id are placed one after the other. The driver handles one
row for each source; the table of sources has the size of a settings file.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PERIOD = 1000
ROWS_PER_BLOCK = 16


def whole_shares(weights: dict, period: int) -> dict:
    """Slots of each source in a period: in proportion, at least one, adding up to the period."""
    total = math.fsum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    shares = {s: max(1, math.floor(x)) for s, x in exact.items()}
    order = sorted(weights, key=lambda s: (shares[s] - exact[s], str(s)))
    at = 0
    while sum(shares.values()) < period:
        shares[order[at % len(order)]] += 1
        at += 1
    while sum(shares.values()) > period:
        largest = max(shares, key=lambda s: (shares[s] - exact[s] if shares[s] > 1 else -math.inf, str(s)))
        shares[largest] -= 1
    return shares


def pattern(shares: dict) -> dict:
    """The slots of one period that each source gets, earliest deadline first."""
    period = sum(shares.values())
    names = sorted(shares, key=str)
    releases = [(0, i, 0) for i in range(len(names))]  # (slot, source, block)
    due: list[tuple[int, int, int]] = []
    slots: dict = {s: [] for s in names}
    for slot in range(period):
        while releases and releases[0][0] <= slot:
            _, i, k = heapq.heappop(releases)
            heapq.heappush(due, (-(-(k + 1) * period // shares[names[i]]), i, k))
        deadline, i, k = heapq.heappop(due)
        assert deadline > slot
        slots[names[i]].append(slot)
        if k + 1 < shares[names[i]]:
            heapq.heappush(releases, ((k + 1) * period // shares[names[i]], i, k + 1))
    return slots


def phases(blocks: dict, weights: dict, period: int = PERIOD) -> list[dict]:
    """The phases, each with its first slot and for every live source its slots in a period and its range of blocks."""
    left, done, first, out = dict(blocks), dict.fromkeys(blocks, 0), 0, []
    weighted = {s for s in blocks if weights.get(s) and weights[s] > 0}
    while any(left.values()):
        live = {s: weights[s] for s in weighted if left[s]} or {s: 1.0 for s in left if left[s]}
        shares = whole_shares(live, max(period, 4 * len(live)))
        slots, size = pattern(shares), sum(shares.values())
        ends = min((left[s] - 1) // n * size + slots[s][(left[s] - 1) % n] + 1 for s, n in shares.items())
        used = {s: ends // size * n + sum(p < ends % size for p in slots[s]) for s, n in shares.items()}
        out.append({"first": first, "size": size, "slots": slots, "from": {s: done[s] for s in shares}, "to": {s: done[s] + used[s] for s in shares}})
        for s, n in used.items():
            left[s] -= n
            done[s] += n
        first += ends
    return out


def square_root_weights(counts: dict) -> dict:
    """Weights between even and in proportion to size."""
    return {s: math.sqrt(n) for s, n in counts.items()}


def mixed(docs: DataFrame, weights=square_root_weights, key: str = "doc_id", source: str = "source", period: int = PERIOD, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """The rows with mix_phase, mix_slot and mix_position, which orders the mixture.

    ``weights``: a dict by source, or a function from the sources' row counts to one.
    Ranks within a source are counted in slices of its hash range, whose number grows
    with the table, so that no task sorts a whole source.
    """
    spark = docs.sparkSession
    counts = {r[0]: r[1] for r in docs.groupBy(F.col(source).cast("string")).count().collect()}
    plan = phases({s: -(-n // rows_per_block) for s, n in counts.items()}, weights(counts) if callable(weights) else weights, period)
    slices = 1 << max(0, math.ceil(math.log2(max(1, math.isqrt(sum(counts.values()))))))
    named = docs.withColumns({
        "_mix_source": F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null")),
        "_mix_order": F.xxhash64(F.col(key).cast("string")),
    }).withColumn("_mix_slice", F.pmod(F.shiftrightunsigned("_mix_order", 20), F.lit(slices)).cast("int"))
    sizes = named.groupBy("_mix_source", "_mix_slice").agg(F.count(F.lit(1)).alias("_mix_n"))
    before = F.coalesce(F.sum("_mix_n").over(Window.partitionBy("_mix_source").orderBy("_mix_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_mix_source", "_mix_slice", before.alias("_mix_before"))
    in_slice = Window.partitionBy("_mix_source", "_mix_slice").orderBy("_mix_order", F.col(key))
    ranked = named.join(starts, ["_mix_source", "_mix_slice"]).withColumn("_mix_rank", F.col("_mix_before") + F.row_number().over(in_slice) - 1)
    ranked = ranked.withColumn("_mix_block", F.floor(F.col("_mix_rank") / rows_per_block))

    label = lambda s: "null" if s is None else f"={s}"
    ranges = [
        (label(s), number, phase["first"], phase["size"], len(slots), phase["from"][s], phase["to"][s])
        for number, phase in enumerate(plan) for s, slots in phase["slots"].items() if phase["to"][s] > phase["from"][s]
    ]
    places = [(label(s), number, k, at) for number, phase in enumerate(plan) for s, slots in phase["slots"].items() for k, at in enumerate(slots)]
    ranges_df = spark.createDataFrame(ranges, "_mix_source string, mix_phase int, _mix_first long, _mix_size long, _mix_share long, _mix_from long, _mix_to long")
    places_df = spark.createDataFrame(places, "_mix_source string, mix_phase int, _mix_k long, _mix_at long")
    done = ranked.drop("mix_phase", "mix_slot", "mix_position").join(F.broadcast(ranges_df), ["_mix_source"]).where("_mix_block >= _mix_from and _mix_block < _mix_to")
    done = done.withColumn("_mix_k", (F.col("_mix_block") - F.col("_mix_from")) % F.col("_mix_share"))
    done = done.join(F.broadcast(places_df), ["_mix_source", "mix_phase", "_mix_k"])
    slot = F.col("_mix_first") + F.floor((F.col("_mix_block") - F.col("_mix_from")) / F.col("_mix_share")) * F.col("_mix_size") + F.col("_mix_at")
    return done.withColumn("mix_slot", slot).withColumn("mix_position", F.col("mix_slot") * rows_per_block + F.col("_mix_rank") % rows_per_block).select(
        *[c for c in docs.columns if c not in ("mix_phase", "mix_slot", "mix_position")], "mix_phase", "mix_slot", "mix_position"
    )
