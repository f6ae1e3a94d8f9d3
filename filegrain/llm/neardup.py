"""Near-duplicates by min-max hashing.

Each of a banding's hash functions gives two signature values, the least and
the greatest hash of the document's shingles: two nearly independent estimates for
one evaluation. Values are banded; documents that share a band are candidates.

Candidates are gathered into coarse clusters (connected by shared bands), clusters
into units of bounded weight, larger ones into pairs of blocks, and inside a unit the
exact similarity of the full shingle sets decides. Pairs that are already in one
component need no comparison: a large group of near copies is settled by few of its
members where they are alike, and by block pairs spread over the cluster where not.

Copies (equal sets) are one node from the start. A null or empty text has no shingles
and is linked with nothing; a text of fewer words than a shingle is one shingle. Rows
that repeat an id are one document. Null ids are linked with nothing.

The threshold is a parameter, in percent; bands follow from it. Chance of missing a
link at the threshold: under ``MISSED``, as (1 - 0.85^7)^36 and (1 - 0.8^6)^46 are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filegrain.llm.common import ascii_lower, map_arrow, non_empty, written
from filegrain.llm.components import connected
from filegrain.session import ship_package

WORDS_PER_SHINGLE = 5
LINK_PERCENT = 85
MISSED, MOST_VALUES = 1e-6, 300
#: What a unit may weigh: shingles, and so many for each document.
UNIT_WEIGHT, DOCUMENT_WEIGHT = 1 << 21, 500
#: An estimate so far below the threshold (over five standard errors) loses no link.
ESTIMATE_SLACK = 0.17
CHUNK = 2048

SEPARATORS = r"[\x20\x09-\x0D]+"
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def banding(percent: int) -> tuple[int, int]:
    """(rows a band, bands): the most rows that ``MOST_VALUES`` signature values allow at ``MISSED``."""
    best = None
    for rows in range(1, 21):
        bands = math.ceil(math.log(MISSED) / math.log1p(-min(percent / 100, 0.999) ** rows))
        bands += rows * bands % 2
        if best is None or rows * bands <= MOST_VALUES:
            best = rows, bands
    return best


@dataclass(frozen=True)
class Signature:
    """What signatures for one threshold are made with."""

    rows: int
    bands: int
    multipliers: np.ndarray
    factors: np.ndarray

    @classmethod
    def of(cls, percent: int) -> Signature:
        rows, bands = banding(percent)
        draw = lambda shape: _draw.integers(0, 1 << 63, shape, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        _draw = np.random.default_rng(20240229)
        return cls(rows, bands, draw(rows * bands // 2), draw((bands, rows)))


_PLACES = np.random.default_rng(20240301).integers(0, 1 << 63, (WORDS_PER_SHINGLE + 1, WORDS_PER_SHINGLE), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OF_LINK_PERCENT = Signature.of(LINK_PERCENT)
PERMUTATIONS = len(_OF_LINK_PERCENT.multipliers)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(27))


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of a sequence of word hashes."""
    n = len(words)
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    size = min(n, WORDS_PER_SHINGLE)
    total = np.zeros(n - size + 1, dtype=np.uint64)
    for k in range(size):
        total += mixed(words[k : n - size + 1 + k]) * _PLACES[size, k]
    return np.unique(mixed(total))


def min_max(shingles: np.ndarray, multipliers: np.ndarray = _OF_LINK_PERCENT.multipliers) -> np.ndarray:
    """All minima, then all maxima."""
    low, high = np.full(len(multipliers), np.iinfo(np.uint64).max, dtype=np.uint64), np.zeros(len(multipliers), dtype=np.uint64)
    for at in range(0, len(shingles), CHUNK):
        hashed = shingles[at : at + CHUNK, None] * multipliers
        np.minimum(low, hashed.min(0), out=low)
        np.maximum(high, hashed.max(0), out=high)
    return np.concatenate([low, high])


def _signatures(made: Signature, batch: pa.RecordBatch) -> pa.RecordBatch:
    lists = batch["words"]
    values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64) if len(lists.values) else np.zeros(0, np.uint64)
    bounds = lists.offsets.to_numpy()
    counts, names, bands, bytes_ = [], [], [], []
    for i in range(batch.num_rows):
        found = shingle_set(values[bounds[i] : bounds[i + 1]])
        counts.append(len(found))
        if not len(found):
            names.append(None), bands.append([]), bytes_.append(None)
            continue
        signature = min_max(found, made.multipliers)
        again = mixed(found ^ np.uint64(0x9E3779B97F4A7C15))
        names.append(found.sum(dtype=np.uint64).tobytes() + np.bitwise_xor.reduce(again).tobytes())
        bands.append(mixed((mixed(signature.reshape(made.bands, made.rows)) * made.factors).sum(1, dtype=np.uint64)).view(np.int64))
        bytes_.append((mixed(signature) >> np.uint64(56)).astype(np.uint8).tobytes())
    return pa.RecordBatch.from_arrays(
        [batch["id"], pa.array(counts, pa.int64()), pa.array(names, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(bytes_, pa.binary())],
        ["id", "n_shingles", "set_name", "bands", "signature"],
    )


def signatures(docs: DataFrame, key: str, text: str, percent: int = LINK_PERCENT) -> DataFrame:
    """(id, n_shingles, set_name, bands, signature) of each row. Words are split and hashed in the JVM."""
    words = non_empty(F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), SEPARATORS))
    hashed = docs.select(F.col(key).cast("long").alias("id"), F.transform(words, lambda w: F.xxhash64(w)).alias("words"))
    return map_arrow(hashed, partial(_signatures, Signature.of(percent)), "id long, n_shingles long, set_name binary, bands array<bigint>, signature binary")


def _sets_of(texts: list[str]) -> list[np.ndarray]:
    out = []
    for text in texts:  # bytes.lower and bytes.split know ASCII only, as the definition of words does
        words = text.encode("utf-8", "surrogatepass").lower().split()
        out.append(shingle_set(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)))
    return out


def _linked(shared: np.ndarray, n: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (n + sizes - shared)


def cluster_links(ids: np.ndarray, sets: list[np.ndarray], marks: np.ndarray, sides: np.ndarray, percent: int = LINK_PERCENT) -> list[tuple[int, int]]:
    """Links that join what no earlier link of these documents has joined. Documents of two sides
    are compared across them, those of one side (all sides equal) with one another."""
    sizes = np.array([len(s) for s in sets])
    of = np.arange(len(ids))  # component of each
    one_side = (sides == sides[0]).all()
    links = []
    for i in range(len(ids)):
        rest = np.arange(i + 1, len(ids))
        near = (of[rest] != of[i]) & (100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i]))
        if not one_side:
            near &= sides[rest] != sides[i]
        rest = rest[near]
        if len(rest):
            alike = (marks[rest] == marks[i]).sum(1, dtype=np.int32)
            rest = rest[alike >= (percent / 100 - ESTIMATE_SLACK) * marks.shape[1]]
        if not len(rest):
            continue
        parts = [sets[j] for j in rest]
        every = np.concatenate(parts)
        at = np.minimum(np.searchsorted(sets[i], every), len(sets[i]) - 1)
        starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
        shared = np.add.reduceat((sets[i][at] == every).astype(np.int64), starts)
        for j in rest[_linked(shared, sizes[i], sizes[rest], percent)]:
            if of[j] != of[i]:
                links.append((int(ids[j]), int(ids[i])))
                of[of == of[j]] = of[i]
    return links


def _unit_links(percent: int, unit: pa.Table) -> pa.Table:
    clusters, ids, sides = (unit[c].to_numpy() for c in ("cluster", "id", "side"))
    order = np.lexsort((ids, clusters))
    texts, marks = unit["text"], unit["signature"]
    links: list[tuple[int, int]] = []
    for group in np.split(order, np.flatnonzero(np.diff(clusters[order])) + 1):
        sets = _sets_of([texts[int(i)].as_py() for i in group])
        table = np.frombuffer(b"".join(marks[int(i)].as_py() for i in group), dtype=np.uint8).reshape(len(group), -1)
        links += cluster_links(ids[group], sets, table, sides[group], percent)
    return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})


def units(clusters: DataFrame) -> DataFrame:
    """(cluster, id, weight) -> (unit, cluster, id, side): where each document is to be compared.

    A cluster within the weight goes whole to one unit, together with others. A heavier
    one is cut into blocks of half the weight; every two blocks meet in one unit.
    """
    sums = clusters.groupBy("cluster").agg(F.sum("weight").alias("total"))
    light_total = sums.where(F.col("total") <= UNIT_WEIGHT).agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    light_units = max(1, -(-int(light_total) // UNIT_WEIGHT))
    placed = clusters.join(sums, "cluster")
    light = placed.where(F.col("total") <= UNIT_WEIGHT).select(
        F.struct(F.pmod(F.xxhash64("cluster"), F.lit(light_units)).alias("unit"), F.lit(-1).alias("i"), F.lit(-1).alias("j")).alias("unit"),
        "cluster", "id", F.lit(0).alias("side"),
    )
    blocks = F.ceil(F.col("total") / (UNIT_WEIGHT / 2)).cast("int")
    heavy = (
        placed.where(F.col("total") > UNIT_WEIGHT)
        .withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .select("cluster", "id", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select(
            F.struct(F.col("cluster").alias("unit"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).alias("unit"),
            "cluster", "id", F.col("block").alias("side"),
        )
    )
    return light.unionByName(heavy)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = LINK_PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, kept) of each document. Documents link from a similarity of ``percent`` on."""
    ship_package()
    marked = written(signatures(docs, key, text, percent), "neardup-signatures")
    nodes = written(
        marked.where("n_shingles > 0 and id is not null").groupBy("set_name")
        .agg(F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("signature").alias("signature")),
        "neardup-sets",
    )
    banded = nodes.select("id", F.explode("bands").alias("band"))
    centres = banded.groupBy("band").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "centre")
    coarse = connected(banded.join(centres, "band").select(F.col("id").alias("a"), F.col("centre").alias("b")), "neardup-coarse")
    members = coarse.select("id", F.col("component").alias("cluster"))
    members = members.unionByName(members.select(F.col("cluster").alias("id"), "cluster").distinct())
    weighed = nodes.select("id", "n_shingles", "signature").join(members, "id")
    clusters = written(weighed.select("cluster", "id", (F.col("n_shingles") + DOCUMENT_WEIGHT).alias("weight"), "signature"), "neardup-clusters")
    placed = units(clusters.select("cluster", "id", "weight"))
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    bodies = clusters.select("id", "signature").join(texts, "id").dropDuplicates(["id"])
    links = placed.join(bodies, "id").groupBy("unit").applyInArrow(lambda unit: _unit_links(percent, unit), "a long, b long")
    joined = connected(links, "neardup-links")
    named = nodes.select("set_name", "id").join(joined, "id", "left").select("set_name", F.coalesce("component", "id").alias("component"))
    return marked.join(named, "set_name", "left").select(
        F.col("id").alias(key), "n_shingles", F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = LINK_PERCENT) -> DataFrame:
    """The rows whose document has the smallest id of its component, once each; rows without an id stay. All columns stay as they are."""
    chosen = near_duplicates(docs, key, text, percent).where("kept").select(F.col(key).alias("_chosen")).where("_chosen is not null").distinct()
    kept = docs.join(chosen, docs[key].cast("long") == chosen["_chosen"], "left_semi").dropDuplicates([key])
    return kept.unionByName(docs.where(docs[key].isNull()))


SQL = rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SEPARATORS}'), lambda x: x <> '') AS w
  FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + {WORDS_PER_SHINGLE - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {WORDS_PER_SHINGLE - 1}) + 1)) AS s FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
  WHERE 100 * shared.n >= {LINK_PERCENT} * (x.n + y.n - shared.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM doc UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
component AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM component LEFT JOIN size USING (doc_id)
"""
