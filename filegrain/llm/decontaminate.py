"""Benchmark decontamination as a prefix-filtered set join.

Every window of an item is a set of shingles. For a document to contain the window
it must contain each of them, so looking for one is enough: shingles are ordered by
how often the documents hold them, and the rarest is the window's prefix. Its
occurrences are the candidates; the window must then fit into the document around
the shingle (position and length) and its words must be equal there.

Built-in functions only. The windows' prefixes are broadcast when they are counted
to be at most ``BROADCAST_WINDOWS``; more of them meet the documents' shingles by a
shuffle, and the words for the exact comparison are joined to the candidates.

Nulls, in documents or items, have no words. Documents without words hit nothing.
Rows that repeat an id are judged one by one. An item without an id hits, but is
not listed. Ties in rarity go to the shingle further left. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filegrain.llm.common import ascii_lower, non_empty

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SHINGLE = 3
BROADCAST_WINDOWS = 100_000


def words_of(text: Column) -> Column:
    return non_empty(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS))


def shingles_of(words: Column, size: int) -> Column:
    """Hash of the ``size`` words from each word on."""
    return F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, size)]))


def item_windows(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(window, length, items): each distinct run of WINDOW words, or whole shorter item, with the ids that hold it."""
    words = items.select(F.col(item).alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(WINDOW))
    starts = words.select("item", "words", F.explode(F.sequence(F.lit(1), F.size("words") - length + 1)).alias("start"))
    return (
        starts.select("item", F.slice("words", F.col("start"), length).alias("window"))
        .groupBy("window").agg(F.collect_set("item").alias("items"))
        .select("window", F.size("window").alias("length"), "items")
    )


def window_shingles(windows: DataFrame) -> DataFrame:
    """(window, length, items, offset, shingle): all shingles of each window; short windows have shorter ones."""
    by_size = F.lit(None).cast("array<bigint>")
    for size in range(1, SHINGLE + 1):
        whole = F.slice(shingles_of(F.col("window"), size), 1, F.col("length") - size + 1)
        by_size = F.when(F.least(F.col("length"), F.lit(SHINGLE)) == size, whole).otherwise(by_size)
    return windows.select("*", F.posexplode(by_size).alias("offset", "shingle"))


def prefixes(docs: DataFrame, shingles: DataFrame, sizes: list[int], small: bool) -> DataFrame:
    """The rarest shingle of each window that the documents hold at all; a window that lacks one occurs nowhere."""
    wanted = shingles.select("shingle").distinct()
    seen = docs.select(F.explode(F.concat(*[shingles_of(F.col("words"), s) for s in sizes])).alias("shingle"))
    counts = seen.join(F.broadcast(wanted) if small else wanted, "shingle").groupBy("shingle").agg(F.count(F.lit(1)).alias("held"))
    ranked = shingles.join(counts, "shingle", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    rarest = ranked.groupBy("window").agg(
        F.min_by(F.struct("length", "items", "offset", "shingle", "held"), F.struct("held", "offset")).alias("p")
    )
    return rarest.select("window", "p.*").where("held > 0")


def occurrences(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(key, row_hash, start, length, items) of each place where a window occurs in a document."""
    shingles = window_shingles(item_windows(items))
    windows = shingles.where("offset = 0").agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.least("length", F.lit(SHINGLE))).alias("sizes")).first()
    sizes, small = sorted(windows["sizes"]) or [SHINGLE], windows["n"] <= broadcast_windows
    read = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("row_hash"), words_of(F.col(text)).alias("words"))
    prefix = prefixes(read, shingles, sizes, small)
    fits = (F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.size("words"))
    equal = F.slice("words", F.col("start") + 1, F.col("length")) == F.col("window")

    def placed(carried: list[str]) -> DataFrame:
        parts = [read.select(*carried, F.posexplode(shingles_of(F.col("words"), s)).alias("at", "shingle")) for s in sizes]
        hits = parts[0]
        for part in parts[1:]:
            hits = hits.unionByName(part)
        return hits.join(F.broadcast(prefix) if small else prefix, "shingle").withColumn("start", F.col("at") - F.col("offset"))

    if small:
        found = placed(["doc", "row_hash", "words"]).where(fits).where(equal)
    else:
        candidates = placed(["doc", "row_hash"]).where("start >= 0").alias("c")
        texts = read.dropDuplicates(["doc", "row_hash"]).alias("t")
        same = F.col("c.doc").eqNullSafe(F.col("t.doc")) & (F.col("c.row_hash") == F.col("t.row_hash"))
        found = candidates.join(texts, same).select("c.*", "t.words").where(fits).where(equal)
    return found.select("doc", "row_hash", "start", "length", "items")


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) of each row."""
    found = occurrences(docs, items, key, text, broadcast_windows)
    step = lambda a, s: F.struct(
        (a["covered"] + F.greatest(s["start"] + s["length"] - F.greatest(a["end"], s["start"]), F.lit(0))).alias("covered"),
        F.greatest(a["end"], s["start"] + s["length"]).alias("end"),
    )
    begin = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("end"))
    # a document's places are at most as many as its words times the window lengths
    hits = (
        found.groupBy("doc", "row_hash")
        .agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
        .select(
            F.col("doc").alias("hit_doc"), F.col("row_hash").alias("hit_hash"),
            F.aggregate("spans", begin, step, lambda a: a["covered"]).cast("long").alias("n_hit"),
            F.sort_array(F.transform("items", lambda i: i.cast("string"))).alias("items"),
        )
    )
    read = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("row_hash"), F.size(words_of(F.col(text))).cast("long").alias("n_words"))
    same = F.col("doc").eqNullSafe(F.col("hit_doc")) & (F.col("row_hash") == F.col("hit_hash"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return read.join(hits, same, "left").select(
        F.col("doc").alias(key), "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows in which no window occurs; all columns stay as they are."""
    hit = occurrences(docs, items, key, text).select(F.col("doc").alias("_doc"), F.col("row_hash").alias("_hash")).distinct()
    same = docs[key].eqNullSafe(hit["_doc"]) & (F.xxhash64(docs[text]) == hit["_hash"])
    return docs.join(hit, same, "left_anti")


_LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = r"list_filter(string_split_regex(coalesce({t}, ''), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')".replace("{t}", _LOWER)
SQL = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT.replace("{t}", "text")} AS w FROM documents),
item AS (SELECT item_id, {_SPLIT.replace("{t}", "text")} AS w FROM benchmark),
pieces AS (
  SELECT DISTINCT item_id, array_to_string(w[s:s + least(len(w), {WINDOW}) - 1], ' ') AS piece, least(len(w), {WINDOW}) AS n
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS s FROM item WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM pieces),
grams AS (
  SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS piece
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM doc, lengths WHERE len(w) >= n)),
found AS (SELECT r, s, n, item_id FROM grams JOIN pieces USING (piece, n)),
hit AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM found)) GROUP BY r),
listed AS (
  SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN listed USING (r)
"""
