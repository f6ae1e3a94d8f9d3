"""Phrase collocations from suffix subtrees, built apart for partitions of word prefixes.

Every word of a piece starts a suffix, cut off after ``DEPTH`` words. As in ERA the
suffixes are partitioned vertically: a prefix that may occur more often than a share of
the memory budget is made longer by a word, until it surely fits; prefixes are then dealt
into groups of the budget's size. A group's suffixes form one subtree that one task
builds without the others: its leaves are distinct suffixes with their totals, and the
total of any node is the sum of the leaves below it.

1. Words are counted (sums in the tasks, then a shuffle). A word rarer than ``least`` is in
   no candidate and ends a suffix as a piece's end does. A prefix occurs at most as often
   as its rarest word, so prefixes grow as long as all their words are hot.
2. Tasks sort the suffixes of some hundred thousand words at a time, sum equal ones and
   send each group one row: its words and its leaves as numbers.
3. A group merges its rows, sorts, and reads node totals off the sorted leaves. A node
   above the group's prefixes lies in several groups; such parts are summed by phrase.
4. Cuts, scores, dropped candidates and ranks are joins and sums over the phrases.

Tasks know frequent and hot words from two bit maps of at most ``MAP_BITS`` bits each, by
checksum. Two words with one bit cost some extra suffixes and longer prefixes, never a
count. A group holds about ``BUDGET`` leaves at most; equal suffixes are one leaf of each
sender, so a passage that a third of all rows hold stays small.

Nulls and empty texts have no words; a null language is ``und``. Long texts are read whole:
they are split some bytes at a time, between words, and suffixes run on. Rows that repeat
count as often as they occur. Ties in score go to the larger count, then to the phrase
that is smaller as bytes. An empty table gives no rows. Other columns of the table are
not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from filegrain.llm.common import LOWER, UPPER, written
from filegrain.session import ship_package

DEPTH = 4
LEAST = 30
TOP = 2000
INSIDE_PERCENT = 80
SCALE = 2_000_000
#: Leaves of a group; a word that occurs more often than a share of it is hot.
BUDGET = 1 << 21
HOT_SHARE = 2
MAP_BITS = 1 << 26
#: Words sorted at a time, words counted and distinct ones held at a time, bytes of text split at a time.
SORTED_WORDS = 1 << 21
COUNTED_WORDS = 1 << 23
HELD_WORDS = 1 << 18
SPLIT_BYTES = 1 << 20

ENDS = ".,;:!?\n\x0b\x0c\r"
BREAK = b"."
SEPARATORS = (ENDS + " \t").encode()
_PLAIN = bytes.maketrans((UPPER + ENDS + "\t").encode(), (LOWER + "." * len(ENDS) + " ").encode())


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """Lower-cased words and a BREAK for each end of a piece, some at a time. All separators are ASCII, so bytes of UTF-8 do."""
    at = 0
    while at < len(text):
        end = at + SPLIT_BYTES
        while end < len(text) and text[end] not in SEPARATORS:
            end += 1
        yield text[at:end].translate(_PLAIN).replace(BREAK, b" . ").split()
        at = end


def mark(lang: bytes, word: bytes) -> int:
    """What the bit maps know a word by; the same as ``mark_of``."""
    return zlib.crc32(lang + b"\n" + word)


def mark_of(lang: Column, word: Column) -> Column:
    return F.crc32(F.concat(lang, F.lit("\n"), word).cast("binary"))


def marks_of(lang: bytes, words: list[bytes]) -> np.ndarray:
    return np.fromiter((mark(lang, w) for w in words), np.uint64, len(words))


class Numbers:
    """Words as numbers in order of appearance, BREAK as 0, of one language."""

    def __init__(self, words: tuple = ()):
        self.of: defaultdict = defaultdict(count().__next__)
        self.of[BREAK]
        self.parts: list[np.ndarray] = []
        self.size = 0
        self.add([*words])

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.of.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def read(self) -> tuple[list[bytes], np.ndarray]:
        return list(self.of), np.concatenate(self.parts)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, bytes]]:
    for batch in batches:
        for lang, text in zip(batch["lang"].cast(pa.binary()), batch["text"].cast(pa.binary())):
            if text.is_valid and (content := text.as_py()):
                yield lang.as_py(), content


def _strings(words: list) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of what this task reads, in parts; a null word stands for all words."""
    held: dict[bytes, Numbers] = defaultdict(Numbers)

    def flushed() -> Iterator[pa.RecordBatch]:
        for lang, numbers in held.items():
            words, ids = numbers.read()
            n = np.bincount(ids, minlength=len(words))
            n[0] = n[1:].sum()
            yield pa.RecordBatch.from_arrays([_strings([lang] * len(n)), _strings([None, *words[1:]]), pa.array(n, pa.int64())], ["lang", "word", "n"])
        held.clear()

    for lang, text in _texts(batches):
        for some in tokens(text):
            held[lang].add(some)
            if sum(len(x.of) for x in held.values()) > HELD_WORDS or sum(x.size for x in held.values()) > COUNTED_WORDS:
                yield from flushed()
    yield from flushed()


def texts_of(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))


def word_counts(texts: DataFrame, least: int) -> DataFrame:
    """(lang, word, n): words with ``least`` occurrences, and a null word with the number of all."""
    parts = texts.mapInArrow(_count_words, "lang string, word string, n long")
    return parts.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("word").isNull() | (F.col("n") >= least))


def bit_map(words: DataFrame, bits: int) -> bytes:
    """A bit for the mark of each word: ``bits`` / 8 bytes, whatever the table."""
    at = F.pmod(mark_of(F.col("lang"), F.col("word")), F.lit(bits))
    cells = words.select(F.shiftright(at, 6).cast("int").alias("cell"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")).alias("bit"))
    found = cells.groupBy("cell").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found["cell"].to_numpy()] = found["bit"].to_numpy()
    return out.tobytes()


def in_map(bits: np.ndarray, marks: np.ndarray) -> np.ndarray:
    at = marks % np.uint64(64 * len(bits))
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def suffixes(ids: np.ndarray) -> list[np.ndarray]:
    """The DEPTH columns of the suffixes that start before the last DEPTH - 1 numbers and have two words; 0 ends a suffix."""
    n = len(ids) - DEPTH + 1
    columns = [ids[:n]]
    for k in range(1, DEPTH):
        columns.append(np.where(columns[-1] > 0, ids[k : n + k], 0))
    return [c[columns[1] > 0] for c in columns]


def summed(columns: list[np.ndarray], totals: np.ndarray | None, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in order, with the sums of their totals (None: 1 each). Numbers are below ``size``."""
    n = len(columns[0])
    if not n:
        return columns, np.zeros(0, np.int64)
    if size**DEPTH < 1 << 63:  # a row fits into one number
        key = columns[0].astype(np.int64)
        for column in columns[1:]:
            key = key * size + column
        if totals is None:
            key.sort()
        else:
            order = np.argsort(key)
            key, totals = key[order], totals[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, columns = key[first], []
        for _ in range(DEPTH):
            key, column = np.divmod(key, size)
            columns.insert(0, column.astype(np.int32))
    else:
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        totals = None if totals is None else totals[order]
        first = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]))
        columns = [c[first] for c in columns]
    return columns, np.diff(np.append(first, n)) if totals is None else np.add.reduceat(totals, first)


def group_of(columns: list[np.ndarray], marks: np.ndarray, hot: np.ndarray, groups: int) -> np.ndarray:
    """The group of each suffix's prefix: its words up to the first that is not hot, all if there is none."""
    spread = mixed(marks + np.uint64(1))
    prefix, grows = spread[columns[0]], hot[columns[0]]
    for column in columns[1:]:
        grows = grows & (column > 0)
        prefix = np.where(grows, mixed(prefix * np.uint64(3) + spread[column]), prefix)
        grows = grows & hot[column]
    return (prefix % np.uint64(groups)).astype(np.int64)


SENT = "lang string, grp long, n_words int, n_leaves int, word_bytes int, packed binary"


def narrowest(n_words: int) -> np.dtype:
    """What holds the numbers 0 to ``n_words``."""
    return np.dtype("<u1" if n_words < 1 << 8 else "<u2" if n_words < 1 << 16 else "<u4")


def packed(words: list[bytes], used: np.ndarray, columns: list[np.ndarray], totals: np.ndarray) -> tuple[int, int, int, bytes]:
    """The words in use, in order, and the leaves by columns, compressed: equal beginnings lie side by side."""
    text = b"\n".join(words[i] for i in used)
    kind = narrowest(len(used))
    body = b"".join([text, *(c.astype(kind).tobytes() for c in columns), totals.astype("<u4").tobytes()])
    return len(used), len(totals), len(text), pa.compress(body, codec="zstd", asbytes=True)


def unpacked(n_words: int, n_leaves: int, word_bytes: int, body: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    kind = narrowest(n_words)
    body = pa.decompress(body, word_bytes + n_leaves * (DEPTH * kind.itemsize + 4), codec="zstd", asbytes=True)
    columns = np.frombuffer(body, kind, DEPTH * n_leaves, word_bytes).reshape(DEPTH, n_leaves)
    return body[:word_bytes].split(b"\n"), columns, np.frombuffer(body, "<u4", n_leaves, word_bytes + columns.nbytes)


def _send(groups: int, frequent_map: bytes, hot_map: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every group one row of each sorted run: the words that its leaves use, the leaves' columns, their totals."""
    frequent_bits, hot_bits = np.frombuffer(frequent_map, np.uint64), np.frombuffer(hot_map, np.uint64)
    held: dict[bytes, Numbers] = defaultdict(Numbers)

    def sorted_run(lang: bytes, words: list[bytes], ids: np.ndarray) -> pa.RecordBatch:
        marks = marks_of(lang, words)
        kept = in_map(frequent_bits, marks)
        kept[0] = False
        order = np.array(sorted(np.flatnonzero(kept).tolist(), key=words.__getitem__), dtype=np.int64)
        new = np.zeros(len(words), np.int32)
        new[order] = np.arange(1, len(order) + 1)
        words, marks = [BREAK, *(words[i] for i in order)], marks[np.concatenate([[0], order])]
        hot = in_map(hot_bits, marks)
        hot[0] = False
        columns, totals = summed(suffixes(new[ids]), None, len(words))
        group = group_of(columns, marks, hot, groups)
        order = np.argsort(group, kind="stable")
        group, totals, columns = group[order], totals[order], [c[order] for c in columns]
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        rows = []
        for a, b in zip(starts, [*starts[1:], len(group)]):
            part = [c[a:b] for c in columns]
            if len(words) < 8 * (b - a):
                seen = np.zeros(len(words), bool)
                for c in part:
                    seen[c] = True
                seen[0] = False
                used, local = np.flatnonzero(seen), np.cumsum(seen)
                part = [np.where(c > 0, local[c], 0) for c in part]
            else:
                used = np.unique(np.concatenate(part))
                used = used[used > 0]
                part = [np.where(c > 0, np.searchsorted(used, c) + 1, 0) for c in part]
            rows.append((int(group[a]), *packed(words, used, part, totals[a:b])))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([_strings([lang] * len(rows)), *columns], [c.split()[0] for c in SENT.split(", ")])

    def flushed(lang: bytes) -> pa.RecordBatch:
        words, ids = held[lang].read()
        held[lang] = Numbers(tuple(words[i] for i in ids[1 - DEPTH :]))  # their suffixes are not cut yet
        return sorted_run(lang, words, ids)

    for lang, text in _texts(batches):
        for some in tokens(text):
            held[lang].add(some)
            if held[lang].size >= SORTED_WORDS:
                yield flushed(lang)
        held[lang].add([BREAK] * (DEPTH - 1))
        if sum(x.size for x in held.values()) >= 2 * SORTED_WORDS:  # many languages
            for other in list(held):
                yield flushed(other)
            held.clear()
    for lang in list(held):
        yield flushed(lang)


def _merge(hot_map: bytes, least: int, group: pa.Table) -> pa.Table:
    """(lang, phrase, size, n): the nodes of the group's subtree from two words on. A node with ``least``
    occurrences, or one whose leaves lie in other groups as well."""
    lang = group["lang"][0].as_py()
    numbers: defaultdict = defaultdict(count(1).__next__)
    parts: list[list[np.ndarray]] = [[] for _ in range(DEPTH + 1)]
    for n_words, n_leaves, word_bytes, body in zip(*(group[c].to_pylist() for c in ("n_words", "n_leaves", "word_bytes", "packed"))):
        names, local, of_each = unpacked(n_words, n_leaves, word_bytes, body)
        ids = np.concatenate([np.zeros(1, np.int32), np.fromiter(map(numbers.__getitem__, names), np.int32, len(names))])
        for part, column in zip(parts, [*(ids[c] for c in local), of_each.astype(np.int64)]):
            part.append(column)
    words = [b"", *numbers]
    hot = in_map(np.frombuffer(hot_map, np.uint64), marks_of(lang.encode(), words))
    columns, totals = summed([np.concatenate(p) for p in parts[:DEPTH]], np.concatenate(parts[DEPTH]), len(words))
    phrases: list[bytes] = []
    sizes, counts = [], []
    new, all_hot = np.zeros(len(totals), bool), np.ones(len(totals), bool)
    new[:1] = True
    for depth, column in enumerate(columns, 1):
        new[1:] |= column[1:] != column[:-1]
        all_hot &= hot[column]
        if depth == 1:
            continue
        starts = np.flatnonzero(new)
        total = np.add.reduceat(totals, starts)
        shown = (column[starts] > 0) & ((total >= least) | (all_hot[starts] & (depth < DEPTH)))
        for row in starts[shown]:
            phrases.append(b" ".join(words[c[row]] for c in columns[:depth]))
        sizes += [depth] * int(shown.sum())
        counts += total[shown].tolist()
    return pa.table({"lang": pa.array([lang] * len(phrases), pa.string()), "phrase": _strings(phrases), "size": pa.array(sizes, pa.int32()), "n": pa.array(counts, pa.int64())})


def phrase_counts(texts: DataFrame, words: DataFrame, least: int = LEAST, budget: int = BUDGET) -> DataFrame:
    """(lang, phrase, size, n) of the phrases of 2 to DEPTH words with ``least`` occurrences. ``words``: (lang, word, n)
    of those with ``least``, a table that is read several times."""
    ship_package()
    known, occurrences = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    groups = max(1, -(-2 * int(occurrences) // budget))
    bits = min(MAP_BITS, 1 << max(12, (16 * known).bit_length()))
    frequent_map, hot_map = bit_map(words, bits), bit_map(words.where(F.col("n") > budget // HOT_SHARE), bits)
    sent = texts.mapInArrow(partial(_send, groups, frequent_map, hot_map), SENT)
    nodes = sent.groupBy("lang", "grp").applyInArrow(lambda group: _merge(hot_map, least, group), "lang string, phrase string, size int, n long")
    return nodes.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def cut_scores(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) at the cut that scores lowest. Parts of a frequent phrase are frequent."""
    counts = phrases.select("lang", "phrase", "n").unionByName(words.select("lang", F.col("word").alias("phrase"), "n"))
    cuts = phrases.select("lang", "phrase", F.col("n").alias("a"), "size", F.split("phrase", " ").alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"),
    )
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    rests = counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    score = F.expr(f"(cast({SCALE} as decimal(38, 0)) * a) div (cast(l as decimal(38, 0)) + r)")
    return (
        cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"]).withColumn("score", score)
        .groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "score"), F.struct("score", "k")).alias("c")).select("lang", "phrase", "c.*")
    )


def largest_around(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, around): the count of the most frequent longer phrase with these words inside."""
    inside = F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("size") - 1),
        lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda at: F.array_join(F.slice(F.split("phrase", " "), at, m), " ")),
    ))
    return phrases.where("size > 2").select("lang", "n", F.explode(inside).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("around"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases."""
    texts = texts_of(docs, text, lang)
    counted = written(word_counts(texts, least), "collocations-words")
    words = counted.where(F.col("word").isNotNull())
    phrases = written(phrase_counts(texts, words, least, budget), "collocations-phrases")
    scored = cut_scores(phrases, words).join(largest_around(phrases), ["lang", "phrase"], "left")
    wide = "cast(100 as decimal(38, 0)) * around >= cast({} as decimal(38, 0)) * a".format(INSIDE_PERCENT)
    free = scored.where(F.expr(f"around is null or not ({wide})"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = free.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = counted.where(F.col("word").isNull()).select("lang", "n")
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = rf"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents WHERE text IS NOT NULL),
line AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM piece),
gram AS (
  SELECT lang, size, w[s:s + size - 1] AS w
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM line, (VALUES (1), (2), (3), (4)) t(size) WHERE len(w) >= size)),
counted AS (SELECT lang, size, w, count(*) AS f FROM gram GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM counted WHERE size = 1 GROUP BY lang),
frequent AS (SELECT * FROM counted WHERE f >= {LEAST}),
cut AS (
  SELECT c.lang, c.w, c.f AS a, c.k, x.f AS l, y.f AS r, (CAST({SCALE} AS HUGEINT) * c.f) // (CAST(x.f AS HUGEINT) + y.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM frequent WHERE size > 1) c
  JOIN frequent x ON x.lang = c.lang AND x.w = c.w[1:c.k] JOIN frequent y ON y.lang = c.lang AND y.w = c.w[c.k + 1:]),
scored AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
inside AS (
  SELECT lang, w[s:s + m - 1] AS w, max(f) AS around
  FROM (SELECT lang, w, f, m, unnest(range(1, size - m + 2)) AS s FROM (SELECT *, unnest(range(2, size)) AS m FROM frequent)) GROUP BY ALL),
free AS (
  SELECT s.*, array_to_string(s.w, ' ') AS phrase FROM scored s LEFT JOIN inside i ON i.lang = s.lang AND i.w = s.w
  WHERE around IS NULL OR 100 * CAST(around AS HUGEINT) < {INSIDE_PERCENT} * CAST(a AS HUGEINT)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM free)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= {TOP}
"""
