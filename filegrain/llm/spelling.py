"""Spelling variants: words one code point apart, found by pairs of trie nodes.

Words are put into two tries, one forward and one over the reversed words. A node's
number follows from its parent's number and its code point, so that every task numbers
nodes alike without a table of them. A word passes a forward node before each of its
positions (all it begins with) and a reversed node behind each (all it ends with), and
gives two kinds of integer pairs:

- a skipped position i: the node before i and the node after i;
- a place between positions: the nodes on either side, which is the word itself.

Words that share a pair of skipped positions differ by the replaced code point there; a
word whose own pair equals another's pair of a skipped position lacks that code point. Of
equal neighbouring code points only the first is skipped for the second kind, so every
two near words meet in exactly one pair, and counts are sums without a list of links.

A pair gathers at most one word for each code point of the alphabet and the one without:
the words are read off the pair in one short array. What a word passes on is a count and
its best partner. Words are numbered in code-point order, which settles ties without
carrying texts; rows grow with a word's length, not with its square. Numbers of nodes have
61 bits, a pair 122: two different pairs meet with a chance below 1e-12 in 10^12 rows.

Nulls and texts without letters have no words; a null id is an empty string before the
colon. Very long texts and words are whole. Rows that repeat count as often as they occur. A word
that is near nothing has n_near 0 and is its own root. An empty table gives no rows. Other
columns of the table are not read, whatever their names.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from filegrain.llm.common import LOWER, UPPER, ascii_lower, map_arrow, written

LEAST_LENGTH = 6
LEAST_COUNT = 5
TIMES = 5
ERRORS_IN = 199
RUN = "[a-zÀ-ÿ]"

PRIME = (1 << 61) - 1
BASE = 0x1B873593CC9E2D51 % PRIME
ROOT = 0x2545F4914F6CDD1D % PRIME
#: In place of the skipped code point: nothing is skipped.
NOTHING = -1


def words_of(docs: DataFrame, key: str, text: str, least_length: int, errors_in: int) -> DataFrame:
    """(word) of each run of letters; of one run in ``errors_in`` a code point is gone, chosen by the checksum."""
    pattern = F.lit(f"{RUN}{{{least_length},}}")
    found = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("doc"), F.regexp_extract_all(ascii_lower(F.col(text)), pattern, F.lit(0)).alias("runs"))
    runs = found.select("doc", F.explode("runs").alias("run")).select(
        "run", F.char_length("run").alias("length"), F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h")
    )
    at = (F.col("h") % F.col("length")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("length")))
    return runs.select(F.when(F.col("h") % errors_in == 0, shorter).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= least_length)


def vocabulary(words: DataFrame, least_count: int) -> DataFrame:
    """(id, word, n): the ids rise in code-point order. To be written before it is used twice."""
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)
    return counted.orderBy("word").select(F.monotonically_increasing_id().alias("id"), "word", "n")


def trie_numbers(codes: list[int]) -> list[int]:
    """The nodes on the way from the root, which is the first."""
    return list(accumulate(codes, lambda node, code: (node * BASE + code) % PRIME, initial=ROOT))


PAIRS = "prefix long, suffix long, id long, n long, skipped int, leads boolean"


def _pairs(batch: pa.RecordBatch) -> pa.RecordBatch:
    columns: list[list[np.ndarray]] = [[] for _ in range(6)]
    for key, word, n in zip(*(batch[c].to_pylist() for c in ("id", "word", "n"))):
        codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int32)
        size = len(codes)
        prefix, suffix = np.array(trie_numbers(codes.tolist())), np.array(trie_numbers(codes[::-1].tolist()))[::-1]
        leads = np.ones(size, bool)
        leads[1:] = codes[1:] != codes[:-1]
        rows = (
            np.concatenate([prefix[:-1], prefix]), np.concatenate([suffix[1:], suffix]), np.full(2 * size + 1, key), np.full(2 * size + 1, n),
            np.concatenate([codes, np.full(size + 1, NOTHING, np.int32)]), np.concatenate([leads, np.zeros(size + 1, bool)]),
        )
        for column, part in zip(columns, rows):
            column.append(part)
    names = [c.split()[0] for c in PAIRS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names)


def node_pairs(vocab: DataFrame) -> DataFrame:
    return map_arrow(vocab.select("id", "word", "n"), _pairs, PAIRS)


def _near(one: Column, other: Column) -> Column:
    """Both skip a position, or one has nothing there and the other skips the first of its equal code points."""
    nothing, others = one["skipped"] == NOTHING, other["skipped"] == NOTHING
    return (one["skipped"] != other["skipped"]) & F.when(nothing, other["leads"]).when(others, one["leads"]).otherwise(True)


def near_words(pairs: DataFrame) -> DataFrame:
    """(id, n_near, best_n, best_id) of each word that is near another."""
    together = Window.partitionBy("prefix", "suffix")
    shared = pairs.withColumn("size", F.count(F.lit(1)).over(together)).where("size > 1")
    members = shared.groupBy("prefix", "suffix").agg(F.collect_list(F.struct("n", (-F.col("id")).alias("order"), "skipped", "leads")).alias("members"))

    def seen(one: Column) -> Column:
        others = F.filter("members", lambda other: _near(one, other))
        best = F.array_max(F.transform(others, lambda other: F.struct(other["n"].alias("n"), other["order"].alias("order"))))
        return F.struct((-one["order"]).alias("id"), F.size(others).cast("long").alias("n_near"), best.alias("best"))

    each = members.select(F.explode(F.transform("members", seen)).alias("s")).select("s.*").where("n_near > 0")
    return each.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best")).select(
        "id", "n_near", F.col("best.n").alias("best_n"), (-F.col("best.order")).alias("best_id")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) from (id, form): follows forms to the last. Every round doubles the way; as a form is several times
    as frequent as its word, ways are short."""
    now = written(forms.select("id", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        if now.join(further, "root", "left_semi").isEmpty():
            return now
        now = written(now.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root")), "spelling-roots")


def variants(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
    times: int = TIMES, errors_in: int = ERRORS_IN,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word."""
    vocab = written(vocabulary(words_of(docs, key, text, least_length, errors_in), least_count), "spelling-words")
    near = written(near_words(node_pairs(vocab)), "spelling-near")
    formed = near.join(vocab.select("id", "n"), "id").where(F.col("best_n") >= times * F.col("n")).select("id", F.col("best_id").alias("form"))
    formed = written(formed, "spelling-forms")
    named = (
        formed.join(roots(formed), "id")
        .join(vocab.select(F.col("id").alias("form"), F.col("word").alias("form_word"), F.col("n").alias("form_n")), "form")
        .join(vocab.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root")
        .select("id", "form_word", "form_n", "root_word")
    )
    return vocab.join(near.select("id", "n_near"), "id", "left").join(named, "id", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"
    )


SQL = rf"""
WITH RECURSIVE polynomial AS (
  SELECT i, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM polynomial WHERE k < 8),
steps AS (SELECT list(c ORDER BY i) AS t FROM polynomial WHERE k = 8),
run AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{RUN}{{{LEAST_LENGTH},}}')) AS run
  FROM documents WHERE text IS NOT NULL),
counted AS (SELECT doc, run, count(*) AS n, hex(encode(doc || ':' || run)) AS x FROM run GROUP BY ALL),
summed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) AS h
  FROM counted, steps),
misspelt AS (
  SELECT n, CASE WHEN h % {ERRORS_IN} = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word FROM summed),
vocab AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM misspelt WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
skipped AS (SELECT word, n, substr(word, 1, i - 1) AS p, substr(word, i + 1) AS s FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
link AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM skipped a JOIN skipped b ON a.p = b.p AND a.s = b.s AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM skipped a JOIN vocab b ON b.word = a.p || a.s
  UNION SELECT b.word, b.n, a.word, a.n FROM skipped a JOIN vocab b ON b.word = a.p || a.s),
best AS (SELECT word, n, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n FROM link GROUP BY ALL),
formed AS (SELECT word, near AS form, near_n AS form_n FROM best WHERE near_n >= {TIMES} * n),
way AS (SELECT word, form AS root, 1 AS steps FROM formed UNION ALL SELECT way.word, formed.form, steps + 1 FROM way JOIN formed ON formed.word = way.root),
last AS (SELECT word, arg_max(root, steps) AS root FROM way GROUP BY word)
SELECT v.word, form, coalesce(root, v.word) AS root, v.n, coalesce(n_near, 0) AS n_near, form_n
FROM vocab v LEFT JOIN best b ON b.word = v.word LEFT JOIN formed f ON f.word = v.word LEFT JOIN last ON last.word = v.word
"""
