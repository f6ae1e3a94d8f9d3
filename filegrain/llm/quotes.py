"""Chat formatting by quotation linking.

Each line's quote level is the number of ``>`` before its text. Neighbouring lines of
one level form a passage; a passage is normalised (lower case, white space as one
space, so that re-wrapping does no harm), cut into sentences, and each sentence
hashed. The same is done with every message's own words, the passages of level zero.
The original of a quoted sentence is the first message of the same conversation that
says it in its own words, if that came before. A message replies to the latest
original among its quotes of level one; without one it starts a thread.

The result is every message without its quotes, and its place: parent, thread (the
message that its chain of replies starts from) and depth in that chain. Ordering by
conversation, thread and turn puts every reply after what it replies to.

Built-in functions only. Sentences meet by hash over the whole table; nothing gathers
a conversation. Chains are followed by pointer doubling, so their length costs its
logarithm in joins.

Null or empty texts have no passages and are kept with an empty text. Rows that
repeat a turn are kept each; they quote alike and count as one original. Null
conversation ids or turns are kept and linked with nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filegrain.llm.common import written

# A line's quote marks, what introduces a quote, and where a sentence ends.
MARKS = r"^\s*(?:>\s?)+"
INTRODUCTION = r"(?i)^\s*(?:on\b.{0,200}\bwrote|am\b.{0,200}\bschrieb.{0,80}|le\b.{0,200}\ba écrit|el\b.{0,200}\bescribió)\s*:\s*$"
LINE_END = r"\r\n|\r|\n"
SENTENCE_END = r"(?<=[.!?…])\s+"
LINE, PASSAGE = "\ue000", "\ue001"  # between lines and passages while they are put together


def levels_of(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", "")))


def _passages(read: DataFrame) -> DataFrame:
    """Adds ``passages``: array of (level, text), neighbouring lines of one level joined.

    A message without a line that starts with a mark is one passage; only the others are taken apart.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), f"[{LINE}{PASSAGE}]", " ")
    split = read.withColumn("_lines", F.when(F.col("text").rlike(r"(?m)^\s*>"), F.split(text, LINE_END)))
    split = split.withColumn("_levels", levels_of(F.col("_lines")))
    own = F.transform("_lines", lambda x, i: F.struct(x.alias("line"), F.get("_levels", i).alias("level"), F.get("_levels", i - 1).alias("before"), F.get("_levels", i + 1).alias("after")))
    own = F.filter(own, lambda s: ~((s["level"] == 0) & (F.coalesce(s["after"], F.lit(0)) > 0) & s["line"].rlike(INTRODUCTION)))
    marked = F.transform(
        own,
        lambda s: F.concat(
            F.when(s["level"] == s["before"], F.lit(LINE)).otherwise(F.concat(F.lit(PASSAGE), s["level"].cast("string"), F.lit(LINE))),
            F.regexp_replace(s["line"], MARKS, ""),
        ),
    )
    runs = F.filter(F.split(F.array_join(marked, ""), PASSAGE), lambda r: r != "")
    cut = F.transform(runs, lambda r: F.struct(F.substring_index(r, LINE, 1).cast("int").alias("level"), F.regexp_replace(r, f"^[0-9]+{LINE}", "").alias("text")))
    whole = F.array(F.struct(F.lit(0).alias("level"), F.regexp_replace(text, LINE_END, LINE).alias("text")))
    return split.withColumn("passages", F.when(F.col("_lines").isNull(), whole).otherwise(cut)).drop("_lines", "_levels")


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), rf"[\s{LINE}]+", " "))


def _sentences(text: Column) -> Column:
    return F.filter(F.split(normalised(text), SENTENCE_END), lambda s: s.rlike(r"[\p{L}\p{N}]"))


def linked(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, turn, role, text, n_quoted, n_linked, max_level, parent_turn, thread_turn, depth) of each row.

    ``n_quoted``: quoted sentences; ``n_linked``: those with an original; ``text``: without
    quotes and the lines that introduce them.
    """
    read = messages.select(F.col(conversation).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    parsed = _passages(read)
    own_text = F.trim(F.regexp_replace(F.array_join(F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: p["text"]), LINE), LINE, "\n"))
    spoken = F.flatten(F.transform("passages", lambda p: F.transform(_sentences(p["text"]), lambda s: F.struct(p["level"].alias("level"), F.xxhash64(s).alias("sentence")))))
    # outer rows: of a plain generator the optimizer makes a filter that takes every message apart once more, its lines once for each line
    rows_said = parsed.where("conv is not null and turn is not null").select("conv", "turn", F.explode_outer(spoken).alias("s"))
    said = written(rows_said.where("s is not null").select("conv", "turn", "s.level", "s.sentence"), "quotes-said")
    originals = said.where("level = 0").groupBy("conv", "sentence").agg(F.min("turn").alias("original"))
    quoted = said.where("level > 0").groupBy("conv", "turn", "sentence").agg(F.min("level").alias("level"))
    found = quoted.join(originals, ["conv", "sentence"], "left").withColumn("original", F.when(F.col("original") < F.col("turn"), F.col("original")))
    replies = written(
        found.groupBy("conv", "turn").agg(
            F.count(F.lit(1)).alias("n_quoted"), F.count("original").alias("n_linked"), F.max("level").alias("max_level"),
            F.max(F.when(F.col("level") == 1, F.col("original"))).alias("parent"),
        ),
        "quotes-replies",
    )
    chains = thread_starts(replies.where("parent is not null").select("conv", "turn", "parent"))
    placed = replies.join(chains, ["conv", "turn"], "left").withColumnsRenamed({"conv": "q_conv", "turn": "q_turn"})
    rows = parsed.select("conv", "turn", "role", own_text.alias("text"))
    joined = rows.join(placed, (F.col("conv") == F.col("q_conv")) & (F.col("turn") == F.col("q_turn")), "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return joined.select(
        F.col("conv").alias(conversation), F.col("turn").alias(turn), F.col("role").alias(role), F.col("text").alias(text),
        number("n_quoted"), number("n_linked"), number("max_level"), F.col("parent").alias("parent_turn"),
        F.coalesce("start", F.col("turn")).alias("thread_turn"), number("depth"),
    )


def thread_starts(replies: DataFrame) -> DataFrame:
    """(conv, turn, parent) -> (conv, turn, start, depth): the end of each chain of parents and its length, by pointer doubling."""
    chains = replies.select("conv", "turn", F.col("parent").alias("start"), F.lit(1).cast("long").alias("depth"))
    while True:
        ahead = chains.select("conv", F.col("turn").alias("start"), F.col("start").alias("next"), F.col("depth").alias("more"))
        joined = written(chains.join(ahead, ["conv", "start"], "left"), "quotes-chains")
        chains = joined.select("conv", "turn", F.coalesce("next", "start").alias("start"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        if joined.where("next is not null").isEmpty():
            return chains


def quoting(messages: DataFrame) -> DataFrame:
    """Messages that quote what they follow: the turn before in full, wrapped anew, with the turn before that nested
    in it in every other turn. For data without quotes; joins on (conv_id, turn), so that no conversation is gathered."""
    earlier = lambda back, name: messages.select("conv_id", (F.col("turn") + back).alias("turn"), F.col("text").alias(name))
    joined = messages.join(earlier(1, "_one"), ["conv_id", "turn"], "left").join(earlier(2, "_two"), ["conv_id", "turn"], "left")
    marked = lambda text, mark: F.concat(F.lit(mark), F.regexp_replace(text, r"\n|, ", f"\n{mark}"), F.lit("\n"))
    nested = F.when(F.col("_two").isNotNull() & (F.col("turn") % 2 == 0), marked(F.col("_two"), ">> ")).otherwise(F.lit(""))
    quote = F.when(F.col("_one").isNotNull(), F.concat(F.lit("On that day they wrote:\n"), nested, marked(F.col("_one"), "> "))).otherwise(F.lit(""))
    return joined.select("conv_id", "turn", "role", F.concat(quote, F.col("text")).alias("text"))


def sql(source: str = "SELECT conv_id, turn, role, text FROM conversations") -> str:
    """What ``linked`` returns, for DuckDB."""
    return rf"""
WITH RECURSIVE source AS ({source}),
read AS (SELECT row_number() OVER () AS r, * FROM source),
lines AS (
  SELECT r, k, line, length(regexp_replace(regexp_extract(line, '{MARKS}'), '[^>]', '', 'g')) AS level
  FROM (SELECT r, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS line
        FROM (SELECT r, string_split_regex(coalesce(text, ''), '
|
|
') AS l FROM read))),
kept AS (
  SELECT r, k, level, lag(level) OVER w AS before, regexp_replace(line, '{MARKS}', '') AS body, line, lead(level) OVER w AS after
  FROM lines WINDOW w AS (PARTITION BY r ORDER BY k)),
bodies AS (
  SELECT *, sum(CASE WHEN level = before THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY k) AS run FROM kept
  WHERE NOT (level = 0 AND coalesce(after, 0) > 0 AND regexp_matches(line, '{INTRODUCTION}'))),
own AS (SELECT r, trim(string_agg(body, chr(10) ORDER BY k)) AS text FROM bodies WHERE level = 0 GROUP BY r),
runs AS (SELECT r, run, level, trim(regexp_replace(lower(string_agg(body, ' ' ORDER BY k)), '\s+', ' ', 'g')) AS text FROM bodies GROUP BY 1, 2, 3),
said AS (
  SELECT conv_id, turn, level, sentence
  FROM (SELECT r, level, unnest(string_split(regexp_replace(text, '([.!?…])\s+', '\1' || chr(2), 'g'), chr(2))) AS sentence FROM runs) JOIN read USING (r)
  WHERE regexp_matches(sentence, '[\p{{L}}\p{{N}}]') AND conv_id IS NOT NULL AND turn IS NOT NULL),
originals AS (SELECT conv_id, sentence, min(turn) AS original FROM said WHERE level = 0 GROUP BY 1, 2),
quoted AS (SELECT conv_id, turn, sentence, min(level) AS level FROM said WHERE level > 0 GROUP BY 1, 2, 3),
found AS (SELECT q.*, CASE WHEN original < turn THEN original END AS original FROM quoted q LEFT JOIN originals USING (conv_id, sentence)),
replies AS (
  SELECT conv_id, turn, count(*) AS n_quoted, count(original) AS n_linked, max(level) AS max_level, max(original) FILTER (level = 1) AS parent
  FROM found GROUP BY 1, 2),
chains AS (
  SELECT conv_id, turn, parent AS start, 1 AS depth FROM replies WHERE parent IS NOT NULL
  UNION ALL
  SELECT c.conv_id, c.turn, p.parent, depth + 1 FROM chains c JOIN replies p ON p.conv_id = c.conv_id AND p.turn = c.start WHERE p.parent IS NOT NULL),
starts AS (SELECT conv_id, turn, min(start) AS start, max(depth) AS depth FROM chains GROUP BY 1, 2)
SELECT conv_id, turn, role, coalesce(own.text, '') AS text, coalesce(n_quoted, 0) AS n_quoted, coalesce(n_linked, 0) AS n_linked,
       CAST(coalesce(max_level, 0) AS BIGINT) AS max_level, parent AS parent_turn, coalesce(start, turn) AS thread_turn, CAST(coalesce(depth, 0) AS BIGINT) AS depth
FROM read LEFT JOIN own USING (r) LEFT JOIN replies USING (conv_id, turn) LEFT JOIN starts USING (conv_id, turn)
"""


QUOTING_SQL = r"""
SELECT c.conv_id, c.turn, c.role,
       CASE WHEN o.text IS NULL THEN '' ELSE 'On that day they wrote:' || chr(10)
         || CASE WHEN t.text IS NOT NULL AND c.turn % 2 = 0 THEN '>> ' || regexp_replace(t.text, '
|, ', chr(10) || '>> ', 'g') || chr(10) ELSE '' END
         || '> ' || regexp_replace(o.text, '
|, ', chr(10) || '> ', 'g') || chr(10) END || c.text AS text
FROM conversations c
LEFT JOIN conversations o ON o.conv_id = c.conv_id AND o.turn = c.turn - 1
LEFT JOIN conversations t ON t.conv_id = c.conv_id AND t.turn = c.turn - 2
"""
