"""Queries over texts: sentences, tokens, signals, scores, changes, categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from filegrain.functions import fixed_values as fv
from filegrain.functions.rows import element_rows, struct_rows
from filegrain.functions.scoring import (
    analyst_note, find_hits, lexicon_table, lexicon_table_hits, of_tier, score_text, signals, top_signals, with_context,
)
from filegrain.functions.text import jaccard, let, sentences, token_set
from filegrain.operators import alignment as al
from filegrain.operators.categories import categorise, category_summary, highlight_sentences, quick_categories
from filegrain.operators.matches import sentence_matches
from filegrain.operators.governance import governance_score, governance_signals, governance_summary
from filegrain.operators.ownership import ownership_columns
from filegrain.plans import filings
from filegrain.plans.compare import compare_texts
from filegrain.plans.score import score_sections

from . import query, table
from .corpus import (
    SQL_DISCLOSURES, accession, disclosures, letters, lit, sql_alignment, sql_compared, sql_letters, sql_lexicon, sql_materiality, sql_note,
    sql_sentences, sql_trim,
    strings,
)

WITH = f"WITH {SQL_DISCLOSURES}, {sql_lexicon()}"
HITS = "hits AS (SELECT doc_id, l.* FROM disc, lex l WHERE contains(lower(text), lower(l.signal)))"
OLD_HITS = "old_hits AS (SELECT doc_id, l.* FROM disc, lex l WHERE contains(lower(older_text), lower(l.signal)))"


@query("sentences", f"""
SELECT doc_id, CAST(len(s) AS INT) AS n_sentences, CAST(len(t) AS INT) AS n_normalised,
  CAST(list_sum(list_transform(s, lambda x: length(x))) AS BIGINT) AS chars, s[1] AS first_sentence, t[-1] AS last_normalised
FROM (SELECT doc_id, {sql_sentences('text')} AS s, {sql_sentences('text', normalise=True)} AS t FROM documents)
""")
def q_sentences(spark, d):
    docs = table(spark, d, "documents").select(
        "doc_id", sentences(F.col("text")).alias("s"), sentences(F.col("text"), normalise=True).alias("t")
    )
    return docs.select(
        "doc_id", F.size("s").alias("n_sentences"), F.size("t").alias("n_normalised"),
        F.when(F.size("s") > 0, F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))).alias("chars"),
        F.get("s", F.lit(0)).alias("first_sentence"), F.get("t", F.size("t") - 1).alias("last_normalised"),
    )


@query("token_jaccard_pairs", f"""
WITH {SQL_DISCLOSURES},
tok AS (
  SELECT doc_id,
    list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{3,}}'))) AS a,
    list_distinct(list_filter(regexp_split_to_array(lower(older_text), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{3,}}'))) AS b
  FROM disc
)
SELECT doc_id, CAST(len(a) AS INT) AS newer_tokens, CAST(len(b) AS INT) AS older_tokens,
  CAST(len(list_intersect(a, b)) AS INT) AS shared,
  CASE WHEN len(a) + len(b) = 0 THEN 1.0
    ELSE CAST(len(list_intersect(a, b)) AS DOUBLE) / (len(a) + len(b) - len(list_intersect(a, b))) END AS similarity
FROM tok
""")
def q_jaccard(spark, d):
    t = disclosures(spark, d).select(
        "doc_id", token_set(F.col("text")).alias("a"), token_set(F.col("older_text")).alias("b")
    )
    return t.select(
        "doc_id", F.size("a").alias("newer_tokens"), F.size("b").alias("older_tokens"),
        F.size(F.array_intersect("a", "b")).alias("shared"), jaccard(F.col("a"), F.col("b")).alias("similarity"),
    )


@query("lexicon_rows", f"WITH {sql_lexicon()} SELECT signal, tier, weight, ord, (SELECT count(*) FROM documents WHERE contains(lower(text), lower(signal))) AS n_documents FROM lex")
def q_lexicon(spark, d):
    # documents counted per phrase: hits are exploded, never text times lexicon
    hits = struct_rows(table(spark, d, "documents"), [], find_hits(F.col("text")))
    n = hits.groupBy("ord").agg(F.count(F.lit(1)).alias("n"))
    return lexicon_table(spark).join(n, "ord", "left").select(
        "signal", "tier", "weight", "ord", F.coalesce("n", F.lit(0)).alias("n_documents")
    )


@query("lexicon_table_hits", """WITH lex AS (SELECT DISTINCT substr(text, 1 + item_id % 7, 3 + item_id % 9) AS signal, CAST(item_id % 3 + 1 AS INT) AS tier, item_id AS ord FROM benchmark
  UNION ALL SELECT s, 1, -len(s) FROM (VALUES ('a'), ('the'), ('THE'), ('')) AS v(s))
SELECT doc_id, signal, tier, ord FROM documents JOIN lex ON signal <> '' AND contains(lower(text), lower(signal))""")
def q_lexicon_table(spark, d):
    """A lexicon held as a table: pieces of the benchmark items, and some very short entries."""
    cut = F.expr("substring(text, cast(1 + item_id % 7 as int), cast(3 + item_id % 9 as int))")
    lexicon = table(spark, d, "benchmark").select(cut.alias("signal"), (F.col("item_id") % 3 + 1).cast("int").alias("tier"), F.col("item_id").alias("ord"))
    short = spark.createDataFrame([(s, 1, -len(s)) for s in ("a", "the", "THE", "")], "signal string, tier int, ord long")
    return lexicon_table_hits(table(spark, d, "documents"), lexicon.unionByName(short), ["doc_id"])


@query("signal_hits", f"{WITH}, {HITS} SELECT doc_id, signal, tier, weight, ord FROM hits")
def q_hits(spark, d):
    return struct_rows(disclosures(spark, d), ["doc_id"], find_hits(F.col("text"))).select(
        "doc_id", "signal", "tier", "weight", "ord"
    )


@query("signal_context", f"""
{WITH}, spots AS (SELECT doc_id, l.signal, l.tier, text, strpos(lower(text), lower(l.signal)) AS p FROM disc, lex l)
SELECT doc_id, signal, tier, '...' || {sql_trim("replace(substr(text, greatest(1, p - 60), p + length(signal) + 60 - greatest(1, p - 60)), chr(10), ' ')")} || '...' AS context
FROM spots WHERE p > 0
""")
def q_context(spark, d):
    df = disclosures(spark, d).withColumn("h", find_hits(F.col("text")))
    return struct_rows(df, ["doc_id"], with_context(F.col("h"), F.col("text"))).select("doc_id", "signal", "tier", "context")


SCORE_SQL = f"""
{WITH}, {HITS},
agg AS (
  SELECT doc_id, sum(base) AS pts, count(*) FILTER (tier = 1) AS n1, count(*) FILTER (tier = 2) AS n2, count(*) FILTER (tier = 3) AS n3,
    list(signal ORDER BY ord) FILTER (tier = 1) AS l1, list(signal ORDER BY ord) FILTER (tier = 2) AS l2
  FROM hits GROUP BY doc_id
)
SELECT d.doc_id, coalesce(pts, 0) / 100.0::DOUBLE AS raw_score, {sql_materiality('coalesce(pts, 0)')} AS materiality,
  CAST(coalesce(n1, 0) AS INT) AS tier1_count, CAST(coalesce(n2, 0) AS INT) AS tier2_count, CAST(coalesce(n3, 0) AS INT) AS tier3_count,
  coalesce(array_to_string(l1[1:20], ','), '') AS tier1, coalesce(array_to_string(l2[1:20], ','), '') AS tier2
FROM disc d LEFT JOIN agg USING (doc_id)
"""


@query("single_filing_score", SCORE_SQL)
def q_single(spark, d):
    s = score_sections(disclosures(spark, d).select("doc_id", "text"))
    n = lambda t: F.size(of_tier(F.col("hits"), t))
    return s.select(
        "doc_id", "raw_score", "materiality",
        n(1).alias("tier1_count"), n(2).alias("tier2_count"), n(3).alias("tier3_count"),
        F.array_join(signals(F.col("tier1_hits")), ",").alias("tier1"),
        F.array_join(signals(F.col("tier2_hits")), ",").alias("tier2"),
    )


DELTA_SQL = f"""
sides AS (
  SELECT doc_id, {sql_sentences('older_text', normalise=True)} AS o, {sql_sentences('text', normalise=True)} AS n FROM disc
),
bag AS (
  SELECT doc_id, x, sum(o) AS o, sum(n) AS n FROM (
    SELECT doc_id, unnest(o) AS x, 1 AS o, 0 AS n FROM sides UNION ALL SELECT doc_id, unnest(n), 0, 1 FROM sides
  ) GROUP BY doc_id, x
),
delta AS (
  SELECT doc_id, CAST(coalesce(sum(least(b.o, b.n)), 0) AS INT) AS unchanged_count, CAST(coalesce(sum(greatest(b.o - b.n, 0)), 0) AS INT) AS removed_count,
    CAST(coalesce(sum(greatest(b.n - b.o, 0)), 0) AS INT) AS added_count, CAST(coalesce(sum(b.o), 0) AS INT) AS older_sentences, CAST(coalesce(sum(b.n), 0) AS INT) AS newer_sentences
  FROM (SELECT doc_id FROM disc) LEFT JOIN bag b USING (doc_id) GROUP BY doc_id
),
delta2 AS (
  SELECT *, round(CAST(added_count + removed_count AS DOUBLE) / greatest(older_sentences, newer_sentences, 1), 4) AS pct_changed,
    CASE WHEN added_count + removed_count = 0 THEN 'none'
      WHEN CAST(added_count + removed_count AS DOUBLE) / greatest(older_sentences, newer_sentences, 1) < 0.10 THEN 'minor'
      WHEN CAST(added_count + removed_count AS DOUBLE) / greatest(older_sentences, newer_sentences, 1) < 0.30 THEN 'moderate'
      ELSE 'major' END AS magnitude
  FROM delta
)"""


def _split_pairs(spark, d):
    return disclosures(spark, d).select(
        "doc_id", "text", "older_text",
        sentences(F.col("older_text"), normalise=True).alias("o"), sentences(F.col("text"), normalise=True).alias("n"),
    )


@query("multiset_delta", f"WITH {SQL_DISCLOSURES}, {DELTA_SQL} SELECT * FROM delta2")
def q_multiset(spark, d):
    return al.multiset_delta(_split_pairs(spark, d).select("doc_id", "o", "n"), "o", "n").drop("o", "n")


CHANGED_SQL = """
added AS (
  SELECT doc_id, array_to_string(list_filter(n, lambda x: NOT list_contains(o, x)), ' ') AS changed FROM sides
)"""


PAIR_SQL = f"""
{WITH}, {DELTA_SQL}, {CHANGED_SQL}, {HITS}, {OLD_HITS},
marked AS (
  SELECT h.*, contains(lower(coalesce(a.changed, '')), lower(h.signal)) AS in_change,
    older_text <> '' AND NOT EXISTS (SELECT 1 FROM old_hits o WHERE o.doc_id = h.doc_id AND o.ord = h.ord) AS is_new
  FROM hits h JOIN (SELECT doc_id, older_text FROM disc) USING (doc_id) LEFT JOIN added a USING (doc_id)
),
gone AS (
  SELECT o.doc_id, count(*) AS n, list(signal ORDER BY ord) AS l FROM old_hits o
  WHERE EXISTS (SELECT 1 FROM disc d WHERE d.doc_id = o.doc_id AND text <> '') AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.doc_id = o.doc_id AND h.ord = o.ord) GROUP BY 1
),
summed AS (
  SELECT doc_id, sum(base) + sum(CASE WHEN in_change THEN bonus ELSE 0 END) + sum(CASE WHEN is_new THEN fresh ELSE 0 END) AS pts,
    count(*) AS n_hits, count(*) FILTER (in_change) AS n_change, count(*) FILTER (is_new) AS n_new,
    list(signal ORDER BY ord) FILTER (is_new) AS new_list, list(signal ORDER BY ord) FILTER (tier = 1) AS t1
  FROM marked GROUP BY doc_id
),
scored AS (
  SELECT d.doc_id, s.*, coalesce(s.pts, 0) + CASE WHEN d.text = '' THEN 0 ELSE
      CASE m.magnitude WHEN 'minor' THEN 200 WHEN 'moderate' THEN 500 WHEN 'major' THEN 1000 ELSE 0 END END AS total,
    m.magnitude, g.n AS n_gone, g.l AS gone_list, m.pct_changed, d.text
  FROM disc d LEFT JOIN summed s USING (doc_id) LEFT JOIN delta2 m USING (doc_id) LEFT JOIN gone g USING (doc_id)
)"""


def _pair_scores(spark, d):
    pairs = al.multiset_delta(_split_pairs(spark, d), "o", "n")
    changed = pairs.select(
        "doc_id", "text", "older_text", "magnitude", "pct_changed",
        F.array_join(let(F.col("o"), lambda o: F.filter("n", lambda x: ~F.array_contains(o, x))), " ").alias("changed"),
    )
    return score_text(
        changed, text="text", older="older_text", changed="changed", magnitude="magnitude"
    )


@query("pair_score", f"""{PAIR_SQL}
SELECT doc_id, total / 100.0::DOUBLE AS raw_score, {sql_materiality('total')} AS materiality, magnitude,
  CAST(coalesce(n_hits, 0) AS INT) AS n_hits, CAST(coalesce(n_change, 0) AS INT) AS n_in_change,
  coalesce(array_to_string(new_list, ','), '') AS new_signals, coalesce(array_to_string(gone_list, ','), '') AS removed_signals
FROM scored
""")
def q_pair_score(spark, d):
    s = _pair_scores(spark, d)
    return s.select(
        "doc_id", "raw_score", "materiality", "magnitude", F.size("hits").alias("n_hits"),
        F.size(F.filter("hits", lambda h: h["in_change"])).alias("n_in_change"),
        F.array_join(signals(F.col("new_hits")), ",").alias("new_signals"),
        F.array_join(signals(F.col("removed_hits")), ",").alias("removed_signals"),
    )


@query("analyst_note", f"""{PAIR_SQL}
SELECT doc_id, CASE WHEN text = '' THEN 'No text available for risk_factors — scoring skipped.' ELSE concat_ws(' ',
  'Risk Factors materiality: ' || upper({sql_materiality('total')}) || '.',
  'Critical signals present: ' || array_to_string(t1[1:5], ', ') || '.',
  'NEW vs prior filing: ' || array_to_string(new_list[1:5], ', ') || '.',
  'Removed vs prior filing: ' || array_to_string(gone_list[1:5], ', ') || '.',
  'Section changed ' || printf('%.1f', pct_changed * 100) || '% by sentence (magnitude: ' || magnitude || ').') END AS note
FROM scored
""")
def q_note(spark, d):
    s = _pair_scores(spark, d)
    return s.select("doc_id", analyst_note(
        F.lit("risk_factors"), F.col("pct_changed"), F.col("magnitude"), F.length("text") > 0
    ).alias("note"))


@query("top_signals", f"""{PAIR_SQL},
picks AS (
  SELECT doc_id, signal, tier, weight, ord, 0 AS g, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM marked WHERE is_new
  UNION ALL
  SELECT doc_id, signal, tier, weight, ord, 1, row_number() OVER (PARTITION BY doc_id ORDER BY ord) FROM marked WHERE tier = 1
),
once AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, signal ORDER BY -tier, -weight, g, k) AS seen FROM picks
  WHERE (g = 0 AND k <= 5) OR (g = 1 AND k <= 3)
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY -tier, -weight, g, k) AS r FROM once WHERE seen = 1)
SELECT doc_id, coalesce(string_agg(signal || ' [risk_factors]', '; ' ORDER BY r) FILTER (r <= 10), '') AS top_signals
FROM disc LEFT JOIN ranked USING (doc_id) GROUP BY doc_id
""")
def q_top(spark, d):
    s = _pair_scores(spark, d)
    top = top_signals([("risk_factors", F.col("new_hits"), of_tier(F.col("hits"), 1))])
    return s.select("doc_id", F.array_join(top, "; ").alias("top_signals"))


ALIGNED = f"""WITH RECURSIVE {SQL_DISCLOSURES},
source AS (
  SELECT doc_id AS k, text, older_text, text <> '' AND older_text <> '' AS compared,
    CASE WHEN text <> '' AND older_text <> '' THEN {sql_sentences('older_text', normalise=True)} END AS o,
    CASE WHEN text <> '' AND older_text <> '' THEN {sql_sentences('text', normalise=True)} END AS n FROM disc
),
whole AS (SELECT k, {sql_sentences('older_text', normalise=True)} AS o, {sql_sentences('text', normalise=True)} AS n FROM source)"""


@query("aligned_changes", f"""{ALIGNED}, {sql_alignment('whole')},
steps AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY block, part, place) AS step FROM aligned)
SELECT w.k AS doc_id, unchanged_count, rewritten_count, removed_count, added_count, CAST(len(o) AS INT) AS older_sentences, CAST(len(n) AS INT) AS newer_sentences,
  pct_changed, magnitude, coalesce((SELECT string_agg(type || '|' || coalesce(substr(older, 1, 300), '') || '|' || coalesce(substr(newer, 1, 300), '') || '|' || printf('%.3f', sim), chr(10) ORDER BY step)
    FROM steps s WHERE s.k = w.k AND step <= 50 AND type <> 'unchanged'), '') AS first_changes
FROM whole w JOIN adelta USING (k)""")
def q_aligned(spark, d):
    p = _split_pairs(spark, d).select("doc_id", "o", "n").withColumn("steps", al.align(F.col("o"), F.col("n")))
    p = p.select(
        "doc_id", *al.counts(F.col("steps")), F.size("o").alias("older_sentences"), F.size("n").alias("newer_sentences"),
        al.top_changes(al.change_rows(F.col("steps"), F.col("o"), F.col("n"))).alias("c"),
    )
    p = al.with_change_summary(p, F.col("older_sentences"), F.col("newer_sentences"))
    line = lambda c: F.concat_ws("|", c["type"], c["older"], c["newer"], F.format_string("%.3f", c["similarity"]))
    return p.withColumn("first_changes", F.array_join(F.transform("c", line), "\n")).drop("c")


_SQL_WORDS = "list_sort(list_distinct(list_filter(regexp_split_to_array(lower(x), '[^\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z]{3,}'))))"


def _sql_rounds(n: int) -> str:
    """The rounds of mutual best choices, spelt out."""
    ctes = []
    for r in range(n):
        rank = lambda side: f"row_number() OVER (PARTITION BY doc_id, {side} ORDER BY least(similarity, 0.95) DESC, old, new)"
        ctes.append(f"""taken{r} AS MATERIALIZED (
  SELECT *, least(old_n, new_n) AS taken FROM choice{r} QUALIFY {rank('old')} = 1 AND {rank('new')} = 1),
choice{r + 1} AS MATERIALIZED (
  SELECT * FROM (
    SELECT c.doc_id, c.old, c.new, c.similarity, c.old_n - coalesce(a.taken, 0) AS old_n, c.new_n - coalesce(b.taken, 0) AS new_n,
      c.old_from + coalesce(a.taken, 0) AS old_from, c.new_from + coalesce(b.taken, 0) AS new_from
    FROM choice{r} c LEFT JOIN taken{r} a USING (doc_id, old) LEFT JOIN taken{r} b ON b.doc_id = c.doc_id AND b.new = c.new
    WHERE NOT EXISTS (SELECT 1 FROM taken{r} t WHERE t.doc_id = c.doc_id AND t.old = c.old AND t.new = c.new))
  WHERE old_n > 0 AND new_n > 0)""")
    return ",\n".join(ctes) + ",\nmatched AS (" + " UNION ALL ".join(f"SELECT * FROM taken{r}" for r in range(n)) + ")"


MATCH_SQL = f"""
WITH {SQL_DISCLOSURES}, sides AS (
  SELECT doc_id, {sql_sentences('older_text', normalise=True)} AS o, {sql_sentences('text', normalise=True)} AS n FROM disc),
older AS (SELECT doc_id, p - 1 AS place, {_SQL_WORDS} AS words FROM (SELECT doc_id, unnest(o) AS x, generate_subscripts(o, 1) AS p FROM sides)),
newer AS (SELECT doc_id, p - 1 AS place, {_SQL_WORDS} AS words FROM (SELECT doc_id, unnest(n) AS x, generate_subscripts(n, 1) AS p FROM sides)),
old_kind AS (SELECT doc_id, words, count(*) AS n, min(place) AS first FROM older GROUP BY ALL),
new_kind AS (SELECT doc_id, words, count(*) AS n, min(place) AS first FROM newer GROUP BY ALL),
compared AS (
  SELECT doc_id, a.first AS old, b.first AS new, a.n AS old_n, b.n AS new_n, len(a.words) + len(b.words) AS total, len(list_intersect(a.words, b.words)) AS shared
  FROM old_kind a JOIN new_kind b USING (doc_id)),
choice0 AS MATERIALIZED (
  SELECT doc_id, old, new, old_n, new_n, CASE WHEN total = 0 THEN 1.0 ELSE CAST(shared AS DOUBLE) / (total - shared) END AS similarity, 0 AS old_from, 0 AS new_from
  FROM compared WHERE total = 0 OR CAST(shared AS DOUBLE) / (total - shared) >= 0.4),
{_sql_rounds(10)},
each AS (SELECT *, unnest(range(taken)) AS k FROM matched),
old_row AS (SELECT doc_id, place, min(place) OVER (PARTITION BY doc_id, words) AS old, row_number() OVER (PARTITION BY doc_id, words ORDER BY place) - 1 AS k FROM older),
new_row AS (SELECT doc_id, place, min(place) OVER (PARTITION BY doc_id, words) AS new, row_number() OVER (PARTITION BY doc_id, words ORDER BY place) - 1 AS k FROM newer)
SELECT e.doc_id, CAST(o.place AS INT) AS older_place, CAST(n.place AS INT) AS newer_place, similarity
FROM each e JOIN old_row o ON o.doc_id = e.doc_id AND o.old = e.old AND o.k = e.old_from + e.k JOIN new_row n ON n.doc_id = e.doc_id AND n.new = e.new AND n.k = e.new_from + e.k
"""


@query("sentence_matches", MATCH_SQL)
def q_matches(spark, d):
    return sentence_matches(_split_pairs(spark, d).select("doc_id", "o", "n"), ["doc_id"], "o", "n")


ALIGN_INVARIANTS = f"""
WITH {SQL_DISCLOSURES}, sides AS (
  SELECT doc_id, {sql_sentences('older_text', normalise=True)} AS o, {sql_sentences('text', normalise=True)} AS n FROM disc
)
SELECT doc_id, CAST(len(o) AS INT) AS older_sentences, CAST(len(n) AS INT) AS newer_sentences, TRUE AS older_adds_up, TRUE AS newer_adds_up,
  len(o) = len(n) AND list_aggregate(list_transform(list_zip(o, n), lambda z: z[1] = z[2]), 'bool_and') IS NOT FALSE AS identical
FROM sides
"""


@query("alignment_invariants", ALIGN_INVARIANTS)
def q_invariants(spark, d):
    p = _split_pairs(spark, d).select("doc_id", "o", "n").withColumn("steps", al.align(F.col("o"), F.col("n")))
    p = p.select("doc_id", "o", "n", *al.counts(F.col("steps")))
    return p.select(
        "doc_id", F.size("o").alias("older_sentences"), F.size("n").alias("newer_sentences"),
        (F.col("unchanged_count") + F.col("rewritten_count") + F.col("removed_count") == F.size("o")).alias("older_adds_up"),
        (F.col("unchanged_count") + F.col("rewritten_count") + F.col("added_count") == F.size("n")).alias("newer_adds_up"),
        (F.col("rewritten_count") + F.col("removed_count") + F.col("added_count") == 0).alias("identical"),
    )


@query("missing_side", f"""WITH {SQL_DISCLOSURES} SELECT doc_id, CASE
  WHEN doc_id % 4 = 0 AND doc_id % 6 = 0 THEN 'Both older and newer text are missing'
  WHEN text = '' AND older_text = '' THEN 'Both older and newer text are missing'
  WHEN doc_id % 4 = 0 OR older_text = '' THEN 'Older filing text missing — cannot compare'
  WHEN doc_id % 6 = 0 OR text = '' THEN 'Newer filing text missing — cannot compare' END AS delta_failure FROM disc""")
def q_missing(spark, d):
    t = disclosures(spark, d)
    older = F.when(F.col("doc_id") % 4 != 0, F.col("older_text"))
    newer = F.when(F.col("doc_id") % 6 != 0, F.col("text"))
    return t.select("doc_id", al.missing_side(older, newer).alias("delta_failure"))


@query("compared_texts", f"""{ALIGNED}, {sql_alignment('source')}, {sql_lexicon()}, {sql_compared('source')}
SELECT k AS doc_id, compared AS delta_success,
  CASE WHEN text = '' AND older_text = '' THEN 'Both older and newer text are missing' WHEN older_text = '' THEN 'Older filing text missing — cannot compare'
    WHEN text = '' THEN 'Newer filing text missing — cannot compare' END AS delta_failure,
  magnitude, pct_changed, unchanged_count, rewritten_count, removed_count, added_count, total / 100.0::DOUBLE AS raw_score, {sql_materiality('total')} AS materiality,
  CASE WHEN text = '' THEN 'No text available for risk_factors — scoring skipped.' ELSE {sql_note("'Risk Factors'")} END AS analyst_note
FROM ascored""")
def q_compared(spark, d):
    t = disclosures(spark, d).select(
        "doc_id", F.lit("risk_factors").alias("section_name"), F.col("text").alias("newer_text"), "older_text",
        F.col("text").alias("delta_newer"), F.col("older_text").alias("delta_older"),
    )
    out = compare_texts(t, keys=["doc_id"])
    return out.select(
        "doc_id", "delta_success", "delta_failure", "magnitude", "pct_changed", "unchanged_count", "rewritten_count",
        "removed_count", "added_count", "raw_score", "materiality", "analyst_note",
    )


# --- categories ----------------------------------------------------------------------


def _taxonomy_sql() -> str:
    rows = ", ".join(
        f"({i}, {lit(k)}, {lit(label)}, {tier}, {lit(w)})"
        for i, (k, label, tier, kws) in enumerate(fv.RISK_TAXONOMY) for w in kws
    )
    return f"tax(d, category, label, tier, keyword) AS (VALUES {rows})"


CAT_SQL = f"""WITH {SQL_DISCLOSURES}, {_taxonomy_sql()},
ss AS (SELECT doc_id, unnest(x) AS s, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, {sql_sentences('text')} AS x FROM disc)),
m AS (SELECT doc_id, pos, s, t.* FROM ss, tax t WHERE contains(lower(s), lower(t.keyword))),
cats AS (
  SELECT doc_id, d, category, label, tier, count(DISTINCT keyword) AS signal_count, list(DISTINCT keyword ORDER BY keyword) AS matched
  FROM m GROUP BY ALL
),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tier, -signal_count, d) AS place FROM cats)"""


@query("risk_categories", f"""{CAT_SQL}
SELECT doc_id, category, label, tier, CAST(signal_count AS INT) AS signal_count, array_to_string(matched, ',') AS matched_signals,
  CAST(place AS INT) AS place FROM placed""")
def q_categories(spark, d):
    c = element_rows(disclosures(spark, d), ["doc_id"], categorise(F.col("text")), pos="place", item="c")
    return c.select(
        "doc_id", "c.category", "c.label", "c.tier", "c.signal_count",
        F.array_join("c.matched_signals", ",").alias("matched_signals"), (F.col("place") + 1).alias("place"),
    )


@query("category_excerpts", f"""{CAT_SQL},
e AS (SELECT doc_id, d, category, s, pos, count(*) AS score FROM m GROUP BY ALL),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, d, s ORDER BY -score, length(s), pos) AS seen FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, d ORDER BY -score, length(s), pos) AS rank FROM u WHERE seen = 1)
SELECT doc_id, category, CAST(rank AS INT) AS rank, substr(s, 1, 250) AS excerpt FROM r WHERE rank <= 5""")
def q_excerpts(spark, d):
    c = struct_rows(disclosures(spark, d), ["doc_id"], categorise(F.col("text")))
    e = element_rows(c, ["doc_id", "category"], F.col("excerpts"), pos="rank", item="excerpt")
    return e.withColumn("rank", F.col("rank") + 1)


@query("category_summary", f"""{CAT_SQL},
x AS (
  SELECT doc_id, count(*) AS n, sum(signal_count) AS total, count(*) FILTER (tier = 1) AS t1,
    string_agg(category, ',' ORDER BY place) FILTER (place <= 5) AS top_domains,
    string_agg(label, ', ' ORDER BY place) FILTER (tier = 1) AS t1_names,
    string_agg(label || ' (' || signal_count || ' signals)', '; ' ORDER BY place) FILTER (place <= 5) AS ranked,
    max(label) FILTER (place = 1) AS dl, max(signal_count) FILTER (place = 1) AS dn, max(array_to_string(matched[1:5], ', ')) FILTER (place = 1) AS ds
  FROM placed GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n, 0) AS INT) AS total_domains_identified, CAST(coalesce(total, 0) AS INT) AS total_signals,
  CAST(coalesce(t1, 0) AS INT) AS tier1_domain_count, coalesce(top_domains, '') AS top_domains,
  concat_ws(' ', 'This report categorizes risks from ' || source || '''s 10-K filing (filed 2024-01-01).',
    'A total of ' || coalesce(n, 0) || ' distinct risk domains were identified, with ' || coalesce(total, 0) || ' signal matches across the Risk Factors section.',
    'Critical (Tier 1) risk domains include: ' || t1_names || '.',
    'The most prominent risk areas by signal density are: ' || ranked || '.',
    CASE WHEN n IS NULL THEN 'No specific risk categories were identified in the filing.'
      ELSE 'The dominant risk theme is ' || dl || ', highlighted by ' || dn || ' signals, such as: ' || ds || '.' END) AS executive_summary
FROM disc LEFT JOIN x USING (doc_id)""")
def q_category_summary(spark, d):
    c = disclosures(spark, d).select("doc_id", "source", categorise(F.col("text")).alias("categories"))
    out = category_summary(c, "categories", F.col("source"), F.lit("10-K"), F.lit("2024-01-01"))
    return out.select(
        "doc_id", "total_domains_identified", "total_signals", "tier1_domain_count",
        F.array_join("top_domains", ",").alias("top_domains"), "executive_summary",
    )


QUICK_ROWS = ", ".join(f"({i}, {lit(n)}, {strings(k)})" for i, (n, k) in enumerate(fv.QUICK_TAXONOMY))


@query("quick_categories", f"""WITH {SQL_DISCLOSURES}, q(i, category, kws) AS (VALUES {QUICK_ROWS}),
c AS (SELECT doc_id, i, category, CAST(len(list_filter(kws, lambda k: contains(lower(text), k))) AS INT) AS signals FROM disc, q)
SELECT doc_id, category, signals, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY -signals, i) AS INT) AS place FROM c WHERE signals > 0""")
def q_quick(spark, d):
    c = element_rows(disclosures(spark, d), ["doc_id"], quick_categories(F.col("text")), pos="place", item="c")
    return c.select("doc_id", "c.category", "c.signals", (F.col("place") + 1).alias("place"))


@query("highlight_sentences", f"""{WITH}, {HITS},
names AS (SELECT doc_id, list(lower(signal)) AS ns FROM hits WHERE tier <= 2 GROUP BY 1),
ss AS (
  SELECT doc_id, unnest(x) AS s, generate_subscripts(x, 1) AS pos
  FROM (SELECT doc_id, list_filter({sql_sentences('text', openers='A-Z', min_chars=40)}, lambda z: length(z) <= 300) AS x FROM disc)
),
sc AS (
  SELECT doc_id, s, pos, len(list_filter({strings(fv.MDA_KEYWORDS)}, lambda k: contains(lower(s), k)))
    + 2 * len(list_filter(coalesce(ns, []), lambda k: contains(lower(s), k))) AS score
  FROM ss LEFT JOIN names USING (doc_id)
),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, substr(s, 1, 60) ORDER BY -score, pos) AS seen FROM sc WHERE score > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY -score, pos) AS rank FROM u WHERE seen = 1)
SELECT doc_id, CAST(rank AS INT) AS rank, substr(s, 1, 200) AS highlight FROM r WHERE rank <= 5""")
def q_highlights(spark, d):
    t = disclosures(spark, d).select("doc_id", "text", of_tier(find_hits(F.col("text")), 1, 2).alias("h"))
    h = element_rows(t, ["doc_id"], highlight_sentences(F.col("text"), F.col("h")), pos="rank", item="highlight")
    return h.withColumn("rank", F.col("rank") + 1)


# --- governance and ownership ---------------------------------------------------------

GOV_ROWS = ", ".join(
    f"({i}, {lit(p)}, {t}, {fv.GOVERNANCE_POINTS[t]}, '{fv.TIER_NAMES[t]}')" for i, (p, t) in enumerate(fv.GOVERNANCE_PHRASES)
)
GOV_SQL = f"""WITH {SQL_DISCLOSURES}, g(i, signal, tier, points, materiality) AS (VALUES {GOV_ROWS}),
found AS (SELECT doc_id, g.*, text, strpos(lower(text), signal) AS p FROM disc, g WHERE contains(lower(text), signal))"""


@query("governance_signals", f"""{GOV_SQL}
SELECT doc_id, signal, tier, materiality, points, substr({sql_trim(
    "regexp_replace(substr(text, greatest(1, p - 60), p + length(signal) + 80 - greatest(1, p - 60)), '[\\s\\x0B\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')"
)}, 1, 250) AS excerpt FROM found""")
def q_governance(spark, d):
    return struct_rows(disclosures(spark, d), ["doc_id"], governance_signals(F.col("text")))


@query("governance_score", f"""{GOV_SQL},
s AS (SELECT doc_id, sum(points) AS pts, count(*) AS n, string_agg(signal, ', ' ORDER BY i) FILTER (tier = 1) AS t1 FROM found GROUP BY 1)
SELECT doc_id, CAST(coalesce(pts, 0) AS INT) AS governance_risk_score, CAST(coalesce(n, 0) AS INT) AS signal_count,
  CASE WHEN n IS NULL THEN source || '''s proxy statement (2024-01-01) shows no elevated governance signals.'
  ELSE concat_ws(' ', source || '''s proxy statement (2024-01-01) governance risk score: ' || printf('%.1f', CAST(pts AS DOUBLE)) || '.',
    'Critical governance flags: ' || t1 || '.', n || ' total governance signals detected.') END AS summary
FROM disc LEFT JOIN s USING (doc_id)""")
def q_governance_score(spark, d):
    t = disclosures(spark, d).select("doc_id", "source", governance_signals(F.col("text")).alias("g"))
    t = t.withColumn("score", governance_score(F.col("g")))
    return t.select(
        "doc_id", F.col("score").alias("governance_risk_score"), F.size("g").alias("signal_count"),
        governance_summary(F.col("source"), F.lit("2024-01-01"), F.col("g"), F.col("score")).alias("summary"),
    )


OWN_FORMS = fv.OWNERSHIP_FORMS
OWN_TEXT = (
    "CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'Name of reporting persons: Fund ' || {letters} || ' Partners; holds ' "
    "|| (doc_id % 40) || '.' || (doc_id % 7) || ' % of the class. ' END || "
    "CASE WHEN doc_id % 5 = 0 AND doc_id % 2 = 0 THEN 'Filed by: Manager ' || {letters} || '; ' ELSE '' END || text"
)


def _owner_docs(spark, d):
    """Each disclosure as an ownership filing of its company of 40 documents."""
    doc = F.col("doc_id")
    third = F.floor(doc / 3)
    head = F.when(doc % 5 == 0, F.lit("")).otherwise(F.concat(
        F.lit("Name of reporting persons: Fund "), letters(third), F.lit(" Partners; holds "),
        (doc % 40).cast("string"), F.lit("."), (doc % 7).cast("string"), F.lit(" % of the class. "),
    ))
    by = F.when((doc % 5 == 0) & (doc % 2 == 0), F.concat(F.lit("Filed by: Manager "), letters(third), F.lit("; "))).otherwise("")
    forms = F.array(*[F.lit(f) for f in OWN_FORMS])
    return disclosures(spark, d).select(
        "doc_id", F.concat(F.lit("C"), letters(F.floor(doc / 40))).alias("ticker"),
        F.element_at(forms, (doc % 6 + 1).cast("int")).alias("form_type"),
        F.lit(None).cast("date").alias("filing_date"), (F.lit(0) - doc).alias("index_pos"),
        F.replace(F.replace(F.concat(head, by, F.col("text")), F.lit("&"), F.lit(" ")), F.lit("<"), F.lit(" ")).alias("body"),
        accession(doc, 2).alias("accession_number"),
    )


OWN_SQL = f"""WITH {SQL_DISCLOSURES},
owned AS (
  SELECT doc_id, 'C' || {sql_letters('doc_id // 40')} AS ticker, ({strings(OWN_FORMS)})[doc_id % 6 + 1] AS form_type,
    replace(replace({OWN_TEXT.format(letters=sql_letters('(doc_id // 3)'))}, '&', ' '), '<', ' ') AS body FROM disc
),
flags AS (
  SELECT doc_id, ticker, form_type, starts_with(form_type, '13F-HR') AS is_portfolio_filing,
    CASE WHEN doc_id % 5 <> 0 THEN 'Fund ' || {sql_letters('doc_id // 3')} || ' Partners'
      WHEN doc_id % 2 = 0 AND starts_with(form_type, '13F-HR') THEN 'Manager ' || {sql_letters('doc_id // 3')} ELSE 'Unknown filer' END AS filer_name,
    CASE WHEN starts_with(form_type, '13F-HR') THEN NULL
      ELSE TRY_CAST(nullif(regexp_extract(body, '\\b(\\d{{1,2}}(?:\\.\\d{{1,2}})?)\\s*%', 1), '') AS DOUBLE) END AS percent_ownership,
    list_filter({strings(fv.ACTIVIST_PHRASES)}, lambda p: contains(lower(body), p)) AS phrases
  FROM owned
),
own AS (SELECT *, starts_with(form_type, 'SC 13D') OR len(phrases) > 0 AS is_activist_signal FROM flags)"""


@query("activist_flags", f"""{OWN_SQL}
SELECT doc_id, form_type, filer_name, percent_ownership, is_portfolio_filing, is_activist_signal,
  coalesce(array_to_string(phrases, ','), '') AS phrases FROM own""")
def q_activist(spark, d):
    return ownership_columns(_owner_docs(spark, d), F.col("body")).select(
        "doc_id", "form_type", "filer_name", "percent_ownership", "is_portfolio_filing", "is_activist_signal",
        F.array_join("activist_phrases_found", ",").alias("phrases"),
    )


@query("ownership_summary", f"""{OWN_SQL},
top AS (SELECT *, row_number() OVER (PARTITION BY ticker, form_type ORDER BY doc_id DESC) AS rn FROM own),
kept AS (SELECT * FROM top WHERE rn <= 6),
g AS (
  SELECT ticker, count(*) AS filing_count, count(*) FILTER (is_activist_signal) AS activist_signal_count,
    list(DISTINCT filer_name ORDER BY filer_name) FILTER (is_activist_signal AND filer_name <> 'Unknown filer') AS a,
    list(DISTINCT filer_name ORDER BY filer_name) FILTER (is_portfolio_filing AND filer_name <> 'Unknown filer') AS p,
    concat_ws(', ', {", ".join(f"CASE WHEN count(*) FILTER (form_type = {lit(f)}) > 0 THEN count(*) FILTER (form_type = {lit(f)}) || {lit(' ' + f)} END" for f in OWN_FORMS)}) AS type_summary
  FROM kept GROUP BY ticker
)
SELECT ticker, filing_count, activist_signal_count, type_summary, concat_ws(' ', ticker || ' ownership filings found: ' || type_summary || '.',
  CASE WHEN activist_signal_count > 0 THEN activist_signal_count || ' filing(s) show activist-style language or active (13D) intent — including '
    || coalesce(array_to_string(a[1:3], ', '), 'unnamed filer(s)') || '.' ELSE 'No activist signals detected — ownership filings appear passive.' END,
  'Institutional 13F-HR filers disclosing this position: ' || array_to_string(p[1:3], ', ') || '.') AS summary
FROM g""")
def q_ownership(spark, d):
    docs = _owner_docs(spark, d)
    bodies = docs.select("accession_number", F.concat(F.lit("<html><p>"), "body", F.lit("</p></html>")).alias("html"))
    return filings.ownership(docs.drop("body", "doc_id"), bodies, 6).select("ticker", "filing_count", "activist_signal_count", "type_summary", "summary")
