"""A disclosure corpus derived from ``documents``, in Spark and in SQL.

Every document becomes the newer of two filings of one company. Its sentences are
numbered, so that none occurs twice in it. A third of them take in a phrase of the lexicons (chosen from the sentence's length
and place), the older filing drops every seventh sentence and words others
differently. Some newer filings begin with a sentence that names every phrase of tier 2. Bodies are laid out in five ways, so that each way of finding a
section occurs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filegrain.functions import fixed_values as fv
from filegrain.functions.text import WS, WS_CHARS, let, sentences, string_array
from filegrain.session import shared_folder
from filegrain.sources.landed import land_bodies

from . import table

PHRASES = [
    *fv.TIER1_SIGNALS, *fv.TIER2_SIGNALS, *fv.TIER3_SIGNALS,
    *[kw for _, _, _, kws in fv.RISK_TAXONOMY for kw in kws],
    *[p for p, _ in fv.GOVERNANCE_PHRASES], *fv.ACTIVIST_PHRASES,
]
RISK_LINE = "We could face material risk."
MDA_LINE = "Operating results and revenue increased compared with the prior year."
#: More phrases of one tier than any list shows.
LISTING = "We have seen " + ", ".join(fv.TIER2_SIGNALS) + "."
COPIES = 9
FORMS = ("10-K", "10-Q", "20-F")
# per form: risk id and heading, heading behind it, discussion id and heading, heading behind it
HEADS = {
    "10-K": ("item1a", "Item 1A. Risk Factors", "Item 1B. Unresolved Comments", "item7", "Item 7. Management's Discussion", "Item 8. Financial Statements"),
    "10-Q": ("item1a", "Item 1A. Risk Factors", "Item 1B. Unresolved Comments", "item2", "Item 2. Management's Discussion", "Item 3. Quantitative Disclosures"),
    "20-F": ("item3.d", "Item 3.D. Risk Factors", "Item 4. Information on the Company", "item5", "Item 5. Operating and Financial Review", "Item 6. Directors"),
}


# --- Spark ---------------------------------------------------------------------


def letters(number: Column) -> Column:
    return F.translate(number.cast("string"), "0123456789", "ABCDEFGHIJ")


def _worded(s: Column, i: Column, shift: Column) -> Column:
    pool = string_array(PHRASES)
    pick = ((F.length(s) * 31 + (i + shift) * 17) % len(PHRASES)) + 1
    return F.when(
        F.length(s) % 3 == 0,
        F.concat(F.substring(s, F.lit(1), F.length(s) - 1), F.lit(" amid "), F.element_at(pool, pick), F.lit(".")),
    ).otherwise(s)


def numbered(s: Column, i: Column) -> Column:
    """A sentence that no other one of its document equals: its number before the last sign."""
    return F.concat(F.substring(s, F.lit(1), F.length(s) - 1), F.lit(" ref"), letters(i), F.substring(s, F.length(s), F.lit(1)))


def disclosures(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """doc_id, lang, source, sents, older_sents, text, older_text. ``docs``: other rows, as of a stream."""
    docs = (table(spark, sf_dir, "documents") if docs is None else docs).select("doc_id", "lang", "source", "text")
    split = docs.select("doc_id", "lang", "source", F.transform(sentences(F.col("text")), numbered).alias("_s"))
    now = F.transform("_s", lambda s, i: _worded(s, i, F.lit(0)))
    then = F.filter(
        F.transform("_s", lambda s, i: F.when(i % 7 != 3, _worded(s, i, F.when(i % 5 == 1, 9).otherwise(0)))),
        lambda s: s.isNotNull(),
    )
    listing = F.when(F.col("doc_id") % 25 == 7, F.array(F.lit(LISTING))).otherwise(F.array().cast("array<string>"))
    return split.select("doc_id", "lang", "source", F.concat(listing, now).alias("sents"), then.alias("older_sents")).select(
        "*", F.array_join("sents", " ").alias("text"), F.array_join("older_sents", " ").alias("older_text")
    )


def company(doc: Column) -> Column:
    return F.floor(doc / 6)


def form_of(doc: Column) -> Column:
    return F.element_at(F.array(*[F.lit(f) for f in FORMS]), (company(doc) % 3 + 1).cast("int"))


def _escaped(s: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(raw), F.lit(entity))
    return s


def _paragraph(*parts: Column) -> Column:
    return F.concat(F.lit("<p>"), *parts, F.lit("</p>\n"))


def _paragraphs(body: Column, line: str) -> Column:
    return F.concat(F.lit(f"<p>{line}</p>"), F.array_join(body, ""))


def _page(layout: Column, risk: Column, mda: Column, heads: tuple[str, ...]) -> Column:
    rid, rh, mh, did, dh, eh = heads
    none = "<p>None.</p>"
    bold = lambda t: F.lit(f'<div style="font-weight:bold">{t}</div>')
    h2 = lambda t: F.lit(f"<h2>{t}</h2>")
    div = lambda t: F.lit(f'<div style="font-weight: 700">{t}</div>')
    par = lambda t: F.lit(f"<p>{t}</p>")
    anchors = F.concat(
        F.lit(f'<div id="{rid}">'), bold(rh), risk, F.lit("</div><div>"), bold(mh), F.lit(none + f'</div><div id="{did}">'),
        bold(dh), mda, F.lit("</div><div>"), bold(eh), F.lit(none + "</div>"),
    )
    plain = lambda h: F.concat(h(rh), risk, h(mh), F.lit(none), h(dh), mda, h(eh), F.lit(none))
    toc = F.concat(
        F.lit(f'<p><a href="#s1">{rh}</a></p><p><a href="#s2">{dh}</a></p><a name="s1"></a>'), risk,
        F.lit(f'<h3>{mh}</h3>{none}<a name="s2"></a>'), mda, F.lit(f"<h3>{eh}</h3>{none}"),
    )
    body = (
        F.when(layout == 0, anchors).when(layout == 1, plain(h2)).when(layout == 2, plain(div))
        .when(layout == 3, toc).otherwise(plain(par))
    )
    return F.concat(
        F.lit('<html><head><style>p{margin:0}</style><script>var t="</p>";</script></head><body>'), body, F.lit("</body></html>")
    )


def filing_html(doc: Column, layout: Column, paragraphs: Column) -> Column:
    """``paragraphs``: a column of its own, it is named more than once."""
    half = F.floor(F.size(paragraphs) / 2).cast("int")
    risk = _paragraphs(F.slice(paragraphs, F.lit(1), half), RISK_LINE)
    mda = _paragraphs(F.slice(paragraphs, half + 1, F.size(paragraphs)), MDA_LINE)
    out = None
    for f in FORMS:
        page = _page(layout, risk, mda, HEADS[f])
        out = F.when(form_of(doc) == f, page) if out is None else out.when(form_of(doc) == f, page)
    return out


def accession(doc: Column, side: int) -> Column:
    return F.lpad((doc * 10 + side).cast("string"), 18, "0")


def pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two filings per document: side 2 newer, side 1 older."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    rows = docs.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("side"))
    doc, side = F.col("doc_id"), F.col("side")
    return rows.select(
        F.concat(F.lit("D"), letters(doc)).alias("ticker"), F.lpad(doc.cast("string"), 10, "0").alias("cik"),
        form_of(doc).alias("form_type"), F.lpad((doc * 10 + side).cast("string"), 18, "0").alias("accession_number"),
        F.date_add(F.lit("2020-01-01").cast("date"), (doc % 300 + side * 365).cast("int")).alias("filing_date"),
        (F.lit(0) - side).alias("index_pos"),
    )


def longer(sents: Column) -> Column:
    """Paragraphs of the sentences COPIES times over, each time with another mark before the last sign, so that the sections
    of a filing pass any minimum. A sentence is cut and escaped once, not for each copy."""
    parts = F.transform(sents, lambda s: F.struct(
        _escaped(F.substring(s, F.lit(1), F.length(s) - 1)).alias("head"), _escaped(F.substring(s, F.length(s), F.lit(1))).alias("last"),
    ))
    marked = lambda p, c: F.transform(p, lambda x: _paragraph(x["head"], F.concat(F.lit(" copy"), letters(F.lit(c))), x["last"]))
    return let(parts, lambda p: F.flatten(F.array(*[marked(p, c) for c in range(COPIES)])))


_LANDED: dict[tuple[str, str, str], str] = {}


def in_buckets(spark: SparkSession, sf_dir: str, name: str, make, lay_out) -> DataFrame:
    """Bodies as a user's analyses find them: landed once, in buckets by accession number, and read by all of them.
    The table is made by the first query of an application that needs it. Sentences move to the buckets and are laid out there."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _LANDED:
        table_name = f"{name}_{uuid.uuid4().hex}"
        buckets, path = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{shared_folder(spark)}/{table_name}"
        land_bodies(make(spark, sf_dir), table_name, buckets, path, finish=lay_out)
        _LANDED[key] = table_name
    return spark.table(_LANDED[key])


def pair_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_buckets(spark, sf_dir, "pair_bodies", make_pair_bodies, lay_out_pairs)


def series_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_buckets(spark, sf_dir, "series_bodies", make_series_bodies, lay_out_series)


def make_pair_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of both filings of every document."""
    sides = F.array(
        F.struct(F.lit(1).alias("side"), F.col("older_sents").alias("s")), F.struct(F.lit(2).alias("side"), F.col("sents").alias("s")),
    )
    rows = disclosures(spark, sf_dir).select("doc_id", F.inline(sides))
    return rows.select(F.lpad((F.col("doc_id") * 10 + F.col("side")).cast("string"), 18, "0").alias("accession_number"), "doc_id", "side", "s")


def lay_out_pairs(rows: DataFrame) -> DataFrame:
    doc = F.col("doc_id")
    once = F.transform("s", lambda s: _paragraph(_escaped(s)))
    rows = rows.withColumn("p", F.when(doc % 6 != 0, longer(F.col("s"))).otherwise(once))
    return rows.select("accession_number", filing_html(doc, (doc + F.col("side")) % 5, F.col("p")).alias("html"))


def series_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One filing per document, six to a company."""
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("T"), letters(company(doc))).alias("ticker"), F.lpad(company(doc).cast("string"), 10, "0").alias("cik"),
        form_of(doc).alias("form_type"), accession(doc, 2).alias("accession_number"),
        F.date_add(F.lit("2015-01-01").cast("date"), (doc % 6 * 91).cast("int")).alias("filing_date"),
        (F.lit(0) - doc).alias("index_pos"),
    )


def make_series_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosures(spark, sf_dir).select(accession(F.col("doc_id"), 2).alias("accession_number"), "doc_id", F.col("sents").alias("s"))


def lay_out_series(rows: DataFrame) -> DataFrame:
    doc = F.col("doc_id")
    rows = rows.withColumn("p", F.transform("s", lambda s: _paragraph(_escaped(s))))
    return rows.select("accession_number", filing_html(doc, doc % 5, F.col("p")).alias("html"))


# --- SQL -----------------------------------------------------------------------


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strings(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def sql_trim(x: str) -> str:
    return f"trim({x}, {lit(WS_CHARS)})"


def sql_sentences(text: str, *, normalise: bool = False, openers: str = "A-Z\"'(", min_chars: int = 20) -> str:
    if normalise:
        text = f"regexp_replace(regexp_replace({text}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g')"
    cut = f"regexp_replace({text}, {lit(f'([.!?]){WS}+([{openers}])')}, '\\1' || chr(1) || '\\2', 'g')"
    return (
        f"list_filter(list_transform(string_split({cut}, chr(1)), lambda z: {sql_trim('z')}), "
        f"lambda z: length(z) >= {min_chars})"
    )


def _sql_worded(shift: str) -> str:
    n = len(PHRASES)
    return (
        f"CASE WHEN length(x) % 3 = 0 THEN substr(x, 1, length(x) - 1) || ' amid ' || "
        f"({strings(PHRASES)})[(length(x) * 31 + (i - 1 + {shift}) * 17) % {n} + 1] || '.' ELSE x END"
    )


SQL_DISCLOSURES = f"""
base AS (
  SELECT doc_id, lang, source, list_transform({sql_sentences('text')}, lambda x, i:
    substr(x, 1, length(x) - 1) || ' ref' || translate(CAST(i - 1 AS VARCHAR), '0123456789', 'ABCDEFGHIJ') || substr(x, length(x), 1)) AS s FROM documents
),
edited AS (
  SELECT doc_id, lang, source,
    list_concat(CASE WHEN doc_id % 25 = 7 THEN [{lit(LISTING)}] ELSE [] END, list_transform(s, lambda x, i: {_sql_worded('0')})) AS sents,
    list_filter(list_transform(s, lambda x, i: CASE WHEN (i - 1) % 7 <> 3 THEN
      {_sql_worded('CASE WHEN (i - 1) % 5 = 1 THEN 9 ELSE 0 END')} END), lambda x: x IS NOT NULL) AS older_sents
  FROM base
),
disc AS (
  SELECT *, coalesce(array_to_string(sents, ' '), '') AS text,
    coalesce(array_to_string(older_sents, ' '), '') AS older_text FROM edited
)"""


def sql_letters(x: str) -> str:
    return f"translate(CAST({x} AS VARCHAR), '0123456789', 'ABCDEFGHIJ')"


def _by_form(pos: int) -> str:
    cases = " ".join(f"WHEN {lit(f)} THEN {lit(HEADS[f][pos])}" for f in FORMS)
    return f"CASE form_type {cases} END"


def sql_sections(source: str, layout: str, sents: str, acc: str, form: str = "((doc_id // 6) % 3)") -> str:
    """CTEs ``laid`` … ``sec``: the sections a reader of the bodies must find,
    worked out from the sentences and the layout alone."""
    nl = "chr(10)"
    return f"""
laid AS (
  SELECT *, {acc} AS accession_number, ({layout}) AS layout, ({strings(FORMS)})[{form} + 1] AS form_type,
    len({sents}) // 2 AS half, {sents} AS ss FROM {source}
),
parts AS (
  SELECT *, {_by_form(1)} AS rh, {_by_form(2)} AS mh, {_by_form(4)} AS dh, {_by_form(5)} AS eh,
    array_to_string(list_prepend({lit(RISK_LINE)}, ss[1:half]), {nl}) AS rb,
    array_to_string(list_prepend({lit(MDA_LINE)}, ss[half + 1:]), {nl}) AS db
  FROM laid
),
whole AS (
  SELECT *, CASE WHEN layout = 3
      THEN rh || {nl} || dh || {nl} || rb || {nl} || mh || {nl} || 'None.' || {nl} || db || {nl} || eh || {nl} || 'None.'
      ELSE rh || {nl} || rb || {nl} || mh || {nl} || 'None.' || {nl} || dh || {nl} || db || {nl} || eh || {nl} || 'None.' END AS full_text,
    rh || {nl} || rb AS rhb, dh || {nl} || db AS dhb
  FROM parts
),
methods AS (
  SELECT *,
    CASE WHEN layout = 0 AND length(rhb) >= 500 THEN 'anchor_href'
         WHEN layout = 1 AND length(rb) >= 500 THEN 'heading_tag'
         WHEN layout IN (0, 2) AND length(rb) >= 200 THEN 'ixbrl_div'
         WHEN layout = 3 AND length(rb) >= 500 THEN 'toc_link'
         WHEN layout = 4 AND length(rhb) >= 1500 THEN 'pattern_match' ELSE 'raw_fallback' END AS rm,
    CASE WHEN layout = 0 AND length(dhb) >= 500 THEN 'anchor_href'
         WHEN layout = 1 AND length(db) >= 500 THEN 'heading_tag'
         WHEN layout IN (0, 2) AND length(db) >= 200 THEN 'ixbrl_div'
         WHEN layout = 3 AND length(db) >= 500 THEN 'toc_link'
         WHEN layout = 4 AND length(dhb) >= 4000 THEN 'pattern_match' ELSE 'raw_fallback' END AS dm
  FROM whole
),
sec AS (
  SELECT *,
    CASE WHEN rm = 'raw_fallback' THEN full_text WHEN rm IN ('anchor_href', 'pattern_match') THEN rhb ELSE rb END AS risk_text,
    CASE WHEN dm = 'raw_fallback' THEN full_text WHEN dm IN ('anchor_href', 'pattern_match') THEN dhb ELSE db END AS mda_text,
    rm <> 'raw_fallback' AS risk_ok, dm <> 'raw_fallback' AS mda_ok
  FROM methods
)"""


def sql_longer(sents: str) -> str:
    copies = ", ".join(
        f"list_transform({sents}, lambda x: substr(x, 1, length(x) - 1) || ' copy{'ABCDEFGHIJ'[c]}' || substr(x, length(x), 1))" for c in range(COPIES)
    )
    return f"CASE WHEN doc_id % 6 <> 0 THEN flatten([{copies}]) ELSE {sents} END"


def sql_lexicon() -> str:
    rows = []
    for tier, phrases in ((1, fv.TIER1_SIGNALS), (2, fv.TIER2_SIGNALS), (3, fv.TIER3_SIGNALS)):
        rows += [(p, tier) for p in phrases]
    body = ", ".join(
        f"({lit(p)}, {t}, {fv.SIGNAL_WEIGHT[t]}, {i}, {fv.BASE_HUNDREDTHS[t]}, {fv.IN_CHANGE_HUNDREDTHS[t]}, {fv.NEW_HUNDREDTHS[t]})"
        for i, (p, t) in enumerate(rows)
    )
    return f"lex(signal, tier, weight, ord, base, bonus, fresh) AS (VALUES {body})"


def sql_materiality(x: str) -> str:
    cases = " ".join(f"WHEN {x} >= {floor} THEN '{name}'" for name, floor in fv.MATERIALITY_FLOORS)
    return f"CASE {cases} ELSE 'low' END"


def sql_alignment(source: str) -> str:
    """CTEs ``osent`` … ``aligned``: how each pair of sentence lists (k, o, n) of ``source``
    aligns, given that no list holds a sentence twice and common ones keep their order.

    Common sentences are anchors; what lies between two anchors is a block, in which
    old sentences choose among the new ones in order."""
    same, near = fv.SAME_SIMILARITY, fv.REWRITE_SIMILARITY
    return f"""
osent AS (SELECT k, unnest(o) AS s, generate_subscripts(o, 1) AS i FROM {source}),
nsent AS (SELECT k, unnest(n) AS s, generate_subscripts(n, 1) AS j FROM {source}),
oblock AS (
  SELECT o.k, o.i, o.s, a.j AS mate, count(a.j) OVER (PARTITION BY o.k ORDER BY o.i) AS block
  FROM osent o LEFT JOIN nsent a ON a.k = o.k AND a.s = o.s),
nblock AS (
  SELECT n.k, n.j, n.s, a.i AS mate, count(a.i) OVER (PARTITION BY n.k ORDER BY n.j) AS block
  FROM nsent n LEFT JOIN osent a ON a.k = n.k AND a.s = n.s),
orest AS (
  SELECT k, block, i, s, list_distinct(list_filter(regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{3,}}'))) AS w, row_number() OVER (PARTITION BY k, block ORDER BY i) AS r
  FROM oblock WHERE mate IS NULL),
nrest AS (SELECT k, block, j, s, list_distinct(list_filter(regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{3,}}'))) AS w FROM nblock WHERE mate IS NULL),
alike AS (
  SELECT o.k, o.block, o.r, o.i, n.j, len(list_intersect(o.w, n.w)) AS shared, len(o.w) AS ow, len(n.w) AS nw
  FROM orest o JOIN nrest n ON n.k = o.k AND n.block = o.block),
choices AS (
  SELECT k, block, r, i, list({{'j': j, 'sim': CASE WHEN ow + nw - shared > 0 THEN CAST(shared AS DOUBLE) / (ow + nw - shared) ELSE 1.0 END}} ORDER BY j) AS c
  FROM alike GROUP BY ALL),
walk AS (
  SELECT k, block, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS j, CAST(NULL AS DOUBLE) AS sim
  FROM (SELECT DISTINCT k, block FROM choices)
  UNION ALL
  SELECT k, block, r, i, CASE WHEN pick.sim >= {near} THEN list_append(used, pick.j) ELSE used END,
    CASE WHEN pick.sim >= {near} THEN pick.j END, CASE WHEN pick.sim >= {near} THEN pick.sim END
  FROM (
    SELECT *, coalesce(list_filter(free, lambda x: x.sim >= {same})[1], list_filter(free, lambda x: x.sim = most)[1]) AS pick
    FROM (
      SELECT *, list_max(list_transform(free, lambda x: x.sim)) AS most
      FROM (
        SELECT c.k, c.block, c.r, c.i, w.used, list_filter(c.c, lambda x: NOT list_contains(w.used, x.j)) AS free
        FROM walk w JOIN choices c ON c.k = w.k AND c.block = w.block AND c.r = w.r + 1)))),
aligned AS (
  SELECT k, block - 1 AS block, 2 AS part, i AS place, 'unchanged' AS type, s AS older, s AS newer, 1.0 AS sim FROM oblock WHERE mate IS NOT NULL
  UNION ALL
  SELECT o.k, o.block, 0, o.i, CASE WHEN w.j IS NULL THEN 'removed' ELSE 'rewritten' END, o.s, n.s, coalesce(round_even(w.sim, 3), 0.0)
  FROM orest o LEFT JOIN walk w ON w.k = o.k AND w.i = o.i LEFT JOIN nsent n ON n.k = w.k AND n.j = w.j
  UNION ALL
  SELECT k, block, 1, j, 'added', NULL, s, 0.0 FROM nrest WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.k = nrest.k AND w.j = nrest.j)),
acounts AS (
  SELECT s.k, CAST(count(*) FILTER (type = 'unchanged') AS INT) AS unchanged_count, CAST(count(*) FILTER (type = 'rewritten') AS INT) AS rewritten_count,
    CAST(count(*) FILTER (type = 'removed') AS INT) AS removed_count, CAST(count(*) FILTER (type = 'added') AS INT) AS added_count,
    greatest(coalesce(any_value(len(o)), 0), coalesce(any_value(len(n)), 0), 1) AS longest
  FROM {source} s LEFT JOIN aligned a ON a.k = s.k GROUP BY s.k),
achanged AS (
  SELECT k, string_agg(newer, ' ') AS changed FROM aligned WHERE type IN ('rewritten', 'added') GROUP BY k),
adelta AS (
  SELECT *, round(CAST(rewritten_count + removed_count + added_count AS DOUBLE) / longest, 4) AS pct_changed,
    CASE WHEN rewritten_count + removed_count + added_count = 0 THEN 'none'
      {" ".join(f"WHEN CAST(rewritten_count + removed_count + added_count AS DOUBLE) / longest < {below} THEN '{name}'" for name, below in fv.CHANGE_BELOW)}
      ELSE 'major' END AS magnitude
  FROM acounts)"""


def sql_compared(source: str, lexicon: str = "lex") -> str:
    """CTEs ``ahits`` … ``ascored``: the scores of ``source`` (k, text, older_text, compared) by its alignment."""
    bonus = " ".join(f"WHEN '{name}' THEN {points}" for name, points in fv.MAGNITUDE_HUNDREDTHS.items())
    return f"""
ahits AS (SELECT k, l.*, older_text FROM {source}, {lexicon} l WHERE contains(lower(text), lower(signal))),
aolder AS (SELECT k, l.*, text FROM {source}, {lexicon} l WHERE contains(lower(older_text), lower(signal))),
amarked AS (
  SELECT h.*, contains(lower(coalesce(c.changed, '')), lower(h.signal)) AS in_change,
    coalesce(older_text, '') <> '' AND NOT EXISTS (SELECT 1 FROM aolder o WHERE o.k = h.k AND o.ord = h.ord) AS is_new
  FROM ahits h LEFT JOIN achanged c USING (k)),
agone AS (
  SELECT k, list(signal ORDER BY ord) AS gone_list FROM aolder o
  WHERE coalesce(text, '') <> '' AND NOT EXISTS (SELECT 1 FROM ahits h WHERE h.k = o.k AND h.ord = o.ord) GROUP BY 1),
asummed AS (
  SELECT k, sum(base) + sum(CASE WHEN in_change THEN bonus ELSE 0 END) + sum(CASE WHEN is_new THEN fresh ELSE 0 END) AS pts,
    list(signal ORDER BY ord) FILTER (is_new) AS new_list, list(signal ORDER BY ord) FILTER (tier = 1) AS t1
  FROM amarked GROUP BY k),
ascored AS (
  SELECT s.*, d.* EXCLUDE (k), new_list, gone_list, t1,
    coalesce(pts, 0) + CASE WHEN coalesce(s.text, '') = '' OR NOT compared THEN 0 ELSE CASE d.magnitude {bonus} ELSE 0 END END AS total
  FROM {source} s LEFT JOIN asummed USING (k) LEFT JOIN adelta d USING (k) LEFT JOIN agone USING (k))"""


def sql_note(section: str) -> str:
    """The analyst's note on a row of ``ascored``; ``section``: its name in words."""
    return f"""concat_ws(' ', {section} || ' materiality: ' || upper({sql_materiality('total')}) || '.',
  'Critical signals present: ' || array_to_string(t1[1:5], ', ') || '.',
  'NEW vs prior filing: ' || array_to_string(new_list[1:5], ', ') || '.',
  'Removed vs prior filing: ' || array_to_string(gone_list[1:5], ', ') || '.',
  CASE WHEN compared THEN 'Section changed ' || printf('%.1f', pct_changed * 100) || '% by sentence (magnitude: ' || magnitude || ').' END)"""
