"""Queries over landed JSON, documents and stored results. The JSON is written
by Spark from ``customer`` and ``orders``, a bounded number of rows to a page."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from filegrain.functions import fixed_values as fv
from filegrain.functions.routing import normal_ticker, valid_ticker
from filegrain.operators import facts as facts_ops
from filegrain.operators.recency import newest
from filegrain.session import shared_folder
from filegrain.sources import landed, results
from filegrain.sources.store import ResultStore

from . import query, table
from .corpus import letters, lit, sql_letters, strings

KINDS = ("10-K", "10-Q", "8-K", "4", "S-1")
PRIORITY_FORM = {"1-URGENT": "10-K", "2-HIGH": "10-Q", "3-MEDIUM": "8-K", "4-NOT SPECIFIED": "4", "5-LOW": "S-1"}


def _case(column, mapping):
    out = None
    for k, v in mapping.items():
        out = F.when(F.col(column) == k, F.lit(v)) if out is None else out.when(F.col(column) == k, F.lit(v))
    return out


def _sql_case(column, mapping):
    return f"CASE {column} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items()) + " END"


# --- companies -----------------------------------------------------------------------


def _company_texts(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    entry = F.struct(F.col("c_custkey").alias("cik_str"), F.concat(F.lit("C"), letters(F.col("c_custkey"))).alias("ticker"))
    pages = c.groupBy(F.floor(F.col("c_custkey") / 200)).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("c_custkey").cast("string"), entry))).alias("m")
    )
    return pages.select(F.to_json("m").alias("json"))


@query("cik_lookup", f"""WITH r AS (SELECT event_id, lower('C' || {sql_letters('user_id * 11')}) || ' ' AS ticker FROM events)
SELECT event_id, ticker, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik FROM r
LEFT JOIN customer ON upper(trim(ticker)) = 'C' || {sql_letters('c_custkey')}""")
def q_cik(spark, d):
    requests = table(spark, d, "events").select("event_id", F.concat(F.lower(F.concat(F.lit("C"), letters(F.col("user_id") * 11))), F.lit(" ")).alias("ticker"))
    return landed.resolve_cik(requests, landed.companies(_company_texts(spark, d))).select("event_id", "ticker", "cik")


@query("ticker_check", r"""SELECT c_custkey, upper(trim(t)) AS ticker, regexp_full_match(replace(replace(upper(trim(t)), '-', ''), '.', ''), '\p{L}+') AS valid
FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN ' brk.b ' WHEN c_custkey % 3 = 1 THEN lower(c_mktsegment) ELSE c_name END AS t FROM customer)""")
def q_ticker(spark, d):
    t = F.when(F.col("c_custkey") % 3 == 0, F.lit(" brk.b ")).when(F.col("c_custkey") % 3 == 1, F.lower("c_mktsegment")).otherwise(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", normal_ticker(t).alias("ticker"), valid_ticker(t).alias("valid"))


# --- submissions ----------------------------------------------------------------------


NO_DATE = "2024-13-45"


def _submission_pages(spark, d):
    """Pages of at most 2000 consecutive order keys per customer; every fourth
    page lacks its report dates, and some rows hold a date that is none."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    acc = landed.dashed(F.lpad(F.col("o_orderkey").cast("string"), 18, "0"))
    day = F.when(F.col("o_orderkey") % 97 == 5, F.lit(NO_DATE)).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    row = F.struct(
        (F.lit(0) - F.col("o_orderkey")).alias("k"), _case("o_orderpriority", PRIORITY_FORM).alias("form"), acc.alias("acc"),
        day.alias("day"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".htm")).alias("doc"),
    )
    # newest keys first: page numbers fall with the key
    pages = o.groupBy("o_custkey", (F.lit(1000000) - F.floor(F.col("o_orderkey") / 2000)).alias("page")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    col = lambda f: F.transform("r", lambda x: x[f])
    dates = F.when(F.col("page") % 4 == 0, F.array().cast("array<string>")).otherwise(col("day"))
    return pages.select(
        F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"), "page",
        F.to_json(F.struct(
            col("form").alias("form"), col("acc").alias("accessionNumber"), col("day").alias("filingDate"),
            dates.alias("reportDate"), col("doc").alias("primaryDocument"),
        )).alias("json"),
    )


SUB_SQL = f"""sub AS (
  SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, CAST(1000000 - o_orderkey // 2000 AS BIGINT) AS page, o_orderkey,
    {_sql_case('o_orderpriority', PRIORITY_FORM)} AS form_type, lpad(CAST(o_orderkey AS VARCHAR), 18, '0') AS accession_number,
    CASE WHEN o_orderkey % 97 <> 5 THEN CAST(o_orderdate AS DATE) END AS filing_date,
    CASE WHEN (1000000 - o_orderkey // 2000) % 4 <> 0 AND o_orderkey % 97 <> 5 THEN CAST(o_orderdate AS DATE) END AS report_date,
    CASE WHEN o_orderkey % 97 = 5 THEN 'filingDate {NO_DATE} is not a date'
      || CASE WHEN (1000000 - o_orderkey // 2000) % 4 <> 0 THEN '; reportDate {NO_DATE} is not a date' ELSE '' END END AS date_note,
    o_orderkey || '.htm' AS primary_document FROM orders
)"""


@query("submissions_rows", f"WITH {SUB_SQL} SELECT * EXCLUDE (o_orderkey), CAST(row_number() OVER (PARTITION BY cik, page ORDER BY o_orderkey DESC) - 1 AS INT) AS pos FROM sub")
def q_submissions(spark, d):
    return landed.submission_rows(_submission_pages(spark, d))


@query("filing_index", f"""WITH {SUB_SQL},
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY cik, form_type ORDER BY o_orderkey DESC) AS INT) AS rn FROM sub WHERE form_type IN {tuple(fv.ALLOWED_FORMS)})
SELECT cik, form_type, accession_number, filing_date, rn FROM r WHERE rn <= 3""")
def q_index(spark, d):
    index = landed.filing_index(landed.submission_rows(_submission_pages(spark, d)))
    # listed order alone decides, as in the source pages
    return newest(index, 3, keys=("cik", "form_type"), order=[F.col("index_pos").asc()]).select("cik", "form_type", "accession_number", "filing_date", "rn")


@query("accession_format", "SELECT o_orderkey, substr(a, 1, 10) || '-' || substr(a, 11, 2) || '-' || substr(a, 13) AS dashed FROM (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 18, '0') AS a FROM orders)")
def q_dashed(spark, d):
    a = F.lpad(F.col("o_orderkey").cast("string"), 18, "0")
    return table(spark, d, "orders").select("o_orderkey", landed.dashed(a).alias("dashed"))


# --- facts -------------------------------------------------------------------------------

TAGS = [tag for _, tags in fv.FACT_TAGS for tag in tags] + ["Goodwill"]


def facts_texts(spark, d):
    """Company facts as JSON: orders as reported values, the tag from the key,
    at most 4000 consecutive keys to a page. Some values are missing."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    tag = F.element_at(F.array(*[F.lit(t) for t in TAGS]), (F.col("o_orderkey") % len(TAGS) + 1).cast("int"))
    value = F.struct(
        F.date_format(F.date_trunc("quarter", "o_orderdate"), "yyyy-MM-dd").alias("end"),
        F.when(F.col("o_orderkey") % 13 != 0, F.floor("o_totalprice").cast("double")).alias("val"),
    )
    per_tag = o.groupBy("o_custkey", F.floor(F.col("o_orderkey") / 4000).alias("page"), tag.alias("tag")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), value.alias("v")))), lambda x: x["v"]).alias("v")
    )
    pages = per_tag.groupBy("o_custkey", "page").agg(
        F.map_from_entries(F.collect_list(F.struct("tag", F.struct(F.create_map(F.lit("USD"), "v").alias("units"))))).alias("m")
    )
    return pages.select(
        F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"), "page",
        F.to_json(F.struct(F.create_map(F.lit("us-gaap"), "m").alias("facts")), {"ignoreNullFields": "false"}).alias("json"),
    )


FACT_SQL = f"""f AS (
  SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, o_orderkey AS k, ({strings(TAGS)})[o_orderkey % {len(TAGS)} + 1] AS tag,
    strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS "end", CASE WHEN o_orderkey % 13 <> 0 THEN CAST(floor(o_totalprice) AS DOUBLE) END AS val FROM orders
),
latest AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY cik, tag ORDER BY "end" DESC, k) = 1)"""


def _facts(spark, d):
    # position over all pages of a company keeps "first listed" well defined
    return landed.company_facts(facts_texts(spark, d)).withColumn("pos", F.col("page") * 1000000 + F.col("pos"))


@query("company_facts", f'WITH {FACT_SQL} SELECT cik, tag, "end", val, count(*) AS n FROM f GROUP BY ALL')
def q_facts(spark, d):
    return _facts(spark, d).groupBy("cik", "tag", "end", "val").agg(F.count(F.lit(1)).alias("n"))


@query("latest_fact", f'WITH {FACT_SQL} SELECT cik, tag, "end", val FROM latest')
def q_latest_fact(spark, d):
    return facts_ops.latest_per_tag(_facts(spark, d)).select("cik", "tag", "end", "val")


def _metric_sql(tags, c):
    v = [f"max({c}) FILTER (tag = '{t}' AND val IS NOT NULL)" for t in tags]
    return v[0] if len(v) == 1 else f"coalesce({', '.join(v)})"


CONTEXT_SQL = f"""WITH {FACT_SQL},
w AS (
  SELECT cik, {", ".join(f'{_metric_sql(tags, "val")} AS {m}, {_metric_sql(tags, chr(34) + "end" + chr(34))} AS e_{m}' for m, tags in fv.FACT_TAGS)}
  FROM latest WHERE tag <> 'Goodwill' GROUP BY cik
),
ctx AS (
  SELECT *, coalesce({", ".join(f"e_{m}" for m, _ in fv.FACT_TAGS)}) AS period_end,
    CASE WHEN current_liabilities <> 0 THEN round(current_assets / current_liabilities, 3) END AS current_ratio,
    concat_ws(',', {", ".join(f"CASE WHEN {m} IS NULL THEN '{m}' END" for m, _ in fv.FACT_TAGS)}) AS missing_metrics FROM w
)"""


@query("financial_context", f"""{CONTEXT_SQL} SELECT cik, {", ".join(m for m, _ in fv.FACT_TAGS)}, period_end, current_ratio, missing_metrics FROM ctx""")
def q_context(spark, d):
    return facts_ops.financial_context(_facts(spark, d)).withColumn("missing_metrics", F.array_join("missing_metrics", ","))


@query("fact_notes", f"""{CONTEXT_SQL}
SELECT cik, CASE WHEN current_ratio IS NULL THEN 'Current ratio unavailable — liquidity risk cannot be quantitatively validated.'
  WHEN current_ratio < 1.0 THEN 'Current ratio ' || printf('%.2f', current_ratio) || ' is below 1.0 — liabilities exceed liquid assets, elevating liquidity/going-concern risk.'
  WHEN current_ratio < 1.5 THEN 'Current ratio ' || printf('%.2f', current_ratio) || ' is tight — limited liquidity buffer.'
  ELSE 'Current ratio ' || printf('%.2f', current_ratio) || ' indicates adequate short-term liquidity.' END AS liquidity,
  CASE WHEN capex IS NULL OR revenue IS NULL OR revenue = 0 THEN 'CapEx-to-revenue ratio unavailable.'
  WHEN capex / revenue * 100 > 15 THEN 'CapEx is ' || printf('%.1f', capex / revenue * 100) || '% of revenue — heavy infrastructure/strategic investment, consistent with AI/capacity buildout risk language.'
  ELSE 'CapEx is ' || printf('%.1f', capex / revenue * 100) || '% of revenue — within typical range.' END AS capex_note FROM ctx""")
def q_fact_notes(spark, d):
    c = facts_ops.financial_context(_facts(spark, d))
    return c.select("cik", facts_ops.liquidity_note(F.col("current_ratio")).alias("liquidity"), facts_ops.capex_note(F.col("capex"), F.col("revenue")).alias("capex_note"))


@query("facts_status", """SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, c_custkey % 5 <> 0 AS fetch_success,
  CASE WHEN c_custkey % 5 = 0 THEN 'No us-gaap facts found for this CIK (may be a foreign filer or holding co).' END AS failure_reason FROM customer""")
def q_status(spark, d):
    texts = table(spark, d, "customer").select(
        F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("cik"),
        F.when(F.col("c_custkey") % 5 == 0, F.lit('{"facts": {"ifrs": {}}}')).otherwise(F.concat(
            F.lit('{"facts": {"us-gaap": {"Revenues": {"units": {"USD": [{"end": "2024-01-01", "val": '), F.col("c_acctbal").cast("string"), F.lit("}]}}}}}"))).alias("json"),
    )
    return landed.facts_status(texts)


# --- documents of a filing ------------------------------------------------------------------


def _filing_docs(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey")
    n = F.col("l_linenumber")
    href = (
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("/Archives/a"), n, F.lit("-index.htm")))
        .when(F.col("l_partkey") % 4 == 0, F.concat(F.lit("/ix?doc=/Archives%2Fedgar/"), F.col("l_partkey"), F.lit(".htm")))
        .when(F.col("l_partkey") % 4 == 1, F.concat(F.lit("doc"), n, F.lit(".htm")))
        .when(F.col("l_partkey") % 4 == 2, F.concat(F.lit("form"), n, F.lit(".XML"))).otherwise(F.concat(F.lit("https://x.example/"), n, F.lit(".txt")))
    )
    kind = F.when(F.col("l_partkey") % 7 == 0, "10-K").when(F.col("l_partkey") % 7 == 1, "EX-99").otherwise("GRAPHIC")
    return li.select(
        F.lpad((F.col("l_orderkey") % 1000).cast("string"), 10, "0").alias("cik"), F.lpad(F.col("l_orderkey").cast("string"), 18, "0").alias("accession_number"),
        (n * F.lit(10**10) + F.col("l_partkey")).alias("seq"), href.alias("href"), kind.alias("doc_type"),
    )


DOC_SQL = """docs AS (
  SELECT lpad(CAST(l_orderkey % 1000 AS VARCHAR), 10, '0') AS cik, lpad(CAST(l_orderkey AS VARCHAR), 18, '0') AS accession_number, l_linenumber * 10000000000 + l_partkey AS seq,
    CASE WHEN l_returnflag = 'A' THEN '/Archives/a' || l_linenumber || '-index.htm' WHEN l_partkey % 4 = 0 THEN '/ix?doc=/Archives%2Fedgar/' || l_partkey || '.htm'
      WHEN l_partkey % 4 = 1 THEN 'doc' || l_linenumber || '.htm' WHEN l_partkey % 4 = 2 THEN 'form' || l_linenumber || '.XML' ELSE 'https://x.example/' || l_linenumber || '.txt' END AS href,
    CASE WHEN l_partkey % 7 = 0 THEN '10-K' WHEN l_partkey % 7 = 1 THEN 'EX-99' ELSE 'GRAPHIC' END AS doc_type FROM lineitem
)"""
URL_SQL = """CASE WHEN starts_with(href, '/ix?doc=') THEN 'https://www.sec.gov' || replace(substr(href, 9), '%2F', '/')
  WHEN starts_with(href, 'http') THEN href WHEN starts_with(href, '/') THEN 'https://www.sec.gov' || href
  ELSE 'https://www.sec.gov/Archives/edgar/data/' || CAST(cik AS BIGINT) || '/' || accession_number || '/' || href END"""


@query("primary_document", f"""WITH {DOC_SQL},
ranked AS (SELECT *, CASE WHEN doc_type = '10-K' THEN 0 WHEN (ends_with(href, '.htm') OR ends_with(href, '.html')) AND NOT contains(lower(href), 'index') THEN 1 END AS r FROM docs),
best AS (SELECT cik, accession_number, arg_min(href, r * 1000000000000 + seq) FILTER (r IS NOT NULL) AS href FROM ranked GROUP BY ALL)
SELECT cik, accession_number, href, {URL_SQL} AS document_url, CASE WHEN href IS NULL THEN 'No primary document found in index of ' ||
  substr(accession_number, 1, 10) || '-' || substr(accession_number, 11, 2) || '-' || substr(accession_number, 13) END AS failure_reason FROM best""")
def q_primary(spark, d):
    return landed.primary_documents(_filing_docs(spark, d))


@query("form4_document", f"""WITH {DOC_SQL},
p AS (SELECT accession_number, arg_min(href, seq) FILTER (ends_with(lower(href), '.xml')) AS x,
  arg_min(href, seq) FILTER (regexp_matches(lower(href), '\\.html?$') AND NOT contains(lower(href), 'index')) AS h FROM docs GROUP BY 1),
i AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 18, '0') AS accession_number, CASE o_orderkey % 3 WHEN 0 THEN 'xsl/doc.xml' WHEN 1 THEN 'main.htm' ELSE '' END AS primary_document FROM orders)
SELECT accession_number, CASE WHEN ends_with(primary_document, '.xml') THEN primary_document ELSE x END AS xml_document,
  CASE WHEN primary_document = 'main.htm' THEN primary_document ELSE h END AS page_document,
  CASE WHEN ends_with(primary_document, '.xml') THEN 'fetched via primaryDocument=' || primary_document
    WHEN x IS NOT NULL AND primary_document <> '' THEN 'fetched via index fallback (primaryDocument was non-XML: ' || primary_document || ')'
    WHEN x IS NOT NULL THEN 'fetched via index scan (no primaryDocument field)' ELSE 'no .xml file found via primaryDocument or index scan' END AS source_note
FROM i LEFT JOIN p USING (accession_number)""")
def q_form4_doc(spark, d):
    k = F.col("o_orderkey")
    index = table(spark, d, "orders").select(
        F.lpad(k.cast("string"), 18, "0").alias("accession_number"),
        F.when(k % 3 == 0, "xsl/doc.xml").when(k % 3 == 1, "main.htm").otherwise("").alias("primary_document"),
    )
    return landed.form4_documents(index, _filing_docs(spark, d)).drop("primary_document")


@query("viewer_url", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://www.sec.gov/' || regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) ELSE url END AS document_url FROM pages")
def q_viewer(spark, d):
    path = F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1)
    wrapped = F.concat(F.lit("https://www.sec.gov/ix?doc="), F.url_encode(F.concat(F.lit("/"), path)), F.lit("&x=1"))
    return table(spark, d, "pages").select("page_id", landed.unwrapped_url(F.when(F.col("page_id") % 2 == 0, wrapped).otherwise(F.col("url"))).alias("document_url"))


# --- stored results -----------------------------------------------------------------------------


def _results(spark, d):
    e = table(spark, d, "events")
    key = results.result_key(F.col("event_type"), F.concat(F.lit("u"), F.col("user_id").cast("string")), F.lit("10-K"), F.when(F.col("event_id") % 2 == 0, "x").otherwise(""))
    return e.select(
        key.alias("result_key"), F.col("event_id").alias("result_id"), F.col("ts").alias("written_at"),
        (F.col("event_id") % 10).cast("int").alias("ttl"), (F.col("event_type") != "error").alias("success"), "value",
    )


NOW = "2024-01-20 00:00:00"
STORE_SQL = f"""res AS (
  SELECT event_type || ':U' || user_id || ':10-K' || CASE WHEN event_id % 2 = 0 THEN ':x' ELSE '' END AS result_key, event_id AS result_id, ts AS written_at, value,
    ts + to_days(CAST(greatest(3, least(event_id % 10, 7)) AS INTEGER)) AS expires_at FROM events WHERE event_type <> 'error'
),
live AS (SELECT * FROM res WHERE expires_at > TIMESTAMP '{NOW}' AND written_at <= TIMESTAMP '{NOW}'
  QUALIFY row_number() OVER (PARTITION BY result_key ORDER BY written_at DESC, result_id DESC) = 1)"""


def _live(spark, d):
    return results.unexpired(results.storable(_results(spark, d)), F.lit(NOW).cast("timestamp_ntz"))


@query("unexpired_results", f"WITH {STORE_SQL} SELECT result_key, result_id, value FROM live")
def q_unexpired(spark, d):
    return _live(spark, d).select("result_key", "result_id", "value")


@query("requests_without_result", f"WITH {STORE_SQL} SELECT event_id, k AS result_key FROM (SELECT event_id, event_type || ':U' || user_id || ':10-K' AS k FROM events) WHERE k NOT IN (SELECT result_key FROM live)")
def q_without(spark, d):
    r = table(spark, d, "events").select("event_id", results.result_key(
        F.col("event_type"), F.concat(F.lit("u"), F.col("user_id").cast("string")), F.lit("10-K")).alias("result_key"))
    return results.without_stored(r, _live(spark, d)).select("event_id", "result_key")


@query("result_json", "SELECT event_id, user_id, event_type, value, CASE WHEN event_id % 3 <> 0 THEN props END AS note FROM events")
def q_json(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.when(F.col("event_id") % 3 != 0, F.col("props")).alias("note"))
    packed = results.as_json(e, ["user_id", "event_type", "value", "note"])
    return results.from_json(packed, "user_id bigint, event_type string, value double, note string")


STORED_SQL = """
SELECT k AS result_key, event_id AS result_id, value FROM (
  SELECT *, 'U' || user_id || ':' || event_id % 3 AS k FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts DESC, event_id DESC) = 1)
WHERE event_type <> 'error' AND ts + to_days(CAST(3 + user_id % 5 AS INTEGER)) > (SELECT max(ts) FROM events)"""


@query("stored_results", STORED_SQL)
def q_stored(spark, d):
    """Results put, overwritten, deleted and expired over four batches that bring versions in no order, with a batch that is
    tried again and two compactions in between."""
    events = table(spark, d, "events")
    store = ResultStore(spark, f"{shared_folder(spark)}/filegrain-store-{uuid.uuid4().hex}", "result_key string", "value double", buckets=8)
    ts = F.to_timestamp(F.col("ts").cast("string"))
    gone = F.col("event_type") == "error"
    rows = events.select(
        F.concat(F.lit("U"), F.col("user_id"), F.lit(":"), F.col("event_id") % 3).alias("result_key"), F.when(~gone, F.col("value").cast("double")).alias("value"),
        ts.alias("written_at"), F.col("event_id").alias("result_id"),
        F.when(~gone, ts + F.make_dt_interval(days=(3 + F.col("user_id") % 5).cast("int"))).alias("expires_at"), gone.alias("deleted"),
        F.pmod(F.xxhash64("event_id"), F.lit(4)).alias("part"),
    )
    now = F.lit(rows.agg(F.max("written_at")).first()[0])
    for batch in (0, 1, 1, 2, 0, 3):
        store.apply(rows.where(F.col("part") == batch).drop("part"), batch)
        if batch in (1, 2):
            store.compact(now, F.expr("interval 60 days"))
    return store.read(now).select("result_key", "result_id", "value")
