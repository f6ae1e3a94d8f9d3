"""Landed JSON and documents as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.rows import element_rows
from ..operators.recency import with_bodies
from ..session import few_rows_a_batch

WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
HOST = "https://www.sec.gov"  # fixed value: public archive host

COMPANIES_JSON = "map<string,struct<cik_str:bigint,ticker:string>>"
SUBMISSION_ARRAYS = ("form", "accessionNumber", "filingDate", "reportDate", "primaryDocument")
SUBMISSIONS_JSON = "struct<" + ",".join(f"{c}:array<string>" for c in SUBMISSION_ARRAYS) + ">"
FACTS_JSON = "struct<facts:map<string,map<string,struct<units:map<string,array<struct<end:string,val:double>>>>>>>"


def read_json_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files, one row each, column ``json``."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("json"))


def companies(texts: DataFrame) -> DataFrame:
    """``json`` objects keyed by ordinal to ``(ticker, cik)``, ids padded."""
    entries = texts.select(F.explode_outer(F.from_json("json", COMPANIES_JSON)).alias("ordinal", "c"))
    return entries.where(F.col("c").isNotNull()).select(
        F.upper("c.ticker").alias("ticker"), padded_cik(F.col("c.cik_str")).alias("cik"),
    )


def padded_cik(cik: Column) -> Column:
    return F.lpad(cik.cast("string"), 10, "0")


def resolve_cik(requests: DataFrame, company_list: DataFrame) -> DataFrame:
    """Requests with the company id of their ticker, NULL when unknown."""
    return (
        requests.withColumn("_t", F.upper(F.trim("ticker")))
        .join(company_list.withColumnRenamed("ticker", "_t"), "_t", "left").drop("_t")
    )


def submission_rows(pages: DataFrame, json: str = "json") -> DataFrame:
    """Parallel arrays of a page to one row per filing. Short date arrays give
    empty strings; ``page`` and ``pos`` keep the listed order. A date that cannot
    be read is NULL, and ``date_note`` says so: one bad row does not end a job."""
    keep = [c for c in pages.columns if c != json]
    # a field may be missing altogether: without it nothing could be zipped
    a = F.from_json(json, SUBMISSIONS_JSON)
    parsed = pages.select(*keep, a.alias("a")).select(
        *keep, *[F.coalesce(F.col(f"a.{c}"), F.array().cast("array<string>")).alias(c) for c in SUBMISSION_ARRAYS]
    )
    filled = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(""))
    date = lambda c: F.nullif(filled(c), F.lit("")).try_cast("date")
    unread = lambda c: F.when((filled(c) != "") & date(c).isNull(), F.concat(F.lit(f"{c} "), filled(c), F.lit(" is not a date")))
    return (
        element_rows(parsed, keep, F.arrays_zip(*SUBMISSION_ARRAYS), pos="pos", item="r")
        .where(F.col("r.form").isNotNull())
        .select(
            *keep, "pos",
            F.col("r.form").alias("form_type"),
            F.replace(F.col("r.accessionNumber"), F.lit("-"), F.lit("")).alias("accession_number"),
            date("filingDate").alias("filing_date"),
            date("reportDate").alias("report_date"),
            filled("primaryDocument").alias("primary_document"),
            F.nullif(F.concat_ws("; ", *[unread(c) for c in ("filingDate", "reportDate")]), F.lit("")).alias("date_note"),
        )
    )


def filing_index(submissions: DataFrame, forms=fv.ALLOWED_FORMS) -> DataFrame:
    """Rows of the recent page and its overflow pages in listed order:
    ``index_pos`` grows with page, then position."""
    return submissions.where(F.col("form_type").isin(*forms)).withColumn(
        "index_pos", F.struct("page", "pos")
    )


def company_facts(texts: DataFrame, json: str = "json") -> DataFrame:
    """Reported us-gaap values in USD: ``(…, tag, pos, end, val)``."""
    keep = [c for c in texts.columns if c != json]
    parsed = texts.select(*keep, F.from_json(json, FACTS_JSON)["facts"]["us-gaap"].alias("f"))
    return (
        element_rows(
            parsed.select(*keep, F.explode_outer("f").alias("tag", "t")),
            [*keep, "tag"], F.col("t.units")["USD"], pos="pos", item="v",
        )
        .select(*keep, "tag", "pos", F.col("v.end").alias("end"), F.col("v.val").alias("val"))
    )


def facts_status(texts: DataFrame, json: str = "json") -> DataFrame:
    """Whether a company reports any us-gaap fact, with the reason if not."""
    keep = [c for c in texts.columns if c != json]
    facts = F.from_json(json, FACTS_JSON)["facts"]["us-gaap"]
    some = F.coalesce(F.size(facts) > 0, F.lit(False))
    return texts.select(*keep, some.alias("fetch_success"), F.when(~some, F.lit(
        "No us-gaap facts found for this CIK (may be a foreign filer or holding co)."
    )).alias("failure_reason"))


# --- documents of a filing ------------------------------------------------------


def dashed(accession: Column) -> Column:
    return F.concat_ws("-", F.substring(accession, 1, 10), F.substring(accession, 11, 2), F.substring(accession, 13, 1000))


def absolute_url(href: Column, cik: Column, accession: Column, host: str = HOST) -> Column:
    folder = F.concat(
        F.lit(f"{host}/Archives/edgar/data/"), F.coalesce(cik.try_cast("long").cast("string"), cik), F.lit("/"), accession, F.lit("/")
    )
    return (
        F.when(F.startswith(href, F.lit("http")), href)
        .when(F.startswith(href, F.lit("/")), F.concat(F.lit(host), href))
        .otherwise(F.concat(folder, href))
    )


def unwrapped_url(url: Column, host: str = HOST) -> Column:
    """The document behind a viewer link."""
    doc = F.try_url_decode(F.regexp_extract(url, r"[?&]doc=([^&#]*)", 1))
    doc = F.nullif(doc, F.lit(""))
    behind = F.when(F.startswith(doc, F.lit("/")), F.concat(F.lit(host), doc)).otherwise(doc)
    return F.when(F.contains(url, F.lit("/ix?doc=")), F.coalesce(behind, url)).otherwise(url)


def _html_name(href: Column) -> Column:
    return href.rlike(r"\.html?$") & ~F.contains(F.lower(href), F.lit("index"))


def primary_documents(docs: DataFrame, forms=fv.ALLOWED_FORMS) -> DataFrame:
    """``docs(cik, accession_number, seq, href, doc_type)`` to the main document
    of each filing: the first of an allowed type, else the first HTML page.
    One combining aggregation; no filing's list is gathered or sorted."""
    rank = F.when(F.col("doc_type").isin(*forms) & (F.length("href") > 0), 0).when(_html_name(F.col("href")), 1)
    best = F.min_by("href", F.when(rank.isNotNull(), F.struct(rank.alias("r"), F.col("seq"))))
    return docs.groupBy("cik", "accession_number").agg(best.alias("href")).withColumn(
        "document_url", unwrapped_url(absolute_url(F.col("href"), F.col("cik"), F.col("accession_number")))
    ).withColumn("failure_reason", F.when(F.col("href").isNull(), F.concat(
        F.lit("No primary document found in index of "), dashed(F.col("accession_number")))))


def form4_documents(index: DataFrame, docs: DataFrame) -> DataFrame:
    """Raw data file of each Form 4: its primary document when that is XML, else
    the first listed ``.xml``; else the page to read the table from."""
    xml = F.lower(F.col("href")).endswith(".xml")
    picks = docs.groupBy("accession_number").agg(
        F.min_by("href", F.when(xml, F.col("seq"))).alias("_xml"),
        F.min_by("href", F.when(F.lower("href").rlike(r"\.html?$") & ~F.contains(F.lower("href"), F.lit("index")), F.col("seq"))).alias("_page"),
    )
    primary = F.col("primary_document")
    primary_xml = F.lower(primary).endswith(".xml")
    return (
        index.join(picks, "accession_number", "left")
        .withColumn("xml_document", F.when(primary_xml, primary).otherwise(F.col("_xml")))
        .withColumn("page_document", F.when((F.length(primary) > 0) & ~primary_xml, primary).otherwise(F.col("_page")))
        .withColumn(
            "source_note",
            F.when(primary_xml, F.concat(F.lit("fetched via primaryDocument="), primary))
            .when(F.col("_xml").isNotNull() & (F.length(primary) > 0), F.concat(
                F.lit("fetched via index fallback (primaryDocument was non-XML: "), primary, F.lit(")")))
            .when(F.col("_xml").isNotNull(), F.lit("fetched via index scan (no primaryDocument field)"))
            .otherwise(F.lit("no .xml file found via primaryDocument or index scan")),
        )
        .drop("_xml", "_page")
    )


def land_bodies(
    bodies: DataFrame, table: str, buckets: int, path: str | None = None, key: str = "accession_number",
    finish: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Bodies as a table bucketed by their key. What is ranked then goes to the
    buckets: no analysis moves ``html`` again. ``buckets`` so many that the bodies of
    one fit a task; ``path`` in storage that all machines share. One file a bucket,
    written as the rows come, not sorted, and read few rows at a time. ``finish`` makes the bodies of what they are
    made of, in the buckets: then they are not moved at all."""
    dealt = bodies.repartition(buckets, key)
    writer = (finish(dealt) if finish else dealt).write.bucketBy(buckets, key).mode("overwrite").option("compression", "zstd")
    conf = bodies.sparkSession.conf
    before = conf.get(WRITERS)
    conf.set(WRITERS, "1")  # a task has the rows of one bucket
    try:
        (writer.option("path", path) if path else writer).saveAsTable(table)
    finally:
        conf.set(WRITERS, before)
    few_rows_a_batch(bodies.sparkSession)
    return bodies.sparkSession.table(table)


def with_body_status(filings: DataFrame, bodies: DataFrame) -> DataFrame:
    """Filings with body size and success; a missing body is a failed row, not
    a failed job."""
    return (
        with_bodies(filings, bodies)
        .withColumn("html_byte_length", F.coalesce(F.octet_length("html"), F.lit(0)))
        .withColumn("fetch_success", F.col("html").isNotNull())
        .withColumn("failure_reason", F.when(~F.col("fetch_success"), F.lit("No document body available")))
    )
