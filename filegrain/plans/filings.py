"""Event reports, proxies, insider and ownership filings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.rows import element_rows
from ..functions.text import strip_markup
from ..operators.governance import governance_score, governance_signals, governance_summary
from ..operators.insider import activity_summary, form4_transactions, net_activity
from ..operators.items import event_items
from ..operators.ownership import form_order, ownership_columns, ownership_summary
from ..operators.recency import SERIES, newest, with_bodies

# fixed values: why an analysis has nothing to show
NO_EVENTS = "No 8-K filings found for %s."
NO_FORM4 = (
    "No Form 4 filings found for %s in the recent submissions window. "
    "This can happen for companies with very low insider trading activity recently."
)
UNPARSED_FORM4 = "Found %d Form 4 filing(s) for %s but could not parse transaction data from any of them. Diagnostic: %s"
NO_TRANSACTIONS, NO_XML, DIAGNOSTIC_CAP = "%s: XML fetched but 0 transactions parsed", "%s: no XML found", 5
NO_OWNERSHIP = (
    "No 13D, 13G, or 13F-HR filings (including amendments) found for %s. This is common for smaller companies with "
    "no activist or institutional >5% holders currently on file with the SEC."
).replace("5%", "5%%")

EMPTY_ITEMS = "array<struct<item_number:string,label:string,tier:int,materiality:string,excerpt:string>>"


def answered(found: DataFrame, requests: DataFrame | None, reason: Column, *also: Column) -> DataFrame:
    """A row for every requested ticker: what was found, or that nothing was and
    why. Without ``requests`` (ticker) only the tickers found have rows."""
    rows = found.withColumn("_found", F.lit(True))
    if requests is not None:
        rows = requests.select("ticker").distinct().join(rows, "ticker", "left")
    why = F.coalesce(F.when(F.col("_found").isNull(), reason), *also)
    return rows.withColumn("failure_reason", why).withColumn("pipeline_success", F.col("failure_reason").isNull()).drop("_found")


def eight_k_items(index: DataFrame, bodies: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` newest event reports of each company with their items;
    unreadable ones stay, without items."""
    ranked = newest(index.where(F.col("form_type") == "8-K"), n)
    rows = with_bodies(ranked, bodies)
    return rows.withColumn("fetch_success", F.length("html") > 0).withColumn(
        "items", F.coalesce(event_items(strip_markup(F.col("html"), "\n")), F.array().cast(EMPTY_ITEMS))
    ).withColumn("fetch_success", F.coalesce("fetch_success", F.lit(False))).drop("html")


def eight_k_events(filings: DataFrame) -> DataFrame:
    """One row per event, newest filing first by ``rn``, then ``item_pos``."""
    keep = [c for c in filings.columns if c != "items"]
    return element_rows(filings, keep, F.col("items"), pos="item_pos", item="item").select(*keep, "item_pos", "item.*")


def eight_k_summary(filings: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Filing counts and the most severe event per company, and why there is none."""
    events = F.transform("items", lambda x, i: F.struct(
        x["tier"].alias("tier"), F.col("rn").alias("rn"), i.alias("i"),
        x["item_number"].alias("number"), x["label"].alias("label"), F.col("filing_date").alias("d"),
    ))
    worst = F.min(F.array_min(events)).alias("w")
    out = filings.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("filing_count"),
        F.count_if("fetch_success").alias("parsed_count"),
        F.sum(F.size("items")).alias("event_count"), worst,
    )
    out = out.withColumn("highest_risk_event", F.when(F.col("w").isNotNull(), F.format_string(
        "Item %s — %s (%s)", F.col("w.number"), F.col("w.label"), F.col("w.d").cast("string")
    ))).drop("w")
    return answered(out, requests, F.format_string(NO_EVENTS, "ticker"))


def proxy_governance(index: DataFrame, bodies: DataFrame) -> DataFrame:
    """Governance signals, score and summary of each newest proxy statement."""
    ranked = newest(index.where(F.col("form_type") == "DEF 14A"), 1)
    rows = with_bodies(ranked, bodies)
    readable = F.coalesce(F.length("html") > 0, F.lit(False))
    rows = (
        rows.withColumn("pipeline_success", readable)
        .withColumn("governance_signals", governance_signals(strip_markup(F.col("html"), " ")))
        .withColumn("governance_risk_score", governance_score(F.col("governance_signals")))
        .withColumn("summary", governance_summary(
            F.col("ticker"), F.col("filing_date").cast("string"), F.col("governance_signals"), F.col("governance_risk_score")
        ))
        .withColumn("failure_reason", F.when(~readable, F.format_string(
            "Could not fetch DEF 14A for %s. Not all companies file proxies on a predictable schedule.", "ticker"
        )))
    )
    return rows.drop("html", "rn")


def insider_filings(index: DataFrame, documents: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` newest Form 4 filings of each company, parsed.
    ``documents(accession_number, xml, rendered_html)``."""
    ranked = newest(index.where(F.col("form_type") == "4"), n)
    rows = with_bodies(ranked, documents)
    return form4_transactions(rows.withColumn("has_xml", F.coalesce(F.length("xml") > 0, F.lit(False))))


def insider_activity(index: DataFrame, documents: DataFrame, n: int = 10, requests: DataFrame | None = None) -> DataFrame:
    """Net activity and summary per company, and why there is none."""
    filings = insider_filings(index, documents, n)
    acc = F.col("accession_number").cast("string")
    note = F.when(F.size("transactions") == 0, F.when(F.col("has_xml"), F.format_string(NO_TRANSACTIONS, acc)).otherwise(F.format_string(NO_XML, acc)))
    # at most n filings of a company
    notes = filings.groupBy("ticker").agg(F.array_sort(F.collect_list(F.when(note.isNotNull(), F.struct("rn", note.alias("note"))))).alias("_notes"))
    out = net_activity(filings, ["ticker"]).join(notes, "ticker")
    nothing = F.when(F.col("transaction_count") == 0, F.format_string(
        UNPARSED_FORM4, "total_filings", "ticker", F.array_join(F.slice("_notes.note", 1, DIAGNOSTIC_CAP), " | ")))
    out = out.withColumn("summary", F.when(F.col("transaction_count") > 0, activity_summary(F.col("ticker"))))
    return answered(out, requests, F.format_string(NO_FORM4, "ticker"), nothing).drop("_notes")


def ownership_filings(index: DataFrame, bodies: DataFrame, n: int = 6) -> DataFrame:
    """The ``n`` newest filings of each ownership form with readable
    bodies. All forms come from one scan; ``form_order`` keeps their order."""
    ranked = newest(index.where(F.col("form_type").isin(*fv.OWNERSHIP_FORMS)), n)
    rows = with_bodies(ranked, bodies, keep_absent=False).where(F.length("html") > 0)
    rows = rows.withColumn("_text", strip_markup(F.col("html"), " ")).drop("html")
    return ownership_columns(rows, F.col("_text")).drop("_text").withColumn("form_order", form_order(F.col("form_type")))


def ownership(index: DataFrame, bodies: DataFrame, n: int = 6, requests: DataFrame | None = None) -> DataFrame:
    """Totals and narrative per company, and why there are none."""
    return answered(ownership_summary(ownership_filings(index, bodies, n)), requests, F.format_string(NO_OWNERSHIP, "ticker"))


__all__ = [
    "SERIES", "eight_k_events", "eight_k_items", "eight_k_summary", "insider_activity",
    "insider_filings", "ownership", "ownership_filings", "proxy_governance",
]
