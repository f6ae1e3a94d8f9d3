"""Form 4 transactions and net activity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.rows import struct_rows
from ..functions.text import let, number, signed_whole, strip, strip_markup, unescape, whole

TRANSACTIONS = "array<struct<code:string,shares:double,price:double,owned_after:double>>"


def _element(tag: str) -> str:
    """Content of an element, prefix and case ignored."""
    return rf"(?is)<(?:\w+:)?{tag}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{tag}\s*>"


def _readable(xml: Column) -> Column:
    """Without comments, and with the text of CDATA parts in place of them."""
    bare = F.regexp_replace(xml, r"(?s)<!--.*?-->", "")
    return F.regexp_replace(bare, r"(?s)<!\[CDATA\[([^<]*)\]\]>", "$1")


def _plain(xml: Column) -> Column:
    return strip(unescape(F.regexp_replace(xml, r"(?s)<[^>]*>", "")))


def _content(xml: Column, tag: str) -> Column:
    """Text of the first such element; NULL when there is none."""
    return F.when(xml.rlike(_element(tag)), _plain(F.regexp_extract(xml, _element(tag), 1)))


def _inner(xml: Column, tag: str) -> Column:
    """Markup inside the first such element; empty when there is none."""
    return F.regexp_extract(xml, _element(tag), 1)


def _amount(xml: Column, tag: str) -> Column:
    """Number in an element, from its ``value`` child when it has one."""
    return let(
        _inner(xml, tag),
        lambda x: number(strip(F.when(F.contains(x, F.lit("<")), F.coalesce(
            F.nullif(_inner(x, "value"), F.lit("")), F.regexp_replace(x, r"(?s)<[^>]*>", "")
        )).otherwise(x))),
    )


def owner_title(xml: Column) -> Column:
    """Officer title, else the roles that are switched on, else ``Insider``."""
    role = lambda tag, name: F.when(strip(_inner(xml, tag)) == "1", F.lit(name))
    roles = F.concat_ws(
        ", ", role("isDirector", "Director"), role("isOfficer", "Officer"), role("isTenPercentOwner", "10% Owner"),
    )
    return F.coalesce(_content(xml, "officerTitle"), F.nullif(roles, F.lit("")), F.lit("Insider"))


def owner_name(xml: Column) -> Column:
    return F.coalesce(_content(xml, "rptOwnerName"), F.lit(fv.UNKNOWN_INSIDER))


def xml_transactions(xml: Column) -> Column:
    """Non-derivative transactions; those without a code are left out."""
    blocks = F.regexp_extract_all(xml, F.lit(_element("nonDerivativeTransaction")), F.lit(1))
    rows = F.transform(blocks, lambda b: F.struct(
        _plain(_inner(b, "transactionCode")).alias("code"),
        _amount(b, "transactionShares").alias("shares"),
        _amount(b, "transactionPricePerShare").alias("price"),
        _amount(b, "sharesOwnedFollowingTransaction").alias("owned_after"),
    ))
    return F.filter(rows, lambda r: r["code"] != "").cast(TRANSACTIONS)


def table_transactions(html: Column) -> Column:
    """Fallback over rendered tables: rows of four or more cells with a code
    cell and a number cell."""

    def row(tr: Column) -> Column:
        cells = F.transform(
            F.regexp_extract_all(tr, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), F.lit(1)), _plain
        )

        def pick(c: Column) -> Column:
            code = F.get(F.filter(c, lambda x: x.rlike(r"^[PSAMFGCD]$")), F.lit(0))
            amount = F.get(F.filter(
                c, lambda x: F.replace(x, F.lit(","), F.lit("")).rlike(r"^\d+\.?\d*$")
            ), F.lit(0))
            return F.when(F.size(c) >= 4, F.struct(
                code.alias("code"), number(amount).alias("shares"),
                F.lit(None).cast("double").alias("price"), F.lit(None).cast("double").alias("owned_after"),
            ))

        return let(cells, pick)

    rows = F.transform(
        F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1)), row
    )
    return F.filter(rows, lambda r: r["code"].isNotNull() & r["shares"].isNotNull()).cast(TRANSACTIONS)


def table_owner(html: Column) -> Column:
    name = F.regexp_extract(
        strip_markup(html, "|"),
        r"Name and Address of Reporting Person\*?\s*\|+([A-Z][A-Za-z .,'-]{2,60})", 1,
    )
    return F.coalesce(F.nullif(strip(name), F.lit("")), F.lit(fv.UNKNOWN_INSIDER))


def code_label(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in fv.TRANSACTION_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, code), F.lit(fv.OTHER_TRANSACTION))


def form4_transactions(filings: DataFrame) -> DataFrame:
    """``filings(…, xml, rendered_html)`` to ``…, insider_name, insider_title,
    transactions``. The table is read only where the XML gave nothing."""
    from_xml = F.coalesce(xml_transactions(F.col("xml")), F.array().cast(TRANSACTIONS))
    out = filings.withColumn("xml", _readable(F.col("xml"))).withColumn("_xml_rows", from_xml)
    parsed = F.size("_xml_rows") > 0
    return (
        out.withColumn("insider_name", F.when(parsed, owner_name(F.col("xml"))).otherwise(table_owner(F.col("rendered_html"))))
        .withColumn("insider_title", F.when(parsed, owner_title(F.col("xml"))).otherwise(F.lit("Insider")))
        .withColumn("transactions", F.when(parsed, F.col("_xml_rows")).otherwise(
            F.coalesce(table_transactions(F.col("rendered_html")), F.array().cast(TRANSACTIONS))
        ))
        .drop("_xml_rows", "xml", "rendered_html")
    )


def transaction_rows(parsed: DataFrame) -> DataFrame:
    """One row per transaction, with the code's label."""
    keep = [c for c in parsed.columns if c != "transactions"]
    return struct_rows(parsed, keep, F.col("transactions")).withColumn("transaction_type", code_label(F.col("code")))


def net_activity(parsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Net shares, counts and coverage per key; ``parsed`` has one row per
    filing with its transactions, so coverage needs no second pass."""
    t = F.col("transactions")
    shares = lambda code: F.sum(F.aggregate(
        F.filter(t, lambda x: x["code"] == code), F.lit(0.0), lambda acc, x: acc + F.coalesce(x["shares"], F.lit(0.0))
    ))
    count = lambda code: F.sum(F.size(F.filter(t, lambda x: x["code"] == code)))
    return parsed.groupBy(*keys).agg(
        shares("P").alias("net_shares_bought"),
        shares("S").alias("net_shares_sold"),
        count("P").alias("buy_count"),
        count("S").alias("sell_count"),
        F.sum(F.size(t)).alias("transaction_count"),
        F.count_if(F.size(t) > 0).alias("filings_with_data"),
        F.count(F.lit(1)).alias("total_filings"),
    )


def activity_summary(ticker: Column) -> Column:
    net = F.col("net_shares_bought") - F.col("net_shares_sold")
    direction = F.when(net > 0, "net buying").when(net < 0, "net selling").otherwise("balanced activity")
    coverage = F.when(
        F.col("filings_with_data") < F.col("total_filings"),
        F.format_string("(parsed %d/%d filings successfully)", "filings_with_data", "total_filings"),
    ).otherwise("")
    return F.format_string(
        "%s insider activity across %d recent Form 4 filings %s: "
        "%d purchase transaction(s) totaling %s shares, "
        "%d sale transaction(s) totaling %s shares. "
        "Net position: %s (%s shares).",
        ticker, F.col("total_filings"), coverage,
        F.col("buy_count"), whole(F.col("net_shares_bought")),
        F.col("sell_count"), whole(F.col("net_shares_sold")),
        direction, signed_whole(net),
    )
