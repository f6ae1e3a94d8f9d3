"""Stakes, filers and activist language of ownership filings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import matched, strip


def percent_owned(text: Column, form: Column) -> Column:
    """The first percentage in the text; NULL for portfolio reports."""
    first = F.nullif(F.regexp_extract(text, fv.PERCENT_PATTERN, 1), F.lit("")).cast("double")
    return F.when(~F.startswith(form, F.lit("13F-HR")), first)


def filer_name(text: Column, form: Column) -> Column:
    named = F.nullif(strip(F.regexp_extract(text, fv.REPORTING_PERSON_PATTERN, 1)), F.lit(""))
    filer = F.nullif(strip(F.regexp_extract(text, fv.FILER_PATTERN, 1)), F.lit(""))
    return F.coalesce(named, F.when(F.startswith(form, F.lit("13F-HR")), filer), F.lit(fv.UNKNOWN_FILER))


def ownership_columns(df: DataFrame, text: Column, phrases: Sequence[str] = fv.ACTIVIST_PHRASES) -> DataFrame:
    form = F.col("form_type")
    return (
        df.withColumn("filer_name", filer_name(text, form))
        .withColumn("percent_ownership", percent_owned(text, form))
        .withColumn("is_portfolio_filing", F.startswith(form, F.lit("13F-HR")))
        .withColumn("activist_phrases_found", matched(text, phrases))
        .withColumn(
            "is_activist_signal",
            F.startswith(form, F.lit("SC 13D")) | (F.size("activist_phrases_found") > 0),
        )
    )


def form_order(form: Column, forms: Sequence[str] = fv.OWNERSHIP_FORMS) -> Column:
    return F.array_position(F.array(*[F.lit(f) for f in forms]), form).cast("int")


def ownership_summary(filings: DataFrame, forms: Sequence[str] = fv.OWNERSHIP_FORMS) -> DataFrame:
    """Totals and narrative per ticker, over the newest N filings of each form:
    what is collected per ticker is bounded by N times the number of forms."""
    named = F.col("filer_name") != fv.UNKNOWN_FILER
    three = lambda flag: F.slice(F.array_sort(F.collect_set(
        F.when(F.col(flag) & named, F.col("filer_name"))
    )), 1, 3)
    totals = filings.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("filing_count"),
        F.count_if("is_activist_signal").alias("activist_signal_count"),
        three("is_activist_signal").alias("activist_filers"),
        three("is_portfolio_filing").alias("portfolio_filers"),
        *[F.count_if(F.col("form_type") == f).alias(f"_n{i}") for i, f in enumerate(forms)],
    )
    types = F.concat_ws(", ", *[
        F.when(F.col(f"_n{i}") > 0, F.concat(F.col(f"_n{i}").cast("string"), F.lit(f" {f}")))
        for i, f in enumerate(forms)
    ])
    names = F.when(F.size("activist_filers") > 0, F.array_join("activist_filers", ", ")).otherwise(F.lit("unnamed filer(s)"))
    out = totals.withColumn("type_summary", types).withColumn("summary", F.concat_ws(
        " ",
        F.format_string("%s ownership filings found: %s.", "ticker", "type_summary"),
        F.when(F.col("activist_signal_count") > 0, F.format_string(
            "%d filing(s) show activist-style language or active (13D) intent — including %s.",
            F.col("activist_signal_count"), names,
        )).otherwise(F.lit("No activist signals detected — ownership filings appear passive.")),
        F.when(F.size("portfolio_filers") > 0, F.concat(
            F.lit("Institutional 13F-HR filers disclosing this position: "),
            F.array_join("portfolio_filers", ", "), F.lit("."),
        )),
    ))
    return out.drop(*[f"_n{i}" for i in range(len(forms))])
