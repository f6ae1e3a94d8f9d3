"""Messages and usage as batch jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import left_join_present
from ..functions import fixed_values as fv
from ..functions import routing as r
from ..functions.text import clip
from ..operators.accounts import daily_usage, plan_usage, with_subscription


def route_messages(messages: DataFrame, text: str = "text") -> DataFrame:
    """Messages with ticker, greeting flag, the tool to run and both other rule
    sets' verdicts."""
    t = F.col(text)
    return (
        messages.withColumn("ticker", r.message_ticker(t))
        .withColumn("is_greeting", r.is_greeting(t, F.col("ticker")))
        .withColumn("tool", F.when((F.col("ticker") != "") & ~F.col("is_greeting"), r.chat_intent(t)))
        .withColumn("router_ticker", r.router_ticker(t))
        .withColumn("router_tool", r.router_intent(t))
        .withColumn("written_ticker", r.written_ticker(t))
        .withColumn("runner_tool", r.runner_intent(t))
    )


def charges(answers: DataFrame) -> DataFrame:
    """``answers(tool_result, tool_name, response)`` with success and charge."""
    return (
        answers.withColumn("filing_succeeded", r.tool_succeeded(F.col("tool_result"), F.col("tool_name")))
        .withColumn("response_succeeded", r.response_succeeded(F.col("response")))
        .withColumn("should_charge", r.charged(F.col("filing_succeeded"), F.col("response_succeeded")))
    )


# fixed values: where a tool's result keeps what the chat needs
_SUMMARIES = {
    "generate_executive_report": (("Report: ", "$.report", fv.CONTEXT_TOOL_CHARS),),
    "compare_filings": (
        ("Overall Materiality: ", "$.scoring.overall_materiality", None),
        ("Top Signals: ", "$.scoring.top_signals", None),
    ),
    "categorize_risks": (("Executive Summary: ", "$.summary.executive_summary", None),),
    "analyze_insider_activity": (("Summary: ", "$.summary", None),),
    "analyze_ownership": (("Summary: ", "$.summary", None),),
    "analyze_proxy": (("Summary: ", "$.summary", None),),
    "analyze_risk_trends": (("Analyst Summary: ", "$.summary.analyst_summary", None),),
}


def _field(output: Column, label: str, path: str, cut: int | None) -> Column:
    value = F.coalesce(F.get_json_object(output, path), F.lit(""))
    return F.concat(F.lit(label), clip(value, cut) if cut else value)


def _events(output: Column) -> Column:
    events = F.from_json(F.get_json_object(output, "$.events"), "array<string>")
    recent = F.when(F.size(events) > 0, F.concat(
        F.lit("Recent Events: ["), F.array_join(F.slice(events, 1, 3), ", "), F.lit("]")
    ))
    return F.concat_ws("\n", _field(output, "Highest Risk Event: ", "$.highest_risk_event", None), recent)


def context_summary(tool: Column, output: Column, ticker: Column, interpretation: Column) -> Column:
    """What the chat is told about a stored analysis, by kind of tool."""
    body = F.when(tool == "analyze_8k_events", _events(output))
    for name, fields in _SUMMARIES.items():
        body = body.when(tool == name, F.concat_ws("\n", *[_field(output, *f) for f in fields]))
    body = body.otherwise(F.concat(F.lit("Tool Output: "), clip(output, fv.CONTEXT_TOOL_CHARS)))
    return clip(F.concat_ws(
        "\n", F.concat(F.lit("Ticker: "), ticker), F.concat(F.lit("Tool: "), tool), body,
        F.when(F.length(interpretation) > 0, F.concat(F.lit("AI Interpretation: "), interpretation)),
    ), fv.CONTEXT_CHARS)


def conversation_context(conversations: DataFrame, analyses: DataFrame) -> DataFrame:
    """Conversations with the summary of the analysis they are linked to."""
    linked = analyses.select(
        F.col("id").alias("analysis_id"),
        context_summary(F.col("tool_name"), F.col("tool_output"), F.col("ticker"), F.col("ai_interpretation")).alias("context"),
    )
    return left_join_present(conversations, linked, "analysis_id")


def usage_report(usage: DataFrame, users: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Daily use of every user with usage, under the plan in force."""
    return daily_usage(usage, with_subscription(users, subscriptions))


__all__ = ["charges", "context_summary", "conversation_context", "plan_usage", "route_messages", "usage_report"]
