"""Reading chat messages: ticker, intent, greeting and charge rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from .text import WS, contains_any, positions, starts_with_any, strip, string_array


def valid_ticker(ticker: Column) -> Column:
    """Letters only, dots and dashes aside."""
    bare = F.regexp_replace(normal_ticker(ticker), r"[-.]", "")
    return bare.rlike(r"^\p{L}+$")


def normal_ticker(ticker: Column) -> Column:
    return F.upper(strip(ticker))


def message_ticker(text: Column, stop_words: Sequence[str] = fv.TICKER_STOP_WORDS) -> Column:
    """The first word of 2–5 letters that is no stop word; empty when none."""
    words = F.split(F.upper(F.regexp_replace(text, r"[*\"'`#]", " ")), f"{WS}+")
    letters = F.transform(words, lambda w: F.regexp_replace(w, "[^A-Z]", ""))
    usable = F.filter(letters, lambda w: F.length(w).between(2, 5) & ~F.array_contains(string_array(stop_words), w))
    return F.coalesce(F.get(usable, F.lit(0)), F.lit(""))


def router_ticker(text: Column, stop_words: Sequence[str] = fv.SHORT_STOP_WORDS) -> Column:
    """First stand-alone word of 1–5 letters, case ignored; NULL when none."""
    words = F.regexp_extract_all(
        F.upper(text), F.lit(r"(?<![\p{L}\p{N}_])[A-Z]{1,5}(?![\p{L}\p{N}_])"), F.lit(0)
    )
    return F.get(F.filter(words, lambda w: ~F.array_contains(string_array(stop_words), w)), F.lit(0))


def written_ticker(text: Column) -> Column:
    """First upper-case word of 2–5 letters as written; NULL when none."""
    return F.nullif(
        F.regexp_extract(text, r"(?<![\p{L}\p{N}_])[A-Z]{2,5}(?![\p{L}\p{N}_])", 0), F.lit("")
    )


def intent(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str | None = None) -> Column:
    """The first rule with a word in the text."""
    # words in rule order: the least ordinal found belongs to the first rule
    tools = string_array(tool for tool, words in rules for _ in words)
    hit = F.get(tools, F.get(positions(text, [w for _, words in rules for w in words]), F.lit(0)))
    return F.coalesce(hit, F.lit(default)) if default else hit


def chat_intent(text: Column) -> Column:
    return intent(text, fv.CHAT_INTENTS, fv.CHAT_DEFAULT_INTENT)


def router_intent(text: Column) -> Column:
    """Tool of the router's rules, only when a ticker is found as well."""
    return F.when(router_ticker(text).isNotNull(), intent(text, fv.ROUTER_INTENTS))


def runner_intent(text: Column) -> Column:
    return intent(text, fv.RUNNER_INTENTS)


def is_greeting(text: Column, ticker: Column, greetings: Sequence[str] = fv.GREETINGS) -> Column:
    """No ticker, and either a greeting or at most three words without a
    domain word."""
    low = strip(F.lower(text))
    few = F.size(F.filter(F.split(low, f"{WS}+"), lambda w: w != "")) <= 3
    return (ticker == "") & (starts_with_any(low, greetings) | (few & ~contains_any(low, fv.DOMAIN_STEMS)))


def tool_succeeded(result: Column, tool: Column) -> Column:
    """A real result: long enough and without a failure phrase."""
    ok = ~contains_any(result, fv.TOOL_FAILURE_PHRASES) & (F.length(strip(result)) > fv.TOOL_RESULT_CHARS)
    return F.coalesce((F.length(result) > 0) & (tool != "error") & ok, F.lit(False))


def response_succeeded(response: Column) -> Column:
    return F.coalesce(
        (F.length(response) > 0) & ~contains_any(response, fv.RESPONSE_FAILURE_PHRASES), F.lit(False)
    )


def charged(filing_ok: Column, response_ok: Column) -> Column:
    return filing_ok & response_ok
