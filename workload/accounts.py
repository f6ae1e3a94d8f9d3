"""Queries over messages, users, plans and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from filegrain.functions import fixed_values as fv

from filegrain.operators import accounts as acc
from filegrain.plans import chat

from . import query, table
from .corpus import lit, strings

LEADS = (
    "Compare AAPL's last two filings", "hello there", "Give me a risk report on TSLA", "show MSFT trend over time",
    "what are you?", "categorize risks for `NVDA`", "insider buying at the bank", "Who owns KO: 13D activist", "ok thanks",
    "proxy governance of *JPM*", "8-K events BRK.B", "summary and overview, please", "Analyst report for IBM", "", "risk",
)


# --- messages -----------------------------------------------------------------------


def _messages(spark, d):
    m = table(spark, d, "conversations")
    lead = F.element_at(F.array(*[F.lit(s) for s in LEADS]), ((F.col("conv_id") * 7 + F.col("turn") * 3) % len(LEADS) + 1).cast("int"))
    # a third of the messages is the lead alone
    text = F.when(F.col("conv_id") % 3 == 0, lead).otherwise(F.concat(lead, F.lit(" "), "text"))
    return m.select("conv_id", "turn", "role", text.alias("text"))


WORDS = lit(r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+")
MSG_SQL = f"""m AS (
  SELECT conv_id, turn, role, CASE WHEN conv_id % 3 = 0 THEN lead ELSE lead || ' ' || text END AS text
  FROM (SELECT *, ({strings(LEADS)})[(conv_id * 7 + turn * 3) % {len(LEADS)} + 1] AS lead FROM conversations)
)"""


def _sql_intent(rules):
    return "CASE " + " ".join(
        f"WHEN {' OR '.join(f'contains(lower(text), {lit(w)})' for w in words)} THEN '{tool}'" for tool, words in rules
    )


TICKER_SQL = f"""coalesce(list_filter(list_transform(regexp_split_to_array(upper(regexp_replace(replace(text, 'ß', 'SS'), '[*"''`#]', ' ', 'g')), {WORDS}),
  lambda w: regexp_replace(w, '[^A-Z]', '', 'g')), lambda w: length(w) BETWEEN 2 AND 5 AND NOT list_contains({strings(fv.TICKER_STOP_WORDS)}, w))[1], '')"""
ROUTED_SQL = f"""WITH {MSG_SQL},
t AS (SELECT *, {TICKER_SQL} AS ticker, trim(lower(text), ' ' || chr(10) || chr(9)) AS low,
  list_filter(regexp_split_to_array(upper(replace(text, 'ß', 'SS')), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z]{{1,5}}') AND NOT list_contains({strings(fv.SHORT_STOP_WORDS)}, w))[1] AS router_ticker,
  list_filter(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z]{{2,5}}'))[1] AS written_ticker FROM m),
g AS (SELECT *, ticker = '' AND ({' OR '.join(f"starts_with(low, {lit(x)})" for x in fv.GREETINGS)} OR
  (len(list_filter(regexp_split_to_array(low, {WORDS}), lambda w: w <> '')) <= 3 AND NOT ({' OR '.join(f"contains(low, {lit(x)})" for x in fv.DOMAIN_STEMS)}))) AS is_greeting FROM t)"""


@query("message_routing", f"""{ROUTED_SQL}
SELECT conv_id, turn, ticker, is_greeting, CASE WHEN ticker <> '' AND NOT is_greeting THEN {_sql_intent(fv.CHAT_INTENTS)} ELSE '{fv.CHAT_DEFAULT_INTENT}' END END AS tool,
  router_ticker, CASE WHEN router_ticker IS NOT NULL THEN {_sql_intent(fv.ROUTER_INTENTS)} END END AS router_tool, written_ticker, {_sql_intent(fv.RUNNER_INTENTS)} END AS runner_tool FROM g""")
def q_routing(spark, d):
    return chat.route_messages(_messages(spark, d)).drop("role", "text")


def _answers(spark, d):
    m = _messages(spark, d)
    k = F.col("conv_id") + F.col("turn")
    result = F.when(k % 7 == 0, F.concat(F.lit("Could not FETCH "), "text")).when(k % 7 == 1, F.lit("")).otherwise(F.col("text"))
    reply = F.when(k % 5 == 0, F.lit("Connection Error, try again")).when(k % 5 == 1, F.lit(None).cast("string")).otherwise(F.col("text"))
    tool = F.when(k % 9 == 0, "error").otherwise("executive_report")
    return m.select("conv_id", "turn", result.alias("tool_result"), tool.alias("tool_name"), reply.alias("response"))


@query("message_charges", f"""WITH {MSG_SQL},
a AS (SELECT conv_id, turn, CASE (conv_id + turn) % 7 WHEN 0 THEN 'Could not FETCH ' || text WHEN 1 THEN '' ELSE text END AS x,
  CASE WHEN (conv_id + turn) % 9 = 0 THEN 'error' ELSE 'executive_report' END AS tool,
  CASE (conv_id + turn) % 5 WHEN 0 THEN 'Connection Error, try again' WHEN 1 THEN NULL ELSE text END AS y FROM m),
b AS (SELECT conv_id, turn, x <> '' AND tool <> 'error' AND NOT ({' OR '.join(f"contains(lower(x), {lit(p.lower())})" for p in fv.TOOL_FAILURE_PHRASES)}) AND length(trim(x, ' ' || chr(10) || chr(9))) > 100 AS filing_succeeded,
  coalesce(y <> '' AND NOT ({' OR '.join(f"contains(lower(y), {lit(p)})" for p in fv.RESPONSE_FAILURE_PHRASES)}), FALSE) AS response_succeeded FROM a)
SELECT *, filing_succeeded AND response_succeeded AS should_charge FROM b""")
def q_charges(spark, d):
    return chat.charges(_answers(spark, d)).drop("tool_result", "tool_name", "response")


def _stored_messages(spark, d):
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("conversation_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.timestamp_seconds(F.col("turn") * 60 + 1704067200).alias("created_at"), "role", "text",
    )


@query("recent_messages", """SELECT conv_id AS conversation_id, turn, role, text,
  CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS position
FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4)""")
def q_recent(spark, d):
    return acc.context_messages(_stored_messages(spark, d), 4).select(
        "conversation_id", (F.col("id") % 1000).alias("turn"), "role", "text", "position")


@query("first_messages", """SELECT conv_id AS conversation_id, turn, text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS position
FROM conversations QUALIFY position <= 3""")
def q_first(spark, d):
    return acc.context_messages(_stored_messages(spark, d), 3, newest=False).select(
        "conversation_id", (F.col("id") % 1000).alias("turn"), "text", "position")


@query("chat_context_messages", """SELECT conv_id AS conversation_id, turn, role, text, CAST(position AS INT) AS position
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM conversations) WHERE position <= 12 AND role IN ('user', 'assistant')""")
def q_chat_context(spark, d):
    """What a chat is told of its past: the first twelve messages, without the system's."""
    rows = acc.context_messages(_stored_messages(spark, d), newest=False, roles=("user", "assistant"), n=12)
    return rows.select("conversation_id", (F.col("id") % 1000).alias("turn"), "role", "text", "position")


@query("conversation_counters", "SELECT conv_id AS conversation_id, count(*) AS message_count, max(turn) AS last_turn FROM conversations GROUP BY 1")
def q_counters(spark, d):
    c = acc.conversation_counters(_stored_messages(spark, d))
    return c.select("conversation_id", "message_count", F.floor((F.unix_seconds("last_message_at") - 1704067200) / 60).alias("last_turn"))


TOOLS = ("generate_executive_report", "compare_filings", "categorize_risks", "analyze_8k_events", "analyze_proxy", "analyze_risk_trends", "other")


def _analyses(spark, d):
    e = table(spark, d, "events")
    kind = F.element_at(F.array(*[F.lit(t) for t in TOOLS]), (F.col("event_id") % len(TOOLS) + 1).cast("int"))
    v = F.concat(F.lit("value "), F.col("user_id").cast("string"))
    body = F.to_json(F.struct(
        F.repeat(v, 200).alias("report"),
        F.struct(v.alias("overall_materiality"), F.array(v, F.col("event_type")).alias("top_signals")).alias("scoring"),
        v.alias("highest_risk_event"),
        F.transform(F.sequence(F.lit(1), F.col("event_id") % 5 + 1), lambda i: F.struct(i.alias("n"))).alias("events"),
    ))
    summary = F.to_json(F.struct(F.when(kind == "analyze_proxy", v).alias("summary")))
    nested = F.to_json(F.struct(F.struct(v.alias("executive_summary"), F.col("event_type").alias("analyst_summary")).alias("summary")))
    return e.select(
        F.col("event_id").alias("id"), "user_id", F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("ticker"), kind.alias("tool_name"),
        F.when(kind == "analyze_proxy", summary).when(kind.isin("categorize_risks", "analyze_risk_trends"), nested).otherwise(body).alias("tool_output"),
        F.when(F.col("event_id") % 3 == 0, F.col("props")).alias("ai_interpretation"), F.lit("completed").alias("status"), F.col("ts").alias("created_at"), "event_type",
    )


@query("analysis_context", f"""WITH a AS (
  SELECT event_id, 'T' || user_id AS ticker, ({strings(TOOLS)})[event_id % {len(TOOLS)} + 1] AS tool, 'value ' || user_id AS v, event_type, event_id % 5 + 1 AS n,
    CASE WHEN event_id % 3 = 0 THEN props END AS note FROM events
), b AS (
  SELECT *, list_transform(range(1, n + 1), lambda i: '{{"n":' || i || '}}') AS ev FROM a
), c AS (
  SELECT *, '{{"report":"' || repeat(v, 200) || '","scoring":{{"overall_materiality":"' || v || '","top_signals":["' || v || '","' || event_type || '"]}},"highest_risk_event":"' || v || '","events":[' || array_to_string(ev, ',') || ']}}' AS js FROM b
)
SELECT event_id AS conversation_id, CASE WHEN event_id % 4 <> 0 THEN substr(concat_ws(chr(10), 'Ticker: ' || ticker, 'Tool: ' || tool,
  CASE tool WHEN 'generate_executive_report' THEN 'Report: ' || substr(repeat(v, 200), 1, 1500)
    WHEN 'compare_filings' THEN 'Overall Materiality: ' || v || chr(10) || 'Top Signals: ["' || v || '","' || event_type || '"]'
    WHEN 'categorize_risks' THEN 'Executive Summary: ' || v WHEN 'analyze_risk_trends' THEN 'Analyst Summary: ' || event_type
    WHEN 'analyze_8k_events' THEN 'Highest Risk Event: ' || v || chr(10) || 'Recent Events: [' || array_to_string(ev[1:3], ', ') || ']'
    WHEN 'analyze_proxy' THEN 'Summary: ' || v ELSE 'Tool Output: ' || substr(js, 1, 1500) END,
  'AI Interpretation: ' || note), 1, 2000) END AS context FROM c""")
def q_analysis_context(spark, d):
    talks = table(spark, d, "events").select(
        F.col("event_id").alias("conversation_id"), F.when(F.col("event_id") % 4 != 0, F.col("event_id")).alias("analysis_id"))
    return chat.conversation_context(talks, _analyses(spark, d)).select("conversation_id", "context")


@query("history_page", """SELECT event_id AS id, user_id, 'T' || user_id AS ticker, event_type,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS INT) AS place FROM events QUALIFY place BETWEEN 6 AND 25""")
def q_history(spark, d):
    columns = ["id", "user_id", "ticker", "event_type", "created_at"]
    return acc.history_pages(_analyses(spark, d), columns, limit=20, offset=5).drop("created_at")


@query("owner_rows", "SELECT event_id AS id, user_id, c_name AS viewer FROM events JOIN customer ON c_custkey = user_id")
def q_owner(spark, d):
    viewers = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("viewer"))
    return acc.visible_rows(_analyses(spark, d), viewers).select("id", "user_id", "viewer")


# --- users and plans -------------------------------------------------------------------

ZONES = ("UTC", "Africa/Lagos", "Asia/Kolkata", "America/New_York")
PLANS = ("free", "pro", "business")
STATES = ("active", "cancelled", "active", "past_due")


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def _users(spark, d):
    u = table(spark, d, "events").select("user_id").distinct()
    return u.withColumn("timezone", F.when(F.col("user_id") % 9 != 0, _pick(ZONES, F.col("user_id"))))


def _subscriptions(spark, d):
    # one market segment has not subscribed
    c = table(spark, d, "customer").where(F.col("c_mktsegment") != "MACHINERY")
    u = c.select(F.col("c_custkey").alias("user_id"))
    return u.select("user_id", _pick(PLANS, F.col("user_id")).alias("plan"), _pick(STATES, F.floor(F.col("user_id") / 3)).alias("status"))


SUBS_SQL = f"""subs AS (
  SELECT c_custkey AS user_id, ({strings(PLANS)})[c_custkey % 3 + 1] AS plan, ({strings(STATES)})[c_custkey // 3 % 4 + 1] AS status FROM customer WHERE c_mktsegment <> 'MACHINERY'
), users AS (
  SELECT DISTINCT user_id, coalesce(CASE WHEN user_id % 9 <> 0 THEN ({strings(ZONES)})[user_id % 4 + 1] END, 'UTC') AS zone FROM events
), full_users AS (
  SELECT u.user_id, zone, coalesce(plan, 'free') AS plan, coalesce(status, 'active') AS status FROM users u LEFT JOIN subs USING (user_id)
)"""


@query("user_subscriptions", f"WITH {SUBS_SQL} SELECT user_id, plan, status, CASE WHEN status = 'active' THEN plan ELSE 'free' END AS effective_plan FROM full_users")
def q_subs(spark, d):
    s = acc.with_subscription(_users(spark, d), _subscriptions(spark, d))
    return s.select("user_id", "plan", "status", acc.effective_plan(F.col("plan"), F.col("status")).alias("effective_plan"))


@query("daily_usage", f"""WITH {SUBS_SQL},
c AS (
  SELECT e.user_id, CASE WHEN status = 'active' THEN plan ELSE 'free' END AS effective_plan, CAST(timezone(zone, timezone('UTC', e.ts)) AS DATE) AS usage_date, count(*) AS today_count
  FROM events e JOIN full_users u USING (user_id) GROUP BY ALL
)
SELECT *, CASE WHEN effective_plan = 'free' THEN 2 END AS daily_limit, CASE WHEN effective_plan = 'free' THEN greatest(0, 2 - today_count) END AS remaining,
  effective_plan <> 'free' OR today_count < 2 AS allowed FROM c""")
def q_daily(spark, d):
    usage = table(spark, d, "events").select("user_id", F.to_timestamp(F.col("ts").cast("string")).alias("ts"))
    return chat.usage_report(usage, _users(spark, d), _subscriptions(spark, d))


def _plans(spark, d):
    start = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("user_id") % 28).cast("int"), hours=F.lit(6))
    p = _users(spark, d).select("user_id", _pick(("free_trial", "pro", "business"), F.col("user_id")).alias("plan"), start.alias("period_start"))
    return p.withColumn("period_end", acc.period_end(F.col("plan"), F.col("period_start"))).withColumn("analyses_used", F.lit(3))


PLAN_SQL = """plans AS (
  SELECT *, CASE WHEN plan = 'free_trial' THEN date_trunc('day', period_start) + INTERVAL 1 DAY ELSE period_start + INTERVAL 30 DAY END AS period_end FROM (
    SELECT DISTINCT user_id, (['free_trial', 'pro', 'business'])[user_id % 3 + 1] AS plan, TIMESTAMP '2024-01-01 06:00:00' + to_days(CAST(user_id % 28 AS INTEGER)) AS period_start FROM events)
)"""
USAGE_NOW = "2024-01-20 12:00:00"


@query("plan_usage", f"""WITH {PLAN_SQL},
cur AS (SELECT user_id, plan, CASE WHEN TIMESTAMP '{USAGE_NOW}' > period_end THEN TIMESTAMP '{USAGE_NOW}' ELSE period_start END AS s,
  CASE WHEN TIMESTAMP '{USAGE_NOW}' > period_end THEN CASE WHEN plan = 'free_trial' THEN TIMESTAMP '2024-01-21 00:00:00' ELSE TIMESTAMP '{USAGE_NOW}' + INTERVAL 30 DAY END ELSE period_end END AS e FROM plans),
n AS (SELECT c.user_id, c.plan, s, e, count(v.event_id) AS n FROM cur c LEFT JOIN events v ON v.user_id = c.user_id AND v.ts >= s AND v.ts <= TIMESTAMP '{USAGE_NOW}' GROUP BY ALL),
l AS (SELECT *, CASE plan WHEN 'free_trial' THEN 10 WHEN 'pro' THEN 500 ELSE -1 END AS plan_limit FROM n)
SELECT user_id, plan, plan_limit, CASE WHEN plan_limit = -1 THEN 0 ELSE least(n, plan_limit) END AS analyses_used,
  CASE WHEN plan_limit <> -1 THEN greatest(0, plan_limit - least(n, plan_limit)) END AS remaining,
  CAST(greatest(0, floor(epoch(e - TIMESTAMP '{USAGE_NOW}') / 86400)) AS INT) AS days_remaining, plan_limit = -1 OR n < plan_limit AS allowed FROM l""")
def q_plan_usage(spark, d):
    charges = table(spark, d, "events").select("user_id", "ts")
    return acc.plan_usage(charges, _plans(spark, d), F.lit(USAGE_NOW).cast("timestamp_ntz")).select(
        "user_id", "plan", "plan_limit", "analyses_used", "remaining", "days_remaining", "allowed")


@query("plan_changes", f"""WITH {PLAN_SQL},
ch AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 'pro' WHEN 'signup' THEN 'free_trial' ELSE 'gold' END AS new_plan FROM events WHERE event_type IN ('purchase', 'signup', 'error')),
l AS (SELECT user_id, arg_max(new_plan, ts) AS new_plan, max(ts) AS ts FROM ch WHERE new_plan <> 'gold' GROUP BY 1)
SELECT user_id, coalesce(l.new_plan, p.plan) AS plan, CASE WHEN l.new_plan IS NULL THEN 3 ELSE 0 END AS analyses_used, coalesce(l.ts, p.period_start) AS period_start,
  CASE WHEN l.new_plan IS NULL THEN p.period_end WHEN l.new_plan = 'free_trial' THEN date_trunc('day', l.ts) + INTERVAL 1 DAY ELSE l.ts + INTERVAL 30 DAY END AS period_end
FROM plans p LEFT JOIN l USING (user_id)""")
def q_plan_changes(spark, d):
    e = table(spark, d, "events").where(F.col("event_type").isin("purchase", "signup", "error"))
    changes = e.select("user_id", "ts", F.col("event_id").alias("change_id"),
                       F.when(F.col("event_type") == "purchase", "pro").when(F.col("event_type") == "signup", "free_trial").otherwise("gold").alias("new_plan"))
    return acc.plan_changes(_plans(spark, d), changes)


@query("default_rows", f"WITH {SUBS_SQL} SELECT * FROM subs UNION ALL SELECT user_id, 'free', 'active' FROM users WHERE user_id NOT IN (SELECT user_id FROM subs)")
def q_defaults(spark, d):
    return acc.default_rows(_users(spark, d), _subscriptions(spark, d))


@query("plan_of_code", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'pro' WHEN '2-HIGH' THEN 'business' ELSE 'pro' END AS plan FROM orders")
def q_plan_code(spark, d):
    return table(spark, d, "orders").select("o_orderkey", acc.plan_from_code(F.col("o_orderpriority"), {"1-URGENT": "pro", "2-HIGH": "business"}).alias("plan"))


@query("user_of_code", "SELECT o_orderkey, o_custkey AS code, (SELECT min(c_custkey) FROM customer WHERE c_custkey // 3 = o_custkey) AS user_id FROM orders")
def q_user_code(spark, d):
    subs = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.floor(F.col("c_custkey") / 3).alias("code"))
    return acc.user_of_code(subs, table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("code")), "code")


# --- integrity ---------------------------------------------------------------------------


def _parents(spark, d):
    return table(spark, d, "customer").select("c_custkey").where(F.col("c_acctbal") > 0)


def _children(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey")


@query("orphans", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def q_orphans(spark, d):
    return acc.orphans(_children(spark, d), _parents(spark, d), "o_custkey", "c_custkey")


@query("cascade_delete", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def q_cascade(spark, d):
    return acc.cascade(_children(spark, d), _parents(spark, d), "o_custkey", "c_custkey")


@query("set_null_delete", "SELECT o_orderkey, c_custkey AS o_custkey FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def q_set_null(spark, d):
    return acc.set_null(_children(spark, d), _parents(spark, d), "o_custkey", "c_custkey")


@query("domain_violations", """SELECT event_id, concat_ws('; ', CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'event_type not allowed' END, CASE WHEN event_id % 6 = 0 THEN 'note missing' END) AS violations
FROM events WHERE event_type NOT IN ('view', 'click', 'purchase') OR event_id % 6 = 0""")
def q_violations(spark, d):
    e = table(spark, d, "events").withColumn("note", F.when(F.col("event_id") % 6 != 0, F.col("props")))
    return acc.domain_violations(e, ["event_id"], {"event_type": ("view", "click", "purchase")}, ("note",))


