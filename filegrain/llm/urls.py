"""URL filters: rules first, then a tree of path templates for each host.

The tree: a path's segments are generalised by their form (numbers, hashes, dates),
then a node whose children are many and mostly seen once turns into a wildcard.
Templates of one host that differ in literal segments only are branches of one
skeleton; labelled branches whose share of blocked pages does not differ from the
skeleton's by more than chance are merged. A template is rejected when its smoothed
share of blocked pages among the labelled ones is high enough.

Labels are what the rules decide; pages that no rule fits are judged by their
template. A null url, or one without ``://``, has an empty host and path, fits no
rule and is judged like any other path of the empty host. Repeated rows are judged
one by one and count as often as they occur. Of two rules of one length that fit, the one
that is larger as text holds. Very long paths are whole; segments beyond ``DEPTH`` count as
one. An empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filegrain.llm.common import ascii_lower

#: (host, path, verdict); configuration, so its size is that of a settings file.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# Forms of segments that vary from page to page, tried in this order.
FORMS = (
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "<date>"),
    (r"^[0-9]+$", "<n>"),
    (r"^[0-9]+(\.[A-Za-z]+)$", "<n>$1"),
    (r"^[0-9a-fA-F-]{16,}$", "<hash>"),
    (r"^.*[0-9]{3,}.*$", "<mixed>"),
)
#: Segments beyond this depth count as one.
DEPTH = 16
WILD_CHILDREN, WILD_SHARE = 20, 0.5
#: Branches with fewer labelled pages are left alone; those within LIKE_Z standard errors of the pooled share merge.
LEAST_LABELLED, LIKE_Z = 5, 1.64
PRIOR_ROWS, PRIOR_SHARE, REJECT_SHARE = 2.0, 0.5, 0.8


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda k: F.coalesce(F.regexp_extract(url, URL, k), F.lit(""))
    return ascii_lower(part(1)), part(2)


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(size, rule, verdict), or null."""
    fits = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for h, p, v in rules
    ]
    none = F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    return F.greatest(none, none, *fits)


def form(segment: Column) -> Column:
    """A segment with what varies replaced by the name of its form."""
    out = segment
    for pattern, name in reversed(FORMS):
        out = F.when(segment.rlike(pattern), F.regexp_replace(segment, pattern, name)).otherwise(out)
    return out


def shape(path: Column) -> Column:
    """The path with each segment in its form, at most DEPTH segments and the rest."""
    parts = F.split(path, "/", DEPTH + 1)
    return F.array_join(F.transform(parts, form), "/")


def template_verdicts(shapes: DataFrame) -> DataFrame:
    """(host, shape, n, blocked, labelled) -> (host, shape, template, rejected).

    Works on distinct shapes, far fewer than pages; every step adds up counts by key.
    """
    parts = F.split("shape", "/")
    levels = shapes.select("host", "shape", "n", F.posexplode(parts).alias("level", "segment")).withColumn(
        "above", F.array_join(F.slice(F.split("shape", "/"), 1, F.col("level")), "/")
    )
    children = levels.groupBy("host", "level", "above", "segment").agg(F.sum("n").alias("n"))
    wild = (
        children.groupBy("host", "level", "above")
        .agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("n"))
        .where((F.col("children") >= WILD_CHILDREN) & (F.col("children") >= WILD_SHARE * F.col("n")))
        .select("host", "level", "above", F.lit(True).alias("wild"))
    )
    templates = (
        levels.join(wild, ["host", "level", "above"], "left")
        .withColumn("segment", F.when(F.col("wild"), F.lit("<any>")).otherwise(F.col("segment")))
        .groupBy("host", "shape")
        .agg(F.array_sort(F.collect_list(F.struct("level", "segment"))).alias("parts"))
        .select("host", "shape", F.array_join(F.col("parts.segment"), "/").alias("template"))
    )
    placed = shapes.join(templates, ["host", "shape"]).withColumn(
        "skeleton", F.array_join(F.transform(F.split("template", "/"), lambda s: F.when((s == "") | s.startswith("<"), s).otherwise("<word>")), "/")
    )
    branches = placed.groupBy("host", "skeleton", "template").agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"))
    pooled = branches.groupBy("host", "skeleton").agg(
        F.sum("blocked").alias("all_blocked"), F.sum("labelled").alias("all_labelled"), F.count_if(F.col("labelled") > 0).alias("known")
    )
    share = (F.col("all_blocked") + 1.0) / (F.col("all_labelled") + 2.0)
    distance = F.col("blocked") - F.col("labelled") * share
    like = (F.col("known") > 1) & (F.col("labelled") >= LEAST_LABELLED) & (distance * distance <= LIKE_Z * LIKE_Z * F.col("labelled") * share * (1 - share))
    judged = branches.join(pooled, ["host", "skeleton"]).withColumn("group", F.when(like, F.col("skeleton")).otherwise(F.col("template")))
    purity = (F.sum("blocked") + PRIOR_ROWS * PRIOR_SHARE) / (F.sum("labelled") + PRIOR_ROWS)
    groups = judged.groupBy("host", "skeleton", "group").agg((purity >= REJECT_SHARE).alias("rejected"))
    verdicts = judged.join(groups, ["host", "skeleton", "group"]).select("host", "template", F.col("group").alias("merged"), "rejected")
    return placed.join(verdicts, ["host", "template"]).select("host", "shape", F.col("merged").alias("template"), "rejected")


def filter_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """(key, host, path, rule, verdict, template) of each row."""
    host, path = host_and_path(F.col(url))
    read = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    read = read.withColumn("hit", longest_rule(F.col("host"), F.col("path"), rules)).withColumn("shape", shape(F.col("path")))
    shapes = read.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("hit.verdict") == "block", 1)).alias("blocked"),
        F.count(F.col("hit.verdict")).alias("labelled"),
    )
    judged = read.join(template_verdicts(shapes), ["host", "shape"], "left")
    return judged.select(
        key, "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.when(F.col("hit").isNull(), F.col("template")).alias("template"),
    )


def _sql_form(s: str) -> str:
    def case(pattern: str, name: str) -> str:
        return f"WHEN regexp_matches({s}, '{pattern}') THEN regexp_replace({s}, '{pattern}', '{name.replace('$', chr(92))}')"

    return "CASE " + " ".join(case(p, n) for p, n in FORMS) + f" ELSE {s} END"


def sql(rules=RULES) -> str:
    """The whole filter in SQL."""
    fits = ", ".join(f"('{h}', '{p}', '{v}', {len(h + p)})" for h, p, v in rules)
    return f"""
WITH rules(rule_host, rule_path, rule_verdict, size) AS (VALUES {fits}),
read AS (
  SELECT row_number() OVER () AS r, page_id,
         translate(coalesce(regexp_extract(url, '{URL}', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '{URL}', 2), '') AS path
  FROM pages),
hits AS (
  SELECT r, first(rule_host || rule_path ORDER BY size DESC, rule_host || rule_path DESC) AS rule, first(rule_verdict ORDER BY size DESC, rule_host || rule_path DESC) AS hit
  FROM read JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY r),
split AS (
  SELECT read.*, rule, hit,
         CASE WHEN len(string_split(path, '/')) <= {DEPTH + 1} THEN string_split(path, '/')
              ELSE list_append(string_split(path, '/')[1:{DEPTH}], array_to_string(string_split(path, '/')[{DEPTH + 1}:], '/')) END AS parts
  FROM read LEFT JOIN hits USING (r)),
shaped AS (SELECT *, array_to_string(list_transform(parts, lambda s: {_sql_form("s")}), '/') AS shape FROM split),
shapes AS (
  SELECT host, shape, count(*) AS n, count(*) FILTER (hit = 'block') AS blocked, count(hit) AS labelled
  FROM shaped GROUP BY 1, 2),
levels AS (
  SELECT host, shape, n, k AS level, string_split(shape, '/')[k] AS segment,
         array_to_string(string_split(shape, '/')[1:k - 1], '/') AS above
  FROM (SELECT *, unnest(range(1, len(string_split(shape, '/')) + 1)) AS k FROM shapes)),
children AS (SELECT host, level, above, segment, sum(n) AS n FROM levels GROUP BY ALL),
wild AS (
  SELECT host, level, above FROM children GROUP BY ALL
  HAVING count(*) >= {WILD_CHILDREN} AND count(*) >= {WILD_SHARE} * sum(n)),
templates AS (
  SELECT host, shape, string_agg(CASE WHEN w THEN '<any>' ELSE segment END, '/' ORDER BY level) AS template
  FROM levels LEFT JOIN (SELECT *, TRUE AS w FROM wild) USING (host, level, above) GROUP BY 1, 2),
placed AS (
  SELECT *, array_to_string(list_transform(string_split(template, '/'),
         lambda s: CASE WHEN s = '' OR starts_with(s, '<') THEN s ELSE '<word>' END), '/') AS skeleton
  FROM shapes JOIN templates USING (host, shape)),
branches AS (SELECT host, skeleton, template, sum(blocked) AS blocked, sum(labelled) AS labelled FROM placed GROUP BY ALL),
pooled AS (
  SELECT *, (sum(blocked) OVER w + 1.0) / (sum(labelled) OVER w + 2.0) AS share, count(*) FILTER (labelled > 0) OVER w AS known FROM branches
  WINDOW w AS (PARTITION BY host, skeleton)),
judged AS (
  SELECT *, CASE WHEN known > 1 AND labelled >= {LEAST_LABELLED}
                  AND pow(blocked - labelled * share, 2) <= {LIKE_Z * LIKE_Z} * labelled * share * (1 - share)
             THEN skeleton ELSE template END AS merged FROM pooled),
verdicts AS (
  SELECT host, template, merged,
         (sum(blocked) OVER w + {PRIOR_ROWS * PRIOR_SHARE}) / (sum(labelled) OVER w + {PRIOR_ROWS}) >= {REJECT_SHARE} AS rejected
  FROM judged WINDOW w AS (PARTITION BY host, skeleton, merged))
SELECT page_id, host, path, rule, coalesce(hit, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN hit IS NULL THEN merged END AS template
FROM shaped LEFT JOIN placed USING (host, shape) LEFT JOIN verdicts USING (host, template)
"""


SQL = sql()

#: Labels for the supplied pages that cut across their templates: first digits of page numbers, so that part of a template's
#: pages is known, by rules of one path, and the tree decides the others.
LABELS = (
    *(("com", f"/en/{d}", "block") for d in range(1, 8)), *(("net", f"/en/{d}", "allow") for d in range(1, 6)), ("net", "/en/6", "block"),
    *(("org", f"/{lang}/{d}", "block" if d % 4 else "allow") for lang in ("en", "de") for d in range(1, 8)), ("com", "/fr/1", "block"), ("com", "/fr/2", "allow"),
)
