"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from filegrain.llm import collocations, decontaminate, html_text, langid, mixing, neardup, quality, quotes, secrets, spelling, toxicity, urls, vectors
from filegrain.llm.registry import ORACLES, QUERIES, query, table  # noqa: F401


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_table(table(spark, sf_dir, "documents"))


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_url_filter", urls.SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


@query("url_templates", urls.sql(urls.LABELS))
def url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with labels that leave many pages of a template to the tree."""
    return urls.filter_urls(table(spark, sf_dir, "pages"), rules=urls.LABELS)


@query("page_layouts", html_text.LAYOUT_SQL)
def page_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of pages made of the documents in layouts that mark no article of their own."""
    return html_text.extract_text(html_text.laid_out(table(spark, sf_dir, "documents")))


@query("op7_html_text", html_text.SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


@query("op1_decontamination", decontaminate.SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_near_duplicates", neardup.SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op8_source_mix")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "source"))


@query("op2_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_chat_threads", quotes.sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.linked(table(spark, sf_dir, "conversations"))


@query("chat_threads_quoted", quotes.sql(quotes.QUOTING_SQL))
def chat_threads_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over messages that quote: the supplied ones hold no quotes."""
    return quotes.linked(quotes.quoting(table(spark, sf_dir, "conversations")))


@query("op9_near_vectors", vectors.SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query("near_vectors_recall")
def near_vectors_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.recall_audit(table(spark, sf_dir, "embeddings"))


@query("op13_collocations", collocations.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op12_spelling_variants", spelling.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@query("op11_secrets")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(secrets.find_secrets(table(spark, sf_dir, "documents")))
