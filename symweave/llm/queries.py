"""Queries of the problems on text over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symweave.llm import encoding, packing, pagespam, syntax
from symweave.session import stage, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_files(table(spark, d, "sources"))


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.syntax_rates(table(spark, d, "sources"))


def p2_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return syntax.diagnostics_report(table(spark, d, "sources"), table(spark, d, "files"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, d, "documents"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = stage(encoding.encode_corpus(table(spark, d, "documents"), counts_only=True), "sizes")
    return packing.pack(sizes, table(spark, d, "token_budgets"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.container_report(_packed(spark, d), table(spark, d, "token_budgets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pagespam.spam_pages(table(spark, d, "documents"))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return pagespam.page_spam(table(spark, d, "documents"))


QUERIES = {"p9_found": p9_found, "p9_scores": p9_scores, "p2_found": p2_found, "p2_rates": p2_rates, "p2_diagnostics": p2_diagnostics, "p7_ids": p7_ids, "p8_containers": p8_containers, "p8_report": p8_report}
ORACLES: dict[str, str] = {}
