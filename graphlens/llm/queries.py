"""Queries p2, p6, p7, p8 and p9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.llm import bpe, docpairs, leaks, reading, syntax
from graphlens.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.check_files(table(spark, d, "source_files"), ["file_id"]).filter("valid = false").select("file_id").distinct()


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "source_files")
    return syntax.rates(syntax.check_files(files, ["file_id", "repo"]).distinct(), ["repo", "language"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.doc_pairs(table(spark, d, "source_files")).select("file_id", "qualname", "def_line").distinct()


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter(F.col("doc_kind").isin("guide", "adr", "issue", "runbook", "faq") & (F.col("lang") == "en"))
    return reading.reading_levels(docs, table(spark, d, "reading_labels"))


QUERIES = {"p2_found": p2_found, "p2_rates": p2_rates, "p6_found": p6_found, "p7_ids": p7_ids, "p8_found": p8_found, "p9_found": p9_found}
ORACLE: dict[str, str] = {}
