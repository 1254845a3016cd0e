"""Evaluation cases and results as files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

TESTSET = (
    "id string, query string, expected_sources array<string>, reference_answer string, category string, expected_content_contains array<string>, "
    "expected_top_result struct<source_contains: string, content_contains: string>, expected_result_count int, max_confidence double"
)


def load_testset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TESTSET).option("multiLine", True).json(path)


def save(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def summary_line(summary: DataFrame, timestamp: str) -> str:
    """A summary (``evaluation.summary``) as one JSON object: the overall means, and those of each category in order of name."""
    rows = [r.asDict() for r in summary.collect()]  # a row a category
    overall = next((r for r in rows if r["category"] is None), {})
    names = ("hit_1", "hit_3", "hit_5", "mrr", "recall_5", "avg_confidence")
    out = {"timestamp": timestamp, "test_count": overall.get("n", 0)} | {n: overall.get(n, 0.0) for n in names}
    return json.dumps(out | {"categories": sorted((r for r in rows if r["category"] is not None), key=lambda r: r["category"])})


def save_summary(summary: DataFrame, path: str, timestamp: str) -> None:
    spark = summary.sparkSession
    spark.createDataFrame([(summary_line(summary, timestamp),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
