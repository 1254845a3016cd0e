"""An evaluation over a test set: retrieval of every case, its metrics, and their means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import trust
from ..operators import evaluate


def run(cases: DataFrame, rows: DataFrame) -> DataFrame:
    """The metrics of each case. cases: query_id, category, expected_sources, expected_content_contains, expected_top_result (as in
    ``results.TESTSET``); rows: the results of ``plans.query.trusted`` with query_id.

    Besides the metrics of ``evaluate.per_query``: hits (the expected sources that were found), content_match (all expected strings stand
    in the five best results), top_match, and avg_freshness and avg_confidence of the results. As in the reference, a result's
    overall trust counts as its confidence adjustment there."""
    rows = rows.withColumnRenamed("raw_content", "content")
    wanted = cases.select("query_id", F.explode(F.array_distinct("expected_sources")).alias("expected"))
    found = evaluate.relevance(rows.select("query_id", "rank", "source_path"), wanted)
    ranked = found.select("query_id", "rank", (F.size("matches") > 0).alias("relevant"), F.explode_outer("matches").alias("found"))
    each = evaluate.per_query(ranked, cases.select("query_id", "category", F.greatest(F.size(F.array_distinct("expected_sources")), F.lit(0)).alias("n_expected")))
    hits = ranked.groupBy("query_id").agg(F.sort_array(F.collect_set("found")).alias("hits"))
    needles = cases.where(F.size("expected_content_contains") > 0).select("query_id", F.col("expected_content_contains").alias("needles"))
    content = evaluate.content_match(rows, needles).withColumnRenamed("matched", "content_match")
    top = evaluate.top_match(rows, cases.select("query_id", "expected_top_result.source_contains", "expected_top_result.content_contains")).withColumnRenamed("matched", "top_match")
    overall = trust.overall(F.col("freshness"), F.col("corroboration"), trust.consistency(F.col("overall")), F.col("authority"))
    mean = lambda c: trust.round2(F.round(F.avg(c), 9))
    signals = rows.withColumn("again", overall).groupBy("query_id").agg(mean("freshness").alias("avg_freshness"), mean("again").alias("avg_confidence"))
    for more in (hits, content, top, signals):
        each = each.join(more, "query_id", "left")
    return each.withColumn("hits", F.coalesce("hits", F.expr("array()").cast("array<string>"))).fillna(0.0, ["avg_freshness", "avg_confidence"])


def summary(each: DataFrame) -> DataFrame:
    """category (null: overall), n, and the mean of each number."""
    return evaluate.summary(each.drop("hits", "content_match", "top_match"))
