"""Rate the documents and sources of a corpus by trust: a batch job.

    python -m jobs.rate_sources --documents PATH --labels PATH --output PATH [--config FILE]

Who keeps a knowledge base wants to know which sources back each other. A statement is a line of ``least_chars`` characters or more, without
blanks around it. Each distinct statement of a document is looked up in all sources; the mean number of sources that make a
document's statements, rounded, is its corroboration, which with freshness (at ``as_of``), consistency (from the labels) and authority gives its trust.

Output: ``documents`` in folders ``source_key=S``, a row for each distinct (doc_id, source, text), and ``sources``, a row for each source.
Both are written with Spark's overwrite, so a run that was cut off and begins again, or a second run, gives the same rows, and a source that
is gone leaves nothing.

How it scales: statements are exchanged as digests. Sources of a statement are counted after partial aggregation, and only statements of two
sources or more are joined back, in ``salts`` parts each, so that a line that stands everywhere is no task's burden.

Nulls: a null source is a source of its own, a null text has no statement, a null doc_id has no path, kind or date. A document without a
statement has corroboration 0. Repeated rows count once. Other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import trust
from corpusloom.schema import fragments_of

log = logging.getLogger("jobs.rate_sources")
CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "rate_sources.json")
BLANKS = " \t\n\x0b\f\r"
ABOUT = ("doc_id", "source_name", "source_path", "file_type", "content_date", "confidence_adj", "checksum")
RATED = (
    "doc_id bigint, source string, source_path string, checksum string, n_statements bigint, n_shared bigint, n_sources bigint, freshness double, corroboration double, "
    "consistency double, authority double, overall double, source_key string"
)


def settings(path: str | None = None) -> dict:
    with open(path or CONFIG, encoding="utf-8") as f:
        return json.load(f)


def statements(documents: DataFrame, least: int) -> DataFrame:
    """ABOUT and ``statement`` (a digest) of each distinct statement of each document; one null for a document without any."""
    lines = F.transform(F.split(F.coalesce("raw_content", F.lit("")), "\n"), lambda x: F.trim(x, F.lit(BLANKS)))
    digests = F.transform(F.filter(lines, lambda x: F.char_length(x) >= least), lambda x: F.unhex(F.sha2(x, 256)))
    return documents.select(*ABOUT, F.explode_outer(F.array_distinct(digests)).alias("statement")).distinct()


def rate(documents: DataFrame, labels: DataFrame, config: dict) -> DataFrame:
    """The rated documents."""
    said = statements(fragments_of(documents, labels), config["least_chars"])
    shared = said.where("statement is not null").groupBy("statement", F.coalesce("source_name", F.lit("")).alias("s")).agg(F.lit(1).alias("one"))
    shared = shared.groupBy("statement").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.sequence(F.lit(0), F.lit(config["salts"] - 1))
    said = said.withColumn("salt", F.pmod(F.xxhash64("doc_id", "checksum"), F.lit(config["salts"])).cast("int"))
    joined = said.join(shared.withColumn("salt", F.explode(parts)), ["statement", "salt"], "left")
    has = F.col("statement").isNotNull()
    rows = joined.groupBy(*ABOUT).agg(
        F.count("statement").alias("n_statements"),
        F.count("n").alias("n_shared"),
        F.coalesce(F.round(F.avg(F.when(has, F.coalesce("n", F.lit(1)).cast("double")))).cast("long"), F.lit(0)).alias("n_sources"),
    )
    date = F.col("content_date")
    rows = rows.withColumns(
        {
            "freshness": trust.freshness(date, date, F.col("file_type"), config["as_of"]),
            "corroboration": trust.corroboration(F.col("n_sources")),
            "consistency": trust.consistency(F.col("confidence_adj")),
            "authority": trust.authority(F.col("file_type")),
        }
    )
    rows = rows.withColumn("overall", trust.overall(*map(F.col, ("freshness", "corroboration", "consistency", "authority"))))
    return rows.withColumn("source", F.col("source_name")).withColumn("source_key", F.coalesce("source_name", F.lit(""))).select(*(c.split()[0] for c in RATED.split(", ")))


def read_back(spark: SparkSession, output: str) -> DataFrame:
    """The rated documents, with what is said of their sources."""
    of = spark.read.parquet(f"{output}/sources").withColumnRenamed("source", "s")
    rows = spark.read.schema(RATED).parquet(f"{output}/documents").drop("source_key")
    return rows.join(of, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def run(spark: SparkSession, documents: str, labels: str, output: str, config: dict | None = None) -> None:
    """Rate all documents, and write them and their sources."""
    config = config or settings()
    docs, marks = spark.read.parquet(documents), spark.read.parquet(labels)
    log.info("reading %d documents of %s and %d labels of %s", docs.count(), documents, marks.count(), labels)
    # Rebalancing keeps a source's rows together, and cuts a large source into several tasks.
    rate(docs, marks, config).hint("rebalance", "source_key").write.mode("overwrite").partitionBy("source_key").parquet(f"{output}/documents")
    rated = spark.read.schema(RATED).parquet(f"{output}/documents")
    of = rated.groupBy("source").agg(F.count("*").alias("source_documents"), F.sum("n_statements").alias("source_statements"), F.sum("n_shared").alias("source_shared"), F.round(F.avg("overall"), 4).alias("source_trust"))
    of.write.mode("overwrite").parquet(f"{output}/sources")
    log.info("wrote %d documents and %d sources to %s", rated.count(), spark.read.parquet(f"{output}/sources").count(), output)


def main() -> None:
    args = argparse.ArgumentParser(description="Rate the documents and sources of a corpus by trust.")
    for name in ("documents", "labels", "output"):
        args.add_argument(f"--{name}", required=True)
    args.add_argument("--config")
    given = args.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("rate_sources").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, given.documents, given.labels, given.output, settings(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
