"""The corpus model as Spark schemas, and adapters that view the driver tables as a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.trust import AS_OF

FRAGMENT = (
    "id string, raw_content string, enriched_content string, source_type string, source_name string, source_path string, source_uri string, "
    "content_date timestamp, ingested_at timestamp, author string, file_type string, checksum string, embedding array<float>, confidence_adj double, "
    "enrichment_model string, enrichment_version string, embedding_model string"
)
RAW_DOCUMENT = (
    "path string, content binary, content_date timestamp, author string, source_uri string, source_type string, source_name string, checksum string, "
    "chunks array<struct<content: string, metadata: map<string,string>>>"
)
SOURCE = "source_type string, source_name string, description string, config map<string,string>, last_ingest timestamp, created_at timestamp"
UNIT = (
    "id string, topic string, summary string, fragment_ids array<string>, confidence struct<overall: double, breakdown: struct<freshness: double, "
    "corroboration: double, consistency: double, authority: double>>, centroid array<float>, last_computed timestamp"
)
CACHE = "cache_key string, query_text string, concise boolean, fragment_sigs string, answer_json string, created_at timestamp"
EXTENSIONS = (".md", ".txt", ".go", ".yaml", ".html")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fragment_id(source_type: Column, path: Column, index: Column) -> Column:
    """First 16 hex digits of sha256("type:path:index")."""
    return F.substring(F.sha2(F.concat_ws(":", source_type, path, index.cast("string")), 256), 1, 16)


def content(enriched: str = "enriched_content", raw: str = "raw_content") -> Column:
    """The enriched text where there is one, else the raw text."""
    return F.coalesce(F.nullif(F.col(enriched), F.lit("")), F.col(raw))


def fragments(spark: SparkSession, sf_dir: str, *, labels: bool = True, of: DataFrame | None = None) -> DataFrame:
    """``documents`` as fragments, one to a document; confidence_adj from ``labels``. of: the doc_id of those that are wanted; other
    rows are left out before they are hashed or exchanged."""
    wanted = (lambda rows: rows) if of is None else (lambda rows: rows.join(of.select("doc_id"), "doc_id", "left_semi"))
    return fragments_of(wanted(table(spark, sf_dir, "documents")), wanted(table(spark, sf_dir, "labels")) if labels else None)


def fragments_of(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The same of given tables; without labels confidence_adj is 0."""
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), ext)
    docs = docs.select("doc_id", "text", "lang", "source", ext.alias("file_type"), path.alias("source_path"))
    if labels is not None:
        adj = labels.groupBy("doc_id").agg((F.max("quality") * 0.1 - F.max("toxic") * 0.2).alias("adj"))
        docs = docs.join(adj, "doc_id", "left")
    return docs.select(
        "doc_id",
        fragment_id(F.lit("filesystem"), F.col("source_path"), F.lit(0)).alias("id"),
        F.col("text").alias("raw_content"),
        F.lit("filesystem").alias("source_type"),
        F.col("source").alias("source_name"),
        "source_path",
        (F.lit(AS_OF).cast("timestamp") - F.make_dt_interval((F.col("doc_id") % 400).cast("int"))).alias("content_date"),
        F.col("lang").alias("author"),
        "file_type",
        F.sha2("text", 256).alias("checksum"),
        (F.coalesce("adj", F.lit(0.0)) if labels is not None else F.lit(0.0)).alias("confidence_adj"),
    )


#: The same as a CTE.
FRAGMENTS_SQL = """fragments AS (
  SELECT d.doc_id, substr(sha256('filesystem:' || source_path || ':0'), 1, 16) AS id, text AS raw_content, 'filesystem' AS source_type,
    source AS source_name, source_path, TIMESTAMP '2024-02-01 00:00:00' - to_days(CAST(d.doc_id % 400 AS INTEGER)) AS content_date, lang AS author,
    file_type, sha256(text) AS checksum, coalesce(l.q * 0.1::DOUBLE - l.t * 0.2::DOUBLE, 0.0::DOUBLE) AS confidence_adj
  FROM (SELECT *, source || '/' || doc_id || file_type AS source_path FROM (SELECT *, ['.md', '.txt', '.go', '.yaml', '.html'][doc_id % 5 + 1] AS file_type FROM documents)) d
  LEFT JOIN (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id)"""
