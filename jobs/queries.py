"""The jobs as queries: each runs twice into one new folder, and gives all of its output as it then stands; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.functions import trust
from corpusloom.schema import FRAGMENTS_SQL
from corpusloom.session import fresh_folder

from . import rate_sources, refresh_fragments


def job1_refresh_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = fresh_folder(spark, "job1")
    # A glob: the table is one file in some folders and many in others.
    for _ in range(2):
        refresh_fragments.run(spark, f"{sf_dir}/documents*.parquet", f"{at}/fragments", f"{at}/checkpoint")
    return refresh_fragments.current(spark, f"{at}/fragments")


def job2_rate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = fresh_folder(spark, "job2")
    for _ in range(2):
        rate_sources.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", at)
    return rate_sources.read_back(spark, at)


QUERIES = {f.__name__: f for f in (job1_refresh_fragments, job2_rate_sources)}

_C1, _C2 = refresh_fragments.settings(), rate_sources.settings()
_STEP = _C1["passage_words"] - _C1["overlap_words"]
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL = {
    "job1_refresh_fragments": rf"""
WITH d AS (SELECT coalesce(doc_id::VARCHAR, 'sha256:' || sha256(coalesce(text, ''))) AS key, doc_id, source, sha256(coalesce(text, '')) AS checksum,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents QUALIFY row_number() OVER (PARTITION BY key ORDER BY checksum DESC, coalesce(source, '') DESC) = 1),
p AS (SELECT *, unnest(range(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, ceil((len(w) - {_C1["overlap_words"]}) / {_STEP}))::BIGINT END)) AS passage_no FROM d)
SELECT doc_id, source, passage_no, substr(sha256('documents:' || coalesce(source, '') || '/' || key || ':' || passage_no), 1, 16) AS fragment_id,
  array_to_string(w[passage_no * {_STEP} + 1:passage_no * {_STEP} + {_C1["passage_words"]}], ' ') AS content, len(w[passage_no * {_STEP} + 1:passage_no * {_STEP} + {_C1["passage_words"]}]) AS n_tokens, checksum FROM p""",
    "job2_rate_sources": f"""
WITH {FRAGMENTS_SQL},
d AS (SELECT DISTINCT doc_id, source_name, source_path, file_type, content_date, confidence_adj, checksum, raw_content FROM fragments),
s AS (SELECT DISTINCT doc_id, source_name, checksum, line FROM (SELECT doc_id, source_name, checksum, trim(unnest(string_split(coalesce(raw_content, ''), chr(10))), {_BLANKS}) AS line FROM d) WHERE length(line) >= {_C2["least_chars"]}),
n AS (SELECT line, count(DISTINCT coalesce(source_name, '')) AS n FROM s GROUP BY 1),
g AS (SELECT doc_id, source_name, checksum, count(*) AS n_statements, count(*) FILTER (n > 1) AS n_shared, round(avg(n))::BIGINT AS n_sources FROM s JOIN n USING (line) GROUP BY 1, 2, 3),
r AS (SELECT d.doc_id, d.source_name AS source, source_path, d.checksum, coalesce(n_statements, 0) AS n_statements, coalesce(n_shared, 0) AS n_shared, coalesce(n_sources, 0) AS n_sources,
  {trust.freshness_sql("content_date", "file_type", _C2["as_of"])} AS freshness, {trust.corroboration_sql("coalesce(n_sources, 0)")} AS corroboration,
  {trust.consistency_sql("confidence_adj")} AS consistency, {trust.authority_sql("file_type")} AS authority
  FROM d LEFT JOIN g ON d.doc_id IS NOT DISTINCT FROM g.doc_id AND d.source_name IS NOT DISTINCT FROM g.source_name AND d.checksum IS NOT DISTINCT FROM g.checksum),
o AS (SELECT *, {trust.overall_sql("freshness", "corroboration", "consistency", "authority")} AS overall FROM r),
t AS (SELECT source, count(*) AS source_documents, sum(n_statements)::BIGINT AS source_statements, sum(n_shared)::BIGINT AS source_shared, round(avg(overall), 4) AS source_trust FROM o GROUP BY 1)
SELECT o.*, source_documents, source_statements, source_shared, source_trust FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source""",
}
