"""The library's registered queries over the driver tables, and the same results as SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import models
from .functions import text as X
from .functions import trust
from .operators import cluster, digests, evaluate, fusion, pivots, search, selection, storage, vector
from .plans import cache as answers
from .plans import corpus, enrichment, evaluation
from .plans import query as plans
from .plans.store import Store
from .schema import FRAGMENTS_SQL, fragment_id, fragments, table
from .session import fresh_folder, written
from .sources import chunking, files, messages, tree
from .streaming import state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# Ids, checksums, sources.


@query("SELECT doc_id, substr(sha256('filesystem:' || source || '/' || doc_id || '.txt:0'), 1, 16) AS fragment_id FROM documents")
def fragment_ids(spark, sf):
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf, "documents").select("doc_id", fragment_id(F.lit("filesystem"), path, F.lit(0)).alias("fragment_id"))


@query(f"WITH {FRAGMENTS_SQL} SELECT id, source_type, source_name, source_path, content_date, author, file_type, checksum, round(confidence_adj, 6) AS confidence_adj FROM fragments")
def fragments_view(spark, sf):
    return fragments(spark, sf).select("id", "source_type", "source_name", "source_path", "content_date", "author", "file_type", "checksum", F.round("confidence_adj", 6).alias("confidence_adj"))


@query("SELECT doc_id, sha256(text) AS checksum FROM documents")
def doc_checksums(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"))


@query("SELECT sha256(text) AS checksum, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf):
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("checksum")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("SELECT 'filesystem/' || source AS source, count(*) AS n FROM documents GROUP BY 1")
def source_counts(spark, sf):
    return table(spark, sf, "documents").groupBy(F.concat_ws("/", F.lit("filesystem"), "source").alias("source")).agg(F.count("*").alias("n"))


@query("SELECT source, sum(length(text))::BIGINT AS chars, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY 1")
def source_sizes(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes"))


@query("""SELECT s.source, s.n, s.chars, coalesce(l.labelled, 0) AS labelled, s.langs FROM
  (SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars, count(DISTINCT lang) AS langs FROM documents GROUP BY 1) s LEFT JOIN
  (SELECT source, count(*) AS labelled FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1) l ON s.source IS NOT DISTINCT FROM l.source""")
def source_overview(spark, sf):
    docs = table(spark, sf, "documents")
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.countDistinct("lang").alias("langs"))
    labelled = docs.join(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi").groupBy(F.col("source").alias("s")).agg(F.count("*").alias("labelled"))
    return sizes.join(labelled, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "n", "chars", F.coalesce("labelled", F.lit(0)).alias("labelled"), "langs")


@query("SELECT count(*) AS n FROM documents")
def table_count(spark, sf):
    return table(spark, sf, "documents").agg(F.count("*").alias("n"))


# Change detection, upserts, deletes, the registry.


def _scans(spark, sf):
    docs = table(spark, sf, "documents")
    row = lambda d, checksum: d.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source_path"), checksum.alias("checksum"))
    known = row(docs.where("doc_id % 10 <> 0"), F.sha2("text", 256))
    changed = F.when(F.col("doc_id") % 7 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256))
    return row(docs.where("doc_id % 11 <> 0"), changed), known


@query("""WITH known AS (SELECT source || '/' || doc_id AS p, sha256(text) AS c FROM documents WHERE doc_id % 10 <> 0),
  seen AS (SELECT source || '/' || doc_id AS p, CASE WHEN doc_id % 7 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS c FROM documents WHERE doc_id % 11 <> 0)
  SELECT s.p AS source_path, CASE WHEN k.c = s.c THEN 'unchanged' ELSE 'changed' END AS state FROM seen s LEFT JOIN known k ON s.p = k.p
  UNION ALL SELECT p, 'deleted' FROM known WHERE p NOT IN (SELECT p FROM seen)""")
def changed_deleted_unchanged(spark, sf):
    return storage.changes(*_scans(spark, sf))


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN text || ' v2' ELSE text END AS content FROM documents
  UNION ALL SELECT doc_id + 100000000, text FROM documents WHERE doc_id % 50 = 1""")
def upsert_merge(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    new = docs.where("id % 5 = 0").withColumn("content", F.concat("content", F.lit(" v2")))
    return storage.upsert(docs, new.unionByName(docs.where("id % 50 = 1").withColumn("id", F.col("id") + 100000000)))


@query("""SELECT source || '/' || (doc_id // 4) AS source_path, doc_id AS version, n_chars FROM documents WHERE (doc_id // 4) % 6 <> 0
  UNION ALL SELECT DISTINCT source || '/' || (doc_id // 4), -1, 0 FROM documents WHERE (doc_id // 4) % 6 = 0""")
def replace_changed_paths(spark, sf):
    docs = table(spark, sf, "documents")
    path = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 4).cast("string"))
    rows = docs.select(path.alias("source_path"), F.col("doc_id").alias("version"), "n_chars")
    new = docs.where(F.floor(F.col("doc_id") / 4) % 6 == 0).select(path.alias("source_path"), F.lit(-1).cast("long").alias("version"), F.lit(0).cast("long").alias("n_chars")).distinct()
    return storage.replace_paths(rows, new)


@query(f"WITH {FRAGMENTS_SQL} SELECT id, source_path FROM fragments WHERE NOT (doc_id % 3 = 0 AND source_name = 'src1') AND NOT (doc_id % 13 = 0)")
def delete_by_paths(spark, sf):
    rows = fragments(spark, sf, labels=False)
    gone = rows.where("doc_id % 3 = 0 AND source_name = 'src1'").select("source_type", "source_name", "source_path")
    every = rows.where("doc_id % 13 = 0").select("source_type", F.lit("").alias("source_name"), "source_path")
    return storage.delete_paths(rows, gone.unionByName(every)).select("id", "source_path")


@query(f"WITH {FRAGMENTS_SQL} SELECT id, source_name FROM fragments WHERE NOT (source_type = 'filesystem' AND source_name = 'src0')")
def delete_by_source(spark, sf):
    return storage.delete_source(fragments(spark, sf, labels=False), "filesystem", "src0").select("id", "source_name")


@query("""WITH a AS (SELECT DISTINCT 'filesystem' AS source_type, source AS source_name, 'all of ' || source AS description FROM documents WHERE source IS NOT NULL),
  b AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN 'filesystem' ELSE 'web' END AS source_type, source AS source_name FROM documents WHERE source IS NOT NULL),
  c AS (SELECT *, CASE WHEN source_name < 'src2' THEN '' ELSE 'new ' || source_name END AS description FROM b)
  SELECT coalesce(c.source_type, a.source_type) AS source_type, coalesce(c.source_name, a.source_name) AS source_name, coalesce(nullif(c.description, ''), a.description, '') AS description
  FROM a FULL JOIN c ON a.source_type = c.source_type AND a.source_name = c.source_name""")
def source_registry_upsert(spark, sf):
    docs = table(spark, sf, "documents").where("source IS NOT NULL")
    config = F.create_map(F.lit("root"), F.col("source_name")).alias("config")
    old = docs.select(F.lit("filesystem").alias("source_type"), F.col("source").alias("source_name")).distinct().select("*", F.concat(F.lit("all of "), "source_name").alias("description"), config)
    new = docs.select(F.when(F.col("doc_id") % 2 == 0, "filesystem").otherwise("web").alias("source_type"), F.col("source").alias("source_name")).distinct()
    new = new.select("*", F.when(F.col("source_name") < "src2", "").otherwise(F.concat(F.lit("new "), "source_name")).alias("description"), config)
    return storage.register(old, new).drop("config")


@query("""SELECT source_type, source_name, CASE WHEN bool_or(kept) THEN 'stored' ELSE 'file' END AS came_from FROM
  (SELECT 'filesystem' AS source_type, source AS source_name, true AS kept FROM documents WHERE source < 'src15'
   UNION ALL SELECT 'filesystem', source, false FROM documents WHERE source > 'src12') WHERE source_name IS NOT NULL GROUP BY 1, 2""")
def sources_merge(spark, sf):
    docs = table(spark, sf, "documents").select(F.lit("filesystem").alias("source_type"), F.col("source").alias("source_name")).distinct()
    return storage.merge_sources(docs.where("source_name < 'src15'").withColumn("came_from", F.lit("stored")), docs.where("source_name > 'src12'").withColumn("came_from", F.lit("file")))


@query("SELECT source, arg_max(sha256(text), doc_id) AS checksum FROM documents GROUP BY 1")
def checksum_map(spark, sf):
    return storage.latest(table(spark, sf, "documents").withColumn("checksum", F.sha2("text", 256)), ["source"], "checksum", ["doc_id"])


@query(f"WITH {FRAGMENTS_SQL} SELECT id, source_path, row_number() OVER (ORDER BY source_path, id) AS place FROM fragments WHERE source_name = 'src3'")
def fragments_by_source(spark, sf):
    rows = fragments(spark, sf, labels=False).where("source_name = 'src3'")
    return rows.select("id", "source_path", F.row_number().over(Window.partitionBy("source_name").orderBy("source_path", "id")).cast("long").alias("place"))


@query(f"WITH {FRAGMENTS_SQL} SELECT id, source_path FROM fragments WHERE id IN (SELECT substr(sha256('filesystem:' || source || '/' || doc_id || '.md:0'), 1, 16) FROM documents WHERE doc_id % 50 = 0)")
def fragments_by_ids(spark, sf):
    docs = table(spark, sf, "documents").where("doc_id % 50 = 0")
    ids = docs.select(fragment_id(F.lit("filesystem"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")), F.lit(0)).alias("id"))
    return fragments(spark, sf, labels=False).join(ids, "id", "left_semi").select("id", "source_path")


@query("SELECT vec_id, label, len(embedding)::BIGINT AS dim, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 5) AS squared FROM embeddings WHERE embedding IS NOT NULL")
def export_embeddings(spark, sf):
    rows = table(spark, sf, "embeddings").where("embedding IS NOT NULL")
    squared = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.select("vec_id", "label", F.size("embedding").cast("long").alias("dim"), F.round(squared, 5).alias("squared"))


@query("SELECT vec_id, array_to_string(list_transform(embedding, lambda x: printf('%.6f', x::DOUBLE)), chr(9)) AS line FROM embeddings")
def tsv_export(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", storage.tsv_line(F.col("embedding")).alias("line"))


@query("SELECT doc_id, translate(text, chr(9) || chr(10) || chr(13), '   ') AS text FROM documents")
def tsv_metadata(spark, sf):
    return table(spark, sf, "documents").select("doc_id", storage.tsv_text(F.col("text")).alias("text"))


@query("SELECT doc_id, json_object('doc_id', doc_id, 'source', source, 'text', text)::VARCHAR AS json FROM documents WHERE source IS NOT NULL AND text IS NOT NULL")
def json_export(spark, sf):
    rows = table(spark, sf, "documents").where("source IS NOT NULL AND text IS NOT NULL")
    return rows.select("doc_id", F.to_json(F.struct("doc_id", "source", "text")).alias("json"))


@query("SELECT vec_id, label, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings WHERE embedding IS NOT NULL")
def vector_round_trip(spark, sf):
    """Vectors as 32-bit floats in bytes, in JSON, and back."""
    from pyspark.sql import types as T

    rows = table(spark, sf, "embeddings").where("embedding IS NOT NULL")
    rows = rows.select("vec_id", F.to_json(F.struct("label", F.base64(models.vector_bytes(F.col("embedding"))).alias("v"))).alias("json"))
    back = F.from_json("json", T.StructType([rows.sparkSession.read.parquet(f"{sf}/embeddings.parquet").schema["label"], T.StructField("v", T.StringType())]))
    rows = rows.select("vec_id", back.alias("r")).select("vec_id", "r.label", models.bytes_vector(F.unbase64("r.v")).alias("v"))
    return rows.select("vec_id", "label", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"))


@query(r"""SELECT DISTINCT source, CASE WHEN k % 6 = 0 THEN 'Git repository: ' WHEN k % 6 = 1 THEN 'Local directory: ' WHEN k % 6 = 2 THEN 'Confluence space: ' WHEN k % 6 = 3 THEN 'Slack channels: ' WHEN k % 6 = 4 THEN 'GitHub wiki: ' ELSE 'web: ' END || source AS label,
  regexp_matches(upper(t), 'KEY|SECRET|TOKEN') AS masked, regexp_replace('sub/' || source || '.page.md', '\.[^./]*$', '') AS page FROM (SELECT source, doc_id % 6 AS k, CASE WHEN doc_id % 2 = 0 THEN 'api_key_' || source ELSE 'path' END AS t FROM documents WHERE source IS NOT NULL)""")
def source_labels(spark, sf):
    kinds = F.array(*map(F.lit, ("git", "filesystem", "confluence", "slack", "github_wiki", "web")))
    docs = table(spark, sf, "documents").where("source IS NOT NULL")
    key = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("api_key_"), "source")).otherwise("path")
    page = files.wiki_page(F.concat(F.lit("sub/"), "source", F.lit(".page.md")))
    return docs.select("source", X.source_label(F.element_at(kinds, (F.col("doc_id") % 6 + 1).cast("int")), F.col("source")).alias("label"), X.is_secret(key).alias("masked"), page.alias("page")).distinct()


# Trust.

_EXT = "['.md', '.GO', '.txt', '.yaml', '.html', '.pdf', ''][event_id % 7 + 1]"
_DATE = "CASE WHEN event_id % 17 = 0 THEN NULL ELSE ts END"
_ADJ = "(event_id % 15 - 7) * 0.1::DOUBLE"


@query(
    f"SELECT event_id, f AS freshness, c AS corroboration, s AS consistency, a AS authority, {trust.overall_sql('f', 'c', 's', 'a')} AS overall FROM (SELECT event_id, "
    f"{trust.freshness_sql(f'({_DATE})', _EXT)} AS f, {trust.corroboration_sql('(event_id % 7)')} AS c, {trust.consistency_sql(_ADJ)} AS s, {trust.authority_sql(_EXT)} AS a FROM events)"
)
def trust_matrix(spark, sf):
    ext = F.element_at(F.array(*map(F.lit, (".md", ".GO", ".txt", ".yaml", ".html", ".pdf", ""))), (F.col("event_id") % 7 + 1).cast("int"))
    date = F.when(F.col("event_id") % 17 != 0, F.col("ts").cast("timestamp"))
    out = table(spark, sf, "events").select(
        "event_id",
        trust.freshness(date, F.lit(None).cast("timestamp"), ext).alias("freshness"),
        trust.corroboration(F.col("event_id") % 7).alias("corroboration"),
        trust.consistency((F.col("event_id") % 15 - 7) * F.lit(0.1)).alias("consistency"),
        trust.authority(ext).alias("authority"),
    )
    return out.withColumn("overall", trust.overall(*map(F.col, out.columns[1:])))


# Vectors.

_NEAR = """near AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, round(list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS distance,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6), v.vec_id) AS rank
  FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0)"""


def _vector_queries(spark, sf):
    return table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(f"WITH {_NEAR} SELECT query_id, vec_id, distance, rank FROM near WHERE rank <= 10")
def knn_topk(spark, sf):
    return vector.knn(table(spark, sf, "embeddings"), _vector_queries(spark, sf), 10)


@query(f"WITH {_NEAR} SELECT query_id, vec_id, distance, rank FROM near WHERE rank <= 10")
def knn_by_pivots(spark, sf):
    index = pivots.build(table(spark, sf, "embeddings"), fresh_folder(spark, "pivots-index"))
    return pivots.knn(index, _vector_queries(spark, sf), 10)


@query(f"WITH {_NEAR}, kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS r FROM near WHERE rank <= 50 AND label IN (1, 2)) SELECT query_id, vec_id, distance, r AS rank FROM kept WHERE r <= 10")
def knn_filtered_overfetch(spark, sf):
    return vector.knn_filtered(table(spark, sf, "embeddings"), _vector_queries(spark, sf), 10, F.col("label").isin(1, 2))


@query(f"WITH {_NEAR}, kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS r FROM near WHERE label IN (1, 2)) SELECT query_id, vec_id, distance, r AS rank FROM kept WHERE r <= 10")
def knn_filtered_exact(spark, sf):
    return vector.knn_filtered(table(spark, sf, "embeddings"), _vector_queries(spark, sf), 10, F.col("label").isin(1, 2), exact=True)


@query("""WITH topic AS (SELECT embedding::DOUBLE[] AS t FROM embeddings WHERE vec_id = 0),
  q AS (SELECT vec_id AS query_id, list_transform(range(1, len(t) + 1), lambda i: embedding[i]::DOUBLE + 0.3::DOUBLE * t[i]) AS raw FROM embeddings, topic WHERE vec_id % 50 = 0),
  b AS (SELECT query_id, list_transform(raw, lambda x: x / sqrt(list_sum(list_transform(raw, lambda y: y * y)))) AS v FROM q),
  d AS (SELECT query_id, vec_id, round(list_distance(b.v, e.embedding::DOUBLE[]), 6) AS distance FROM b, embeddings e)
  SELECT query_id, vec_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) WHERE rank <= 5""")
def topic_blend_knn(spark, sf):
    topic = table(spark, sf, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("topic")).limit(1)
    asked = _vector_queries(spark, sf).crossJoin(F.broadcast(topic)).select("query_id", vector.blend(F.col("embedding"), F.col("topic"), 0.3).alias("embedding"))
    return vector.knn(table(spark, sf, "embeddings"), asked, 5)


@query("SELECT vec_id, round(list_sum(list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y))))), 6) AS total FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def vector_normalised(spark, sf):
    v = vector.normalise(F.col("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


# Full text.

_TOKENS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"


_ASKED = f"SELECT item_id AS query_id, {_TOKENS} AS t FROM benchmark"


def _bm25_sql(keep: str, limit: int, name: str = "bm25", asked: str = _ASKED) -> str:
    """CTEs that end in ``name``(query_id, doc_id, score, rank). asked: query_id and all tokens t of each query."""
    return f"""q AS (SELECT query_id, list_distinct(t) AS w FROM ({asked})),
  qt AS (SELECT query_id, len(w) AS n_phrases, unnest(w) AS term FROM q WHERE len(w) > 0),
  d AS (SELECT doc_id, source, {_TOKENS} AS t FROM documents),
  tot AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM d),
  p AS (SELECT doc_id, source, len(t) AS dl, unnest(t) AS term FROM d),
  tf AS (SELECT doc_id, source, dl, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  s AS (SELECT query_id, doc_id, n_phrases, count(*) AS n, round(sum(CASE WHEN ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) > 0 THEN ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) ELSE 1e-6::DOUBLE END
    * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
    FROM qt JOIN tf USING (term) JOIN df USING (term), tot WHERE {keep} GROUP BY ALL),
  {name} AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE n = n_phrases QUALIFY rank <= {limit})"""


def _text_queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(search.tokens(F.col("text")), " ").alias("query"))


@query(f"WITH {_bm25_sql('true', 10)} SELECT * FROM bm25")
def bm25_topk(spark, sf):
    return search.bm25(table(spark, sf, "documents"), _text_queries(spark, sf), 10)


_PAIRS = f"SELECT item_id * 1000000 + i AS query_id, t[i:i + 1] AS t FROM (SELECT item_id, t, unnest(range(1, len(t))) AS i FROM (SELECT item_id, {_TOKENS} AS t FROM benchmark))"


def _pair_queries(spark, sf):
    """Each two neighbouring words of each item."""
    words = table(spark, sf, "benchmark").select("item_id", search.tokens(F.col("text")).alias("t")).where(F.size("t") > 1)
    each = words.select("item_id", "t", F.explode(F.sequence(F.lit(1), F.size("t") - 1)).alias("i"))
    return each.select((F.col("item_id") * 1000000 + F.col("i")).alias("query_id"), F.concat_ws(" ", F.element_at("t", F.col("i")), F.element_at("t", F.col("i") + 1)).alias("query"))


@query(f"WITH {_bm25_sql('true', 10, asked=_PAIRS)} SELECT * FROM bm25")
def bm25_pairs(spark, sf):
    return search.bm25(table(spark, sf, "documents"), _pair_queries(spark, sf), 10)


_KEEP = "source IN ('src1', 'src2', 'src3')"


@query(f"WITH {_bm25_sql(_KEEP, 10)} SELECT * FROM bm25")
def bm25_filtered(spark, sf):
    return search.bm25(table(spark, sf, "documents"), _text_queries(spark, sf), 10, keep=F.coalesce(F.col("source").isin("src1", "src2", "src3"), F.lit(False)))


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf, max(dl)::BIGINT AS longest FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)) GROUP BY 1")
def inverted_index_terms(spark, sf):
    return search.postings(table(spark, sf, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"), F.max("dl").alias("longest"))


@query("""SELECT item_id, array_to_string(list_filter(list_transform(regexp_split_to_array(trim('say "' || text || '" now'), '\\s+'), lambda w: replace(w, '"', '')), lambda w: w <> ''), '|') AS words FROM benchmark""")
def query_sanitised(spark, sf):
    asked = F.concat(F.lit('say "'), "text", F.lit('" now'))
    return table(spark, sf, "benchmark").select("item_id", F.array_join(search.query_words(asked), "|").alias("words"))


@query("SELECT source, count(*) AS n FROM documents WHERE source IN ('src1', 'src5') AND 'filesystem' IN ('filesystem', 'web') GROUP BY 1")
def source_filtered(spark, sf):
    rows = fragments(spark, sf, labels=False).where(search.source_filter(["src1", "src5"], ["filesystem", "web"]))
    return rows.groupBy(F.col("source_name").alias("source")).agg(F.count("*").alias("n"))


# Fusion and queries.

_VEC = """vec AS (SELECT q.item_id AS query_id, v.vec_id AS doc_id, row_number() OVER (PARTITION BY q.item_id
  ORDER BY round(list_distance(e.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6), v.vec_id) AS rank FROM benchmark q JOIN embeddings e ON e.vec_id = q.item_id, embeddings v QUALIFY rank <= 20)"""
_FUSED = f"""{_bm25_sql('true', 20)}, {_VEC},
  rrf AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT query_id, doc_id, rank FROM bm25 UNION ALL SELECT * FROM vec) GROUP BY 1, 2),
  fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM rrf QUALIFY rank <= 20)"""


def _embedded(spark, sf, asked):
    """asked with the embedding of its query_id. Embeddings of others are left out before any exchange."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return asked.join(vectors.join(asked.select("query_id"), "query_id", "left_semi"), "query_id", "left")


def _hybrid(spark, sf, limit: int = 20, **options):
    asked = _embedded(spark, sf, _text_queries(spark, sf))
    docs = table(spark, sf, "documents").withColumnRenamed("text", "raw_content").withColumnRenamed("source", "source_name")
    return plans.hybrid(docs, asked, limit, vectors=table(spark, sf, "embeddings"), **options)


@query(f"WITH {_FUSED} SELECT query_id, doc_id, score, rank FROM fused")
def rrf_hybrid(spark, sf):
    return _hybrid(spark, sf)


_TRUSTED = f"""{_FUSED}, {FRAGMENTS_SQL},
  r AS (SELECT f.query_id, f.rank, g.* FROM fused f JOIN fragments g ON f.doc_id = g.doc_id),
  sig AS (SELECT r.*, {trust.freshness_sql('content_date', 'file_type')} AS freshness, n.c AS corroboration, {trust.consistency_sql('confidence_adj')} AS consistency, {trust.authority_sql('file_type')} AS authority
    FROM r JOIN (SELECT query_id, {trust.corroboration_sql('count(DISTINCT source_name)')} AS c FROM r GROUP BY 1) n ON r.query_id = n.query_id),
  trusted AS (SELECT *, {trust.overall_sql('freshness', 'corroboration', 'consistency', 'authority')} AS overall FROM sig)"""


def _trusted(spark, sf, *more):
    ranked = written(_hybrid(spark, sf), "ranked")
    return plans.trusted(ranked, fragments(spark, sf, of=ranked), more=more)


@query(f"WITH {_TRUSTED} SELECT query_id, rank, id, source_path, freshness, corroboration, consistency, authority, overall FROM trusted")
def raw_query_trust(spark, sf):
    return _trusted(spark, sf).select("query_id", "rank", "id", "source_path", "freshness", "corroboration", "consistency", "authority", "overall")


@query(SQL["raw_query_trust"])
def hybrid_query(spark, sf):
    return raw_query_trust(spark, sf)


@query(f"""WITH {_TRUSTED}, m AS (SELECT query_id, round(round(avg(freshness), 9) * 100) / 100 AS freshness, max(corroboration) AS corroboration, round(round(avg(consistency), 9) * 100) / 100 AS consistency,
  round(round(avg(authority), 9) * 100) / 100 AS authority FROM trusted GROUP BY 1) SELECT *, {trust.overall_sql('freshness', 'corroboration', 'consistency', 'authority')} AS overall FROM m""")
def answer_confidence(spark, sf):
    return plans.answer_confidence(_trusted(spark, sf))


@query(f"""WITH {_TRUSTED}, m AS (SELECT query_id, max(freshness) AS freshness, {trust.corroboration_sql('count(DISTINCT source_name)')} AS corroboration, round(round(avg(consistency), 9) * 100) / 100 AS consistency,
  max(authority) AS authority FROM trusted WHERE rank <= 5 GROUP BY 1) SELECT *, {trust.overall_sql('freshness', 'corroboration', 'consistency', 'authority')} AS overall FROM m""")
def local_query(spark, sf):
    return plans.local(_trusted(spark, sf))


_VEC_KEPT = _VEC.replace("rank <= 20)", "rank <= 100)").replace("vec AS", "far AS") + f""",
  near AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id) AS place FROM far WHERE doc_id IN (SELECT doc_id FROM documents WHERE {_KEEP})),
  vec AS (SELECT query_id, doc_id, place AS rank FROM near WHERE place <= 20)"""


@query(f"""WITH {_bm25_sql(_KEEP, 20)}, {_VEC_KEPT}, rrf AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT query_id, doc_id, rank FROM bm25 UNION ALL SELECT * FROM vec) GROUP BY 1, 2)
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM rrf QUALIFY rank <= 20""")
def hybrid_filtered(spark, sf):
    """Hybrid retrieval among some sources: the filter holds for words and for vectors."""
    return _hybrid(spark, sf, keep=search.source_filter(["src1", "src2", "src3"]) & F.col("source_name").isNotNull())


_EXPANDED = f"""lists AS (SELECT item_id, 0 AS n, {_TOKENS} AS t, item_id AS vec FROM benchmark UNION ALL SELECT item_id, 1, t[len(t) // 2 + 1:], item_id + 1 FROM (SELECT item_id, {_TOKENS} AS t FROM benchmark)),
  topic AS (SELECT embedding::DOUBLE[] AS t FROM embeddings WHERE vec_id = 0),
  raw AS (SELECT item_id * 8 + n AS query_id, list_transform(range(1, len(topic.t) + 1), lambda i: embedding[i]::DOUBLE + 0.3::DOUBLE * topic.t[i]) AS r FROM lists JOIN embeddings ON vec_id = vec, topic),
  asked AS (SELECT query_id, list_transform(r, lambda x: x / sqrt(list_sum(list_transform(r, lambda y: y * y)))) AS v FROM raw),
  near AS (SELECT query_id, vec_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_distance(v, embedding::DOUBLE[]), 6), vec_id) AS rank FROM asked, embeddings QUALIFY rank <= 20)"""


@query(f"""WITH {_EXPANDED}, {_bm25_sql('true', 20, asked='SELECT item_id * 8 + n AS query_id, t FROM lists')}, rrf AS (SELECT query_id // 8 AS query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT query_id, doc_id, rank FROM bm25 UNION ALL SELECT * FROM near) GROUP BY 1, 2)
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM rrf QUALIFY rank <= 20""")
def hybrid_expanded(spark, sf):
    """Hybrid retrieval of each question and its second half, with a topic."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    words = search.tokens(F.col("text"))
    half = F.array_join(F.slice(words, (F.floor(F.size(words) / 2) + 1).cast("int"), F.greatest(F.size(words), F.lit(1))), " ")
    more = table(spark, sf, "benchmark").select(F.col("item_id").alias("asked"), (F.col("item_id") + 1).alias("query_id"), half.alias("query"))
    more = _embedded(spark, sf, more).select(F.col("asked").alias("query_id"), F.lit(1).alias("n"), "query", "embedding")
    topic = vectors.where("query_id = 0").select("embedding").limit(1)
    topics = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id")).distinct().crossJoin(F.broadcast(topic))
    return _hybrid(spark, sf, expansions=more, topics=topics)


_USED = f"""{_TRUSTED}, used AS (SELECT * FROM trusted WHERE query_id % 3 = 0 OR rank IN (1, 3)), m AS (SELECT query_id, round(round(avg(freshness), 9) * 100) / 100 AS freshness, {trust.corroboration_sql('count(DISTINCT source_name)')} AS corroboration,
  round(round(avg(consistency), 9) * 100) / 100 AS consistency, round(round(avg(authority), 9) * 100) / 100 AS authority, string_agg(id, ',' ORDER BY CASE WHEN query_id % 3 = 0 THEN rank ELSE -rank END) AS sources FROM used GROUP BY 1)"""


def _said(rows):
    """Answers that cite the third and the first result, before older metadata; of every third question such that cite nothing known."""
    by = rows.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("id"))).alias("a"), F.max(F.when(F.col("rank") == 3, F.col("id"))).alias("b"))
    ids = F.concat(F.lit("["), F.coalesce("b", F.lit("")), F.lit("] and ["), "a", F.lit("] ---KB_META--- {} [ffffffffffffffff]"))
    return by.select("query_id", F.concat(F.lit(" See "), F.when(F.col("query_id") % 3 == 0, "[0123456789abcdef]").otherwise(ids)).alias("answer"))


@query(f"""WITH {_USED}, c AS (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN ' See [0123456789abcdef]' ELSE 'See [' || coalesce(max(CASE WHEN rank = 3 THEN id END), '') || '] and [' || max(CASE WHEN rank = 1 THEN id END) || ']' END AS content FROM trusted GROUP BY 1)
  SELECT item_id AS query_id, CASE WHEN m.query_id IS NULL THEN 'I don''t have any relevant information to answer this question.' ELSE content END AS content, coalesce(sources, '') AS sources, coalesce(freshness, 0) AS freshness, coalesce(corroboration, 0) AS corroboration,
  coalesce(consistency, 0) AS consistency, coalesce(authority, 0) AS authority, CASE WHEN m.query_id IS NULL THEN 0 ELSE {trust.overall_sql('freshness', 'corroboration', 'consistency', 'authority')} END AS overall
  FROM benchmark LEFT JOIN m ON item_id = m.query_id LEFT JOIN c ON item_id = c.query_id""")
def answer_assembled(spark, sf):
    """Answers with sources and trust: of the cited fragments, of all where none is cited, and of nothing."""
    rows = _trusted(spark, sf).persist()
    out = plans.assembled(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id")), rows, _said(rows))
    return out.withColumn("sources", F.array_join(F.transform("sources", lambda x: x["id"]), ",")).drop("contradictions")


@query(f"""WITH {_TRUSTED}, g AS (SELECT query_id, source_name, count(*) AS n, min(rank) AS first, list(id ORDER BY rank) AS l FROM trusted GROUP BY 1, 2), shown AS (SELECT query_id, flatten(list(l ORDER BY -n, first)) AS l FROM g GROUP BY 1)
  SELECT query_id, unnest(l[1:2]) AS id, unnest(range(len(l[1:2]))) AS pos FROM shown""")
def answered_query(spark, sf):
    """Answers of an offline model that cites the first two fragments of its prompt, with the fragments it cites."""
    rows = _trusted(spark, sf).persist()

    def model(prompt: str) -> str:
        import re

        return "From " + " ".join(re.findall(r"^\[[a-f0-9]{16}\]", prompt, re.M)[:2])

    return plans.cited(plans.answered(rows, model), rows).withColumn("pos", F.col("pos").cast("long"))


_RUN = f"""{_TRUSTED}, cases AS (SELECT item_id AS query_id, 'c' || (item_id % 3) AS category, [a.doc_id || a.file_type, b.source_path] AS e, CASE WHEN item_id % 2 = 0 THEN 'SRC1' ELSE '' END AS top FROM benchmark JOIN fragments a ON a.doc_id = item_id JOIN fragments b ON b.doc_id = item_id + 1),
  m AS (SELECT c.query_id, t.rank, x.e, coalesce(t.source_path = x.e OR ends_with(t.source_path, '/' || x.e), false) AS hit FROM (SELECT query_id, unnest(e) AS e FROM cases) x JOIN cases c ON c.query_id = x.query_id LEFT JOIN trusted t ON t.query_id = c.query_id),
  results AS (SELECT query_id, rank, bool_or(hit) AS hit FROM m GROUP BY 1, 2),
  k AS (SELECT query_id, min(CASE WHEN hit THEN rank END) AS first, {', '.join(f'sum(CASE WHEN hit AND rank <= {k} THEN 1 ELSE 0 END) AS good_{k}, sum(CASE WHEN rank <= {k} THEN 1 ELSE 0 END) AS top_{k}' for k in evaluate.KS)} FROM results GROUP BY 1),
  f AS (SELECT query_id, {', '.join(f'count(DISTINCT CASE WHEN hit AND rank <= {k} THEN e END) AS found_{k}' for k in evaluate.KS)}, coalesce(string_agg(DISTINCT CASE WHEN hit THEN e END, ',' ORDER BY CASE WHEN hit THEN e END), '') AS hits FROM m GROUP BY 1),
  trust AS (SELECT query_id, round(round(avg(freshness), 9) * 100) / 100 AS avg_freshness, round(round(avg(again), 9) * 100) / 100 AS avg_confidence FROM (SELECT *, {trust.overall_sql('freshness', 'corroboration', trust.consistency_sql('overall'), 'authority')} AS again FROM trusted) GROUP BY 1),
  one AS (SELECT query_id, lower(source_path) AS p FROM trusted WHERE rank = 1)"""


@query(f"""WITH {_RUN} SELECT c.query_id, category, {', '.join(f'round(found_{k} / 2.0::DOUBLE, 6) AS recall_{k}, CASE WHEN top_{k} = 0 THEN 0 ELSE round(good_{k}::DOUBLE / top_{k}, 6) END AS precision_{k}' for k in evaluate.KS)},
  round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, {', '.join(f'CASE WHEN first <= {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_{k}' for k in evaluate.HITS)}, hits, coalesce(avg_freshness, 0) AS avg_freshness, coalesce(avg_confidence, 0) AS avg_confidence,
  CASE WHEN top <> '' THEN coalesce(contains(p, lower(top)), false) END AS top_match FROM cases c JOIN k USING (query_id) JOIN f USING (query_id) LEFT JOIN trust USING (query_id) LEFT JOIN one USING (query_id)""")
def eval_run(spark, sf):
    """An evaluation run: every benchmark item as a case, with the files it expects."""
    rows = fragments(spark, sf, labels=False)
    name = F.concat(F.col("doc_id").cast("string"), "file_type")
    cases = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    cases = cases.join(rows.select(F.col("doc_id").alias("query_id"), name.alias("a")), "query_id").join(rows.select((F.col("doc_id") - 1).alias("query_id"), F.col("source_path").alias("b")), "query_id")
    top = F.struct(F.when(F.col("query_id") % 2 == 0, "SRC1").otherwise("").alias("source_contains"), F.lit("").alias("content_contains"))
    cases = cases.select("query_id", F.concat(F.lit("c"), (F.col("query_id") % 3).cast("string")).alias("category"), F.array("a", "b").alias("expected_sources"), F.expr("cast(array() as array<string>)").alias("expected_content_contains"), top.alias("expected_top_result"))
    out = evaluation.run(cases, _trusted(spark, sf)).drop("content_match")
    return out.withColumn("hits", F.array_join("hits", ","))


@query(f"WITH {_TRUSTED} SELECT query_id, substr(sha256(string_agg(id || ':' || checksum || chr(10), '' ORDER BY rank)), 1, 32) AS sig FROM trusted GROUP BY 1")
def result_signature(spark, sf):
    return plans.signature(_trusted(spark, sf, "checksum"))


@query(f"""WITH {_FUSED}, l AS (SELECT query_id, doc_id, 0 AS list_id, rank FROM vec WHERE rank <= 5 UNION ALL SELECT query_id, doc_id, 1, rank FROM bm25 WHERE rank <= 5),
  f AS (SELECT query_id, doc_id, min(list_id * 1000 + rank) AS place FROM l GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, doc_id) AS rank FROM f QUALIFY rank <= 5)
  SELECT k.query_id, k.rank, '[' || source || '/' || d.doc_id || '] ' || substr(text, 1, list_max(list_filter(range(0, 501), lambda i: strlen(substr(text, 1, i)) <= 500))) AS hint FROM k JOIN documents d ON k.doc_id = d.doc_id""")
def vocabulary_hints(spark, sf):
    asked = _text_queries(spark, sf)
    near = vector.knn(table(spark, sf, "embeddings"), table(spark, sf, "embeddings").join(asked.select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi").withColumnRenamed("vec_id", "query_id"), 5)
    lists = near.select("query_id", F.col("vec_id").alias("doc_id"), F.lit(0).alias("list_id"), "rank")
    lists = lists.unionByName(search.bm25(table(spark, sf, "documents"), asked, 5).select("query_id", "doc_id", F.lit(1).alias("list_id"), "rank"))
    docs = table(spark, sf, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source_path"), F.col("text").alias("raw_content"))
    return plans.scouted(docs, lists)


@query("""SELECT doc_id, array_to_string(list_filter(list_transform(list_filter(list_transform(string_split('1. ' || text || chr(10) || '- two' || chr(10) || '*x' || chr(10) || chr(10) || 'plain', chr(10)), lambda x: trim(x)), lambda x: x <> ''),
  lambda x: trim(CASE WHEN length(x) > 2 AND regexp_matches(x, '^[1-9][.)]') THEN substr(x, 3) WHEN length(x) > 2 AND regexp_matches(x, '^[-*]') THEN substr(x, 2) ELSE x END)), lambda x: x <> '')[1:5], '|') AS lines FROM documents""")
def query_expansions(spark, sf):
    reply = F.concat(F.lit("1. "), "text", F.lit("\n- two\n*x\n\nplain"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.expansions(reply), "|").alias("lines"))


@query("""WITH c AS (SELECT doc_id, substr(sha256(doc_id::VARCHAR), 1, 16) AS a, substr(sha256((doc_id + 1)::VARCHAR), 1, 8) AS b FROM documents)
  SELECT doc_id, array_to_string([a, b], ',') AS cited FROM c""")
def citation_ids(spark, sf):
    a, b = (F.substring(F.sha2((F.col("doc_id") + k).cast("string"), 256), 1, n) for k, n in ((0, 16), (1, 8)))
    answer = F.concat(F.lit("x ["), a, F.lit("] y ["), b, F.lit("] ["), a, F.lit("] [abc] "), F.lit(" ---KB_META--- [ffffffffff]"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.citations(X.strip_meta(answer)), ",").alias("cited"))


@query("SELECT conv_id, arg_max(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY 1")
def last_user_message(spark, sf):
    return storage.latest(table(spark, sf, "conversations").where("role = 'user'").withColumnRenamed("text", "question"), ["conv_id"], "question", ["turn"])


@query("SELECT item_id, substr(sha256(text || ':' || (item_id % 2 = 0)::VARCHAR), 1, 32) AS key FROM benchmark")
def cache_keys(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", X.cache_key(F.col("text"), F.col("item_id") % 2 == 0).alias("key"))


@query("""WITH stored AS (SELECT substr(sha256(text || ':false'), 1, 32) AS k, CASE WHEN item_id % 4 = 0 THEN 'old' ELSE 'same' END AS sig, 'answer ' || item_id AS answer, TIMESTAMP '2024-02-01 00:00:00' - to_seconds(CASE WHEN item_id % 3 = 0 THEN 601 ELSE 600 END) AS created FROM benchmark),
  live AS (SELECT k, sig, arg_max(answer, (created, answer)) AS answer FROM stored WHERE created >= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 600 SECOND GROUP BY 1, 2)
  SELECT item_id AS request, answer FROM benchmark LEFT JOIN live ON k = substr(sha256(text || ':false'), 1, 32) AND sig = 'same'""")
def cache_lookup(spark, sf):
    rows = table(spark, sf, "benchmark")
    key = X.cache_key(F.col("text"), F.lit(False))
    stored = rows.select(key.alias("cache_key"), F.when(F.col("item_id") % 4 == 0, "old").otherwise("same").alias("fragment_sigs"), F.concat(F.lit("answer "), F.col("item_id").cast("string")).alias("answer_json"),
                         (F.lit(trust.AS_OF).cast("timestamp") - F.make_dt_interval(secs=F.when(F.col("item_id") % 3 == 0, 601).otherwise(600))).alias("created_at"))
    found = answers.lookup(stored, rows.select("item_id", key.alias("cache_key"), F.lit("same").alias("fragment_sigs")), trust.AS_OF)
    return found.select(F.col("item_id").alias("request"), F.col("answer_json").alias("answer"))


# Documents from messages, and chunks.


@query("""SELECT conv_id, string_agg(coalesce(role, '') || ': ' || coalesce(text, '') || chr(10), '' ORDER BY turn, role, text) AS content, arg_min(role, turn) AS author, count(*) AS n FROM conversations GROUP BY 1""")
def thread_documents(spark, sf):
    return messages.threads(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, sha256(string_agg(strftime(ts, '%H:%M:%S') || ' ' || coalesce(event_type, '') || ': ' || coalesce(props, '') || chr(10), '' ORDER BY ts, event_id)) AS digest, count(*) AS n, max(ts) AS last FROM events GROUP BY 1""")
def daily_digest(spark, sf):
    out = messages.daily(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "props", "event_id")
    return out.select("day", F.sha2("content", 256).alias("digest"), "n", "last")


@query("SELECT event_type, count(*) AS n, min(ts) AS first FROM events WHERE ts >= TIMESTAMP '2024-01-19 00:00:00' GROUP BY 1")
def scan_window(spark, sf):
    start = messages.window_start(F.lit("2024-01-20 00:00:00").cast("timestamp"), F.lit(trust.AS_OF).cast("timestamp"))
    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).where(F.col("ts") >= start)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first"))


@query("""SELECT page_id, page_id::VARCHAR AS path, url AS source_uri, sha256(html) AS checksum, TIMESTAMP '2024-01-05 00:00:00' + to_minutes((page_id % 600)::BIGINT) - CASE page_id % 5 WHEN 1 THEN INTERVAL 2 HOUR WHEN 3 THEN INTERVAL '-210' MINUTE ELSE INTERVAL 0 HOUR END AS content_date
  FROM pages WHERE page_id % 5 <> 4 UNION ALL SELECT page_id, page_id::VARCHAR, url, sha256(html), NULL FROM pages WHERE page_id % 5 = 4""")
def wiki_documents(spark, sf):
    minutes = F.date_format(F.lit("2024-01-05 00:00:00").cast("timestamp") + F.make_dt_interval(mins=(F.col("page_id") % 600).cast("int")), "yyyy-MM-dd'T'HH:mm:ss")
    ends = F.array(F.lit(".000Z"), F.lit("+02:00"), F.lit(".000+0000"), F.lit(".000-0330"), F.lit(" local"))
    stamp = F.concat(minutes, F.element_at(ends, (F.col("page_id") % 5 + 1).cast("int")))
    return table(spark, sf, "pages").select("page_id", F.col("page_id").cast("string").alias("path"), F.col("url").alias("source_uri"), F.sha2("html", 256).alias("checksum"), messages.wiki_time(stamp).alias("content_date"))


_MD = "'## Head ' || doc_id || chr(10) || text || chr(10) || '### Tail' || chr(10) || 'end'"


#: White space of the chunkers.
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(5760) || " + " || ".join(f"chr({c})" for c in (*range(8192, 8203), 8232, 8233, 8239, 8287, 12288))
#: Chunks are not split further.
_WHOLE = 1 << 40


def _chunked(docs, most: int):
    return chunking.chunks(docs, most=most, columns=["doc_id"]).select("doc_id", F.col("idx").cast("long").alias("idx"), F.col("chunk.content").alias("content"), F.col("chunk.metadata").alias("metadata"))


def _texts(spark, sf, ext: str, text):
    return table(spark, sf, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(ext)).alias("source_path"), text.alias("raw_content"))


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split({_MD}, chr(10))) AS line, unnest(range(len(string_split({_MD}, chr(10))))) AS i FROM documents),
  h AS (SELECT doc_id, line, i, trim(line, {_WS}) AS bare, starts_with(bare, '## ') OR starts_with(bare, '### ') AS head FROM l),
  g AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM h),
  s AS (SELECT doc_id, section, coalesce(max(CASE WHEN head THEN bare END), '') AS heading, trim(coalesce(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY i), ''), {_WS}) AS body FROM g GROUP BY 1, 2)
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section) - 1 AS idx, ltrim(heading, '# ') AS heading, heading || CASE WHEN heading <> '' AND body <> '' THEN chr(10) || chr(10) ELSE '' END || body AS content FROM s WHERE heading <> '' OR body <> ''""")
def markdown_headings(spark, sf):
    """Sections under headings, of the markdown chunker."""
    text = F.concat(F.lit("## Head "), F.col("doc_id").cast("string"), F.lit("\n"), "text", F.lit("\n### Tail\nend"))
    return _chunked(_texts(spark, sf, ".md", text).where("raw_content IS NOT NULL"), _WHOLE).select("doc_id", "idx", F.col("metadata")["heading"].alias("heading"), "content")


@query(f"""SELECT doc_id, 0::BIGINT AS idx, array_to_string(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: trim(p, {_WS})), lambda p: p <> ''), chr(10) || chr(10)) AS content FROM documents WHERE text IS NOT NULL""")
def paragraph_split(spark, sf):
    """Paragraphs without blanks around them, gathered into one chunk by the plain text chunker."""
    return _chunked(_texts(spark, sf, ".txt", F.col("text")).where("raw_content IS NOT NULL"), _WHOLE).select("doc_id", "idx", "content")


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(f, chr(10))) AS line, unnest(range(len(string_split(f, chr(10))))) AS i FROM (SELECT doc_id, 'top=1' || chr(10) || '[s' || doc_id || ']' || chr(10) || text || chr(10) || '[[t]]' || chr(10) || 'k=v' AS f FROM documents WHERE text IS NOT NULL)),
  h AS (SELECT *, trim(line, {_WS}) AS bare, starts_with(bare, '[') AND ends_with(bare, ']') AND length(bare) > 2 AS head FROM l),
  g AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM h),
  s AS (SELECT doc_id, section, coalesce(max(CASE WHEN head THEN CASE WHEN starts_with(bare, '[[') AND ends_with(bare, ']]') THEN bare[2:-3] ELSE bare[2:-2] END END), '') AS name, trim(string_agg(line, chr(10) ORDER BY i), {_WS}) AS body FROM g GROUP BY 1, 2)
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section) - 1 AS idx, name, body AS content FROM s WHERE body <> ''""")
def chunk_sections(spark, sf):
    """Sections of configuration files."""
    text = F.concat(F.lit("top=1\n[s"), F.col("doc_id").cast("string"), F.lit("]\n"), "text", F.lit("\n[[t]]\nk=v"))
    return _chunked(_texts(spark, sf, ".toml", text).where("raw_content IS NOT NULL"), _WHOLE).select("doc_id", "idx", F.col("metadata")["section"].alias("name"), "content")


@query(f"""WITH g AS (SELECT doc_id, unnest(x) AS body, unnest(range(len(x))) AS i FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array('A=' || doc_id || chr(10) || '# note' || chr(10) || chr(10) || text || chr(10) || ' ' || chr(10) || 'Z: end', '\n[ \t]*\n'), lambda b: trim(b, {_WS})), lambda b: b <> '') AS x FROM documents WHERE text IS NOT NULL)),
  k AS (SELECT *, list_filter(string_split(body, chr(10)), lambda l: trim(l, {_WS}) <> '' AND NOT starts_with(trim(l, {_WS}), '#') AND NOT starts_with(trim(l, {_WS}), '!')) AS lines FROM g)
  SELECT doc_id, i AS idx, CASE WHEN len(lines) = 0 THEN '' ELSE trim(regexp_split_to_array(lines[1], '[=:]')[1], {_WS}) END AS key, body AS content FROM k""")
def chunk_pairs(spark, sf):
    """Groups of key-value lines."""
    text = F.concat(F.lit("A="), F.col("doc_id").cast("string"), F.lit("\n# note\n\n"), "text", F.lit("\n \nZ: end"))
    return _chunked(_texts(spark, sf, ".env", text).where("raw_content IS NOT NULL"), _WHOLE).select("doc_id", "idx", F.col("metadata")["key"].alias("key"), "content")


@query()
def chunked_fragments(spark, sf):
    """All documents cut into chunks by their extension."""
    return chunking.to_fragments(fragments(spark, sf, labels=False)).select("id", "source_path", "idx", "raw_content", "metadata")


def _files(spark, sf, ext: str, body: Callable):
    """Each document's whole text as a file of a kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return table(spark, sf, "documents").select(F.lit("filesystem").alias("source_type"), F.col("source").alias("source_name"), F.concat(F.col("doc_id").cast("string"), F.lit(ext)).alias("source_path"), body(text).alias("raw_content"), F.lit("").alias("checksum"))


def _paragraphs(text, head: str, before: str, after: str):
    """Each paragraph, numbered and indented, under a line of its own."""
    each = F.transform(F.split(text, "\n\n"), lambda p, i: F.concat(F.lit(before), i.cast("string"), F.lit(after), F.replace(p, F.lit("\n"), F.lit("\n    ")), F.lit("\n\n")))
    return F.concat(F.lit(head), F.array_join(each, ""))


def _notebook(text):
    """A cell of each line, every fourth of text."""
    kind = lambda i: F.when(i % 4 == 3, "markdown").otherwise("code")
    return F.to_json(F.struct(F.transform(F.split(text, "\n"), lambda p, i: F.struct(kind(i).alias("cell_type"), F.array(p).alias("source"))).alias("cells")))


@query()
def chunk_code(spark, sf):
    rows = _files(spark, sf, ".py", lambda t: _paragraphs(t, "import os\n\n", "def f", "():\n    "))
    return chunking.to_fragments(rows).select("id", "source_path", "idx", "raw_content", "metadata")


@query()
def chunk_config(spark, sf):
    rows = _files(spark, sf, ".ini", lambda t: _paragraphs(t, "[a]\nk=1\n", "[b", "]\ntext = "))
    return chunking.to_fragments(rows).select("id", "source_path", "idx", "raw_content", "metadata")


@query()
def chunk_jupyter(spark, sf):
    return chunking.to_fragments(_files(spark, sf, ".ipynb", _notebook)).select("id", "source_path", "idx", "raw_content", "metadata")


@query("""WITH c AS (SELECT doc_id, len(list_filter(regexp_split_to_array(p, '\\s+'), lambda w: w <> '')) AS words FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents WHERE text IS NOT NULL))
  SELECT count(DISTINCT doc_id) AS files, count(*) AS chunks, round(count(*) / count(DISTINCT doc_id)::DOUBLE, 6) AS per_file, round(avg(words), 6) AS mean_words, quantile_cont(words::DOUBLE, 0.5) AS median_words, quantile_disc(words, 0.95)::BIGINT AS p95_words FROM c""")
def chunk_stats(spark, sf):
    rows = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.explode(F.split("text", "\n")).alias("p"))
    return evaluate.chunk_stats(rows, "doc_id", "p")


# Enrichment.


@query("""SELECT conv_id, turn, coalesce(string_agg(text, chr(10) || chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS previous,
  coalesce(string_agg(text, chr(10) || chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING), '') AS following FROM conversations""")
def context_window(spark, sf):
    return models.context(table(spark, sf, "conversations"), ["conv_id"], "turn", "text").select("conv_id", "turn", "previous", "following")


@query(f"WITH {FRAGMENTS_SQL} SELECT id, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'E ' || author END AS enriched_content FROM fragments")
def enrichment_reuse(spark, sf):
    rows = fragments(spark, sf, labels=False)
    old = rows.where("doc_id % 3 = 0").select("id", F.when(F.col("doc_id") % 2 == 0, F.col("raw_content")).otherwise("other").alias("raw_content"), F.concat(F.lit("E "), "author").alias("enriched_content"), F.lit("m").alias("enrichment_model"), F.lit("v2").alias("enrichment_version"))
    return models.reuse(rows.select("id", "raw_content"), old, "m", "v2").select("id", "enriched_content")


@query("SELECT doc_id, text || chr(10) || chr(10) || 'note on ' || lang AS content FROM documents WHERE lang <> 'fr' UNION ALL SELECT doc_id, text FROM documents WHERE lang = 'fr'")
def enriched_content(spark, sf):
    answer = F.when(F.col("lang") != "fr", F.concat(F.lit("note on "), "lang"))
    return table(spark, sf, "documents").where("lang IS NOT NULL").select("doc_id", models.enriched(F.col("text"), answer).alias("content"))


_NOTE_HEAD, _, _NOTE_TAIL = models.ASK[2].partition("{}")
#: Characters of a prompt besides its texts: the whole, and those of a side that is there.
_NOTE_REST, _NOTE_SIDE = len(_NOTE_HEAD) + len(_NOTE_TAIL) + len("Chunk:\n\n\n"), (len("Before:\n\n\n"), len("After:\n\n\n"))


@query(f"""WITH w AS (SELECT conv_id, turn, coalesce(text, '') AS text, coalesce(string_agg(coalesce(text, ''), chr(10) || chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS p,
  coalesce(string_agg(coalesce(text, ''), chr(10) || chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING), '') AS f FROM conversations),
  n AS (SELECT *, {_NOTE_REST} + length(text) + CASE WHEN p = '' THEN 0 ELSE length(p) + {_NOTE_SIDE[0]} END + CASE WHEN f = '' THEN 0 ELSE length(f) + {_NOTE_SIDE[1]} END AS size FROM w),
  d AS (SELECT *, bool_or(size % 50 = 7) OVER (PARTITION BY conv_id) AS failed FROM n)
  SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN 'kept' WHEN NOT failed THEN text || chr(10) || chr(10) || 'note ' || size END AS enriched_content, CASE WHEN conv_id % 4 = 0 OR NOT failed THEN 'm' END AS model FROM d""")
def enrichment_run(spark, sf):
    """Conversations as documents: those with stored enrichments keep them, those on which the model fails stay as they are."""
    rows = table(spark, sf, "conversations").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.lit("chat").alias("source_type"), F.col("conv_id").cast("string").alias("source_path"),
        F.coalesce("text", F.lit("")).alias("raw_content"), F.col("turn").cast("long").alias("idx"), "conv_id", "turn",
    )
    stored = rows.where("conv_id % 4 = 0").select("id", "raw_content", F.lit("kept").alias("enriched_content"), F.lit("m").alias("enrichment_model"), F.lit("v2").alias("enrichment_version"))

    def model(prompt: str) -> str:
        if len(prompt) % 50 == 7:
            raise RuntimeError("no answer")
        return f"note {len(prompt)}"

    out = enrichment.run(rows, model, "m", stored=stored)
    return out.select("conv_id", "turn", "enriched_content", F.col("enrichment_model").alias("model"))


@query("""WITH h AS (SELECT doc_id, sha256(text) || sha256(text || chr(0) || chr(0) || chr(0) || chr(1)) || sha256(text || chr(0) || chr(0) || chr(0) || chr(2)) || sha256(text || chr(0) || chr(0) || chr(0) || chr(3)) AS d FROM documents WHERE trim(text) <> ''),
  v AS (SELECT doc_id, list_transform(range(0, 64), lambda i: list_reduce(list_transform(range(1, 5), lambda k: strpos('0123456789abcdef', substr(d, i * 4 + k, 1)) - 1), lambda x, y: x * 16 + y) / 65536.0::DOUBLE) AS e FROM h)
  SELECT doc_id, 64::BIGINT AS dim, round(e[1] / sqrt(list_sum(list_transform(e, lambda x: x * x))), 3) AS first, round(e[64] / sqrt(list_sum(list_transform(e, lambda x: x * x))), 3) AS last, round(list_sum(e) / sqrt(list_sum(list_transform(e, lambda x: x * x))), 2) AS total FROM v""")
def hash_embeddings(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", models.embed(F.col("text"), models.HashEmbedder(64)).alias("v")).where("v IS NOT NULL")
    at = lambda i: F.round(F.element_at("v", i).cast("double"), 3)
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rows.select("doc_id", F.size("v").cast("long").alias("dim"), at(1).alias("first"), at(64).alias("last"), F.round(total, 2).alias("total"))


# Clusters: labels of ``embeddings`` are clusters, ``documents`` of the same number their fragments.

_MEMBERS = f"{FRAGMENTS_SQL}, members AS (SELECT label::BIGINT AS cluster, g.* FROM embeddings e JOIN fragments g ON e.vec_id = g.doc_id)"


def _members(spark, sf):
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("long").alias("cluster"))
    return fragments(spark, sf).join(labels, "doc_id")


@query("SELECT label::BIGINT AS label, pos - 1 AS pos, round(avg(x), 6) AS value FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY 1, 2")
def centroids(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("label", F.col("label").cast("long"))
    return cluster.centroids_of(rows, "label", "embedding").withColumn("pos", F.col("pos").cast("long"))


@query("""WITH s AS (SELECT label, arg_min(embedding::DOUBLE[], vec_id) AS c FROM embeddings GROUP BY 1), k AS (SELECT c, row_number() OVER (ORDER BY label) - 1 AS cluster FROM s),
  d AS (SELECT vec_id, cluster, round(list_sum(list_transform(list_zip(embedding::DOUBLE[], c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS d FROM embeddings, k)
  SELECT vec_id, arg_min(cluster, (d, cluster)) AS cluster FROM d GROUP BY 1""")
def kmeans_assign(spark, sf):
    import numpy as np

    rows = table(spark, sf, "embeddings")
    seeds = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("c")).orderBy("label").collect()
    return cluster.assign(rows, np.array([r["c"] for r in seeds], float))


_SQUARED = "round(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9)"


@query(f"""WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
  s AS (SELECT label, arg_min(embedding::DOUBLE[], vec_id) AS c FROM embeddings GROUP BY 1),
  r AS (SELECT 0 AS i, row_number() OVER (ORDER BY label) - 1 AS cluster, c FROM s
    UNION ALL SELECT i + 1, k.cluster, coalesce(m, c) FROM r k LEFT JOIN (SELECT cluster, list(x ORDER BY pos) AS m FROM (SELECT cluster, pos, avg(x) AS x FROM (SELECT cluster, unnest(v) AS x, unnest(range(len(v))) AS pos FROM
      (SELECT vec_id, any_value(v) AS v, arg_min(cluster, ({_SQUARED}, cluster)) AS cluster FROM e, r GROUP BY 1)) GROUP BY 1, 2) GROUP BY 1) n ON k.cluster = n.cluster WHERE i < 4)
  SELECT vec_id, arg_min(cluster, ({_SQUARED}, cluster)) AS cluster FROM e, r WHERE i = 4 GROUP BY 1""")
def kmeans_rounds(spark, sf):
    """Five rounds from given seeds."""
    import numpy as np

    rows = table(spark, sf, "embeddings")
    seeds = rows.where("embedding IS NOT NULL").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("c")).orderBy("label").collect()
    return cluster.lloyd(rows, np.array([r["c"] for r in seeds], float), rounds=5)[0]


@query()
def kmeans_full(spark, sf):
    rows = table(spark, sf, "embeddings")
    return cluster.kmeans(rows, 10)[0]


@query()
def pca_2d(spark, sf):
    out = cluster.pca(table(spark, sf, "embeddings"), 2)
    return out.select("vec_id", F.round("x0", 6).alias("x0"), F.round("x1", 6).alias("x1"))


@query(f"WITH {_MEMBERS}, n AS (SELECT cluster, count(*) AS n FROM members GROUP BY 1) SELECT min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM n")
def cluster_sizes(spark, sf):
    return _members(spark, sf).groupBy("cluster").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))


_TOPIC = f"""{_MEMBERS}, total AS (SELECT cluster, count(*) AS n FROM members GROUP BY 1),
  dirs AS (SELECT cluster, regexp_replace(source_path, '/[^/]*$', '') AS dir, count(*) AS c FROM members GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY c DESC, dir) = 1),
  exts AS (SELECT cluster, file_type AS ext, count(*) AS c FROM members GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY c DESC, ext) = 1),
  srcs AS (SELECT cluster, source_name AS src, count(*) AS c, count(*) OVER (PARTITION BY cluster) AS kinds FROM members GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY c DESC, src) = 1)"""


@query(f"""WITH {_TOPIC} SELECT t.cluster, CASE WHEN s.kinds = 1 OR s.c >= floor(t.n * 7 / 10) THEN src || ': ' ELSE '' END || dir || CASE WHEN d.c < floor(t.n * 7 / 10) THEN ' ' || ext ELSE '' END AS topic
  FROM total t JOIN dirs d USING (cluster) JOIN exts e USING (cluster) JOIN srcs s USING (cluster)""")
def cluster_topic(spark, sf):
    return cluster.topics(_members(spark, sf))


@query(f"""WITH {_MEMBERS}, m AS (SELECT cluster, round(round(avg({trust.freshness_sql('content_date', 'file_type')}), 9) * 100) / 100 AS freshness, {trust.corroboration_sql('count(DISTINCT source_name)')} AS corroboration,
  round(round(avg({trust.consistency_sql('confidence_adj')}), 9) * 100) / 100 AS consistency, round(round(avg({trust.authority_sql('file_type')}), 9) * 100) / 100 AS authority FROM members GROUP BY 1)
  SELECT *, {trust.overall_sql('freshness', 'corroboration', 'consistency', 'authority')} AS overall FROM m""")
def cluster_confidence(spark, sf):
    return cluster.confidence(_members(spark, sf))


@query(f"""WITH {_MEMBERS}, p AS (SELECT cluster, list_sort(list_distinct(list(source_path))) AS l FROM members GROUP BY 1)
  SELECT cluster, CASE WHEN len(l) > 5 THEN 'Covers ' || len(l) || ' files including ' ELSE 'Covers ' END || array_to_string(l[1:5], ', ') AS summary FROM p""")
def cluster_summary(spark, sf):
    return cluster.summaries(_members(spark, sf))


@query(f"WITH {_MEMBERS} SELECT cluster, substr(sha256('unit:' || cluster || ':' || string_agg(id, ',' ORDER BY id)), 1, 16) AS unit_id, count(*) AS n FROM members GROUP BY 1")
def knowledge_unit_ids(spark, sf):
    return cluster.unit_ids(_members(spark, sf))


@query("""WITH c AS (SELECT label::BIGINT AS unit, list(a ORDER BY pos) AS v FROM (SELECT label, pos, round(avg(x), 6) AS a FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
  d AS (SELECT q.vec_id AS query_id, unit, round(list_distance(q.embedding::DOUBLE[], c.v), 5) AS distance FROM embeddings q, c WHERE q.vec_id % 50 = 0)
  SELECT query_id, unit, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, unit) AS rank FROM d) WHERE rank <= 5""")
def unit_search(spark, sf):
    means = centroids(spark, sf).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("centroid"))
    out = vector.knn(means.withColumnRenamed("centroid", "embedding"), _vector_queries(spark, sf), 5, vec_id="label", digits=5)
    return out.select("query_id", F.col("vec_id").alias("unit"), "rank")


# Evaluation: a result is relevant if its label is the query's.

_RANKED = f"""{_NEAR}, ranked AS (SELECT n.query_id, n.rank, n.label = q.label AS relevant, q.label FROM near n JOIN embeddings q ON n.query_id = q.vec_id WHERE n.rank <= 21 AND n.vec_id <> n.query_id),
  rk AS (SELECT query_id, label, relevant, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM ranked)"""
_EACH = f"""{_RANKED}, each AS (SELECT query_id, (label % 3)::VARCHAR AS category,
  {', '.join(f'max(CASE WHEN relevant AND rank <= {k} THEN 1.0 ELSE 0.0 END)::DOUBLE AS recall_{k}' for k in evaluate.KS)},
  {', '.join(f'round(sum(CASE WHEN relevant AND rank <= {k} THEN 1 ELSE 0 END)::DOUBLE / sum(CASE WHEN rank <= {k} THEN 1 ELSE 0 END), 6) AS precision_{k}' for k in evaluate.KS)},
  round(coalesce(1.0::DOUBLE / min(CASE WHEN relevant THEN rank END), 0), 6) AS mrr,
  {', '.join(f'max(CASE WHEN relevant AND rank <= {k} THEN 1.0 ELSE 0.0 END)::DOUBLE AS hit_{k}' for k in evaluate.HITS)} FROM rk GROUP BY query_id, label)"""


def _each(spark, sf):
    vectors = table(spark, sf, "embeddings")
    labels = vectors.select("vec_id", "label")
    near = vector.knn(vectors, _vector_queries(spark, sf), 21).where("vec_id <> query_id")
    asked = labels.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))
    by = Window.partitionBy("query_id").orderBy("rank")
    ranked = near.withColumn("rank", F.row_number().over(by)).join(labels, "vec_id").join(asked, "query_id").select("query_id", "rank", (F.col("label") == F.col("wanted")).alias("relevant"), F.col("wanted").alias("found"))
    queries = asked.select("query_id", (F.col("wanted") % 3).cast("string").alias("category"), F.lit(1).alias("n_expected"))
    return evaluate.per_query(ranked, queries)


@query(f"WITH {_EACH} SELECT * FROM each")
def eval_per_query(spark, sf):
    return _each(spark, sf)


_METRICS = [*(f"recall_{k}" for k in evaluate.KS), *(f"precision_{k}" for k in evaluate.KS), "mrr", *(f"hit_{k}" for k in evaluate.HITS)]


@query(f"WITH {_EACH} SELECT coalesce(category, 'overall') AS category, count(*) AS n, {', '.join(f'round(round(avg({m}), 9) * 100) / 100 AS {m}' for m in _METRICS)} FROM each GROUP BY GROUPING SETS ((category), ())")
def eval_summary(spark, sf):
    return evaluate.summary(_each(spark, sf)).withColumn("category", F.coalesce("category", F.lit("overall")))


@query(f"""WITH {_EACH}, a AS (SELECT category, round(round(avg(mrr), 9) * 100) / 100 AS v FROM each GROUP BY GROUPING SETS ((category), ())),
  b AS (SELECT category, round(round(avg(mrr), 9) * 100) / 100 AS o FROM each WHERE query_id % 100 = 0 GROUP BY GROUPING SETS ((category), ()))
  SELECT coalesce(a.category, 'overall') AS category, v AS value, round(v - o, 6) AS change, CASE WHEN round(v - o, 6) > 0.005 THEN 'up' WHEN round(v - o, 6) < -0.005 THEN 'down' WHEN o IS NOT NULL THEN 'same' ELSE 'new' END AS sign
  FROM a LEFT JOIN b ON a.category IS NOT DISTINCT FROM b.category""")
def eval_delta(spark, sf):
    each = _each(spark, sf)
    return evaluate.delta(evaluate.summary(each), evaluate.summary(each.where("query_id % 100 = 0")), "mrr").withColumn("category", F.coalesce("category", F.lit("overall")))


@query(f"WITH {FRAGMENTS_SQL} SELECT doc_id AS query_id, id, list_sort(list_filter(['src1/' || doc_id || '.md', doc_id || '.txt', 'x'], lambda e: e = source_path OR ends_with(source_path, '/' || e))) AS matches FROM fragments")
def source_relevance(spark, sf):
    rows = fragments(spark, sf, labels=False).select(F.col("doc_id").alias("query_id"), "id", "source_path")
    d = F.col("query_id").cast("string")
    expected = rows.select("query_id", F.explode(F.array(F.concat(F.lit("src1/"), d, F.lit(".md")), F.concat(d, F.lit(".txt")), F.lit("x"))).alias("expected"))
    return evaluate.relevance(rows, expected).select("query_id", "id", "matches")


@query("SELECT item_id AS query_id, contains(lower(text), lower(substr(text, 3, 6))) AND NOT item_id % 2 = 0 AS matched FROM benchmark")
def content_match(spark, sf):
    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(1).alias("rank"), F.col("text").alias("content"))
    needles = F.array(F.upper(F.substring("content", 3, 6)), F.when(F.col("query_id") % 2 == 0, F.lit("\u0001none")).otherwise(F.substring("content", 1, 1)))
    return evaluate.content_match(rows, rows.select("query_id", needles.alias("needles")))


# Latest rows, windows, scalars.


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY 1")
def latest_per_key(spark, sf):
    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max("ts").alias("ts"))


@query("SELECT DISTINCT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events")
def dedup_window(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("day"))
    return rows.dropDuplicates(["user_id", "event_type", "day"])


@query("""SELECT doc_id, CASE WHEN a < 1 THEN 'today' WHEN a < 30 THEN a || ' day' || CASE WHEN a = 1 THEN '' ELSE 's' END WHEN a // 30 < 12 THEN (a // 30) || ' month' || CASE WHEN a // 30 = 1 THEN '' ELSE 's' END
    ELSE (a // 30 // 12) || ' year' || CASE WHEN a // 30 // 12 = 1 THEN '' ELSE 's' END END AS age,
  CASE WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0::DOUBLE) WHEN n >= 1024 THEN printf('%.1f KB', n / 1024.0::DOUBLE) ELSE printf('%d B', n) END AS size,
  len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::BIGINT AS words, CASE WHEN length(lang || source || lang) < 8 THEN '****' ELSE left(lang || source || lang, 8) || '****' END AS secret
  FROM (SELECT *, doc_id % 800 AS a, n_chars * 7 AS n FROM documents)""")
def formatted_values(spark, sf):
    days, n = F.col("doc_id") % 800, F.col("n_chars") * 7
    return table(spark, sf, "documents").select("doc_id", X.age(days).alias("age"), X.size(n).alias("size"), X.words(F.col("text")).cast("long").alias("words"), X.mask(F.concat("lang", "source", "lang")).alias("secret"))


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split('a, ,' || source || ' ,' || lang, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM documents")
def split_values(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.split_csv(F.concat(F.lit("a, ,"), "source", F.lit(" ,"), "lang")), "|").alias("parts"))


@query("""WITH p AS (SELECT doc_id // 5 AS part, min(path) AS a, max(path) AS b, count(path) AS n FROM
    (SELECT doc_id, coalesce(lang, 'none') || '/' || coalesce(source, 'none') || '/' || (coalesce(n_chars, 0) // 1000) || '/' || doc_id || '/f.md' AS path FROM documents) GROUP BY 1),
  s AS (SELECT part, n, string_split(a, '/') AS x, string_split(b, '/') AS y FROM p WHERE n > 0),
  d AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(x), len(y))), lambda i: x[i] <> y[i])), least(len(x), len(y))) AS k FROM s)
  SELECT part, n, array_to_string(x[1:k - 1], '/') AS common FROM d""")
def common_directories(spark, sf):
    """What the paths of each five neighbouring documents share."""
    docs = table(spark, sf, "documents")
    named = lambda c: F.coalesce(F.col(c), F.lit("none"))
    thousands = F.floor(F.coalesce("n_chars", F.lit(0)) / 1000).cast("string")
    path = F.concat(named("lang"), F.lit("/"), named("source"), F.lit("/"), thousands, F.lit("/"), F.col("doc_id").cast("string"), F.lit("/f.md"))
    # What the least and the greatest path share is shared by all between.
    ends = docs.groupBy(F.floor(F.col("doc_id") / 5).alias("part")).agg(F.min(path).alias("least"), F.max(path).alias("most"), F.count(path).alias("n")).where("n > 0")
    return ends.select("part", "n", X.common_directory(F.array("least", "most")).alias("common"))


_FOLDERS = ("src", "node_modules", ".hidden", "lib", "img/deep", "a/build/b", "docs")
_NAMES = ("a.py", "x.min.js", "LICENSE", "p.PNG", "_generated.go", "n.generated.ts", ".env", "README.md", "b.lock", "MAP.Map", "noext")
_LISTED = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(f"""WITH f AS (SELECT doc_id, {_LISTED(_FOLDERS)}[doc_id % {len(_FOLDERS)} + 1] || '/' || {_LISTED(_NAMES)}[doc_id % {len(_NAMES)} + 1] AS path, doc_id * 1500 AS size FROM documents),
  p AS (SELECT *, string_split(path, '/') AS parts, parts[-1] AS name, lower(name) AS low FROM f)
  SELECT doc_id, path, NOT (len(list_filter(parts[:-2], lambda d: list_contains({_LISTED(files.SKIPPED_FOLDERS)}, d) OR starts_with(d, '.'))) > 0 OR starts_with(name, '.') OR list_contains({_LISTED(files.SKIPPED_FILES)}, name)
    OR len(list_filter({_LISTED(files.SKIPPED_ENDINGS)}, lambda e: ends_with(low, e))) > 0 OR contains(low, '.generated.') OR starts_with(low, '_generated') OR list_contains({_LISTED(files.BINARY)}, regexp_extract(low, '([.][^.]*)$', 1)) OR size > 1048576) AS wanted FROM p""")
def scan_predicates(spark, sf):
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values) + 1).cast("int"))
    rows = table(spark, sf, "documents").select("doc_id", F.concat(pick(_FOLDERS), F.lit("/"), pick(_NAMES)).alias("path"))
    return rows.select("doc_id", "path", files.wanted(F.col("path"), F.col("doc_id") * 1500).alias("wanted"))


@query("""WITH r AS (SELECT ['A', 'M', 'D', 'R100', 'C75'][doc_id % 5 + 1] AS s, source || '/' || doc_id || '.md' AS p, 'new/' || doc_id || '.md' AS q FROM documents)
  SELECT p AS path, CASE WHEN s[1] IN ('A', 'M') THEN 'changed' ELSE 'deleted' END AS state FROM r UNION SELECT q, 'changed' FROM r WHERE s[1] IN ('R', 'C')""")
def git_name_status(spark, sf):
    status = F.element_at(F.array(*map(F.lit, ("A", "M", "D", "R100", "C75"))), (F.col("doc_id") % 5 + 1).cast("int"))
    d = F.col("doc_id").cast("string")
    rows = table(spark, sf, "documents").select(status.alias("status"), F.concat("source", F.lit("/"), d, F.lit(".md")).alias("path"), F.concat(F.lit("new/"), d, F.lit(".md")).alias("new_path"))
    return files.name_status(rows)


@query("SELECT 'f' || (event_id % 100) AS path, max(ts) AS date, arg_max(user_id, (ts, event_id))::VARCHAR AS author FROM events GROUP BY 1")
def git_last_change(spark, sf):
    rows = table(spark, sf, "events").select(F.concat(F.lit("f"), (F.col("event_id") % 100).cast("string")).alias("path"), F.struct(F.col("ts").cast("timestamp").alias("ts"), "event_id").alias("date"), F.col("user_id").cast("string").alias("author"))
    return files.git_log(rows).select("path", F.col("date.ts").alias("date"), "author")


# Streams.


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events, (SELECT max(ts) AS last FROM events) WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= last - INTERVAL 1 HOUR GROUP BY 1, 2""")
def stream_daily(spark, sf):
    from .streaming import ingest as streams

    schema = table(spark, sf, "events").schema
    at = fresh_folder(spark, "daily")
    state.run_to_files(streams.daily_counts(spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")), f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema("day string, event_type string, n long, value double").parquet(f"{at}/out")


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
  g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id AS root, min(ts) AS "from", max(ts) + INTERVAL 1 HOUR AS "to", count(*) AS n FROM g GROUP BY user_id, k""")
def debounced_changes(spark, sf):
    from .streaming import ingest as streams

    return streams.debounced(table(spark, sf, "events"), "user_id", "ts", quiet="1 hour")


# Stored tables.


@query("""SELECT doc_id, b AS version, n_chars FROM documents, range(12) AS t(b) WHERE (doc_id + 7 * b) % 5 = 0 OR (doc_id + 3 * b) % 11 = 0
  QUALIFY b = max(b) OVER (PARTITION BY doc_id) AND (doc_id + 7 * b) % 5 = 0""")
def stored_changes(spark, sf):
    """Batches of upserts and deletions of documents in a stored table, compacted on the way: the last word on each document stands."""
    store, docs = Store(spark, fresh_folder(spark, "stored")), table(spark, sf, "documents")
    for b in range(12):
        rows = docs.where((F.col("doc_id") + 7 * b) % 5 == 0).select("doc_id", F.lit(b).cast("long").alias("version"), "n_chars")
        store.change("documents", rows, ["doc_id"], docs.where((F.col("doc_id") + 3 * b) % 11 == 0))
        if b == 6:
            store.compact("documents")
    return store.read("documents")


class _Scan:
    """A source whose documents are given."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def scan(self, spark: SparkSession) -> DataFrame:
        return self.rows


@query(f"""WITH {FRAGMENTS_SQL} SELECT DISTINCT source_path, content_date, author, {trust.freshness_sql('content_date', 'file_type')} AS freshness, {trust.consistency_sql('confidence_adj')} AS consistency,
  {trust.authority_sql('file_type')} AS authority FROM fragments WHERE source_path IS NOT NULL""")
def stored_trust(spark, sf):
    """Trust of documents by what a store has kept of them: their own dates, authors and adjustments."""
    store = Store(spark, fresh_folder(spark, "corpus"))
    corpus.ingest(store, _Scan(fragments(spark, sf).where("source_path IS NOT NULL")), models.HashEmbedder(8), trust.AS_OF)
    rows = corpus.searchable(store).withColumn("freshness", trust.freshness(F.col("content_date"), F.col("ingested_at"), F.col("file_type")))
    rows = rows.withColumn("consistency", trust.consistency(F.col("confidence_adj"))).withColumn("authority", trust.authority(F.col("file_type")))
    return rows.select("source_path", "content_date", "author", "freshness", "consistency", "authority").distinct()


# Streams with state, and a tree of files as a stream.


@query("""WITH e AS (SELECT DISTINCT event_id, user_id, ts FROM events WHERE event_id IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL), l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM e)
  SELECT user_id AS key, event_id AS id, coalesce(ts - before <= INTERVAL 10 MINUTE, false) AS seen FROM l WHERE epoch_ms(ts) <= (SELECT max(epoch_ms(ts)) FROM e) - 3600000""")
def seen_recently(spark, sf):
    """Of each event that the watermark has passed: whether its user was seen in the ten minutes before."""
    at, schema = fresh_folder(spark, "seen"), table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    state.run_to_files(state.seen_within(stream, "user_id", "event_id", "ts"), f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema("key long, id long, seen boolean").parquet(f"{at}/out")


@query("""SELECT page_id || '.html' AS source_path, 'changed' AS state, sha256(coalesce(html, '')) AS checksum, 1 AS seq FROM pages
  UNION ALL SELECT page_id || '.html', 'changed', sha256(coalesce(html, '') || '<!-- 2 -->'), 2 FROM pages WHERE page_id % 7 = 0 AND page_id % 10 <> 0
  UNION ALL SELECT page_id || '.html', 'deleted', NULL, 2 FROM pages WHERE page_id % 10 = 0""")
def tree_changes(spark, sf):
    """Pages as a tree of files that is read as a stream, changed, and read on: every change once, deletions too."""
    at, pages = fresh_folder(spark, "tree"), table(spark, sf, "pages")
    rows = pages.select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.coalesce("html", F.lit("")).alias("content"), F.lit(False).alias("gone"), "page_id")
    spark.dataSource.register(tree.Tree)
    for k in range(2):
        tree.put(rows, f"{at}/tree")
        stream = spark.readStream.format("corpus_tree").option("path", f"{at}/tree").option("journal", f"{at}/journal").load()
        state.run_to_files(stream, f"{at}/out", f"{at}/checkpoint")
        if k == 0:
            rows = rows.where("page_id % 7 = 0 OR page_id % 10 = 0").withColumn("gone", F.col("page_id") % 10 == 0).withColumn("content", F.concat("content", F.lit("<!-- 2 -->")))
    return spark.read.schema(tree.SCHEMA).parquet(f"{at}/out").select("source_path", "state", "checksum", F.col("seq").cast("int").alias("seq"))


# Exact selection, suffixes as keys, digests of buckets.


@query("""SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, quantile_cont(l_extendedprice, 0.5) AS median, quantile_disc(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY 1, 2""")
def price_quantiles(spark, sf):
    return selection.quantiles(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", cont={"median": 0.5}, disc={"p95": 0.95})


@query(f"""WITH {FRAGMENTS_SQL}, i AS (SELECT DISTINCT doc_id AS id FROM labels WHERE doc_id IS NOT NULL), x AS (SELECT id, id || '.md' AS expected FROM i UNION ALL SELECT id, 'src' || (id % 20) || '/' || id || '.txt' FROM i)
  SELECT x.id AS labelled, expected, source_path FROM fragments, x WHERE source_path = expected OR ends_with(source_path, '/' || expected) OR ends_with(source_path, chr(92) || expected)""")
def sources_in_paths(spark, sf):
    """Expected sources, two for each labelled document, against all paths."""
    ids = table(spark, sf, "labels").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id")).distinct()
    name = F.col("id").cast("string")
    expected = ids.select("id", F.concat(name, F.lit(".md")).alias("expected"))
    expected = expected.unionByName(ids.select("id", F.concat(F.lit("src"), (F.col("id") % 20).cast("string"), F.lit("/"), name, F.lit(".txt")).alias("expected")))
    return evaluate.found_in(fragments(spark, sf, labels=False).select("source_path"), expected).withColumnRenamed("id", "labelled")


@query(SQL["changed_deleted_unchanged"])
def changes_by_digest(spark, sf):
    scanned, known = _scans(spark, sf)
    tree_of = digests.write(known, fresh_folder(spark, "digests"))
    return digests.changes(scanned, tree_of)


@query("""WITH l AS (SELECT strftime(ts, '%Y-%m-%d') AS day, ts, event_id, strftime(ts, '%H:%M:%S') || ' ' || coalesce(event_type, '') || ': ' || coalesce(props, '') || chr(10) AS line FROM events),
  b AS (SELECT *, (sum(strlen(line)) OVER (PARTITION BY day ORDER BY ts, event_id, line ROWS UNBOUNDED PRECEDING) - strlen(line)) // 4096 AS part FROM l)
  SELECT day, part::BIGINT AS part, string_agg(line, '' ORDER BY ts, event_id, line) AS content, count(*) AS n FROM b GROUP BY 1, 2""")
def daily_digest_parts(spark, sf):
    """Daily digests in parts of 4 KiB and a line."""
    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return messages.daily_parts(rows, "ts", "event_type", "props", "event_id", size=4096)


@query("""WITH l AS (SELECT conv_id, turn, coalesce(role, '') || ': ' || coalesce(text, '') || chr(10) AS line FROM conversations),
  b AS (SELECT *, (sum(strlen(line)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, line ROWS UNBOUNDED PRECEDING) - strlen(line)) // 1000 AS part FROM l)
  SELECT conv_id, part::BIGINT AS part, string_agg(line, '' ORDER BY turn NULLS FIRST, line) AS content, count(*) AS n FROM b GROUP BY 1, 2""")
def thread_parts(spark, sf):
    """Threads in parts of 1000 bytes and a line."""
    return messages.thread_parts(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text", size=1000)
