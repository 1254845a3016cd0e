"""A stored corpus from end to end: incremental ingestion, search with trust, overview, export."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import models, trust
from ..functions.text import first_bytes
from ..operators import storage
from ..schema import content
from ..session import written
from ..sources import chunking, messages, pdf, registry
from . import enrichment
from . import query as plans
from .store import Store

FRAGMENTS, REGISTRY = "fragments", "sources"
ENRICHED = ("enriched_content", "enrichment_model", "enrichment_version")
#: A document: what a changed one replaces.
DOCUMENT = ("source_type", "source_name", "source_path")
#: What a fragment keeps of its document, where that has it.
KEPT = {"content_date": "timestamp", "author": "string", "source_uri": "string", "confidence_adj": "double"}


def ingest(store: Store, source: registry.Connector, embedder: models.Embedder, as_of: str) -> tuple[int, int]:
    """Bring a source's changes into the store; (documents changed, paths deleted). Nothing is written where nothing changed."""
    spark = store.spark
    have = store.exists(FRAGMENTS)
    none = spark.createDataFrame([], "source_path string, checksum string")
    scanned = source.scan(spark)
    names = scanned.select("source_type", "source_name").distinct()
    stored = store.read(FRAGMENTS).join(names, ["source_type", "source_name"], "left_semi") if have else None
    known = stored.select("source_path", "checksum").distinct() if have else none
    changed, deleted = registry.incremental(spark, source, known)
    rows = fragments_of(changed, embedder, as_of)
    n_changed, n_deleted = changed.count(), deleted.count()
    if n_changed + n_deleted or not have:
        # A changed document without a chunk left goes as one that is gone.
        gone = changed.select(*DOCUMENT)
        gone = gone.unionByName(stored.join(deleted, "source_path", "left_semi").select(*DOCUMENT)) if have else gone
        store.change(FRAGMENTS, rows, DOCUMENT, gone)
    new = names.select("source_type", "source_name", F.lit("").alias("description"), F.create_map(F.lit("at"), F.lit(as_of)).alias("config"))
    if store.exists(REGISTRY):
        store.update(REGISTRY, lambda t: storage.register(t, new))
    else:
        store.write(REGISTRY, new)
    return n_changed, n_deleted


def fragments_of(documents: DataFrame, embedder: models.Embedder, as_of: str) -> DataFrame:
    """The stored fragments of documents: chunked and embedded, not enriched yet. They keep their document's date, author, address and
    adjustment (KEPT); a PDF file's own date goes before that of its source."""
    for name, kind in KEPT.items():
        documents = documents.withColumn(name, F.col(name).cast(kind) if name in documents.columns else F.lit(None).cast(kind))
    rows = chunking.to_fragments(pdf_dated(documents), keep=(*KEPT,)).drop("metadata").withColumn("idx", F.col("idx").cast("long"))
    for name in ENRICHED:
        rows = rows.withColumn(name, F.lit(None).cast("string"))
    return rows.withColumn("embedding", models.embed(F.col("raw_content"), embedder)).withColumn("ingested_at", F.lit(as_of).cast("timestamp"))


def pdf_dated(documents: DataFrame) -> DataFrame:
    """documents with content_date as PDF files state it; others, and files that state none, keep theirs."""
    is_pdf = F.lower("source_path").endswith(".pdf")
    if "binary" not in documents.schema["raw_content"].dataType.simpleString():
        return documents

    def stamps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data in batch.column(1).to_pylist():
                try:
                    found.append(pdf.stamp(data or b""))
                except (ValueError, KeyError, TypeError, IndexError, AttributeError):  # no file that can be read
                    found.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["row", "stamp"])

    files = documents.where(is_pdf).select(F.struct("*").alias("row"), F.col("raw_content").alias("data"))
    stamped = files.mapInArrow(stamps, T.StructType([files.schema["row"], T.StructField("stamp", T.StringType())]))
    dated = stamped.select("row.*", messages.pdf_time(F.col("stamp")).alias("own")).withColumn("content_date", F.coalesce("own", "content_date")).drop("own")
    return documents.where(~F.coalesce(is_pdf, F.lit(False))).unionByName(dated)


def fitted(table: DataFrame, like: DataFrame) -> DataFrame:
    """table with the columns of another; those that it lacks are null."""
    return table.select(*(F.col(f.name) if f.name in table.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema))


def enrich(store: Store, model: Callable[[str], str | None], name: str, embedder: models.Embedder, version: int = 2) -> int:
    """Enrich what no current enrichment has, embed it anew and store it; how many fragments were stale."""
    table = store.read(FRAGMENTS)
    n = enrichment.stale(table, name, version).count()
    if n:
        store.update(FRAGMENTS, lambda t: enrichment.again(t, model, name, embedder, version=version))
    return n


def search(store: Store, texts: list[str], embedder: models.Embedder, limit: int = 20, as_of: str = trust.AS_OF) -> DataFrame:
    """Hybrid results of each text, with trust."""
    rows = store.read(FRAGMENTS).withColumn("doc_id", F.xxhash64("id")).withColumn("raw_content", content())
    asked = [(i, t, v) for i, (t, v) in enumerate(zip(texts, embedder.embed(texts), strict=True))]
    queries = store.spark.createDataFrame(asked, "query_id long, query string, embedding array<float>")
    vectors = rows.select(F.col("doc_id").alias("vec_id"), "embedding")
    ranked = written(plans.hybrid(rows, queries, limit, vectors=vectors), "ranked")
    return plans.trusted(ranked, searchable(store), as_of)


def searchable(store: Store) -> DataFrame:
    """The stored fragments with the columns that retrieval and trust need."""
    rows = store.read(FRAGMENTS).withColumn("doc_id", F.xxhash64("id"))
    for name, kind in KEPT.items():  # tables of before these were kept
        rows = rows if name in rows.columns else rows.withColumn(name, F.lit(None).cast(kind))
    return rows.withColumn("confidence_adj", F.coalesce("confidence_adj", F.lit(0.0)))


def overview(store: Store) -> DataFrame:
    """source_type, source_name, description, fragments and characters of each registered source."""
    sizes = store.read(FRAGMENTS).groupBy("source_type", "source_name").agg(F.count("*").alias("fragments"), F.sum(F.length("raw_content")).alias("chars"))
    out = store.read(REGISTRY).join(sizes, ["source_type", "source_name"], "left")
    return out.select("source_type", "source_name", "description", F.coalesce("fragments", F.lit(0)).alias("fragments"), F.coalesce("chars", F.lit(0)).alias("chars"))


def source(store: Store, source_type: str, source_name: str) -> dict | None:
    """A registered source, None where there is none."""
    row = store.read(REGISTRY).where((F.col("source_type") == source_type) & (F.col("source_name") == source_name)).first()
    return None if row is None else row.asDict(True)


def describe(store: Store, source_type: str, source_name: str, description: str, force: bool = False) -> None:
    """Describe a source; a description that is there already is kept unless forced."""
    old = source(store, source_type, source_name)
    if old is None:
        raise KeyError(f"{source_type}/{source_name}")
    if old["description"] and not force:
        raise ValueError(f"{source_type}/{source_name} has a description")
    it = (F.col("source_type") == source_type) & (F.col("source_name") == source_name)
    store.update(REGISTRY, lambda t: t.withColumn("description", F.when(it, F.lit(description)).otherwise(F.col("description"))))


def remove(store: Store, source_type: str, source_name: str) -> None:
    """Forget a source and its fragments."""
    store.update(FRAGMENTS, lambda t: storage.delete_source(t, source_type, source_name))
    store.update(REGISTRY, lambda t: storage.delete_source(t, source_type, source_name))


def export_sources(store: Store, to: str) -> None:
    """The registry as JSON lines, merged with what is at ``to`` already; what is stored wins."""
    rows, spark = store.read(REGISTRY), store.spark
    fs, at = store._fs(to)
    if fs.exists(at):
        rows = storage.merge_sources(rows, spark.read.schema(rows.schema).json(to))
    lines = [r["line"] for r in rows.orderBy("source_type", "source_name").select(F.to_json(F.struct(*rows.columns)).alias("line")).collect()]  # a line a source
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(to)


def import_sources(store: Store, path: str) -> None:
    """Take registered sources from a file; they have not been ingested here, so their time of ingestion is cleared."""
    schema = store.read(REGISTRY).schema if store.exists(REGISTRY) else "source_type string, source_name string, description string, config map<string,string>"
    new = store.spark.read.schema(schema).json(path)
    new = new.withColumn("config", F.map_filter("config", lambda k, _: k != "at"))
    store.write(REGISTRY, storage.merge_sources(store.read(REGISTRY), new) if store.exists(REGISTRY) else new)


def info(store: Store, embedder: models.Embedder) -> dict:
    """What runs here: versions, cores, and how much is stored."""
    spark = store.spark
    rows = store.read(FRAGMENTS).agg(F.count("*").alias("n"), F.sum(F.octet_length("raw_content")).alias("bytes")).first() if store.exists(FRAGMENTS) else {"n": 0, "bytes": 0}
    java = spark._jvm.java.lang.System.getProperty
    return {"spark": spark.version, "java": java("java.version"), "system": f"{java('os.name')} {java('os.arch')}", "cores": spark.sparkContext.defaultParallelism, "fragments": rows["n"], "bytes": rows["bytes"] or 0, "dimensions": embedder.dim}


def watch(store: Store, source: registry.Connector, embedder: models.Embedder, now: Callable[[], str], wait: Callable[[], bool]) -> list[tuple[int, int]]:
    """Ingest a source again and again until wait() says that it is over: (changed, deleted) of each round with changes."""
    rounds = []
    while wait():
        found = ingest(store, source, embedder, now())
        if any(found):
            rounds.append(found)
    return rounds


def export(store: Store, to: str) -> None:
    """tensors and metadata as tab-separated text."""
    rows = store.read(FRAGMENTS).where(F.col("embedding").isNotNull()).orderBy("id")
    rows.select(storage.tsv_line(F.col("embedding"))).write.mode("overwrite").text(f"{to}/tensors")
    rows.select(F.concat_ws("\t", "id", "source_path", storage.tsv_text(first_bytes(F.col("raw_content"), 100)))).write.mode("overwrite").text(f"{to}/metadata")
