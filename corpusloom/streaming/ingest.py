"""Streams: ingestion by batches, daily digests, debounced changes, repeated scans."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import models
from ..operators import storage
from ..plans import corpus
from ..plans.store import Store
from ..sources import files, tree


def ingest(changes: DataFrame, store: Store, name: str, checkpoint: str, key: str = "id"):
    """Apply a stream of rows (with ``deleted``) to a stored table, batch by batch; returns the query. A batch that runs again
    gives the same table, since rows are replaced by key."""

    def apply(batch: DataFrame, number: int) -> None:
        rows = batch.where(~F.coalesce("deleted", F.lit(False))).drop("deleted")
        gone = batch.where(F.coalesce("deleted", F.lit(False))).select(key).distinct()
        store.change(name, storage.upsert(rows.limit(0), rows.join(gone, key, "left_anti"), key), [key], gone)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folder_stream(spark: SparkSession, root: str, name: str, source_type: str = "filesystem") -> DataFrame:
    """The documents of a tree as they come: files that are new there, by the rules of ``files.wanted``. Files that change later are found
    by ``corpus.ingest``, which compares checksums."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(root)
    base = root if "://" in root else f"file:{root}"
    below = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^{re.escape(re.sub('^file:/+', '/', base).rstrip('/'))}/", "")
    rows = found.withColumn("source_path", below).where(files.wanted(F.col("source_path"), F.col("length")))
    rows = rows.where(F.lower("source_path").endswith(".pdf") | ~F.contains(F.substring("content", 1, 8192), F.lit(b"\0")))
    return rows.select(
        F.lit(source_type).alias("source_type"), F.lit(name).alias("source_name"), "source_path", F.col("content").alias("raw_content"), F.sha2("content", 256).alias("checksum"),
        F.col("modificationTime").alias("content_date"),
    )


def ingest_documents(documents: DataFrame, store: Store, embedder: models.Embedder, checkpoint: str, as_of: str, name: str = "fragments"):
    """Chunk, embed and store a stream of documents batch by batch; returns the query. A document's fragments replace those it had; one that
    is ``deleted`` (where the stream says so) has none from then on."""

    def apply(batch: DataFrame, number: int) -> None:
        there = batch.where(~F.coalesce("deleted", F.lit(False))).drop("deleted") if "deleted" in batch.columns else batch
        store.change(name, corpus.fragments_of(there, embedder, as_of), corpus.DOCUMENT, batch.select(*corpus.DOCUMENT))

    return documents.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tree_stream(spark: SparkSession, root: str, journal: str, name: str, source_type: str = "filesystem") -> DataFrame:
    """The changes of a tree as they come, deletions too, by the rules of ``files.wanted``: documents with ``deleted``. The journal folder goes with
    the stream's checkpoint."""
    spark.dataSource.register(tree.Tree)
    rows = spark.readStream.format("corpus_tree").option("path", root).option("journal", journal).option("most_bytes", files.MOST_BYTES).load()
    deleted = F.col("state") == "deleted"
    text = files.wanted(F.col("source_path"), F.col("size")) & (F.lower("source_path").endswith(".pdf") | ~F.contains(F.substring("raw_content", 1, 8192), F.lit(b"\0")))
    # A file that has become one that is not wanted goes, as one that was deleted does.
    gone = deleted | ~F.coalesce(text, F.lit(False))
    uri = F.concat(F.lit(f"{root if '://' in root else 'file://' + root}/"), "source_path")
    return rows.select(
        F.lit(source_type).alias("source_type"), F.lit(name).alias("source_name"), "source_path", "raw_content", "checksum", "content_date", uri.alias("source_uri"), gone.alias("deleted"), "seq",
    )


def ingest_tree(spark: SparkSession, root: str, store: Store, embedder: models.Embedder, checkpoint: str, as_of: str, *, name: str, table: str = "fragments"):
    """Bring a stored table up to date with a tree: what is new or changed is chunked and embedded, and what is gone goes. Returns the query."""

    def apply(batch: DataFrame, number: int) -> None:
        last = Window.partitionBy("source_path").orderBy(F.col("seq").desc())
        now = batch.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth", "seq")
        there = now.where("not deleted").drop("deleted")
        store.change(table, corpus.fragments_of(there, embedder, as_of), corpus.DOCUMENT, now.select(*corpus.DOCUMENT))

    rows = tree_stream(spark, root, f"{checkpoint}/journal", name)
    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table_stream(spark: SparkSession, sf_dir: str, name: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def daily_counts(events: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """day, event_type, n, value of each closed day of an event stream."""
    timed = events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", late)
    out = timed.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "value")


def debounced(changes: DataFrame, root: str, ts: str, quiet: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """root, from, to, n of each burst of changes, ended by ``quiet`` without one."""
    timed = changes.withColumn("at", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("at", late) if changes.isStreaming else timed
    out = timed.groupBy(F.session_window("at", quiet).alias("w"), F.col(root).alias("root")).agg(F.count("*").alias("n"))
    return out.select("root", F.col("w.start").alias("from"), F.col("w.end").alias("to"), "n")


def once(scans: DataFrame, keys: list[str], ts: str, within: str = "1 day") -> DataFrame:
    """Rows of overlapping scans, each (keys) once within the time that scans overlap."""
    timed = scans.withColumn("at", F.col(ts).cast("timestamp"))
    return timed.withWatermark("at", within).dropDuplicatesWithinWatermark(keys) if scans.isStreaming else timed.dropDuplicates(keys)


def run_to_memory(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is now, and read its rows."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
