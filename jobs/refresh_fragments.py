"""Keep the passages of a document corpus current: an incremental job.

    python -m jobs.refresh_fragments --documents PATH --output PATH --checkpoint PATH [--config FILE]

A folder (or a glob) of Parquet files of documents (doc_id, text, source) grows. Each run takes the files that no run has taken (a file stream with its
checkpoint), keeps the newest row of each document in them, leaves out those whose text is what is stored already, and cuts the others
into overlapping passages with the ids by which fragments are cited. A later row of a document replaces its passages; one without
words leaves it none.

Output: a row for each version of a document, in folders ``batch=N/source_key=S``; ``current`` reads the newest version of each. A batch is
written with Spark's overwrite to the folder of its number, and compared with earlier batches only, so a batch that was cut off and runs
again gives the same files. Output and checkpoint belong together: a new checkpoint needs a new output.

Nulls: a document without doc_id is known by its text's checksum; a null text has no words; a null source is an empty one in paths.
Rows of one doc_id in a batch: the one of the newest file, of the last path, of the largest checksum and source stays. Texts of any length are taken
whole. Other columns are ignored. An empty folder gives no rows.
"""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import words as word_count
from corpusloom.operators import storage
from corpusloom.schema import fragment_id

log = logging.getLogger("jobs.refresh_fragments")
CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "refresh_fragments.json")
PASSAGE = "passage_no: bigint, fragment_id: string, content: string, n_tokens: bigint"
STORED = f"key string, doc_id bigint, source string, checksum string, passages array<struct<{PASSAGE}>>, batch bigint, source_key string"


def settings(path: str | None = None) -> dict:
    with open(path or CONFIG, encoding="utf-8") as f:
        return json.load(f)


def windows(text: Column, size: int, overlap: int) -> Column:
    """Runs of ``size`` words, each beginning with the last ``overlap`` words of the one before, joined by a space."""
    if not 0 <= overlap < size:
        raise ValueError("passages must be longer than what they share")
    step = size - overlap

    def of(words: Column) -> Column:
        count = F.greatest(F.when(F.size(words) > 0, 1).otherwise(0), F.ceil((F.size(words) - overlap) / step)).cast("int")
        starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(starts, lambda k: F.array_join(F.slice(words, k * step + 1, F.lit(size)), " "))

    # Inside an array the words are made once, not once for each passage.
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return F.get(F.transform(F.array(words), of), F.lit(0))


def cut(documents: DataFrame, config: dict) -> DataFrame:
    """documents with ``passages``: number, id, content and tokens of each."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), "key")
    texts = windows(F.col("text"), config["passage_words"], config["overlap_words"])
    whole = F.transform(
        texts,
        lambda t, k: F.struct(
            k.cast("long").alias("passage_no"), fragment_id(F.lit("documents"), path, k).alias("fragment_id"), t.alias("content"), word_count(t).cast("long").alias("n_tokens")
        ),
    )
    return documents.withColumn("passages", whole)


def keyed(batch: DataFrame) -> DataFrame:
    """The rows of a batch with key, checksum and ``place``, by which one row of a document is newer than another."""
    text = F.coalesce("text", F.lit(""))
    rows = batch.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text.alias("text"), F.sha2(text, 256).alias("checksum"), "file_time", "file_path")
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("sha256:"), "checksum"))
    return rows.withColumn("key", key).withColumn("place", F.struct("file_time", "file_path", "checksum", F.coalesce("source", F.lit("")).alias("source"))).drop("file_time", "file_path")


def stored(spark: SparkSession, output: str) -> DataFrame:
    """All versions written so far."""
    try:
        return spark.read.schema(STORED).parquet(output)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORED)


def versions(rows: DataFrame) -> DataFrame:
    """key, batch, checksum of each document's newest version."""
    last = rows.groupBy("key").agg(F.max(F.struct("batch", "checksum")).alias("last"))
    return last.select("key", "last.batch", "last.checksum")


def current(spark: SparkSession, output: str) -> DataFrame:
    """The passages as they stand: doc_id, source, passage_no, fragment_id, content, n_tokens, checksum."""
    rows = stored(spark, output)
    rows = rows.join(versions(rows).select("key", "batch"), ["key", "batch"], "left_semi")
    return rows.select("doc_id", "source", "checksum", F.explode("passages").alias("p")).select("doc_id", "source", "p.*", "checksum")


def take(batch: DataFrame, number: int, output: str, config: dict) -> None:
    """Write what is new or changed in a batch, as batch ``number``."""
    spark = batch.sparkSession
    rows = keyed(batch)
    # What changed is found without texts; then those that changed are fetched, once for each document.
    newest = rows.groupBy("key").agg(F.max("place").alias("place")).select("key", "place", "place.checksum")
    earlier = stored(spark, output).where(F.col("batch") < number).select("key", "batch", "checksum")
    known = versions(earlier.join(newest, "key", "left_semi")).select("key", "checksum")
    changed = newest.join(storage.changes(newest, known, path="key").where("state = 'changed'"), "key", "left_semi").select("key", "place")
    changed = cut(rows.join(changed, ["key", "place"], "left_semi").dropDuplicates(["key", "place"]), config)
    changed = changed.select("key", "doc_id", "source", "checksum", "passages")
    to = f"{output}/batch={number}"
    # Rebalancing keeps a source's rows together, and cuts a large source into several tasks.
    changed = changed.withColumn("source_key", F.coalesce("source", F.lit(""))).hint("rebalance", "source_key")
    changed.write.mode("overwrite").partitionBy("source_key").parquet(to)
    done = spark.read.schema(STORED).parquet(to).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("passages")), F.lit(0)).alias("passages")).first()
    log.info("batch %d: read %d rows, wrote %d documents of %d passages to %s", number, batch.count(), done["n"], done["passages"], to)


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, config: dict | None = None) -> None:
    """Take all files that are new in ``documents``, and return when they are written."""
    config = config or settings()
    log.info("reading new files of %s", documents)
    rows = spark.readStream.schema("doc_id bigint, text string, source string").option("maxFilesPerTrigger", config["files_per_batch"]).parquet(documents)
    rows = rows.select("doc_id", "text", "source", F.col("_metadata.file_modification_time").alias("file_time"), F.col("_metadata.file_path").alias("file_path"))
    stream = rows.writeStream.foreachBatch(lambda batch, number: take(batch, number, output, config)).option("checkpointLocation", checkpoint)
    stream.trigger(availableNow=True).start().awaitTermination()


def main() -> None:
    args = argparse.ArgumentParser(description="Keep the passages of a document corpus current.")
    for name in ("documents", "output", "checkpoint"):
        args.add_argument(f"--{name}", required=True)
    args.add_argument("--config")
    given = args.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("refresh_fragments").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, given.documents, given.output, given.checkpoint, settings(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
