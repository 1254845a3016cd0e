"""Enrichment of chunks by a model, document by document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import models
from ..operators import storage

BEFORE, AFTER = 3, 1


def run(rows: DataFrame, model: Callable[[str], str | None], name: str, *, version: int = 2, stored: DataFrame | None = None, order: str = "idx", before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """rows (id, source_type, source_path, raw_content, ``order``) with enriched_content, enrichment_model, enrichment_version.

    Stored enrichments (id, raw_content, enriched_content, enrichment_model, enrichment_version) of the same text, model and version are
    taken over. A document with a chunk that has none is given to the model chunk by chunk, each with the texts around it; if the
    model fails on one of its chunks, the document keeps what it had, or its raw text."""
    mark = f"v{version}"
    if stored is None:
        known = rows.withColumn("had", F.lit(None).cast("string"))
    else:
        known = models.reuse(rows, stored.where(F.coalesce("enriched_content", F.lit("")) != ""), name, mark).withColumnRenamed("enriched_content", "had")
    document = ["source_type", "source_path"]
    whole = Window.partitionBy(*document)
    known = models.context(known.withColumn("new", F.max(F.col("had").isNull()).over(whole)), document, order, "raw_content", before, after)
    ask = models.prompt(F.col("raw_content"), F.col("previous"), F.col("following"), version)
    asked = known.where("new").withColumn("said", models.answers(ask, model))
    asked = asked.withColumn("failed", F.max("said.failed").over(whole))
    full = models.enriched(F.col("raw_content"), F.col("said.answer"), version)
    asked = asked.withColumn("enriched_content", F.when(F.col("failed"), F.col("had")).otherwise(full)).select(*rows.columns, "enriched_content")
    out = asked.unionByName(known.where("not new").withColumnRenamed("had", "enriched_content").select(*rows.columns, "enriched_content"))
    done = F.col("enriched_content").isNotNull()
    return out.withColumn("enrichment_model", F.when(done, F.lit(name))).withColumn("enrichment_version", F.when(done, F.lit(mark)))


def stale(table: DataFrame, name: str, version: int = 2) -> DataFrame:
    """Stored fragments that no current enrichment has: of another model or version, or without one."""
    current = (F.col("enrichment_model") == name) & (F.col("enrichment_version") == f"v{version}") & (F.coalesce("enriched_content", F.lit("")) != "")
    return table.where(~F.coalesce(current, F.lit(False)))


def again(table: DataFrame, model: Callable[[str], str | None], name: str, embedder: models.Embedder, *, version: int = 2, order: str = "idx", **options) -> DataFrame:
    """The table after its stale fragments have been enriched and embedded anew. What is around a chunk is found among the stale ones."""
    rest = [c for c in table.columns if c not in ("enriched_content", "enrichment_model", "enrichment_version", "embedding")]
    rows = run(stale(table, name, version).select(*rest), model, name, version=version, order=order, **options)
    rows = rows.withColumn("embedding", models.embed(F.coalesce("enriched_content", "raw_content"), embedder))
    return storage.upsert(table, rows.select(*table.columns))
