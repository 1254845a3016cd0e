"""Kinds of sources by name, and batches that are pushed in."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import storage
from ..schema import fragment_id
from . import files, git, remote


class Connector(Protocol):
    """A source of documents: what there is now, as source_type, source_name, source_path, raw_content, checksum."""

    def scan(self, spark: SparkSession) -> DataFrame: ...


class Folder:
    def __init__(self, root: str, name: str | None = None):
        self.root, self.name = root, name

    def scan(self, spark: SparkSession) -> DataFrame:
        rows = files.scan(spark, self.root, self.name)
        return git.dated(spark, rows, self.root) if os.path.isdir(os.path.join(self.root, ".git")) else rows


class Table:
    """Documents in a table that Spark reads, with columns named in ``columns``."""

    def __init__(self, path: str, name: str, columns: dict[str, str]):
        self.path, self.name, self.columns = path, name, columns

    def scan(self, spark: SparkSession) -> DataFrame:
        rows = spark.read.parquet(self.path)
        text = F.col(self.columns["raw_content"])
        return rows.select(F.lit("table").alias("source_type"), F.lit(self.name).alias("source_name"), F.col(self.columns["source_path"]).cast("string").alias("source_path"), text.alias("raw_content"), F.sha2(text, 256).alias("checksum"))


KINDS: dict[str, Callable[..., Connector]] = {"filesystem": Folder, "table": Table, "git": git.Git, "github_wiki": git.Wiki, "slack": remote.Chat, "confluence": remote.Pages}


def register(kind: str, make: Callable[..., Connector]) -> None:
    """Make a kind of source known by name."""
    KINDS[kind] = make


def connector(kind: str, **config) -> Connector:
    if kind not in KINDS:
        raise ValueError(f"no such kind of source: {kind}")
    return KINDS[kind](**config)


def incremental(spark: SparkSession, source: Connector, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents that are new or changed, paths that are gone) against known(source_path, checksum)."""
    scanned = source.scan(spark)
    state = storage.changes(scanned, known)
    return scanned.join(state.where("state = 'changed'").select("source_path"), "source_path", "left_semi"), state.where("state = 'deleted'").select("source_path")


def batches(rows: DataFrame, most_bytes: int = 10 << 20) -> DataFrame:
    """rows with ``batch``: pushes of about most_bytes of JSON each, by the mean size of a row. rows: pos counts from 0."""
    size = F.octet_length(F.to_json(F.struct(*rows.columns)))
    total = rows.agg(F.sum(size).alias("bytes"), F.count("*").alias("n"))
    mean = F.greatest(F.floor(F.col("bytes") / F.greatest("n", F.lit(1))), F.lit(1))
    per = F.when(F.col("bytes") <= most_bytes, F.greatest("n", F.lit(1))).otherwise(F.greatest(F.floor(F.lit(most_bytes) / mean), F.lit(1)))
    return rows.crossJoin(F.broadcast(total.select(per.alias("per")))).withColumn("batch", F.floor(F.col("pos") / F.col("per")).cast("long")).drop("per")


def pushes(rows: DataFrame, deleted: DataFrame, most_bytes: int = 10 << 20) -> Iterator[str]:
    """The bodies of a client's pushes, one after the other; the first has the deletions. rows: source_type, source_name, source_path,
    content, checksum, pos; deleted: source_type, source_name, path."""
    gone = [r.asDict() for r in deleted.collect()]  # paths only
    held, at = [], None
    for r in batches(rows, most_bytes).orderBy("pos").toLocalIterator():
        if at is not None and r["batch"] != at:
            yield json.dumps({"fragments": held, "deleted": gone})
            held, gone = [], []
        held.append({k: v for k, v in r.asDict().items() if k not in ("pos", "batch")})
        at = r["batch"]
    if held or gone:
        yield json.dumps({"fragments": held, "deleted": gone})


def pushed(table: DataFrame, rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """The table after a push: deletions by path, then fragments of documents whose checksum is new. rows: source_type,
    source_name, source_path, raw_content, checksum, pos; ids count the fragments of each document."""
    left = storage.delete_paths(table, deleted)
    same = left.select("source_type", "source_path", "checksum").distinct()
    new = rows.join(same, ["source_type", "source_path", "checksum"], "left_anti")
    by = Window.partitionBy("source_type", "source_path").orderBy("pos")
    new = new.withColumn("id", fragment_id(F.col("source_type"), F.col("source_path"), F.row_number().over(by) - 1))
    return storage.replace_paths(left, new.select(*table.columns))
