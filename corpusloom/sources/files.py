"""File trees and version control as document sources."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 1 << 20
# Folders, files and endings that hold nothing to retrieve.
SKIPPED_FOLDERS = ("node_modules", "vendor", ".git", "__pycache__", ".venv", "dist", "build")
SKIPPED_FILES = (
    "package-lock.json", "pnpm-lock.yaml", "LICENSE", "LICENSE.md", "LICENSE.txt", "NOTICE", "NOTICE.md",
    ".gitignore", ".gitattributes", ".editorconfig", ".DS_Store",
)
SKIPPED_ENDINGS = (".min.js", ".min.css", ".map", ".pb.go", ".gen.go")
BINARY = (
    ".exe", ".bin", ".o", ".a", ".so", ".dylib", ".dll", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".bmp", ".svg", ".webp", ".woff", ".woff2", ".ttf",
    ".otf", ".eot", ".zip", ".tar", ".gz", ".bz2", ".xz", ".7z", ".rar", ".tgz", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".db", ".db-shm",
    ".db-wal", ".db-journal", ".sqlite", ".sqlite3", ".mp3", ".mp4", ".wav", ".avi", ".mov", ".flac", ".ogg", ".webm", ".parquet", ".arrow", ".avro",
    ".tfrecord", ".lock", ".sum", ".wasm", ".pyc", ".pyo", ".class", ".jar", ".war",
)


def wanted(path: Column, size: Column) -> Column:
    """Whether a file, named by its path below the root, is read."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    low = F.lower(name)
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    ext = F.regexp_extract(low, r"(\.[^.]*)$", 1)
    skipped = F.exists(folders, lambda d: d.isin(*SKIPPED_FOLDERS) | d.startswith("."))
    ending = F.lit(False)
    for e in SKIPPED_ENDINGS:
        ending = ending | low.endswith(e)
    return ~(skipped | name.startswith(".") | name.isin(*SKIPPED_FILES) | ending | F.contains(low, F.lit(".generated.")) | low.startswith("_generated") | ext.isin(*BINARY) | (size > MOST_BYTES))


def walk(root: str) -> Iterator[tuple[str, int, float]]:
    """(path below root, bytes, time of change) of the files of a tree; links to folders are not followed."""
    for folder, names, files in os.walk(root):
        names[:] = sorted(n for n in names if n not in SKIPPED_FOLDERS and not n.startswith("."))
        for name in sorted(files):
            full = os.path.join(folder, name)
            if os.path.isfile(full):
                yield os.path.relpath(full, root).replace(os.sep, "/"), os.path.getsize(full), os.path.getmtime(full)


def scan(spark: SparkSession, root: str, name: str | None = None, source_type: str = "filesystem", only: list[str] | None = None) -> DataFrame:
    """raw_documents of a tree, or of the files of it in ``only``, by the same rules. Names are listed on the driver; files are read by the tasks. Text with a byte 0 in its first
    8 KiB is binary and left out, but for PDF."""
    names = walk(root) if only is None else ((p, os.path.getsize(f"{root}/{p}"), os.path.getmtime(f"{root}/{p}")) for p in only if os.path.isfile(f"{root}/{p}"))
    listed = spark.createDataFrame([*names], "path string, size long, changed double")
    files = listed.where(wanted(F.col("path"), F.col("size"))).repartition(max(1, spark.sparkContext.defaultParallelism), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, changed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        data = f.read(MOST_BYTES + 1)
                except OSError:
                    continue
                if len(data) <= MOST_BYTES and (path.lower().endswith(".pdf") or b"\0" not in data[:8192]):
                    rows.append({"path": path, "content": data, "changed": changed, "checksum": hashlib.sha256(data).hexdigest()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("content", pa.binary()), ("changed", pa.float64()), ("checksum", pa.string())]))

    out = files.select("path", "changed").mapInArrow(read, "path string, content binary, changed double, checksum string")
    return out.select(
        F.col("path").alias("source_path"), F.col("content").alias("raw_content"), F.timestamp_seconds("changed").alias("content_date"),
        F.lit(f"file://{os.path.abspath(root)}/").alias("base"), F.lit(source_type).alias("source_type"), F.lit(name or os.path.basename(os.path.abspath(root))).alias("source_name"), "checksum",
    ).withColumn("source_uri", F.concat("base", "source_path")).drop("base")


def git_log(lines: DataFrame) -> DataFrame:
    """path, date, author: the last change of each path, from parsed log rows (commit order, ISO date, author, path)."""
    when = F.struct("date", "author")
    return lines.groupBy("path").agg(F.max_by(when, F.col("date")).alias("w")).select("path", "w.date", "w.author")


def name_status(rows: DataFrame) -> DataFrame:
    """path, state from rows (status, path, new_path): A and M changed, D deleted, R and C delete the old path and change the new."""
    s = F.substring("status", 1, 1)
    moved = s.isin("R", "C")
    states = F.when(moved, F.array(F.struct(F.col("path").alias("path"), F.lit("deleted").alias("state")), F.struct(F.col("new_path").alias("path"), F.lit("changed").alias("state"))))
    states = states.when(s == "D", F.array(F.struct(F.col("path").alias("path"), F.lit("deleted").alias("state")))).when(s.isin("A", "M"), F.array(F.struct(F.col("path").alias("path"), F.lit("changed").alias("state"))))
    return rows.select(F.explode(states).alias("x")).select("x.path", "x.state").distinct()


def repository_name(url: Column) -> Column:
    """owner/name of a repository's address."""
    return F.regexp_extract(F.regexp_replace(F.regexp_replace(url, r"\.git/?$", ""), ":", "/"), r"([^/]+/[^/]+)/?$", 1)


def wiki_page(path: Column) -> Column:
    """A wiki page's name: its path without the file's ending."""
    return F.regexp_replace(path, r"\.[^./]*$", "")
