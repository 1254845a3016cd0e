"""Version control as a source: a clone on the driver, whose files are written once to a folder that Spark reads."""

from __future__ import annotations

import hashlib
import os
import re
import shutil
import subprocess
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

SCHEMA = "source_path string, raw_content binary, checksum string"
#: Bytes of files that are sent to Spark at once.
BLOCK = 32 << 20


def _git(args: list[str], folder: str | None = None) -> str:
    return subprocess.run(["git", *args], cwd=folder, check=True, capture_output=True, text=True).stdout


@dataclass
class Scan:
    """What a scan found: the head commit, documents, deleted paths (None: whatever is not among the documents), and how it looked."""

    head: str
    documents: DataFrame
    deleted: DataFrame | None
    mode: str


@dataclass
class Git:
    """A repository. work: a folder, as a URI that Spark can write, in which file contents are put."""

    url: str
    work: str
    branch: str = ""
    commit: str = ""
    last_commit: str = ""
    source_type: str = "git"
    run: Callable[..., str] = field(default=_git)

    @property
    def name(self) -> str:
        """owner/name of the address."""
        return "/".join(re.split(r"[/:]", re.sub(r"\.git/?$", "", self.url).rstrip("/"))[-2:])

    @property
    def base(self) -> str:
        """The address before a document's path."""
        return re.sub(r"\.git/?$", "", self.url).rstrip("/") + "/blob/" + (self.commit or self.branch or "HEAD")

    def scan(self, spark: SparkSession) -> DataFrame:
        """All documents, as other connectors give them."""
        return self.fetch(spark, force=True).documents

    def fetch(self, spark: SparkSession, *, force: bool = False) -> Scan:
        """Pinned to a commit: its whole tree. With the commit of the last scan: what changed since, if that commit can be reached.
        Else a shallow clone."""
        folder = tempfile.mkdtemp(prefix="corpusloom-git-")  # the clone is the driver's own; tasks never read it
        try:
            pinned = bool(self.commit)
            diff = bool(self.last_commit) and not force and not pinned
            how = ["--filter=tree:0", "--no-checkout"] if pinned else ["--filter=blob:none", "--no-checkout"] if diff else ["--depth", "1"]
            self.run(["clone", "--quiet", *how, *(["--branch", self.branch] if self.branch else []), self.url, folder])
            if pinned:
                self.run(["-c", "advice.detachedHead=false", "checkout", "--quiet", self.commit], folder)
            head = self.run(["rev-parse", "HEAD"], folder).strip()
            if diff:
                try:
                    return self._since(spark, folder, head)
                except subprocess.CalledProcessError:  # the last commit is gone, as after a forced push
                    self.run(["checkout", "--quiet", "HEAD"], folder)
            names = [path for path, _, _ in files.walk(folder)]
            return Scan(head, self._documents(spark, folder, names), None, "commit" if pinned else "full")
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    def _since(self, spark: SparkSession, folder: str, head: str) -> Scan:
        self.run(["cat-file", "-t", self.last_commit], folder)
        lines = self.run(["diff", "--name-status", f"{self.last_commit}..HEAD"], folder).splitlines()
        rows = [(x + ["", "", ""])[:3] for x in (line.split("\t") for line in lines if line)]
        states = files.name_status(spark.createDataFrame(rows, "status string, path string, new_path string"))
        changed = sorted(r["path"] for r in states.where("state = 'changed'").collect())  # as many as the difference has
        for k in range(0, len(changed), 500):
            self.run(["checkout", "--quiet", "HEAD", "--", *changed[k : k + 500]], folder)
        gone = states.where("state = 'deleted'").select(F.col("path").alias("source_path"))
        return Scan(head, self._documents(spark, folder, changed), gone, "diff")

    def _documents(self, spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
        sizes = [(n, os.path.getsize(f"{folder}/{n}")) for n in names if os.path.isfile(f"{folder}/{n}")]
        good = [r["path"] for r in spark.createDataFrame(sizes, "path string, size long").where(files.wanted(F.col("path"), F.col("size"))).sort("path").collect()]
        to = f"{self.work.rstrip('/')}/git-{uuid.uuid4().hex}"
        spark.createDataFrame([], SCHEMA).write.parquet(to)
        for block in self._blocks(folder, good):
            spark.createDataFrame(block, SCHEMA).write.mode("append").parquet(to)
        out = spark.read.schema(SCHEMA).parquet(to)
        return out.select(
            F.lit(self.source_type).alias("source_type"), F.lit(self.name).alias("source_name"), "source_path", "raw_content", "checksum",
            F.concat(F.lit(f"{self.base}/"), self._address(F.col("source_path"))).alias("source_uri"),
        )

    def _address(self, path):
        return path

    def _blocks(self, folder: str, names: list[str]) -> Iterator[list[tuple[str, bytes, str]]]:
        block, size = [], 0
        for name in names:
            with open(f"{folder}/{name}", "rb") as f:
                data = f.read()
            if not name.lower().endswith(".pdf") and b"\0" in data[:8192]:
                continue
            block.append((name, data, hashlib.sha256(data).hexdigest()))
            size += len(data)
            if size > BLOCK:
                yield block
                block, size = [], 0
        if block:
            yield block


@dataclass
class Wiki(Git):
    """The wiki of a repository; a page's address is its path without the file's ending."""

    source_type: str = "github_wiki"

    def __post_init__(self) -> None:
        self.url = re.sub(r"(\.wiki)?(\.git)?/?$", "", self.url) + ".wiki.git"

    @property
    def name(self) -> str:
        return super().name.removesuffix(".wiki")

    @property
    def base(self) -> str:
        return re.sub(r"\.wiki\.git$", "", self.url) + "/wiki"

    def _address(self, path):
        return files.wiki_page(path)


def log(spark: SparkSession, folder: str, run: Callable[..., str] = _git) -> DataFrame:
    """path, date, author: the last change of every file of a clone."""
    rows, when, who = [], None, ""
    for line in run(["log", "--format=%aI|%aN", "--name-only", "--diff-filter=ACMR", "HEAD"], folder).splitlines():
        head = re.match(r"(\d{4}-\d\d-\d\dT[0-9:.]+(?:Z|[+-]\d\d:\d\d))\|(.*)$", line)
        if head:
            when, who = head[1], head[2]
        elif line and when:
            rows.append((line, when, who))
    parsed = spark.createDataFrame(rows, "path string, at string, author string").select("path", F.to_timestamp("at").alias("date"), "author")
    return files.git_log(parsed)


def dated(spark: SparkSession, documents: DataFrame, folder: str, run: Callable[..., str] = _git) -> DataFrame:
    """documents of a work tree with the date and author of each file's last change; files that no commit has keep their own date."""
    try:
        changes = log(spark, folder, run)
    except subprocess.CalledProcessError:  # no commit yet
        return documents.withColumn("author", F.lit(None).cast("string"))
    changes = changes.select(F.col("path").alias("source_path"), "date", F.col("author").alias("by"))
    out = documents.join(changes, "source_path", "left").withColumn("content_date", F.coalesce("date", "content_date"))
    return out.withColumn("author", F.col("by")).drop("date", "by")
