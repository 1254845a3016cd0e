"""A tree of files as a stream: a Python data source whose offsets count the listings of the tree.

Each time Spark asks how far the source is, the tree is listed (names, sizes and times of change only) and compared with the listing
before. What differs is written as the next segment of a journal, changed files first and deleted paths last, and the segment's number is the
offset. A batch is the segments between two offsets; tasks read slices of them, and the files they name. So a stream that stops and starts again
gets every change once: a segment is written before its offset is known to Spark, and is removed only when Spark has committed it. From time to
time the state of the tree is written beside the segments, so that a restart does not read all of the journal's past.

A file is changed if its size or time is another one. A file that is gone when a task comes to it has no row: its deletion follows in a later
segment. Files of more than ``most_bytes`` have a row without content. Any file system that pyarrow opens by URI can hold tree and journal.
A null or empty tree gives no rows. Names are held by the driver, contents are not.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "source_path string, state string, raw_content binary, checksum string, content_date timestamp, size long, seq long"
_JOURNAL = pa.schema([("path", pa.string()), ("size", pa.int64()), ("changed", pa.int64()), ("deleted", pa.bool_())])
#: Files of a task, bytes of a record batch, and segments after which the state is written.
FILES, BATCH_BYTES, SNAPSHOT = 200, 16 << 20, 16


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI, or of a local path."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def listing(uri: str) -> dict[str, tuple[int, int]]:
    """path below the root: (size, time of change in ns) of each file. Hidden folders and files, as writers leave them, are passed over."""
    fs, root = opened(uri)
    root = root.rstrip("/")
    found = {}
    for info in fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
        path = info.path[len(root) + 1 :]
        if info.type == pafs.FileType.File and not any(part.startswith(".") for part in path.split("/")):
            found[path] = (info.size, info.mtime_ns or 0)
    return found


class Journal:
    """Segments and states in a folder."""

    def __init__(self, uri: str):
        self.fs, self.root = opened(uri)
        self.root = self.root.rstrip("/")
        self.fs.create_dir(self.root, recursive=True)

    def _numbers(self, kind: str) -> list[int]:
        names = [i.base_name for i in self.fs.get_file_info(pafs.FileSelector(self.root))]
        return sorted(int(n.split("-")[1].split(".")[0]) for n in names if n.startswith(f"{kind}-"))

    def _name(self, kind: str, number: int) -> str:
        return f"{self.root}/{kind}-{number:010d}.parquet"

    def _write(self, kind: str, number: int, rows: list[tuple]) -> None:
        table = pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, _JOURNAL, strict=True)], schema=_JOURNAL)
        beside = f"{self.root}/.{uuid.uuid4().hex}"
        pq.write_table(table, beside, filesystem=self.fs)
        self.fs.move(beside, self._name(kind, number))

    def last(self) -> int:
        return max([0, *self._numbers("segment")[-1:], *self._numbers("state")[-1:]])

    def read(self, number: int) -> pa.Table:
        return pq.read_table(self._name("segment", number), filesystem=self.fs)

    def rows(self, number: int) -> int:
        with self.fs.open_input_file(self._name("segment", number)) as f:
            return pq.read_metadata(f).num_rows

    def state(self) -> dict[str, tuple[int, int]]:
        """The tree as the journal has it."""
        states = self._numbers("state")
        known: dict[str, tuple[int, int]] = {}
        tables = [pq.read_table(self._name("state", states[-1]), filesystem=self.fs)] if states else []
        tables += [self.read(n) for n in self._numbers("segment") if not states or n > states[-1]]
        for table in tables:
            for path, size, changed, deleted in zip(*(c.to_pylist() for c in table.columns), strict=True):
                if deleted:
                    known.pop(path, None)
                else:
                    known[path] = (size, changed)
        return known

    def append(self, known: dict, now: dict) -> int:
        """Write what differs as the next segment; the number of the last one."""
        rows = [(p, *v, False) for p, v in sorted(now.items()) if known.get(p) != v] + [(p, None, None, True) for p in sorted(known.keys() - now.keys())]
        number = self.last()
        if rows:
            number += 1
            self._write("segment", number, rows)
        return number

    def forget(self, end: int, most: int = SNAPSHOT) -> None:
        """Segments up to ``end`` have been committed. When there are ``most`` of them, write the state there and remove them."""
        done = [n for n in self._numbers("segment") if n <= end]
        if len(done) < most:
            return
        states = self._numbers("state")
        known: dict[str, tuple[int, int]] = {}
        tables = [pq.read_table(self._name("state", states[-1]), filesystem=self.fs)] if states else []
        for table in [*tables, *(self.read(n) for n in done)]:
            for path, size, changed, deleted in zip(*(c.to_pylist() for c in table.columns), strict=True):
                known.pop(path, None)
                if not deleted:
                    known[path] = (size, changed)
        self._write("state", end, [(p, *v, False) for p, v in sorted(known.items())])
        for kind, numbers in (("segment", done), ("state", states)):
            for n in numbers:
                self.fs.delete_file(self._name(kind, n))


@dataclass
class Slice(InputPartition):
    segment: int
    low: int
    high: int


class TreeStreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.journal_path = options["path"], options["journal"]
        self.files, self.most = int(options.get("files_per_task", FILES)), int(options.get("most_bytes", 1 << 62))
        self.most_segments = int(options.get("most_segments", SNAPSHOT))
        self.known = None

    def initialOffset(self) -> dict:
        return {"segment": 0}

    def latestOffset(self) -> dict:
        journal = Journal(self.journal_path)
        if self.known is None:
            self.known = journal.state()
        now = listing(self.path)
        number = journal.append(self.known, now)
        self.known = now
        return {"segment": number}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        journal, out = Journal(self.journal_path), []
        for n in range(start["segment"] + 1, end["segment"] + 1):
            size = journal.rows(n)
            out += [Slice(n, k, min(k + self.files, size)) for k in range(0, size, self.files)]
        return out

    def commit(self, end: dict) -> None:
        Journal(self.journal_path).forget(end["segment"], self.most_segments)

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        fs, root = opened(self.path)
        table = Journal(self.journal_path).read(partition.segment).slice(partition.low, partition.high - partition.low)
        rows, size = [], 0
        for path, length, changed, deleted in zip(*(c.to_pylist() for c in table.columns), strict=True):
            if deleted:
                rows.append((path, "deleted", None, None, None, None, partition.segment))
                continue
            content = None
            if length <= self.most:
                try:
                    with fs.open_input_stream(f"{root.rstrip('/')}/{path}") as f:
                        content = f.read()
                except FileNotFoundError:
                    continue
            rows.append((path, "changed", content, None if content is None else hashlib.sha256(content).hexdigest(), changed // 1000, length, partition.segment))
            size += len(content or b"")
            if size > BATCH_BYTES:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.binary(), pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.int64()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class Tree(DataSource):
    """``spark.readStream.format("corpus_tree").option("path", ...).option("journal", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "corpus_tree"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TreeStreamReader:
        for name in ("path", "journal"):
            if name not in self.options:
                raise ValueError(f"option {name} is missing: {json.dumps(sorted(self.options))}")
        return TreeStreamReader(dict(self.options.items()))


def put(rows, root: str) -> int:
    """Write each row's ``content`` (text; null: empty) to its ``path`` below root, or remove that file where ``content`` is ``gone``; how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(root)
        for batch in batches:
            for path, content, gone in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                at = f"{base.rstrip('/')}/{path}"
                if gone:
                    if fs.get_file_info(at).type != pafs.FileType.NotFound:  # a task that runs again finds it gone
                        fs.delete_file(at)
                    continue
                fs.create_dir(at.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(at) as out:
                    out.write((content or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return sum(r["n"] for r in rows.select("path", "content", "gone").mapInArrow(run, "n long").collect())
