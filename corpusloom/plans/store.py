"""A corpus store: Parquet tables that change by small writes.

A table is a list of folders, each written once by Spark: a base, and changes after it. A change holds rows, and keys that are gone; it
replaces all that earlier folders have of the keys it names. ``read`` merges: a row stays if no later change names its key. A small change
writes in proportion to itself, and is a table of its own until ``compact`` writes base and changes as one.

The state of a table is the list with the highest number in ``_current``. A writer puts its folder in place first and then makes the list of the
next number, by the file system's exclusive create; a writer that finds that number taken starts again from the new state.
Changes need only the list anew; what was computed from the table's rows (``update``, ``compact``) is computed again. So no writer's rows are lost,
readers see whole states only, and a folder whose writer died is in no list. Exclusive create is atomic on HDFS and local disks.

Nulls in keys are keys as any other. Of a change's keys that also are among those gone, the rows win. Columns that a change has and
the table lacks are null in older rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GONE, FOLDER = "_gone", "_folder"
#: Changes after which ``change`` compacts by itself.
MOST_CHANGES = 64


@dataclass(frozen=True)
class State:
    """folders: the base first, if there is one, and then the changes in order."""

    number: int = -1
    folders: tuple[str, ...] = ()
    has_base: bool = False
    key: tuple[str, ...] = ()
    by: str | None = None
    schema: dict = field(default_factory=dict)

    @property
    def changes(self) -> tuple[str, ...]:
        return self.folders[1:] if self.has_base else self.folders


class Conflict(RuntimeError):
    """Another writer was first, again and again."""


class Store:
    """Tables under a root that Spark can write."""

    TRIES = 20

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _numbers(self, name: str) -> list[int]:
        fs, p = self._fs(f"{self.root}/{name}/_current")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p)) if fs.exists(p) else []

    def _text(self, name: str, number: int) -> str:
        fs, p = self._fs(f"{self.root}/{name}/_current/{number:010d}")
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def state(self, name: str, number: int | None = None) -> State:
        """The newest state, or that of a number; one without folders where there is no table."""
        for n in reversed(self._numbers(name)):
            if number is not None and n != number:
                continue
            text = self._text(name, n)
            if text.endswith("\n"):  # else its writer is writing it, or died then
                had = json.loads(text)
                return State(n, tuple(had["folders"]), had["has_base"], tuple(had["key"]), had["by"], had["schema"])
        return State()

    def _commit(self, name: str, state: State) -> bool:
        """Make the state current; whether its number was free."""
        fs, p = self._fs(f"{self.root}/{name}/_current/{state.number:010d}")
        try:
            out = fs.create(p, False)
        except Py4JJavaError as e:
            if "exist" in str(e.java_exception.getMessage()):
                return False
            raise
        out.write(bytearray(json.dumps(asdict(state)).encode() + b"\n"))
        out.close()
        return True

    def _next(self, name: str, state: State) -> int:
        return max([state.number, *self._numbers(name)[-1:]]) + 1

    def _put(self, name: str, df: DataFrame, by: str | None) -> str:
        folder = f"{FOLDER}={uuid.uuid4().hex}"
        (df.write.partitionBy(by) if by else df.write).parquet(f"{self.root}/{name}/{folder}")
        return folder

    def exists(self, name: str) -> bool:
        return bool(self.state(name).folders)

    def _rows(self, name: str, state: State, folders: Sequence[str]) -> DataFrame:
        """The rows of folders as they are, with GONE and FOLDER."""
        schema = T.StructType([*T.StructType.fromJson(state.schema).fields, T.StructField(GONE, T.BooleanType()), T.StructField(FOLDER, T.StringType())])
        if not folders:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.root}/{name}/{f}" for f in folders]
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*paths)

    def _merged(self, name: str, state: State) -> DataFrame:
        columns = T.StructType.fromJson(state.schema).fieldNames()
        if not state.changes:
            return self._rows(name, state, state.folders).select(*columns)
        order = F.create_map(*(x for k, f in enumerate(state.changes) for x in (F.lit(f.partition("=")[2]), F.lit(k))))
        rows = self._rows(name, state, state.changes).withColumn("_place", order[F.col(FOLDER)])
        last = rows.groupBy(*state.key).agg(F.max("_place").alias("_last"))
        last = last.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(state.key)), "_last")
        same = lambda of: _all(of[c].eqNullSafe(last[f"_k{i}"]) for i, c in enumerate(state.key))
        live = rows.join(last, same(rows) & (rows["_place"] == last["_last"]), "left_semi").where(~F.coalesce(F.col(GONE), F.lit(False)))
        if not state.has_base:
            return live.select(*columns)
        base = self._rows(name, state, state.folders[:1])
        return base.join(last, same(base), "left_anti").select(*columns).unionByName(live.select(*columns))

    def read(self, name: str, number: int | None = None) -> DataFrame:
        """The table as it is, or as it was at a number that is still kept."""
        state = self.state(name, number)
        if not state.folders:
            raise KeyError(name)
        return self._merged(name, state)

    def write(self, name: str, df: DataFrame, by: str | None = None, key: Sequence[str] = ()) -> int:
        """The whole table anew, in folders ``by`` a column; ``key`` is what later changes replace rows by. Replaces what others wrote meanwhile."""
        folder = self._put(name, df, by)
        for _ in range(self.TRIES):
            old = self.state(name)
            new = State(self._next(name, old), (folder,), True, tuple(key) or old.key, by, df.schema.jsonValue())
            if self._commit(name, new):
                return new.number
        raise Conflict(name)

    def update(self, name: str, change: Callable[[DataFrame], DataFrame]) -> int:
        """Rewrite the whole table from its rows; from its new rows, if another writer was first."""
        for _ in range(self.TRIES):
            old = self.state(name)
            if not old.folders:
                raise KeyError(name)
            df = change(self._merged(name, old))
            new = State(old.number + 1, (self._put(name, df, old.by),), True, old.key, old.by, df.schema.jsonValue())
            if self._commit(name, new):
                return new.number
        raise Conflict(name)

    def change(self, name: str, rows: DataFrame, key: Sequence[str], gone: DataFrame | None = None, by: str | None = None) -> int:
        """Let rows replace all that the table has of their keys, and forget the keys of ``gone``. Makes the table where there is none."""
        key = tuple(key)
        old = self.state(name)
        if old.folders and old.key and set(old.key) != set(key):
            raise ValueError(f"{name} changes by {', '.join(old.key)}")
        by = old.by if old.folders else by
        out = rows.withColumn(GONE, F.lit(False))
        if gone is not None:
            keys = gone.select(*key).distinct()
            named = rows.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(key))).distinct()
            keys = keys.join(named, _all(keys[c].eqNullSafe(named[f"_k{i}"]) for i, c in enumerate(key)), "left_anti")
            rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in key]
            out = out.unionByName(keys.select(*key, *rest, F.lit(True).alias(GONE)))
        folder = self._put(name, out, by)
        for _ in range(self.TRIES):
            old = self.state(name)
            if old.folders and old.key and set(old.key) != set(key):
                raise ValueError(f"{name} changes by {', '.join(old.key)}")
            had = T.StructType.fromJson(old.schema).fields if old.schema else []
            schema = T.StructType([*had, *(T.StructField(f.name, f.dataType) for f in rows.schema if f.name not in {h.name for h in had})])
            new = State(self._next(name, old), (*old.folders, folder), old.has_base, key, by, schema.jsonValue())
            if self._commit(name, new):
                if len(new.changes) > MOST_CHANGES:
                    self.compact(name)
                return new.number
        raise Conflict(name)

    def compact(self, name: str) -> int:
        """Write base and changes as one base. Changes that come meanwhile stay changes."""
        for _ in range(self.TRIES):
            old = self.state(name)
            if not old.changes:
                return old.number
            folder = self._put(name, self._merged(name, old), old.by)
            for _ in range(self.TRIES):
                now = self.state(name)
                if now.folders[: len(old.folders)] != old.folders:
                    break  # rewritten meanwhile
                new = State(self._next(name, now), (folder, *now.folders[len(old.folders) :]), True, now.key, now.by, now.schema)
                if self._commit(name, new):
                    return new.number
        raise Conflict(name)

    def forget(self, name: str, keep: int = 2) -> int:
        """Delete all states but the last ``keep``, and the folders that only they list; how many folders went."""
        numbers = self._numbers(name)
        kept = {f for n in numbers[-keep:] for f in self.state(name, n).folders}
        lost = {f for n in numbers[:-keep] for f in self.state(name, n).folders} - kept
        for path in [*(f"_current/{n:010d}" for n in numbers[:-keep]), *lost]:
            fs, p = self._fs(f"{self.root}/{name}/{path}")
            fs.delete(p, True)
        return len(lost)

    def backup(self, name: str, to: str) -> None:
        self.read(name).write.parquet(to)

    def restore(self, name: str, path: str) -> int:
        old = self.state(name)
        return self.write(name, self.spark.read.parquet(path), old.by, old.key)


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
