"""Shared storage of a run, and views of Arrow text as bytes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset in a single process (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        found = _own[app]
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def made() -> int:
    """How many paths have been given out."""
    return len(_made)


def remove_made(spark: SparkSession, first: int, last: int) -> None:
    """Delete what was written at the paths given out from ``first`` to before ``last``: for a caller that has stored the results
    that were read from them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in _made[first:last]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While an action runs, send texts to Python in batches of at most ``rows``: a batch is held on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, name: str, rows: int = 1000, compression: str = "snappy") -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts its lineage. rows: of an Arrow batch meanwhile."""
    path = fresh_path(df.sparkSession, name)
    with small_batches(df.sparkSession, rows):
        df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of df's size, taken from file sizes without a scan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_for(df: DataFrame, mb: int = 32) -> int:
    """Partitions of about mb each, by the size estimate (where there is one); never fewer than the session's shuffle partitions."""
    least, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), plan_bytes(df)
    return least if size >= 1 << 60 else max(least, min(200_000, size // (mb << 20) + 1))


def trim() -> None:
    """Give freed memory back to the system: workers live on between tasks."""
    import ctypes

    _powers.clear()
    pa.default_memory_pool().release_unused()
    trim_heap = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim_heap is not None:
        trim_heap(0)


def lean(run: Callable) -> Callable:
    """A task's function on batches that gives its memory back when it is done."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return task


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary array; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if len(array) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at - at[0]


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A random 64-bit value for each byte, made from a fixed seed.
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}
#: A second polynomial, modulo a prime, for segments that may be made to collide modulo 2 ** 64 (Thue-Morse words).
_PRIME = (1 << 31) - 1
_BASE_P = 1_442_695_041
_VALUE_P = np.random.default_rng(20240301).integers(1, _PRIME, 256, dtype=np.uint64)


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, but for a multiple of it that fits 33 bits."""
    return (x & np.uint64(_PRIME)) + (x >> np.uint64(31))


def _power_p(base: int, n: int) -> np.ndarray:
    """base ** (0 .. n-1) modulo the prime."""
    have = _powers.get(-base)
    if have is None or len(have) < n:
        out = np.ones(1, np.uint64)
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), _PRIME)) % np.uint64(_PRIME)])
        have = _powers[-base] = out.astype(np.uint32)
    return have[:n]


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** (0 .. n-1) modulo 2 ** 64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        step = np.full(n, base, np.uint64)
        step[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(step)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (splitmix64's last steps)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def segment_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 17, strong: bool = False) -> np.ndarray:
    """A 64-bit hash of raw[s:e] for each of the ascending segments, from prefix sums of a polynomial modulo 2 ** 64, and, if
    strong, of one modulo a prime too. Equal hashes don't prove equal segments: callers compare what is behind them."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, low + block)))
        while j > i + 1 and ends[j - 1] > low + 2 * block:
            j -= 1
        high = int(ends[i:j].max())
        n = high - low
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[raw[low:high]] * _power(_BASE, n), out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        h = (sums[e] - sums[s]) * _power(_INVERSE, n + 1)[s]
        h += (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        if strong:
            np.cumsum(_fold(_VALUE_P[raw[low:high]] * _power_p(_BASE_P, n)), out=sums[1:])
            rest = (sums[e] - sums[s]) % np.uint64(_PRIME) * _power_p(pow(_BASE_P, -1, _PRIME), n + 1)[s] % np.uint64(_PRIME)
            h = mix(h) + rest * np.uint64(0xC2B2AE3D27D4EB4F)
        out[i:j] = mix(h)
        i = j
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start .. start+length-1 of each range, one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)
