"""Exact order statistics of many groups, without gathering or sorting values.

A number's bits, read as a signed integer, can be made to have its order. A wanted rank is found digit by digit of that integer: values are counted
by group and next digit, the running counts name the digit in which the rank lies, and the next pass looks at the values with the digits
found so far. Counting is partial in the tasks, so a pass exchanges at most a row for each digit, group and task, however many values a
group has, and a fixed number of passes ends with the very value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import fresh_folder

#: Bits of a digit; they divide 64.
BITS = 16


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Signed integers in the order of the doubles; 0.0 for -0.0, NaN above all."""
    values = np.where(np.isnan(values), np.nan, values) + 0.0
    raw = values.view(np.int64)
    return np.where(raw < 0, raw ^ np.int64(0x7FFFFFFFFFFFFFFF), raw)


def doubles(bits: np.ndarray) -> np.ndarray:
    """The doubles of ``ordered_bits``."""
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits).astype(np.int64).view(np.float64)


def _bits(rows: DataFrame) -> DataFrame:
    """rows (their last column ``_value``) with ``_bits`` in its place."""
    kept = T.StructType([*rows.schema.fields[:-1], T.StructField("_bits", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = ordered_bits(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(float))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bits)], [*batch.schema.names[:-1], "_bits"])

    return rows.mapInArrow(run, kept)


def select(rows: DataFrame, by: list[str], wanted: DataFrame) -> DataFrame:
    """by, name, bits: the value of each wanted (by, name, rank from 0) among rows (by, _bits). Groups may be null."""
    state = wanted.select(*by, "name", F.col("rank"), F.lit(0).cast("long").alias("prefix"))
    names = [f"_g{i}" for i in range(len(by))]
    path = fresh_folder(rows.sparkSession, "selection")
    for step in range(64 // BITS):
        shift = 64 - BITS * (step + 1)
        # The first digit has the sign: it counts from the least.
        digit = F.shiftright("_bits", shift) if step == 0 else F.shiftright("_bits", shift).bitwiseAND((1 << BITS) - 1)
        prefix = F.lit(0).cast("long") if step == 0 else F.shiftright("_bits", shift + BITS)
        counts = rows.groupBy(*(F.col(c).alias(n) for c, n in zip(by, names, strict=True)), prefix.alias("_prefix"), digit.alias("digit"))
        if step:  # only values that go on from the digits found so far
            near = state.select(*(F.col(c).alias(n) for c, n in zip(by, names, strict=True)), F.col("prefix").alias("_prefix")).distinct()
            within = rows.select(*(F.col(c).alias(n) for c, n in zip(by, names, strict=True)), prefix.alias("_prefix"), digit.alias("digit"))
            same = within["_prefix"] == near["_prefix"]
            for n in names:
                same = same & within[n].eqNullSafe(near[n])
            counts = within.join(near, same, "left_semi").groupBy(*names, "_prefix", "digit")
        counts = counts.agg(F.count("*").alias("n"))
        ahead = Window.partitionBy(*names, "_prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
        inside = (state["prefix"] == counts["_prefix"]) & (state["rank"] >= counts["before"]) & (state["rank"] < counts["before"] + counts["n"])
        for c, n in zip(by, names, strict=True):
            inside = inside & state[c].eqNullSafe(counts[n])
        found = state.join(counts, inside)
        value = F.shiftleft("prefix", BITS).bitwiseOR(F.col("digit")) if step else F.col("digit")
        found.select(*by, "name", (F.col("rank") - F.col("before")).alias("rank"), value.cast("long").alias("prefix")).write.parquet(f"{path}/{step}")
        state = rows.sparkSession.read.parquet(f"{path}/{step}")
    return state.select(*by, "name", F.col("prefix").alias("bits"))


def quantiles(df: DataFrame, by: list[str], value: str, *, cont: dict[str, float] | None = None, disc: dict[str, float] | None = None) -> DataFrame:
    """by, n (values that are not null) and, by name, quantiles of each group: interpolated (``cont``) or the nearest rank's value (``disc``). Groups
    without a value are left out; a group may be null."""
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_value"))
    path = fresh_folder(df.sparkSession, "selection-rows")
    _bits(rows).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"))
    place = lambda q: F.col("n") * q
    ranks = []
    for name, q in (cont or {}).items():
        at = (F.col("n") - 1) * F.lit(float(q))
        ranks += [(f"{name}/low", F.floor(at)), (f"{name}/high", F.ceil(at))]
    ranks += [(f"{name}/at", F.greatest(F.lit(1), F.col("n") - F.floor(F.col("n") - place(float(q)))) - 1) for name, q in (disc or {}).items()]
    wanted = counts.select(*by, F.explode(F.array(*(F.struct(F.lit(name).alias("name"), r.cast("long").alias("rank")) for name, r in ranks))).alias("w")).select(*by, "w.name", "w.rank")
    found = _values(select(rows, by, wanted))
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    of = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    wide = found.groupBy(*keys).agg(*(of(name).alias(f"_v{i}") for i, (name, _) in enumerate(ranks)))
    place_of = {name: f"_v{i}" for i, (name, _) in enumerate(ranks)}
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & counts[c].eqNullSafe(wide[f"_k{i}"])
    out = counts.join(wide, same)
    for name, q in (cont or {}).items():
        low, high = F.col(place_of[f"{name}/low"]), F.col(place_of[f"{name}/high"])
        at = (F.col("n") - 1) * F.lit(float(q))
        out = out.withColumn(name, low + (high - low) * (at - F.floor(at)))
    for name in disc or {}:
        out = out.withColumn(name, F.col(place_of[f"{name}/at"]))
    return out.select(*by, "n", *(cont or {}), *(disc or {}))


def _values(found: DataFrame) -> DataFrame:
    kept = T.StructType([*(f for f in found.schema.fields if f.name != "bits"), T.StructField("value", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = doubles(batch.column(batch.num_columns - 1).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values)], [*batch.schema.names[:-1], "value"])

    return found.mapInArrow(run, kept)
