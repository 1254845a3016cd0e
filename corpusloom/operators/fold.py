"""An ordered fold over rows of any number to a key: long documents in parts of bounded size.

Rows are dealt by ranges of (key, order) and sorted, so that a key with very many rows lies in many tasks. Each task sums sizes along
its rows, key by key; a key that goes on over a range's edge goes on with what stood before, of which there is one number to each range. So each row
knows how much stands before it in its key, which says in which part it belongs, and only a part's rows are gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import fresh_folder


def running(rows: DataFrame, key: str, order: list[str], size: str, *, parts: int | None = None) -> DataFrame:
    """rows with ``before``: the sum of size over the rows of its key that come before it in ``order`` (then by all columns, nulls first). size is
    a whole number that is not null. Equal rows follow each other."""
    spark = rows.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [key, *order, *(c for c in rows.columns if c not in (key, *order))]
    place = rows.columns.index(key), rows.columns.index(size)
    schema = T.StructType([*rows.schema.fields, T.StructField("before", T.LongType()), T.StructField("_range", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here, last, total = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, sizes = batch.column(place[0]), batch.column(place[1]).to_numpy().astype(np.int64)
            codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
            first = np.flatnonzero(np.diff(codes, prepend=-1))
            sums = np.cumsum(sizes) - sizes
            before = sums - np.repeat(sums[first], np.diff(np.append(first, len(sizes))))
            if last is not None and keys[0].as_py() == last[0]:
                before[: first[1] if len(first) > 1 else len(sizes)] += total
            last, total = (keys[-1].as_py(),), int(before[-1] + sizes[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before), pa.array(np.full(len(sizes), here, np.int32))], [*batch.schema.names, "before", "_range"])

    path = fresh_folder(spark, "running")
    rows.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(run, schema).write.parquet(path)
    table = spark.read.schema(schema).parquet(path)
    # Only the first key of a range has rows in the ranges before it, so this is a row a range at most.
    ahead = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = table.groupBy(key, "_range").agg(F.sum(size).alias("sum")).withColumn("carry", F.sum("sum").over(ahead)).where("carry is not null")
    sums = sums.select(F.col(key).alias("_key"), F.col("_range").alias("_at"), "carry")
    out = table.join(F.broadcast(sums), table[key].eqNullSafe(sums["_key"]) & (table["_range"] == sums["_at"]), "left")
    return out.select(*rows.columns, (F.col("before") + F.coalesce("carry", F.lit(0))).alias("before"))


def documents(rows: DataFrame, key: str, order: list[str], line: Column, size: int, *, parts: int | None = None) -> DataFrame:
    """key, part (from 0), content, n: the lines of each key in order (then by the line), one after the other, in parts. A line belongs to the part
    in which its first byte falls, counting ``size`` bytes to each, so a part is shorter than that and its last line together."""
    cut = rows.select(key, *order, F.coalesce(line, F.lit("")).alias("_line")).withColumn("_size", F.octet_length("_line").cast("long"))
    placed = running(cut, key, order, "_size", parts=parts).withColumn("part", F.floor(F.col("before") / size).cast("long"))
    each = F.struct(*order, F.col("_line").alias("line"))
    out = placed.groupBy(key, "part").agg(F.sort_array(F.collect_list(each)).alias("m"), F.count("*").alias("n"))
    return out.select(key, "part", F.array_join(F.transform("m", lambda x: x["line"]), "").alias("content"), "n")
