"""Change detection that reads only where something has changed: digests of buckets, two levels deep.

A document belongs to a leaf bucket by the hash of its path, and leaves to a folder of the stored table. Each leaf has a digest that does not
depend on order: the number of its rows, the sum of a hash of each row (path and checksum), and the exclusive or of another. A scan
is digested in one pass, with partial sums in the tasks. Folders whose digest is that of the stored table are not read; in the others,
leaves of equal digest are left out, and only the rest is joined.

Null paths are not compared (as ``storage.changes``: a null path equals none, so the scanned one is changed and the known one deleted). Repeated known rows of a path count with the
largest checksum. Equal digests do not prove equal rows: two hashes of 64 bits and the number agree by chance once in about 2 ** 128.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage

#: Folders of the stored table, and leaves in each.
FOLDERS, LEAVES = 64, 256


@dataclass(frozen=True)
class Stored:
    """known: path, checksum, leaf in folders; leaves: their digests."""

    path: str
    known: DataFrame
    leaves: DataFrame


def _placed(rows: DataFrame, path: str, checksum: str) -> DataFrame:
    """path, checksum (the largest of each path), folder, leaf."""
    one = rows.groupBy(F.col(path).alias("path")).agg(F.max(checksum).alias("checksum"))
    leaf = F.pmod(F.xxhash64("path"), F.lit(FOLDERS * LEAVES)).cast("int")
    return one.withColumn("leaf", leaf).withColumn("folder", F.floor(F.col("leaf") / LEAVES).cast("int"))


def _leaves(placed: DataFrame) -> DataFrame:
    """folder, leaf, digest."""
    row = F.xxhash64("path", "checksum").cast("decimal(20,0)")
    other = F.xxhash64("checksum", F.lit(1), "path")
    made = placed.groupBy("folder", "leaf").agg(F.count("*").alias("n"), F.sum(row).alias("total"), F.bit_xor(other).alias("either"))
    return made.select("folder", "leaf", F.struct("n", "total", "either").alias("digest"))


def write(known: DataFrame, to: str, path: str = "source_path", checksum: str = "checksum") -> Stored:
    """Store what is known (path, checksum) and its digests below ``to``."""
    spark = known.sparkSession
    placed = _placed(known.where(F.col(path).isNotNull()), path, checksum)
    placed.hint("rebalance", "folder").write.partitionBy("folder").parquet(f"{to}/known")
    _leaves(spark.read.schema("path string, checksum string, leaf int, folder int").parquet(f"{to}/known")).coalesce(1).write.parquet(f"{to}/leaves")
    return stored(known, to)


def stored(frame: DataFrame, to: str) -> Stored:
    """What ``write`` has stored; frame: any of the session."""
    spark = frame.sparkSession
    return Stored(to, spark.read.schema("path string, checksum string, leaf int, folder int").parquet(f"{to}/known"), spark.read.parquet(f"{to}/leaves"))


def differing(scanned: DataFrame, known: Stored) -> tuple[list[int], DataFrame]:
    """(folders in which a leaf differs, the leaves that differ: folder, leaf). At most FOLDERS numbers come to the driver."""
    a = _leaves(scanned).select("folder", "leaf", F.col("digest").alias("new"))
    b = known.leaves.select("folder", "leaf", F.col("digest").alias("old"))
    leaves = a.join(b, ["folder", "leaf"], "full_outer").where(~F.col("new").eqNullSafe(F.col("old"))).select("folder", "leaf")
    return sorted(r["folder"] for r in leaves.select("folder").distinct().collect()), leaves


def changes(scanned: DataFrame, known: Stored, path: str = "source_path", checksum: str = "checksum") -> DataFrame:
    """path, state: as ``storage.changes`` of scanned against what is stored, which is read only in the folders that differ."""
    placed = _placed(scanned.where(F.col(path).isNotNull()), path, checksum)
    folders, leaves = differing(placed, known)
    leaves = F.broadcast(leaves)  # FOLDERS * LEAVES rows at most
    near = placed.join(leaves, ["folder", "leaf"], "left_semi").select(F.col("path").alias(path), F.col("checksum").alias(checksum))
    old = known.known.where(F.col("folder").isin(folders)) if folders else known.known.where("false")
    old = old.join(leaves, ["folder", "leaf"], "left_semi").select(F.col("path").alias(path), F.col("checksum").alias(checksum))
    same = placed.join(leaves, ["folder", "leaf"], "left_anti").select(F.col("path").alias(path), F.lit("unchanged").alias("state"))
    nowhere = scanned.where(F.col(path).isNull()).select(path, F.lit("changed").alias("state"))
    return storage.changes(near, old, path, checksum).unionByName(same).unionByName(nowhere)
