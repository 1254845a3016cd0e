"""The store's operations as plans over tables: change detection, upserts, deletes, the source registry, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import decimals


def changes(scanned: DataFrame, known: DataFrame, path: str = "source_path", checksum: str = "checksum") -> DataFrame:
    """path, state: changed (new or of another checksum), unchanged, or deleted (known, no longer there)."""
    seen = scanned.select(path, F.struct(F.col(checksum).alias("c")).alias("new"))
    old = known.groupBy(path).agg(F.max(F.struct(F.col(checksum).alias("c"))).alias("old"))
    both = seen.join(old, path, "full_outer")
    state = F.when(F.col("new").isNull(), "deleted").when(F.col("new").eqNullSafe(F.col("old")), "unchanged").otherwise("changed")
    return both.select(path, state.alias("state"))


def upsert(table: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """rows replace those of table with the same key. Of rows with one key, that of the largest content stays."""
    rest = [c for c in rows.columns if c != key]
    new = rows.groupBy(key).agg(F.max(F.struct(*rest)).alias("r")).select(key, "r.*").select(*rows.columns)
    return table.join(new.select(key), key, "left_anti").select(*rows.columns).unionByName(new)


def replace_paths(table: DataFrame, rows: DataFrame, path: str = "source_path") -> DataFrame:
    """All rows of a changed path go for its new ones, so that no chunk of a longer older version stays."""
    return table.join(rows.select(path).distinct(), path, "left_anti").select(*rows.columns).unionByName(rows)


def delete_paths(table: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Rows but those of a deleted (source_type, source_name, source_path); an empty name stands for all names."""
    t = tombstones.select(F.col("source_type").alias("t_type"), F.nullif(F.col("source_name"), F.lit("")).alias("t_name"), F.col("source_path").alias("t_path")).distinct()
    hit = (table["source_type"] == t["t_type"]) & (table["source_path"] == t["t_path"]) & (t["t_name"].isNull() | (table["source_name"] == t["t_name"]))
    return table.join(t, hit, "left_anti")


def delete_source(table: DataFrame, source_type: str, name: str) -> DataFrame:
    return table.where(~((F.col("source_type") == source_type) & (F.col("source_name") == name)))


def register(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert sources by (source_type, source_name); an empty new description leaves the old one."""
    a, b = registry.alias("a"), new.alias("b")
    both = a.join(b, ["source_type", "source_name"], "full_outer")
    take = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c)
    description = F.coalesce(F.nullif(F.col("b.description"), F.lit("")), F.col("a.description"), F.lit(""))
    return both.select("source_type", "source_name", description.alias("description"), take("config"))


def merge_sources(stored: DataFrame, file: DataFrame) -> DataFrame:
    """The union by (source_type, source_name); what is stored wins over the file."""
    ranked = stored.withColumn("from_file", F.lit(0)).unionByName(file.withColumn("from_file", F.lit(1)))
    by = Window.partitionBy("source_type", "source_name").orderBy("from_file")
    return ranked.withColumn("k", F.row_number().over(by)).where("k = 1").drop("k", "from_file")


def latest(table: DataFrame, key: list[str], value: str, order: list[str | Column]) -> DataFrame:
    """The value of each key's last row by ``order``."""
    return table.groupBy(*key).agg(F.max_by(F.col(value), F.struct(*order)).alias(value))


def tsv_line(vector: Column) -> Column:
    """A vector as tab-separated decimals of six digits."""
    return F.array_join(F.transform(vector, lambda x: decimals(x.cast("double"), 6)), "\t")


def tsv_text(text: Column) -> Column:
    return F.translate(text, "\t\n\r", "   ")
