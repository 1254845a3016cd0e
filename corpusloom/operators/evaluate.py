"""Retrieval evaluation: recall, precision, reciprocal rank, hits, means and deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.trust import round2

KS, HITS = (5, 10, 20), (1, 3, 5)


def is_source(path: Column, expected: Column) -> Column:
    """Whether a path is an expected source: equal, or ending in it after a slash or backslash."""
    return (path == expected) | path.endswith(F.concat(F.lit("/"), expected)) | path.endswith(F.concat(F.lit("\\"), expected))


def relevance(results: DataFrame, expected: DataFrame, path: str = "source_path") -> DataFrame:
    """results with ``matches``: the expected sources of its query that each row is. The join is by query; the suffix test is its
    condition, so rows meet the few sources of their own query only."""
    r, e = results.alias("r"), expected.alias("e")
    hit = (F.col("r.query_id") == F.col("e.query_id")) & is_source(F.col(f"r.{path}"), F.col("e.expected"))
    joined = r.join(e, hit, "left").groupBy(*(F.col(f"r.{c}") for c in results.columns))
    return joined.agg(F.sort_array(F.collect_set("e.expected")).alias("matches"))


def suffixes(path: Column) -> Column:
    """A path and what follows each of its separators, each once."""
    marks = F.filter(F.sequence(F.lit(1), F.char_length(path)), lambda i: F.substr(path, i, F.lit(1)).isin("/", "\\"))
    after = F.transform(marks, lambda i: F.substr(path, i + 1))
    return F.array_distinct(F.concat(F.array(path), F.when(F.char_length(path) > 0, after).otherwise(F.expr("cast(array() as array<string>)"))))


def found_in(paths: DataFrame, expected: DataFrame, path: str = "source_path") -> DataFrame:
    """The rows of expected (with ``expected``) with each row of paths that is their source (``is_source``). A path's suffixes are its keys, so
    this is a join by equality that is dealt by key, whatever rows are to meet; null paths and expectations meet nothing. Columns of one name
    in both are those of expected."""
    keep = [c for c in paths.columns if c == path or c not in expected.columns]
    keyed = paths.where(F.col(path).isNotNull()).select(*keep).withColumn("_key", F.explode(suffixes(F.col(path))))
    return expected.join(keyed, expected["expected"] == keyed["_key"]).drop("_key")


def per_query(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """Metrics of each query. ranked: query_id, rank, relevant, found (which expected item a row is, else null); queries:
    query_id, category, n_expected. Nothing expected: recall, reciprocal rank and hits are 1, precision 0 (1 without results)."""
    by = queries.join(ranked, "query_id", "left").groupBy("query_id", "category", "n_expected")
    rank, relevant = F.col("rank"), F.coalesce(F.col("relevant"), F.lit(False))
    none = F.col("n_expected") == 0
    cols = {}
    for k in KS:
        cols[f"found_{k}"] = F.size(F.collect_set(F.when(relevant & (rank <= k), F.col("found"))))
        cols[f"good_{k}"] = F.size(F.collect_set(F.when(relevant & (rank <= k), rank)))  # a rank is one result, whatever it matches
        cols[f"top_{k}"] = F.size(F.collect_set(F.when(rank <= k, rank)))
    out = by.agg(*(c.alias(n) for n, c in cols.items()), F.min(F.when(relevant, rank)).alias("first"))
    metrics = [F.when(none, 1.0).otherwise(F.col(f"found_{k}") / F.col("n_expected")).alias(f"recall_{k}") for k in KS]
    metrics += [F.when(none & (F.col(f"top_{k}") == 0), 1.0).when(F.col(f"top_{k}") == 0, 0.0).otherwise(F.col(f"good_{k}") / F.col(f"top_{k}")).alias(f"precision_{k}") for k in KS]
    metrics += [F.when(none, 1.0).otherwise(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr")]
    metrics += [F.when(none | (F.col("first") <= k), 1.0).otherwise(0.0).alias(f"hit_{k}") for k in HITS]
    out = out.select("query_id", "category", *metrics)
    return out.select("query_id", "category", *(F.round(c, 6).alias(c) for c in out.columns[2:]))


def summary(each: DataFrame) -> DataFrame:
    """category (null: overall), n, and the mean of each metric."""
    names = [c for c in each.columns if c not in ("query_id", "category")]
    return each.rollup("category").agg(F.count("*").alias("n"), *(round2(F.round(F.avg(c), 9)).alias(c) for c in names))


def delta(now: DataFrame, before: DataFrame, metric: str, dead: float = 0.005) -> DataFrame:
    """category, value, change (null without a former value), sign: up, down or same within the dead band."""
    old = before.select(F.col("category").alias("c"), F.col(metric).alias("old"))
    out = now.join(old, F.col("category").eqNullSafe(F.col("c")), "left")
    change = F.round(F.col(metric) - F.col("old"), 6)
    sign = F.when(change > dead, "up").when(change < -dead, "down").when(change.isNotNull(), "same").otherwise("new")
    return out.select("category", F.col(metric).alias("value"), change.alias("change"), sign.alias("sign"))


def content_match(results: DataFrame, queries: DataFrame, top: int = 5) -> DataFrame:
    """query_id, matched: all needles stand in the lower-cased texts of the first results. queries: query_id, needles."""
    texts = results.where(F.col("rank") <= top).groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "content"))), lambda r: r["content"]), "\n").alias("t"))
    out = queries.join(texts, "query_id", "left")
    return out.select("query_id", F.forall("needles", lambda n: F.contains(F.lower(F.coalesce("t", F.lit(""))), F.lower(n))).alias("matched"))


def top_match(results: DataFrame, cases: DataFrame) -> DataFrame:
    """query_id, matched: the path and the text of the first result hold the expected strings, whatever their case; null where nothing is
    expected, false without results. cases: query_id, source_contains, content_contains."""
    first = results.where(F.col("rank") == 1).select("query_id", F.lower("source_path").alias("p"), F.lower("content").alias("c"))
    path, content = (F.coalesce(F.lower(x), F.lit("")) for x in ("source_contains", "content_contains"))
    holds = F.coalesce(F.contains(F.col("p"), path) & F.contains(F.col("c"), content), F.lit(False))
    return cases.join(first, "query_id", "left").select("query_id", F.when((path != "") | (content != ""), holds).alias("matched"))


def chunk_stats(chunks: DataFrame, path: str, text: str) -> DataFrame:
    """files, chunks, mean chunks a file, and mean, median and 95th percentile (nearest rank) of the words of a chunk."""
    words = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != ""))
    rows = chunks.select(F.col(path).alias("path"), words.alias("words"))
    return rows.agg(
        F.countDistinct("path").alias("files"),
        F.count("*").alias("chunks"),
        F.round(F.count("*") / F.countDistinct("path"), 6).alias("per_file"),
        F.round(F.avg("words"), 6).alias("mean_words"),
        F.expr("percentile(words, 0.5)").alias("median_words"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY words)").cast("long").alias("p95_words"),
    )
