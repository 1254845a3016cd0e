"""The corpus pipeline: language ID, near duplicates, repeated passages, benchmark decontamination, packing.

Each stage takes all documents that the stage before kept (written as Parquet and read again) and returns those it keeps,
with the columns of ``documents``; the last returns the packed pieces. No stage can be said in SQL as a whole (the first and
last need a trained model and a tokenizer), so ORACLE_SQL is None and the tests hold run() against brute force.

Nulls: a document with null text has no language and goes in the first stage; null doc_id, lang, source and n_chars are
carried along. Repeated rows are near duplicates: one stays; rows of one id with unlike texts are documents of their own. Texts are
never cut for a decision, whatever their length. Columns beyond those of ``documents`` are left out by the stages. Empty tables give no rows.

The stages lower ``spark.sql.execution.arrow.maxRecordsPerBatch`` while they run; ``run`` sets it back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontam, jaccard, langid, packing, shared, suffix
from corpusloom.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text of which no language's value stands out has a smaller score.
LEAST_SCORE = 0.3

#: Near duplicates: words of a shingle, and the least Jaccard similarity of a link in per cent.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Rows of an Arrow batch: texts are long, and a batch is held by the executor and by its Python worker.
BATCH_ROWS = 1000

_tables = {"from": None}


def _begin(spark: SparkSession) -> None:
    """Remove the tables of the stage before: its result has been written since."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    now = shared.made()
    if _tables["from"] is not None:
        shared.remove_made(spark, _tables["from"], now)
    _tables["from"] = now


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: not ``und``, with a score of LEAST_SCORE or more. Learns from the labelled ones."""
    _begin(spark)
    out = langid.annotate(docs.select(*COLUMNS), langid.fit(docs))
    return out.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five-word shingles, Jaccard 0.8) one row: that of the smallest doc_id (null ids last), of
    rows with that id the one of the least hash of its text, and of rows equal in both the least. Documents without words stay."""
    _begin(spark)
    docs = docs.select(*COLUMNS)
    found = jaccard.members(docs, words=NEAR_WORDS, percent=NEAR_PERCENT).where("root is not null").select("root", "doc_id", "hash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash")).alias("first")
    stays = (F.col("doc_id").eqNullSafe(F.col("first.doc_id"))) & (F.col("hash") == F.col("first.hash"))
    marked = found.join(found.groupBy("root").agg(first), "root").select(F.col("doc_id").alias("id"), F.col("hash").alias("h"), stays.alias("stays"))
    marked = shared.materialise(marked.groupBy("id", "h").agg(F.min("stays").alias("stays"), F.count("*").alias("n")), "near")
    keyed = docs.withColumn("hash", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("h"))
    kept = keyed.join(marked.where("not stays or n > 1").select("id", "h"), same, "left_anti").select(*COLUMNS)
    twice = marked.where("stays and n > 1").select("id", "h")
    if not twice.isEmpty():  # repeated rows of one id and text
        one = keyed.join(twice, same, "left_semi").groupBy("doc_id", "hash").agg(F.min(F.struct(*COLUMNS)).alias("row"))
        kept = kept.unionByName(one.select("row.*"))
    return kept


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 100 bytes that start earlier; those of which nothing is left go."""
    _begin(spark)
    out = suffix.annotate(docs.select(*COLUMNS))
    out = out.where((F.size("spans") == 0) | (F.char_length("kept_text") > 0))
    rest = [F.col(f"row.{c}").alias(c) for c in ("doc_id", "lang", "source")]
    length = F.when(F.size("spans") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))
    return out.select(*rest, F.col("kept_text").alias("text"), length.alias("n_chars")).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item stands."""
    _begin(spark)
    out = decontam.annotate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.where(F.size("found.spans") == 0).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed."""
    _begin(spark)
    return packing.pack(docs, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_languages),
    ("ngram_jaccard", keep_one_of_each),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_leaks),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    _tables["from"] = None
    path = shared.fresh_path(spark, "pipeline")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for k, (name, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{path}/{k}-{name}")
            docs = spark.read.parquet(f"{path}/{k}-{name}")
    finally:
        spark.conf.set(key, before)
    return docs
