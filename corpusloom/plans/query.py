"""Retrieval queries, batch-wise: hybrid, raw with trust, local and answered."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import models, trust
from ..functions import text as text_functions
from ..operators import fusion, search, vector
from ..session import written


#: Phrasings of a question at most: the question and its expansions. A list's id is LISTS * query_id + n.
LISTS = 8
TOPIC_WEIGHT = 0.3
EMPTY = "I don't have any relevant information to answer this question."  # a fixed value of the answers' format


def hybrid(fragments: DataFrame, queries: DataFrame, limit: int = 20, *, vectors: DataFrame | None = None, keep: Column | None = None,
           expansions: DataFrame | None = None, topics: DataFrame | None = None, postings: search.Stored | None = None) -> DataFrame:
    """query_id, doc_id, score, rank: a list by BM25 and one by nearest vectors for each question and each of its expansions, all fused.

    queries: query_id, query and, with vectors, embedding. expansions: query_id, n (from 1), query, embedding. topics: query_id,
    embedding, which pulls all embeddings of the question its way. ``keep``, a condition on fragments, holds on either side:
    BM25 filters before its limit, the vector side after an over-fetch. postings: the stored index of the fragments."""
    columns = ["query_id", "n", "query", *(["embedding"] if vectors is not None else [])]
    asked = queries.withColumn("n", F.lit(0)).select(*columns)
    if expansions is not None:
        asked = asked.unionByName(expansions.where(F.col("n").between(1, LISTS - 1)).select(*columns))
    asked = asked.withColumn("list_id", F.col("query_id") * LISTS + F.col("n"))
    of_query = F.floor(F.col("list_id") / LISTS).cast("long").alias("query_id")
    if postings is not None:
        kept = None if keep is None else fragments.where(keep).select("doc_id")
        words = postings.search(asked, limit, query_id="list_id", keep=kept)
    else:
        words = search.bm25(fragments, asked, limit, text="raw_content", query_id="list_id", keep=keep)
    lists = words.withColumnRenamed("query_id", "list_id").select(of_query, "doc_id", "rank")
    if vectors is not None:
        if topics is not None:
            topic = topics.select("query_id", F.col("embedding").alias("topic"))
            blended = F.when(F.col("topic").isNull(), F.transform("embedding", lambda x: x.cast("double"))).otherwise(vector.blend(F.col("embedding"), F.col("topic"), TOPIC_WEIGHT))
            asked = asked.join(topic, "query_id", "left").withColumn("embedding", blended)
        if keep is None:
            near = vector.knn(vectors, asked, limit, query_id="list_id")
        else:
            near = vector.knn_filtered(vectors, asked, limit, fragments.where(keep).select(F.col("doc_id").alias("vec_id")), query_id="list_id")
        near = near.withColumnRenamed("query_id", "list_id")
        lists = lists.unionByName(near.select(of_query, F.col("vec_id").alias("doc_id"), "rank"))
    return fusion.fuse(lists, limit)


def scouted(fragments: DataFrame, lists: DataFrame, most: int = 5) -> DataFrame:
    """query_id, rank, hint: the vocabulary shown to a model that rephrases a question: of its nearest and its best fragments (lists:
    query_id, doc_id, list_id, rank) the first ``most`` different ones, each as its path and the first 500 bytes of its text."""
    text = F.concat(F.lit("["), "source_path", F.lit("] "), text_functions.first_bytes(F.col("raw_content"), 500))
    first = written(fusion.distinct_in_order(lists, most), "scouted")
    return first.join(fragments.select("doc_id", text.alias("hint")), "doc_id").select("query_id", "rank", "hint")


def expanded(queries: DataFrame, hints: DataFrame, model: Callable[[str], str], embedder: models.Embedder) -> DataFrame:
    """expansions (query_id, n, query, embedding) of questions by a model, which is shown their hints. A failing model gives none."""
    shown = hints.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "hint"))), lambda x: x["hint"]), "\n").alias("hints"))
    ask = F.concat(F.lit("Rephrase the search query in three to five ways, one to a line, in other words.\n"), F.when(F.col("hints").isNotNull(), F.concat(F.lit("Excerpts:\n"), "hints", F.lit("\n"))).otherwise(""), F.lit("Query: "), "query")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = []
            for p in batch.column(1).to_pylist():
                try:
                    said.append(model(p))
                except Exception:  # a question without expansions is still asked
                    said.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string())], ["query_id", "reply"])

    replies = queries.join(shown, "query_id", "left").select("query_id", ask.alias("p")).mapInArrow(run, "query_id long, reply string")
    out = replies.select("query_id", F.posexplode(text_functions.expansions(F.col("reply"))).alias("n", "query")).withColumn("n", F.col("n") + 1)
    return out.withColumn("embedding", models.embed(F.col("query"), embedder))


def trusted(ranked: DataFrame, fragments: DataFrame, as_of: str = trust.AS_OF, more: list[str] = ()) -> DataFrame:
    """ranked with the fragment's columns, those of ``more`` too, and its trust; corroboration is shared by the results of a query.
    A ranked table that was written is known to be small, and is sent to the fragments, whose texts are not exchanged then."""
    keep = ["doc_id", "id", "source_name", "source_path", "file_type", "content_date", "confidence_adj", "raw_content", *more]
    taken = F.col("ingested_at") if "ingested_at" in fragments.columns else F.lit(None).cast("timestamp")
    rows = ranked.join(fragments.select(*keep, taken.alias("ingested_at")), "doc_id")
    rows = rows.withColumn("n_sources", F.size(F.collect_set("source_name").over(Window.partitionBy("query_id"))))
    fresh = trust.freshness(F.col("content_date"), F.col("ingested_at"), F.col("file_type"), as_of)
    rows = rows.withColumn("freshness", fresh).drop("ingested_at").withColumn("corroboration", trust.corroboration(F.col("n_sources")))
    rows = rows.withColumn("consistency", trust.consistency(F.col("confidence_adj"))).withColumn("authority", trust.authority(F.col("file_type")))
    return rows.withColumn("overall", trust.overall(*map(F.col, ("freshness", "corroboration", "consistency", "authority"))))


def answer_confidence(rows: DataFrame) -> DataFrame:
    """query_id with the mean signals of its results and the overall trust of these."""
    mean = lambda c: trust.round2(F.round(F.avg(c), 9)).alias(c)
    out = rows.groupBy("query_id").agg(mean("freshness"), trust.corroboration(F.countDistinct("source_name")).alias("corroboration"), mean("consistency"), mean("authority"))
    return out.withColumn("overall", trust.overall(*map(F.col, ("freshness", "corroboration", "consistency", "authority"))))


def local(rows: DataFrame, most: int = 5) -> DataFrame:
    """Confidence without a model: of the first ``most`` results the largest freshness and authority and the mean consistency."""
    top = rows.where(F.col("rank") <= most)
    out = top.groupBy("query_id").agg(
        F.max("freshness").alias("freshness"), trust.corroboration(F.countDistinct("source_name")).alias("corroboration"),
        trust.round2(F.round(F.avg("consistency"), 9)).alias("consistency"), F.max("authority").alias("authority"),
    )
    return out.withColumn("overall", trust.overall(*map(F.col, ("freshness", "corroboration", "consistency", "authority"))))


def prompt(rows: DataFrame, concise: bool = False, as_of: str = trust.AS_OF) -> DataFrame:
    """query_id, prompt: the results by source (larger groups first, then the better ranked), each with id, path, age and text."""
    days = F.floor((F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds("content_date")) / 86400)
    line = F.concat(F.lit("["), "id", F.lit("] "), "source_path", F.lit(" ("), text_functions.age(days), F.lit(")\n"), "raw_content", F.lit("\n"))
    groups = rows.groupBy("query_id", "source_name").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    block = F.concat(F.lit("## "), "source_name", F.lit("\n"), F.array_join(F.transform("l", lambda x: x["line"]), ""))
    groups = groups.select("query_id", F.struct((-F.size("l")).alias("n"), F.col("l")[0]["rank"].alias("first"), block.alias("block")).alias("g"))
    out = groups.groupBy("query_id").agg(F.sort_array(F.collect_list("g")).alias("g"))
    ask = "Answer briefly from the fragments below." if concise else "Answer from the fragments below and cite their ids in brackets."
    return out.select("query_id", F.concat(F.lit(f"{ask}\n\n"), F.array_join(F.transform("g", lambda x: x["block"]), "\n")).alias("prompt"))


def cited(answers: DataFrame, rows: DataFrame) -> DataFrame:
    """query_id, id, pos of the retrieved fragments that an answer cites, in order of first citation; all of them where it
    cites none. answers: query_id, answer."""
    said = answers.select("query_id", F.posexplode(text_functions.citations(text_functions.strip_meta(F.col("answer")))).alias("pos", "id"))
    used = said.join(rows.select("query_id", "id", "rank"), ["query_id", "id"]).select("query_id", "id", "pos")
    none = answers.join(used.select("query_id").distinct(), "query_id", "left_anti").select("query_id")
    rest = rows.join(none, "query_id", "left_semi").select("query_id", "id", (F.col("rank") - 1).cast("int").alias("pos"))
    return used.unionByName(rest)


def local_prompt(rows: DataFrame, as_of: str = trust.AS_OF, most: int = 5) -> DataFrame:
    """query_id, prompt for a small model: the first ``most`` results, numbered, each with path, source, type, date, age, author and text."""
    days = F.floor((F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds("content_date")) / 86400)
    source = F.when(F.coalesce("source_name", F.lit("")) != "", F.concat(F.lit(" ("), "source_name", F.lit(")"))).otherwise("")
    dated = F.concat(F.date_format("content_date", "yyyy-MM-dd"), F.lit(" ("), text_functions.age(days), F.lit(" ago)"))
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "source_path", source, F.lit("\nType: "), "file_type", F.lit(" | Date: "), F.coalesce(dated, F.lit("unknown")), F.lit("\n\n"), "raw_content", F.lit("\n\n---\n\n"))
    got = rows.where(F.col("rank") <= most).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    ask = "Answer the question from the numbered sources below, in plain text. Cite them as [1], [2]. Name both claims where sources differ, and say so where they tell too little.\n\n## Sources\n\n"
    return got.select("query_id", F.concat(F.lit(ask), F.array_join(F.transform("l", lambda x: x["line"]), "")).alias("prompt"))


def answered(rows: DataFrame, model: Callable[[str], str], concise: bool = False, local: bool = False) -> DataFrame:
    """query_id, answer: each query's prompt given to a model, by the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [model(p) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string())], ["query_id", "answer"])

    asked = (local_prompt(rows) if local else prompt(rows, concise)).select("query_id", "prompt")
    return asked.mapInArrow(run, "query_id long, answer string")


def assembled(queries: DataFrame, rows: DataFrame, answers: DataFrame) -> DataFrame:
    """query_id, content, sources (id, path, name, in order of citation), contradictions (a place for them, empty as in the reference),
    freshness, corroboration, consistency, authority, overall: a
    model's answer with its trust. Both are of the fragments it cites, of all that were found where it cites none of them. A
    question for which nothing was found has the EMPTY answer, no sources and no trust."""
    used = cited(answers, rows)
    of = rows.join(used, ["query_id", "id"])
    refs = F.struct("pos", F.struct("id", "source_path", "source_name").alias("ref"))
    sources = of.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(refs)), lambda x: x["ref"]).alias("sources"))
    said = answers.select("query_id", text_functions.strip_meta(F.col("answer")).alias("content"))
    out = queries.select("query_id").join(said, "query_id", "left").join(sources, "query_id", "left").join(answer_confidence(of), "query_id", "left")
    signals = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("freshness", "corroboration", "consistency", "authority", "overall")]
    none = F.col("sources").isNull()
    return out.select("query_id", F.when(none, EMPTY).otherwise(F.col("content")).alias("content"), F.coalesce("sources", F.expr("array()").cast(sources.schema["sources"].dataType)).alias("sources"), F.expr("cast(array() as array<struct<claim: string, fragment_ids: array<string>>>)").alias("contradictions"), *signals)


def signature(rows: DataFrame) -> DataFrame:
    """query_id, sig: a hash of the results' ids and checksums in order, by which a stored answer is validated."""
    pairs = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "checksum"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.concat(x["id"], F.lit(":"), x["checksum"], F.lit("\n"))), "")
    return pairs.select("query_id", F.substring(F.sha2(text, 256), 1, 32).alias("sig"))
