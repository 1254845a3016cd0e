"""A question from its text to an answer: caches in two tiers, retrieval, a model, and trust."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import models, trust
from ..functions import text as text_functions
from . import cache as caches
from . import query as plans
from .store import Store

TABLE = "answers"


class Cache:
    """Answers in memory, and behind it in a stored table. Times are seconds since 1970, given by the caller."""

    def __init__(self, store: Store | None = None, **options):
        self.memory, self.fast, self.store, self.puts = caches.MemoryCache(**options), caches.MemoryCache(ttl=caches.FAST_TTL), store, 0

    def quick(self, key: str, now: float) -> str | None:
        """An answer of the last minutes, whatever its fragments are by now."""
        return self.fast.get(key, now)

    def get(self, key: str, sig: str, now: float) -> str | None:
        """An answer made of the same fragments. One found in the table is kept in memory from then on, with its age."""
        found = self.memory.get(key, now, sig)
        if found is None and self.store is not None and self.store.exists(TABLE):
            rows = self.store.read(TABLE).where((F.col("cache_key") == key) & (F.col("fragment_sigs") == sig) & (F.unix_seconds("created_at") >= now - self.memory.ttl))
            row = rows.orderBy(F.col("created_at").desc(), "answer_json").select("answer_json", F.unix_seconds("created_at").alias("at")).first()
            if row is not None:
                found = row["answer_json"]
                self.memory.put(key, sig, found, row["at"])
        if found is not None:
            self.fast.put(key, sig, found, now)
        return found

    def put(self, key: str, query: str, concise: bool, sig: str, answer: str, now: float) -> None:
        """Keep an answer in all tiers; every tenth time the table is rid of what is older than an hour."""
        self.memory.put(key, sig, answer, now)
        self.fast.put(key, sig, answer, now)
        if self.store is None:
            return
        self.puts += 1
        new = self.store.spark.createDataFrame([(key, query, concise, sig, answer, int(now))], "cache_key string, query_text string, concise boolean, fragment_sigs string, answer_json string, at long")
        new = new.withColumn("created_at", F.timestamp_seconds("at")).drop("at")
        old = None
        if self.puts % 10 == 0 and self.store.exists(TABLE):
            old = self.store.read(TABLE).where(F.unix_seconds("created_at") < now - caches.PRUNE).select("cache_key")
        self.store.change(TABLE, new, ["cache_key"], old)


class Engine:
    """Questions one at a time, over fragments (doc_id, id, checksum and the columns of ``plans.trusted``, with embedding)."""

    def __init__(self, fragments: DataFrame, embedder: models.Embedder, model: Callable[[str], str] | None = None, *, limit: int = 20, cache: Cache | None = None, as_of: str = trust.AS_OF, units: DataFrame | None = None):
        self.fragments, self.embedder, self.model, self.limit = fragments, embedder, model, limit
        self.cache, self.as_of, self.units = cache or Cache(), as_of, units

    @property
    def spark(self) -> SparkSession:
        return self.fragments.sparkSession

    def _asked(self, messages: list[dict]) -> str:
        """Only the last message is asked, and a user must have said it."""
        if not messages:
            raise ValueError("no messages")
        if messages[-1]["role"] != "user":
            raise ValueError("the last message is not a user's")
        return messages[-1]["content"]

    def retrieved(self, question: str, *, sources: list[str] = (), types: list[str] = (), topics: list[str] = (), expand: bool = False, limit: int | None = None) -> DataFrame:
        """The question's results with their trust."""
        spark, vectors = self.spark, self.fragments.select(F.col("doc_id").alias("vec_id"), "embedding")
        queries = spark.createDataFrame([(0, question, self.embedder.embed([question])[0])], "query_id long, query string, embedding array<float>")
        keep = plans.search.source_filter([*sources], [*types]) if sources or types else None
        expansions = None
        if expand and self.model is not None:
            rows = self.fragments if keep is None else self.fragments.where(keep)
            ids = rows.select(F.col("doc_id").alias("vec_id"))
            near = plans.vector.knn(vectors, queries, 5) if keep is None else plans.vector.knn_filtered(vectors, queries, 5, ids)
            lists = near.select("query_id", F.col("vec_id").alias("doc_id"), F.lit(0).alias("list_id"), "rank")
            words = plans.search.bm25(self.fragments, queries, 5, text="raw_content", keep=keep)
            lists = lists.unionByName(words.select("query_id", "doc_id", F.lit(1).alias("list_id"), "rank"))
            expansions = plans.expanded(queries, plans.scouted(self.fragments, lists), self.model, self.embedder).persist()
        topic = None
        if topics:
            topic = spark.createDataFrame([(0, self.embedder.embed([" ".join(topics)])[0])], "query_id long, embedding array<float>")
        ranked = plans.hybrid(self.fragments, queries, limit or self.limit, vectors=vectors, keep=keep, expansions=expansions, topics=topic)
        return plans.trusted(ranked, self.fragments, self.as_of)

    def raw(self, messages: list[dict], **options) -> dict:
        """Fragments with trust, and the knowledge units nearest to the question."""
        question = self._asked(messages)
        rows = self.retrieved(question, **options).orderBy("rank")
        found = [json.loads(x) for x in rows.select(F.to_json(F.struct("rank", "id", "source_path", "source_name", "file_type", "raw_content", "freshness", "corroboration", "consistency", "authority", "overall"))).toPandas().iloc[:, 0]]
        units: list[dict] = []
        if found and self.units is not None:
            asked = self.spark.createDataFrame([(0, self.embedder.embed([question])[0])], "query_id long, embedding array<float>")
            near = plans.vector.knn(self.units.select(F.col("cluster").alias("vec_id"), F.col("centroid").alias("embedding")), asked, 5)
            got = near.join(self.units, F.col("vec_id") == F.col("cluster")).orderBy("rank")
            units = [r.asDict(True) for r in got.select("unit_id", "topic", "summary", "overall", "fragment_ids").collect()]
        return {"fragments": found, "units": units}

    def answer(self, messages: list[dict], *, concise: bool = False, **options) -> dict:
        """An answer with sources and trust, from a cache where one holds it."""
        if self.model is None:
            raise ValueError("no model to answer with")
        question, now = self._asked(messages), self.spark.sql(f"SELECT unix_seconds(TIMESTAMP '{self.as_of}')").first()[0]
        key = self.spark.range(1).select(text_functions.request_key(F.lit(question), F.lit(concise), F.lit(json.dumps(options, sort_keys=True, default=list)))).first()[0]
        held = self.cache.quick(key, now)
        if held is not None:
            return json.loads(held)
        rows = self.retrieved(question, expand=not options.pop("no_expand", False), **options).persist()
        queries = self.spark.createDataFrame([(0,)], "query_id long")
        signed = plans.signature(rows.join(self.fragments.select("doc_id", "checksum"), "doc_id")).first()
        if signed is None:
            none = rows.select("query_id", F.lit("").alias("answer")).limit(0)
            return self._one(plans.assembled(queries, rows, none))
        held = self.cache.get(key, signed["sig"], now)
        if held is not None:
            return json.loads(held)
        out = self._one(plans.assembled(queries, rows, plans.answered(rows, self.model, concise)))
        self.cache.put(key, question, concise, signed["sig"], json.dumps(out), now)
        return out

    def local(self, messages: list[dict], **options) -> dict:
        """An answer of a small model from the five best results, without expansions; all of them are its sources."""
        if self.model is None:
            raise ValueError("no model to answer with")
        most = min(options.pop("limit", None) or 5, 5)
        rows = self.retrieved(self._asked(messages), limit=most, **options).persist()
        said = plans.answered(rows, self.model, local=True).first()
        if said is None:
            return {"content": plans.EMPTY, "sources": [], "overall": 0.0}
        sources = [r.asDict() for r in rows.orderBy("rank").select("id", "source_path", "source_name").collect()]
        signals = plans.local(rows).first().asDict()
        return {"content": said["answer"], "sources": sources, **{k: v for k, v in signals.items() if k != "query_id"}}

    @staticmethod
    def _one(frame: DataFrame) -> dict:
        return {k: v for k, v in frame.first().asDict(True).items() if k != "query_id"}
