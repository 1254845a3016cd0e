"""Full-text search: inverted index, query phrases, BM25 with implicit AND, source filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import fresh_folder, written

K1, B = 1.2, 0.75
DIGITS = 6
#: Terms of all phrases of all queries that are broadcast at most; beyond, postings are joined by a shuffle.
SENT_TERMS = 200_000
#: Ids of more than one row that are broadcast at most; beyond, the phrases of all rows are exchanged.
SENT_IDS = 200_000
#: Tokens of documents that a task looks at together.
PIECE_TOKENS = 1 << 21


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_words(query: Column) -> Column:
    """The phrases of a query: its words without quotes; all of them must be found."""
    return F.filter(F.transform(F.split(F.trim(query), r"\s+"), lambda w: F.replace(w, F.lit('"'), F.lit(""))), lambda w: w != "")


def postings(docs: DataFrame, doc_id: str, text: str, tokenizer: Callable[[Column], Column] = tokens) -> DataFrame:
    """term, doc_id, tf, positions, dl of every term of every document."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), tokenizer(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    rows = rows.select("doc_id", F.size("t").cast("long").alias("dl"), F.posexplode("t").alias("pos", "term"))
    return rows.groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def source_filter(names: list[str] = (), types: list[str] = ()) -> Column:
    """Names are alternatives, types are alternatives, both must hold; an empty list holds always."""
    keep = F.lit(True)
    if names:
        keep = keep & F.col("source_name").isin(*names)
    if types:
        keep = keep & F.col("source_type").isin(*types)
    return keep


def _phrases(queries: DataFrame, query_id: str, query: str, tokenizer: Callable[[Column], Column]) -> DataFrame:
    """query_id, p (the tokens of a query word, joined by a space), n_phrases: each different phrase of each query."""
    words = queries.select(F.col(query_id).alias("query_id"), F.posexplode(query_words(F.col(query))).alias("n", "word"))
    phrases = words.select("query_id", tokenizer(F.col("word")).alias("t")).where(F.size("t") > 0)
    phrases = phrases.select("query_id", F.array_join("t", " ").alias("p")).distinct()
    return phrases.withColumn("n_phrases", F.count("*").over(Window.partitionBy("query_id")))


def _parts(phrases: DataFrame) -> DataFrame:
    """p, n_terms, k, term: the terms of each different phrase by their places."""
    each = phrases.select("p").distinct().withColumn("t", F.split("p", " "))
    return each.select("p", F.size("t").alias("n_terms"), F.posexplode("t").alias("k", "term"))


def _few(phrases: DataFrame) -> bool:
    """Whether the phrases of all queries, and with them their terms and weights, may be broadcast."""
    return (phrases.agg(F.sum(F.size(F.split("p", " ")))).first()[0] or 0) <= SENT_TERMS


def _occurrences(held: DataFrame, parts: DataFrame, few: bool) -> DataFrame:
    """The rows of held (row, doc_id, keep, dl, term, pos) by phrase p: doc_id, keep, dl, p, tf. A phrase begins where its first term stands and
    each next term stands one further in the same row; a phrase of one term is counted by row where it is read."""
    starts = held.join(F.broadcast(parts) if few else parts, "term")
    starts = starts.select("row", "doc_id", "keep", "dl", "p", "n_terms", F.when(F.col("n_terms") > 1, F.col("pos") - F.col("k")).alias("start"))
    runs = starts.groupBy("row", "doc_id", "keep", "dl", "p", "n_terms", "start").agg(F.count("*").alias("n"))
    whole = F.when(F.col("n_terms") == 1, F.col("n")).when(F.col("n") == F.col("n_terms"), 1)
    return runs.groupBy("doc_id", "keep", "dl", "p").agg(F.sum(whole).alias("tf")).where("tf is not null")


def _top(scored: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score, rank of each query's k best."""
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return scored.select("query_id", "doc_id", "score", F.row_number().over(by).cast("long").alias("rank")).where(F.col("rank") <= k)


def _ranked(tf: DataFrame, phrases: DataFrame, total: DataFrame, k: int, few: bool, df: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, score, rank from occurrences of phrases, total (one row: n_docs, avgdl) and df (p, df: documents with p), by default those of tf.

    A document must hold all phrases, so only documents with a query's rarest one are looked at: what is joined grows with the
    rarest lists, not with queries times documents. Queries with a phrase that stands nowhere go at once. Where weights are sent, a document's
    phrases are gathered and matched where they are; else occurrences are written once, and only pairs of a query and a document with its
    rarest phrase are joined with them."""
    send = F.broadcast if few else (lambda df: df)
    if not few:
        path = fresh_folder(tf.sparkSession, "occurrences")
        tf.write.parquet(path)
        tf = tf.sparkSession.read.parquet(path)
    if df is None:
        df = tf.groupBy("p").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    of_query = Window.partitionBy("query_id")
    weights = phrases.join(df, "p").crossJoin(F.broadcast(total))
    weights = weights.withColumn("n", F.count("*").over(of_query)).withColumn("nth", F.row_number().over(of_query.orderBy("df", "p"))).where("n = n_phrases")
    weights = weights.select("query_id", "p", "n_phrases", "avgdl", F.when(idf > 0, idf).otherwise(1e-6).alias("idf"), "nth")
    rarest = weights.where("nth = 1").select("query_id", "p")
    if few:
        by_doc = tf.where("keep").groupBy("doc_id").agg(F.collect_list(F.struct("p", "dl", "tf")).alias("held"))
        led = by_doc.withColumn("p", F.explode(F.array_distinct("held.p"))).join(send(rarest), "p")
        hits = led.select("query_id", "doc_id", F.inline("held")).join(send(weights), ["query_id", "p"])
    else:
        tf = tf.where("keep").select(F.col("doc_id").alias("id"), "dl", "p", "tf")
        led = tf.join(rarest, "p").select("query_id", F.col("id").alias("doc_id")).distinct()
        hits = led.join(weights, "query_id").join(tf.withColumnRenamed("p", "held"), (F.col("p") == F.col("held")) & F.col("doc_id").eqNullSafe(F.col("id")))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.groupBy("query_id", "doc_id", "n_phrases").agg(F.round(F.sum(part), DIGITS).alias("score"), F.count("*").alias("n"))
    return _top(scored.where(F.col("n") == F.col("n_phrases")), k)


class _Asked:
    """The phrases of all queries as a task needs them: terms, the phrases of one term by it, longer ones, and the phrases of each query."""

    def __init__(self, phrases: DataFrame):
        got = phrases.select("query_id", "p").toArrow().combine_chunks()
        queries, names = (got.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in ("query_id", "p"))
        of, self.ids, self.names = queries.indices.to_numpy(), queries.dictionary, names.dictionary
        split = [x.split(" ") for x in self.names.to_pylist()]
        self.phrases = names.indices.to_numpy()[np.argsort(of, kind="stable")].astype(np.int64)
        self.starts = np.searchsorted(np.sort(of), np.arange(len(self.ids) + 1))
        number = {t: i for i, t in enumerate(dict.fromkeys(t for x in split for t in x))}
        self.n, self.terms, self.single = len(split), pa.array(list(number), pa.string()), np.full(len(number), -1)
        self.longer = []
        for i, x in enumerate(split):
            if len(x) == 1:
                self.single[number[x[0]]] = i
            else:
                self.longer.append((i, [number[t] for t in x]))

    def found(self, tokens: pa.ListArray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, row, how often it stands there), by phrase, then row, of the rows' tokens. A longer phrase is its terms next to each other."""
        term = pc.index_in(tokens.flatten(), value_set=self.terms).fill_null(-1).to_numpy()
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = np.flatnonzero(term >= 0)
        one = at[self.single[term[at]] >= 0]
        keys = [self.single[term[one]] * len(sizes) + row[one]]
        if self.longer:
            at = at[np.argsort(term[at], kind="stable")]
            bounds = np.searchsorted(term[at], np.arange(len(self.terms) + 1))
            for i, x in self.longer:
                s = at[bounds[x[0]] : bounds[x[0] + 1]]
                s = s[s + len(x) <= len(term)]
                s = s[row[s + len(x) - 1] == row[s]]
                for k, t in enumerate(x[1:], 1):
                    s = s[term[s + k] == t]
                keys.append(i * len(sizes) + row[s])
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        return key // len(sizes), key % len(sizes), n


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows of a batch with their numbers of tokens, at most PIECE_TOKENS at once, a longer row alone."""
    sizes = pc.list_value_length(batch.column(column)).to_numpy().astype(np.int64)
    ends, low = np.cumsum(sizes), 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] - sizes[low] + PIECE_TOKENS, "right")))
        yield batch.slice(low, high - low), sizes[low:high]
        low = high


def _counted(rows: DataFrame, asked: _Asked) -> tuple[int, float, np.ndarray]:
    """(number of rows, their mean length, number of rows with each phrase). Tasks count, so a row for each phrase and task is exchanged."""
    sent = rows.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        total = np.zeros(asked.n + 2, np.int64)
        for batch in batches:
            for piece, sizes in _pieces(batch, 0):
                total += np.bincount(asked.found(piece.column(0), sizes)[0], minlength=asked.n + 2)
                total[-2:] += len(sizes), sizes.sum()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["p", "n"])

    total = np.zeros(asked.n + 2, np.int64)
    for r in rows.select("t").mapInArrow(run, "p long, n long").groupBy("p").agg(F.sum("n").alias("n")).collect():  # a row a phrase
        total[r["p"]] = r["n"]
    return int(total[-2]), total[-1] / max(1, total[-2]), total[:-2]


def _stood(rows: DataFrame, asked: _Asked) -> DataFrame:
    """doc_id, keep, dl, p, tf, n: the phrases of documents whose rows may share an id; the n rows of one id and length with p are one document. Tasks count
    the phrases of the rows that they read, so a row for each phrase of a row is exchanged."""
    sent = rows.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        for batch in batches:
            for piece, dl in _pieces(batch, 1):
                p, d, tf = asked.found(piece.column(1), dl)
                at = pa.array(d)
                yield pa.RecordBatch.from_arrays([piece.column(0).take(at), piece.column(2).take(at), pa.array(dl[d]), asked.names.take(pa.array(p)), pa.array(tf)], ["doc_id", "keep", "dl", "p", "tf"])

    schema = T.StructType([rows.schema["doc_id"], T.StructField("keep", T.BooleanType()), T.StructField("dl", T.LongType()), T.StructField("p", T.StringType()), T.StructField("tf", T.LongType())])
    each = rows.select("doc_id", "t", "keep").mapInArrow(run, schema)
    return each.groupBy("doc_id", "keep", "dl", "p").agg(F.sum("tf").alias("tf"), F.count("*").alias("n"))


def _best(rows: DataFrame, phrases: DataFrame, asked: _Asked, total: tuple[int, float, np.ndarray], k: int) -> DataFrame:
    """As ``_ranked``, of documents with different ids and of queries that are sent: whatever a document holds stands in its own row, so
    tasks match and score the rows that they read, from each query's rarest phrase on, and what is exchanged is the k best of a query and piece."""
    n_docs, avgdl, df = total
    idf = np.log((n_docs - df + 0.5) / (df + 0.5))
    sent = rows.sparkSession.sparkContext.broadcast((asked, np.where(idf > 0, idf, 1e-6), avgdl or 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, idf, avgdl = sent.value
        for batch in batches:
            for piece, dl in _pieces(batch, 1):
                p, d, tf = asked.found(piece.column(1), dl)
                may = piece.column(2).fill_null(False).to_numpy(zero_copy_only=False)[d]
                p, d, tf = p[may], d[may], tf[may]
                part = idf[p] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[d] / avgdl))
                bounds = np.searchsorted(p, np.arange(asked.n + 1))
                n, place = np.diff(bounds), np.empty(len(dl), np.int64)
                place[pc.sort_indices(piece.column(0), null_placement="at_start").to_numpy()] = np.arange(len(dl))
                names, docs, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
                for q in np.flatnonzero(np.minimum.reduceat(n[asked.phrases], asked.starts[:-1])).tolist() if asked.n else ():
                    mine = asked.phrases[asked.starts[q] : asked.starts[q + 1]]
                    first, *rest = mine[np.argsort(n[mine], kind="stable")].tolist()
                    at, score = d[bounds[first] : bounds[first + 1]], part[bounds[first] : bounds[first + 1]]
                    for x in rest:
                        held = d[bounds[x] : bounds[x + 1]]
                        i = np.minimum(np.searchsorted(held, at), len(held) - 1)
                        both = held[i] == at
                        at, score = at[both], score[both] + part[bounds[x] + i[both]]
                    if len(at) > k:
                        near = np.round(score, DIGITS)
                        some = np.flatnonzero(near >= np.partition(near, len(near) - k)[len(near) - k])
                        some = some[np.lexsort((place[at[some]], -near[some]))[:k]]
                        at, score = at[some], score[some]
                    names.append(np.full(len(at), q))
                    docs.append(at)
                    scores.append(score)
                names, docs, scores = map(np.concatenate, (names, docs, scores))
                yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(names)), piece.column(0).take(pa.array(docs)), pa.array(scores)], ["query_id", "doc_id", "score"])

    schema = T.StructType([phrases.schema["query_id"], rows.schema["doc_id"], T.StructField("score", T.DoubleType())])
    return _top(rows.select("doc_id", "t", "keep").mapInArrow(run, schema).withColumn("score", F.round("score", DIGITS)), k)


def _sent(texts: DataFrame, cut: Callable[[DataFrame], DataFrame], phrases: DataFrame, k: int) -> DataFrame:
    """As ``_ranked``, of queries that are sent. Rows with an id of their own are scored where they are read; only of rows that share one, phrases are
    exchanged. ``cut`` makes tokens of the texts that are picked."""
    spark, rows, asked = texts.sparkSession, cut(texts), _Asked(phrases)
    n_docs, avgdl, df = _counted(rows, asked)
    ids = rows.groupBy(F.col("doc_id").alias("id")).count().where("count > 1").select("id")
    if ids.isEmpty():
        return _best(rows, phrases, asked, (n_docs, avgdl, df), k)
    ids = written(ids, "shared-ids")
    few, same = ids.count() <= SENT_IDS, F.col("doc_id").eqNullSafe(F.col("id"))
    tf = written(_stood(cut(texts.join(F.broadcast(ids), same, "left_semi")) if few else rows, asked), "occurrences")
    number = {p: i for i, p in enumerate(asked.names.to_pylist())}
    for r in tf.groupBy("p").agg(F.sum(F.col("n") - 1).alias("n")).where("n > 0").collect():  # a row a phrase
        df[number[r["p"]]] -= r["n"]
    total = spark.range(1).select(F.lit(n_docs).alias("n_docs"), F.lit(avgdl).alias("avgdl"))
    held = spark.createDataFrame(pa.table({"p": asked.names, "df": df})).where("df > 0")
    shared = _ranked(tf, phrases, total, k, True, held)
    if not few:
        return shared
    alone = _best(cut(texts.join(F.broadcast(ids), same, "left_anti")), phrases, asked, (n_docs, avgdl, df), k)
    return _top(alone.unionByName(shared), k)


def bm25(docs: DataFrame, queries: DataFrame, k: int, *, doc_id: str = "doc_id", text: str = "text", query_id: str = "query_id", query: str = "query", keep: Column | None = None, tokenizer: Callable[[Column], Column] = tokens) -> DataFrame:
    """query_id, doc_id, score (rounded), rank of the k best documents that hold every phrase of the query.

    A phrase is the tokens of a query word, next to each other (``docker-compose``: two). Words without tokens are ignored
    beside others. Queries are sent to the tasks and scored where the texts are read; only queries of more than SENT_TERMS terms, and rows that
    share an id (all rows, where more than SENT_IDS ids are shared), are joined with postings, of which those of query terms are exchanged.
    ``keep`` filters rows of docs before the limit; term statistics stay those of all documents. ``tokenizer`` makes tokens, without spaces, of texts and query words (``stem.tokens`` for stems)."""
    phrases = _phrases(queries, query_id, query, tokenizer)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), (keep if keep is not None else F.lit(True)).alias("keep"))
    cut = lambda some: some.select("doc_id", tokenizer(F.col("text")).alias("t"), "keep")
    if _few(phrases):
        return _sent(texts, cut, phrases, k)
    rows = cut(texts)
    total = rows.agg(F.count("*").alias("n_docs"), F.avg(F.size("t")).alias("avgdl"))
    placed = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "keep", F.size("t").alias("dl"), F.posexplode("t").alias("pos", "term"))
    return _ranked(_occurrences(placed, _parts(phrases), False), phrases, total, k, False)


class Stored:
    """An inverted index in a store: postings (term, doc_id, tf, positions, dl) in buckets of terms, and the length of every document, kept
    current document by document. A search reads the buckets of its terms only, and no texts."""

    BUCKETS = 256

    def __init__(self, store, name: str = "index", tokenizer: Callable[[Column], Column] = tokens):
        self.store, self.postings, self.lengths, self.tokenizer = store, f"{name}-postings", f"{name}-lengths", tokenizer

    def _cut(self, docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
        rows = postings(docs, doc_id, text, self.tokenizer).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.BUCKETS)).cast("int"))
        lengths = docs.select(F.col(doc_id).alias("doc_id"), F.size(self.tokenizer(F.coalesce(F.col(text), F.lit("")))).cast("long").alias("dl"))
        return rows, lengths

    def fill(self, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> bool:
        """Index all documents where there is no index yet; whether it was done."""
        if self.store.exists(self.lengths):
            return False
        rows, lengths = self._cut(docs, doc_id, text)
        self.store.write(self.postings, rows.repartition("bucket").sortWithinPartitions("term", "doc_id"), by="bucket", key=["doc_id"])
        self.store.write(self.lengths, lengths, key=["doc_id"])
        return True

    def update(self, changed: DataFrame, deleted: DataFrame | None = None, *, doc_id: str = "doc_id", text: str = "text") -> None:
        """Take in new and changed documents, and forget deleted ones (doc_id)."""
        rows, lengths = self._cut(changed, doc_id, text)
        gone = changed.select(F.col(doc_id).alias("doc_id"))
        gone = (gone if deleted is None else gone.unionByName(deleted.select("doc_id"))).distinct()
        self.store.change(self.postings, rows.repartition("bucket").sortWithinPartitions("term", "doc_id"), ["doc_id"], gone)
        self.store.change(self.lengths, lengths, ["doc_id"], gone)

    def search(self, queries: DataFrame, k: int, *, query_id: str = "query_id", query: str = "query", keep: DataFrame | None = None) -> DataFrame:
        """As ``bm25`` over the indexed documents; keep: the doc_id of those that may be found."""
        phrases = _phrases(queries, query_id, query, self.tokenizer)
        few, parts = _few(phrases), _parts(phrases)
        terms = parts.select("term").distinct()
        wanted = terms.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.BUCKETS)).cast("int"))
        held = self.store.read(self.postings).join(F.broadcast(wanted) if few else wanted, ["bucket", "term"])
        if keep is None:
            held = held.withColumn("keep", F.lit(True))
        else:
            held = held.join(keep.select("doc_id").distinct().withColumn("keep", F.lit(True)), "doc_id", "left").withColumn("keep", F.coalesce("keep", F.lit(False)))
        one = parts.where("n_terms = 1").select("p", "term")
        more = parts.where("n_terms > 1")
        counted = held.join(F.broadcast(one) if few else one, "term").select("doc_id", "keep", "dl", "p", "tf")
        placed = held.select(F.lit(0).alias("row"), "doc_id", "keep", "dl", "term", F.explode("positions").alias("pos"))
        tf = counted.unionByName(_occurrences(placed, more, few))
        total = self.store.read(self.lengths).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
        return _ranked(tf, phrases, total, k, few)
