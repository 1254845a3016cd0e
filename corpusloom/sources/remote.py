"""Sources behind a paged interface: chats and wiki pages. What asks the server is given by the caller, so that it can be a client of any
library, or a recording.

Pages are fetched by the driver, one after the other as their cursors demand, and written in blocks to a folder that Spark reads."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import messages

#: get(url) gives (status, headers, decoded JSON).
Get = Callable[[str], tuple[int, dict[str, str], dict]]
RETRIES, PAGE, WIKI_PAGE, BLOCK = 5, 200, 25, 5000


def asked(get: Get, url: str, sleep: Callable[[float], None] = time.sleep) -> dict:
    """A page; after status 429 the server's time is waited, at most RETRIES times."""
    for tried in range(RETRIES + 1):
        status, headers, body = get(url)
        if status == 200:
            return body
        if status != 429:
            raise RuntimeError(f"status {status} from {url}")
        if tried < RETRIES:
            wait = headers.get("Retry-After", "")
            sleep(int(wait) if wait.isdigit() and int(wait) > 0 else 1)
    raise RuntimeError(f"too many requests, {RETRIES} times again: {url}")


def _written(spark: SparkSession, work: str, rows: Iterator[tuple], schema: str) -> DataFrame:
    to, block = f"{work.rstrip('/')}/remote-{uuid.uuid4().hex}", []
    spark.createDataFrame([], schema).write.parquet(to)
    for row in rows:
        block.append(row)
        if len(block) >= BLOCK:
            spark.createDataFrame(block, schema).write.mode("append").parquet(to)
            block = []
    if block:
        spark.createDataFrame(block, schema).write.mode("append").parquet(to)
    return spark.read.schema(schema).parquet(to)


@dataclass
class Chat:
    """Channels of a chat: a document of each thread, and one of each day's other messages."""

    get: Get
    base: str
    channels: list[str]
    work: str
    name: str = "chat"
    sleep: Callable[[float], None] = field(default=time.sleep)

    def _pages(self, url: str) -> Iterator[dict]:
        cursor = ""
        while True:
            body = asked(self.get, url + (f"&cursor={quote(cursor, safe="")}" if cursor else ""), self.sleep)
            if not body.get("ok"):
                raise RuntimeError(f"the server says {body.get('error', 'nothing')}")
            yield from body.get("messages", ())
            cursor = (body.get("response_metadata") or {}).get("next_cursor", "")
            if not cursor:
                return

    def _messages(self, since: int) -> Iterator[tuple]:
        for channel in self.channels:
            named = asked(self.get, f"{self.base}/api/conversations.info?channel={channel}", self.sleep)
            label = (named.get("channel") or {}).get("name", channel)
            for m in self._pages(f"{self.base}/api/conversations.history?channel={channel}&oldest={since}&limit={PAGE}"):
                threaded = m.get("reply_count", 0) > 0
                if m.get("thread_ts") and m["thread_ts"] != m["ts"]:
                    continue  # a reply that is shown in the channel, too: its thread has it
                replies = self._pages(f"{self.base}/api/conversations.replies?channel={channel}&ts={m['ts']}&limit={PAGE}") if threaded else [m]
                for r in replies:
                    yield channel, label, m["ts"] if threaded else None, r["ts"], r.get("user", ""), r.get("text", "")

    def scan(self, spark: SparkSession, since: int = 0) -> DataFrame:
        """source_type, source_name, source_path, raw_content, checksum, author, content_date of the messages since a time in seconds."""
        rows = _written(spark, self.work, self._messages(since), "channel string, label string, thread string, ts string, user string, text string")
        rows = rows.withColumn("at", messages.chat_time(F.col("ts")))
        line = F.concat(F.lit("["), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("] "), "user", F.lit(": "), "text", F.lit("\n"))
        path = F.concat_ws("/", "label", F.when(F.col("thread").isNotNull(), F.concat(F.lit("thread-"), "thread")).otherwise(F.date_format("at", "yyyy-MM-dd")))
        said = F.struct("ts", line.alias("line"), "user", "at")
        out = rows.groupBy(path.alias("source_path")).agg(F.sort_array(F.collect_list(said)).alias("m"))
        content = F.array_join(F.transform("m", lambda x: x["line"]), "")
        return out.select(
            F.lit("slack").alias("source_type"), F.lit(self.name).alias("source_name"), "source_path", content.alias("raw_content"), F.sha2(content, 256).alias("checksum"),
            F.col("m")[0]["user"].alias("author"), F.array_max(F.transform("m", lambda x: x["at"])).alias("content_date"),
        )


@dataclass
class Pages:
    """A wiki space: a document of each page, with its text as stored."""

    get: Get
    base: str
    space: str
    work: str
    sleep: Callable[[float], None] = field(default=time.sleep)

    def _pages(self) -> Iterator[tuple]:
        url = f"{self.base}/wiki/rest/api/content?spaceKey={quote(self.space)}&expand=body.storage,version&limit={WIKI_PAGE}&start=0"
        while url:
            body = asked(self.get, url, self.sleep)
            for p in body.get("results", ()):
                version = p.get("version") or {}
                yield p["id"], p["body"]["storage"]["value"], version.get("when", ""), (version.get("by") or {}).get("displayName", "")
            following = (body.get("_links") or {}).get("next", "")
            url = following if following.startswith("http") else self.base + following if following else ""

    def scan(self, spark: SparkSession) -> DataFrame:
        """source_type, source_name, source_path (the page's id), raw_content, checksum, source_uri, author, content_date."""
        rows = _written(spark, self.work, self._pages(), "source_path string, raw_content string, at string, author string")
        return rows.select(
            F.lit("confluence").alias("source_type"), F.lit(self.space).alias("source_name"), "source_path", "raw_content", F.sha2("raw_content", 256).alias("checksum"),
            F.concat(F.lit(f"{self.base}/wiki/spaces/{self.space}/pages/"), "source_path").alias("source_uri"), "author", messages.wiki_time(F.col("at")).alias("content_date"),
        )
