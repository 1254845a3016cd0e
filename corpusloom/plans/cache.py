"""Answers kept in memory and in a table."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TTL, FAST_TTL, PRUNE, MOST = 600, 120, 3600, 256


class MemoryCache:
    """At most MOST answers; the one put in first goes first. Times are seconds, given by the caller."""

    def __init__(self, most: int = MOST, ttl: float = TTL, fast_ttl: float = FAST_TTL):
        self.most, self.ttl, self.fast_ttl = most, ttl, fast_ttl
        self.held: OrderedDict[str, tuple[str, str, float]] = OrderedDict()

    def put(self, key: str, sig: str, answer: str, now: float) -> None:
        self.held.pop(key, None)
        while len(self.held) >= self.most:
            self.held.popitem(last=False)
        self.held[key] = (sig, answer, now)

    def get(self, key: str, now: float, sig: str | None = None) -> str | None:
        """An answer of this key: with a signature if it is the same and not older than ttl, without one within fast_ttl."""
        found = self.held.get(key)
        if found is None:
            return None
        if now - found[2] > self.ttl:
            del self.held[key]
            return None
        good = found[0] == sig if sig is not None else now - found[2] <= self.fast_ttl
        return found[1] if good else None


def lookup(cache: DataFrame, requests: DataFrame, as_of: str, ttl: int = TTL) -> DataFrame:
    """requests (cache_key, fragment_sigs) with the stored answer that is valid at as_of, else null."""
    live = cache.where(F.col("created_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"make_dt_interval(0, 0, 0, {ttl})"))
    best = live.groupBy("cache_key", "fragment_sigs").agg(F.max_by("answer_json", F.struct("created_at", "answer_json")).alias("answer_json"))
    return requests.join(best, ["cache_key", "fragment_sigs"], "left")


def pruned(cache: DataFrame, as_of: str, age: int = PRUNE) -> DataFrame:
    return cache.where(F.col("created_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"make_dt_interval(0, 0, 0, {age})"))
