"""Scalar functions on texts, paths, ids and times, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed by the data format: what stands before the metadata of older answers.
META = "---KB_META---"


def citations(answer: Column) -> Column:
    """The ids cited in [brackets], each once, in order."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[([a-f0-9]{8,})\]"), F.lit(1)))


def strip_meta(answer: Column, mark: str = META) -> Column:
    """The answer before its last metadata mark, without white space around it; an answer without a mark as it is."""
    before = F.regexp_replace(answer, rf"(?s)^(.*){mark}.*$", "$1")
    return F.when(F.contains(answer, F.lit(mark)), F.regexp_replace(before, r"^\s+|\s+$", "")).otherwise(answer)


def expansions(reply: Column, most: int = 5) -> Column:
    """The lines of a reply without one list mark each (``1.``, ``1)``, ``-`` or ``*``), at most ``most``."""
    lines = F.filter(F.transform(F.split(reply, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    bare = F.transform(
        lines,
        lambda x: F.trim(
            F.when((F.length(x) > 2) & x.rlike(r"^[1-9][.)]"), F.substring(x, 3, 1 << 30)).when((F.length(x) > 2) & x.rlike(r"^[-*]"), F.substring(x, 2, 1 << 30)).otherwise(x)
        ),
    )
    return F.slice(F.filter(bare, lambda x: x != ""), 1, most)


def age(days: Column) -> Column:
    """Whole days as words: months of 30 days, years of 12 such months."""
    months, years = F.floor(days / 30), F.floor(days / 360)
    s = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))
    return F.when(days < 1, "today").when(days < 30, s(days, "day")).when(months < 12, s(months, "month")).otherwise(s(years, "year"))


def decimals(x: Column, digits: int) -> Column:
    """A number with so many digits after the point; of two that are equally near the even one, where format_string takes the larger.
    What rounds to 0 keeps its sign; null has none."""
    even = F.bround(x, digits)
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", F.when(even == 0, x).otherwise(even)))


def size(n: Column) -> Column:
    mb, kb = n / F.lit(1048576.0), n / F.lit(1024.0)
    return F.when(n >= 1048576, F.concat(decimals(mb, 1), F.lit(" MB"))).when(n >= 1024, F.concat(decimals(kb, 1), F.lit(" KB"))).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def split_csv(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, ","), lambda y: F.trim(y)), lambda y: y != "")


def mask(secret: Column) -> Column:
    return F.when(F.length(secret) < 8, "****").otherwise(F.concat(F.substring(secret, 1, 8), F.lit("****")))


def is_secret(key: Column) -> Column:
    """Whether a setting of this name is masked."""
    return F.upper(key).rlike("KEY|SECRET|TOKEN")


def source_label(source_type: Column, source_name: Column) -> Column:
    """A source in words, by its type."""
    # Types and their words.
    words = {"git": "Git repository", "filesystem": "Local directory", "confluence": "Confluence space", "slack": "Slack channels", "github_wiki": "GitHub wiki"}
    kind = source_type
    for name, text in words.items():
        kind = F.when(source_type == name, text).otherwise(kind)
    return F.concat(kind, F.lit(": "), source_name)


def first_bytes(x: Column, n: int) -> Column:
    """The first n UTF-8 bytes, without a character that is cut."""
    cut = F.make_valid_utf8(F.substring(F.encode(x, "UTF-8"), 1, n).cast("string"))
    return F.when(F.octet_length(x) <= n, x).otherwise(F.regexp_replace(cut, "\\x{FFFD}+$", ""))


def words(x: Column) -> Column:
    """How many words between white space."""
    return F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))


def cache_key(query: Column, concise: Column) -> Column:
    """First 32 hex digits of sha256("query:true|false")."""
    return F.substring(F.sha2(F.concat(query, F.lit(":"), concise.cast("string")), 256), 1, 32)


def request_key(*parts: Column) -> Column:
    """A key of the whole request, so that other sources, topics or limits get another answer."""
    return F.substring(F.sha2(F.to_json(F.struct(*parts)), 256), 1, 32)


def common_directory(paths: Column) -> Column:
    """The longest directory prefix that an array of paths shares."""
    parts = F.transform(paths, lambda p: F.split(p, "/"))
    least = F.array_min(F.transform(parts, lambda p: F.size(p) - 1))
    same = F.transform(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda i: F.size(F.array_distinct(F.transform(parts, lambda p: F.slice(p, F.lit(1), i)))) == 1)
    n = F.when(least < 1, 0).otherwise(F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a["n"] + F.when(a["on"] & x, 1).otherwise(0)).alias("n"), (a["on"] & x).alias("on")), lambda a: a["n"]))
    return F.array_join(F.slice(parts[0], F.lit(1), n), "/")
