"""Trust of fragments and answers, as Column expressions. Nothing reads the clock: ``as_of`` is given."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

AS_OF = "2024-02-01 00:00:00"

# Kinds of file whose freshness does not decay, and authority by kind.
CODE = (".go", ".py", ".js", ".ts", ".java", ".rs", ".c", ".cpp", ".rb", ".yaml", ".yml", ".toml", ".json", ".xml", ".html")
AUTHORITY = {
    0.8: ("md", "markdown", "rst"),
    0.7: ("go", "py", "js", "ts", "java", "rs", "c", "cpp", "rb"),
    0.65: ("yaml", "yml", "toml", "json"),
    0.6: ("txt",),
    0.55: ("html", "htm", "xml"),
}
HALF_LIFE_DAYS = 130.0


@dataclass(frozen=True)
class Weights:
    freshness: float = 0.20
    corroboration: float = 0.25
    consistency: float = 0.30
    authority: float = 0.25


def round2(x: Column) -> Column:
    return F.round(x * 100) / 100


def is_code(file_type: Column) -> Column:
    return F.lower(file_type).isin(*CODE)


def freshness(content_date: Column, ingested_at: Column, file_type: Column, as_of: str = AS_OF) -> Column:
    """0.95 for code; 0.3 without a date; else exponential decay by age, between 0.1 and 1."""
    date = F.coalesce(content_date, ingested_at)
    days = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(date)) / F.lit(86400e6)
    aged = round2(F.greatest(F.lit(0.1), F.exp(-days / HALF_LIFE_DAYS)))
    return F.when(is_code(file_type), 0.95).when(date.isNull(), 0.3).when(days <= 0, 1.0).otherwise(aged)


def corroboration(n_sources: Column) -> Column:
    return F.when(n_sources <= 0, 0.0).when(n_sources == 1, 0.3).when(n_sources == 2, 0.6).when(n_sources <= 4, 0.8).otherwise(1.0)


def consistency(adjustment: Column) -> Column:
    return round2(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) + adjustment)))


def authority(file_type: Column) -> Column:
    kind = F.regexp_extract(F.lower(F.coalesce(file_type, F.lit(""))), r"\.?([^.]*)$", 1)
    out = F.lit(0.5)
    for value, kinds in reversed(AUTHORITY.items()):
        out = F.when(kind.isin(*kinds), value).otherwise(out)
    return out


def overall(fresh: Column, corroborated: Column, consistent: Column, authoritative: Column, w: Weights = Weights()) -> Column:
    return round2(fresh * w.freshness + corroborated * w.corroboration + consistent * w.consistency + authoritative * w.authority)


# The same rules for the oracle.


def _in(expr: str, values) -> str:
    return f"{expr} IN ({', '.join(repr(v) for v in values)})"


def freshness_sql(date: str, file_type: str, as_of: str = AS_OF) -> str:
    days = f"((epoch_us(TIMESTAMP '{as_of}') - epoch_us({date})) / 86400e6::DOUBLE)"
    return (
        f"CASE WHEN {_in(f'lower({file_type})', CODE)} THEN 0.95::DOUBLE WHEN {date} IS NULL THEN 0.3::DOUBLE WHEN {days} <= 0 THEN 1.0::DOUBLE "
        f"ELSE round(greatest(0.1::DOUBLE, exp(-{days} / 130.0::DOUBLE)) * 100) / 100 END"
    )


def corroboration_sql(n: str) -> str:
    return f"CASE WHEN {n} <= 0 THEN 0.0::DOUBLE WHEN {n} = 1 THEN 0.3::DOUBLE WHEN {n} = 2 THEN 0.6::DOUBLE WHEN {n} <= 4 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END"


def consistency_sql(adj: str) -> str:
    return f"round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + {adj})) * 100) / 100"


def authority_sql(file_type: str) -> str:
    kind = f"regexp_extract(lower(coalesce({file_type}, '')), '\\.?([^.]*)$', 1)"
    return "CASE " + " ".join(f"WHEN {_in(kind, kinds)} THEN {value}::DOUBLE" for value, kinds in AUTHORITY.items()) + " ELSE 0.5::DOUBLE END"


def overall_sql(f: str, c: str, s: str, a: str) -> str:
    return f"round(({f} * 0.2::DOUBLE + {c} * 0.25::DOUBLE + {s} * 0.3::DOUBLE + {a} * 0.25::DOUBLE) * 100) / 100"
