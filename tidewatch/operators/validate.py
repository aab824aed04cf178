"""Validation rules, dead letters and breach reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Rule:
    """One named condition a row must meet."""

    code: str
    holds: Column


def required(name: str) -> Rule:
    return Rule(f"missing:{name}", F.col(name).isNotNull())


def typed(name: str, *types: str) -> Rule:
    """The value, if present, can be read as one of the types."""
    ok = F.col(name).isNull()
    for t in types:
        ok = ok | F.col(name).try_cast(t).isNotNull()
    return Rule(f"type:{name}", ok)


def min_items(name: str, n: int = 1) -> Rule:
    return Rule(f"items:{name}", F.col(name).isNull() | (F.size(name) >= n))


def dimension(name: str, dim: int) -> Rule:
    return Rule(f"dim:{name}", F.col(name).isNull() | (F.size(name) == dim) | (F.size(name) == 0))


TIME_TYPES = ("double", "timestamp")


def _holds(rule: Rule) -> Column:
    return F.coalesce(rule.holds, F.lit(False))


def _all(rules: Sequence[Rule]) -> Column:
    out = F.lit(True)
    for r in rules:
        out = out & _holds(r)
    return out


def check(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``violations``: the codes of the rules a row breaks, in rule order."""
    codes = [F.when(~_holds(r), F.lit(r.code)) for r in rules]
    return df.withColumn("violations", F.array_compact(F.array(*codes)))


def split(df: DataFrame, rules: Sequence[Rule], at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid rows, dead letters). Every input row is in exactly one of them.

    The valid side is a plain filter, so presence rules reach the scan. Dead
    letters keep the whole row as JSON with the reasons, and ``_ts`` when an
    arrival time is given.
    """
    valid = df.where(_all(rules))
    document = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    dead = check(df.where(~_all(rules)), rules).select(
        document.alias("document"), F.array_join("violations", ",").alias("reason"), *([at.alias("_ts")] if at is not None else [])
    )
    return valid, dead


def type_guard(df: DataFrame, **types: Sequence[str]) -> DataFrame:
    """Rows whose fields are present and readable as one of their types."""
    for name, allowed in types.items():
        ok = F.lit(False)
        for t in allowed:
            ok = ok | F.col(name).try_cast(t).isNotNull()
        df = df.where(F.col(name).isNotNull() & ok)
    return df


def breach_counts(df: DataFrame, rules: Sequence[Rule], table: str) -> DataFrame:
    """Warn mode: rows per broken rule; nothing is rejected."""
    counts = df.agg(*[F.count_if(~_holds(r)).alias(f"r{i}") for i, r in enumerate(rules)])
    pairs = F.array(*[F.struct(F.lit(r.code).alias("rule"), F.col(f"r{i}").alias("breaches")) for i, r in enumerate(rules)])
    return counts.select(F.lit(table).alias("table_name"), F.inline(pairs))


def embedding_rules(name: str = "embedding", dim: int | None = None) -> list[Rule]:
    rules = [required(name), min_items(name)]
    return rules + [dimension(name, dim)] if dim else rules


def ride_documents(spec: T.StructType) -> list[Rule]:
    """Presence rules from a declared schema: every non-null field is required."""
    return [required(f.name) for f in spec.fields if not f.nullable]


# The rules of each keyed table.
def zone_traffic_rules() -> list[Rule]:
    return [
        required("zone"),
        required("window_start"),
        typed("window_start", *TIME_TYPES),
        typed("window_end", *TIME_TYPES),
    ]


def anomaly_rules() -> list[Rule]:
    return [required("pickup_zone"), required("window_time"), typed("window_time", *TIME_TYPES)]


def dispatch_rules() -> list[Rule]:
    return [
        required("pickup_zone"),
        required("dispatch_summary"),
        required("window_time"),
        typed("window_time", *TIME_TYPES),
    ]


def calendar_rules() -> list[Rule]:
    return [required("event_name"), required("zone"), required("description"), required("event_time_start")]


def knowledge_rules() -> list[Rule]:
    return [required(n) for n in ("document_id", "embedding", "chunk", "event_name", "zone")]
