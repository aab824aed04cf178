"""Changes of several tables as one tagged feed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.joins import WATCHED
from tidewatch.operators.rows import document


def change_feed(
    tables: Mapping[str, DataFrame], ts: Mapping[str, Column] | None = None, watched: Sequence[str] = WATCHED
) -> DataFrame:
    """(collection, operationType, ts, doc) over the watched tables.

    A table may carry an ``operationType`` column; deletes are left out, as they
    hold no document. The plan is a union, so it runs on streams too.
    """
    parts = []
    for name, df in tables.items():
        if name not in watched:
            continue
        op = F.col("operationType") if "operationType" in df.columns else F.lit("insert")
        columns = [c for c in df.columns if c != "operationType"]
        parts.append(
            df.where(op != "delete").select(
                F.lit(name).alias("collection"),
                op.alias("operationType"),
                (ts or {}).get(name, F.current_timestamp()).alias("ts"),
                document(df, columns).alias("doc"),
            )
        )
    if not parts:
        raise ValueError("no watched table given")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
