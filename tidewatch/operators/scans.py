"""Ordered scans (running totals, as-of lookups) that never put a whole key in one task.

A plain ``Window.partitionBy(key).orderBy(time)`` sends every row of a key to
one task. Here each key is cut into chunks along its order; the window runs per
(key, chunk), and one small row per chunk carries the totals across chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "__key"
CHUNK = "__chunk"
SALT = "__salt"


def time_chunk(time: str, seconds: int) -> Column:
    """Chunk number of a timestamp column."""
    return F.floor(F.unix_micros(F.col(time)) / F.lit(seconds * 1_000_000))


def key_of(keys: Sequence[str]) -> Column:
    """Keys as one struct: equal structs match even where a key is null."""
    return F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))


def running_before(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    chunk: Column,
    measures: Mapping[str, Column],
    totals: bool = False,
    coarse: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Add, per measure, its sum over all earlier rows of the key (0 for the first).

    ``chunk`` must not decrease along ``order``. With ``totals=True`` the sum
    over the whole key is added as ``<name>_total``. Where a key may have very
    many chunks, ``coarse`` maps a chunk to a larger one and the chunk rows are
    themselves summed in chunks.
    """
    base = df.withColumn(KEY, key_of(keys)).withColumn(CHUNK, chunk)
    base = base.withColumns({f"__m_{n}": c for n, c in measures.items()})

    per_chunk = base.groupBy(KEY, CHUNK).agg(*[F.sum(f"__m_{n}").alias(f"__s_{n}") for n in measures])
    total_names = [f"{n}_total" for n in measures] if totals else []
    if coarse is None:
        earlier = Window.partitionBy(KEY).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        sums = [F.sum(f"__s_{n}").over(earlier).alias(f"__c_{n}") for n in measures]
        whole = [F.sum(f"__s_{n}").over(Window.partitionBy(KEY)).alias(f"{n}_total") for n in measures]
        carry = per_chunk.select(KEY, CHUNK, *sums, *(whole if totals else []))
    else:
        inner = per_chunk.withColumnsRenamed({KEY: "__k", CHUNK: "__c"})
        parts = {n: F.col(f"__s_{n}") for n in measures}
        scanned = running_before(inner, ["__k"], ["__c"], coarse(F.col("__c")), parts, totals)
        renamed = [F.col(n).alias(f"__c_{n}") for n in measures]
        carry = scanned.select(F.col("__k").alias(KEY), F.col("__c").alias(CHUNK), *renamed, *total_names)

    local = Window.partitionBy(KEY, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    base = base.withColumns({f"__l_{n}": F.sum(f"__m_{n}").over(local) for n in measures})
    joined = base.join(carry, [KEY, CHUNK])
    zero = F.lit(0)
    return joined.withColumns(
        {n: F.coalesce(f"__l_{n}", zero) + F.coalesce(f"__c_{n}", zero) for n in measures}
    ).drop(
        KEY,
        CHUNK,
        *[f"__m_{n}" for n in measures],
        *[f"__l_{n}" for n in measures],
        *[f"__c_{n}" for n in measures],
    )


def running_low(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], chunk: Column, value: str, name: str) -> DataFrame:
    """Add the smallest ``value`` so far, the row's own included, chunk by chunk like :func:`running_before`."""
    base = df.withColumn(KEY, key_of(keys)).withColumn(CHUNK, chunk)
    earlier = Window.partitionBy(KEY).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = base.groupBy(KEY, CHUNK).agg(F.min(value).alias("__low")).select(KEY, CHUNK, F.min("__low").over(earlier).alias("__carry"))
    local = Window.partitionBy(KEY, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = base.withColumn("__own", F.min(value).over(local)).join(carry, [KEY, CHUNK])
    return seen.withColumn(name, F.least("__own", "__carry")).drop(KEY, CHUNK, "__own", "__carry")


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    value: str,
    chunk_seconds: int,
    direction: str = "backward",
    salts: int = 1,
) -> DataFrame:
    """For each left row, the struct of the nearest right row at or before it
    (``backward``) or at or after it (``forward``), as column ``value``.

    Both sides are merged into one ordered stream per (key, chunk) and the last
    right row is carried along, so no (left, right) pairs are produced. Right
    rows with the same time are resolved by the smallest struct.

    Left rows do not depend on each other, so ``salts`` spreads those of a chunk
    over that many tasks; each gets its own copy of the (smaller) right side.
    """
    sign = 1 if direction == "backward" else -1
    chunk = F.floor(F.col("__t") / F.lit(chunk_seconds * 1_000_000))
    l_rows = left.select(
        key_of(keys).alias(KEY),
        (F.unix_micros(left_time) * sign).alias("__t"),
        F.struct(*[F.col(c) for c in left.columns]).alias("__left"),
        F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int").alias(SALT),
    ).withColumn(CHUNK, chunk)
    # one right row per (key, time): duplicates are folded before the shuffle
    r_rows = (
        right.select(
            key_of(keys).alias(KEY),
            (F.unix_micros(right_time) * sign).alias("__t"),
            F.struct(*[F.col(c) for c in right.columns]).alias("__right"),
        )
        .groupBy(KEY, "__t")
        .agg(F.min("__right").alias("__right"))
        .withColumn(CHUNK, chunk)
    )
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias(SALT)

    # one small row per chunk: its last right row, carried into the later chunks
    last = (
        l_rows.select(KEY, CHUNK, F.lit(None).cast("long").alias("__t"))
        .unionByName(r_rows.select(KEY, CHUNK, "__t", "__right"), allowMissingColumns=True)
        .groupBy(KEY, CHUNK)
        .agg(F.max_by("__right", "__t").alias("__last"))
    )
    earlier = Window.partitionBy(KEY).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(KEY, CHUNK, F.last("__last", ignorenulls=True).over(earlier).alias("__carry"))
    carry = carry.select(KEY, CHUNK, "__carry", every_salt)

    both = l_rows.unionByName(r_rows.select("*", every_salt), allowMissingColumns=True)
    upto = (
        Window.partitionBy(KEY, CHUNK, SALT)
        .orderBy("__t", F.col("__left").isNotNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    seen = both.withColumn("__seen", F.last("__right", ignorenulls=True).over(upto)).where(F.col("__left").isNotNull())
    return seen.join(carry, [KEY, CHUNK, SALT]).select("__left.*", F.coalesce("__seen", "__carry").alias(value))
