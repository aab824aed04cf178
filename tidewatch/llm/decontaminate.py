"""Benchmark decontamination by a broadcast hash set of n-grams.

A task turns each text into words, looks for runs of words that benchmarks use at
all, and slides windows over those runs only. A window is looked up as the words
themselves, so a hit is verified by being found.

What is broadcast is a number for each window, never its items: windows of the same
items share a number, and rows with hits join their numbers to the items afterwards.
The broadcast set has a bound: ``block_windows`` windows. A larger benchmark is
cut by hash into blocks that keep the bound, and the documents are scanned once a
block; further blocks return hits alone. So every size is exact.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import kept, materialize, small_batches, source, table, unused

WIDTH = 13
#: Windows of one broadcast block, about 300 bytes each in a worker.
BLOCK_WINDOWS = 400_000

#: A-Z, 0-9 and everything beyond ASCII, after A-Z are lower-cased.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(65, 91)}
_BLANK = {i: 32 for i in range(128) if not (48 <= i <= 57 or 97 <= i <= 122)} | _LOWER


def words(text: str | None) -> list[str]:
    """Words of a text: only A-Z are folded; letters beyond ASCII stay as they are."""
    # A blank between words is ASCII 32 here; str.split() would also cut at wider spaces.
    return [w for w in (text or "").translate(_BLANK).split(" ") if w]


def windows(text: str | None, width: int = WIDTH) -> list[tuple[str, ...]]:
    """Windows of an item: ``width`` words, or all of a shorter item; none without words."""
    w = words(text)
    return [tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []


class Windows:
    """A block of windows: by length, each with its number, and the words they use."""

    def __init__(self, rows: list[tuple[str, int]]):
        self.items: dict[int, dict[tuple[str, ...], int]] = {}
        self.vocabulary: set[str] = set()
        for text, number in rows:
            gram = tuple(text.split(" "))
            self.items.setdefault(len(gram), {})[gram] = number
            self.vocabulary.update(gram)

    def find(self, w: list[str]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged word spans (start, end) covered by windows, and the numbers of these."""
        spans: list[tuple[int, int]] = []
        numbers: set[int] = set()
        if not self.items:
            return spans, numbers
        shortest, known = min(self.items), self.vocabulary
        outside = [i for i, x in enumerate(w) if x not in known]
        begin = 0
        for end in [*outside, len(w)]:
            if end - begin >= shortest:
                for n, grams in self.items.items():
                    for i in range(begin, end - n + 1):
                        number = grams.get(tuple(w[i : i + n]))
                        if number is not None:
                            numbers.add(number)
                            spans.append((i, i + n))
            begin = end + 1
        return merged(spans), numbers


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def benchmark_blocks(benchmark: DataFrame, item_id: str, text: str, width: int, block_windows: int) -> tuple[list[DataFrame], DataFrame]:
    """(gram, number) cut by hash into blocks of fewer than ``block_windows``, and (number, item_id); windows of the same items have one number."""
    spark = benchmark.sparkSession
    small_batches(spark)

    def cut(batches):
        for b in batches:
            rows = [(" ".join(g), i) for i, t in zip(b["item_id"].to_pylist(), b["text"].to_pylist(), strict=True) for g in windows(t, width)]
            yield pa.RecordBatch.from_pydict(
                {"gram": pa.array([r[0] for r in rows], pa.string()), "item_id": pa.array([r[1] for r in rows], pa.string())}
            )

    items = source(benchmark, item_id=item_id, text=text).withColumn("item_id", F.col("item_id").cast("string"))
    pairs = materialize(items.mapInArrow(cut, "gram string, item_id string").distinct(), "benchmark-windows")
    # Sums of two 64-bit hashes and a count stand for the set of a window's items, which is never gathered.
    named = pairs.withColumn("x", F.xxhash64("item_id")).withColumn("y", F.xxhash64(F.lit("y"), "item_id"))
    sums = [F.sum(F.when(F.col("item_id").isNull(), 0).otherwise(F.col(c)).cast("decimal(38,0)")).alias(c) for c in ("x", "y")]
    sets = named.groupBy("gram").agg(F.count("item_id").alias("n"), *sums)
    numbers = sets.groupBy("n", "x", "y").agg(F.min("gram").alias("least")).withColumn("number", F.monotonically_increasing_id())
    numbers = materialize(numbers, "benchmark-numbers")
    grams = materialize(sets.join(numbers, ["n", "x", "y"]).select("gram", "number"), "benchmark-grams")
    owners = numbers.select("number", F.col("least").alias("gram")).join(pairs.filter("item_id IS NOT NULL"), "gram").select("number", "item_id")
    blocks = max(1, math.ceil(2 * grams.count() / block_windows))
    return [grams.filter(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == F.lit(k)) for k in range(blocks)], owners


FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
#: What a further block finds: no texts, and only rows with hits.
HITS = "uid long, spans array<long>, numbers array<long>"
SCANNED = T.StructType([*FOUND.fields[:2], T.StructField("numbers", T.ArrayType(T.LongType()))])


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """``docs`` with ``__found``: n_words, spans (start, end, start, end, … in words) and items.

    Every row of ``docs`` stays, once, with all its columns; one called ``__found`` is
    replaced. Null and empty texts have no words and no hits. Items without words have
    no windows; an item whose id is null marks its words but is not listed. An empty
    benchmark hits nothing.

    The rows are written once, with what the first block found. Any further block reads
    the texts again and returns its hits alone, which join their rows at the end.
    """
    spark = docs.sparkSession
    uid = unused(docs, "__uid")
    rows = docs.withColumn("__found", F.lit(None).cast(SCANNED)).withColumn(uid, F.monotonically_increasing_id())
    blocks, owners = benchmark_blocks(benchmark, item_id, item_text, width, block_windows)
    schema, more = rows.schema, []
    small_batches(spark)
    for k, block in enumerate(blocks):
        listed = [(r["gram"], r["number"]) for r in block.collect()]  # bounded by block_windows
        if len(listed) > block_windows:
            raise RuntimeError(f"a block holds {len(listed)} windows; block_windows is {block_windows}")
        sent, mark = spark.sparkContext.broadcast(listed), uuid.uuid4().hex

        def scanned(b, sent=sent, mark=mark):
            known = kept("windows", mark, lambda: Windows(sent.value))  # one block's set in a worker at a time
            found = []
            for t in b[text].to_pylist():
                w = words(t)
                spans, numbers = known.find(w)
                found.append({"n_words": len(w), "spans": [x for s in spans for x in s], "numbers": sorted(numbers)})
            return found

        def first(batches, scanned=scanned):
            for b in batches:
                at = b.schema.get_field_index("__found")
                yield b.set_column(at, b.schema.field(at).name, pa.array(scanned(b), b.schema.field(at).type))

        def later(batches, scanned=scanned):
            for b in batches:
                hits = [(u, f["spans"], f["numbers"]) for u, f in zip(b[uid].to_pylist(), scanned(b), strict=True) if f["spans"]]
                columns = [pa.array([h[i] for h in hits], kind) for i, kind in enumerate((pa.int64(), *[pa.list_(pa.int64())] * 2))]
                yield pa.RecordBatch.from_arrays(columns, ["uid", "spans", "numbers"])

        if k == 0:
            rows = materialize(rows.mapInArrow(first, schema), "scanned")
        else:
            more.append(materialize(rows.select(uid, text).mapInArrow(later, HITS), "scanned-hits"))
        sent.destroy()
    if more:
        own = rows.filter(F.size("__found.spans") > 0).select(F.col(uid).alias("uid"), "__found.spans", "__found.numbers")
        rows = _with_hits(rows, reduce(DataFrame.union, more, own), uid)
    return with_items(rows.drop(uid), owners)


def _with_hits(rows: DataFrame, hits: DataFrame, uid: str) -> DataFrame:
    """``rows`` with the hits of all blocks in ``__found``."""

    def together(batches):
        for b in batches:
            spans = [[x for s in merged([p for one in every for p in zip(one[::2], one[1::2], strict=True)]) for x in s] for every in b["spans"].to_pylist()]
            numbers = [sorted({n for one in every for n in one}) for every in b["numbers"].to_pylist()]
            columns = [b["uid"], pa.array(spans, pa.list_(pa.int64())), pa.array(numbers, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "spans", "numbers"])

    every = hits.groupBy("uid").agg(F.collect_list("spans").alias("spans"), F.collect_list("numbers").alias("numbers"))  # a row a block
    union = unused(rows, "__all")
    every = every.mapInArrow(together, HITS).select(F.col("uid").alias(uid), F.struct("spans", "numbers").alias(union))
    found = F.struct(F.col("__found.n_words").alias("n_words"), F.col(f"{union}.spans").alias("spans"), F.col(f"{union}.numbers").alias("numbers"))
    joined = rows.join(every, uid, "left").withColumn("__found", F.when(F.col(union).isNotNull(), found.cast(SCANNED)).otherwise(F.col("__found")))
    return joined.select(*rows.columns)


def with_items(scanned: DataFrame, owners: DataFrame) -> DataFrame:
    """The items of the numbers in ``__found``, worked out once for rows of the same numbers; rows without hits are not moved."""
    hit, key = F.size("__found.numbers") > 0, unused(scanned, "__key")
    rows = scanned.filter(hit).withColumn(key, F.md5(F.array_join("__found.numbers", ",")))
    sets = rows.select(key, "__found.numbers").distinct().select(key, F.explode("numbers").alias("number"))
    listed = unused(scanned, "__items")
    items = sets.join(owners, "number").groupBy(key).agg(F.array_sort(F.collect_set("item_id")).alias(listed))

    def finished(items: Column) -> Column:
        return F.struct(F.col("__found.n_words").alias("n_words"), F.col("__found.spans").alias("spans"), items.alias("items")).cast(FOUND)

    none = F.array().cast("array<string>")
    rows = rows.join(items, key, "left").withColumn("__found", finished(F.coalesce(listed, none))).select(*scanned.columns)
    return rows.union(scanned.filter(~hit).withColumn("__found", finished(none)))


def hit_words() -> F.Column:
    """Words covered by the spans of ``__found``."""
    ends = F.transform(F.col("__found.spans"), lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    return F.aggregate(ends, F.lit(0).cast("long"), lambda a, x: a + x)


def contaminated() -> F.Column:
    """At least one hit word, and at least a twentieth of the words hit."""
    return (hit_words() > 0) & (20 * hit_words() >= F.col("__found.n_words"))


def remove_documents(found: DataFrame) -> DataFrame:
    """The rows of :func:`find_contamination` that are not contaminated."""
    return found.filter(~contaminated()).drop("__found")


def remove_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """The rows of :func:`find_contamination` without the characters of the hit spans."""

    @F.pandas_udf("string")
    def without(texts, spans):
        return texts.combine(spans, lambda t, s: t if t is None or not len(s) else cut_spans(t, list(s)))

    return found.withColumn(text, without(F.col(text), F.col("__found.spans"))).drop("__found")


def cut_spans(text: str, spans: list[int]) -> str:
    """``text`` without the characters from the first to the last word of each span."""
    at = [m.span() for m in WORD.finditer(text.translate(_LOWER))]
    out, done = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[done : at[a][0]])
        done = at[b - 1][1]
    return "".join([*out, text[done:]])


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each document repeats benchmark items, and whether that is too far."""
    docs = source(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    items = F.col("__found.items")
    return found.select(
        "doc_id",
        F.col("__found.n_words").alias("n_words"),
        hit_words().alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[0-9a-z\x{80}-\x{10FFFF}]+')"""
OP3_SQL = f"""
WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
grams AS (SELECT DISTINCT item, least(len(w), {WIDTH}) AS n, array_to_string(w[i:i + least(len(w), {WIDTH}) - 1], ' ') AS gram
          FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), {WIDTH}) + 2)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM grams),
dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dg AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, dg.n, i, item FROM dg JOIN grams USING (gram)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
           FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)"""
