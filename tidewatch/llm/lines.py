"""Line dedup by whole windows of lines, in DataFrame operations alone.

A *run* is a series of consecutive lines of one document; blank lines do not count.
The rule: a line goes if it lies in a run of at least ``min_words`` words that
also occurs earlier in the corpus, in the order of (doc_id, text, line).

Windows are measured in words: from each line forward, and from each line back,
to the shortest run of ``min_words`` words. Any line of a repeated run lies in such
a window inside the run, so looking at windows finds all of it. A window's
smallest line hash is its fingerprint. Only fingerprints met in two places go on
to the comparison of whole windows by hash, which alone decides: no subset of
fingerprints is selected and no match is extended line by line. Windows that overlap or adjoin then make up maximal
runs, and the blank lines within them go too.

A fingerprint or a window that a third of the corpus shares is met once in each
task's partial aggregate; occurrences are joined to their first place only, never
to each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.llm.common import materialize, source, table, text_key

MIN_WORDS = 40


def squeezed(line: Column) -> Column:
    """A line for comparison: outer white space cut off, inner white space one blank."""
    return F.trim(F.regexp_replace(line, r"\s+", " "))


def row_key(doc_id: Column, text: Column) -> Column:
    """16 bytes for (doc_id, text): rows alike in both are one document."""
    return text_key(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit(""))))


def windows(docs: DataFrame, min_words: int) -> DataFrame:
    """Windows of every document (key, doc_id, text): first and last line, also by number without blank ones, fingerprint, content."""
    cut = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line")
    lines = docs.withColumn("uid", F.monotonically_increasing_id()).select("key", "doc_id", "uid", cut)
    lines = lines.withColumn("line", squeezed(F.col("line")))
    lines = lines.filter("line <> ''").select(
        "key",
        "doc_id",
        "uid",
        "pos",
        F.unhex(F.md5("line")).alias("hash"),
        (F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1).cast("long").alias("words"),
    )
    in_order = Window.partitionBy("uid").orderBy("pos")
    lines = lines.withColumn("upto", F.sum("words").over(in_order)).withColumn("nth", F.row_number().over(in_order))
    lines = lines.withColumn("before", F.col("upto") - F.col("words"))
    ahead = Window.partitionBy("uid").orderBy("before").rangeBetween(0, min_words - 1)
    back = Window.partitionBy("uid").orderBy("upto").rangeBetween(1 - min_words, 0)

    def window(frame) -> Column:
        return F.struct(
            F.min("pos").over(frame).alias("start"),
            F.max("pos").over(frame).alias("end"),
            F.min("nth").over(frame).alias("from"),
            F.max("nth").over(frame).alias("to"),
            F.sum("words").over(frame).alias("words"),
            F.min(F.struct("hash", "pos")).over(frame).alias("least"),
            F.collect_list("hash").over(frame).alias("hashes"),
        )

    both = lines.select("key", "doc_id", "words", window(ahead).alias("ahead"), window(back).alias("back"))
    # A window back that is also a window ahead from its first line comes once.
    own = F.when(F.col("ahead.words") >= min_words, F.array("ahead")).otherwise(F.array())
    other = F.when(F.col("back.words") - F.col("words") >= min_words, F.array("back")).otherwise(F.array())
    content = F.unhex(F.md5(F.concat_ws("", F.transform("w.hashes", F.hex))))
    return both.select("key", "doc_id", F.explode(F.concat(own, other)).alias("w")).select(
        "key",
        "doc_id",
        F.col("w.start").alias("start"),
        F.col("w.end").alias("end"),
        F.col("w.from").alias("from"),
        F.col("w.to").alias("to"),
        F.col("w.least.hash").alias("print"),
        F.col("w.least.pos").alias("print_pos"),
        content.alias("run"),
    )


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, start, end) of the maximal series of lines that repeat earlier runs."""
    found = materialize(windows(docs, min_words), "line-windows")
    place = F.struct("key", F.col("print_pos"))
    shared = found.groupBy("print").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("print")
    # Written down, the small side of either join is a shuffle of its own, and Spark can split a common line or run.
    shared = materialize(shared, "line-prints")
    near = materialize(found.join(shared, "print", "left_semi").drop("print", "print_pos"), "line-matches")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "start")
    first = near.groupBy("run").agg(F.min(order).alias("first"), F.max(order).alias("final")).filter("first <> final")
    first = materialize(first.select("run", "first"), "line-firsts")
    later = near.join(first, "run").filter(order > F.col("first")).select("key", "start", "end", "from", "to").distinct()
    by_start = Window.partitionBy("key").orderBy("from", "to")
    reach = F.max("to").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opened = later.withColumn("new", F.coalesce(F.col("from") > reach + 1, F.lit(True)).cast("int"))
    return (
        opened.withColumn("nth", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("key", "nth")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("nth")
    )


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``__runs`` (start, end of the lines cut out) and ``text`` without them.

    Every row stays, with all its columns. Null texts stay null, texts without a
    repeated run stay as they are, a text that is repeated whole becomes empty.
    The first occurrence always stays; null ids come last in the order. Rows alike
    in id and text are one document and are cut alike.
    """
    keyed = docs.withColumn("__key", row_key(F.col(doc_id), F.col(text)))
    runs = repeated_runs(source(keyed, key="__key", doc_id=doc_id, text=text), min_words)
    edits = runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__runs"))
    joined = keyed.join(edits.withColumnRenamed("key", "__key"), "__key", "left")
    lines = F.split(F.col(text), "\n")
    cut = F.flatten(F.transform("__runs", lambda r: F.sequence(r["start"], r["end"])))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), cut)
    joined = joined.withColumn("__lines", lines)
    kept = F.concat_ws("\n", F.transform(stay, lambda i: F.get("__lines", i)))
    return joined.withColumn(text, F.when(F.col("__runs").isNull(), F.col(text)).otherwise(kept)).select(
        *docs.columns, F.coalesce("__runs", F.array().cast("array<struct<start:int,end:int>>")).alias("__runs")
    )


def full_lines(text: Column) -> Column:
    """How many lines of a text are not blank."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: squeezed(x) != "")).cast("long")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document once runs of lines that repeat earlier ones are gone."""
    docs = source(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    out = dedup_lines(docs)
    runs = F.array_join(F.transform("__runs", lambda r: F.concat_ws(":", r["start"], r["end"])), ",")
    return out.select(
        "doc_id",
        full_lines(F.col("text")).alias("n_lines"),
        F.size("__runs").cast("long").alias("n_runs"),
        runs.alias("runs"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


OP4_SQL = rf"""
WITH raw AS (SELECT doc_id, text, coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, '') AS whole,
                    string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
cut AS (SELECT doc_id, unhex(md5(whole)) AS key, parts, unnest(range(0, len(parts))) AS pos FROM raw),
lines AS (SELECT doc_id, key, pos, trim(regexp_replace(parts[pos + 1], '[ \t\n\x0B\f\r]+', ' ', 'g')) AS line FROM cut),
counted AS (SELECT *, len(string_split(line, ' ')) AS words FROM lines WHERE line <> ''),
summed AS (SELECT *, sum(words) OVER d AS upto, row_number() OVER d AS nth FROM (SELECT DISTINCT * FROM counted) WINDOW d AS (PARTITION BY key ORDER BY pos)),
placed AS (SELECT *, CAST(upto - words AS BIGINT) AS before, CAST(upto AS BIGINT) AS till FROM summed),
framed AS (
  SELECT doc_id, key, min(pos) OVER a AS s, max(pos) OVER a AS e, min(nth) OVER a AS f, max(nth) OVER a AS t,
         sum(words) OVER a AS n, list(line) OVER a AS run FROM placed
  WINDOW a AS (PARTITION BY key ORDER BY before RANGE BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING)
  UNION
  SELECT doc_id, key, min(pos) OVER b, max(pos) OVER b, min(nth) OVER b, max(nth) OVER b, sum(words) OVER b, list(line) OVER b FROM placed
  WINDOW b AS (PARTITION BY key ORDER BY till RANGE BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW)),
ranked AS (SELECT *, rank() OVER (PARTITION BY run ORDER BY doc_id, key, s) AS nth FROM framed WHERE n >= {MIN_WORDS}),
windows AS (SELECT DISTINCT key, s, e, f, t FROM ranked WHERE nth > 1),
opened AS (SELECT *, CASE WHEN f > 1 + max(t) OVER (PARTITION BY key ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
             THEN 1 ELSE 0 END AS new FROM windows),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS g FROM opened),
merged AS (SELECT key, g, min(s) AS s, max(e) AS e FROM grouped GROUP BY key, g),
gone AS (SELECT key, unnest(range(s, e + 1)) AS pos FROM merged),
runs AS (SELECT key, count(*) AS n_runs, string_agg(s || ':' || e, ',' ORDER BY s) AS runs FROM merged GROUP BY key),
stay AS (SELECT c.key, string_agg(c.parts[c.pos + 1], chr(10) ORDER BY c.pos) AS text
         FROM (SELECT DISTINCT key, pos, parts FROM cut) c LEFT JOIN gone g ON c.key = g.key AND c.pos = g.pos WHERE g.pos IS NULL GROUP BY c.key),
whole_lines AS (SELECT c.key, count(*) AS n_lines FROM (SELECT DISTINCT key, pos FROM counted) c
         LEFT JOIN gone g ON c.key = g.key AND c.pos = g.pos WHERE g.pos IS NULL GROUP BY c.key)
SELECT r.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_runs, 0) AS n_runs, coalesce(runs, '') AS runs,
       sha256(coalesce(stay.text, '')) AS text_sha256
FROM raw r LEFT JOIN runs ON unhex(md5(whole)) = runs.key LEFT JOIN stay ON unhex(md5(whole)) = stay.key LEFT JOIN whole_lines ON unhex(md5(whole)) = whole_lines.key"""
