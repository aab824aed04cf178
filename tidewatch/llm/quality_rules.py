"""Quality rules learned as a decision list, in DataFrame operations alone.

Counts of a text become shares (:data:`FEATURES`). Sequential covering learns, from
counts of labelled rows, an ordered list of rules that name bad documents:

1. *Grow* on two thirds of the labelled rows: start from all rows no earlier rule
   covers, add the threshold condition of the highest information gain, and go on
   until no good document is covered or nothing is gained.
2. *Prune* on the other third: drop the last conditions while that raises the share of
   bad documents among the covered, less the good ones.
3. Keep the rule if the other third confirms it; take its rows away; go on.

Every step is one aggregation of all labelled rows into counts by (feature, bin), a
number of rows that the features and bins fix. The list becomes one Spark
conditional expression.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import materialize, source, table
from tidewatch.llm.quality import held_out

#: Counts of :func:`counted` that every rule is made of, as shares.
FEATURES = {
    "mean_word": ("word_chars", "n_words"),
    "symbols": ("n_symbols", "word_chars"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "repeated_lines": ("n_dup_lines", "n_lines"),
    "distinct_words": ("n_distinct_words", "n_words"),
    "words_a_line": ("n_words", "n_lines"),
    "capitals": ("n_capitals", "word_chars"),
    "digits": ("n_digits", "word_chars"),
    "marks": ("n_marks", "word_chars"),
}
#: Quantiles of either label that thresholds lie between.
QUANTILES = 48
#: Least share of bad documents that a rule covers: among the pruning rows, and among all rows with one more of each label.
PRECISION = 0.9
MIN_WORDS, REPEATED = 50, 50
#: Bits of a window's place while windows are sorted by hash.
_PLACE = 26


def _left(text: Column, others: str) -> Column:
    """How many code points stay once ``others`` are gone."""
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def _twins(ordered: str, key) -> Column:
    """The elements of a sorted array whose key equals a neighbour's."""

    def shared(x, i):
        own = key(x)
        return F.coalesce(own == key(F.get(F.col(ordered), i - 1)), F.lit(False)) | F.coalesce(
            own == key(F.get(F.col(ordered), i + 1)), F.lit(False)
        )

    return F.filter(ordered, shared)


def repeated_words(rows: DataFrame, words: str) -> DataFrame:
    """``rows`` with ``n_repeat_words``: words inside three-word windows that the text holds twice or more.

    Windows are compared by 64-bit hash. Sorting whole numbers of a part of the hash and
    the place finds the few windows that can repeat; only those are compared in full.
    Every step is linear or sorts, whatever the text repeats.
    """
    w = F.col(words)
    window = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    low, places = F.lit((1 << _PLACE) - 1).cast("long"), F.lit(1 << _PLACE)
    rows = rows.withColumn("hashes", F.slice(window, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))))
    rows = rows.withColumn(
        "ranked",
        F.when(
            F.size("hashes") < places,
            F.sort_array(F.transform("hashes", lambda h, i: F.shiftleft(F.shiftright(h, _PLACE), _PLACE).bitwiseOR(i.cast("long")))),
        ),
    )
    # Beyond 2**26 words places don't fit beside the hash, and all windows are compared in full.
    some = F.transform(_twins("ranked", lambda x: F.shiftright(x, _PLACE)), lambda x: x.bitwiseAND(low).cast("int"))
    every = F.sequence(F.lit(0), F.size("hashes") - 1)
    rows = rows.withColumn("places", F.when(F.col("ranked").isNotNull(), some).otherwise(every))
    whole = F.sort_array(F.transform("places", lambda p: F.struct(F.get(F.col("hashes"), p).alias("h"), p.alias("p"))))
    rows = rows.withColumn("whole", whole)
    rows = rows.withColumn("found", F.sort_array(F.transform(_twins("whole", lambda x: x["h"]), lambda x: x["p"])))
    covers = F.transform("found", lambda p, i: F.least(F.lit(3), F.coalesce(F.get(F.col("found"), i + 1) - p, F.lit(3))))
    total = F.aggregate(covers, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", total).drop("hashes", "ranked", "places", "whole", "found")


def counted(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every text; a null text has no words."""
    blank = r"[\x20\x09-\x0D]+"
    rows = docs.withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("words", F.filter(F.split("text", blank), lambda x: x != ""))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.select(
        "doc_id",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
        _left(F.col("text"), blank).alias("word_chars"),
        _left(F.col("text"), r"[^#*$%&|<>]+").alias("n_symbols"),
        _left(F.col("text"), r"\P{Lu}+").alias("n_capitals"),
        _left(F.col("text"), r"\P{Nd}+").alias("n_digits"),
        _left(F.col("text"), r"[^\p{P}\p{S}]+").alias("n_marks"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    rows = repeated_words(rows, "words").drop("words")
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words")))


@dataclass(frozen=True)
class Condition:
    """``feature`` above the threshold, or at most it."""

    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = share(self.feature)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def share(feature: str) -> Column:
    """A feature from the counts; 0 where its whole is 0."""
    part, whole = FEATURES[feature]
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def holds(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (c.column() for c in rule))


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one expression: false at the first rule that holds, true where none does."""
    if not rules:
        return F.lit(True)
    listed = F.when(holds(rules[0]), F.lit(False))
    for rule in rules[1:]:
        listed = listed.when(holds(rule), F.lit(False))
    return listed.otherwise(F.lit(True))


def _gain(p: int, n: int, whole_p: int, whole_n: int) -> float:
    """Information gained on the bad documents that stay covered."""
    return p * (math.log2(p / (p + n)) - math.log2(whole_p / (whole_p + whole_n))) if p else 0.0


def thresholds(rows: DataFrame) -> dict[str, list[float]]:
    """Midpoints between neighbouring quantiles of either label, for each feature."""
    at = [k / QUANTILES for k in range(QUANTILES + 1)]
    asked = [F.percentile_approx(share(f), at, 10_000).alias(f) for f in FEATURES]
    found: dict[str, set[float]] = defaultdict(set)
    for row in rows.groupBy("bad").agg(*asked).collect():  # two rows
        for f in FEATURES:
            found[f].update(row[f] or [])
    out = {}
    for f, values in found.items():
        marks = sorted(values)
        out[f] = sorted({(a + b) / 2 for a, b in zip(marks, marks[1:], strict=False)})
    return out


def _bin(feature: str, marks: list[float]) -> Column:
    """How many thresholds a value exceeds."""
    value = share(feature)
    return F.size(F.filter(F.array(*map(F.lit, marks)), lambda t: t < value))


def _counts(rows: DataFrame, marks: dict[str, list[float]]) -> dict[str, list[list[int]]]:
    """[bad, good] rows of each bin of every feature."""
    bins = [F.struct(F.lit(f).alias("feature"), F.col(f"bin_{f}").alias("bin")) for f in marks]
    parts = rows.select("bad", F.explode(F.array(*bins)).alias("at")).groupBy("at.feature", "at.bin")
    out = {f: [[0, 0] for _ in range(len(m) + 1)] for f, m in marks.items()}
    totals = parts.agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good"))
    for row in totals.collect():  # at most a row a bin
        out[row["feature"]][row["bin"]] = [row["bad"], row["good"]]
    return out


def best_condition(counts: dict[str, list[list[int]]], marks: dict[str, list[float]]) -> tuple[Condition | None, int, int]:
    """The condition of the highest gain and the bad and good rows it leaves; ties go to the order of features and thresholds."""
    some = next(iter(counts.values()))
    bad, good = sum(c[0] for c in some), sum(c[1] for c in some)
    best, top, left = None, 1e-9, (bad, good)
    if not bad:
        return None, bad, good
    for f, bins in counts.items():
        low_bad = low_good = 0
        for threshold, (b, g) in zip(marks[f], bins, strict=False):
            low_bad, low_good = low_bad + b, low_good + g
            for above, p, n in ((True, bad - low_bad, good - low_good), (False, low_bad, low_good)):
                gain = _gain(p, n, bad, good)
                if gain > top:
                    best, top, left = Condition(f, above, threshold), gain, (p, n)
    return best, *left


def covering(rows: DataFrame, precision: float = PRECISION) -> list[Rule]:
    """Rules from rows of counts with ``bad`` (1 or 0) and ``growing`` (whether to grow on the row or prune)."""
    marks = {f: m for f, m in thresholds(rows).items() if m}
    if not marks:
        return []
    for f, m in marks.items():
        rows = rows.withColumn(f"bin_{f}", _bin(f, m))
    rows = materialize(rows, "rule-rows")
    rules: list[Rule] = []
    while True:
        open_rows = rows.filter(verdict(rules))
        rule: Rule = ()
        while True:
            covered = open_rows.filter("growing")
            condition, _, good = best_condition(_counts(covered.filter(holds(rule)) if rule else covered, marks), marks)
            if condition is None or condition in rule:
                break
            rule += (condition,)
            if not good:
                break
        if not rule:
            return rules
        heads = [rule[: k + 1] for k in range(len(rule))]
        bad, good = F.col("bad") == 1, F.col("bad") == 0
        kinds = (bad & ~F.col("growing"), good & ~F.col("growing"), bad, good)
        said = open_rows.agg(*[F.count_if(holds(h) & kind) for h in heads for kind in kinds]).first()
        worth = [(b - g) / (b + g) if b + g else -1.0 for b, g in zip(said[::4], said[1::4], strict=True)]
        k = worth.index(max(worth))
        b, g, all_bad, all_good = said[4 * k : 4 * k + 4]
        if not b or b / (b + g) < precision or (all_bad + 1) / (all_bad + all_good + 2) < precision:
            return rules
        rules.append(heads[k])


def learn(counts: DataFrame, labels: DataFrame, precision: float = PRECISION) -> list[Rule]:
    """The decision list for documents that the base does not fail, from labels 0 and 1 of ids that are not held out.

    ``counts`` is :func:`counted`. Null ids and other labels teach nothing; an id
    labelled twice is two rows. Without rows of both labels there are no rules.
    """
    marked = source(labels, doc_id="doc_id", quality="quality").filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    rows = counts.filter(~F.col("base_failed")).join(marked, "doc_id")
    growing = F.pmod(F.xxhash64("doc_id", F.lit("grow")), F.lit(3)) != 0
    return covering(rows.withColumn("bad", (1 - F.col("quality")).cast("int")).withColumn("growing", growing), precision)


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, list[Rule]]:
    """doc_id, all counts, base_failed and kept of every document, and the rules learned.

    Null and empty texts have no words and fail the base. Every row is judged on its
    own, also where ids or whole rows repeat; null ids stay. Other columns are dropped.
    """
    counts = materialize(counted(source(docs, doc_id=doc_id, text=text)), "rule-counts")
    rules = learn(counts, labels)
    return counts.withColumn("kept", ~F.col("base_failed") & verdict(rules)), rules


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base rules' counts of every document, and whether they and the learned list keep it."""
    judged, _ = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
