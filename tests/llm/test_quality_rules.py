import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewatch.llm.common import table
from tidewatch.llm.quality import held_out
from tidewatch.llm.quality_rules import Condition, counted, covering, judge, op13_quality_rules, verdict

from conftest import odd_rows  # isort: skip

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    failed = n < 50 or 100 * len(inside) > 50 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), failed


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def in_order(rows):
    return sorted(rows, key=repr)


def test_counts_of_odd_texts(docs):
    r = random.Random(2)
    texts = [" ".join(r.choice("abc") for _ in range(r.randrange(1, 120))) for _ in range(60)]
    texts += ["a b a b a b a", "a a a", "a a a a", "a b c", "a b c a b c", "x\x1cy\xa0z \x0b\x0c w", "#*$ %&|<> 𝒳𝒴\n\n#\n#\n \n \n", "a\r\na\r\na", "é é é é"]
    texts += ["\n".join(r.choice(["one line", "two", " ", "", "one line "]) for _ in range(30)) for _ in range(20)]
    rows = [(k, t) for k, t in enumerate(texts)] + [t[:2] for t in odd_rows()]
    found = counted(docs(rows)).select("doc_id", *COLUMNS).collect()
    assert in_order(tuple(x) for x in found) == in_order((i, *plain_counts(t)) for i, t in rows)


def test_long_texts_take_time_in_proportion(docs):
    def took(n):
        r = random.Random(n)
        text = " ".join(f"w{r.randrange(60)}" for _ in range(n))
        start = time.time()
        assert tuple(counted(docs([(1, text)])).select(*COLUMNS).first()) == plain_counts(text)
        return time.time() - start

    took(1000)
    assert took(160_000) < 8 * took(40_000) + 2


def labelled(spark, rows):
    schema = "word_chars long, n_words long, n_symbols long, n_repeat_words long, n_dup_lines long, n_lines long, n_distinct_words long, n_capitals long, n_digits long, n_marks long, bad int, growing boolean"
    return spark.createDataFrame(rows, schema)


def test_finds_a_conjunction_and_an_alternative(spark):
    """Bad: many symbols and short words together, or many digits. Either of the first two alone is good."""
    r = random.Random(7)
    rows = []
    for k in range(3000):
        symbols, short, digits = r.random() < 0.4, r.random() < 0.4, r.random() < 0.15
        n = 200
        chars = n * (3 if short else 7) + r.randrange(20)
        bad = int(symbols and short or digits)
        rows.append((chars, n, chars // 5 if symbols else r.randrange(3), 0, 0, 10, 100, 20, chars // 4 if digits else r.randrange(9), 5, bad, k % 3 > 0))
    rules = covering(labelled(spark, rows))
    assert {frozenset((c.feature, c.above) for c in rule) for rule in rules} == {frozenset({("digits", True)}), frozenset({("symbols", True), ("mean_word", False)})}
    wrong = labelled(spark, rows).filter(verdict(rules) == (F.col("bad") == 1)).count()
    assert wrong == 0


def test_chance_makes_no_rules(spark):
    r = random.Random(8)
    rows = [(r.randrange(900, 1100), 200, r.randrange(50), 0, 0, 10, r.randrange(50, 100), 20, r.randrange(50), 5, int(r.random() < 0.2), k % 3 > 0) for k in range(2000)]
    assert covering(labelled(spark, rows)) == []
    for one in (0, 1):
        assert covering(labelled(spark, [(*x[:-2], one, x[-1]) for x in rows])) == []
    assert covering(labelled(spark, [])) == []


def test_the_first_rule_that_holds_decides(spark):
    rows = labelled(spark, [(100, 20, s, 0, 0, 10, 5, 2, d, 5, 0, True) for s in (0, 50) for d in (0, 50)])
    rules = [(Condition("symbols", True, 0.1), Condition("digits", False, 0.1)), (Condition("digits", True, 0.4),)]
    found = {(r.n_symbols, r.n_digits): r.kept for r in rows.withColumn("kept", verdict(rules)).collect()}
    assert found == {(0, 0): True, (50, 0): False, (0, 50): False, (50, 50): False}
    assert str(rules[0][0]) == "symbols > 0.1"


def test_odd_rows_and_empty_tables(spark, docs):
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (None, 1, 0), (4, None, 0), (5, 7, 1)], "doc_id long, quality int, toxic int")
    judged, rules = judge(docs(odd_rows()), labels)
    assert rules == [] and judged.count() == len(odd_rows())
    assert {r.doc_id for r in judged.filter("kept").collect()} == {4, 5}
    assert judge(docs([]), labels.limit(0))[0].collect() == []


def test_held_out_labels(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    judged, rules = judge(docs, labels)
    seen = judged.filter(~F.col("base_failed")).join(labels, "doc_id").filter(held_out(F.col("doc_id")))
    counts = {(r.quality, r.kept): r["count"] for r in seen.groupBy("quality", "kept").count().collect()}
    total = sum(counts.values())
    right = counts.get((1, True), 0) + counts.get((0, False), 0)
    print([" and ".join(map(str, r)) for r in rules], counts)
    assert rules and right / total >= 0.95 and counts.get((1, False), 0) <= 0.01 * total


def test_query_counts(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    rows = op13_quality_rules(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in COLUMNS) == plain_counts(texts[r.doc_id])
        assert not (r.kept and r.base_failed)


@pytest.mark.parametrize("part", ["Python", "Arrow", "Pandas"])
def test_no_python_workers(spark, part):
    plan = op13_quality_rules(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert part not in plan and part not in counted(table(spark, SF, "documents"))._jdf.queryExecution().executedPlan().toString()
