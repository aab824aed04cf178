from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import decontaminate, near_join, packing, quality
from tidewatch.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Input and output of every stage, written and read again."""
    out, docs = [], table(spark, SF, "documents")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def test_all_but_the_last_return_documents(spark, steps):
    columns = table(spark, SF, "documents").dtypes
    assert [after.dtypes == columns for _, after in steps] == [True] * 4 + [False]


def test_classifier_drops_what_it_rejects(spark, steps):
    before, after = steps[0]
    scores = quality.score(before, quality.fit(before, table(spark, SF, "labels")))
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in scores.filter(quality.accepted()).collect()}


def test_lines_are_cut(steps):
    before, after = ({r["doc_id"]: r for r in x.collect()} for x in steps[1])
    assert set(after) <= set(before)
    assert all(not r["text"].strip() or r["n_chars"] == len(r["text"]) for r in after.values())
    assert any(len(after[k]["text"]) < len(before[k]["text"]) for k in after)


def test_one_of_each_group_is_left(spark, steps):
    before, after = steps[2]
    kept = {r["doc_id"] for r in near_join.near_groups(before).filter("kept").collect()}
    assert Counter(r["doc_id"] for r in after.collect()) == Counter(kept)
    again = near_join.near_groups(after)
    assert again.count() == after.count() and 0 < after.count() < before.count()


def test_benchmark_is_gone(spark, steps):
    before, after = steps[3]
    found = decontaminate.find_contamination(after, table(spark, SF, "benchmark"))
    assert found.filter(decontaminate.contaminated()).count() == 0
    clean = decontaminate.find_contamination(before, table(spark, SF, "benchmark")).filter(~decontaminate.contaminated())
    assert clean.count() == after.count()


def test_every_document_left_is_packed(steps):
    before, after = steps[4]
    encoder = packing.Encoder(packing.default_tokenizer())
    want = {r["doc_id"]: len(encoder.encode(r["text"])) // 4 for r in before.collect()}
    got = {r["doc_id"]: r["n"] for r in after.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert got == want
    fill = after.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert fill.agg(F.max("n")).first()[0] <= 2048


def test_run_is_the_stages(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, got.select(columns).collect())) == Counter(map(tuple, steps[4][1].select(columns).collect()))


def test_empty_and_odd_documents(spark, tmp_path):
    rows = [(1, None, None, "s", None, "e"), (None, "", "en", None, 0, "e"), (2, "one line", "en", "s", 8, "e"), (2, "one line", "en", "s", 8, "e")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `__extra` string"
    for k, given in enumerate((rows, [])):
        docs = spark.createDataFrame(given, schema)
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{tmp_path}/{k}-{n}"
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.count() <= len(given)
