from conftest import odd_rows, prose

from tidewatch.llm import decontaminate as d


def found(docs, spark, rows, items, **options):
    bench = spark.createDataFrame(items, "item_id string, text string, spans string")
    return d.find_contamination(docs(rows), bench, **options)


def test_words_fold_ascii_only():
    assert d.words("Ab-ÉÄ x9_İ") == ["ab", "ÉÄ x9", "İ"]
    assert d.words(None) == [] and d.windows("") == [] and d.windows("a b") == [("a", "b")]


def test_blocks_change_nothing(docs, spark):
    items = [(f"i{k}", prose(k, 40), "") for k in range(30)] + [("short", "Only Four words here", ""), (None, prose(99, 20), ""), ("none", "...", ""), ("null", None, "")]
    rows = [(k, f"{prose(500 + k, 30)} {prose(k, 40)[8 * k % 60:]} {prose(600 + k, 30)}") for k in range(30)]
    rows += [(90, "say ONLY four, words HERE now"), (91, prose(99, 20)), *odd_rows()]
    one = found(docs, spark, rows, items).collect()
    many = found(docs, spark, rows, items, block_windows=120).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))
    by = {r["doc_id"]: r["__found"] for r in one}
    assert by[90]["items"] == ["short"] and by[90]["spans"] == [1, 5]
    assert by[91]["items"] == [] and by[91]["spans"] == [0, 20]
    assert all(by[k]["items"] == [f"i{k}"] for k in range(10, 30))
    assert by[2]["n_words"] == 0 and len(one) == len(rows)


def test_a_column_called_like_the_helpers_stays(docs, spark):
    frame = docs([(1, prose(1, 20)), (2, "clean")]).withColumnsRenamed({"uid": "__uid", "key": "__key"})
    bench = spark.createDataFrame([("a", prose(1, 20))], "item_id string, text string")
    for width in (400_000, 6):
        out = d.find_contamination(frame.withColumn("__found", frame["size"]), bench, block_windows=width)
        assert sorted((r["doc_id"], r["__uid"], r["__key"], r["__found"]["items"]) for r in out.collect()) == [(1, "u", "k", ["a"]), (2, "u", "k", [])]


def test_removal(docs, spark):
    passage = prose(1, 20)
    rows = [(1, f"Before, {passage}! After"), (2, f"{prose(2, 800)} {passage}"), (3, "clean"), (4, None)]
    out = found(docs, spark, rows, [("a", passage, "")])
    assert [r["doc_id"] for r in d.remove_documents(out).orderBy("doc_id").collect()] == [2, 3, 4]
    texts = {r["doc_id"]: r["text"] for r in d.remove_spans(out).collect()}
    assert texts[1] == "Before, ! After" and texts[3] == "clean" and texts[4] is None and passage not in texts[2]


def test_empty_tables(docs, spark):
    bench = spark.createDataFrame([], "item_id string, text string")
    out = d.find_contamination(docs(odd_rows()), bench)
    assert out.filter(d.contaminated()).count() == 0 and out.count() == len(odd_rows())
    assert found(docs, spark, [], [("a", "b", "")]).count() == 0


def test_contamination_rule(docs, spark):
    item = prose(7, 13)
    rows = [(n, f"{item} {prose(50, n - 13, 10**9)}".strip()) for n in (13, 260, 261)]
    out = found(docs, spark, rows, [("a", item, "")]).select("doc_id", d.hit_words().alias("n"), d.contaminated().alias("c"))
    assert {r["doc_id"]: (r["n"], r["c"]) for r in out.collect()} == {13: (13, True), 260: (13, True), 261: (13, False)}


def test_blocks_carry_numbers_and_shared_windows_find_all_items(docs, spark):
    template = prose(3, 30)
    items = [(f"i{k:03}", f"{template} {prose(100 + k, 15, 10**9)}", "") for k in range(200)]
    bench = spark.createDataFrame(items, "item_id string, text string, spans string")
    blocks, owners = d.benchmark_blocks(bench, "item_id", "text", 13, 100_000)
    rows = [r for b in blocks for r in b.collect()]
    assert all(isinstance(r["number"], int) and len(r) == 2 for r in rows)
    shared = {r["number"] for r in rows if r["gram"] in template}
    assert len(shared) == 1 and owners.filter(owners["number"] == shared.pop()).count() == 200
    out = d.find_contamination(docs([(1, template), (2, items[7][1]), (2, items[7][1]), (3, "clean")]), bench).collect()
    every = [i for i, _, _ in items]
    assert sorted((r["doc_id"], r["__found"]["items"]) for r in out) == [(1, every), (2, every), (2, every), (3, [])]
