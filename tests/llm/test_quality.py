import random
import zlib

import numpy as np
from conftest import odd_rows, prose
from pyspark.sql import functions as F

from tidewatch.llm import quality
from tidewatch.llm.common import table

SF = "/root/testdata/sf0.01"


def test_scorer_equals_the_features():
    r = np.random.default_rng(1)
    values = r.standard_normal(1 << quality.BITS)
    scorer = quality.Scorer(values)
    for text in ("The cat sat. The cat sat.", "a", "é" * 50, "x x x x y x", prose(3, 500), "z" * 70_000):
        b, w = quality.text_features(text)
        assert abs(scorer.means([text])[0] - values[b] @ w) < 1e-5
        assert len(set(b.tolist())) == len(b) and abs(w.sum() - 1) < 1e-5
    assert scorer.means([None, ""]).tolist() == [0, 0]


def test_training_equals_a_plain_loop(monkeypatch):
    """Averaged vectors, softmax and gradient steps number by number, without numpy."""
    import math

    monkeypatch.setattr(quality, "BITS", 5)
    monkeypatch.setattr(quality, "EPOCHS", 3)
    r = random.Random(5)
    labels = [r.randrange(2) for _ in range(40)]
    buckets = [sorted(r.sample(range(32), r.choice([0, 3, 9]))) for _ in labels]
    weights = [[1 / max(len(b), 1)] * len(b) for b in buckets]
    got, bias_got = quality.train([np.array(b, np.int32) for b in buckets], [np.array(w, np.float32) for w in weights], np.array(labels))

    rng, dims = np.random.default_rng(7), quality.DIMENSIONS
    vectors = rng.uniform(-1 / dims, 1 / dims, (32, dims)).tolist()
    out, bias, order = [[0.0, 0.0] for _ in range(dims)], [0.0, 0.0], np.arange(len(labels))
    for epoch in range(3):
        rng.shuffle(order)
        for done, i in enumerate(order.tolist()):
            rate = quality.RATE * (1 - (epoch + done / len(order)) / 3)
            hidden = [sum(w * vectors[b][d] for b, w in zip(buckets[i], weights[i], strict=True)) for d in range(dims)]
            e = [math.exp(sum(h * out[d][c] for d, h in enumerate(hidden)) + bias[c]) for c in (0, 1)]
            error = [e[c] / sum(e) - (labels[i] == c) for c in (0, 1)]
            back = [sum(out[d][c] * error[c] for c in (0, 1)) for d in range(dims)]
            for d in range(dims):
                for c in (0, 1):
                    out[d][c] -= rate * hidden[d] * error[c]
            bias = [bias[c] - 0.1 * rate * error[c] for c in (0, 1)]
            for b, w in zip(buckets[i], weights[i], strict=True):
                # a text's step is shared by its features, so it is scaled up by their number
                vectors[b] = [v - rate * len(buckets[i]) * w * g for v, g in zip(vectors[b], back, strict=True)]
    want = [sum(v * (o[1] - o[0]) for v, o in zip(row, out, strict=True)) for row in vectors]
    assert np.allclose(got, want, atol=1e-4) and abs(bias_got - (bias[1] - bias[0])) < 1e-4


def test_held_out_is_the_crc_rule(spark):
    got = spark.range(500).select("id", quality.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)


def test_held_out_accuracy(spark):
    scored = quality.op6_quality(spark, SF)
    marked = scored.join(table(spark, SF, "labels"), "doc_id").filter("held_out").collect()
    assert all((r["score"] >= 0.7) == bool(r["predicted"]) and 0 <= r["score"] <= 1 for r in marked)
    right = sum(r["predicted"] == r["quality"] for r in marked)
    assert right >= 0.95 * len(marked)
    assert scored.count() == table(spark, SF, "documents").count()


def test_held_out_labels_are_not_read(spark, docs):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["good", "fine"] if i % 2 else ["bad###", "poor***"]) for _ in range(20))) for i in range(200)]
    labels = [(i, i % 2, "x") for i in range(200)]
    flipped = [(i, q if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - q, "x") for i, q, _ in labels]
    schema = "doc_id long, quality int, text string"
    one = quality.fit(docs(rows), spark.createDataFrame(labels, schema))
    two = quality.fit(docs(rows), spark.createDataFrame(flipped, schema))
    assert np.array_equal(one[0], two[0]) and one[1] == two[1]


def test_odd_rows(spark, docs):
    schema = "doc_id long, quality int"
    labels = [(1, 1), (2, 0), (4, 1), (None, 1), (6, None), (3, 0), (77, 1), (5, 7)]
    for marked in (labels, [], [(1, 1)]):
        scored = quality.score(docs(odd_rows()), quality.fit(docs(odd_rows()), spark.createDataFrame(marked, schema)))
        got = scored.collect()
        assert len(got) == len(odd_rows()) and all(0 <= r["__score"] <= 1 for r in got)
        assert len({r["__score"] for r in got if not (r["text"] or "").split()}) == 1
    model = quality.fit(docs([]), spark.createDataFrame([], schema))
    assert quality.score(docs([]), model).count() == 0
