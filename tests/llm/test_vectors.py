import math
from collections import Counter

import numpy as np
import pytest

from tidewatch.llm import vectors
from tidewatch.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int, key string, copies int"


def near(spark, rows, schema=SCHEMA):
    return vectors.near_vectors(spark.createDataFrame([(*r, "k", 1) for r in rows], schema)).collect()


def brute(rows, threshold=0.93):
    v = np.array([r[1] for r in rows], np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    hit = (v @ v.T >= threshold) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows])[None])
    np.fill_diagonal(hit, False)
    root = np.arange(len(rows))
    while True:
        new = np.where(hit, root[None], len(rows)).min(axis=1)
        new = np.minimum(root, new)
        if (new == root).all():
            return hit, root
        root = new


def test_decode_finds_the_nearest_point():
    r = np.random.default_rng(0)
    x = r.standard_normal((1000, 8)) * 2
    point, ways = vectors.decode(x) / 2, vectors.shortest() / 2
    own = ((x - point) ** 2).sum(axis=1)
    assert len({tuple(w) for w in ways}) == 240 and np.allclose((ways**2).sum(axis=1), 2)
    assert (((x[:, None] - point[:, None] - ways) ** 2).sum(axis=2).min(axis=1) >= own - 1e-9).all() and own.max() <= 1 + 1e-9
    whole = np.all(point == np.rint(point), axis=1) | np.all(point - 0.5 == np.rint(point - 0.5), axis=1)
    assert whole.all() and (point.sum(axis=1) % 2 == 0).all()


def test_recall_against_all_pairs(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal((60, 64))
    rows = []
    for k in range(900):
        v = base[k % 60] / np.linalg.norm(base[k % 60]) + r.standard_normal(64) * r.choice([0.005, 0.02, 0.03]) 
        rows.append((k, v.astype(np.float32).tolist(), k % 3))
    hit, root = brute(rows)
    got = {x["vec_id"]: x for x in near(spark, rows)}
    found, total = sum(x["n_links"] for x in got.values()), int(hit.sum())
    assert total > 5000 and 0.99 * total <= found <= total
    assert all(got[k]["n_links"] <= hit[k].sum() for k in got)
    assert sum(got[k]["component_id"] == rows[root[k]][0] for k in got) >= 0.99 * len(rows)


@pytest.mark.parametrize("dim", [8, 16, 256, 768])
def test_pairs_just_above_the_threshold_in_any_dimension(spark, dim):
    """Pairs at cosine 0.935, far from all others."""
    r = np.random.default_rng(dim)
    rows = []
    for k in range(150):
        a, b = np.linalg.qr(r.standard_normal((dim, 2)))[0].T
        rows += [(2 * k, (3 * a).tolist(), k), (2 * k + 1, (0.935 * a + math.sqrt(1 - 0.935**2) * b).tolist(), k)]
    got = near(spark, rows)
    assert sum(x["n_links"] for x in got) >= 0.95 * len(rows) and all(x["n_links"] <= 1 for x in got)


def test_a_dense_group_in_blocks(spark):
    r = np.random.default_rng(2)
    rows = [(k, (np.ones(16) + 0.01 * r.standard_normal(16)).tolist(), 1) for k in range(300)] + [(900 + k, [1.0] * 16, 1) for k in range(50)]
    got = near(spark, rows)
    assert {x["n_links"] for x in got} == {349} and {x["component_id"] for x in got} == {0} and sum(x["kept"] for x in got) == 1


def test_odd_rows(spark):
    one = [1.0, 0.0, 0.0]
    rows = [(1, one, 1), (2, one, 2), (3, one, None), (4, None, 1), (5, [], 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 0.0], 1), (8, [math.nan, 1.0, 0.0], 1)]
    rows += [(9, [math.inf, 0.0, 0.0], 1), (10, [1.0, 0.0], 1), (11, [5.0, 0.0, 0.0], 1), (12, one, 1), (12, one, 1), (None, one, 1), (13, [1e-30, 0.0, 0.0], 1)]
    got = near(spark, rows)
    assert len(got) == len(rows)
    links = Counter((x["vec_id"], x["n_links"], x["component_id"], x["kept"]) for x in got)
    alone = {2, 3, 4, 5, 6, 7, 8, 9, 10}
    assert links == Counter({(k, 0, k, True): 1 for k in alone} | {(1, 5, 1, True): 1, (11, 5, 1, False): 1, (12, 5, 1, False): 2, (None, 5, 1, False): 1, (13, 5, 1, False): 1})
    assert near(spark, []) == []


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    assert vectors.op10_near_vectors(spark, sf).count() == table(spark, sf, "embeddings").count()
