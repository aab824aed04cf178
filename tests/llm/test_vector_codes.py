import math
import random

import numpy as np
import pytest
from oracle import duck, spark_rows
from pyspark.sql import types as T

from tidewatch.llm import vector_codes as vc
from tidewatch.llm.vector_codes import OP11_SQL, CoverTree, compress, op11_vector_codes, spans

SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
        T.StructField("code", T.StringType()),
        T.StructField("v", T.StringType()),
        T.StructField("trees", T.StringType()),
    ]
)


@pytest.fixture
def vectors(spark):
    return lambda rows: spark.createDataFrame([(*r, "c", "v", "t") for r in rows], SCHEMA)


def plain_lloyd(rows, rounds=vc.ROUNDS):
    """Codes, errors and codebooks as the rule says them, one part and one entry at a time."""
    good = [(i, [math.floor(4096 * float(np.float32(x))) for x in e]) for i, e, _ in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    if not good:
        return [], []
    width = -(-max(len(e) for _, e in good) // 8) or 1
    good = sorted(((i is None, i if i is not None else 0, e + [0] * (8 * width - len(e))) for i, e in good))
    books, codes = [], [[] for _ in good]
    errors = [0] * len(good)
    for p in range(8):
        subs = [e[p * width : (p + 1) * width] for *_, e in good]
        book = [list(s) for s in subs[:16]]
        for r in range(rounds + 1):
            near = [min(range(len(book)), key=lambda k: (sum((a - b) ** 2 for a, b in zip(s, book[k], strict=True)), k)) for s in subs]
            if r < rounds:
                for k in range(len(book)):
                    own = [s for s, n in zip(subs, near, strict=True) if n == k]
                    if own:
                        book[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
        for j, (s, n) in enumerate(zip(subs, near, strict=True)):
            codes[j].append(f"{n:02x}")
            errors[j] += sum((a - b) ** 2 for a, b in zip(s, book[n], strict=True))
        books.append(book)
    return in_order((None if none else i, "".join(c), e) for (none, i, _), c, e in zip(good, codes, errors, strict=True)), books


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


def random_rows(seed, n, dim=16, spread=5):
    r = random.Random(seed)
    middles = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(spread)]
    return [(k, [m + r.gauss(0, 0.2) for m in r.choice(middles)], r.choice([None, 0, 1])) for k in range(n)]


@pytest.mark.parametrize(("n", "dim", "chunk"), [(5, 8, 4), (200, 16, 64), (300, 24, 4000)])
def test_equals_plain_lloyd(vectors, monkeypatch, n, dim, chunk):
    monkeypatch.setattr(vc, "CHUNK", chunk)
    rows = random_rows(n, n, dim)
    codes, books = compress(vectors(rows))
    expected, plain = plain_lloyd(rows)
    assert in_order((r.vec_id, r.code, r.error) for r in codes.collect()) == expected
    assert books.tolist() == plain


def test_a_vector_that_most_rows_share_and_ties(vectors):
    grid = [(k, [float(x) for x in np.unravel_index(k % 27, (3, 3, 3))] * 3, 0) for k in range(120)]
    rows = grid + [(1000 + k, [0.25] * 9, 1) for k in range(300)]
    codes, books = compress(vectors(rows))
    expected, plain = plain_lloyd(rows)
    assert in_order((r.vec_id, r.code, r.error) for r in codes.collect()) == expected
    assert books.tolist() == plain


def test_odd_vectors(vectors):
    """No code: null, null or non-finite components, too large ones. Empty ones are zeros, short ones filled up."""
    none = [(1, None, 0), (2, [None, 1.0], 0), (3, [math.nan, 1.0], 1), (4, [math.inf] * 2, 1), (5, [-math.inf], None)]
    rows = [(6, [], 0), (7, [1.0] * 8, None), (7, [1.0] * 8, None), (7, [0.5] * 8, None), (None, [-0.1] * 9, 2), (9, [2.0], 2)]
    codes, books = compress(vectors(none + rows + [(10, [1e30] * 8, 0)]))
    expected, plain = plain_lloyd(rows)
    assert in_order((r.vec_id, r.code, r.error) for r in codes.collect()) == expected
    assert books.tolist() == plain and books.shape == (8, 6, 2)


def test_empty_tables(vectors):
    for rows in ([], [(1, None, 0)]):
        codes, books = compress(vectors(rows))
        assert codes.collect() == [] and books.shape == (8, 0, 1)


def test_tree_covers_separates_and_sums():
    rng = np.random.default_rng(3)
    points = np.unique(rng.integers(-500, 500, (700, 4)), axis=0)
    weights = rng.integers(1, 9, len(points))
    tree = CoverTree(points, weights)
    assert sorted(tree.order.tolist()) == list(range(len(points))) and (tree.points == points[tree.order]).all()
    for node in range(len(tree.lo)):
        lo, hi, centre = tree.lo[node], tree.hi[node], tree.points[tree.place[node]]
        assert lo <= tree.place[node] < hi
        far = np.sqrt(((tree.points[lo:hi] - centre) ** 2).sum(axis=1)).max()
        assert far <= tree.radius[node] and tree.radius[node] <= far * (1 + 1e-9)
        own = tree.order[lo:hi]
        assert (tree.sums[hi] - tree.sums[lo] == (points[own] * weights[own][:, None]).sum(axis=0)).all()
        assert tree.counts[hi] - tree.counts[lo] == weights[own].sum()
        kids = range(tree.first[node], tree.first[node] + tree.kids[node])
        if tree.kids[node]:
            middles = tree.points[tree.place[list(kids)]]
            apart = np.sqrt(((middles[:, None] - middles) ** 2).sum(axis=2)) + np.eye(len(kids)) * 1e9
            assert apart.min() > tree.radius[node] / vc.SHRINK * (1 - 1e-9)
            assert max(tree.radius[k] for k in kids) <= tree.radius[node] / vc.SHRINK * (1 + 1e-9)
            assert [lo, *(tree.hi[k] for k in kids)] == [*(tree.lo[k] for k in kids), hi]


def test_whole_subtrees_are_assigned():
    """Far clusters need no comparison of their points: fewer ranges than points, and the right entries."""
    rng = np.random.default_rng(4)
    points = np.unique(np.concatenate([rng.integers(0, 40, (400, 4)) + 10_000 * k for k in range(4)]), axis=0)
    tree = CoverTree(points, np.ones(len(points), np.int64))
    book = np.array([[10_000 * k + 20] * 4 for k in range(4)])
    lo, hi, entry = tree.assign(book)
    at, which = spans(lo, hi)
    assert sorted(at.tolist()) == list(range(len(points)))
    assert (entry[which] == tree.points[at][:, 0] // 10_000).all()
    assert len(lo) <= 8


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert spark_rows(op11_vector_codes(spark, sf)) == duck(sf, OP11_SQL)
