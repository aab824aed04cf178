import random
from collections import Counter, defaultdict

import numpy as np
from conftest import odd_rows, prose

from tidewatch.llm import near_join
from tidewatch.llm.decontaminate import words


def sets(rows):
    out = []
    for _, text in rows:
        w = words(text)
        out.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(rows):
    """(links, smallest id reachable) of every row, from all pairs."""
    s = sets(rows)
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(rows[i][0], links[i], rows[find(i)][0], find(i) == i) for i in range(len(rows))]


def near_rows(seed, groups, copies, length=60):
    """Families of texts that differ in a few words, some of them in none."""
    r = random.Random(seed)
    out = []
    for g in range(groups):
        base = prose(1000 * seed + g, length).split()
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(length)] = f"n{r.randrange(50)}"
            out.append(" ".join(w))
    return list(enumerate(out))


def test_equals_brute_force(docs):
    rows = near_rows(1, 30, 6) + [(500 + k, prose(70 + k, k)) for k in range(12)] + [(600 + k, prose(70 + k, k)) for k in range(12)]
    got = near_join.near_groups(docs(rows)).collect()
    assert sorted((r["doc_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == sorted(brute(rows))


def test_large_group_in_many_blocks(docs):
    rows = near_rows(2, 1, 150, length=100)
    got = near_join.near_groups(docs(rows), block=16, prune_block=20).collect()
    assert sorted((r["doc_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == sorted(brute(rows))


def test_pruning_keeps_pairs_at_the_threshold():
    needed = near_join.needed_matches()
    assert [n for n, _ in needed] == list(range(16, 129, 16)) and all(a[1] < b[1] for a, b in zip(needed, needed[1:], strict=False))
    r = np.random.default_rng(3)
    lost = 0
    for _ in range(200):
        common, own = r.integers(0, 1 << 60, 400, dtype=np.uint64), r.integers(0, 1 << 60, (2, 50), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, o])) for o in own)
        sigs = np.stack([near_join.minhash(a), near_join.minhash(b)])
        lost += not len(near_join.living(sigs, np.array([0]), np.array([1]), needed)[0])
    assert lost == 0


def test_exact_counts_the_threshold_itself():
    a, b = np.arange(90, dtype=np.uint64), np.arange(10, 100, dtype=np.uint64)  # 80 of 100
    c = np.arange(11, 101, dtype=np.uint64)
    left, right = near_join.exact([a, b, c], np.array([0, 0]), np.array([1, 2]), 0.8)
    assert left.tolist() == [0] and right.tolist() == [1]


def test_odd_rows(docs):
    rows = odd_rows()
    got = near_join.near_groups(docs(rows)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert sorted(r["kept"] for r in by[1]) == [False, True] and {r["n_links"] for r in by[1]} == {1}
    assert by[4][0]["kept"] and by[5][0]["component_id"] == 4 and not by[5][0]["kept"]
    assert all(r["n_links"] == 0 and r["kept"] for i in (2, 3, 7) for r in by[i])
    assert near_join.near_groups(docs([])).count() == 0


def test_one_of_each_group_stays(docs):
    rows = odd_rows() + [(*r, 0, "s", "k", "u") for r in [(10, prose(5, 40)), (11, prose(5, 40) + " more"), (12, prose(6, 40))]]
    out = near_join.keep_one(docs(rows))
    kept = Counter(r["doc_id"] for r in out.collect())
    assert out.columns == docs(rows).columns
    assert kept == Counter({1: 1, 2: 1, 3: 1, None: 2, 4: 1, 6: 1, 7: 1, 10: 1, 12: 1})
