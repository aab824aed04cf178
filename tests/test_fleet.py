"""Vector search, models, dispatch and paths."""

import datetime as dt
import random
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidewatch.operators import dispatch, models, nearest, paths, vector
from tidewatch.plans import surge

cloudpickle.register_pickle_by_value(sys.modules[__name__])

T0 = dt.datetime(2026, 5, 29, 8, 0)


# -- vectors -----------------------------------------------------------------


def vectors(spark, n, dim, key, seed, hot=False):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim))
    if hot:
        m[: n // 2] = m[0]  # half of the rows are copies
    m[-1] = 0
    data = [(f"{i:04d}", [float(x) for x in v], "ab"[i % 2]) for i, v in enumerate(m)]
    return m, spark.createDataFrame(data, f"{key} string, embedding array<float>, zone string")


def brute(q, d, k, same=None):
    qn, dn = np.float32(q).astype(float), np.float32(d).astype(float)
    qn, dn = [x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, n) for x in (qn, dn)]
    s = np.round(qn @ dn.T, vector.DIGITS)
    out = {}
    for i in range(len(q)):
        if not q[i].any():
            continue
        ids = [j for j in range(len(d)) if d[j].any() and (same is None or same(i, j))]
        best = sorted(ids, key=lambda j: (-s[i, j], j))[:k]
        out[f"{i:04d}"] = [f"{j:04d}" for j in best]
    return out


def ranked(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.document_id)
    return out


@pytest.mark.parametrize("block,hot", [(2048, False), (7, False), (16, True)])
def test_search_equals_brute_force(spark, block, hot):
    q, queries = vectors(spark, 23, 8, "query_id", 1)
    d, kb = vectors(spark, 60, 8, "document_id", 2, hot)
    assert ranked(vector.search(queries, kb, 3, block_rows=block)) == brute(q, d, 3)


def test_filtered_search(spark):
    q, queries = vectors(spark, 11, 4, "query_id", 3)
    d, kb = vectors(spark, 30, 4, "document_id", 4)
    got = ranked(vector.search(queries, kb, 4, match=["zone"], block_rows=8))
    assert got == brute(q, d, 4, same=lambda i, j: i % 2 == j % 2)


def test_fewer_documents_than_k(spark):
    _, queries = vectors(spark, 3, 4, "query_id", 5)
    _, kb = vectors(spark, 3, 4, "document_id", 6)
    assert {len(v) for v in ranked(vector.search(queries, kb, 5)).values()} == {2}


def test_cells_are_exact_and_candidates_recall(spark):
    q, queries = vectors(spark, 40, 6, "query_id", 7)
    d, kb = vectors(spark, 200, 6, "document_id", 8, hot=True)
    cells = vector.Cells(kb, nlist=6)
    want = brute(q, d, 3)
    assert ranked(vector.search_cells(queries, cells, 3, candidates=10, block_rows=16)) == want
    near = ranked(vector.search_cells(queries, cells, 3, candidates=60, exact=False))
    hits = sum(len(set(near[k]) & set(want[k])) for k in want)
    assert hits / sum(map(len, want.values())) > 0.5


@pytest.mark.parametrize("step", ["probes", "remaining"])
def test_cells_of_a_batch_take_little_memory(monkeypatch, step):
    """Not rows times centres times dimensions at once."""
    import tracemalloc

    class Rows:
        def __getattr__(self, name):
            return lambda *a, **b: self

    made = []
    monkeypatch.setattr(vector.F, "pandas_udf", lambda kind: lambda f: made.append(f) or (lambda *columns: None))
    rng = np.random.default_rng(4)
    cells = vector.Cells.__new__(vector.Cells)
    cells.centres, cells.sizes, cells.radii = rng.normal(size=(300, 32)), np.full(300, 5.0), np.full(300, 0.1)
    cells.probes(Rows(), 20) if step == "probes" else cells.remaining(Rows(), [list(range(150)), list(range(150, 300))])
    n = 4_000
    more = [] if step == "probes" else [pd.Series([[0, 1]] * n), pd.Series([0.5] * n)]
    tracemalloc.start()
    out = made[0](pd.Series(list(rng.normal(size=(n, 32)))), *more)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == n and peak < 100_000_000


def test_open_cells_share_what_is_sent(spark, monkeypatch):
    """Vectors without clusters leave nearly every cell open; a query isn't sent once for each."""
    from pyspark.sql.group import GroupedData

    sent, cogroup = [], GroupedData.cogroup
    monkeypatch.setattr(GroupedData, "cogroup", lambda self, other: sent.append((self._df.count(), other._df.count())) or cogroup(self, other))
    q, queries = vectors(spark, 60, 16, "query_id", 9)
    d, kb = vectors(spark, 300, 16, "document_id", 10)
    assert ranked(vector.search_cells(queries, vector.Cells(kb, nlist=17), 3)) == brute(q, d, 3)
    assert max(n for n, _ in sent) <= 2 * 60 and max(n for _, n in sent) <= 300


@pytest.mark.parametrize("values,block,clusters", [(2**22, 8, 5), (6 * 20, 3, 5), (6 * 20, 16, 0)])
def test_cells_in_bins_are_exact(spark, monkeypatch, values, block, clusters):
    """Bins of few cells, cells in several bins, cells that the bound closes, equal scores and null ids."""
    monkeypatch.setattr(vector, "BLOCK_VALUES", values)
    rng = np.random.default_rng(11)
    m = rng.normal(size=(150, 6))
    if clusters:
        m = np.repeat(rng.normal(size=(clusters, 6)), 30, axis=0) + 0.02 * m
    m[100:140] = m[100]
    vecs = [[float(x) for x in v] for v in m]
    kb = spark.createDataFrame([(f"{i:04d}", v) for i, v in enumerate(vecs)], "document_id string, embedding array<float>")
    queries = spark.createDataFrame([(f"{i:04d}", v) for i, v in enumerate(vecs[::3])] + [(None, vecs[0]), ("none", None)], "query_id string, embedding array<float>")
    got = {}
    for r in vector.search_cells(queries, vector.Cells(kb, nlist=12), 4, candidates=2, block_rows=block).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.document_id
    want = brute(m[::3].astype(np.float32), m.astype(np.float32), 4)
    assert {k: [v[n] for n in sorted(v)] for k, v in got.items()} == want | {None: want["0000"]}


def test_cell_places_cover_every_row(spark):
    cells = vector.Cells.__new__(vector.Cells)
    data = [(f"{i}", [float(i % 7)], 2 if i < 50 else i % 5) for i in range(100)]
    cells.items = spark.createDataFrame(data, "item_id string, vec array<float>, cell int")
    cells.sizes = np.array([sum(c == x for *_, c in data) for x in range(6)])
    bins = cells.bins(20)
    got = {r.item_id: bins[r.bin][r.place] for r in cells.binned(bins).collect()}
    assert got == {i: c for i, _, c in data}
    assert sum(b.count(2) for b in bins) == 3 and not any(5 in b for b in bins)


def test_nearest_point(spark):
    rng = random.Random(2)
    pts = [(i, rng.random(), rng.random()) for i in range(50)]
    way = [(i, rng.random(), rng.random()) for i in range(20)] + [(20, 0.5, 0.5), (21, 0.5, 0.5)]
    got = nearest.nearest_point(
        spark.createDataFrame(pts + [(99, 0.5, 0.5)], "zone long, lon double, lat double"), spark.createDataFrame(way, "idx long, lon double, lat double")
    ).collect()
    assert len(got) == 51
    for r in got:
        x, y = next(((a, b) for z, a, b in pts if z == r.zone), (0.5, 0.5))
        assert r.idx == min(way, key=lambda w: ((w[1] - x) ** 2 + (w[2] - y) ** 2, w[0]))[0]


def test_chunks_cover_every_word(spark):
    sizes = [0, 1, 255, 256, 257, 480, 481, 1000]
    df = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n))) for n in sizes], "document_id int, text string")
    got = {}
    for r in vector.chunks(df).orderBy("document_id", "chunk_index").collect():
        got.setdefault(r.document_id, []).append(r.chunk.split(" "))
    assert set(got) == set(sizes) - {0}
    for n, parts in got.items():
        assert all(len(p) <= 256 for p in parts) and all(len(p) == 256 for p in parts[:-1])
        assert all(a[-32:] == b[:32] for a, b in zip(parts, parts[1:]) if len(b) >= 32)
        seen = parts[0] + [w for p in parts[1:] for w in p[32:]]
        assert seen == [f"w{i}" for i in range(n)]


# -- models ---------------------------------------------------------------------


class Counting(models.HashEmbedder):
    def embed(self, texts, kind="document"):
        assert len(set(texts)) == len(texts) and kind == "query"
        return super().embed(texts, kind)


def test_equal_texts_share_one_vector(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, None)], "id int, t string")
    got = {r.id: r.embedding for r in models.embed(df, "t", Counting(), "query").collect()}
    assert got[1] == got[2] != got[3] and got[4] is None and len(got[1]) == 64


class Broken(models.HashEmbedder):
    def __init__(self, how):
        super().__init__()
        self.how = how

    def embed(self, texts, kind="document"):
        if self.how == "raise":
            raise OSError("no route")
        return super().embed(texts, kind)[1:] if self.how == "short" else [[] for _ in texts]


@pytest.mark.parametrize("how,message", [("short", "vectors for"), ("empty", "empty vector"), ("raise", "no route")])
def test_bad_replies_fail_loud_or_mark_the_row(spark, how, message):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string").coalesce(1)
    with pytest.raises(Exception, match=message):
        models.embed(df, "t", Broken(how)).collect()
    marked = models.embed(df, "t", Broken(how), on_error="row").collect()
    assert all(r.embedding is None and message in r.embedding_error for r in marked)


def test_generate_sends_equal_prompts_once(spark):
    class Shout:
        def write(self, prompts, max_tokens):
            assert len(set(prompts)) == len(prompts) and max_tokens == 500
            return [p.upper() for p in prompts]

    df = spark.createDataFrame([("a",), ("a",), (None,)], "p string")
    assert sorted((r.response or "") for r in models.generate(df, "p", Shout()).collect()) == ["", "A", "A"]


def test_explanation_prefers_high_impact_in_rank_order(spark):
    df = spark.sql("""select 'Surge. ' as anomaly_reason, array(
        struct('Jazz' as event_name, 'concert' as event_type, 'low' as impact_level),
        struct('Parade' as event_name, cast(null as string) as event_type, 'HIGH' as impact_level),
        struct('Race' as event_name, 'sport' as event_type, 'high' as impact_level)) as search_results""")
    df = df.unionByName(df.select(F.lit("None").alias("anomaly_reason"), F.slice("search_results", 1, 0).alias("search_results")))
    got = {r.anomaly_reason for r in models.explain(df).collect()}
    assert got == {"Surge. Likely cause: Parade (event, HIGH impact).", "None"}


def test_knowledge_base_build_and_refresh(spark):
    rows = [("Fest", "Marigny", "music in the street", "high"), ("Tour", "Uptown", "garden walk", "low"), (None, "Uptown", "x", "low")]
    cal = spark.createDataFrame(
        [(*r, T0, T0, "v", 5, "music") for r in rows],
        "event_name string, zone string, description string, impact_level string, event_time_start timestamp, event_time_end timestamp, venue string, expected_attendance int, event_type string",
    )
    good, dead = surge.knowledge_rows(cal, F.lit(T0))
    assert good.columns == surge.KB_COLUMNS
    assert sorted(r.document_id for r in good.collect()) == ["fest-marigny", "tour-uptown"]
    assert [r.reason for r in dead.collect()] == ["missing:event_name"]
    later = cal.withColumn("description", F.when(F.col("event_name") == "Fest", "new text").otherwise(F.col("description")))
    again = surge.refreshed_knowledge_base(good, later, F.lit(T0 + dt.timedelta(days=1)))
    assert {r.document_id: r.embedded_at for r in again.collect()} == {"fest-marigny": T0 + dt.timedelta(days=1), "tour-uptown": T0}


class FirstSentence:
    def write(self, prompts, max_tokens):
        return ["Likely related: " + p.split("<<DOC 1 START>>\n", 1)[1].split("\n", 2)[2].split(". ", 1)[0] for p in prompts]


class Opening:
    """Repeats the first words, refuses prompts that begin with T."""

    def write(self, prompts, max_tokens):
        if any(p.startswith("T") for p in prompts):
            raise ValueError("refused")
        return [" ".join(p.split(" ")[: min(max_tokens, 3)]) for p in prompts]


def test_generate_by_a_writer_or_a_column(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "The end"), (3, None), (4, "a b c d")], "n int, p string")
    got = {r.n: (r.response, r.response_error) for r in models.generate(df, "p", Opening(), on_error="row", retries=1, timeout=60).collect()}
    assert got == {1: ("a b c", None), 2: (None, "ValueError: refused"), 3: (None, None), 4: ("a b c", None)}
    by_column = models.generate(df, "p", lambda p: F.substring_index(p, " ", 2), on_error="row")
    assert {r.n: (r.response, r.response_error) for r in by_column.collect()} == {1: ("a b", None), 2: ("The end", None), 3: (None, None), 4: ("a b", None)}


def test_pieces_of_a_block_give_the_same_hits(monkeypatch):
    monkeypatch.setattr(vector, "QUERY_ROWS", 7)
    monkeypatch.setattr(vector, "ITEM_ROWS", 40)
    r = np.random.default_rng(5)
    items = r.normal(size=(300, 16)) + 0.3
    items[50:140] = items[3]  # a large group of copies
    items[200:210] = items[17] + 1e-12  # ties once rounded
    queries = np.concatenate([items[::9], r.normal(size=(20, 16))])
    for odd in (False, True):
        if odd:
            items[[44, 250]] = np.nan
        for metric in ("cosine", "euclidean"):
            a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) if metric == "cosine" else x for x in (queries, items))
            s = np.round(a @ b.T, vector.DIGITS) if metric == "cosine" else -np.square(a[:, None] - b[None]).sum(axis=2)
            key = np.where(np.isnan(s), np.inf, s)
            for k in (1, 5, 60):
                row, col, score = vector._best_of_blocks(a, b, k, metric)
                assert (np.bincount(row) == k).all()
                want = np.argsort(-key, axis=1, kind="stable")[:, :k]
                assert (np.round(score.reshape(-1, k), 8) == np.round(np.take_along_axis(s, want, 1), 8))[~np.isnan(score.reshape(-1, k))].all()
                if metric == "cosine":
                    assert (col.reshape(-1, k) == want).all()


def test_blocks_stay_few_while_tables_grow(spark):
    sizes = [(2_000, 2_000, 64), (100_000, 100_000, 64), (600_000, 600_000, 64), (600_000, 600_000, 1_024), (1, 600_000, 64), (600_000, 1, 64)]
    df = spark.createDataFrame(sizes, "__nq long, __ni long, __dim int")
    got = [tuple(r) for r in df.select(*vector._grid(vector.BLOCK, 96)).collect()]
    assert got == [(1, 1), (10, 10), (10, 10), (147, 147), (1, 96), (96, 1)]


def test_generate_query_marks_refused_prompts(spark, tmp_path):
    import __spark_entry__ as entry

    turns = [(1, 0, "a b c d"), (1, 1, "The end"), (2, 0, None), (2, 1, "a b c d")]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): (r.response, r.response_error) for r in entry.queries()["m2_generate"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0): ("a b c", None), (1, 1): (None, "ValueError: refused"), (2, 0): (None, None), (2, 1): ("a b c", None)}


def test_explained_surges_drop_or_keep_unmatched(spark):
    a = spark.createDataFrame([("Marigny", T0, 50, 10, True), ("Uptown", T0, 9, 9, False)], "pickup_zone string, window_time timestamp, request_count long, expected_requests long, is_surge boolean")
    kb = models.embed(spark.createDataFrame([(f"d{i}", f"event {i} in Marigny. more") for i in range(4)], "document_id string, chunk string"), "chunk")
    row = surge.explained(a, kb, FirstSentence()).collect()
    assert len(row) == 1 and row[0].anomaly_reason.startswith("Likely related: event") and row[0].top_chunk_3
    assert surge.explained(a, kb.limit(0), FirstSentence()).count() == 0
    assert surge.explained(a, kb.limit(0), FirstSentence(), keep_unmatched=True).count() == 1


# -- dispatch ------------------------------------------------------------------------

STOPS = [("Bywater", 7), ("Marigny", 9), ("French Quarter", 11), ("Central Business District (CBD)", 13), ("CBD", 13), ("Uptown", 23)]


def stops(spark):
    return spark.createDataFrame(STOPS, "zone string, idx int")


def fleet(spark, data):
    return spark.createDataFrame([(v, v, z, a, c, z) for v, z, a, c in data], "vessel_id string, vessel_name string, base_zone string, availability string, capacity int, current_zone string")


def surges_df(spark, data):
    return spark.createDataFrame(data, "pickup_zone string, window_time timestamp, request_count long, expected_requests long")


def test_one_surge_is_rank_and_cumulative_seats(spark):
    boats = [("V1", "Marigny", "available", 5), ("V2", "CBD", "available", 9), ("V3", "CBD", "available", 6), ("V4", "French Quarter", "available", 9),
             ("V5", "Uptown", "available", 9), ("V6", "Bywater", "in_dock", 9), ("V7", "Bywater", "available", 7)]
    got = dispatch.plan(surges_df(spark, [("French Quarter", T0, 40, 16)]), fleet(spark, boats), stops(spark)).collect()
    # nearest first, then larger; stops once 24 seats are covered
    assert [(r.vessel_id, r.cost) for r in sorted(got, key=lambda r: (r["round"], r.cost, -r.capacity))] == [("V2", 2), ("V3", 2), ("V1", 2), ("V7", 4)]


def plain_plan(surges, boats, at):
    """The rule of dispatch.plan with lists: (zone, window, vessel, round)."""
    free = {v: (at[z], c) for v, z, a, c in boats if a == "available" and c > 0}
    short = {(z, w): [n - e, 0] for z, w, n, e in surges if n > e}
    out, r = [], 0
    while True:
        r += 1
        open_ = {k: v for k, v in short.items() if v[0] > 0 and v[1] < 8}
        if not free or not open_:
            return out
        largest = max(c for _, c in free.values())
        asks = {k: min(8 - b, -(-left // largest)) for k, (left, b) in open_.items()}
        zones = {at[k[0]] for k in asks}
        lack = {x: sum(open_[k][0] for k in asks if at[k[0]] == x) for x in zones}
        claims = {}
        for x in zones:
            near = sorted((abs(x - s), -c, v) for v, (s, c) in free.items() if s != x)
            for cost, _, v in near[: sum(n for k, n in asks.items() if at[k[0]] == x)]:
                claims.setdefault(v, []).append((cost, -lack[x], x))
        won = {}
        for v, who in claims.items():
            tied = sorted(c for c in who if c[0] == min(who)[0])
            stop = sorted((-c, u) for u, (s, c) in free.items() if s == free[v][0])
            cost, _, x = tied[stop.index((-free[v][1], v)) % len(tied)]
            won.setdefault(x, []).append((cost, -free[v][1], v))
        if not won:
            return out
        for x, got in won.items():
            got.sort()
            for k in sorted((k for k in asks if at[k[0]] == x), key=lambda k: (-open_[k][0], k[1], k[0])):
                for cost, c, v in got[: asks[k]]:
                    out.append((*k, v, r))
                    short[k][0] += c
                    short[k][1] += 1
                    del free[v]
                got = got[asks[k] :]


@pytest.mark.parametrize("seed", range(4))
def test_plan_equals_plain_lists(spark, seed):
    r = random.Random(seed)
    at = dict(STOPS)
    boats = [(f"V{k:02d}", r.choice(list(at)), r.choice(["available"] * 5 + ["in_dock"]), r.choice([1, 4, 5, 9])) for k in range(r.choice([6, 30, 60]))]
    asked = [(z, T0 + dt.timedelta(minutes=m), r.choice([3, 20, 60, 200]), r.choice([0, 5, 60])) for z in at for m in range(r.choice([1, 3]))]
    got = dispatch.plan(surges_df(spark, asked), fleet(spark, boats), stops(spark)).collect()
    assert sorted((x.pickup_zone, x.window_time, x.vessel_id, x["round"]) for x in got) == sorted(plain_plan(asked, boats, at))


def test_many_boats_a_round(spark):
    """Ten surges of one stop and 24 boats at 24 others: handed out in a few rounds."""
    path = spark.createDataFrame([(f"Z{k}", k) for k in range(30)], "zone string, idx int")
    boats = [(f"V{k:02d}", f"Z{k + 3}", "available", 5) for k in range(24)]
    s = surges_df(spark, [("Z0", T0 + dt.timedelta(minutes=k), 40, 0) for k in range(10)])
    got = dispatch.plan(s, fleet(spark, boats), path).collect()
    assert len({x.vessel_id for x in got}) == 24 and max(x["round"] for x in got) <= 2


def test_two_surges_never_share_a_boat(spark):
    boats = [(f"V{i}", "Marigny", "available", 5) for i in range(3)]
    s = surges_df(spark, [("French Quarter", T0, 100, 0), ("Bywater", T0, 20, 0)])
    got = dispatch.plan(s, fleet(spark, boats), stops(spark)).collect()
    # at a stop, the surge that lacks more takes the first boat of a round
    assert {r.vessel_id: r.pickup_zone for r in got} == {"V0": "French Quarter", "V1": "Bywater", "V2": "French Quarter"}


def test_at_most_eight_boats_and_none_without_need(spark):
    boats = [(f"V{i:02d}", "Marigny", "available", 1) for i in range(20)]
    s = surges_df(spark, [("Uptown", T0, 500, 1), ("Bywater", T0, 5, 5)])
    got = dispatch.plan(s, fleet(spark, boats), stops(spark))
    assert got.count() == 8
    after = dispatch.apply_dispatch(fleet(spark, boats), got).where("availability = 'hired'").collect()
    assert len(after) == 8 and all((r.current_zone, r.base_zone) == ("Uptown", "Marigny") for r in after)
    action = dispatch.completed_actions(s, got).first()
    assert action.dispatch_summary == "Due to the surge in demand in Uptown as a result of high demand, we dispatched 8 additional boats from Marigny."
    assert action.api_response == '{"status":"success","boats_dispatched":8,"total_capacity_added":8}'
    assert dispatch.plan(s, fleet(spark, []), stops(spark)).count() == 0


def test_actions_from_replies(spark):
    df = surges_df(spark, [("Uptown", T0, 9, 3)]).withColumn("response", F.lit("Dispatch Summary:\nSent 2.\n\nDispatch JSON:\n[]\n\nAPI Response:\n{}"))
    row = dispatch.from_replies(df).first()
    assert (row.anomaly_reason, row.dispatch_summary, row.dispatch_json, row.api_response) == ("Surge detected: 9 requests (expected 3)", "Sent 2.", "[]", "{}")


# -- paths -------------------------------------------------------------------------------


def way(spark):
    # a stretch of river points, one per index
    return spark.createDataFrame([(i, -90.0 - 0.003 * i, 29.95 + 0.001 * (i % 3)) for i in range(39)], "idx int, lon double, lat double")


def dispatch_rows(spark, data):
    return spark.createDataFrame([(z, T0 + dt.timedelta(minutes=i), j) for i, (z, j) in enumerate(data)], "pickup_zone string, window_time timestamp, dispatch_json string")


def test_trip_follows_the_path(spark):
    boats = fleet(spark, [("VESSEL-13", "Central Business District (CBD)", "available", 9)])
    d = dispatch_rows(spark, [("French Quarter", '[{"vessel_id":"VESSEL-13","new_zone":"French Quarter"}]')])
    pts = sorted(paths.trips(d, boats, stops(spark), way(spark)).collect(), key=lambda r: r.seq)
    assert [p.idx for p in pts] == [13, 12, 11]
    times = [p.t_ms for p in pts]
    assert times == sorted(times) and times[-1] - times[0] in (7999, 8000) and 0 <= times[0] < 22_000


def names(df):
    return sorted((r.pickup_zone, r.vessel_id, r.origin) for r in df.collect())


@pytest.mark.parametrize(
    "zone,text,boats,want",
    [
        ("French Quarter", "not json", [("V1", "Bywater")], [("French Quarter", "V1", "Bywater")]),
        ("French Quarter", '[{"vessel_id":"V1"}]', [("V1", "French Quarter")], []),
        ("French Quarter", '[{"vessel_id":"UNKNOWN"}]', [], []),
        ("Atlantis", '[{"vessel_id":"V1"}]', [("V1", "Bywater")], []),
        ("CBD", "{}", [("V1", "Central Business District (CBD)")], []),
        ("Uptown", None, [(f"V{i}", "Bywater") for i in range(5)] + [("A", "Uptown"), ("B", "Marigny"), ("C", "Nowhere")],
         [("Uptown", "B", "Marigny"), ("Uptown", "V0", "Bywater"), ("Uptown", "V1", "Bywater")]),
        ("Uptown", '[{"vessel_id":"V4"},{"vessel_id":""},{"x":1}]', [(f"V{i}", "Bywater") for i in range(5)], [("Uptown", "V4", "Bywater")]),
    ],
)
def test_trip_starts(spark, zone, text, boats, want):
    got = paths.trip_starts(dispatch_rows(spark, [(zone, text)]), fleet(spark, [(v, z, "available", 5) for v, z in boats]), stops(spark))
    assert names(got) == want


def points(spark, data):
    return spark.createDataFrame([("X", T0, "V1", *p) for p in data], "pickup_zone string, window_time timestamp, vessel_id string, seq int, lon double, lat double, t_ms long")


def test_positions(spark):
    p = points(spark, [(0, 0.0, 0.0, 1000), (1, 10.0, 20.0, 2000), (2, 10.0, 30.0, 3000)])
    mid = paths.positions(p, 1500).first()
    assert (mid.lon, mid.lat) == (5.0, 10.0) and mid.heading == pytest.approx(63.4349488)
    # on a joint the first segment counts
    joint = paths.positions(p, 2000).first()
    assert (joint.lon, joint.lat) == (10.0, 20.0) and joint.heading == pytest.approx(63.4349488)
    assert paths.positions(p, 100).count() == paths.positions(p, 9000).count() == 0


def test_stitch_joins_clips_and_reverses(spark):
    pts = [("r", 1, 0, -90.0, 29.90), ("r", 1, 1, -90.1, 29.91), ("r", 2, 0, -90.1, 29.91), ("r", 2, 1, -90.15, 29.92), ("r", 3, 0, -90.5, 29.92), ("r", 3, 1, -90.19, 29.95)]
    got = paths.stitch(spark.createDataFrame(pts, "path_id string, way int, pos int, lon double, lat double")).orderBy("idx").collect()
    assert [(r.idx, r.lon) for r in got] == [(0, -90.19), (1, -90.15), (2, -90.1), (3, -90.0)]


def test_markers_are_one_per_coordinate(spark):
    c = [(0, "Bywater", 1.0, 1.0), (1, "Central Business District (CBD)", 2.0, 2.0), (2, "CBD", 2.0, 2.0), (3, "Uptown", 3.0, 3.0)]
    coords = spark.createDataFrame(c, "ord int, zone string, lon double, lat double")
    got = paths.zone_markers(coords, spark.createDataFrame([("CBD",)], "zone string")).collect()
    assert {r.name: r.is_active for r in got} == {"Bywater": False, "Central Business District (CBD)": True, "Uptown": False}


def test_no_surge_is_short_while_another_zone_has_a_boat(spark):
    """30 surges of one zone, 300 boats elsewhere: each gets its seats or all eight boats."""
    places = spark.createDataFrame([(f"z{k}", k) for k in range(6)], "zone string, idx long")
    s = surges_df(spark, [("z0", T0 + dt.timedelta(minutes=m), 100 + m, 20) for m in range(30)])
    boats = [(f"v{k:03d}", f"z{1 + k % 5}", "available", 5 + k % 4) for k in range(300)]
    ships = spark.createDataFrame(boats, "vessel_id string, base_zone string, availability string, capacity int")
    got = dispatch.plan(s, ships, places).collect()
    assert len({r.vessel_id for r in got}) == len(got) and {r.pickup_zone for r in got} == {"z0"}
    sent = {}
    for r in got:
        n, seats = sent.get(r.window_time, (0, 0))
        sent[r.window_time] = (n + 1, seats + r.capacity)
    need = {r.window_time: r.request_count - r.expected_requests for r in s.collect()}
    assert len(sent) == 30 and all(n == 8 or (n < 8 and seats >= need[t]) for t, (n, seats) in sent.items())


def test_boats_run_out(spark):
    places = spark.createDataFrame([(f"z{k}", k) for k in range(3)], "zone string, idx long")
    s = surges_df(spark, [(f"z{k % 2}", T0 + dt.timedelta(minutes=k), 60, 10) for k in range(8)])
    ships = spark.createDataFrame([(f"v{k}", f"z{k % 3}", "available", 4) for k in range(12)], "vessel_id string, base_zone string, availability string, capacity int")
    got = dispatch.plan(s, ships, places).collect()
    assert len(got) == 12 and all(r.base_zone != r.pickup_zone for r in got)


class Tally:
    """An embedder and writer that counts what it is asked, across worker processes."""

    name, dim = "count", 4

    def __init__(self, path):
        self.path = str(path)

    def _seen(self, texts):
        with open(self.path, "a") as f:
            f.writelines("x\n" for _ in texts)

    def embed(self, texts, kind):
        self._seen(texts)
        return [[1.0, 2.0, 3.0, float(len(t))] for t in texts]

    def write(self, prompts, max_tokens):
        self._seen(prompts)
        if any("bad" in p for p in prompts):
            raise ValueError("no")
        return [p.upper() for p in prompts]

    def calls(self):
        with open(self.path) as f:
            return len(f.readlines())


def test_each_text_is_embedded_once_whatever_reads_the_result(spark, tmp_path):
    client = Tally(tmp_path / "calls")
    vectors = models.embed(spark.createDataFrame([(k, f"text {k % 10}") for k in range(40)], "n long, t string"), "t", client)
    assert vectors.count() == 40 and vectors.where("embedding is not null").count() == 40
    assert client.calls() == 10


def test_knowledge_rows_and_dead_letters_share_the_calls(spark, tmp_path):
    client = Tally(tmp_path / "calls")
    rows = [(f"Fest {k}", "Marigny", f"words {k}", "high", T0, T0, "v", 5, "music") for k in range(12)]
    schema = "event_name string, zone string, description string, impact_level string, event_time_start timestamp, event_time_end timestamp, venue string, expected_attendance int, event_type string"
    good, dead = surge.knowledge_rows(spark.createDataFrame(rows, schema), F.lit(T0), client)
    assert good.count() == 12 and dead.count() == 0 and client.calls() == 12


def test_a_failing_prompt_fails_alone(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("bad",), ("c",), (None,)], "p string")
    got = models.generate(df, "p", Tally(tmp_path / "calls"), on_error="row", retries=1)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("a", "A", None), ("bad", None, "ValueError: no"), ("c", "C", None), (None, None, None)], key=repr)
    with pytest.raises(Exception, match="no"):
        models.generate(df, "p", Tally(tmp_path / "calls")).collect()


def test_calls_end_after_the_timeout():
    import time

    with pytest.raises(TimeoutError):
        models.patient(lambda v: time.sleep(5) or v, [1], 0.05, 1)
    tries = []
    assert models.patient(lambda v: v if len(tries) > 1 else tries.append(1) or 1 / 0, [7], None, 3) == [7] and len(tries) == 2


def test_lateral_keeps_or_drops_rows_without_an_answer(spark):
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (4, "a b")], "n int, t string")
    call = lambda texts: [[{"w": w} for w in t.split()] for t in texts]
    inner = models.lateral(df, "t", call, "w string")
    left = models.lateral(df, "t", call, "w string", "left")
    assert sorted((r.n, r.w) for r in inner.collect()) == [(1, "a"), (1, "b"), (4, "a"), (4, "b")]
    assert sorted((r.n, r.w or "") for r in left.collect()) == [(1, "a"), (1, "b"), (2, ""), (3, ""), (4, "a"), (4, "b")]


def nearest_of(spark, points, marks):
    got = nearest.nearest_point(spark.createDataFrame(points, "zone long, lon double, lat double"), spark.createDataFrame(marks, "idx long, lon double, lat double"))
    return {q.zone: (q.d2, q.idx) for q in got.collect()}


def plainly(points, marks):
    real = [m for m in marks if all(v is not None and abs(v) < float("inf") for v in m[1:])]
    return {z: min(((x - a) * (x - a) + (y - b) * (y - b), i) for i, a, b in real) for z, x, y in points if x is not None and abs(x) < float("inf")}


def test_nearest_point_on_odd_layouts(spark):
    r = random.Random(8)
    marks = [(k, r.choice([0.0, 0.001, 5.0]) + r.random() * 1e-3, r.random() * 1e-3) for k in range(300)] + [(900, 400.0, -3.0), (901, 400.0, -3.0)]
    marks += [(902, None, 1.0), (903, float("nan"), 1.0), (904, 1.0, float("-inf"))]
    points = [(k, r.uniform(-10, 420), r.uniform(-10, 10)) for k in range(200)] + [(500, 400.0, -3.0)]
    odd = [(501, None, 1.0), (502, float("nan"), 1.0), (503, float("inf"), 1.0)]
    assert nearest_of(spark, points + odd, marks) == plainly(points, marks)
    assert nearest_of(spark, points, marks[-3:]) == {} and nearest_of(spark, [], marks) == {}


def test_nearest_point_with_all_points_outside(spark):
    r = random.Random(9)
    marks = [(k, r.random(), r.random()) for k in range(1500)]
    points = [(k, r.choice([-1, 1]) * r.uniform(5, 5000), r.uniform(-3000, 3000)) for k in range(300)]
    assert nearest_of(spark, points, marks) == plainly(points, marks)


def test_nearest_point_on_lines_and_clusters(spark):
    """All waypoints on one meridian, on a coarse grid full of ties, and nearly all in one far corner."""
    r = random.Random(10)
    points = [(k, r.uniform(-2, 12), r.uniform(-2, 12)) for k in range(150)] + [(200 + k, k % 11 + 0.5, 4.5) for k in range(11)]
    for marks in (
        [(k, 3.0, r.random() * 10) for k in range(700)],
        [(k, float(k % 11), float(k // 11 % 11)) for k in range(400)],
        [(k, 9 + r.random() * 1e-6, 9 + r.random() * 1e-6) for k in range(800)] + [(k, r.random() * 10, r.random() * 10) for k in range(1000, 1010)],
    ):
        assert nearest_of(spark, points, marks) == plainly(points, marks)


def test_points_meet_few_waypoints(spark):
    """Every point goes to a few leaves, however far outside it lies."""
    r = random.Random(11)
    marks = spark.createDataFrame([(k, r.random(), r.random()) for k in range(4000)], "idx long, x double, y double")
    levels, leaves = nearest._levels(marks, 4000)
    sizes = [len(x.marks) for x in leaves.collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 2 * nearest.LEAF
    assert levels[0].count() == 1 and all(len(x.children) <= nearest.FAN**2 for level in levels for x in level.collect())
