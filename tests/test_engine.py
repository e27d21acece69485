"""Golden values, round trips, state machines and metamorphic properties of the engine."""

import functools
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.cluster import Cluster
from spindrift.functions import vectors as V
from spindrift.operators import distributed as D
from spindrift.operators import index as I
from spindrift.operators import metrics, train
from spindrift.operators import placement as M
from spindrift.sources import metric_files, vecfiles
from spindrift.sources.index_dir import AnnIndex, IndexDir
from spindrift.streaming import arrivals, reports
from spindrift.undecided import OPEN, NotResident, PQAbsent, PQFull, Unavailable, Undecided
from tests.model import CodeStore


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def tables(spark, sf):
    from spindrift.plans.vector_queries import Tables

    return Tables(spark, sf)


# --- golden values ---------------------------------------------------------------------------------------------


def test_group_by_owner(spark):
    probed = spark.createDataFrame([(0, i, l) for i, l in enumerate([5, 2, 0, 3])], "qid int, pos int, list_id int")
    lp = spark.createDataFrame(list(enumerate([0, 0, 1, 1, 2, 2])), "list_id int, part int")
    pl = spark.createDataFrame(list(enumerate([7, 3, 7])), "part int, node int")
    got = {r["node"]: r["lists"] for r in D.owner_groups(D.group_by_owner(probed, lp, pl)).collect()}
    assert got == {3: [2, 3], 7: [5, 0]}


def test_merge_topk(spark):
    a, b = [(4, 1.0), (9, 2.0), (1, 3.0)], [(9, 2.0), (2, 2.0), (8, 0.5)]
    for both in (a + b, b + a):
        df = spark.createDataFrame([(0, i, d) for i, d in both], "qid int, vec_id int, dist double")
        assert [r["vec_id"] for r in D.merge_topk(df, "dist", 4).orderBy("rank").collect()] == [8, 4, 2, 9]
        assert D.merge_topk(df, "dist", -1).count() == 5


def test_split_by_origin(spark):
    df = spark.createDataFrame([(0, 0, 4, 1.0), (0, 0, 9, 2.0), (0, 1, 8, 0.5), (0, 1, 9, 2.0), (0, 1, 2, 3.0)], "qid int, node int, vec_id int, adc double")
    assert rows(D.merge_origin(df, 3), "node", "vec_id") == [(0, 4), (0, 9), (1, 8)]


def test_round_robin():
    assert M.round_robin([5, 6, 7], 2, 0) == ([0, 1, 0], 1)
    assert M.round_robin([8], 2, 3)[0] == [1]
    assert M.round_robin([8, 9], 0, 0)[0] == [-1, -1]


@pytest.mark.parametrize("p,n,m", [(8, 2, 4), (64, 4, 8), (64, 4, 5), (16, 2, 4), (64, 8, 16), (12, 3, 6), (64, 4, 16), (64, 3, 6)])
def test_round_trip_home(spark, p, n, m):
    start = M.initial(p, list(range(n)))
    h = M.History(start)
    out, moves = M.repartition(spark, start, list(range(m)))
    h.record(out)
    back, _ = M.repartition(spark, out, list(range(n)), h.owned)
    assert back == start and moves
    counts = [out.count(i) for i in range(m)]
    assert max(counts) - min(counts) <= 1
    stayed, _ = M.repartition(spark, out, list(range(n)))
    assert all(stayed[i] == start[i] for i in range(p) if out[i] == start[i])


def test_scale_out_frame_equals_list(spark):
    for p, n, m in [(64, 4, 5), (64, 4, 8), (16, 2, 4), (12, 3, 6), (9, 2, 3)]:
        _, moves = M.repartition(spark, M.initial(p, list(range(n))), list(range(m)))
        got = rows(M.scale_out(D.even_placement(spark, p, list(range(n))), list(range(m))), "src", "dst", "part")
        assert got == moves


def test_placement_refuses(spark):
    for bad in (lambda: M.initial(2, [1, 2, 3]), lambda: M.initial(4, []), lambda: M.initial(4, [1, 1]), lambda: M.repartition(spark, [0, 0, 1, 1], [0, 2])):
        with pytest.raises(ValueError):
            bad()
    assert M.repartition(spark, [0, 0, 1, 1], [1, 0]) == ([0, 0, 1, 1], [])
    with pytest.raises(Undecided):
        M.weighted()
    assert M.rescale_nodes([5, 4, 9], [1, 2], 4) == ([4, 5], []) and M.rescale_nodes([], [1, 2, 3], 1) == ([], [2, 3])


def test_ranges_round_trip(spark):
    pl = spark.createDataFrame(list(enumerate([0, 0, 1, 0, 2, 2, 2])), "part int, node int")
    r = M.ranges(pl)
    assert rows(r, "node", "lo", "hi") == [(0, 0, 1), (0, 3, 3), (1, 2, 2), (2, 4, 6)]
    assert rows(M.from_ranges(r), "node", "part") == rows(pl, "node", "part")


def test_code_store():
    s = CodeStore(4)
    assert s.reserve([3, 1]) == [1, 3]
    assert s.put([(1, b"a"), (3, b"b"), (1, b"c")]) == 2
    s.ref([(1, 10), (1, 10), (3, 30)])
    assert s.stats() | {"live": 2, "staged": 0, "cached": 0, "skipped": 1} == s.stats()
    with pytest.raises(PQAbsent):
        s.ref([(1, 10), (9, 90)])
    with pytest.raises(ValueError):
        s.ref([(1, 11)])
    s.unref([1])
    assert s.state(1) == "live"
    s.unref([1])
    assert s.state(1) == "cached"
    s.put({5: b"", 6: b""})
    assert s.put({7: b""}) == 1 and 1 not in s.held  # the cached code made room
    with pytest.raises(PQFull):
        s.put({8: b"", 9: b""})
    assert s.release_staged([5, 6, 7]) == 3 and s.stats()["resident"] == 1


def test_epochs_and_bucket():
    e = M.EpochStore()
    e.compare_and_swap(0, {"epoch": 1, "owners": [1]})
    with pytest.raises(ValueError):
        e.compare_and_swap(0, {"epoch": 1, "owners": [1]})
    b = M.TokenBucket(100, 50)
    assert b.send(0, 50) == 0 and b.send(0, 100) == pytest.approx(1.0)
    assert b.send(0, 10, background=True) >= 1.0


def test_undecided():
    assert len(OPEN) == 16
    for f, u in ((arrivals.self_similar, "U11"), (M.adaptive_rate, "U8"), (M.weighted, "U3")):
        with pytest.raises(Undecided) as x:
            f()
        assert x.value.ident == u


# --- index and search ------------------------------------------------------------------------------------------


def test_distance_kernels(spark):
    rng = np.random.default_rng(1)
    for dim in (1, 7, 64):
        a, b = rng.integers(-128, 128, dim), rng.integers(-128, 128, dim)
        df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<long>, b array<long>")
        r = df.select(V.l2sqr(F.col("a"), F.col("b")).alias("x"), V.unrolled_l2sqr(F.col("a"), F.col("b"), dim).alias("y")).first()
        assert r["x"] == r["y"] == int(((a - b) ** 2).sum())
    assert [V.default_pq_m(d) for d in (64, 12, 6, 7)] == [8, 3, 3, 7]


@pytest.mark.parametrize("name", ["P1_l2_int", "P2_l2_float", "P3_l2_mixed"])
def test_distances_of_all_pairs(spark, sf, name):
    """Each query of the query set beside every vector."""
    from spindrift.plans import registry

    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = registry.QUERIES[name](spark, sf).select("qid", "vec_id").distinct().count()
    assert got == e.count() * e.where("vec_id % 50 = 0").count()


def test_pairs_of_blocks_and_nulls(spark, monkeypatch):
    from spindrift.operators import blocks

    monkeypatch.setattr(blocks, "PAIRED", (3, 2))
    gen = np.random.default_rng(7)
    v = {i: gen.normal(size=5).tolist() for i in range(11)} | {20: None, 21: [1.0, None, 2.0, 3.0, 4.0]}
    df = spark.createDataFrame(list(v.items()), "id long, v array<double>")
    got = {(r["qid"], r["id"]): r["dist"] for r in blocks.all_pairs(df.where("id % 2 = 0"), df).collect()}
    want = {(i, j): None if i > 11 or j > 11 else functools.reduce(lambda s, x: s + (x[0] - x[1]) * (x[0] - x[1]), zip(v[i], v[j]), 0.0) for i in v if i % 2 == 0 for j in v}
    assert got == want


def test_every_list_and_code_gives_exact_answers(tables):
    p = I.Params(nprobe=50, n=500)
    f = I.filter_stage(I.gather(I.navigate(tables.q, tables.h, p.nprobe), tables.post()), tables.codes(), tables.luts(), p.n)
    got = I.rerank(f, tables.v, tables.q, 10)
    want = I.exact_knn(tables.q, tables.v, 10)
    assert rows(got, "qid", "rank", "vec_id", "dist") == rows(want, "qid", "rank", "vec_id", "dist")


def test_coarse_assignment(tables, spark):
    """With all cells probed the assignment is the exact one; with some, more of it than their share."""
    cells = tables.h.where("list_id % 7 = 0").select((F.col("list_id") / 7).cast("int").alias("id"), F.col("hv").alias("v"))
    want = rows(tables.post(), "vec_id", "list_id", "rank", "dist")
    assert rows(I.assign_coarse(tables.v, tables.h, cells, cells.count()), "vec_id", "list_id", "rank", "dist") == want
    found = []
    for probes in (2, 5):
        some = {r[:2] for r in rows(I.assign_coarse(tables.v, tables.h, cells, probes), "vec_id", "list_id")}
        found.append(len(some & {r[:2] for r in want}) / len(want))
        assert found[-1] > probes / cells.count()
    assert found[1] > found[0]


def test_graph_navigation(tables, spark):
    """Against the exact lists: most are found, by meeting fewer heads than there are."""
    from spindrift.operators import graph

    v = I.read_vectors(spark, "/root/testdata/sf0.1")
    h, q = I.heads_of(v), I.query_set(v)
    built = graph.build(h.select(F.col("list_id").alias("id"), F.col("hv").alias("v")))
    edges = built[0].collect()
    per = Counter(e["id"] for e in edges)
    assert max(per.values()) <= 40 and len(per) == h.count() and all(e["id"] != e["to"] for e in edges)
    at = {r["list_id"]: np.array(r["hv"]) for r in h.collect()}
    assert all(((at[e["id"]] - at[e["to"]]) ** 2).sum() == e["dist"] for e in edges)
    near, seen = I.navigate_graph(q, h, built, 8, beam=10)
    got, want = rows(near, "qid", "list_id"), rows(I.navigate(q, h, 8), "qid", "list_id")
    assert len(got) == len(want) and len(set(got) & set(want)) >= 0.9 * len(want)
    assert np.mean([r["seen"] for r in seen.collect()]) < h.count()


def test_graph_search_broadcasts_nothing(tables, monkeypatch):
    """Small tables too are merged in the rounds: broadcasts of every round would add up at the driver."""
    from spindrift.operators import graph

    nodes = tables.h.select(F.col("list_id").alias("id"), F.col("hv").alias("v"))
    made = graph.build(nodes)
    plans, staged = [], graph.staged
    monkeypatch.setattr(graph, "staged", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or staged(df, name))
    graph.search(tables.q.select(F.col("qid").alias("id"), F.col("qv").alias("v")), nodes, *made, 8)
    assert len(plans) > 1 and not any("Broadcast" in p for p in plans[1:])


def test_graph_of_few_and_equal_nodes(spark):
    """Fewer nodes than a beam, one node, none; many nodes at one place."""
    from spindrift.operators import graph

    make = lambda x: spark.createDataFrame(list(enumerate(x)), "id long, v array<long>")
    q = make([[0, 0], [9, 9]])
    for nodes in ([[1, 1]], [[1, 1]] * 40, [[i, 0] for i in range(7)], []):
        n = make(nodes)
        got = rows(graph.search(q, n, *graph.build(n, 8, 16, 2), 3)[0], "qid", "rank", "id", "dist")
        d = [[(x - a) ** 2 + (y - a) ** 2 for x, y in nodes] for a in (0, 9)]
        if len({tuple(x) for x in nodes}) > 1 or len(nodes) < 2:
            assert got == [(a, k + 1, int(i), d[a][i]) for a in (0, 1) for k, i in enumerate(np.argsort(d[a], kind="stable")[:3])]
        else:
            assert [(r[0], r[1], r[3]) for r in got] == [(a, k + 1, d[a][0]) for a in (0, 1) for k in range(3)]


def test_assignment_of_ties_and_copies(spark, monkeypatch):
    """Small coordinates tie often and copies are at distance 0; blocks of few heads; against all pairs."""
    from spindrift.operators import blocks

    monkeypatch.setattr(blocks.nearest_in_cells, "__defaults__", (16, 8, None))
    monkeypatch.setattr(blocks.nearest, "__defaults__", (16, 8, None))
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-3, 4, (80, 3)), np.tile([[1, 1, 1]], (40, 1)), rng.integers(-40, 41, (40, 3))])
    v = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id long, v array<long>")
    h = spark.createDataFrame([(i, r) for i, r in enumerate(x[::2].tolist())], "list_id long, hv array<long>")
    cells = spark.createDataFrame([(i, r) for i, r in enumerate(x[::10].tolist())], "id int, v array<long>")
    d = ((x[:, None] - x[::2][None]) ** 2).sum(axis=2)
    near = lambda a, k: np.argsort(a, kind="stable")[:k]
    home = [near(r, 1)[0] for r in ((x[::2][:, None] - x[::10][None]) ** 2).sum(axis=2)]
    for p in (I.Params(), I.Params(candidates=3), I.Params(eps=0.5, replicas=12)):
        for probes in (5, 16):
            want = []
            for i, r in enumerate(((x[:, None] - x[::10][None]) ** 2).sum(axis=2)):
                met = np.flatnonzero(np.isin(home, near(r, probes)))
                best = met[near(d[i][met], min(p.candidates, p.replicas))]
                want += [(i, int(j), k + 1, int(d[i, j])) for k, j in enumerate(best) if d[i, j] * 10_000 <= d[i, best[0]] * round((1 + p.eps) ** 2 * 10_000)]
            assert rows(I.assign_coarse(v, h, cells, probes, p), "vec_id", "list_id", "rank", "dist") == sorted(want)


@pytest.mark.parametrize("within", [None, 1.1])
def test_blocks_are_met_in_slices(within):
    """Full blocks take a few MB beside themselves, not their whole product (67 MB) several times."""
    import tracemalloc

    import pyarrow as pa

    from spindrift.operators import blocks

    gen = np.random.default_rng(3)
    pack = lambda n: (np.arange(n), gen.integers(-300, 300, (n, 8)))
    (b, y), (a, x) = pack(blocks.ROWS), pack(blocks.QUERIES)
    left, right = (pa.table({"ids": [i.astype("<i8").tobytes()], "data": [v.astype("<f8").tobytes()]}) for i, v in ((b, y), (a, x)))
    tracemalloc.start()
    got = blocks._meet(left, right, 10, False, within)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6
    for q in (0, 31, 32, 1023):
        d = ((y - x[q]) ** 2).sum(axis=1)
        want = [(int(d[i]), int(i)) for i in np.lexsort((b, d))[:10] if within is None or d[i] <= d.min() * within]
        of = got["qid"].to_numpy() == q
        have = sorted(zip(got["dist"].to_numpy()[of].tolist(), got["id"].to_numpy()[of].tolist()))
        assert [w for w in have if within is None or w[0] <= d.min() * within] == want


def test_batches_in_slices():
    """A batch of many queries is worked out some at a time."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"n": list(range(1000))})
    got = list(I._slices([batch], 128))
    assert max(g.num_rows for g in got) == 128 and pa.Table.from_batches(got)["n"].to_pylist() == batch["n"].to_pylist()


def test_first_of_rows():
    from spindrift.operators.blocks import _first

    d = np.random.default_rng(5).integers(0, 6, (50, 30)).astype(float)
    for k in (1, 5, 29, 30, 40):
        assert (_first(d, k) == np.argsort(d, axis=1, kind="stable")[:, :k]).all()


def test_two_phase_any_placement(tables, spark):
    p = I.Params()
    want = rows(I.rerank(tables.filt(), tables.v, tables.q, p.k), "qid", "rank", "vec_id")
    for lp, nodes in ((D.hash_partitions(tables.h, 8), [4, 1]), (D.range_partitions(tables.h, 5), [0, 1, 2, 3])):
        n = lp.agg(F.max("part")).first()[0] + 1
        own = D.group_by_owner(tables.nav(), lp, D.even_placement(spark, n, nodes))
        assert rows(D.two_phase(own, tables.post(), tables.codes(), tables.luts(), tables.v, tables.q, p), "qid", "rank", "vec_id") == want


def test_candidates_are_dealt_by_queries(tables, monkeypatch):
    monkeypatch.setattr(D, "APART", 3)
    n, _ = D._passed(tables.own(), tables.post(), tables.codes(), tables.luts(), 50)
    plan = n._jdf.queryExecution().executedPlan().toString()
    assert f", {-(-tables.q.count() // 3)}), REPARTITION_BY_NUM" in plan


def test_not_resident(tables, spark):
    with pytest.raises(NotResident):
        I.gather(tables.nav(), tables.post(), spark.createDataFrame([(0,)], "list_id long"))
    with pytest.raises(ValueError):
        I.Params(k=0).checked()


def test_heuristic_stops(spark):
    """Candidates already in order of distance: the second batch changes nothing; eps 1 stops after the first."""
    v = spark.createDataFrame([(i, [i]) for i in range(1, 101)], "vec_id long, v array<long>")
    q = spark.createDataFrame([(0, [0])], "qid long, qv array<long>")
    f = spark.createDataFrame([(0, i, i) for i in range(1, 101)], "qid long, vec_id long, rank int")
    lay = I.sequential_layout(v, 8)
    one = I.heuristic_rerank(f, v, q, lay, 10).first()
    assert one["batches"] == 2 and one["ids"] == list(range(1, 11))
    assert I.heuristic_rerank(f, v, q, lay, 10, eps=1.0).first()["batches"] == 1
    every = I.heuristic_rerank(f, v, q, lay, 10, eps=-1.0).first()
    assert every["batches"] == 10 and every["pages_read"] + every["intra_merged"] + every["buffer_hits"] == 100
    plain = I.heuristic_rerank(f, v, q, lay, 10, eps=-1.0, io_dedup=False).first()
    assert plain["pages_read"] == 100


def pack_naively(tails, vpp):
    """Page and slot of each tail, page by page: largest first, then the largest that fits."""
    left = {}
    for i, s in enumerate(tails):
        left.setdefault(s, []).append(i)
    out, page = {}, 0
    while any(left.values()):
        room = vpp
        while fit := [s for s in left if left[s] and s <= room]:
            s = max(fit)
            out[left[s].pop(0)] = (page, vpp - room)
            room -= s
        page += 1
    return out


def test_bucket_layout(spark):
    rng = np.random.default_rng(2)
    vpp = 8
    lists = rng.integers(0, 70, 900)
    df = spark.createDataFrame([(i, int(l)) for i, l in enumerate(lists)], "vec_id long, list_id long")
    got = {r["vec_id"]: (r["page"], r["slot"]) for r in I.bucket_layout(df, vpp).collect()}
    assert len(set(got.values())) == 900
    members = {l: np.flatnonzero(lists == l) for l in sorted(set(lists.tolist()))}
    page, want, tails = 0, {}, []
    for l, m in members.items():
        for k in range(len(m) // vpp):
            want |= {int(m[k * vpp + s]): (page + k, s) for s in range(vpp)}
        page += len(m) // vpp
        if len(m) % vpp:
            tails.append(m[len(m) // vpp * vpp :])
    for i, (p, s) in pack_naively([len(t) for t in tails], vpp).items():
        want |= {int(v): (page + p, s + j) for j, v in enumerate(tails[i])}
    assert got == want


def test_kmeans_and_hierarchy(spark):
    rng = np.random.default_rng(3)
    centre = np.array([[0, 0], [10, 0], [0, 10], [10, 10]])
    x = np.concatenate([c + rng.normal(0, 0.1, (250, 2)) for c in centre])
    c, label = train.kmeans(x, 4)
    assert all(((c - t) ** 2).sum(axis=1).min() < 0.1 for t in centre) and len(set(label)) == 4
    leaves = train.hierarchical(x, np.arange(1000))
    assert max(map(len, leaves)) <= 15 and sorted(np.concatenate(leaves)) == list(range(1000))
    same = train.hierarchical(np.zeros((50, 2)), np.arange(50))
    assert sum(map(len, same)) == 50 and max(map(len, same)) <= 15


def test_trained_index(tables):
    cb = train.train_codebook(tables.v, 8, codes=64, iterations=5)
    assert cb.count() == 8 * 64
    codes = I.encode(tables.v, cb, 8)
    back = I.decode(codes, cb).join(tables.v.withColumnRenamed("v", "w"), "vec_id")
    err = back.select(V.l2sqr(F.col("v"), F.col("w")).alias("e"), V.l2sqr(F.col("w"), F.transform("w", lambda x: F.lit(0).cast("long"))).alias("n")).agg(F.sum("e") / F.sum("n")).first()[0]
    assert err < 0.5
    leaves = train.cluster(tables.v)
    assert leaves.count() == tables.v.count() and leaves.groupBy("node", "leaf").count().agg(F.max("count")).first()[0] <= 15


def test_clustering_by_joins(spark, monkeypatch):
    """Several levels by joins; a third of the vectors equal; no task gets more members than it is meant to."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(-500, 500, (600, 4)), np.tile([[7, 7, 7, 7]], (300, 1))]).tolist()
    v = spark.createDataFrame(list(enumerate(x)), "vec_id long, v array<long>").repartition(5)
    c = train.cluster(v, ratio=0.1, slack=1.5, branch=4, task=64)
    got = c.collect()
    assert sorted(r["vec_id"] for r in got) == list(range(900))
    assert max(Counter((r["node"], r["leaf"]) for r in got).values()) <= 15
    assert sorted(map(tuple, got)) == sorted(map(tuple, train.cluster(v.repartition(3), ratio=0.1, slack=1.5, branch=4, task=64).collect()))
    assert max(Counter(r["node"] for r in got if r["leaf"] >= 0).values()) <= 64
    spread = {r["vec_id"]: (r["node"], r["leaf"]) for r in got}
    near = [((np.array(x[a]) - x[b]) ** 2).sum() for a in range(0, 600, 7) for b in range(600) if a != b and spread[a] == spread[b]]
    assert np.mean(near) < 0.5 * np.mean([((np.array(x[a]) - x[b]) ** 2).sum() for a in range(0, 600, 7) for b in range(1, 600, 11)])


def test_seeds_and_repair(spark):
    """Far groups each get a seed; draws follow the distance; an empty centre takes half of the largest cluster."""
    rng = np.random.default_rng(5)
    middle = np.array([[0, 0], [4000, 0], [0, 4000], [4000, 4000], [9000, 9000]])
    x = np.concatenate([m + rng.integers(-20, 21, (200, 2)) for m in middle])
    v = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, v array<long>")
    s = np.array([r["v"] for r in train.seed(v, 5).collect()])
    assert len(s) == 5 and all(np.abs(s - m).max(axis=1).min() <= 40 for m in middle)
    first = spark.createDataFrame([(0, [0, 0])], "id long, v array<long>")
    drawn = train.seeding_round(v, first, 100, 1).collect()
    assert 60 < len(drawn) < 140 and sum(r["vec_id"] < 200 for r in drawn) == 0
    assert train.seeding_round(v.where("vec_id < 0"), first, 100, 1).count() == 0
    c = spark.createDataFrame([(0, [0, 0]), (1, [1024, -1024]), (2, [5, 5])], "id long, v array<long>")
    n = spark.createDataFrame([(0, 3), (1, 9)], "id long, n long")
    assert rows(train.repaired(c, n), "id", "v") == [(0, [0, 0]), (1, [1023, -1023]), (2, [1025, -1025])]


def test_codebook_training_lowers_the_error(tables):
    first = tables.cb()
    errors = [train.quantizer_error(tables.v, c, 8).agg(F.sum("error")).first()[0] for c in (first, train.train_codebook(tables.v, 8, iterations=1, first=first), train.train_codebook(tables.v, 8, iterations=6, first=first))]
    assert errors[0] >= errors[1] >= errors[2]
    some = train.train_codebook(tables.v, 8, codes=16, iterations=0)
    assert train.quantizer_error(tables.v, train.train_codebook(tables.v, 8, iterations=5, first=some), 8).agg(F.sum("error")).first()[0] < train.quantizer_error(tables.v, some, 8).agg(F.sum("error")).first()[0]


def test_trained_folder(tables, spark, tmp_path):
    """An index whose heads and codebook come from the whole table: complete, and its search finds more than the recipe's."""
    v = I.read_vectors(spark, "/root/testdata/sf0.01")
    q = I.query_set(v)
    truth = I.exact_knn(q, v, 10)
    got = []
    for trained in (False, True):
        d = IndexDir(spark, str(tmp_path / str(trained)))
        d.build(v, trained=trained)
        assert set(d.validate().values()) == {0}
        got.append(D.recall(truth, AnnIndex(d, v).search(q, I.Params(nprobe=16, n=100)), 10).first()["recall"])
    heads = d.read("heads").collect()
    assert len(heads) >= v.count() / 15 and sorted(h["list_id"] for h in heads) == list(range(len(heads)))
    assert got[1] >= 0.95 and got[1] >= got[0] - 0.02
    with pytest.raises(ValueError):
        d.build(v)


def test_index_folder(tables, spark, tmp_path):
    d = IndexDir(spark, str(tmp_path / "ix"))
    d.build(tables.v)
    d.segment()
    assert set(d.validate().values()) == {0}
    got = AnnIndex(d, tables.v).search(tables.q)
    assert rows(got, "qid", "rank", "vec_id") == rows(I.rerank(tables.filt(), tables.v, tables.q, 10), "qid", "rank", "vec_id")
    assert AnnIndex(d, tables.v).search(tables.q, heuristic=True).count() == tables.q.count()
    assert d.segments([0, 1]).select("part").distinct().count() == 2
    d.build(tables.v)  # nothing left to do
    with pytest.raises(ValueError):
        d.build(tables.v.limit(3))
    assert {r["name"] for r in d.describe().collect()} >= {"heads", "codes"}
    on_disk = {t.name: sum(f.stat().st_size for f in t.rglob("*") if f.is_file() and not f.name.endswith(".crc")) for t in Path(d.path).iterdir() if t.is_dir()}
    sizes = {r["name"]: r["bytes"] for r in d.sizes().collect()}
    assert {"heads", "codes"} <= set(sizes) and sizes == {t: on_disk[t] for t in sizes}


def test_cluster_ledger(tables, spark):
    c = Cluster(spark, tables.lp(), tables.post(), 8)
    with pytest.raises(Unavailable):
        c.deploy(2)
    for _ in range(3):
        c.register()
    c.deploy(2)
    out = c.rescale(3)
    back = c.rescale(2)
    again = c.rescale(3)
    assert out["moved"] > 0 and out["pq_codes"] > 0
    assert back["pq_codes"] == again["pq_codes"] == 0  # copies are still there
    assert c.status()["epoch"] == 4 and c.admit() == 4


# --- files, metrics, streams -----------------------------------------------------------------------------------


@pytest.mark.parametrize("ext", ["fbin", "u8bin", "i8bin", "fvecs", "bvecs"])
def test_vector_files(spark, tmp_path, ext):
    low = -100 if ext in ("i8bin", "fbin", "fvecs") else 0
    x = np.random.default_rng(4).integers(low, 100, (50, 6)).astype("float32")
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    path = str(tmp_path / f"v.{ext}")
    vecfiles.save_bin(df, path)
    assert rows(vecfiles.read_vectors(spark, path), "vec_id", "embedding") == rows(df, "vec_id", "embedding")
    assert vecfiles.read_vectors(spark, path, max_n=7).count() == 7
    with pytest.raises(ValueError):
        vecfiles.dtype_of("x.txt")


def test_files_in_parts(spark, tmp_path):
    """Tasks write parts, the commit only lists them, and readers number rows through all of them."""
    x = np.random.default_rng(9).integers(-100, 100, (1000, 3)).astype("float32")
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(7)
    path = str(tmp_path / "v.fbin")
    vecfiles.save_bin(df, path, part_rows=100)
    parts = vecfiles.parts_of(path)
    assert len(parts) > 5 and Path(path).stat().st_size < 2000
    assert rows(vecfiles.read_vectors(spark, path), "vec_id", "embedding") == rows(df, "vec_id", "embedding")
    assert rows(vecfiles.read_vectors(spark, path, max_n=333), "vec_id", "embedding") == rows(df.where("vec_id < 333"), "vec_id", "embedding")
    one = rows(vecfiles.read_vectors(spark, parts[1]), "embedding")  # a part is a file of the format
    n = vecfiles.read_vectors(spark, parts[0]).count()
    assert one == rows(df.where(F.col("vec_id").between(n, n + len(one) - 1)), "embedding")
    vecfiles.save_bin(df.limit(0), str(tmp_path / "none.fbin"))
    assert vecfiles.read_vectors(spark, str(tmp_path / "none.fbin")).count() == 0
    with pytest.raises(Exception, match="dimensions"):
        vecfiles.save_bin(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<float>"), str(tmp_path / "bad.fbin"))
    t = spark.createDataFrame([(q, r, 10 * q + r, float(r)) for q in range(50) for r in (1, 2, 3)], "qid long, rank int, vec_id long, dist double")
    for ext in ("ibin", "ivecs"):
        vecfiles.save_truth(t, str(tmp_path / f"gt.{ext}"), part_rows=8)
        assert len(vecfiles.parts_of(str(tmp_path / f"gt.{ext}"))) > 3
        assert rows(vecfiles.read_truth(spark, str(tmp_path / f"gt.{ext}")), "qid", "rank", "vec_id") == rows(t, "qid", "rank", "vec_id")


def test_page_files(spark, tmp_path, monkeypatch):
    """Only the pages asked for are read: the byte ranges are theirs, and parts without any may be gone."""
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

    from spindrift.sources import pages

    monkeypatch.setattr(pages, "PART_PAGES", 10)
    x = np.arange(1200, dtype="float32").reshape(400, 3)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    layout = spark.createDataFrame([(i, (i + i // 30) // 4, i + i // 30) for i in range(400)], "vec_id long, page long, loc long")
    path = str(tmp_path / "v.pages")
    pages.save_pages(df, layout, path, vpp=4, page_bytes=64)
    every = layout.join(pages.read_pages(spark, path).drop("page"), "loc")
    assert rows(every, "vec_id", "embedding") == rows(df, "vec_id", "embedding")

    def asked(*filters):
        r = pages.PageReader({"path": path})
        left = list(r.pushFilters(list(filters)))
        assert len([p for part in r.partitions() for p in part.value]) == len(r.runs())
        return sorted(p for _, _, lo, hi in r.runs() for p in range(lo, hi)), len(left)

    assert asked(In(("page",), (3, 4, 77, 5000))) == ([3, 4, 77], 0)
    assert asked(EqualTo(("loc",), 41)) == ([10], 1)
    assert asked(GreaterThan(("page",), 5), LessThanOrEqual(("loc",), 39)) == ([6, 7, 8, 9], 1)
    assert asked(EqualTo(("page",), 5), EqualTo(("page",), 6)) == ([], 0)
    assert len(asked(EqualTo(("slot",), 1))[0]) == 104
    assert rows(pages.read_pages(spark, path).where("loc > 40 and loc < 43"), "page", "slot", "loc") == [(10, 1, 41), (10, 2, 42)]
    manifest = pages.PageReader({"path": path})
    for name, first, n in manifest.parts:
        if not first <= 50 < first + n:
            (tmp_path / name).unlink()
    assert pages.read_pages(spark, path).where("page = 50").count() == 4
    with pytest.raises(Exception, match="twice"):
        pages.save_pages(df.limit(2), layout.limit(2).withColumn("loc", F.lit(1)), str(tmp_path / "w.pages"), vpp=4)


def test_truncated_header(spark, tmp_path):
    path = tmp_path / "v.fbin"
    path.write_bytes(np.array([10, 2], "<u4").tobytes() + np.arange(8, dtype="<f4").tobytes())
    assert vecfiles.read_vectors(spark, str(path)).count() == 4


def test_truth_files(tables, spark, tmp_path):
    t = I.exact_knn(tables.q, tables.v, 5).withColumn("qid", F.expr("qid div 50"))
    vecfiles.save_truth(t, str(tmp_path / "gt.ibin"))
    got = vecfiles.read_truth(spark, str(tmp_path / "gt.ibin"))
    assert rows(got, "qid", "rank", "vec_id") == rows(t, "qid", "rank", "vec_id")
    assert all(abs(a["dist"] - b["dist"]) <= 1e-6 * b["dist"] for a, b in zip(got.orderBy("qid", "rank").collect(), t.orderBy("qid", "rank").collect()))


def test_metric_files(spark, tmp_path):
    df = spark.sql("SELECT timestamp'2024-01-01' AS ts, 1 AS node, 'x' AS type, explode(array(1.5D, double('NaN'), double('Infinity'))) AS value")
    metric_files.write_metrics(df, str(tmp_path / "m"))
    assert rows(metric_files.read_metrics(spark, str(tmp_path / "m")), "operator_id", "value") == [("1", 1.5)]
    lat = spark.createDataFrame([(2.0, 5, "ok", 1, 0.9), (1.0, 7, "unavailable", 1, 0.0)], metric_files.LATENCY)
    metric_files.write_latency(lat, str(tmp_path / "l"))
    assert rows(metric_files.read_latency(spark, str(tmp_path / "l")), "sched_ms") == [(1.0,), (2.0,)]


def test_rank_quantiles(spark):
    df = spark.createDataFrame([("a", i) for i in range(1, 101)] + [("b", 7)], "k string, us long")
    got = {r["k"]: (r["p50"], r["p99"], r["top"]) for r in metrics.rank_quantiles(df, ["k"], "us", {"p50": 0.5, "p99": 0.99, "top": 1.0}).collect()}
    assert got == {"a": (51, 100, 100), "b": (7, 7, 7)}


def test_arrivals(spark):
    assert arrivals.parse_steps("30:400,90:800") == [(30.0, 400.0), (90.0, 800.0)]
    with pytest.raises(ValueError):
        arrivals.parse_steps("90:1,30:2")
    df = arrivals.poisson(spark, [(0, 100.0), (10, 0.0), (20, 400.0)], 30.0, 7)
    n = {r["w"]: r["count"] for r in df.groupBy(F.floor(F.col("sched") / 10).alias("w")).count().collect()}
    assert 800 < n[0] < 1200 and 1 not in n and 3600 < n[2] < 4400
    order = [r["qid"] for r in df.orderBy("sched").collect()]
    assert order == [i % 7 for i in range(len(order))]
    tries = spark.createDataFrame([(1, 0.0, [(1.0, "unavailable"), (2.0, "unavailable"), (3.0, "ok")]), (2, 0.0, [(1.0, "unavailable")] * 4)], "qid int, sched_ms double, tries array<struct<ms:double,status:string>>")
    assert rows(arrivals.with_retries(tries), "qid", "latency_ms", "status", "attempts") == [(1, 21.0, "ok", 3), (2, 18.0, "unavailable", 3)]


def test_stream_equals_batch(spark, sf):
    got = rows(reports.drained(spark, f"{sf}/events.parquet"), "w", "type", "n", "busy_us")
    s = metrics.samples(spark.read.parquet(f"{sf}/events.parquet"))
    want = s.groupBy(F.unix_timestamp(F.date_trunc("day", "ts")).alias("w"), "type").agg(F.count("*").alias("n"), F.sum("us").alias("busy_us"))
    assert got == rows(want, "w", "type", "n", "busy_us")


def test_absent_stream(spark, tmp_path):
    for i, ids in enumerate([[1, 2, 2, 3], [3, 4]]):
        spark.createDataFrame([(x, f"d{x}") for x in ids], "loc long, data string").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    s = spark.readStream.schema("loc long, data string").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    reports.stream_absent(s, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "loc") == [(1,), (2,), (3,), (4,)]


def test_entry_without_llm(tmp_path):
    """The entry imports and has its own queries when the training-data subpackage is gone."""
    import pathlib
    import shutil
    import subprocess
    import sys

    repo = pathlib.Path(__file__).resolve().parents[1]
    shutil.copytree(repo, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q), len(e.oracle_sql()))"], cwd=tmp_path / "r", capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split()[1] == "False" and int(out.stdout.split()[0]) > 80


def test_options(tables):
    from spindrift import options

    for kind in (options.STRATEGIES, options.SELECTORS, options.POLICIES, options.PARTITIONERS, options.ARRIVALS, options.RATES, options.EPOCH_STORES):
        with pytest.raises(ValueError):
            options.option(kind, "no such")
    for kind, name in ((options.STRATEGIES, "proportional-quota"), (options.SELECTORS, "outsource"), (options.PARTITIONERS, "locality"), (options.EPOCH_STORES, "etcd")):
        with pytest.raises(Undecided):
            options.option(kind, name)()
    own = tables.own()
    assert {r["owner"] for r in options.SELECTORS["warmup"](own, [0, 1, 2], [1]).collect()} == {0, 2}
    assert {r["owner"] for r in options.SELECTORS["local"](own, 7).collect()} == {7}
    assert {r["owner"] for r in options.SELECTORS["warmup"](own, [1], [1]).collect()} == {1}


def test_owner_selector(spark):
    own = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 1, 3), (2, 0, 0, 3), (2, 1, 4, 3), (3, 0, 0, 1), (3, 1, 5, 2)], "qid long, pos int, list_id long, node int")
    pick = lambda *a: {r["qid"]: r["owner"] for r in D.pick_owner(own, *a).collect()}
    assert pick(1) == {1: 1, 2: 3, 3: 1} and pick(1, [1, 2]) == {1: 1, 2: 1, 3: 1} and pick(3) == {1: 3, 2: 3, 3: 3}


def test_synthetic(spark):
    from spindrift.sources.synthetic import mixture

    a = mixture(spark, 200, dim=32, clusters=20, parts=3)
    assert rows(a, "vec_id", "embedding") == rows(mixture(spark, 200, dim=32, clusters=20, parts=7), "vec_id", "embedding")
    assert a.select(F.max(F.array_max("embedding")), F.min(F.array_min("embedding"))).first()[0] <= 255


def test_recall_of_search(spark):
    """Mixture data, as a build with trained codewords: exhaustive re-ranking finds 95 % of the true neighbours."""
    from spindrift.sources.synthetic import mixture

    v = mixture(spark, 2000, dim=32, clusters=60).select("vec_id", V.quantised(F.col("embedding"), 1).alias("v")).cache()
    q = I.query_set(v)
    h = I.heads_of(v)
    cb = train.train_codebook(v, 16, codes=256, iterations=6)
    post = I.assign(v, h)
    f = I.filter_stage(I.gather(I.navigate(q, h, 32), post), I.encode(v, cb, 16), I.distance_tables(q, cb, 16), 200)
    truth = I.exact_knn(q, v, 10)
    assert D.recall(truth, I.rerank(f, v, q, 10), 10).first()["recall"] >= 0.95
    lay = I.bucket_layout(post.where("rank = 1"), 16)
    quick = I.heuristic_rerank(f, v, q, lay, 10)
    ids = quick.select("qid", F.explode("ids").alias("vec_id"))
    assert D.recall(truth, ids, 10).first()["recall"] >= 0.8
    v.unpersist()


def test_runs_from_another_folder(tmp_path):
    """Executors' Python finds the package although neither their folder nor PYTHONPATH has it."""
    import os
    import pathlib
    import subprocess
    import sys

    repo = str(pathlib.Path(__file__).resolve().parents[1])
    code = f"""
import sys; sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
print("ROWS", e.entry(s).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert "ROWS 100" in out.stdout, out.stderr[-2000:]


def test_rng_pruning(tables):
    post, heads = tables.post(), {r["list_id"]: np.array(r["hv"]) for r in tables.h.collect()}
    lists = {}
    for r in post.orderBy("vec_id", "rank").collect():
        lists.setdefault(r["vec_id"], []).append((r["list_id"], r["dist"]))
    want = []
    for v, ls in lists.items():
        kept = []
        for l, d in ls:
            if all(((heads[l] - heads[k]) ** 2).sum() > d for k, _ in kept):
                kept.append((l, d))
        want += [(v, l, i + 1) for i, (l, _) in enumerate(kept)]
    assert rows(I.prune_rng(post, tables.h), "vec_id", "list_id", "rank") == sorted(want)


def test_samples_repeat(tables):
    a = rows(train.sample_ids(tables.v, 40), "vec_id")
    assert a == rows(train.sample_ids(tables.v.repartition(7), 40), "vec_id") and len(a) == 40
    assert train.sample_ids(tables.v, 10**6).count() == tables.v.count()
    assert a != rows(train.sample_ids(tables.v, 40, seed=7), "vec_id")


def test_pinned_queries_stream(spark, tmp_path):
    """Pins and ends by node and epoch, as they arrive; an epoch is drained when its number is 0."""
    batches = [[(1, 1, 1), (1, 1, 1), (2, 1, 1)], [(1, 1, -1), (1, 2, 1)], [(1, 1, -1), (2, 1, -1)]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, "node int, epoch int, d int").coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
    s = spark.readStream.schema("node int, epoch int, d int").option("recursiveFileLookup", True).parquet(str(tmp_path))
    q = reports.pinned(s).writeStream.format("memory").queryName("pinned").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("pinned"), "node", "epoch", "pinned") == [(1, 1, 0), (1, 2, 1), (2, 1, 0)]


def test_command_line(spark, sf, tmp_path, capsys):
    from spindrift.__main__ import main

    base = f"{sf}/embeddings.parquet"
    main(["build", "--base", base, "--index", str(tmp_path / "ix")])
    main(["segment", "--index", str(tmp_path / "ix")])
    main(["gt", "--base", base, "--queries", base, "--k", "3", "--out", str(tmp_path / "gt")])
    main(["search", "--base", base, "--queries", base, "--index", str(tmp_path / "ix"), "--k", "3", "--out", str(tmp_path / "ans")])
    gt, ans = spark.read.parquet(str(tmp_path / "gt")), spark.read.parquet(str(tmp_path / "ans"))
    assert gt.count() == ans.count() == 1500
    assert D.recall(gt, ans, 3).first()["recall"] > 0.8
    with pytest.raises(ValueError):
        main(["search", "--k", "0"])
