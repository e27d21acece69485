"""Node stores as tables against the driver's store, entry by entry; epochs in a shared folder; bounds of an index."""

import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import index, metrics, placement, ranking, stores
from spindrift.streaming import arrivals
from spindrift.undecided import PQFull, RawAbsent
from tests.model import CodeStore


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_states_follow_the_store(spark, seed):
    rnd, log, store = random.Random(seed), [], {0: CodeStore(100), 1: CodeStore(100)}
    for seq in range(600):
        node, i, op = rnd.randrange(2), rnd.randrange(25), rnd.choice(stores.OPS)
        s = store[node]
        if op == "put":
            s.put({i: b"x"})
        elif op == "reserve":
            s.reserve([i])
        elif op == "ref" and i in s.held:
            s.ref([(i, i)])
        elif op == "unref" and s.refs[i]:
            s.unref([i])
        elif op == "release" and i in s.held:
            s.release_staged([i])
        else:
            continue
        log.append((node, i, seq, op))
    df = spark.createDataFrame(log + [(0, None, 900, "put"), (1, 3, 901, "other")], "node int, vec_id long, seq long, op string")
    states = stores.code_states(df)
    assert rows(states, "node", "vec_id", "refs", "state") == sorted((n, i, s.refs[i], s.state(i)) for n, s in store.items() for i in s.held)
    cols = ("resident", "live", "staged", "cached")
    assert rows(stores.code_stats(states), "node", *cols) == [(n, *(s.stats()[c] for c in cols)) for n, s in store.items()]


@pytest.mark.parametrize("seed", range(4))
def test_admission_under_a_capacity(spark, seed):
    """Against the store kept entry by entry, whose cached codes go in the order in which they were last used."""
    rnd = random.Random(seed)
    states, asked, slots, want = [], [], [], []
    for node in range(6):
        held = rnd.sample(range(40), rnd.randrange(25))
        use = {i: rnd.randrange(5) for i in held}
        s = CodeStore(capacity := len(held) + rnd.randrange(-3, 12))
        for i in sorted(held, key=lambda i: (use[i], i)):
            kind = rnd.choice(["live", "staged", "cached"])
            states.append((node, i, kind, use[i]))
            s.held[i] = {"code": b"", "protected": kind == "staged", "ever": True, "loc": None}
            s.refs[i] = int(kind == "live")
        new = [rnd.randrange(60) for _ in range(rnd.randrange(20))]
        asked += [(node, i) for i in new] + ([(node, new[0])] if new else [])
        slots.append((node, capacity))
        before = set(s.held)
        try:
            s.put([(i, b"") for i in new])
            want += [(node, i, "install") for i in set(s.held) - before] + [(node, i, "evict") for i in before - set(s.held)]
        except PQFull:
            want += [(node, i, "refuse") for i in set(new) - before]
    got = stores.admitted(spark.createDataFrame(states, "node int, vec_id long, state string, used long"), spark.createDataFrame(asked, "node int, vec_id long"), spark.createDataFrame(slots, "node int, slots long"))
    assert rows(got, "node", "vec_id", "change") == sorted(want)


def test_writers_that_compete(spark, tmp_path):
    """Each of 20 writers installs its table once, from the one before it; of those that started from one epoch, one was first."""
    from concurrent.futures import ThreadPoolExecutor

    made = []

    def one(name):
        def make(now):
            made.append((name, now["epoch"] if now else 0))
            return {"owners": (now["owners"] if now else []) + [name]}

        return stores.EpochLog(spark, str(tmp_path / "log")).commit(make)["epoch"]

    with ThreadPoolExecutor(10) as pool:
        epochs = list(pool.map(one, range(20)))
    log = stores.EpochLog(spark, str(tmp_path / "log"))
    assert sorted(epochs) == log.epochs() == list(range(1, 21))
    for a, b in zip([{"owners": []}, *log.history()], log.history()):
        assert b["owners"][:-1] == a["owners"]
    assert sorted(log.current()["owners"]) == list(range(20)) and len(made) >= 20
    with pytest.raises(stores.Conflict):
        log.compare_and_swap(3, {"epoch": 4, "owners": [1]})


def test_drains_of_a_stream(spark, tmp_path):
    """Rows in several runs of one checkpoint: an epoch that opens again is told again, what is too late is dropped."""
    from spindrift.streaming import drains

    minute, first = 60_000_000, 1_000_000  # minutes are counted from a time after that of the first watermark
    schema = "node long, epoch long, ts timestamp, done_us long"

    def run(*found):
        at = lambda m: f"timestamp_micros({(first + m) * minute})"
        sql = " UNION ALL ".join(f"SELECT {n}L AS node, {e}L AS epoch, {at(t)} AS ts, {(first + d) * minute}L AS done_us" for n, e, t, d in found)
        spark.sql(sql).write.mode("append").parquet(str(tmp_path / "in"))
        drains.run(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), "10 minutes").awaitTermination()
        return sorted((r["node"], r["epoch"], r["done_us"] // minute - first) for r in spark.read.schema(drains.OUT).parquet(str(tmp_path / "out")).collect())

    assert run((1, 1, 0, 5), (1, 1, 1, 3), (1, 2, 2, 30), (2, 1, 3, 4)) == []
    assert run((2, 2, 20, 21)) == [(1, 1, 5), (2, 1, 4)]
    again = run((1, 1, 12, 13), (1, 2, 40, 41), (2, 1, 1, 60))  # 12 is late but within the delay; 1 is dropped
    assert set(again) == {(1, 1, 5), (2, 1, 4), (1, 1, 13), (2, 2, 21)}
    end = run((9, 9, 900, 901))
    assert set(end) == set(again) | {(1, 2, 41)}
    table = spark.read.schema(drains.OUT).parquet(str(tmp_path / "out"))
    assert rows(drains.drained(spark, table), "epoch", "drained_us") == [(1, (first + 13) * minute), (2, (first + 41) * minute)]


def test_drains_keep_few_entries(spark, sf, tmp_path, monkeypatch):
    """The drain times of many nodes, one of them null: the state is asked for an epoch of a group of nodes, not of a node."""
    from spindrift.plans import registry
    from spindrift.streaming import drains

    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("user_id", F.when(F.col("event_id") % 7 > 0, F.col("event_id")))
    e.write.parquet(str(tmp_path / "events.parquet"))
    keys, run = [], drains.run
    monkeypatch.setattr(drains, "run", lambda pinned, out, *a: keys.append(out) or run(pinned, out, *a))
    got = rows(registry.QUERIES["T8_stream_drains"](spark, str(tmp_path)), "epoch", "drained_us")
    assert got == rows(registry.QUERIES["M17_drain_times"](spark, str(tmp_path)), "epoch", "drained_us")
    assert spark.read.parquet(keys[0].removesuffix("out") + "in").where("node >= 0").select("node").distinct().count() <= 64


def test_event_log_batches(spark, tmp_path):
    """At most so many rows a batch, over files and row groups, across a restart and files that come later; each row once."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from spindrift.sources.event_log import stream

    put = lambda name, lo, hi: pq.write_table(pa.table({"user_id": pa.array(range(lo, hi), "int64"), "other": ["x"] * (hi - lo)}), tmp_path / "in" / name, row_group_size=7)
    (tmp_path / "in").mkdir()
    put("a.parquet", 0, 25)
    put("b.parquet", 25, 40)

    def run():
        seen = lambda df, n: df.selectExpr("user_id", f"{n} AS batch").write.mode("append").parquet(str(tmp_path / "out"))
        q = stream(spark, str(tmp_path / "in"), str(tmp_path / "position"), 10, "user_id long").writeStream.foreachBatch(seen).option("checkpointLocation", str(tmp_path / "state")).start()
        q.processAllAvailable()
        q.stop()
        return rows(spark.read.parquet(str(tmp_path / "out")), "batch", "user_id")

    got = run()
    assert got == [(i // 10, i) for i in range(40)]
    assert run() == got
    put("c.parquet", 40, 63)
    got = run()
    assert sorted(u for _, u in got) == list(range(63))
    assert max(sum(b == n for b, _ in got) for n in range(9)) <= 20


def test_states_of_an_empty_log(spark):
    assert stores.code_states(spark.createDataFrame([], "node int, vec_id long, seq long, op string")).count() == 0


def test_raw_store(spark):
    have = spark.createDataFrame([(1, "index", 10)], "loc long, origin string, data long")
    batch = spark.createDataFrame([(2, "streamed", 21, 5), (2, "fetched", 20, 4), (1, "streamed", 11, 1), (3, "fetched", 30, 9)], "loc long, origin string, data long, seq long")
    now = stores.raw_put(have, batch)
    assert rows(now, "loc", "origin", "data") == [(1, "index", 10), (2, "fetched", 20), (3, "fetched", 30)]
    assert rows(stores.raw_put(now, batch), "loc", "origin", "data") == rows(now, "loc", "origin", "data")
    assert rows(stores.raw_missing(batch, have), "loc") == [(2,), (3,)]
    assert rows(stores.raw_get(batch.select("loc"), now), "loc", "data") == [(1, 10), (2, 20), (2, 20), (3, 30)]
    with pytest.raises(RawAbsent):
        stores.raw_get(batch.select("loc"), have)
    assert stores.in_range(batch, "loc", 4).count() == 4
    with pytest.raises(Exception, match="out of range"):
        stores.in_range(batch, "loc", 3).collect()


def test_load_and_evict(spark):
    r = spark.createDataFrame([(0, 1), (0, 2)], "node int, part int")
    more = spark.createDataFrame([(0, 2), (1, 5)], "node int, part int")
    assert rows(stores.load(r, more), "node", "part") == [(0, 1), (0, 2), (1, 5)]
    assert rows(stores.evict(r, more), "node", "part") == [(0, 1)]


def test_epoch_log(spark, tmp_path):
    a, b = stores.EpochLog(spark, f"{tmp_path}/epochs"), stores.EpochLog(spark, f"{tmp_path}/epochs")
    assert a.current() is None
    a.compare_and_swap(0, {"epoch": 1, "owners": [1, 1, 2]})
    with pytest.raises(ValueError):
        b.compare_and_swap(0, {"epoch": 1, "owners": [2]})
    b.compare_and_swap(1, {"epoch": 2, "owners": [2, 2, 2]})
    for previous, table in ((2, {"epoch": 4, "owners": [1]}), (2, {"epoch": 3, "owners": []}), (1, {"epoch": 2, "owners": [1]})):
        with pytest.raises(ValueError):
            a.compare_and_swap(previous, table)
    assert a.current() == {"epoch": 2, "owners": [2, 2, 2]} and a.epochs() == [1, 2] and [t["epoch"] for t in b.history()] == [1, 2]


def test_registry_of_nulls(spark):
    df = spark.sql("SELECT * FROM VALUES (1L, timestamp'2020-01-01 00:00:01', 'a', cast(null as long)), (2L, timestamp'2020-01-02 00:00:01', 'a', 500L), (3L, timestamp'2020-01-02 00:00:02', 'a', 1L) t(event_id, ts, type, us)")
    got = {(str(r["w"])[:10], r["type"]): r["value"] for r in metrics.registry(df).collect()}
    assert ("2020-01-01", "latency.a.p50_us") not in got and got["2020-01-01", "latency.a.count"] == 0 and got["2020-01-01", "latency.a.last_us"] is None
    assert got["2020-01-02", "queries.a"] == 3 and got["2020-01-02", "latency.a.p50_us"] == 1.0 and got["2020-01-02", "latency.a.max_us"] == 500 and got["2020-01-02", "latency.a.p999_us"] == 500


def test_runs_over_borders(spark):
    ids = [0, 1, 2, 3, 4, 7, 8, 9, 15, 16, 17, 23, 24, 31, 33, -1, -2, -5]
    df = spark.createDataFrame([("a", i) for i in ids] + [("b", 8), ("b", 8), ("b", 9), ("b", None)], "k string, id long")
    for width in (2, 4, 8, 100):
        got = rows(ranking.runs(df, "k", "id", width), "k", "lo", "hi", "n")
        assert got == [("a", -5, -5, 1), ("a", -2, 4, 7), ("a", 7, 9, 3), ("a", 15, 17, 3), ("a", 23, 24, 2), ("a", 31, 31, 1), ("a", 33, 33, 1), ("b", 8, 9, 3)]


@pytest.mark.parametrize("eps,beta", [(0.1, 1), (0.5, 2), (0.0, 3)])
def test_heuristic_stops_as_the_rule_says(spark, eps, beta):
    rnd, k, n = random.Random(7), 4, 30
    vectors = [(i, [rnd.randrange(50), rnd.randrange(50)]) for i in range(60)]
    queries = [(i, [rnd.randrange(50), rnd.randrange(50)]) for i in range(5)]
    filtered = [(q, i, r + 1) for q, _ in queries for r, i in enumerate(rnd.sample(range(60), n if q else 3))]
    got = index.heuristic_rerank(
        spark.createDataFrame(filtered, "qid long, vec_id long, rank int"), spark.createDataFrame(vectors, "vec_id long, v array<long>"), spark.createDataFrame(queries, "qid long, qv array<long>"),
        spark.createDataFrame([(i, i // 3) for i, _ in vectors], "vec_id long, page long"), k, eps=eps, beta=beta,
    )
    for r in got.collect():
        mine = [i for q, i, _ in filtered if q == r["qid"]]
        qv, best, streak, seen = queries[r["qid"]][1], [], 0, 0
        for b in range(0, len(mine), k):
            old, batch = set(best), mine[b : b + k]
            best = sorted(best + batch, key=lambda i: (sum((x - y) ** 2 for x, y in zip(qv, vectors[i][1])), i))[:k]
            seen += len(batch)
            streak = streak + 1 if len(best) >= k and len(set(best) - old) <= eps * k else 0
            if streak >= beta:
                break
        assert r["ids"] == best and r["reranked"] == seen and r["batches"] == -(-seen // k) and r["pages_read"] == len({i // 3 for i in mine[:seen]})


def test_arrivals_within_slices(spark):
    df = arrivals.poisson(spark, [(0.5, 2000.0), (1.25, 0.0), (1.75, 4000.0)], 2.5, 5, slice_s=0.75)
    got = [r["sched"] for r in df.collect()]
    count = lambda a, b: sum(a <= x < b for x in got)
    assert count(0, 0.5) == count(1.25, 1.75) == 0 and count(0, 2.5) == len(got)
    assert 1300 < count(0.5, 1.25) < 1700 and 2700 < count(1.75, 2.5) < 3300
    assert sorted(got) == sorted(r["sched"] for r in arrivals.poisson(spark, [(0.5, 2000.0), (1.25, 0.0), (1.75, 4000.0)], 2.5, 5, slice_s=0.75).repartition(3).collect())
