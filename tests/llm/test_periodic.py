"""Run detection against plain loops."""

import hashlib
import random
import re
from zlib import crc32

import pytest

from spindrift.llm import periodic
from tests.llm.cases import documents, empty, rows_of


def brute(t, repeats=4, least=6):
    """Every maximal stretch of every period, without those whose words have a smaller one."""
    n, out = len(t), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and t[i] == t[i + q]:
                i += 1
            size = i + q - s
            if size >= 2 * q and not any(all(t[x] == t[x + r] for x in range(s, s + size - r)) for r in range(1, q)) and size >= max(least, repeats * q):
                out.add((s, size, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def odd_texts(rng):
    for _ in range(rng.randint(1, 6)):
        n, k = rng.randint(0, 60), rng.choice([1, 2, 2, 3, 5])
        t = [bytes([97 + rng.randrange(k)]) for _ in range(n)]
        if n and rng.random() < 0.5:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, n - a))
            t = t[:a] + [t[a + (i - a) % p] for i in range(a, n)]
        yield t


@pytest.mark.parametrize("repeats, least", [(4, 6), (2, 2), (3, 1)])
def test_runs(repeats, least, monkeypatch):
    rng = random.Random(repeats)
    for turn in range(300):
        monkeypatch.setattr(periodic, "LEAVES", 7 if turn % 2 else 1 << 21)
        texts = list(odd_texts(rng))
        assert periodic._block(texts, repeats, least) == [brute(t, repeats, least) for t in texts], texts


def test_strings_of_fibonacci():
    """Dense in repeats: all runs of two periods of the first 377 letters."""
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 377:
        a, b = b, b + a
    assert periodic._block([b], 2, 2) == [brute(b, 2, 2)]
    assert periodic._block([[b"x"] * 100_000], 4, 6) == [[(0, 100_000, 1)]]


def want(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words) if len(set(words)) < 2000 else []
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))


COLS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
key = lambda r: tuple((x is None, str(x)) for x in r)


def test_odd_rows(spark):
    docs = documents(spark)
    docs = docs.where("length(text) < 9000 or text is null")
    got = rows_of(periodic.query(docs), *COLS)
    assert sorted(got, key=key) == sorted((want(r["doc_id"], r["text"]) for r in docs.collect()), key=key)
    assert periodic.query(empty(spark)).count() == 0


def test_altered_rows(spark):
    """Ids whose remainder is zero get their repetition; string ids are hashed as they are."""
    rng = random.Random(5)
    ids = [i for i in range(4000) if crc32(str(i).encode()) % 10 == 0][:60] + list(range(40))
    texts = ["  " * (i % 3) + " ".join(rng.choice(["a", "b", "c", "dd", "漢", "e\x0bf"]) for _ in range(rng.randint(0, 90))) for i in ids]
    rows = list(zip(ids, texts))
    got = rows_of(periodic.query(spark.createDataFrame(rows, "doc_id long, text string")), *COLS)
    assert sorted(got, key=key) == sorted((want(*r) for r in rows), key=key)
    assert sum(r[1] > 0 for r in got) > 10
    named = rows_of(periodic.query(spark.createDataFrame([(str(i), t) for i, t in rows], "doc_id string, text string")), *COLS)
    assert sorted(named, key=key) == sorted((want(str(i), t) for i, t in rows), key=key)


def test_spans_and_ties(spark):
    rows = [(1, "a b a b a b a b c c c c c c x"), (3, "z " * 6 + "y " * 6), (7, "none here"), (9, None)]
    got = {r["doc_id"]: r for r in periodic.detect(spark.createDataFrame(rows, "doc_id long, text string"), spans=True).collect()}
    assert [tuple(x) for x in got[1]["runs"]] == [(0, 8, 2), (8, 6, 1)] and got[1]["collapsed"] == "a b c x"
    assert (got[1]["start"], got[1]["exponent_milli"]) == (8, 6000)
    assert got[3]["start"] == 0 and got[3]["collapsed"] == "z y"
    assert got[7]["runs"] == [] and got[9]["collapsed"] == ""


def test_blocks_and_long_texts(spark, monkeypatch):
    """A text of 400,000 words that repeats; texts dealt over many blocks."""
    rng = random.Random(3)
    part = [str(rng.randrange(10**6)) for _ in range(40_000)]
    got = periodic.detect(spark.createDataFrame([(1, " ".join(part * 10)), (2, "a"), (3, " ".join(part))], "doc_id long, text string")).collect()
    assert [(r["n_runs"], r["start"], r["length"], r["period"]) for r in got] == [(1, 0, 400_000, 40_000), (0, None, None, None), (0, None, None, None)]
    assert got[0]["collapsed_sha256"] == hashlib.sha256(" ".join(part).encode()).hexdigest()
