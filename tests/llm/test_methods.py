"""The methods by themselves, against definitions."""

import random

import numpy as np
import pytest

from spindrift.llm import bpe, bwt, matroska, topk, toxicity, warc
from tests.llm.cases import rows_of


def naive_suffixes(strings):
    order = sorted(((tuple(s[o:]), i, o) for i, s in enumerate(strings) for o in range(len(s) + 1)), key=lambda x: (x[0], x[1]))
    prefix = [0]
    for (a, *_), (b, *_) in zip(order, order[1:]):
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        prefix.append(k)
    return [(i, o) for _, i, o in order], prefix


@pytest.mark.parametrize("seed,shard", [(1, 2), (2, 3), (3, 100), (4, 1)])
def test_merged_transforms(seed, shard):
    rng = random.Random(seed)
    strings = [np.array([rng.randint(1, 3) for _ in range(rng.randint(0, 12))], "int64") for _ in range(9)]
    strings[4] = strings[2]
    s, o, p = bwt.merged_order(strings, shard)
    want, prefix = naive_suffixes([s.tolist() for s in strings])
    # suffixes that are equal to their end are ordered by string, as ends are
    assert list(zip(s.tolist(), o.tolist())) == want
    assert p.tolist()[1:] == prefix[1:]


def naive_segments(s):
    def rec(a, b):
        best = None
        for i in range(a, b):
            t = 0.0
            for j in range(i, b):
                t += s[j]
                if t > 0 and (best is None or t > best[2] + 1e-12):
                    best = (i, j + 1, t)
        return [] if best is None else rec(a, best[0]) + [best] + rec(best[1], b)

    return rec(0, len(s))


def test_segments():
    rng = random.Random(5)
    for _ in range(300):
        s = [rng.uniform(-3, 3) for _ in range(rng.randint(0, 14))]
        got = toxicity.segments(np.array(s))
        want = naive_segments(s)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]


def test_lambda():
    s, p = np.array([1.0, -1.0]), np.array([0.25, 0.75])
    assert toxicity._lambda(s, p) == pytest.approx(np.log(3))


def test_bpe_merges_match_naive():
    t = bpe.tokenizer(bpe.vocabulary_path("byte_bpe_50k.json"))

    def naive(data):
        ids = [t.byte_id[b] for b in data]
        while True:
            best = min(((t.pairs[a << 32 | b][0], i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if a << 32 | b in t.pairs), default=None)
            if best is None:
                return ids
            i = best[1]
            ids[i : i + 2] = [t.pairs[ids[i] << 32 | ids[i + 1]][1]]

    rng = random.Random(6)
    for n in [0, 1, 2, 3, 5, 8, 13, 40, 200]:
        for _ in range(10):
            w = bytes(rng.choice(b"etaoin shr") for _ in range(n))
            assert t.merge(w) == naive(w)
    assert t.decode(b"\xff\xff\xff\x7f") == ""


@pytest.mark.parametrize("lacing", [0, 1, 2, 3])
def test_lacings(lacing):
    data = bytes(random.Random(7).randrange(256) for _ in range(576 * 19))
    media = matroska.write_pcm(data, lacing=lacing)
    m = matroska.parse(media)
    assert b"".join(media[o : o + s] for _, _, o, s, _ in m.packets) == data
    assert [t for _, t, *_ in m.packets] == [i * 72_000_000 for i in range(19)]
    assert m.tracks[1]["codec"] == "A_PCM/INT/LIT" and m.cues and m.clusters


def test_uneven_laces_and_groups():
    M = matroska
    frames = [b"a" * 700, b"b" * 3, b"c" * 255, b"d" * 60]
    for lacing in (M.XIPH, M.EBML_LACE):
        body = b"\x81" + (5).to_bytes(2, "big") + bytes([lacing << 1]) + M.laced(frames, lacing)
        group = M.element(M.GROUP, M.element(M.BLOCK, body) + M.element(M.REFERENCE, b"\x01"))
        # a cluster of unknown size, ended by the cues
        cluster = M.CLUSTER.to_bytes(4, "big") + b"\x01\xff\xff\xff\xff\xff\xff\xff" + M.number(M.TIMECODE, 10) + group
        seg = M.SEGMENT.to_bytes(4, "big") + b"\xff" + cluster + M.element(M.CUES, b"")
        media = M.element(M.EBML, M.element(M.DOCTYPE, b"matroska")) + seg
        m = M.parse(media)
        assert [media[o : o + s] for _, _, o, s, _ in m.packets] == frames
        assert m.packets[0][1] == 15_000_000 and not m.packets[0][4]
    with pytest.raises(ValueError):
        M.parse(M.write_pcm(b"\0" * 576)[:-30])
    with pytest.raises(ValueError):
        M.parse(b"not a file")


@pytest.mark.parametrize("version", [1, 2])
def test_arc(version):
    date = "20010203040506"
    blob = warc.arc_opening("x.arc", date, version)
    blocks = [b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\n\n", b"", b"plain"]
    for i, b in enumerate(blocks):
        blob += warc.arc_record(f"http://h/{i}", date, "text/html", b, version)
    got = list(warc.parse_arc(blob))
    assert [b for _, b in got] == blocks
    records = b"".join(warc.convert(f, b) for f, b in got)
    back = list(warc.parse_warc(records))
    assert [b for _, b in back] == blocks
    h = back[0][0]
    assert h["WARC-Date"] == "2001-02-03T04:05:06Z" and h["WARC-Payload-Digest"] == "sha1:" + warc.digest(b"body\n\n")
    again = dict(next(warc.parse_warc(warc.convert(*got[0], "5", ("2", "<urn:x>"))))[0])
    assert again["WARC-Type"] == "revisit" and again["WARC-Refers-To"] == "<urn:x>"
    with pytest.raises(ValueError):
        list(warc.parse_arc(blob[:-3]))


def test_topk(spark):
    rng = np.random.default_rng(8)
    v = {i: (rng.integers(-3, 4, 6) / 8).tolist() for i in range(300)}
    v[50], v[100] = v[7], v[7]
    odd = [(401, None), (402, []), (403, [1.0] * 5 + [None]), (404, [float("nan")] * 6), (405, [float("inf")] * 6), (None, v[1]), (450, [0.5, 0.5]), (451, [0.25, 1.0])]
    again = [(7, v[7]), (7, v[8]), (50, v[50]), (50, v[9]), (100, v[100]), (100, v[100])]  # ids that several rows share
    df = spark.createDataFrame([(i, x, 0, "k", 1) for i, x in [*v.items(), *odd, *again]], "vec_id long, embedding array<double>, score int, tag string, dims int")
    rows = [(i, np.floor(np.array(x) * 256).astype(int)) for i, x in [*v.items(), (450, [0.5, 0.5]), (451, [0.25, 1.0]), *again]]
    want = []
    for a, (i, x) in enumerate(rows):
        if i % 50 == 0:
            s = sorted((-int(x @ y), j) for b, (j, y) in enumerate(rows) if b != a and len(y) == len(x))[:5]
            want += [(i, r + 1, j, -y) for r, (y, j) in enumerate(s)]
    assert sorted(rows_of(topk.query(df))) == sorted(want)
    q = topk.quantised(df)
    small = topk.search(q.where("vec_id % 50 = 0"), q, 5, row_block=16, query_block=2)
    assert sorted(rows_of(small.select("query_id", "rank", "vec_id", "score"))) == sorted(want)
    assert topk.query(df.limit(0)).count() == 0


def test_topk_large_numbers():
    ids, rows = np.arange(4), np.array([[2.0**60, 1], [2.0**59, 3], [-(2.0**60), 0], [0, 5]])
    got = topk.Lists(ids, rows).search(np.array([[2.0**10, 1.0]]), np.array([9]), 2)
    assert got[0][1].tolist() == [0, 1] and got[0][3].tolist() == [2**63 - 1, 2**63 - 1]


@pytest.mark.parametrize("dims,n,high", [(64, 3000, 200), (3, 500, 3), (8, 40, 10**6), (1, 9, 2), (64, 3000, 2**20)])
def test_topk_stops_early(dims, n, high):
    """Whole scores whatever was read, and less than all is read where the vectors have many dimensions or copies."""
    rng = np.random.default_rng(9)
    rows = np.floor(rng.normal(0, high / 4, (n, dims)))
    rows[: n // 4] = rows[0]
    lists = topk.Lists(np.arange(n), rows)
    asked = rows[[0, n // 2, n - 1]]
    for j, ids, _, scores, share in lists.search(asked, np.array([0, n // 2, n - 1]), 5):
        all_scores = rows @ asked[j]
        all_scores[[0, n // 2, n - 1][j]] = -np.inf
        best = np.lexsort((np.arange(n), -all_scores))[:5]
        assert ids.tolist() == best.tolist() and scores.tolist() == all_scores[best].tolist()
        assert share <= 1
    rows = np.zeros((2000, 4))
    rows[:, 0] = rng.permutation(2000)
    wide = np.floor(rng.normal(0, 32, (3000, 64)))
    assert all(share < 1 for *_, share in topk.Lists(np.arange(3000), wide).search(wide[:5], np.arange(5), 5))
    got = topk.Lists(np.arange(2000), rows).search(np.array([[1.0, 0, 0, 0]]), np.array([-1]), 5)
    assert got[0][4] <= 0.5 and (rows[got[0][1], 0] == np.arange(1999, 1994, -1)).all()


def test_toxic_passages_further_on():
    """A passage counts in full wherever its words came before; repetition alone makes none."""
    bad = ["moron", "loser", "trash", "idiot"]
    m = toxicity.Model({w + "\n": (0, 50) for w in bad}, 1000, 100)

    def passages(words):
        return [(a, b) for a, b, _ in m.facts(m.tokens(" ".join(words)))[1]]

    gap = ["plain"] * 200
    assert passages([*bad, *gap, *bad]) == [(0, 4), (204, 208)]
    assert passages([*gap, *bad, *gap, *reversed(bad), *gap, *bad]) == [(200, 204), (404, 408), (608, 612)]
    apart = [x for w in bad for x in (w, *gap)]  # each word by itself first
    assert passages([*apart, *gap * 90, *bad]) == [(18804, 18808)]
    assert passages([*bad, *bad]) == [(0, 4)]
    assert passages(["moron"] * 500) == [] and passages([x for _ in range(500) for x in ("moron", "plain")]) == []
    # the peak that a repeat is held against, by definition
    rng = random.Random(12)
    for _ in range(200):
        words = rng.choices([*bad, "plain"], [1, 1, 1, 1, rng.choice([2, 20, 60])], k=rng.randint(0, 300))
        got, sums, last = m.tokens(" ".join(words)), [], {}
        for i, w in enumerate(words):
            s, before = m.quick(w), sums[-1] if sums else 0.0
            if w in bad:
                if w in last and before + s > max(sums[last[w] :]):
                    s = -m.drift
                else:
                    last[w] = i
            assert got[i] == s
            sums.append(before + s)


def test_toxicity_held_out(spark):
    from spindrift.llm.common import table

    sf = "/root/testdata/sf0.1"
    p = toxicity.query(table(spark, sf, "documents"), table(spark, sf, "labels")).join(table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    hit = ((p["predicted"] == 1) & (p["toxic"] == 1)).sum()
    assert hit / (p["toxic"] == 1).sum() > 0.75 and hit / (p["predicted"] == 1).sum() > 0.75


def test_unsigned_crc(spark):
    assert rows_of(spark.sql("SELECT crc32('17') % 4 AS x")) == [(__import__("zlib").crc32(b"17") % 4,)]
