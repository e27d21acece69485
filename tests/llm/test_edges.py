"""Every dealt operator and pipeline stage on odd inputs, against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from spindrift.llm import bpe, bwt, jaccard, linededup, matroska, mixing, toxicity, unigram, warc
from tests.llm.cases import documents, empty, rows_of

key = lambda r: tuple((x is None, str(x)) for x in r)


def same(got, want):
    assert sorted(got, key=key) == sorted(want, key=key)


def plain(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_bpe(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json"))
    docs = documents(spark)
    want = []
    for d, x in plain(docs):
        ids = t.encode(x or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    same(rows_of(bpe.query(docs)), want)
    assert bpe.query(empty(spark)).count() == 0


def test_unigram(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = bpe.vocabulary_path("piece_bpe_32k.model")
    t = Tokenizer(models.Unigram(unigram.piece_scores(path), unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    docs = documents(spark)
    same(rows_of(unigram.query(docs), "doc_id", "n_tokens"), [(d, len(t.encode(x or "", add_special_tokens=False).ids)) for d, x in plain(docs)])
    assert unigram.query(empty(spark)).count() == 0


def test_unigram_ties():
    from tokenizers import Tokenizer, models

    vocab = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("c", -5.0)]
    t, c = Tokenizer(models.Unigram(vocab, unk_id=0)), unigram.Counter(vocab)
    for w in ("abab", "ababa", "axxb", "xx", "cab", "bababab"):
        assert c.word(w)[0] == len(t.encode(w).ids), w


def test_matroska(spark):
    docs = documents(spark)
    got = {r["payload_sha256"]: r for r in matroska.query(docs).collect()}
    for _, x in plain(docs):
        raw = (x or "").encode()
        pad = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got[hashlib.sha256(pad).hexdigest()]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(pad), zlib.crc32(pad[-32:]))
        media = matroska.write_pcm(pad)
        assert (hashlib.sha256(media).hexdigest(), len(media)) == (r["media_sha256"], r["media_bytes"])
        n = len(pad) // 576
        laces, clusters = -(-n // 8), -(-n // (8 * 48))
        assert r["feature"] == f"A_PCM/INT/LIT;8000Hz;8bit;packets={n};clusters={clusters};cues={clusters};ms={n * 72};sum={sum(pad)};peak=255", laces
    same(rows_of(matroska.query(docs), "doc_id", "n_bytes"), [(d, len((x or "").encode())) for d, x in plain(docs)])
    assert matroska.query(empty(spark)).count() == 0
    assert matroska.packets(matroska.store(docs.limit(3))).count() > 0


def test_warc(spark):
    rows = [(1, "http://a/x y", "<p>1</p>", 0), (2, None, "<p>1</p>", 0), (3, "http://b/", None, 0), (4, "http://b/", "", 0), (5, "http://c/", "é" * 9000, 0), (1, "http://a/x y", "<p>1</p>", 0), (None, "http://d/", "<p>1</p>", 0), (None, "http://d/", "only", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha int")
    got = rows_of(warc.query(pages), "page_id", "payload_bytes", "record_type", "refers_to")
    want = [(1, 8, "response", None), (1, 8, "response", None), (2, 8, "revisit", 1), (3, 0, "response", None), (4, 0, "revisit", 3), (5, 18000, "response", None), (None, 8, "revisit", 1), (None, 4, "response", None)]
    same(got, want)
    assert warc.query(pages.limit(0)).count() == 0


def brute_repeats(docs, length=400):
    raw = [(d, x, (x or "").encode()) for d, x in docs]
    seen = Counter(r[i : i + length] for _, _, r in raw for i in range(len(r) - length + 1))
    out = []
    for d, _, r in raw:
        cover = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        kept = bytes(x for x, c in zip(r, cover) if not c)
        out.append((d, len(r), sum(cover), len(re.findall(b"\1+", cover)), hashlib.sha256(kept).hexdigest(), len(kept), kept.decode("utf-8", "replace")))
    return out


@pytest.mark.parametrize("hot,bucket", [(1024, 2048), (1, 4), (3, 2)])
def test_repeats(spark, hot, bucket, monkeypatch):
    monkeypatch.setattr(bwt.repeats, "__defaults__", (bucket, hot))
    docs = documents(spark)
    same(rows_of(bwt.query(docs)), brute_repeats(plain(docs)))
    assert bwt.query(empty(spark)).count() == 0


def brute_lines(docs, width=3):
    split = {k: k[1].split("\n") for k in docs if k[1] is not None}
    first = {}
    order = lambda d: (d is not None, d)
    for (d, x), lines in split.items():
        for i in range(len(lines) - width + 1):
            w = tuple(lines[i : i + width])
            at = (order(d)[0], d or 0, x, i)
            if w not in first or at[:2] < first[w][:2] or at[:2] == first[w][:2] and at[2] == first[w][2] and i < first[w][3]:
                first[w] = at
    out = {}
    for (d, x), lines in split.items():
        gone = set()
        for i in range(len(lines) - width + 1):
            w = tuple(lines[i : i + width])
            if w in first:
                f = first[w]
                if (f[0], f[1], f[2]) != (*order(d)[:1], d or 0, x) or i >= f[3] + width:
                    gone |= set(range(i, i + width))
        out[d, x] = "\n".join(s for i, s in enumerate(lines) if i not in gone)
    return out


def test_lines(spark):
    docs = documents(spark)
    want = brute_lines(set(plain(docs)))
    got = linededup.dedup(docs)
    assert got.columns == [*docs.columns, "__removed", "__kept"]
    assert rows_of(got.where("text is null"), "__removed", "__kept") == [(0, 0)] * 2
    back = sorted(rows_of(got, "doc_id", "text"), key=key)
    assert back == sorted([(d, None if x is None else want[d, x]) for d, x in plain(docs)], key=key)
    assert sum(r["__removed"] > 0 for r in got.collect()) >= 3
    assert linededup.query(empty(spark)).count() == 0


def test_repeats_that_cut_characters(spark):
    """What remains of a character is replaced in text; the digest is of the bytes."""
    body = "".join(chr(97 + i * i % 23) for i in range(397))
    docs = spark.createDataFrame([(1, "é" + body + "é1"), (2, "è" + body + "è2"), (3, "x")], "doc_id long, text string")
    got = rows_of(bwt.query(docs))
    same(got, brute_repeats(plain(docs)))
    assert {r[0]: r[2] for r in got} == {1: 0, 2: 0, 3: 0}
    docs = spark.createDataFrame([(1, "é" + body * 2 + "é1"), (2, "é" + body * 2 + "è2")], "doc_id long, text string")
    got = rows_of(bwt.query(docs))
    same(got, brute_repeats(plain(docs)))
    assert {r[6] for r in got} == {"\ufffd1", "\ufffd2"}


def test_words_without_structure_collide(spark):
    """The word of Thue and Morse and its complement have equal sums under any polynomial modulo 2^64; they share no shingle."""
    rows = []
    for k in (10, 11, 16):
        word = [bin(i).count("1") & 1 for i in range(1 << k)]
        rows += [(2 * k, "".join("ab"[x] for x in word)), (2 * k + 1, "".join("ba"[x] for x in word))]
    got = rows_of(jaccard.query(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_shingles", "component_id")
    assert sorted(got) == [(d, 1, d) for d, _ in rows]


def brute_components(docs, n, num, den):
    sets = []
    for d, x in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (x or "").encode().lower())
        sets.append((d, x, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, _, a) in enumerate(sets):
        for j, (_, _, b) in enumerate(sets[:i]):
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    names = defaultdict(list)
    for i, (d, _, _) in enumerate(sets):
        names[find(i)].append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in names.items()}
    return [(d, len(s), least[find(i)] if s else d) for i, (d, _, s) in enumerate(sets)]


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80)])
def test_components(spark, n, num):
    docs = documents(spark)
    same(rows_of(jaccard.join(docs, n, num, 100), "doc_id", "n_shingles", "component_id"), brute_components(plain(docs), n, num, 100))
    assert jaccard.query(empty(spark)).count() == 0


def test_components_chains(spark):
    """Near copies of a text that are no near copies of each other, and a chain of small steps."""
    import random

    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows, step = [], list(base)
    for i in range(40):
        x = list(base)
        for _ in range(3):
            x[rng.randrange(200)] = f"v{rng.randrange(10**6)}"
        rows.append((100 + i, " ".join(x), "s"))
        step[(i * 7) % 200] = f"u{i}"
        rows.append((500 + i, " ".join(step), "s"))
    docs = documents(spark, rows)
    same(rows_of(jaccard.query(docs), "doc_id", "n_shingles", "component_id"), brute_components(plain(docs), 3, 90, 100))


def test_mixing(spark):
    docs = documents(spark)
    rows = mixing.query(docs).collect()
    assert len(rows) == docs.count()
    total = sum(r["size"] for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", next(x or "" for d, x in plain(docs) if d == r["doc_id"]))) or r["doc_id"] in (None, 0, 3, 4, 6)
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert abs(sum(v[0]["target"] for v in by.values()) - total) < 1e-6 * total
    for v in by.values():
        assert v[0]["target"] <= 3 * v[0]["source_size"] + 1e-6
    again = mixing.query(docs.repartition(3))
    same(rows_of(again, "doc_id", "size", "taken"), [(r["doc_id"], r["size"], r["taken"]) for r in rows])
    assert mixing.query(empty(spark)).count() == 0
    copied = mixing.mixed(docs)
    assert copied.columns == docs.columns
    assert mixing.mixed(empty(spark)).count() == 0


def test_mixing_meets_targets(spark):
    """Taken words are the targets up to about half a small document, whatever shares doc_id, source and size."""
    import random

    rng = random.Random(11)
    rows = [(rng.choice([None, i % 300]), " ".join("w" * rng.randint(1, 3) + str(rng.randrange(9999)) for _ in range(rng.choice([1, 2, 3, 5, 5, 5, 40]))), rng.choice("aaaabcdefg")) for i in range(1500)]
    rows += [rows[0]] * 400
    docs = documents(spark, rows)
    out = mixing.query(docs).collect()
    size = Counter()
    for _, x, s in rows:
        size[s] += len(x.split())
    want = shared_targets(dict(size), {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))})
    taken = Counter()
    for r in out:
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 2 for s in size), (taken, want)
    copied = Counter((r["doc_id"], r["text"], r["source"]) for r in mixing.mixed(docs).collect())
    assert Counter({s: sum(len(x.split()) * n for (_, x, t), n in copied.items() if t == s) for s in size}) == taken
    assert mixing.mixed(docs.repartition(5)).exceptAll(mixing.mixed(docs)).count() == 0


def shared_targets(size, weight, most=3.0):
    left, live, want = float(sum(size.values())), set(size), {}
    while live:  # share by weight, hold those above their cap, share again
        level = left / sum(weight[s] for s in live)
        over = {s for s in live if level * weight[s] > most * size[s]}
        if not over:
            return want | {s: level * weight[s] for s in live}
        want |= {s: most * size[s] for s in over}
        left -= sum(most * size[s] for s in over)
        live -= over
    return want


def test_mixing_targets_capped(spark):
    totals = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1), (None, 0), ("d", 500)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.weighted_targets(totals).collect()}
    size, weight = {"a": 10, "b": 1000, "c": 1, "d": 500, None: 0}, {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}
    want = shared_targets(size, weight)
    assert got == pytest.approx(want)


def test_balance_families(spark):
    rows = [(i % 3, i % 2, 10 + i) for i in range(60)]
    df = spark.createDataFrame([(f"s{a}", f"l{b}", n) for a, b, n in rows], "source string, lang string, size long")
    total = sum(n for *_, n in rows)
    goal = {"source": {"s0": total * 0.5, "s1": total * 0.3, "s2": total * 0.2}, "lang": {"l0": total * 0.7, "l1": total * 0.3}}
    duals = mixing.balance(df, "size", goal)
    import math

    got = defaultdict(float)
    for a, b, n in rows:
        m = n * math.exp(duals["source"][f"s{a}"] + duals["lang"][f"l{b}"])
        got[f"s{a}"] += m
        got[f"l{b}"] += m
    assert dict(got) == pytest.approx(goal["source"] | goal["lang"], rel=1e-6)


def test_toxicity(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(i * 2, i, int(i == 21)) for i in range(22)] + [(None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.query(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert toxicity.query(docs, labels.limit(0)).where("score <> 0").count() == 0
    assert toxicity.query(empty(spark), labels).count() == 0


def test_stages(spark, tmp_path):
    """Each stage on the odd documents: columns stay, and what goes is what brute force says."""
    spark.createDataFrame([(i * 2, i, int(i == 21)) for i in range(22)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert stage(spark, empty(spark), str(tmp_path)).count() == 0, name
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    comp = brute_components(plain(docs), 5, 80, 100)
    want = len({c for d, n, c in comp if n}) + len({x for x, (_, n, _) in zip(plain(docs), comp) if not n})
    assert kept.count() == want
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert last.count() == docs.count()


def test_near_duplicates_by_root(spark):
    """Unrelated texts without an id, or under one id, are components of one name; each keeps a document."""
    import random

    rng = random.Random(4)
    t = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(8)]
    rows = [(None, t[0]), (None, t[1]), (None, t[2]), (None, t[2] + " end"), (7, t[3]), (7, t[4]), (7, t[5]), (9, t[4] + " end"), (3, t[6]), (7, t[6] + " end"), (None, t[7]), (None, t[7])]
    docs = documents(spark, [(d, x, "s") for d, x in rows])
    kept = plain(corpus_pipeline.drop_near_duplicates(spark, docs, ""))
    # the names are alike within each of these groups, the texts are not
    groups = [{rows[0]}, {rows[1]}, {rows[2], rows[3]}, {rows[4]}, {rows[5], rows[7]}, {rows[6]}, {rows[8], rows[9]}, {rows[10]}]
    assert sorted(sum(x in g for x in kept) for g in groups) == [1] * 8 and len(kept) == 8
    same([x for x in kept if x[0] is not None], [rows[4], rows[5], rows[6], rows[8]])


def test_pipeline_run(spark, sf):
    """run() over the smallest tables, each stage against brute force on what the stage before kept."""
    from tokenizers import Tokenizer

    from spindrift.llm.common import staged, table

    docs = table(spark, sf, "documents")
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, sf, "labels").collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = staged(stage(spark, before, sf), f"test-{name}")
        was, now = plain(before), plain(docs) if name != "bpe" else None
        if name == "toxicity":
            assert set(now) <= set(was)
            gone = {d for d, _ in was} - {d for d, _ in now}
            clean = [d for d, t in labels.items() if not t]
            # eight toxic documents teach nothing here; what is found is held against larger tables in test_methods
            assert len(gone & set(clean)) <= 0.05 * len(clean)
        elif name == "line_dedup":
            want = brute_lines(set(was))
            word = re.compile(r"[^\x20\x09-\x0D]")
            same(now, [(d, x if x is None else want[d, x]) for d, x in was if x is None or want[d, x] == x or word.search(want[d, x])])
            assert any(x and not word.search(want[d, x]) for d, x in was if x is not None)
        elif name == "near_duplicates":
            comp = brute_components(was, 5, 80, 100)
            same([(d,) for d, _ in now], [(d,) for d, n, c in comp if c == d])
        elif name == "mixing":
            copies = Counter(now)
            assert set(copies) <= set(was) and max(copies.values()) <= 3
        else:
            t = Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json"))
            same(rows_of(docs, "doc_id", "n_tokens"), [(d, len(t.encode(x or "", add_special_tokens=False).ids)) for d, x in was])
        kept.append(docs.count())
    assert kept[-1] == kept[-2] and corpus_pipeline.run(spark, sf).count() == kept[-1]
