"""Language identification against a plain coder, on odd rows, and by held-out accuracy."""

import math
import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest

from spindrift.llm import language
from spindrift.llm.common import table
from tests.llm.cases import documents, empty


def trees(rows, order, entries):
    """Of each language: byte counts of its contexts, those that the rule keeps."""
    names = sorted({l for l, _ in rows})
    out = {}
    for name in names:
        tree = defaultdict(lambda: defaultdict(int))
        for l, text in rows:
            if l == name:
                data = bytes(order) + text.encode()
                for i in range(order, len(data)):
                    for j in range(order + 1):
                        tree[data[i - j : i]][data[i]] += 1
        step = {c: math.floor(math.log2(sum(n.values())) * 8) for c, n in tree.items()}
        room, least = entries // len(names), None
        for s in sorted(set(step.values()), reverse=True):
            room -= sum(len(tree[c]) for c in tree if step[c] == s)
            if room < 0 and least is not None:
                break
            least = s
        out[name] = {c: n for c, n in tree.items() if step[c] >= least}
    return out


def bits(tree, order, text):
    """Code length by the definition: escapes with exclusions, from the longest context down."""
    data, total = bytes(order) + text.encode(), 0.0
    for i in range(order, len(data)):
        gone = set()
        for j in range(order, -1, -1):
            node = tree.get(data[i - j : i])
            if node is None:
                continue
            left = {s: n for s, n in node.items() if s not in gone}
            whole = sum(left.values()) + len(left)
            if data[i] in left:
                total += math.log2(whole / left[data[i]])
                break
            if left:
                total += math.log2(whole / len(left))
            gone |= node.keys()
        else:
            total += math.log2(256 - len(gone))
    return total


@pytest.mark.parametrize("order, entries", [(0, 10**6), (2, 10**6), (4, 10**6), (3, 300), (5, 5)])
def test_code_lengths(spark, order, entries):
    rng = random.Random(order)
    word = lambda s: "".join(rng.choice(s) for _ in range(rng.randint(1, 5)))
    rows = [(l, " ".join(word(s) for _ in range(rng.randint(1, 40)))) for l, s in (("aa", "abcde"), ("bb", "defgé"), ("cc", "agzñ")) for _ in range(12)]
    texts = [x for _, x in rows[::9]] + ["", "Q", "abc zzz ñé \x00\x01", "a" * 300] + [word("abcdefgzéñ漢 ") * 4 for _ in range(20)]
    model = language.fit(spark.createDataFrame([*rows, (None, "no language"), ("aa", None)], "lang string, text string"), order, entries)
    got = {r["text"]: r for r in language.predict(spark.createDataFrame([(t, t) for t in texts], "doc_id string, text string"), model, lengths=True).withColumnRenamed("doc_id", "text").collect()}
    want = trees(rows, order, entries)
    assert entries > 1000 or sum(len(n) for t in want.values() for n in t.values()) < 3 * 10**2 + 3 * 256
    for t in texts:
        lengths = {l: bits(tree, order, t) for l, tree in want.items()}
        for l, b in lengths.items():
            assert abs(got[t]["bits"][l] - b) <= 4 * (order + 2) * len(t.encode()) / language.UNIT, (t, l)  # rounded terms
        if any(c.isalpha() for c in t):
            first = min(lengths, key=lambda l: (lengths[l], l))
            if sorted(lengths.values())[1] - lengths[first] > 1e-3:
                assert got[t]["lang_pred"] == first
                assert abs(got[t]["score"] - 1 / sum(2 ** (lengths[first] - b) for b in lengths.values())) < 1e-4
        else:
            assert (got[t]["lang_pred"], got[t]["score"]) == ("und", 0.0)


def test_slices_and_sliced_arrays():
    """A text that runs over slices costs what it costs alone, wherever its column begins."""
    import pyarrow as pa

    from spindrift.llm.common import utf8

    rng = np.random.default_rng(1)
    text = ["x", "", "".join(rng.choice(list("abc "), 700_000)), "b" * 10, ""]
    model = language.Model(["a", "b"], 1, np.array([0, 0, 1]), np.array([0, 1, 0]), np.array([97, 97 << 8 | 98, 98], "uint64"), np.array([3, 1, 2]))
    whole = model.lengths(*utf8(pa.array(text)))
    for i, t in enumerate(text):
        assert (whole[i] == model.lengths(*utf8(pa.array(["é", t]).slice(1)))[0]).all()
    assert (whole[3] == [10 * language._bits(np.array(256 - 1)) + 10 * language._bits(np.array(4.0)), 10 * language._bits(np.array(1.5))]).all()


def test_odd_rows(spark):
    docs = documents(spark)
    got = language.query(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.collect()
    assert len(rows) == docs.count()
    for r, d in zip(rows, docs.collect()):
        assert r["doc_id"] == d["doc_id"]
        assert r["held_out"] == (d["doc_id"] is not None and crc32(str(d["doc_id"]).encode()) % 4 == 2)
        letter = any(c.isalpha() for c in d["text"] or "")
        assert (r["lang_pred"], r["score"]) == (("en", 1.0) if letter else ("und", 0.0))
    assert language.query(empty(spark)).count() == 0
    assert {r[0] for r in language.query(docs.withColumn("lang", docs["lang"].cast("string").substr(9, 2)).replace("", None, "lang")).select("lang_pred").collect()} == {"und"}
    with pytest.raises(ValueError):
        language.fit(docs.selectExpr("'a' as lang", "text"), 9)


def test_long_text(spark):
    text = "the long text is here and there " * 100_000
    rows = [(1, text, "en"), (3, "der lange text ist hier und dort " * 3, "de"), (4, text + "!", None)]
    got = language.query(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert [r["lang_pred"] for r in got] == ["en", "de", "en"]


def test_held_out_accuracy(spark):
    """Rows that were not learned from, on sf0.01; lang and source change no prediction."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r["doc_id"]: r for r in language.query(docs).collect()}
    rows = [r for r in docs.select("doc_id", "lang", "text").collect() if got[r["doc_id"]]["held_out"] and any(c.isalpha() for c in r["text"])]
    assert len(rows) > 200
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
