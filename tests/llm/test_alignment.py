"""Alignment against the tokenizers themselves and plain loops over tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from spindrift.llm import alignment
from spindrift.llm.bpe import byte_symbols, vocabulary_path
from tests.llm.cases import documents, empty, rows_of, texts

COLS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))


def tokens(libraries, text):
    """Ids and bytes of both sides; none if the bytes differ."""
    t, sp = libraries
    if not text:
        return [], [], [], []
    back = {c: i for i, c in enumerate(byte_symbols())}
    e = t.encode(" " + text, add_special_tokens=False)
    b = sp.encode(text)
    ab = [bytes(back[c] for c in t.id_to_token(i)) for i in e.ids]
    bb = [bytes([int(p[1:-1], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(sp.id_to_piece, b))]
    if b"".join(ab) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
        return [], [], [], []
    return e.ids, b, ab, bb


def plain(libraries, rows):
    """The contract, document by document."""
    seen, held = [], Counter()
    for doc_id, text in rows:
        a, b, ab, bb = tokens(libraries, text)
        ends = [set(np.cumsum([len(x) for x in y]).tolist()) for y in (ab, bb)]
        cuts = sorted(ends[0] & ends[1])
        groups = [([], []) for _ in cuts]
        for side, ids, parts in ((0, a, ab), (1, b, bb)):
            at, g = 0, 0
            for i, p in zip(ids, parts):
                at += len(p)
                groups[g][side].append(i)
                g += at == cuts[g]
        links = Counter((x, y) for xs, ys in groups for x in xs for y in ys)
        held.update(links.keys())
        seen.append((doc_id, len(a), len(b), groups, links))
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for doc_id, na, nb, groups, links in seen:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(n for (x, y), n in links.items() if held[x, y] == top[x])
        out.append((doc_id, na, nb, len(groups), sum(links.values()), best, sum(n * held[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out, held, top


key = lambda r: tuple((x is None, str(x)) for x in r)
ODD = [
    "it's 12,5   x", "a\n\nb \n c", "tabs\tand\r\nlines\r\rx", "▁under", "x▁y", "<s> </s> <unk> <0x0A> <|endoftext|>", "é é 漢字 🙂🙂 \x1c \x1d x", "　wide space x",
    " lead", "trail ", "trail\n", "   ", "\n", " ", "\x00", "a\x00b c", "line sep", "mong᠎x", "9" * 50, "-" * 200, "'s 're'll '", "{\r\n} ();\r x", "  two  three   four    ", "ÀÈ ñandú́",
]


def test_odd_rows(spark, libraries):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(rows_of(alignment.query(docs), *COLS), key=key) == sorted(plain(libraries, rows)[0], key=key)
    assert alignment.query(empty(spark)).count() == 0
    more = list(enumerate(ODD))
    got = rows_of(alignment.query(spark.createDataFrame(more, "doc_id int, text string")), *COLS)
    assert sorted(got, key=key) == sorted(plain(libraries, more)[0], key=key)


def test_random_texts_small_blocks(spark, libraries, monkeypatch):
    """Blocks, tables of units and expansions of a few at a time give the same; so do several salts."""
    rng = random.Random(2)
    alphabet = ["the", "cat's", " ", "  ", "\n", "\t", "ing", "é", "漢", "12", "…", "'", "Ab", "\r", " ", "🙂", "x" * 9, "▁", "<s>"]
    rows = [(i, rng.choice([" ", ""]).join(rng.choice(alphabet[: rng.choice([5, 17, 19])]) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    want, held, top = plain(libraries, rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted(rows_of(alignment.query(docs), *COLS)) == sorted(want)
    monkeypatch.setattr(alignment, "SALTED", 3)
    for name, value in (("UNITS", 50), ("LINKS", 5), ("BLOCK", 500)):
        monkeypatch.setattr(alignment, name, value)
    table = alignment.aligned(docs)
    assert alignment._salts(table) > 1
    got = {(r["a"], r["b"]): (r["docs"], r["best"]) for r in alignment.pair_counts(table).collect()}
    assert got == {p: (n, n == top[p[0]]) for p, n in held.items()}
    assert sorted(rows_of(alignment.linked(docs), *COLS)) == sorted(want)


def test_worker_table_forgets(libraries):
    """What is known of a unit does not depend on what was forgotten before."""
    k = alignment.Known(alignment.byte_level(vocabulary_path("byte_bpe_50k.json")), alignment.pieces(vocabulary_path("piece_bpe_32k.model")), most=40)
    rng = random.Random(4)
    words = texts()[0].split()
    for _ in range(60):
        t = " ".join(rng.choice(words) for _ in range(30))
        out, pairs, docs = alignment._block(k, [t], True)
        want, _, _ = plain(libraries, [(0, t)])
        assert (out["n_a"][0], out["n_b"][0], out["n_groups"][0], out["n_links"][0], out["groups_sha256"][0]) == (*want[0][1:5], want[0][7])
        assert (docs == 1).all() and len(k.number) <= 40 + 30


def test_groups_and_long_texts(spark, libraries):
    """A word of a million letters, a text of 200,000 words, and the groups themselves."""
    rng = random.Random(6)
    long = " ".join(rng.choice(["alpha", "beta", "gamma's", "δ"]) for _ in range(200_000))
    rows = [(1, "ab" * 500_000), (2, long), (3, "a cat")]
    got = rows_of(alignment.linked(spark.createDataFrame(rows, "doc_id long, text string"), groups=True), *COLS, "groups")
    want = plain(libraries, rows)[0]
    assert sorted(r[:8] for r in got) == sorted(want)
    assert [hashlib.sha256(r[8].encode()).hexdigest() for r in got] == [r[7] for r in got]
