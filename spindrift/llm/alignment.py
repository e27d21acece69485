"""Alignment of two tokenizers' ids over the same bytes, and how many documents of the corpus link each pair of ids.

Tokens' ends are running sums of their lengths in bytes; the ends that both tokenizers share cut the tokens into groups, and every token
of one is linked with every token of the other in its group. A text is taken in units (white space with the word after it), at whose borders
both tokenizers always end a token: a byte-level pattern has no match that runs from a word into white space, and no piece of the
other does but into a carriage return, which is no border (pieces() checks the vocabulary). Units repeat, so a worker aligns those it hasn't met, many at a time, and keeps what it found (a
bounded table); a text's numbers are sums over its units.

Corpus counts: the texts of a block leave one row a distinct pair with the number of documents that hold it; those are summed by pair and salt,
then by pair. Each block then asks for the counts of its own pairs, and its documents read them by their place. So what is
shuffled is pairs of blocks, not of documents; as a pair has one row a block at most, its rows are dealt over salts whose number is counted.

Defined cases: null and empty texts, and those whose tokens' bytes differ from space + text, have no tokens: zeros and an empty groups_sha256; an
empty table gives none. A row is a document: rows that share a doc_id count apiece. Ties for an id's highest count are all the
highest. The literals of special tokens are plain text. Only doc_id and text are read, so other columns' names don't matter. Texts are never
cut; a block holds at least one text, and a worker's memory grows with the longest (some 30 times its bytes).
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, ByteBpe, vocabulary_path
from .common import small_batches, staged

#: Units kept by a worker, links expanded at a time, bytes of text of a block, blocks that share a salt.
UNITS, LINKS, BLOCK, SALTED = 400_000, 1 << 21, 6 << 20, 1 << 14
#: Fixed value: the characters that are white space in the pattern of byte-level vocabularies.
SPACES = " \t\n\r\x0b\x0c\x85\xa0                　"
_UNIT = re.compile(f"[{SPACES}]*[^{SPACES}]+(?:\r[{SPACES}]*[^{SPACES}]*)*|[{SPACES}]+")
_TWO = re.compile(f"[{SPACES}][{SPACES}]")


class Side:
    """One tokenizer: ids of units, and the bytes of ids."""

    def __init__(self, tokens: dict[int, bytes], encode):
        self.encode, self.count = encode, max(tokens) + 1
        self.size = np.array([len(tokens.get(i, b"")) for i in range(self.count)], "int64")
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(self.count)), "uint8")
        #: what a token looks like in a row of groups: followed by the next of its side, or by what ends its side
        self.text = [[str(i).encode() + end for end in (b",", b"|", b";")] for i in range(self.count)]

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return self.data[spread(self.begin[ids], self.size[ids])]


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (size[0] of them), begin[1], ..."""
    out = np.repeat(begin - np.cumsum(size) + size, size)
    return out + np.arange(len(out))


def byte_level(path: str) -> Side:
    """The vocabulary of a tokenizers file, merged by rank. Special tokens' strings are plain text."""
    import tiktoken

    tokens = ByteBpe(path)
    plain = {i: t for i, t in tokens.bytes_of.items() if i not in tokens.special.values()}
    core = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks={t: i for i, t in plain.items()}, special_tokens={})
    return Side(plain, lambda units: [core.encode_ordinary(u) for u in units])


def pieces(path: str) -> Side:
    """The vocabulary of a sentencepiece file. Its prefix, a space, is expected to be in the units."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    rule, kind = proto.normalizer_spec, proto.SentencePiece
    inner = re.compile(f"[^▁{SPACES}][▁ ]|[^{SPACES}▁][{SPACES.replace(chr(13), '')}]")
    if rule.precompiled_charsmap or rule.remove_extra_whitespaces or any(inner.search(p.piece) for p in proto.pieces if p.type == kind.NORMAL):
        raise ValueError(f"{path}: tokens may run over the borders of words")
    rule.add_dummy_prefix = False
    tokens = {}
    for i, p in enumerate(proto.pieces):
        if p.type not in (kind.CONTROL, kind.UNKNOWN):
            tokens[i] = bytes([int(p.piece[1:-1], 16)]) if p.type == kind.BYTE else p.piece.replace("▁", " ").encode()
    sp = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    return Side(tokens, lambda units: sp.encode(units, num_threads=1))


def units_of(text: str) -> list[str]:
    """text in pieces that begin where white space follows a word."""
    if _TWO.search(text) or "\0" in text:
        return _UNIT.findall(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n").removeprefix("\0").split("\0")


class Aligned:
    """What is known of a list of texts, given by their ids on both sides (equal bytes)."""

    def __init__(self, a: Side, b: Side, texts: list[str]):
        ids = [self._flat(s.encode(texts)) for s in (a, b)]
        said = [t.encode() for t in texts]
        length = np.fromiter(map(len, said), "int64", len(said))
        data = np.frombuffer(b"".join(said), "uint8")
        self.good = length > 0
        for s, (x, n) in zip((a, b), ids):
            self.good &= self._equal(s, x, n, length, data)
        (x, nx), (y, ny) = [(v[np.repeat(self.good, n)], np.where(self.good, n, 0)) for v, n in ids]
        self.tokens = nx, ny
        # a text's tokens end where the sum of all bytes up to there says, so common ends cut all texts at once
        ends = [np.cumsum(s.size[v]) for s, v in ((a, x), (b, y))]
        cuts = np.intersect1d(*ends, assume_unique=True)
        group = [np.searchsorted(cuts, e) for e in ends]
        of = np.searchsorted(np.cumsum(np.where(self.good, length, 0)), cuts)
        self.groups = np.bincount(of, minlength=len(texts))
        per = [np.bincount(g, minlength=len(cuts)) for g in group]
        self.links = np.bincount(of, per[0] * per[1], minlength=len(texts)).astype("int64")
        self.rows = self._rows((a, b), (x, y), group, per, of)
        self._pairs((x, y), group, per, of, a.count, b.count)

    @staticmethod
    def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        n = np.fromiter(map(len, lists), "int64", len(lists))
        return np.fromiter(itertools.chain.from_iterable(lists), "int64", int(n.sum())), n

    @staticmethod
    def _equal(s: Side, ids: np.ndarray, n: np.ndarray, length: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Whether the tokens' bytes are the text's."""
        ok = np.zeros(len(n), bool)
        some = n > 0
        if some.any():
            ok[some] = np.add.reduceat(s.size[ids], (np.cumsum(n) - n)[some]) == length[some]
        mine, theirs = s.bytes_of(ids[np.repeat(ok, n)]), data[np.repeat(ok, length)]
        at = np.flatnonzero(ok)
        if len(at):
            ok[at] = np.add.reduceat(mine != theirs, np.cumsum(length[at]) - length[at]) == 0
        return ok

    def _rows(self, sides, ids, group, per, of) -> list[bytes]:
        """Each text's groups as text: a1,a2|b1;a3|b2,b3;"""
        ends = [np.cumsum(p) for p in per]
        first = ends[0] + ends[1] - per[0] - per[1]
        parts = np.empty(len(ids[0]) + len(ids[1]), object)
        for side in (0, 1):
            inside = np.arange(len(ids[side])) - (ends[side] - per[side])[group[side]]
            end = np.where(inside == per[side][group[side]] - 1, side + 1, 0)
            text = sides[side].text
            parts[(first + (per[0] if side else 0))[group[side]] + inside] = [text[i][e] for i, e in zip(ids[side].tolist(), end.tolist())]
        n = np.bincount(of, per[0] + per[1], minlength=len(self.good)).astype("int64")
        upto, parts = np.cumsum(n).tolist(), parts.tolist()
        return [b"".join(parts[e - k : e]) for e, k in zip(upto, n.tolist())]

    def _pairs(self, ids, group, per, of, na: int, nb: int) -> None:
        """self.pairs, self.times, self.size: distinct linked pairs (a * nb + b) of each text and how often they are linked."""
        # distinct ids of a group with their numbers: the links of a group are the products
        distinct = [np.unique(g * n + v, return_counts=True) for g, v, n in zip(group, ids, (na, nb))]
        (ga, va), (gb, vb) = [np.divmod(k, n) for (k, _), n in zip(distinct, (na, nb))]
        ca, cb = distinct[0][1], distinct[1][1]
        nb_of = np.bincount(gb, minlength=len(of))
        begin_b = np.cumsum(nb_of) - nb_of
        many, total, cut, got = nb_of[ga], np.cumsum(nb_of[ga]), 0, []
        while cut < len(ga):
            end = max(cut + 1, int(np.searchsorted(total, (total[cut - 1] if cut else 0) + LINKS, "right")))
            i, j = np.repeat(np.arange(cut, end), many[cut:end]), spread(begin_b[ga[cut:end]], many[cut:end])
            got.append(_summed((of[ga[i]] * na + va[i]) * nb + vb[j], ca[i] * cb[j]))
            cut = end
        key, times = _summed(*[np.concatenate(c) for c in zip(*got)]) if got else (np.empty(0, "int64"), np.empty(0, "int64"))
        text, self.pairs = np.divmod(key, na * nb)
        self.times, self.size = times, np.bincount(text, minlength=len(self.good))


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their n."""
    if not len(key):
        return key, n
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(n[order], first)


class Known:
    """Units that a worker has met. When there are more than it keeps, the half that was asked for less often goes."""

    _TYPES = {"good": "bool", "na": "int32", "nb": "int32", "groups": "int32", "links": "int64", "size": "int64", "used": "int64"}

    def __init__(self, a: Side, b: Side, most: int = UNITS):
        self.a, self.b, self.most = a, b, most
        self.number: dict[str, int] = {}
        self.rows: list[bytes] = []
        self.cols = {k: np.empty(0, t) for k, t in self._TYPES.items()}
        self.pairs, self.times = np.empty(0, "int64"), np.empty(0, "int64")

    def numbers(self, texts: list[list[str]]) -> list[list[int]]:
        """The numbers of each text's units, valid until the next call."""
        if len(self.number) > self.most:
            self._forget()
        new = list({u: None for t in texts for u in t if u not in self.number})
        self.number.update(zip(new, itertools.count(len(self.number))))
        if new:
            x = Aligned(self.a, self.b, new)
            self.rows += x.rows
            for k, v in zip(self._TYPES, (x.good, *x.tokens, x.groups, x.links, x.size, np.zeros(len(new), "int64"))):
                self.cols[k] = np.concatenate([self.cols[k], v.astype(self._TYPES[k])])
            self.pairs, self.times = np.concatenate([self.pairs, x.pairs]), np.concatenate([self.times, x.times])
        self.begin = np.cumsum(self.cols["size"]) - self.cols["size"]
        return [list(map(self.number.__getitem__, t)) for t in texts]

    def _forget(self) -> None:
        keep = np.sort(np.argsort(-self.cols["used"], kind="stable")[: self.most // 2])
        at = spread(self.begin[keep], self.cols["size"][keep])
        self.pairs, self.times = self.pairs[at], self.times[at]
        self.cols = {k: v[keep] for k, v in self.cols.items()}
        self.cols["used"] //= 2
        self.rows = [self.rows[i] for i in keep.tolist()]
        names = list(self.number)
        self.number = {names[i]: n for n, i in enumerate(keep.tolist())}


_open: dict[tuple[str, str], Known] = {}


def known(a_path: str | None, b_path: str | None) -> Known:
    key = a_path or vocabulary_path("byte_bpe_50k.json"), b_path or vocabulary_path("piece_bpe_32k.model")
    if key not in _open:
        _open[key] = Known(byte_level(key[0]), pieces(key[1]))
    return _open[key]


def _block(k: Known, texts: list[str], groups: bool) -> tuple[dict[str, list], np.ndarray, np.ndarray]:
    """Columns of each text, and the block's distinct pairs with the number of texts that hold them."""
    unit = k.numbers([units_of(" " + t) if t else [] for t in texts])
    n = np.fromiter(map(len, unit), "int64", len(unit))
    flat = np.fromiter(itertools.chain.from_iterable(unit), "int64", int(n.sum()))
    of = np.repeat(np.arange(len(texts)), n)
    k.cols["used"] += np.bincount(flat, minlength=len(k.rows))
    good = (n > 0) & (np.bincount(of, ~k.cols["good"][flat], minlength=len(texts)) == 0)
    out = {}
    for name, col in (("n_a", "na"), ("n_b", "nb"), ("n_groups", "groups"), ("n_links", "links")):
        out[name] = np.where(good, np.bincount(of, k.cols[col][flat], minlength=len(texts)), 0).astype("int64")
    rows = [b"".join(map(k.rows.__getitem__, u))[:-1] if g else b"" for u, g in zip(unit, good.tolist())]
    out["groups_sha256"] = [hashlib.sha256(r).hexdigest() if r else "" for r in rows]
    if groups:
        out["groups"] = [r.decode() for r in rows]
    keep = good[of]
    key, times = np.unique(of[keep] * len(k.rows) + flat[keep], return_counts=True)  # units of a text, each once
    text, u = np.divmod(key, max(1, len(k.rows)))
    size, ids = k.cols["size"][u], k.a.count * k.b.count
    at = spread(k.begin[u], size)
    key, times = _summed(np.repeat(text, size) * ids + k.pairs[at], np.repeat(times, size) * k.times[at])
    text, pair = np.divmod(key, ids)
    pairs, place, docs = np.unique(pair, return_inverse=True, return_counts=True)
    cut = np.cumsum(np.bincount(text, minlength=len(texts)))[:-1]
    out["at"] = [x.astype("<u4").tobytes() for x in np.split(place, cut)]
    out["times"] = [x.astype("<u8" if len(x) and x.max() >> 32 else "<u4").tobytes() for x in np.split(times, cut)]
    return out, pairs, docs


_DOC = {"n_a": "int64", "n_b": "int64", "n_groups": "int64", "n_links": "int64", "groups_sha256": "string"}


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, groups: bool = False) -> DataFrame:
    """A staged table with two kinds of rows, in blocks: for each document block, doc_id, n_a, n_b, n_groups, n_links, groups_sha256
    (with groups=True: groups, the ids themselves), at and times; for each block pairs (ascending) and docs. at: little-endian places of
    a document's pairs within its block's; times: how often they are linked there.

    a_path, b_path: the vocabulary files on every node; by default those of the installed package."""
    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    types = dict(_DOC) | ({"groups": "string"} if groups else {}) | {"at": "binary", "times": "binary"}

    def rows(number, ids, texts):
        k = known(a_path, b_path)
        cols, pairs, held = _block(k, texts, groups)
        ids = pa.concat_arrays(ids)
        a, b = np.divmod(pairs, k.b.count)
        none = pa.nulls(1, ids.type)
        out = {"block": pa.array(np.full(len(ids) + 1, number)), "doc_id": pa.concat_arrays([ids, none]), "is_doc": pa.array([True] * len(ids) + [False])}
        for name, t in types.items():
            out[name] = pa.array([*cols[name], None], t)
        for name, x in (("a", a), ("b", b), ("docs", held)):
            out[name] = pa.concat_arrays([pa.nulls(len(ids), pa.list_(pa.int32())), pa.array([x.astype("int32")], pa.list_(pa.int32()))])
        return pa.RecordBatch.from_arrays(list(out.values()), list(out))

    def run(batches):
        task, ids, texts, size, count = TaskContext.get().partitionId() << 32, [], [], 0, 0
        for batch in batches:
            begin = 0
            for i, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                if texts and size + len(text) > BLOCK:
                    yield rows(task + count, [*ids, batch.column(0).slice(begin, i - begin)], texts)
                    begin, ids, texts, size, count = i, [], [], 0, count + 1
                texts.append(text)
                size += len(text)
            ids.append(batch.column(0).slice(begin))
        if texts:
            yield rows(task + count, ids, texts)

    spell = {"int64": "bigint"}
    schema = f"block bigint, doc_id {id_type}, is_doc boolean, " + ", ".join(f"{n} {spell.get(t, t)}" for n, t in types.items()) + ", a array<int>, b array<int>, docs array<int>"
    return staged(docs.select("doc_id", "text").mapInArrow(run, schema), "aligned")


def _salts(table: DataFrame) -> int:
    """A pair has one row a block at most."""
    return 1 + table.where("not is_doc").count() // SALTED


def _salt(salts: int):
    return F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt")


def pair_counts(table: DataFrame) -> DataFrame:
    """a, b, docs, best of aligned()'s table: how many documents link a with b, and whether that is a's highest count. Summed by salt first."""
    rows = table.where("not is_doc").select(_salt(_salts(table)), F.inline(F.arrays_zip("a", "b", "docs")))
    n = rows.groupBy("a", "b", "salt").agg(F.sum("docs").alias("docs")).groupBy("a", "b").agg(F.sum("docs").alias("docs"))
    top = n.groupBy("a").agg(F.max("docs").alias("top"))
    return n.join(top, "a").select("a", "b", "docs", (F.col("docs") == F.col("top")).alias("best"))


def linked(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups) of every document."""
    table = aligned(docs, a_path, b_path, groups)
    salts = _salts(table)
    asked = table.where("not is_doc").select(F.col("block").alias("of"), _salt(salts), F.posexplode(F.arrays_zip("a", "b")).alias("place", "x")).select("of", "salt", "place", "x.a", "x.b")
    counts = pair_counts(table).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    told = asked.join(counts, ["a", "b", "salt"]).select("of", "place", "docs", "best")
    cols = [*_DOC, *(["groups"] if groups else [])]
    kept = table.where("is_doc").select("block", "doc_id", *cols, "at", "times")

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        n, best = np.zeros(right.num_rows, "int64"), np.zeros(right.num_rows, bool)
        place = right["place"].to_numpy()
        n[place], best[place] = right["docs"].to_numpy(), right["best"].to_numpy()
        sums: tuple[list, list] = ([], [])
        for at, times in zip(left["at"].to_pylist(), left["times"].to_pylist()):
            at = np.frombuffer(at, "<u4")
            times = np.frombuffer(times, "<u8" if len(times) > 4 * len(at) else "<u4").astype("int64")
            sums[0].append(int(times[best[at]].sum()))
            sums[1].append(int((times * n[at]).sum()))
        out = left.select(["doc_id", *cols])
        return out.append_column("n_best", pa.array(sums[0], "int64")).append_column("count_sum", pa.array(sums[1], "int64"))

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields if f.name not in ("block", "at", "times")]
    out = kept.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(add, ", ".join([*fields, "n_best bigint", "count_sum bigint"]))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", *[c for c in cols if c.startswith("groups")])


def query(docs: DataFrame) -> DataFrame:
    return linked(docs)
