"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A piece of text starts as its bytes. Each leaf of the tree holds the merge rank of one adjacent pair with its
place, so the root is the leftmost pair of the lowest rank; applying it changes three leaves, each in
logarithmic time, until the root holds no pair. Pieces repeat, so a worker keeps the ids of those it has met
(a bounded table in two halves, of which the older goes when the newer is full).

Defined cases: null text is empty text; empty text has no ids; rows repeat as they are; very long pieces cost
n log n. The literal of a special token in a text is that token, as in the tokenizers library's default.
"""

from __future__ import annotations

import hashlib
import json
import struct

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import small_batches

#: Fixed value: the pattern that splits text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = 1 << 62
CACHE = 500_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(256 + extra), extra + 1
    return out


class ByteBpe:
    """A byte-level BPE vocabulary read from a tokenizers file."""

    def __init__(self, path: str, cache: int = CACHE):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        symbols = byte_symbols()
        back = {s: b for b, s in enumerate(symbols)}
        self.byte_id = [vocab[s] for s in symbols]
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        #: by the pair of ids as one number: rank << 32 | id of the merged token
        self.pairs = {}
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs.setdefault(vocab[a] << 32 | vocab[b], (rank << 32, vocab[a + b]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(PATTERN)
        self.cache, self.older, self.most = {}, {}, cache

    def merge(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        ids = [self.byte_id[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        pairs = self.pairs
        size = 1
        while size < n - 1:
            size *= 2
        tree = [NONE] * (2 * size)
        into = [0] * n  # what the pair at a place becomes
        for i in range(n - 1):
            if p := pairs.get(ids[i] << 32 | ids[i + 1]):
                tree[size + i], into[i] = p[0] | i, p[1]
        for v in range(size - 1, 0, -1):
            a, b = tree[2 * v], tree[2 * v + 1]
            tree[v] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (root := tree[1]) != NONE:
            i = root & 0xFFFFFFFF
            j = after[i]
            ids[i] = into[i]
            ids[j] = -1
            k = after[i] = after[j]
            changed = []
            if j < n - 1:
                changed.append((j, NONE))
            if k < n:
                before[k] = i
                p = pairs.get(ids[i] << 32 | ids[k])
                changed.append((i, p[0] | i if p else NONE))
                if p:
                    into[i] = p[1]
            else:
                changed.append((i, NONE))
            if (h := before[i]) >= 0:
                p = pairs.get(ids[h] << 32 | ids[i])
                changed.append((h, p[0] | h if p else NONE))
                if p:
                    into[h] = p[1]
            for at, key in changed:
                v = size + at
                if tree[v] == key:
                    continue
                tree[v] = key
                v >>= 1
                while v:
                    a, b = tree[2 * v], tree[2 * v + 1]
                    if b < a:
                        a = b
                    if tree[v] == a:
                        break
                    tree[v] = a
                    v >>= 1
        return [x for x in ids if x >= 0]

    def packed(self, piece: str) -> bytes:
        """Ids of one piece as little-endian unsigned 32-bit integers. Pieces that come again outlive the table's turn."""
        out = self.older.get(piece)
        if out is None:
            ids = self.merge(piece.encode())
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self.cache) >= self.most // 2:
                self.older = dict(self.cache)
                self.cache.clear()
            self.cache[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        out, get, packed = [], self.cache.get, self.packed
        for k, part in enumerate(self.split.split(text) if self.split and any(s in text for s in self.special) else [text]):
            if k % 2:
                out.append(struct.pack("<I", self.special[part]))
            else:
                out += [get(p) or packed(p) for p in self.pieces.findall(part)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Ids past the vocabulary are skipped; bytes that are no UTF-8 become U+FFFD."""
        get = self.bytes_of.get
        return b"".join([get(i, b"") for i in struct.unpack(f"<{len(ids) // 4}I", ids)]).decode("utf-8", "replace")


_open: dict[str, ByteBpe] = {}


def tokenizer(path: str) -> ByteBpe:
    if path not in _open:
        _open[path] = ByteBpe(path)
    return _open[path]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str | None = None, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with ids=True the ids as packed bytes.

    path: the vocabulary file on every node; by default the byte-level one of the installed package."""
    small_batches(docs.sparkSession)

    def run(batches):
        t = tokenizer(path or vocabulary_path("byte_bpe_50k.json"))
        for b in batches:
            rows = ([], [], [], [])
            for text in b.column(1):
                got = t.encode(text.as_py() or "")
                back = t.decode(got)
                for to, x in zip(rows, (len(got) // 4, hashlib.sha256(got).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), got)):
                    to.append(x)
            cols = [b.column(0), pa.array(rows[0], "int64"), pa.array(rows[1], "string"), pa.array(rows[2], "string")]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                cols.append(pa.array(rows[3], "binary"))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def query(docs: DataFrame) -> DataFrame:
    return encode_documents(docs)
