"""Maximal periodic runs of words, by branching tandem repeats in suffix trees.

The texts of a block share one suffix array (prefix doubling; a suffix never equals one of another text), whose intervals of
common prefixes are the inner nodes of the texts' suffix trees. Of each node only the leaves of its smaller children are
visited (every leaf at most log n times): leaf i of a node of depth d is half of a branching tandem repeat if i + d, or
i - d, is a leaf below another child. Such a repeat is the last one of its run: it is rotated left for as long as the words
a period apart are equal, and repeats that become one stretch are merged under the smallest period. Comparisons of any
length come from the ranks that the doubling left, so nothing walks word by word.

Defined cases: null text has no words; texts without words, and empty tables, have no runs; rows that share a doc_id, or are
equal throughout, are separate texts; a null doc_id alters nothing (query()); only doc_id and text are read, so other columns'
names don't matter. Ties: see best(). A text is never cut: one longer than a block is a block of its own, whose memory is some
4 bytes a word for each doubling (log2 of the longest repeated stretch) and 100 bytes a word besides.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, small_batches

#: Words of the texts that are worked on at a time, and leaves that are expanded at a time.
BLOCK, LEAVES = 1 << 18, 1 << 21
#: A run repeats its period at least so many times and has at least so many words.
REPEATS, LEAST = 4, 6


def suffix_ranks(words: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """words: ids, equal only within a text. ends: for each place the end of its text. A list of rank arrays: two places have
    equal ranks in the k-th if and only if 2^k words from there are equal and inside their text; in the last no two have."""
    n = len(words)
    active, key, width = np.arange(n), words.astype("int64"), 0
    ranks: list[np.ndarray] = []
    while True:
        order = np.argsort(key, kind="stable")
        key, active = key[order], active[order]
        place = np.arange(len(active))
        new = np.ones(len(active), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.maximum.accumulate(np.where(new, place, 0))
        if ranks:
            old = ranks[-1][active]
            begin = np.ones(len(active), bool)
            begin[1:] = old[1:] != old[:-1]
            rank = ranks[-1].copy()
            rank[active] = old + first - np.maximum.accumulate(np.where(begin, place, 0))
        else:
            rank = np.empty(n, "int32")
            rank[active] = first
        ranks.append(rank)
        many = ~new
        many[:-1] |= ~new[1:]
        active = active[many]
        if not len(active):
            return ranks
        width = 1 << (len(ranks) - 1)
        after = active + width
        inside = after < ends[active]
        then = np.where(inside, rank[np.minimum(after, n - 1)], -1)
        key = rank[active].astype("int64") * (n + 1) + then + 1


def _extend(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray, room: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words are equal from i and j on (back: before i and j), at most room."""
    done = np.zeros(len(i), "int64")
    for k in range(len(ranks) - 1, -1, -1):
        at = np.flatnonzero(done + (1 << k) <= room)
        step = -done[at] - (1 << k) if back else done[at]
        done[at[ranks[k][i[at] + step] == ranks[k][j[at] + step]]] += 1 << k
    return done


def _nearest_smaller(x: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """For each place of at, the nearest place before (step -1) or after it (1) whose value is smaller; pointers are doubled."""
    to = np.arange(len(x)) + step
    todo = at
    while len(todo := todo[x[to[todo]] >= x[todo]]):
        to[todo] = to[to[todo]]
    return to[at]


def branching_repeats(ranks: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and half length of every tandem repeat that the word after it doesn't continue."""
    rank, n = ranks[-1], len(ranks[-1])
    sa = np.empty(n, "int64")
    sa[rank] = np.arange(n)
    common = np.zeros(n + 1, "int64")  # between the suffix at a place of the array and the one before it
    x = np.flatnonzero(ranks[0][sa[1:]] == ranks[0][sa[:-1]]) + 1
    if not len(x):
        return np.empty(0, "int64"), np.empty(0, "int64")
    i, j = sa[x - 1], sa[x]
    common[x] = _extend(ranks, i, j, ends[i] - np.maximum(i, j))
    # inner nodes: intervals lo..hi of the array, each found once for every border between two of its children
    lo, hi = _nearest_smaller(common, x, -1), _nearest_smaller(common, x, 1) - 1
    order = np.argsort(lo * (n + 1) + hi, kind="stable")
    x, lo, hi = x[order], lo[order], hi[order]
    head = np.ones(len(x), bool)
    head[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    node, at = np.cumsum(head) - 1, np.arange(len(x))
    heads = np.flatnonzero(head)
    tails = np.append(heads[1:], len(x)) - 1
    lo, hi, depth = lo[heads], hi[heads], common[x[heads]]
    left, right = np.empty(len(x) + len(heads), "int64"), np.empty(len(x) + len(heads), "int64")
    begins = heads + np.arange(len(heads))
    left[at + node + 1], left[begins] = x, lo
    right[at + node], right[tails + node[tails] + 1] = x - 1, hi
    size = right - left + 1
    parent = np.repeat(np.arange(len(heads)), tails - heads + 2)
    largest = np.flatnonzero(size == np.maximum.reduceat(size, begins)[parent])
    big = largest[np.unique(parent[largest], return_index=True)[1]]
    small = np.ones(len(size), bool)
    small[big] = False
    small = np.flatnonzero(small)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    upto = np.cumsum(size[small])
    cut = 0
    while cut < len(small):
        end = max(cut + 1, int(np.searchsorted(upto, (upto[cut - 1] if cut else 0) + LEAVES, "right")))
        kid = np.repeat(small[cut:end], size[small[cut:end]])
        off = np.arange(len(kid)) - np.repeat(np.cumsum(size[small[cut:end]]) - size[small[cut:end]], size[small[cut:end]])
        p, up = sa[left[kid] + off], parent[kid]
        d = depth[up]
        on = np.flatnonzero(p + d < ends[p])
        r = rank[p[on] + d[on]]
        k, u = kid[on], up[on]
        on = on[(r >= lo[u]) & (r <= hi[u]) & ((r < left[k]) | (r > right[k]))]
        found.append((p[on], d[on]))
        on = np.flatnonzero(p - d >= starts[p])
        r, b = rank[p[on] - d[on]], big[up[on]]
        on = on[(r >= left[b]) & (r <= right[b])]
        found.append((p[on] - d[on], d[on]))
        cut = end
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def runs(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, repeats: int = REPEATS, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all maximal runs of at least `least` words and `repeats` periods, ordered by start, then
    period. starts, ends: for each place those of its text. The period is the smallest one."""
    if not len(words):
        return np.empty((0, 3), "int64")
    ranks = suffix_ranks(words, ends)
    p, d = branching_repeats(ranks, starts, ends)
    back = _extend(ranks, p, p + d, p - starts[p], back=True) if len(p) else p
    got = np.stack([p - back, 2 * d + back, d], axis=1)
    got = got[(got[:, 1] >= least) & (got[:, 1] >= repeats * got[:, 2])]
    got = got[np.lexsort((got[:, 2], got[:, 1], got[:, 0]))]
    one = np.ones(len(got), bool)
    one[1:] = (got[1:, :2] != got[:-1, :2]).any(axis=1)
    got = got[one]
    return got[np.lexsort((got[:, 2], got[:, 0]))]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def best(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period, compared exactly; ties by the smallest start, then period."""
    top = None
    for run in found:
        if top is None or run[1] * top[2] > top[1] * run[2]:
            top = run
    return top


def _block(texts: list[list[bytes]], repeats: int, least: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text."""
    numbers = _Numbers()
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes) - sizes
    words = np.fromiter((numbers[w] for t in texts for w in t), "int64", int(sizes.sum()))
    text = np.repeat(np.arange(len(texts)), sizes)
    got = runs(text * max(1, len(numbers)) + words, starts[text], (starts + sizes)[text], repeats, least)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    of = text[got[:, 0]]
    got[:, 0] -= starts[of]
    for k, run in zip(of.tolist(), got.tolist()):
        out[k].append(tuple(run))
    return out


def _kept(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    cover = np.zeros(len(words) + 1, "int64")
    for start, length, period in found:
        cover[start + period] += 1
        cover[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]


def detect(docs: DataFrame, repeats: int = REPEATS, least: int = LEAST, spans: bool = False) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256; with spans=True also runs (array of
    start, length, period) and collapsed, the text without the repetitions. A map over the rows, with no shuffle."""
    small_batches(docs.sparkSession)
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def rows(ids: list, texts: list[list[bytes]]):
        cols: list[list] = [[] for _ in range(9)]
        for words, found in zip(texts, _block(texts, repeats, least)):
            kept = b" ".join(_kept(words, found) if found else words)
            top = best(found)
            lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
            row = [len(found), *(top or (None,) * 3), top and 1000 * top[1] // top[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()]
            if spans:
                row += [[{"start": s, "length": n, "period": q} for s, n, q in found], kept.decode()]
            for c, v in zip(cols, row):
                c.append(v)
        types = [pa.int64()] * 5 + [pa.string()] * 2 + ([run_type, pa.string()] if spans else [])
        names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"] + ["runs", "collapsed"] * spans
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *(pa.array(c, t) for c, t in zip(cols, types))], names)

    def run(batches):
        for b in batches:
            begin, texts, n = 0, [], 0
            for i, text in enumerate(b.column(1)):
                words = (text.as_py() or "").encode().split()
                if texts and n + len(words) > BLOCK:
                    yield rows([b.column(0).slice(begin, len(texts))], texts)
                    begin, texts, n = i, [], 0
                texts.append(words)
                n += len(words)
            if texts:
                yield rows([b.column(0).slice(begin, len(texts))], texts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema + ", runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string" * spans)


def altered(docs: DataFrame) -> DataFrame:
    """doc_id, text: of every document whose h = crc32(doc_id) is divisible by ten, words from the a-th on repeat p of them."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", WORD.replace("[^", "[")), lambda w: w != "")

    def repeated(w):
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i >= a, F.get(w, (a + (i - a) % p).cast("int"))).otherwise(x)), " ")

    # the words are bound to a variable, as an expression would be worked out anew for each of them
    text = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.col("text"))), 0)
    return docs.select("doc_id", F.when(h % 10 == 0, text).otherwise(F.col("text")).alias("text"))


def query(docs: DataFrame) -> DataFrame:
    return detect(altered(docs))
