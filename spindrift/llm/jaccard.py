"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set holds its distinct word n-grams as 64-bit hashes. Documents with equal sets are one class from the
start (a 128-bit digest of the set names it; after the classes are known, a number). Tokens are ordered rare first, by a table of counts over all classes and documents
(2^18 hash buckets, so its size is fixed) and then by hash: any total order gives right results, this one keeps
frequent n-grams out of the prefixes. Two sets of similarity t share a token in their prefixes of n - ceil(t n) + 1.

Only links between components matter to the result, so a frequent prefix token does not pair all its classes:

1. twice, each token names a centre (first the class in whose order the token stands first, which is the least edited
   text of a group of copies; then any other), each class proposes the centre that most of its tokens name, and
   proposals that pass the filters are verified;
2. tokens whose classes are now all in one component are done; for the rest all pairs of classes from different
   components meet on the token, pass the length, positional and suffix filters, and are verified, each pair once.
   The suffix filter bounds from below how many n-grams differ, by a partition of the sets: 512 parts by hash, of
   each of which the parity of its size is kept, so that the bound is a count of bits.

Step 2 leaves no pair out, so components are exact. Verifying reads both whole texts again and intersects the
sets. Components come from alternating star contractions, with a checkpoint a round; nothing is collected but the
table of counts and two numbers a round.

Defined cases: null and empty texts, and texts without words, have an empty set and are linked with nothing; texts
of fewer words than n have one n-gram, the whole sequence; rows that share a doc_id are separate documents of one
name; a null doc_id is never a component's name unless all are null; empty tables give no rows. Only doc_id and text
are read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, salted_left_join, small_batches, staged

BUCKETS = 1 << 18
PART_BYTES = 4 << 20
#: Parts of a set by hash, for the suffix filter.
PARTS = 512
#: Rows of a token or class that meet in one task, about.
SALTED = 512

_rng = np.random.default_rng(20240229)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTE = _rng.integers(1, 2**63, 256, dtype="uint64") * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NEXT = np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_places = np.array([], "uint64")


def _place(n: int) -> np.ndarray:
    """A multiplier for each place in a word. They are mixed from the place's number and have no structure: powers of one base
    would, and words such as Thue and Morse's and its complement then have equal sums."""
    global _places
    if len(_places) < n:
        _places = _mix(np.arange(max(n, 4096), dtype="uint64") * _BASE + _NEXT) | np.uint64(1)
    return _places


def _grams(data: np.ndarray, starts: np.ndarray, n: int) -> list[np.ndarray]:
    """For texts laid end to end in data (text i starts at starts[i]): sorted distinct n-gram hashes of each."""
    texts = len(starts) - 1
    none = np.array([], "uint64")
    word = ~_SPACE[data]
    if not word.any():
        return [none] * texts
    first = word.copy()
    first[1:] &= ~word[:-1]
    edge = starts[1:-1]
    edge = edge[edge < len(data)]
    first[edge] = word[edge]
    at = np.flatnonzero(word)
    heads = np.flatnonzero(first[at])  # within at
    size = np.diff(np.append(heads, len(at)))
    inside = np.arange(len(at)) - np.repeat(heads, size)
    h = _mix(np.add.reduceat(_BYTE[data[at]] * _place(int(size.max()))[inside], heads) + size.astype("uint64"))
    doc = np.searchsorted(starts, at[heads], "right") - 1
    count = np.bincount(doc, minlength=texts)
    g = h.copy()
    for j in range(1, n):
        g = _mix(g * _NEXT + np.append(h[j:], np.zeros(min(j, len(h)), "uint64"))[: len(h)])
    begin = np.concatenate([[0], np.cumsum(count)])
    out = []
    for i in range(texts):
        a, c = begin[i], count[i]
        if c >= n:
            out.append(np.unique(g[a : a + c - n + 1]))
        elif c:
            x = h[a : a + 1]
            for j in range(1, c):
                x = _mix(x * _NEXT + h[a + j : a + j + 1])
            out.append(_mix(x + np.uint64(c)))
        else:
            out.append(none)
    return out


def gram_sets(col: pa.Array, n: int):
    """Sets of a column of texts, a bounded number of bytes at a time."""
    i = 0
    while i < len(col):
        part, size = [], 0
        while i < len(col) and (not part or size < PART_BYTES):
            part.append((col[i].as_py() or "").encode())
            size += len(part[-1])
            i += 1
        starts = np.concatenate([[0], np.cumsum([len(x) for x in part])])
        yield from _grams(np.frombuffer(b"".join(part), "uint8"), starts, n)


def _digest(s: np.ndarray) -> tuple[int, int]:
    h = hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest()
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def _parities(s: np.ndarray) -> list[int]:
    """Each n-gram that only one of two sets holds changes one bit, so sets differ in as many n-grams as bits at least."""
    odd = np.bincount((s & np.uint64(PARTS - 1)).astype("int64"), minlength=PARTS) & 1
    return np.packbits(odd.astype("uint8")).view("<i8").tolist()


def _kind(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


def members(docs: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """doc_id, s1, s2 (digest of the set; null if empty), n (size of the set), th (hash of the text, which with doc_id finds it
    again), and the documents that hold an n-gram of each bucket, over all documents: both from one pass over the texts. A task
    sends one row per bucket at most; those rows have a bucket and no document."""
    def run(batches):
        c = np.zeros(BUCKETS, "int64")
        kind = None
        for b in batches:
            kind = b.column(0).type
            rows = ([], [], [])
            for s in gram_sets(b.column(1), n):
                np.add.at(c, (s >> np.uint64(46)).astype("int64"), 1)
                for to, x in zip(rows, (*(_digest(s) if len(s) else (None, None)), len(s))):
                    to.append(x)
            nothing = pa.nulls(b.num_rows, "int32"), pa.nulls(b.num_rows, "int64")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows[0], "int64"), pa.array(rows[1], "int64"), pa.array(rows[2], "int64"), b.column(2), *nothing], names)
        if kind is not None:
            k = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(k), kind), *[pa.nulls(len(k), "int64")] * 4, pa.array(k.astype("int32")), pa.array(c[k])], names)

    names = ["doc_id", "s1", "s2", "n", "th", "bucket", "c"]
    every = staged(docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, f"doc_id {_kind(docs, 'doc_id')}, s1 bigint, s2 bigint, n bigint, th bigint, bucket int, c bigint"), "members")
    got = every.where("bucket is not null").groupBy("bucket").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(BUCKETS, "int64")
    out[got["bucket"].to_numpy()] = got["c"].to_numpy()
    mem = every.where("bucket is null").drop("bucket", "c")
    mem._staged = every._staged
    return mem, out


def prefixes(docs: DataFrame, n: int, num: int, den: int, freq: np.ndarray) -> DataFrame:
    """A row per class: sid (its number), s1, s2, n, parities (of the sizes of the set's parts, as bits), prefix (array of
    tokens, rare first)."""
    table = docs.sparkSession.sparkContext.broadcast(freq)
    names = ["s1", "s2", "n", "parities", "prefix"]

    def run(batches):
        freq = table.value
        for b in batches:
            rows = ([], [], [], [], [])
            for s in gram_sets(b.column(0), n):
                if not len(s):
                    continue
                order = np.lexsort((s, freq[(s >> np.uint64(46)).astype("int64")]))
                keep = len(s) - -(-num * len(s) // den) + 1
                for to, x in zip(rows, (*_digest(s), len(s), _parities(s), s[order[:keep]].astype("int64"))):
                    to.append(x)
            sizes = np.cumsum([0, *map(len, rows[4])])
            prefix = pa.ListArray.from_arrays(pa.array(sizes, "int32"), pa.array(np.concatenate(rows[4]) if rows[4] else [], "int64"))
            yield pa.RecordBatch.from_arrays([*[pa.array(c, "int64") for c in rows[:3]], pa.array(rows[3], pa.list_(pa.int64())), prefix], names)

    all_rows = docs.select("text").mapInArrow(run, "s1 bigint, s2 bigint, n bigint, parities array<bigint>, prefix array<bigint>")
    classes = all_rows.groupBy("s1", "s2").agg(*[F.first(c).alias(c) for c in names[2:]])
    return staged(classes.withColumn("sid", F.monotonically_increasing_id()), "prefixes")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (sid, root): root is the smallest sid of the component. Alternating large-star and small-star, until
    a round changes nothing."""
    e = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        old, e = e, staged(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "cc")
        discard(old)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    return e.select(F.col("u").alias("sid"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("sid"), F.col("v").alias("root")).distinct())


def _need(num: int, den: int):
    """Least intersection of two sets that are similar."""
    return F.ceil(F.lit(num) * (F.col("na") + F.col("nb")) / F.lit(num + den))


def _filters(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Length and positional filters. pairs: a, b, na, nb, pa, pb (places of the first shared prefix token)."""
    pairs = pairs.where((F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num))
    return pairs.where(F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= _need(num, den))


def _differ(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """The suffix filter's lower bound on how many tokens only one of two sorted sets holds: y's middle token splits both,
    and so on. At the last depth pieces differ by their sizes' difference at least."""
    if not len(x) or not len(y) or not depth:
        return abs(len(x) - len(y))
    m = len(y) // 2
    i = int(np.searchsorted(x, y[m]))
    hit = i < len(x) and x[i] == y[m]
    return _differ(x[:i], y[:m], depth - 1) + _differ(x[i + hit :], y[m + 1 :], depth - 1) + (not hit)


def _salted(df: DataFrame, counts: DataFrame, key: str, other: str) -> DataFrame:
    """Adds __salt: a key with k rows (counts: key, __k) is dealt over k / SALTED salts by a hash of other."""
    return df.join(counts, key).withColumn("__salt", F.pmod(F.xxhash64(other), F.ceil(F.col("__k") / F.lit(float(SALTED)))).cast("int")).drop("__k")


def _every_salt(df: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """A row for each of its key's salts."""
    return df.join(counts, key).withColumn("__salt", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("__k") / F.lit(float(SALTED))) - 1).cast("int")))).drop("__k")


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Of (a, b), those whose sets are similar; the whole texts are read again. Rows come sorted by b: its set is kept.

    A class b that many pairs share is copied for its salts, so no task gets all its partners' texts."""
    texts = reps.join(docs, F.col("__d").eqNullSafe(F.col("doc_id")) & (F.col("__t") == F.xxhash64("text")), "inner").select("sid", "text")
    wanted = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    texts = staged(texts.join(wanted, "sid", "left_semi").dropDuplicates(["sid"]), "texts")
    fan = pairs.groupBy("b").agg(F.count("*").alias("__k"))
    left = _salted(pairs, fan, "b", "a").join(texts.select(F.col("sid").alias("a"), F.col("text").alias("ta")), "a")
    right = _every_salt(texts.select(F.col("sid").alias("b"), F.col("text").alias("tb")), fan, "b")
    both = left.join(right, ["b", "__salt"]).select("a", "b", "ta", "tb")

    def run(batches):
        held = (None, None)
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for i, x in enumerate(gram_sets(batch.column(2), n)):
                if held[0] != b[i]:
                    held = (b[i], next(gram_sets(batch.column(3).slice(i, 1), n)))
                y = held[1]
                least = -(-num * (len(x) + len(y)) // (num + den))  # tokens that similar sets share
                if _differ(x, y) > len(x) + len(y) - 2 * least:
                    keep.append(False)
                    continue
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(large, small)
                same = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep.append(den * same >= num * (len(x) + len(y) - same))
            k = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in k], "int64"), pa.array([b[i] for i in k], "int64")], ["a", "b"])

    out = staged(both.mapInArrow(run, "a bigint, b bigint"), "links")
    discard(texts)
    return out


def links(docs: DataFrame, n: int, num: int, den: int, rounds: int = 2, pairs: bool = False) -> tuple[DataFrame, DataFrame]:
    """members() with sid (the class; null if empty), and the roots (sid, root) of classes in components of two classes or more.

    pairs: instead of the roots, every pair (a, b) of similar classes, a < b."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    mem, freq = members(docs, n)
    pre = prefixes(docs, n, num, den, freq)
    names = pre.select(F.struct("s1", "s2").alias("s"), "sid")
    raw, mem = mem, staged(salted_left_join(mem.withColumn("s", F.when(F.col("s1").isNotNull(), F.struct("s1", "s2"))), names, "s", ["doc_id", "th"]).select("doc_id", "sid", "n", "th"), "members")
    discard(raw)
    reps = staged(mem.where("sid is not null").groupBy("sid").agg(F.min(F.struct("doc_id", "th")).alias("r")).select("sid", F.col("r.doc_id").alias("__d"), F.col("r.th").alias("__t")), "classes")
    tok = pre.select("sid", "n", F.posexplode("prefix").alias("pos", "tok"))
    shared = tok.groupBy("tok").agg(F.count("*").alias("k")).where("k > 1").select("tok")
    tok = staged(tok.join(shared, "tok", "left_semi"), "tokens")
    found, roots = None, None
    for r in range(0 if pairs else rounds):
        rows = tok
        if roots is not None:
            rows = rows.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
            live = rows.groupBy("tok").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("tok")
            old, rows = tok, staged(rows.join(live, "tok", "left_semi"), "tokens")
            discard(old)
            first = F.min(F.struct(F.xxhash64("sid"), F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("root").alias("rb")))
            tok = rows.drop("root")
            tok._staged = rows._staged
        else:
            first = F.min(F.struct("pos", F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("sid").alias("rb")))
            rows = rows.withColumn("root", F.col("sid"))
        named = salted_left_join(rows, rows.groupBy("tok").agg(first.alias("c")), "tok", ["sid"]).select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("root").alias("ra"), "c.b", "c.nb", "c.pb", "c.rb")
        votes = named.where("ra <> rb").groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.count("*").alias("votes"))
        votes = _filters(votes, num, den).withColumn("first", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("votes"), "b"))).where("first = 1")
        asked = staged(votes.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        new = verified(asked, docs, reps, n, num, den)
        discard(asked)
        found = new if found is None else found.unionByName(new)
        roots = components(found)
    rows = tok.withColumn("root", F.col("sid"))
    if roots is not None:
        rows = tok.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    live = rows.groupBy("tok").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("__k")).where("x <> y")
    rows = staged(rows.join(live.select("tok"), "tok", "left_semi").join(pre.select("sid", "parities"), "sid"), "live")
    live = live.select("tok", "__k")
    side = lambda s: rows.select("tok", F.col("sid").alias(s), F.col("n").alias(f"n{s}"), F.col("pos").alias(f"p{s}"), F.col("root").alias(f"r{s}"), F.col("parities").alias(f"o{s}"))
    a, b = _salted(side("a"), live, "tok", "a"), _every_salt(side("b"), live, "tok")
    # the filters need sizes, places and parities alone, so unlikely pairs go within the join
    ok = (F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num)
    ok = ok & (F.least("pa", "pb") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= _need(num, den))
    differ = sum((F.bit_count(F.get("oa", F.lit(i)).bitwiseXOR(F.get("ob", F.lit(i)))) for i in range(PARTS // 64)), F.lit(0))
    ok = ok & (differ <= F.col("na") + F.col("nb") - 2 * _need(num, den))
    met = a.join(b, (a["tok"] == b["tok"]) & (a["__salt"] == b["__salt"]) & (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & ok)
    met = met.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.min("pa").alias("pa"), F.min("pb").alias("pb"))
    asked = staged(_filters(met, num, den).select("a", "b"), "pairs")
    new = verified(asked, docs, reps, n, num, den)
    discard(asked, rows, tok, pre)
    if pairs:
        return mem, new
    return mem, components(found.unionByName(new) if found is not None else new)


def join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, th (hash of the text), root (the component itself, by its smallest sid; null if empty) for every row.

    component_id is a name only: components of unrelated texts share it where their documents share a doc_id or have none."""
    mem, roots = links(docs, n, num, den)
    mem = mem.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    names = mem.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("k")).where("k > 1").select("root", "component_id")
    out = salted_left_join(mem, names, "root", ["doc_id", "th"])
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "th", "root")


def query(docs: DataFrame) -> DataFrame:
    """Three-word shingles, similarity 0.9."""
    return join(docs, 3, 90, 100).drop("th", "root")
