"""Suffix-array dedup by merging the Burrows-Wheeler transforms of shards.

merge() interleaves the transforms of shards by refinement: it starts from any order of shards, and each round sorts
the suffixes by one more symbol with one stable pass over the transforms' symbols, so that no suffix is sorted again.
The round in which two neighbours part is their common prefix plus one, which gives the repeated intervals.

At scale the transforms are of fragments. In every window of 256 places the smallest hash of 16 bytes names an
anchor; equal 400-byte strings have their anchor at the same place, so they can only be equal to strings of anchors
with the same bytes to the right. Strings of one anchor are one fragment (its bytes from the first string's start to
the last one's end). Fragments that are equal throughout are counted first, per task and then globally, so exact copies never
leave that aggregate. Anchors with the same key and different fragments are dealt over buckets of bounded size: there the
fragments' right parts, as strings of 16-byte blocks, are transformed by shard and merged; the intervals of the merged
transform with common prefix 400 - d, refined by the d bytes to the left, are the repeated strings that start d
before the anchor.

A key with more fragments than a bucket may take from one key is divided, and its parts go the same way: the strings that
start 16 i to 16 i + 15 before the anchor are a part, whose key is the 385 bytes that strings of it that can be equal
share. Near copies differ in few places, so most of their parts are equal and are counted; the others are merged. A part
that is still too large (thousands of strings that differ in 15 bytes only) is divided into its single strings, which are
their own keys, so that there is nothing left to sort: they are hashed to 128 bits and counted. No task holds a hot key,
and the result is the same at every size.

Defined cases: null and empty texts, and texts under 400 bytes, lose nothing; overlapping occurrences count; rows that
repeat in full are occurrences of each other; strings are judged on the input. Long texts are read for anchors a slice at a
time. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, salted_left_join, small_batches, staged

LENGTH, WINDOW, GRAM, BLOCK = 400, 256, 16, 16
#: Fragments of a shard, of a bucket on average, and of one key in a bucket at most.
SHARD, BUCKET, HOT = 512, 2048, 1024
#: Strings of so many starts are a part of a fragment of a hot key.
PART = 16
#: Bytes of text of which anchors are sought at once.
SLICE_BYTES = 256 << 10


# --- transforms of collections of strings of positive integers -------------------------------------------------


def transform(strings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one shard: its transform (symbol before each suffix, 0 before a string's start), and each suffix's string
    and offset, in the order of suffixes. A string's end sorts before any symbol, ends by string."""
    size = np.array([len(s) for s in strings])
    text = np.concatenate([np.append(s, 0) for s in strings]).astype("int64")
    string = np.repeat(np.arange(len(strings)), size + 1)
    offset = np.arange(len(text)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
    # ends are told apart by their string, so that every suffix has a rank of its own
    key = np.where(text > 0, text + len(strings), string)
    rank = np.unique(key, return_inverse=True)[1].astype("int64")
    step, longest = 1, int(size.max(initial=0)) + 1
    while step < longest:
        nxt = np.full(len(text), -1)
        ok = np.flatnonzero(offset + step <= np.repeat(size, size + 1))
        nxt[ok] = rank[ok + step]
        rank = np.unique(rank * (len(text) + 1) + nxt + 1, return_inverse=True)[1].astype("int64")
        step *= 2
    order = np.argsort(rank, kind="stable")
    before = np.where(offset > 0, np.append(0, text[:-1]), 0)
    return before[order], string[order], offset[order]


def merge(transforms: list[np.ndarray], counts: list[int], rounds: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Shard of each suffix in the merged order, and the common prefix (in symbols) of each suffix with the one before.

    counts: strings of each shard. rounds: stop early; common prefixes then go up to rounds."""
    n = sum(map(len, transforms))
    z = np.repeat(np.arange(len(transforms)), [len(t) for t in transforms])
    ends = np.repeat(np.arange(len(counts)), counts)
    prefix = np.full(n, -1)
    group = np.zeros(n, "int64")  # of the suffixes that agree in the symbols so far
    k, symbols = 0, np.empty(n, "int64")
    while (prefix < 0).any() and (rounds is None or k <= rounds):
        at = np.argsort(z, kind="stable")  # places of shard 0, then of shard 1, ...
        symbols[at] = np.concatenate(transforms)
        order = np.argsort(symbols, kind="stable")
        c, g = symbols[order], group[order]
        z = z[order]
        z[: len(ends)] = ends
        new = np.ones(n, bool)
        new[1:] = (c[1:] != c[:-1]) | (g[1:] != g[:-1])
        new[: len(ends)] = True  # every string's end is its own
        prefix[new & (prefix < 0)] = k
        group = np.cumsum(new)
        k += 1
    prefix[prefix < 0] = k - 1
    return z, prefix


def merged_order(strings: list[np.ndarray], shard: int = SHARD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String and offset of each suffix in order, and the common prefix with the one before, by shards of strings."""
    parts = [strings[i : i + shard] for i in range(0, len(strings), shard)]
    done = [transform(p) for p in parts]
    z, prefix = merge([t for t, _, _ in done], [len(p) for p in parts])
    string, offset = np.empty(len(z), "int64"), np.empty(len(z), "int64")
    for s, (_, w, o) in enumerate(done):
        at = z == s
        string[at], offset[at] = w + s * shard, o
    return string, offset, prefix


# --- repeated strings among fragments that share their anchor's key --------------------------------------------


def repeated(frags: list[bytes], dmax: np.ndarray, dmin: np.ndarray, times: np.ndarray, length: int = LENGTH, shard: int = SHARD) -> np.ndarray:
    """For each fragment, by d: does the string of `length` that starts d before its anchor occur again?

    Fragment i holds its anchor at dmax[i] and the strings of d from dmin[i] to dmax[i]; it stands for times[i]."""
    n, wide = len(frags), -(-length // BLOCK) * BLOCK
    right = np.zeros((n, wide), "uint8")
    deepest = int(dmax.max(initial=0))
    left = np.zeros((n, max(1, deepest)), "uint8")
    for i, f in enumerate(frags):
        d = int(dmax[i])
        r = np.frombuffer(f, "uint8", len(f) - d, d) if len(f) > d else np.zeros(0, "uint8")
        right[i, : len(r)] = r[:wide]
        left[i, :d] = np.frombuffer(f, "uint8", d)[::-1]
    blocks = np.ascontiguousarray(right).view(">u8").reshape(-1, BLOCK // 8)
    # ranks of blocks follow their bytes, as the eight-byte halves are big-endian
    order = np.lexsort((blocks[:, 1], blocks[:, 0]))
    change = np.append(False, (blocks[order[1:]] != blocks[order[:-1]]).any(axis=1))
    symbols = np.empty(len(order), "int64")
    symbols[order] = np.cumsum(change) + 1
    symbols = symbols.reshape(n, -1)
    string, offset, prefix = merged_order(list(symbols), shard)
    whole = np.flatnonzero(offset == 0)
    sorted_frags = string[whole]
    common = np.minimum.reduceat(prefix[: whole[-1] + 1], np.append(0, whole[:-1] + 1))[1:] if n > 1 else np.zeros(0, "int64")
    # reduceat above spans (previous whole suffix, this one], for every whole suffix but the first
    a, b = sorted_frags[:-1], sorted_frags[1:]
    lcp = np.full(n, -1)
    if n > 1:
        col = np.minimum(common, wide // BLOCK - 1)
        x = np.stack([right[a[:, None], col[:, None] * BLOCK + np.arange(BLOCK)], right[b[:, None], col[:, None] * BLOCK + np.arange(BLOCK)]])
        differ = x[0] != x[1]
        inside = np.where(differ.any(axis=1), differ.argmax(axis=1), BLOCK)
        lcp[1:] = np.where(common >= wide // BLOCK, wide, col * BLOCK + inside)
    out = np.zeros((n, deepest + 1), bool)
    lclass = np.zeros(n, "int64")
    place = np.empty(n, "int64")
    for d in range(deepest + 1):
        if d:
            live = np.flatnonzero(dmax >= d)
            lclass[live] = np.unique(lclass[live] * 256 + left[live, d - 1], return_inverse=True)[1]
        place[sorted_frags] = np.cumsum(lcp < length - d)
        v = np.flatnonzero((dmin <= d) & (d <= dmax))
        if len(v):
            got, inv = np.unique(place[v] * (n + 1) + lclass[v], return_inverse=True)
            out[v, d] = np.bincount(inv, weights=times[v])[inv] >= 2
    return out


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each run of true."""
    edge = np.diff(np.concatenate([[0], flags.astype("int8"), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()))


# --- anchors ---------------------------------------------------------------------------------------------------


def _least(data: np.ndarray, window: int) -> np.ndarray:
    """Of each place of data, where the smallest hash of GRAM bytes is in the `window` places from it on."""
    x = np.zeros(len(data) + GRAM, "uint64")
    x[: len(data)] = data
    v = x[:-1] | x[1:] << np.uint64(8)
    v = v[:-2] | v[2:] << np.uint64(16)
    v = v[:-4] | v[4:] << np.uint64(32)
    h = v[: len(data)] * np.uint64(0x9E3779B97F4A7C15)
    h[: len(v) - 8] ^= (v[8:] * np.uint64(0xC2B2AE3D27D4EB4F))[: len(h)] >> np.uint64(7)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    m = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(data), dtype="uint64")
    w = 1
    while w < window:
        s = min(w, window - w)
        m = np.minimum(m[: len(m) - s], m[s:]) if len(m) > s else m
        w += s
    return (m & np.uint64(0xFFFFFFFF)).astype("int64")


def anchors(parts: list[bytes], length: int = LENGTH, window: int = WINDOW, slice_bytes: int | None = None):
    """(text, anchor, dmax, dmin, key, hash of the fragment) for the anchors of texts of UTF-8 bytes.

    The texts are read in slices of slice_bytes starts, which hold about 70 bytes a byte; only runs of starts are kept."""
    data, slice_bytes = b"".join(parts), slice_bytes or SLICE_BYTES
    ends = np.cumsum([len(p) for p in parts])
    same, key, held = length - window + 1, xxhash.xxh3_64_intdigest, None

    def row(t, a, lo, hi):
        b = int(ends[t]) - len(parts[t])
        return t, a - b, a - lo, a - hi, key(data[a : a + same]), key(data[lo : hi + length], a - lo)

    for s in range(0, len(data), slice_bytes):
        e = min(len(data), s + slice_bytes)
        text = np.searchsorted(ends, np.arange(s, e), "right")
        start = np.flatnonzero(np.arange(s, e) + length <= ends[text])  # where a string of `length` starts
        if not len(start):
            continue
        at = _least(np.frombuffer(data, "uint8", min(len(data), e + length) - s, s), window)[start]
        new = np.append(True, (at[1:] != at[:-1]) | (text[start[1:]] != text[start[:-1]]))
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        for r in zip(text[start[first]].tolist(), (at[first] + s).tolist(), (start[first] + s).tolist(), (start[last] + s).tolist()):
            if held and held[:2] == r[:2]:  # its starts go on from the slice before
                held = (*held[:3], r[3])
                continue
            if held:
                yield row(*held)
            held = r
    if held:
        yield row(*held)


def _signed(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, "uint64").view("int64"))


def anchor_table(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), a, dmax, dmin, key, fh."""
    def batch(b, i, rows):
        t, a, hi, lo, key, fh = zip(*rows)
        take = pa.array(t, "int64")
        return pa.RecordBatch.from_arrays([b.column(0).slice(i).take(take), b.column(1).slice(i).take(take), pa.array(a, "int32"), pa.array(hi, "int16"), pa.array(lo, "int16"), _signed(key), _signed(fh)], ["doc_id", "th", "a", "dmax", "dmin", "key", "fh"])

    def run(batches):
        for b in batches:
            i = 0
            while i < b.num_rows:
                j, part, size = i, [], 0
                while j < b.num_rows and (not part or size < SLICE_BYTES):
                    part.append((b.column(2)[j].as_py() or "").encode())
                    size += len(part[-1])
                    j += 1
                found = anchors(part)
                while rows := list(itertools.islice(found, 4096)):
                    yield batch(b, i, rows)
                i = j

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, f"doc_id {kind}, th bigint, a int, dmax smallint, dmin smallint, key bigint, fh bigint")


def _by_document(rows: DataFrame, docs: DataFrame, how: str) -> DataFrame:
    """rows (__d, __t, ...) unique by document, with docs' doc_id and text."""
    d = docs.select("doc_id", "text").withColumn("__th", F.xxhash64("text"))
    return d.join(rows, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__th") == F.col("__t")), how)


def _cut(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """key, fh, n, dmax, dmin, frag: the bytes of each representative fragment."""
    kept = ["key", "fh", "n", "dmax", "dmin"]
    rows = reps.groupBy(F.col("r.doc_id").alias("__d"), F.col("r.th").alias("__t")).agg(F.collect_list(F.struct(F.col("r.a").alias("a"), *kept)).alias("f"))
    rows = _by_document(rows, docs, "inner").dropDuplicates(["__d", "__t"]).select("text", "f")

    def run(batches):
        for b in batches:
            for text, fs in zip(b.column(0), b.column(1)):
                raw, fs = text.as_py().encode(), fs.as_py()
                yield pa.RecordBatch.from_arrays([*[pa.array([f[k] for f in fs], t) for k, t in zip(kept, ("int64", "int64", "int64", "int16", "int16"))], pa.array([raw[f["a"] - f["dmax"] : f["a"] - f["dmin"] + LENGTH] for f in fs], "binary")], [*kept, "frag"])

    return rows.mapInArrow(run, "key bigint, fh bigint, n bigint, dmax smallint, dmin smallint, frag binary")


SPANS = "key bigint, fh bigint, spans array<struct<lo:int,hi:int>>"
_SPANS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _bucket(key, t):
    order = np.lexsort((t["fh"].to_numpy(), t["key"].to_numpy()))
    t = t.take(pa.array(order))
    flags = repeated(t["frag"].to_pylist(), t["dmax"].to_numpy().astype("int64"), t["dmin"].to_numpy().astype("int64"), t["n"].to_numpy())
    spans = [[{"lo": a, "hi": b} for a, b in runs(f)] for f in flags]
    return pa.table([t["key"], t["fh"], pa.array(spans, _SPANS)], names=["key", "fh", "spans"])


def _whole(frags: DataFrame) -> DataFrame:
    """Spans of fragments that are the only ones of their key."""
    return frags.where("n > 1").select("key", "fh", F.array(F.struct(F.col("dmin").cast("int").alias("lo"), F.col("dmax").cast("int").alias("hi"))).alias("spans"))


def _merged(frags: DataFrame, bucket: int) -> DataFrame:
    """Spans of fragments that share a key with others, by merged transforms; no key may hold more than a bucket takes."""
    buckets = max(1, -(-frags.count() // bucket))
    return frags.withColumn("__b", F.pmod(F.xxhash64("key"), F.lit(buckets))).select("__b", "key", "fh", "n", "dmax", "dmin", "frag").groupBy("__b").applyInArrow(lambda k, t: _bucket(k, t), SPANS).where(F.size("spans") > 0)


def _parts(frags: DataFrame) -> DataFrame:
    """The parts of fragments of hot keys: key, fh (of the whole), pkey, pfh (of the part), n, dmax, dmin, frag."""
    def run(batches):
        for b in batches:
            out = [[] for _ in range(8)]
            for key, fh, n, hi, lo, frag in zip(*(c.to_pylist() for c in b.columns)):
                for i in range(lo // PART, hi // PART + 1):
                    near, far = max(lo, i * PART), min(hi, (i + 1) * PART - 1)
                    own = frag[hi - far : hi - near + LENGTH]
                    shared = frag[hi - i * PART : hi + LENGTH - (i + 1) * PART + 1]
                    for to, x in zip(out, (key, fh, xxhash.xxh3_64_intdigest(shared, i), xxhash.xxh3_64_intdigest(own, far), n, far, near, own)):
                        to.append(x)
                    if len(out[0]) >= 4096:
                        yield batch(out)
                        out = [[] for _ in range(8)]
            yield batch(out)

    def batch(c):
        return pa.RecordBatch.from_arrays([pa.array(c[0], "int64"), pa.array(c[1], "int64"), _signed(c[2]), _signed(c[3]), pa.array(c[4], "int64"), pa.array(c[5], "int16"), pa.array(c[6], "int16"), pa.array(c[7], "binary")], ["key", "fh", "pkey", "pfh", "n", "dmax", "dmin", "frag"])

    return frags.select("key", "fh", "n", "dmax", "dmin", "frag").mapInArrow(run, "key bigint, fh bigint, pkey bigint, pfh bigint, n bigint, dmax smallint, dmin smallint, frag binary")


def _hashed(frags: DataFrame) -> DataFrame:
    """Spans of fragments of hot keys: every string hashed to 128 bits and counted, in partial sums."""
    def run(batches):
        for b in batches:
            for key, fh, n, hi, lo, frag in zip(*(c.to_pylist() for c in b.columns)):
                ds = range(lo, hi + 1)
                h = [xxhash.xxh3_128_intdigest(frag[hi - d : hi - d + LENGTH], d) for d in ds]
                k = len(h)
                yield pa.RecordBatch.from_arrays([pa.array([key] * k, "int64"), pa.array([fh] * k, "int64"), pa.array([n] * k, "int64"), pa.array(ds, "int32"), _signed([x >> 64 for x in h]), _signed([x & (1 << 64) - 1 for x in h])], ["key", "fh", "n", "d", "w1", "w2"])

    rows = staged(frags.select("key", "fh", "n", "dmax", "dmin", "frag").mapInArrow(run, "key bigint, fh bigint, n bigint, d int, w1 bigint, w2 bigint"), "strings")
    again = rows.groupBy("w1", "w2").agg(F.sum("n").alias("k")).where("k > 1").select(F.struct("w1", "w2").alias("w"), F.lit(True).alias("again"))
    hit = salted_left_join(rows.select("key", "fh", "d", F.struct("w1", "w2").alias("w")), again, "w", ["key", "fh", "d"]).where("again")
    return hit.groupBy("key", "fh").agg(_joined(F.transform(F.collect_list("d"), lambda d: F.struct(d.alias("lo"), d.alias("hi")))).alias("spans"))


def _joined(spans):
    """Spans in order, those that touch as one."""
    def add(done, s):
        last = F.element_at(done, -1)
        touch = F.when(F.size(done) > 0, last["hi"] + 1 >= s["lo"]).otherwise(F.lit(False))
        longer = F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], s["hi"]).alias("hi"))
        return F.when(touch, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<lo:int,hi:int>>"), add)


def _divided(frags: DataFrame, bucket: int, hot: int) -> DataFrame:
    """Spans of fragments of hot keys, by their parts."""
    parts = staged(_parts(frags), "parts")
    each = parts.groupBy(F.col("pkey").alias("key"), F.col("pfh").alias("fh")).agg(F.sum("n").alias("n"), F.first("dmax").alias("dmax"), F.first("dmin").alias("dmin"), F.first("frag").alias("frag"))
    each = staged(each, "part-classes")
    kinds = each.groupBy("key").agg(F.count("*").alias("k"))
    each = each.join(kinds, "key")
    spans = _whole(each.where("k = 1")).unionByName(_merged(each.where((F.col("k") > 1) & (F.col("k") <= hot)), bucket)).unionByName(_hashed(each.where(F.col("k") > hot)))
    spans = staged(spans.select(F.struct("key", "fh").alias("f"), "spans"), "part-spans")
    hit = salted_left_join(parts.select("key", "fh", F.struct(F.col("pkey").alias("key"), F.col("pfh").alias("fh")).alias("f")), spans, "f", ["key", "fh"]).where("spans is not null")
    return hit.groupBy("key", "fh").agg(_joined(F.flatten(F.collect_list("spans"))).alias("spans"))


def repeats(docs: DataFrame, bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """doc_id, th, covered: array of (start, end) of bytes in repeated strings; only documents that have some."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    table = staged(anchor_table(docs), "anchors")
    frags = table.groupBy("key", "fh").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "a")).alias("r"), F.min("dmax").alias("dmax"), F.min("dmin").alias("dmin"))
    keys = table.groupBy("key").agg(F.count("*").alias("total")).where("total > 1").select("key")
    fragments = staged(frags.join(keys, "key", "left_semi"), "fragments")
    kinds = fragments.groupBy("key").agg(F.count("*").alias("k"))
    frags = fragments.join(kinds, "key")
    several = staged(_cut(docs, frags.where("k > 1")).join(kinds, "key"), "cut")
    spans = _whole(frags.where("k = 1")).unionByName(_merged(several.where(F.col("k") <= hot), bucket)).unionByName(_divided(several.where(F.col("k") > hot), bucket, hot))
    spans = staged(spans.select(F.struct("key", "fh").alias("f"), "spans"), "spans")
    discard(fragments, several)
    hit = salted_left_join(table.select("doc_id", "th", "a", F.struct("key", "fh").alias("f")), spans, "f", ["doc_id", "th", "a"]).where("spans is not null")
    ranges = F.transform("spans", lambda s: F.struct((F.col("a") - s["hi"]).alias("start"), (F.col("a") - s["lo"] + LENGTH).alias("end")))
    # rows that repeat in full have the same ranges, which count once
    return hit.groupBy("doc_id", "th").agg(F.flatten(F.collect_set(ranges)).alias("covered"))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that remain) for every row.

    Spans may end within a character; kept is then no UTF-8."""
    hit = repeats(docs).select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), "covered")
    rows = _by_document(hit, docs, "left").select("doc_id", "text", "covered")

    def run(batches):
        for b in batches:
            out = []
            for text, covered in zip(b.column(1), b.column(2)):
                raw, spans = (text.as_py() or "").encode(), []
                for s in sorted((c["start"], c["end"]) for c in covered.as_py() or ()):
                    if spans and s[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], s[1])
                    else:
                        spans.append(list(s))
                at, kept = 0, []
                for s, e in spans:
                    kept.append(raw[at:s])
                    at = e
                left = b"".join([*kept, raw[at:]])
                out.append((len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, ("int64", "int64", "int64", "string", "binary"))]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def query(docs: DataFrame) -> DataFrame:
    """dedup() with what remains: kept_bytes, and text, in which the rest of a cut character is U+FFFD."""
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.octet_length("kept").cast("long").alias("kept_bytes"), F.expr("make_valid_utf8(cast(kept as string))").alias("text"))
