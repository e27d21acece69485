"""Language identification by partial matching: one variable-order byte context tree a language, with frozen counts.

A byte s after the context c (the `order` bytes before it, zeros before a text's beginning) is coded in the longest context that the
tree holds: with probability n(c, s) / (N + T) if it was seen there, N being the bytes and T the different bytes seen after c; else
by an escape of probability T / (N + T) into the context one byte shorter, where bytes that the longer one knows are excluded
from all counts; below the empty context all bytes left are equally likely. A text's code length in a language is the sum over its bytes, in whole
units of 2^-20 bit, so that it doesn't depend on the order of summation; the language of the shortest code wins, by name on ties.

Counts are gathered from all training rows by Spark. As the tree goes to every worker, its size is bounded: of each language's
contexts those are nodes that occur often enough for all that occur as often to have `entries` / languages (context, byte) pairs
together (in steps of an eighth of a doubling; a context's suffix is never rarer than itself, so the tree is closed). Longer or rarer
contexts, and texts of any size, are coded through escapes: nothing is left out.

For speed the trees of all languages are laid into two tables an order: rows of costs by (context, byte), and rows of escape costs by
context, the latter in two forms, as the exclusions change the shorter context's denominator, and its escape too if it doesn't know the byte.

Defined cases: texts that are null or hold no letter are `und` with score 0, as are all if nothing could be learned (no training row, or an
empty table); a null doc_id has no remainder: not held out; rows repeat as they are; other columns' names don't matter; texts
are never cut, and a very long one is scored a slice at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, staged, utf8

#: Bytes of context; pairs of context and byte in all trees together; one bit in units of a cost; bytes scored at a time.
ORDER, ENTRIES, UNIT, SLICE = 4, 1 << 20, 1 << 20, 1 << 18
#: Each language is a column of the cost tables, which have at most so many cells; more languages than this are an error.
CELLS, LANGUAGES = 1 << 24, 256


class Table:
    """Numbers of known keys, by open addressing; -1 for others."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys, self.number = np.full(1 << bits, ~np.uint64(0)), np.full(1 << bits, -1, "int32")
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = todo[self.number[slot[todo]] < 0]
            self.number[slot[free]] = free  # of several for one slot the last stays
            self.keys[slot[free]] = keys[free]
            todo = todo[self.number[slot[todo]] != todo]
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        got = self.number[slot]
        todo = np.flatnonzero((self.keys[slot] != keys) & (got >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask
            at = slot[todo]
            got[todo] = self.number[at]
            todo = todo[(self.keys[at] != keys[todo]) & (got[todo] >= 0)]
        return got


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For every byte of texts laid end to end, it and the `order` bytes before it in its text (zeros before), as one number."""
    size = np.diff(offsets)
    base = int(offsets[0])
    shift = np.repeat(np.arange(1, len(size) + 1) * order, size)
    at = np.arange(len(shift)) + shift
    x = np.zeros(len(shift) + (len(size) + 1) * order, "uint64")
    x[at] = data[base : base + len(shift)]
    out = x[at]
    for k in range(1, order + 1):
        out |= x[at - k] << np.uint64(8 * k)
    return out


def _bits(x: np.ndarray) -> np.ndarray:
    return np.rint(np.log2(x) * UNIT).astype("int64")


class Model:
    """Context trees, made of rows (lang, order, gram, n): gram is the context's bytes and, last, the byte that follows."""

    def __init__(self, names: list[str], order: int, lang: np.ndarray, level: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.names, self.order, count = names, order, len(names)
        self.grams, self.costs, self.hits, self.contexts, self.escapes = [], [], [], [], []
        below: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # contexts, bytes seen, different bytes of the order below
        for j in range(order + 1):
            here = level == j
            keys = np.unique(gram[here])
            ctx = np.unique(keys >> np.uint64(8))
            freq = np.zeros((len(keys), count), "int64")
            freq[np.searchsorted(keys, gram[here]), lang[here]] = n[here]
            of = np.searchsorted(ctx, keys >> np.uint64(8))
            total, kinds = np.zeros((len(ctx), count), "int64"), np.zeros((len(ctx), count), "int64")
            np.add.at(total, of, freq)
            np.add.at(kinds, of, (freq > 0).astype("int64"))
            hit, node = freq > 0, kinds > 0
            # the next shorter context: its counts less those of the bytes known here
            short = keys & np.uint64((1 << (8 * j)) - 1)  # the gram without its first byte
            if j:
                keys0, ctx0, freq0, total0, kinds0, hit0 = below
                at0, c0 = np.searchsorted(keys0, short), np.searchsorted(ctx0, ctx & np.uint64((1 << (8 * (j - 1))) - 1))
                known = np.zeros((len(ctx), count), "int64")
                np.add.at(known, of, np.where(hit, freq0[at0], 0))
                den0, kinds_of = total0[c0] + kinds0[c0], kinds0[c0]
                rest, left = total0[c0] - known + kinds0[c0] - kinds, kinds0[c0] - kinds
            else:
                den0, kinds_of, rest, left = np.full((1, count), 256), np.full((1, count), 256), 256 - kinds, 256 - kinds
            one = lambda x: np.maximum(x, 1)  # noqa: E731 - values where there is no node are not used
            escape = _bits(one(total + kinds) / one(kinds))
            seen = escape + _bits(one(rest) / one(den0))
            again = np.where(left > 0, seen + _bits(one(kinds_of) / one(left)), escape - _bits(one(den0) / one(kinds_of)))
            seen, again = np.where(node, seen, 0), np.where(node, again, 0)
            longer = self.costs[j - 1][at0] if j else np.full((len(keys), count), 8 * UNIT)
            known_below = hit0[at0] if j else np.ones((len(keys), count), bool)
            cost = np.where(hit, _bits(one(total + kinds)[of] / one(freq)), longer + np.where(known_below, seen[of], again[of]))
            self.grams.append(Table(keys)), self.contexts.append(Table(ctx))
            self.costs.append(cost), self.hits.append(hit), self.escapes.append((seen, again))
            below = (keys, ctx, freq, total, kinds, hit)
        self.costs = [c.astype("int32") for c in self.costs]
        self.escapes = [(a.astype("int32"), b.astype("int32")) for a, b in self.escapes]

    def code(self, gram: np.ndarray) -> np.ndarray:
        """(byte, language): the cost of each byte after its context."""
        out = np.empty((len(gram), len(self.names)), "int32")
        todo, extra = np.arange(len(gram)), None
        for j in range(self.order, -1, -1):
            key = gram[todo] & np.uint64((1 << (8 * (j + 1))) - 1)
            at = self.grams[j].find(key)
            ok = at >= 0
            row, known = self.costs[j][at[ok]], self.hits[j][at[ok]]
            if extra is not None:
                row = row + extra[ok] + self._above(j, gram[todo[ok]], known)
                extra = extra[~ok] + self._above(j, gram[todo[~ok]], None)
            else:
                extra = np.zeros((int((~ok).sum()), len(self.names)), "int32")
            out[todo[ok]] = row
            todo = todo[~ok]
            if not len(todo):
                return out
        out[todo] = 8 * UNIT + extra + self._above(-1, gram[todo], True)
        return out

    def _above(self, j: int, gram: np.ndarray, known) -> np.ndarray:
        """Costs of the escape from the context of order j + 1 into that of order j. known: whether the byte is known there."""
        if j == self.order or not len(self.escapes[j + 1][0]):
            return np.int32(0)
        at = self.contexts[j + 1].find((gram & np.uint64((1 << (8 * (j + 2))) - 1)) >> np.uint64(8))
        seen, again = self.escapes[j + 1]
        got = again[at] if known is None else seen[at] if known is True else np.where(known, seen[at], again[at])
        return np.where((at >= 0)[:, None], got, np.int32(0))

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(text, language): code lengths in units of texts laid end to end."""
        gram, begin = grams(data, offsets, self.order), offsets - offsets[0]
        total = np.zeros((len(offsets) - 1, len(self.names)), "int64")
        for a in range(0, len(gram), SLICE):
            b = min(a + SLICE, len(gram))
            i, k = int(np.searchsorted(begin, a, "right")) - 1, int(np.searchsorted(begin, b, "left"))
            some = np.flatnonzero(begin[i + 1 : k + 1] > np.maximum(begin[i:k], a)) + i  # texts with bytes in the slice
            total[some] += np.add.reduceat(self.code(gram[a:b]), np.maximum(begin[some] - a, 0), axis=0, dtype="int64")
        return total

    def best(self, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language of the shortest code, and its share of 2^-length over all languages."""
        first = total.argmin(axis=1)
        gap = (total - total[np.arange(len(total)), first][:, None]) / UNIT
        return first, 1 / np.exp2(-np.minimum(gap, 1000)).sum(axis=1)


def _counts(rows: DataFrame, names: list[str], order: int) -> DataFrame:
    """lang int, gram long, n long of rows (lang, text), summed per batch and then by Spark."""
    number = {x: i for i, x in enumerate(names)}

    def run(batches):
        for b in batches:
            data, offsets = utf8(pc.fill_null(b.column(1), ""))
            if offsets[-1] == offsets[0]:
                continue
            of = np.array([number[x] for x in b.column(0).to_pylist()], "uint64")
            gram = grams(data, offsets, order) | np.repeat(of, np.diff(offsets)) << np.uint64(8 * (order + 1))
            key, n = np.unique(gram, return_counts=True)
            low = np.uint64((1 << (8 * (order + 1))) - 1)
            cols = (key >> np.uint64(8 * (order + 1))).astype("int32"), (key & low).astype("int64"), n.astype("int64")
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["lang", "gram", "n"])

    one = rows.select("lang", "text").mapInArrow(run, "lang int, gram bigint, n bigint")
    return one.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame, order: int = ORDER, entries: int = ENTRIES) -> Model | None:
    """The model of all rows (lang, text) whose lang is not null; None if there are none. order: at most 5."""
    if not 0 <= order <= 5:
        raise ValueError(f"order {order}")
    small_batches(rows.sparkSession)
    rows = rows.where(F.col("lang").isNotNull())
    names = sorted(r[0] for r in rows.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if not names:
        return None
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    levels = F.explode(F.array(*[F.struct(F.lit(j).alias("level"), F.col("gram").bitwiseAND((1 << (8 * (j + 1))) - 1).alias("gram")) for j in range(order + 1)])).alias("x")
    every = _counts(rows, names, order).select("lang", "n", levels).groupBy("lang", "x.level", "x.gram").agg(F.sum("n").alias("n"))
    byte = F.struct(F.col("gram"), F.col("n"))
    nodes = every.groupBy("lang", "level", F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("total"), F.collect_list(byte).alias("bytes"))
    nodes = staged(nodes.withColumn("step", F.floor(F.log2("total") * 8).cast("int")), "contexts")
    held = nodes.groupBy("lang", "step").agg(F.sum(F.size("bytes")).alias("pairs")).collect()  # some 500 steps a language at most
    least = {}
    for i in range(len(names)):
        room = min(entries, CELLS // len(names)) // len(names)
        for r in sorted((r for r in held if r["lang"] == i), key=lambda r: -r["step"]):
            room -= r["pairs"]
            if room < 0 and i in least:
                break
            least[i] = r["step"]
    keep = F.lit(False)
    for step in set(least.values()):
        keep = keep | (F.col("lang").isin([i for i in least if least[i] == step]) & (F.col("step") >= step))
    t = nodes.where(keep).select("lang", "level", F.inline("bytes")).toArrow()
    discard(nodes)
    col = lambda x: t[x].to_numpy()
    return Model(names, order, col("lang"), col("level"), col("gram").astype("uint64"), col("n"))


def predict(docs: DataFrame, model: Model | None, lengths: bool = False) -> DataFrame:
    """doc_id, lang_pred, score; lengths=True: also bits, the code length in bits of each language by name. No shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            text = pc.fill_null(b.column(1), "")
            data, offsets = utf8(text)
            name, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
            bits: list[dict] = [{} for _ in name]
            if m is not None and b.num_rows:
                total = m.lengths(data, offsets)
                first, share = m.best(total)
                for i in np.flatnonzero(pc.match_substring_regex(text, r"\pL").to_numpy(zero_copy_only=False)):
                    name[i], score[i] = m.names[first[i]], share[i]
                if lengths:
                    bits = [dict(zip(m.names, (row / UNIT).tolist())) for row in total]
            cols = [b.column(0), pa.array(name, "string"), pa.array(score, "float64")]
            if lengths:
                cols.append(pa.array([list(x.items()) for x in bits], pa.map_(pa.string(), pa.float64())))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang_pred", "score"] + ["bits"] * lengths)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double" + ", bits map<string,double>" * lengths)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def query(docs: DataFrame) -> DataFrame:
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("lang", "text"))
    out = predict(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
