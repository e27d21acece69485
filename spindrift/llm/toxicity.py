"""Toxicity by maximum-scoring segments of token log-odds.

Labelled documents give, for each word and each of its prefixes, the numbers of toxic and other documents that hold
it. A word's rate has a Dirichlet prior around the rate of its longest known prefix, that one around the next, and
the first around the rate of all documents; so inflected forms of a toxic stem score before they are common. A
token's score is its log-odds against the base rate, less a drift that makes clean text negative on average. One linear
scan finds all maximal scoring segments of a text (those that no longer segment beats and none overlaps).

Segment scores of clean text follow an extreme-value law, P(S >= x) = 1 - exp(-K n exp(-lambda x)); lambda solves
E exp(lambda s) = 1 over clean tokens and K fits clean documents. A text's significant segments are those expected
less than `expect` times in a clean text of its length. What several segments weigh together is their sum statistic;
it, the best segment, their number and the length go through a logistic curve, fitted on labelled documents each
scored without its own counts.

The model is fitted on at most `sample` labelled rows, those with the smallest hash of doc_id (documented bound, the
whole labelled table when it is smaller); its features are therefore bounded and broadcast. All documents are scored.

Defined cases: null and empty texts score as a text of no tokens; label rows with a null doc_id or label teach nothing,
of several for a document the largest counts; rows repeat as they are; without any label, or with one class only, every
score is the rate of toxic labels (0 without labels). Only doc_id and text are read from documents.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

WORDS = re.compile(r"\w+")
PREFIXES = (4, 5, 6, 7, 8)
SAMPLE = 20_000
CACHE = 400_000


def chain(word: str) -> list[str]:
    """A word's prefixes, shortest first, and the word with an end mark."""
    return [word[:k] for k in PREFIXES if k < len(word)] + [word + "\n"]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, past the last, score), in order, in linear time.

    A segment keeps the sums before and after it and the place of the last segment before it whose sum before is lower,
    so a search jumps over those that are not. Where there is none, all segments so far are final."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    at = np.flatnonzero(scores > 0)
    out: list = []
    stack: list = []
    for i, low, high in zip(at.tolist(), total[at].tolist(), total[at + 1].tolist()):
        first, j = i, len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0:
                out += stack
                stack = [(first, i + 1, low, high, -1)]
                break
            if stack[j][3] >= high:
                stack.append((first, i + 1, low, high, j))
                break
            first, _, low, _, link = stack[j]
            del stack[j:]
            j = link
    return [(a, b, r - l) for a, b, l, r, _ in out + stack]


class Model:
    def __init__(self, counts: dict[str, tuple[int, int]], other: int, toxic: int, alpha: float = 2.0, drift: float = 0.3, expect: float = 0.01):
        self.counts, self.other, self.toxic = counts, other, toxic
        self.alpha, self.drift, self.expect = alpha, drift, expect
        self.lam, self.logk, self.coef = 1.0, 0.0, None
        self.cache: dict[str, float] = {}
        self.known = self._known()

    def _known(self) -> dict[str, float]:
        """The score of every feature, so that a word takes that of its longest known form. A prefix is held by as many documents as
        any longer form, so what is known of a word is known of all its shorter prefixes."""
        base = (self.toxic + 0.5) / (self.toxic + self.other + 1)
        rate: dict[str, float] = {}
        for f in sorted(self.counts, key=lambda f: (f[-1:] == "\n", len(f))):
            forms = chain(f[:-1])[:-1] if f[-1:] == "\n" else [f[:k] for k in PREFIXES if k < len(f)]
            q = next((rate[p] for p in reversed(forms) if p in rate), base)
            a, b = self.counts[f]
            rate[f] = (b + self.alpha * q) / (a + b + self.alpha)
        self.floor = -self.drift
        return {f: math.log(q / (1 - q)) - math.log(base / (1 - base)) - self.drift for f, q in rate.items()}

    def quick(self, word: str) -> float:
        """token() without a label, by the longest known form."""
        known = self.known
        s = known.get(word + "\n")
        if s is None:
            n = len(word)
            for k in (8, 7, 6, 5, 4):
                if k < n and (s := known.get(word[:k])) is not None:
                    return s
            return self.floor
        return s

    def token(self, word: str, label: int | None = None) -> float:
        """label: of a document that holds the word and is to be left out of the counts."""
        t, o = self.toxic - (label == 1), self.other - (label == 0)
        base = q = (t + 0.5) / (t + o + 1)
        for f in chain(word):
            if c := self.counts.get(f):
                a, b = c[0] - (label == 0), c[1] - (label == 1)
                q = (b + self.alpha * q) / (a + b + self.alpha)
            elif f[-1] != "\n":
                break
        return math.log(q / (1 - q)) - math.log(base / (1 - base)) - self.drift

    def tokens(self, text: str, label: int | None = None) -> np.ndarray:
        """Scores of a text's tokens. A word counts again only where the sum of scores has since fallen by as much as it adds: where
        it would lift the sum above the peak since it last counted, it would lengthen the passage that holds it already, and scores
        the drift. So repetition alone makes no passage, and a passage further on has its whole score."""
        words = WORDS.findall(text.lower())
        cache, out, last = self.cache if label is None else {}, [], {}
        total, places, peaks = 0.0, [], []  # peaks that no later one reaches, and where they are
        for w in words:
            s = cache.get(w)
            if s is None:
                if len(cache) >= CACHE:
                    cache.clear()
                s = self.quick(w) if label is None else self.token(w, label)
                if len(w) <= 64 or label is not None:
                    cache[w] = s
            if s > 0:
                if w in last and total + s > peaks[bisect_left(places, last[w])]:
                    s = -self.drift
                else:
                    last[w] = len(out)
                    while peaks and peaks[-1] <= total + s:
                        places.pop(), peaks.pop()
                    places.append(len(out))
                    peaks.append(total + s)
            total += s
            out.append(s)
        return np.array(out)

    def normal(self, score: float, n: int) -> float:
        """The exponent of a segment's expectation: -ln(K n exp(-lambda S))."""
        return self.lam * score - self.logk - math.log(max(n, 1))

    def evidence(self, exponents: list[float]) -> float:
        """-ln of the chance of the best run of highest segments in clean text: for r of them with exponents that sum to T,
        exp(-T) T^(r - 1) / (r! (r - 1)!) (the sum statistic of the extreme-value law)."""
        best = total = 0.0
        for r, x in enumerate(sorted(exponents, reverse=True), 1):
            total += x
            best = max(best, total - (r - 1) * math.log(max(total, 1.0)) + math.lgamma(r + 1) + math.lgamma(r))
        return best

    def facts(self, scores: np.ndarray) -> tuple[list[float], list]:
        """What the curve takes, and the significant segments."""
        n, segs = len(scores), segments(scores)
        best = max((s for _, _, s in segs), default=0.0)
        least = (self.logk + math.log(max(n, 1))) / self.lam
        some = [(x, self.normal(x[2], n)) for x in segs if x[2] > least]
        sig = [x for x, e in some if e >= -math.log(self.expect)]
        clip = lambda x: min(max(x, -20.0), 40.0)
        return [clip(self.evidence([e for _, e in some])), clip(self.normal(best, n)), math.log1p(len(some)), math.log1p(n), math.log1p(best)], sig

    def probability(self, facts: list[float]) -> float:
        if self.coef is None:
            return self.toxic / max(1, self.toxic + self.other)
        z = self.coef[0] + float(np.dot(self.coef[1:], facts))
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def _sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text, y of the labelled training rows in the sample."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "y")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: int = 5) -> Model:
    """The model; features that fewer than `least` sampled documents hold are left out."""
    small_batches(docs.sparkSession)
    rows = _sampled(docs, labels, sample).persist()

    def count(batches):
        c = ({}, {})
        for b in batches:
            for text, y in zip(b.column(0), b.column(1).to_pylist()):
                held = {f for w in set(WORDS.findall(text.as_py().lower())) for f in chain(w)} | {""}
                for f in held:
                    c[y][f] = c[y].get(f, 0) + 1
        names = list(c[0].keys() | c[1].keys())
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, "string"), *[pa.array([c[y].get(f, 0) for f in part], "int64") for y in (0, 1)]], ["f", "a", "b"])

    got = rows.mapInArrow(count, "f string, a bigint, b bigint").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    t = got.where((F.col("a") + F.col("b") >= least) | (F.col("f") == "")).toArrow()
    counts = dict(zip(t["f"].to_pylist(), zip(t["a"].to_pylist(), t["b"].to_pylist())))
    other, toxic = counts.pop("", (0, 0))
    model = Model(counts, other, toxic)
    if not other or not toxic:
        rows.unpersist()
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(step):
        def run(batches):
            m = shared.value if step == 1 else again.value
            hist: Counter = Counter()
            for b in batches:
                out = []
                for text, y in zip(b.column(0), b.column(1).to_pylist()):
                    s = m.tokens(text.as_py(), y)
                    if step == 1:
                        if not y:
                            hist.update(np.round(s * 20).astype(int).tolist())
                            out.append([len(s), float(max((x for *_, x in segments(s)), default=0.0))])
                    else:
                        out.append([y, *m.facts(s)[0]])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([step] * len(out), "int32"), pa.array(out, pa.list_(pa.float64()))], ["step", "x"])
            if hist:
                yield pa.RecordBatch.from_arrays([pa.array([0] * len(hist), "int32"), pa.array([[k / 20, float(v)] for k, v in hist.items()], pa.list_(pa.float64()))], ["step", "x"])

        return run

    got = rows.mapInArrow(measure(1), "step int, x array<double>").toArrow()
    # in order, so that sums do not depend on which task ends first
    kind, x = got["step"].to_numpy(), got["x"].to_pylist()
    hist = np.array(sorted(v for k, v in zip(kind, x) if k == 0))
    seen = np.array(sorted(v for k, v in zip(kind, x) if k == 1))
    model.lam = _lambda(hist[:, 0], hist[:, 1] / hist[:, 1].sum())
    seen = seen[(seen[:, 0] > 0) & (seen[:, 1] > 0)]
    if len(seen):
        model.logk = float(np.mean(model.lam * seen[:, 1] - np.log(seen[:, 0]))) - 0.5772156649
    again = docs.sparkSession.sparkContext.broadcast(model)
    facts = np.array(sorted(rows.mapInArrow(measure(2), "step int, x array<double>").toArrow()["x"].to_pylist()))
    rows.unpersist()
    model.coef = _monotone(facts[:, 1:], facts[:, 0])
    return model


def _lambda(s: np.ndarray, p: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1; 1 if the mean isn't negative or no score is positive."""
    if float((s * p).sum()) >= 0 or s.max() <= 0:
        return 1.0
    low, high = 0.0, 1.0
    f = lambda x: float((p * np.exp(x * s)).sum()) - 1
    while f(high) < 0 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def _monotone(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The curve in which evidence (columns 0 and 1) never speaks against toxicity: a column with a negative weight is left
    out; with neither of them left, as on very few labels, every score is the rate of toxic labels."""
    keep = list(range(x.shape[1]))
    while True:
        w = _logistic(x[:, keep], y)
        bad = [c for c, v in zip(keep, w[1:]) if c < 2 and v <= 0]
        if not bad:
            break
        keep = [c for c in keep if c not in bad]
        if not {0, 1} & set(keep):
            keep, w = [], np.array([math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))])
            break
    out = np.zeros(x.shape[1] + 1)
    out[0] = w[0]
    out[[c + 1 for c in keep]] = w[1:]
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, passages (array of first and last word of the significant segments)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            p, segs = [], []
            for text in b.column(1):
                facts, sig = m.facts(m.tokens(text.as_py() or ""))
                p.append(m.probability(facts))
                segs.append([{"start": a, "end": e, "score": float(s)} for a, e, s in sig])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, "float64"), pa.array([int(x >= cut) for x in p], "int32"), pa.array(segs, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))), b.column(2)], ["doc_id", "score", "predicted", "passages", "th"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, f"doc_id {kind}, score double, predicted int, passages array<struct<start:int,end:int,score:double>>, th bigint")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted", "passages", "th")


def reject(docs: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose text is not predicted toxic."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        m = shared.value
        for b in batches:
            keep = [m.probability(m.facts(m.tokens(x.as_py() or ""))[0]) < cut for x in b.column(at)]
            yield b.filter(pa.array(keep, "bool"))

    return docs.mapInArrow(run, docs.schema)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels)).select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))
