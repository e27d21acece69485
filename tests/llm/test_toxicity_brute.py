"""The registered toxicity query against a plain computation of every number in it."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from spindrift.llm import toxicity
from tests.llm.test_methods import naive_segments

ALPHA, DRIFT, EXPECT, LEAST = 2.0, 0.3, 0.01, 5


def forms(word):
    return [word[:k] for k in (4, 5, 6, 7, 8) if k < len(word)] + [word + "\n"]


def words_of(text):
    return re.findall(r"\w+", text.lower())


def score_of(word, counts, other, toxic, label):
    """Smoothed log-odds against the base rate, without the document's own label if there is one."""
    n1, n0 = toxic - (label == 1), other - (label == 0)
    base = rate = (n1 + 0.5) / (n1 + n0 + 1)
    for f in forms(word):
        if f in counts:
            c0, c1 = counts[f][0] - (label == 0), counts[f][1] - (label == 1)
            rate = (c1 + ALPHA * rate) / (c0 + c1 + ALPHA)
    return math.log(rate / (1 - rate)) - math.log(base / (1 - base)) - DRIFT


def scores_of(text, counts, other, toxic, label=None):
    """A positive word counts again only if the sum has fallen enough: it must not pass the highest sum since it last counted."""
    out, sums, counted = [], [], {}
    for w in words_of(text):
        s = score_of(w, counts, other, toxic, label)
        total = sums[-1] if sums else 0.0
        if s > 0:
            if w in counted and total + s > max(sums[i] for i in range(counted[w], len(sums)) if out[i] > 0):
                s = -DRIFT
            else:
                counted[w] = len(out)
        out.append(s)
        sums.append(total + s)
    return out


def facts_of(scores, lam, logk):
    n = len(scores)
    segs = [s for _, _, s in naive_segments(scores)]
    exponent = lambda s: lam * s - logk - math.log(max(n, 1))
    e = sorted((exponent(s) for s in segs if exponent(s) > 0), reverse=True)
    best, total = 0.0, 0.0
    for r, x in enumerate(e, 1):
        total += x
        best = max(best, total - (r - 1) * math.log(max(total, 1.0)) + math.log(math.factorial(r) * math.factorial(r - 1)))
    top = max(segs, default=0.0)
    clip = lambda x: min(max(x, -20.0), 40.0)
    return [clip(best), clip(exponent(top)), math.log1p(len(e)), math.log1p(n), math.log1p(top)], sum(x >= -math.log(EXPECT) for x in e)


def curve(x, y):
    """Ridge logistic weights by Newton; evidence with a weight of zero or less goes."""
    use = [0, 1, 2, 3, 4]
    while True:
        m = np.array([[1.0, *[r[c] for c in use]] for r in x])
        w = np.zeros(m.shape[1])
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
            w = w + np.linalg.solve(m.T @ (m * (p * (1 - p))[:, None]) + 0.01 * np.eye(len(w)), m.T @ (y - p) - 0.01 * w)
        wrong = [c for c, v in zip(use, w[1:]) if c < 2 and v <= 0]
        if not wrong:
            return use, w
        use = [c for c in use if c not in wrong]
        assert {0, 1} & set(use)


def brute(docs, labels):
    y = {}
    for d, t in labels:
        if d is not None and t is not None and zlib.crc32(str(d).encode()) % 4 != 2:
            y[d] = max(y.get(d, 0), int(t == 1))
    train = [(x or "", y[d]) for d, x in docs if d in y]
    counts = {}
    for x, t in train:
        for f in {f for w in words_of(x) for f in forms(w)}:
            counts.setdefault(f, [0, 0])[t] += 1
    counts = {f: c for f, c in counts.items() if sum(c) >= LEAST}
    other, toxic = sum(t == 0 for _, t in train), sum(t == 1 for _, t in train)
    own = [(scores_of(x, counts, other, toxic, t), t) for x, t in train]
    clean = [s for s, t in own if not t]
    rounded = np.round(np.concatenate([np.array(s) for s in clean]) * 20) / 20
    lo, hi = 0.0, 64.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.exp(mid * rounded).mean() < 1 else (lo, mid)
    lam = hi
    tops = [(max((x for *_, x in naive_segments(s)), default=0.0), len(s)) for s in clean]
    logk = float(np.mean([lam * m - math.log(n) for m, n in tops if m > 0 and n > 0])) - 0.5772156649
    use, w = curve([facts_of(s, lam, logk)[0] for s, _ in own], np.array([t for _, t in own], float))
    out = []
    for d, x in docs:
        f, n = facts_of(scores_of(x or "", counts, other, toxic), lam, logk)
        z = w[0] + sum(a * f[c] for a, c in zip(w[1:], use))
        out.append((d, d is not None and zlib.crc32(str(d).encode()) % 4 == 2, 1 / (1 + math.exp(-z)), n))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_query(spark, seed):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(150)]
    bad = [stem + end for stem in ("zworf", "zquibb", "zdrekk") for end in ("", "s", "ling", "erish")]
    docs, labels = [], []
    for i in range(400):
        ws = [rng.choice(plain) for _ in range(rng.randint(3, 80))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randint(1, 3)):
                k = rng.randrange(len(ws) + 1)
                ws[k:k] = [rng.choice(bad) if rng.random() < 0.7 else rng.choice(plain) for _ in range(rng.randint(2, 7))]
        elif rng.random() < 0.5:
            ws.insert(rng.randrange(len(ws)), rng.choice(bad))
        docs.append((i, " ".join(ws).capitalize()))
        if rng.random() < 0.95:
            labels.append((i, int(toxic)))
    docs += [(900, None), (901, ""), (902, "¿!"), (None, docs[3][1]), docs[5], docs[5], (903, " ".join(bad * 3))]
    labels += [(None, 1), (5, None), labels[0], (labels[1][0], 1), (900, 0), (901, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = toxicity.query(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got = sorted(((r["doc_id"], r["held_out"], r["score"], r["n_passages"], r["predicted"]) for r in got), key=key)
    want = sorted(brute(docs, labels), key=key)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-6)
    assert [g[3] for g in got] == [w[3] for w in want]
    assert all(g[4] == int(w[2] >= 0.3) for g, w in zip(got, want) if abs(w[2] - 0.3) > 1e-6)
    assert sum(g[4] for g in got) > 20 and sum(g[3] for g in got) > 5
