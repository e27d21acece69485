"""Trained builds: sampling, k-means with a size-balance term, hierarchical clustering, leaf heads, product quantizers."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.folders import discard, staged
from spindrift.functions.vectors import l2sqr
from spindrift.operators.blocks import nearest, nearest_at_cost
from spindrift.operators.index import codebook_of, codewords, decode, encode, sub_space_distances
from spindrift.operators.ranking import numbered
from spindrift.shipping import ship

def sample_ids(vectors: DataFrame, s: int, seed: int = 42) -> DataFrame:
    """s ids (all if there are fewer), the same on every run: those of smallest hash."""
    return vectors.select("vec_id").orderBy(F.md5(F.concat_ws(":", F.col("vec_id").cast("string"), F.lit(str(seed)))), "vec_id").limit(s)

def lloyd_sums(vectors: DataFrame, heads: DataFrame) -> DataFrame:
    """One Lloyd step: list_id, dim, total, members; a centroid is total / members. Sums are partial per task."""
    near = nearest(vectors.select(F.col("vec_id").alias("id"), "v"), heads.select(F.col("list_id").alias("id"), F.col("hv").alias("v")), 1)
    rows = near.select(F.col("qid").alias("vec_id"), F.col("id").alias("list_id")).join(vectors, "vec_id")
    dims = rows.select("list_id", F.posexplode("v").alias("dim", "x"))
    return dims.groupBy("list_id", "dim").agg(F.sum("x").alias("total"), F.count("*").alias("members"))

def balanced_assignment(vectors: DataFrame, heads: DataFrame, per_member: int) -> DataFrame:
    """Nearest head by distance + per_member * (size of the head's list before): the size-balance penalty of one step.

    The penalty is part of the block products, so a vector leaves one row a block of heads, not one a head."""
    rows = heads.select(F.col("list_id").alias("id"), F.col("hv").alias("v"))
    asked = vectors.select(F.col("vec_id").alias("id"), "v")
    size = nearest(asked, rows, 1).groupBy("id").agg(F.count("*").alias("size"))
    costly = rows.join(size, "id", "left").select("id", "v", (F.coalesce("size", F.lit(0)) * per_member).alias("cost"))
    return nearest_at_cost(asked, costly, 1).select(F.col("qid").alias("vec_id"), F.col("id").alias("list_id"))

def leaf_heads(vectors: DataFrame, members: DataFrame) -> DataFrame:
    """list_id, head_vec_id: the member nearest to its list's mean, the smallest id on ties. Scaled by the list's size, the
    mean is an integer vector, so distances are exact."""
    rows = members.join(vectors, "vec_id")
    dims = rows.select("list_id", F.posexplode("v").alias("dim", "x")).groupBy("list_id", "dim").agg(F.sum("x").alias("t"), F.count("*").alias("n"))
    mean = dims.groupBy("list_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "t"))), lambda x: x["t"]).alias("total"), F.first("n").alias("n"))
    d = rows.join(mean, "list_id").withColumn("d", F.expr("aggregate(zip_with(v, total, (x, t) -> (x * n - t) * (x * n - t)), 0L, (s, x) -> s + x)"))
    return d.groupBy("list_id").agg(F.min(F.struct("d", "vec_id")).alias("b")).select("list_id", F.col("b.vec_id").alias("head_vec_id"))

def kmeans(x: np.ndarray, k: int, iterations: int = 10, balance: float = 0.0, seed: int = 42, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and labels of a bounded number of rows, which may have weights: D-squared seeding, Lloyd steps, first minimum on ties, a
    penalty of balance * mean error * size / (n / k) from the sizes before, and empty clusters refilled by splitting large ones."""
    rng = np.random.default_rng(seed)
    x = np.asarray(x, float)
    n, k = len(x), min(k, len(x))
    w = np.ones(n) if weights is None else np.asarray(weights, float)
    centre = [x[rng.integers(n)]]
    near = ((x - centre[0]) ** 2).sum(axis=1)
    while len(centre) < k:
        p = near * w / (near * w).sum() if near.sum() > 0 else None
        centre.append(x[rng.choice(n, p=p)])
        near = np.minimum(near, ((x - centre[-1]) ** 2).sum(axis=1))
    c, size, label = np.array(centre), np.full(k, n / k), np.zeros(n, int)
    for _ in range(iterations):
        d = (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None] - 2 * x @ c.T
        penalty = balance * max(d.min(axis=1).mean(), 0) * size / (n / k)
        label = (d + penalty).argmin(axis=1)
        size = np.bincount(label, w, minlength=k)
        for j in np.flatnonzero(size == 0):
            big = int(size.argmax())
            c[j], c[big] = c[big] * (1 + 1 / 1024), c[big] * (1 - 1 / 1024)
            size[j], size[big] = size[big] / 2, size[big] / 2
        for j in np.unique(label):
            c[j] = np.average(x[label == j], axis=0, weights=w[label == j])
    return c, label

def hierarchical(x: np.ndarray, ids: np.ndarray, ratio: float = 0.1, branch: int = 32, slack: float = 1.5, iterations: int = 10, balance: float = 0.5, seed: int = 42) -> list[np.ndarray]:
    """Members of each leaf of a balanced tree: split until at most slack / ratio, merge children under half the target
    into the nearest that still takes them; a split with one label becomes chunks."""
    target, most = max(1, round(1 / ratio)), max(1, int(slack / ratio))
    leaves, todo = [], [np.arange(len(x))]
    while todo:
        part = todo.pop()
        if len(part) <= most:
            leaves.append(part)
            continue
        k = min(max(round(len(part) / target), 2), branch)
        c, label = kmeans(x[part], k, iterations, balance, seed)
        kids = {j: part[label == j] for j in np.unique(label)}
        if len(kids) == 1:
            todo += [part[i : i + target] for i in range(0, len(part), target)]
            continue
        for j in sorted(kids, key=lambda j: len(kids[j])):
            if len(kids[j]) < target / 2 and len(kids) > 1:
                for o in sorted((o for o in kids if o != j), key=lambda o: ((c[o] - c[j]) ** 2).sum()):
                    if len(kids[o]) + len(kids[j]) <= most:
                        kids[o] = np.concatenate([kids[o], kids.pop(j)])
                        break
        todo += list(kids.values())
    return [ids[np.sort(p)] for p in leaves]

#: Members of a node from which on it is split by joins instead of in one task.
TASK = 4096


def _drawn(*parts) -> F.Column:
    """32 bits by hash of what is named, the same everywhere."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.lit(str(p)) if isinstance(p, int) else p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def _nearest_centre(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """rows (node, vec_id, v), centres (node, label, c), a few labels a node: adds label, that of the nearest centre, the smallest on ties.

    One equi-join of each row with its node's centres, which are one row; how it is done is left to the size of that side."""
    packed = centres.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("label", "c"))).alias("cs"))
    ship(rows.sparkSession)

    def run(batches):
        for b in batches:
            x = np.array(b.column("v").to_pylist(), float).reshape(b.num_rows, -1)
            label = np.zeros(b.num_rows, "int32")
            node = b.column("node").to_numpy()
            for n in np.unique(node):
                at = np.flatnonzero(node == n)
                cs = b.column("cs")[int(at[0])].as_py()
                c = np.array([z["c"] for z in cs], float)
                d = (c * c).sum(axis=1)[None] - 2 * (x[at] @ c.T)
                label[at] = np.array([z["label"] for z in cs])[d.argmin(axis=1)]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("vec_id"), b.column("v"), pa.array(label)], ["node", "vec_id", "v", "label"])

    return rows.join(packed, "node").select("node", "vec_id", "v", "cs").mapInArrow(run, "node bigint, vec_id bigint, v array<bigint>, label int")


def _means(labelled: DataFrame) -> DataFrame:
    """node, label, c: means rounded to whole numbers (halves up), of sums that are partial per task."""
    dims = labelled.select("node", "label", F.posexplode("v").alias("dim", "x")).groupBy("node", "label", "dim").agg(F.sum("x").alias("t"), F.count("*").alias("n"))
    mean = dims.withColumn("x", F.floor((2 * F.col("t") + F.col("n")) / (2 * F.col("n"))).cast("long"))
    return mean.groupBy("node", "label").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda z: z["x"]).alias("c"))


def split_level(rows: DataFrame, target: int, branch: int = 32, iterations: int = 3) -> DataFrame:
    """rows (node, vec_id, v): one level of splitting all nodes at once; label is the child.

    A node of n members gets n / target children, from 2 to `branch`; the first centres are the members of smallest hash, then come
    Lloyd steps. Work on a node is spread over its rows; only its centres, at most `branch`, meet in one row."""
    size = rows.groupBy("node").agg(F.count("*").alias("n"))
    k = F.least(F.greatest(F.floor(F.col("n") / target + 0.5), F.lit(2)), F.lit(branch))
    w = Window.partitionBy("node").orderBy("h", "vec_id")
    first = rows.withColumn("h", F.md5(F.col("vec_id").cast("string"))).withColumn("r", F.row_number().over(w)).where(F.col("r") <= branch)
    centres = first.join(size, "node").where(F.col("r") <= k).select("node", (F.col("r") - 1).cast("int").alias("label"), F.col("v").alias("c"))
    for _ in range(iterations):
        centres = staged(_means(_nearest_centre(rows, centres)), "centres")
    return _nearest_centre(rows, centres)


def cluster(vectors: DataFrame, ratio: float = 0.1, slack: float = 1.5, branch: int = 32, iterations: int = 3, task: int = TASK, **options) -> DataFrame:
    """vec_id, node, leaf: balanced clustering of the whole table; a leaf has at most slack / ratio members, every vector one leaf.

    Level by level, nodes of more than `task` members are split by joins (split_level); a node whose members all get one label is
    dealt into chunks by order of id. What has at most `task` members is split further in one task (hierarchical), which
    also merges small children."""
    target = max(1, round(1 / ratio))
    ship(vectors.sparkSession)
    todo = vectors.select(F.lit(1).cast("long").alias("node"), "vec_id", "v")
    small, chunks, level = [], [], 0
    while True:
        size = todo.groupBy("node").agg(F.count("*").alias("n"))
        sized = todo.join(size, "node")
        small.append(sized.where(F.col("n") <= task).drop("n"))
        big = sized.where(F.col("n") > task).drop("n")
        if big.limit(1).count() == 0:
            break
        got = staged(split_level(big, target, branch, iterations), "level")
        labels = got.groupBy("node").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
        got = got.join(labels, "node")
        same = got.where("lo = hi")
        if same.limit(1).count():
            nth = numbered(same.select("node", "vec_id"), [F.col("node"), F.col("vec_id")], "nth")
            chunks.append(nth.select("vec_id", "node", F.expr(f"-1 - cast((nth - 1) div {target} as bigint)").alias("leaf")))
        # names of children: their parents' times the branches, so that they never meet those of other levels
        todo = staged(got.where("lo < hi").select((F.col("node") * (branch + 1) + F.col("label") + 1).alias("node"), "vec_id", "v"), "nodes")
        level += 1
        if level > 10:
            raise ValueError("ten levels did not reach nodes of one task")

    def split(pdf):
        import pandas as pd

        pdf = pdf.sort_values("vec_id")  # the rows' order is not to matter
        leaves = hierarchical(np.array(pdf["v"].tolist(), float), pdf["vec_id"].to_numpy(), ratio=ratio, slack=slack, branch=branch, **options)
        return pd.concat([pd.DataFrame({"vec_id": l, "node": pdf["node"].iloc[0], "leaf": i}) for i, l in enumerate(leaves)])

    rows = functools.reduce(DataFrame.unionByName, small)
    out = rows.groupBy("node").applyInPandas(split, "vec_id long, node long, leaf long")
    return functools.reduce(DataFrame.unionByName, chunks, out)


def heads(vectors: DataFrame, **options) -> DataFrame:
    """list_id, head_vec_id, hv: of each leaf of cluster(), numbered in order, the member nearest to its mean."""
    members = staged(cluster(vectors, **options), "members")
    leaves = numbered(members.select("node", "leaf").distinct(), [F.col("node"), F.col("leaf")], "nth").select("node", "leaf", (F.col("nth") - 1).alias("list_id"))
    found = leaf_heads(vectors, members.join(leaves, ["node", "leaf"]).select("vec_id", "list_id"))
    return found.join(vectors.select(F.col("vec_id").alias("head_vec_id"), F.col("v").alias("hv")), "head_vec_id").select("list_id", "head_vec_id", "hv")


def seeding_round(vectors: DataFrame, centres: DataFrame, draws: int, turn: int) -> DataFrame:
    """vec_id, v, dist: the vectors drawn in one round of oversampled seeding, each with probability draws * dist / sum of dist (about `draws` of
    them), dist being the squared distance to the nearest of centres (id, v). The draw is a hash of the id and the turn."""
    near = nearest(vectors.select(F.col("vec_id").alias("id"), "v"), centres, 1).select(F.col("qid").alias("vec_id"), "dist")
    cost = staged(near, "cost")
    total = cost.agg(F.sum(F.col("dist").cast("decimal(28,0)"))).first()[0] or 0
    wide = lambda c: c.cast("decimal(19,0)")
    chosen = cost.where(wide(_drawn(F.col("vec_id"), turn)) * F.lit(int(total)).cast("decimal(28,0)").cast("decimal(19,0)") < wide(F.col("dist")) * F.lit(draws << 32).cast("decimal(19,0)"))
    return chosen.join(vectors, "vec_id").select("vec_id", "v", "dist")


def seed(vectors: DataFrame, k: int, rounds: int = 4, oversample: int = 2, turn: int = 42) -> DataFrame:
    """id, v: k first centres for k-means on the whole table. A few rounds each draw about oversample * k vectors far from those drawn before;
    the candidates, weighted by how many vectors are nearest to each, are then clustered on the driver (rounds * oversample * k rows)."""
    first = vectors.orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id").limit(1).select(F.col("vec_id").alias("id"), "v")
    centres = staged(first, "seeds")
    for r in range(rounds):
        new = seeding_round(vectors, centres, oversample * k, turn + r).select(F.col("vec_id").alias("id"), "v")
        more = staged(centres.unionByName(new).dropDuplicates(["id"]), "seeds")
        discard(centres)
        centres = more
    weight = nearest(vectors.select(F.col("vec_id").alias("id"), "v"), centres, 1).groupBy("id").agg(F.count("*").alias("w"))
    rows = centres.join(weight, "id").orderBy("id").collect()
    x, w = np.array([r["v"] for r in rows], float), np.array([r["w"] for r in rows], float)
    c, _ = kmeans(x, k, weights=w)
    return vectors.sparkSession.createDataFrame([(i, [int(z) for z in np.rint(row)]) for i, row in enumerate(c)], "id long, v array<long>")


def repaired(centres: DataFrame, sizes: DataFrame) -> DataFrame:
    """centres (id, v), sizes (id, n), a few thousand: the i-th centre without members becomes the i-th largest one's times 1025 / 1024, and that one's
    shrinks to 1023 / 1024 of itself (rounded down), so that the next step divides its members. Centres are matched by order on both sides."""
    c = centres.join(sizes, "id", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    none = c.where("n = 0").withColumn("r", F.row_number().over(Window.orderBy("id"))).select(F.col("id").alias("empty"), "r")
    big = c.where("n > 1").withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "id"))).select(F.col("id").alias("split"), "v", "r")
    pair = none.join(big, "r")
    scaled = lambda m: F.transform("v", lambda x: F.floor(x * m / 1024).cast("long")).alias("v")
    moved = pair.select(F.col("empty").alias("id"), scaled(1025)).unionByName(pair.select(F.col("split").alias("id"), scaled(1023)))
    return centres.join(moved.select("id"), "id", "left_anti").unionByName(moved)


def codebook_sums(vectors: DataFrame, codebook: DataFrame, m: int) -> DataFrame:
    """sub, code, dim, total, members: one Lloyd step of all sub-spaces at once. A batch leaves one row a (sub, code, dim) it holds."""
    words = codewords(codebook, m)
    ship(vectors.sparkSession)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype("int64").reshape(b.num_rows, -1)
            width, out = words.shape[2], []
            for sub, d in enumerate(sub_space_distances(x.astype(float), words)):
                code = d.argmin(axis=1)
                n = np.bincount(code, minlength=words.shape[1])
                held = np.flatnonzero(n)
                total = np.zeros((words.shape[1], width), "int64")
                np.add.at(total, code, x[:, sub * width : (sub + 1) * width])
                out.append((np.full(len(held) * width, sub), np.repeat(held, width), np.tile(np.arange(width), len(held)), total[held].ravel(), np.repeat(n[held], width)))
            cols = [np.concatenate(c) for c in zip(*out)]
            kinds = ("int32", "int32", "int32", "int64", "int64")
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(cols, kinds)], ["sub", "code", "dim", "total", "members"])

    each = vectors.select("v").mapInArrow(run, "sub int, code int, dim int, total bigint, members bigint")
    return each.groupBy("sub", "code", "dim").agg(F.sum("total").alias("total"), F.sum("members").alias("members"))


def codebook_step(vectors: DataFrame, codebook: DataFrame, m: int) -> DataFrame:
    """sub, code, c: the codebook after one step: means rounded to whole numbers (halves up); codewords that no vector has stay."""
    s = codebook_sums(vectors, codebook, m).withColumn("x", F.floor((2 * F.col("total") + F.col("members")) / (2 * F.col("members"))).cast("long"))
    new = s.groupBy("sub", "code").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda z: z["x"]).alias("new"))
    return codebook.join(new, ["sub", "code"], "left").select("sub", "code", F.coalesce("new", "c").alias("c"))


def train_codebook(vectors: DataFrame, m: int, codes: int = 256, iterations: int = 20, first: DataFrame | None = None) -> DataFrame:
    """sub, code, c: product quantizer of the whole table. Starts from `first` (or the vectors of smallest hash); every step is an
    aggregate over (sub, code, dim), of at most m * codes * dims rows, and is staged."""
    if first is None:
        chosen = vectors.join(sample_ids(vectors, codes), "vec_id")
        first = codebook_of(chosen, m, codes)
    book = staged(first, "codebook")
    for _ in range(iterations):
        better = staged(codebook_step(vectors, book, m), "codebook")
        discard(book)
        book = better
    return book


def quantizer_error(vectors: DataFrame, codebook: DataFrame, m: int) -> DataFrame:
    """vec_id, error: squared distance of each vector to what its codes stand for."""
    back = decode(encode(vectors, codebook, m), codebook).withColumnRenamed("v", "w")
    return vectors.join(back, "vec_id").select("vec_id", l2sqr(F.col("v"), F.col("w")).alias("error"))


def chunked(df: DataFrame, target: int, key: str = "vec_id") -> DataFrame:
    """The split of last resort: fixed-size chunks in order of key, numbered over ranges of it."""
    return numbered(df, [F.col(key)], "__nth").withColumn("chunk", F.expr(f"cast((__nth - 1) div {target} as int)")).drop("__nth")
