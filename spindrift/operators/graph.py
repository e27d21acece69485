"""Navigation over many heads: a proximity graph built and searched by joins, so that no vector meets all heads.

Build: about sqrt(n) of the nodes, those of smallest hash, are entries; each node begins with the nearest ones of the cells of its two nearest entries, and
then, a few rounds, with the nearest of its neighbours' neighbours: the vectors of a node's neighbours meet in one row of bounded size, where
each finds the others. What a round costs grows with nodes * degree. In the end edges go both ways, the nearest `reach` of a node are kept.

Search: a query begins at its nearest entries. A round follows the edges of the open nodes of its beam (the `beam` nearest so far),
measures the nodes it has not seen and opens those that come into the beam; it ends when no query has an open node. So frontier rows
are (query, node), joined with edges by node and with vectors by node and query. Nothing is collected but a count a round,
and these joins are merges: what is broadcast passes through the driver, and again in each round.
Distances are exact; which nodes are reached is not proven, so recall is to be measured (navigate's answer is the exact one).

Defined cases: fewer nodes than a beam are all found if the graph connects them; no node gives no row; equal distances are ordered by id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.folders import discard, staged
from spindrift.functions.vectors import l2sqr
from spindrift.operators.blocks import nearest, nearest_in_cells
from spindrift.shipping import ship

#: Nodes whose neighbourhoods a task works on at a time.
BUCKET = 256


def entries_of(nodes: DataFrame) -> DataFrame:
    """About sqrt(n) of the nodes (id, v): those whose hash is below a threshold, at least the first by hash."""
    n = nodes.count()
    share = 1 / max(1.0, math.sqrt(n))
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    some = nodes.where(h < int(share * (1 << 40)))
    first = nodes.orderBy(h, "id").limit(1)
    return some.unionByName(first).dropDuplicates(["id"])


def _best(pairs: DataFrame, degree: int) -> DataFrame:
    """id, to, dist: the nearest `degree` of each id, repeated pairs once."""
    w = Window.partitionBy("id").orderBy("dist", "to")
    return pairs.groupBy("id", "to").agg(F.min("dist").alias("dist")).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= degree).drop("__r")


def _neighbours_meet(edges: DataFrame, nodes: DataFrame, degree: int) -> DataFrame:
    """id, to, dist: of the nodes around each node (its edges, and as many edges to it), each one's nearest among the others."""
    back = edges.select(F.col("to").alias("id"), F.col("id").alias("to"), "dist")
    around = edges.unionByName(_best(back, degree)).select("id", "to").distinct()
    ship(nodes.sparkSession)
    rows = around.join(nodes.select(F.col("id").alias("to"), "v").hint("merge"), "to")
    buckets = max(1, -(-nodes.count() // BUCKET))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(buckets)))

    def meet(t: pa.Table) -> pa.Table:
        of, to = t["id"].to_numpy(), t["to"].to_numpy()
        v = t["v"].combine_chunks()
        x = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(of), -1)
        order = np.argsort(of, kind="stable")
        cuts = np.flatnonzero(np.diff(of[order])) + 1
        out: list[list[np.ndarray]] = [[], [], []]
        for g in np.split(order, cuts):
            y = x[g]
            size = (y * y).sum(axis=1)
            d = size[:, None] + size[None] - 2 * (y @ y.T)
            np.fill_diagonal(d, np.inf)
            k = min(degree, len(g) - 1)
            if k < 1:
                continue
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            out[0].append(np.repeat(to[g], k))
            out[1].append(to[g][near].ravel())
            out[2].append(np.rint(np.take_along_axis(d, near, axis=1)).astype("int64").ravel())
        cols = [np.concatenate(c) if c else np.array([], "int64") for c in out]
        # in one bucket a pair may come from several neighbourhoods
        keep = np.unique(np.stack(cols[:2]), axis=1, return_index=True)[1] if len(cols[0]) else slice(0)
        return pa.table([pa.array(c[keep], "int64") for c in cols], names=["id", "to", "dist"])

    return rows.groupBy("b").applyInArrow(meet, "id bigint, to bigint, dist bigint")


def build(nodes: DataFrame, degree: int | None = None, reach: int | None = None, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """nodes: (id long, v array<long>). The edges (id, to, dist), a staged table, and the entries (id, v), staged too.

    degree: by default 2.5 times the binary logarithm of the number of nodes, as what a search needs to find its way grows with it; reach:
    twice the degree."""
    degree = degree or max(4, math.ceil(2.5 * math.log2(max(2, nodes.count()))))
    reach = reach or 2 * degree
    entries = staged(entries_of(nodes), "entries")
    cells = entries.select(F.col("id").cast("int"), "v")
    two = nearest(nodes, cells, 2).select(F.col("id").cast("int").alias("cell"), F.col("qid").alias("id"), F.col("rank").alias("nth"))
    placed = staged(two.join(nodes.hint("merge"), "id"), "cells")
    asked, there = placed.select("cell", "id", "v"), placed.select("cell", "id", "v")
    found = nearest_in_cells(asked, there, degree + 1).select(F.col("qid").alias("id"), F.col("id").alias("to"), "dist").where("id <> to")
    edges = staged(_best(found, degree), "edges")
    for _ in range(rounds):
        better = staged(_best(edges.unionByName(_neighbours_meet(edges, nodes, degree)), degree), "edges")
        discard(edges)
        edges = better
    both = edges.unionByName(edges.select(F.col("to").alias("id"), F.col("id").alias("to"), "dist"))
    graph = staged(_best(both, reach), "graph")
    discard(edges, placed)
    return graph, entries


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, entries: DataFrame, k: int, beam: int = 16, starts: int = 4) -> tuple[DataFrame, DataFrame]:
    """queries: (id, v). qid, rank, id, dist of the k nearest nodes reached (beam at least k), and qid, seen: how many were measured, the
    entries included. What is known of the nodes seen is a staged table, written anew each round; the last one stays."""
    beam = max(beam, k)
    seen = staged(nearest(queries, entries, starts).select("qid", "id", "dist", F.lit(True).alias("open")), "seen")
    w = Window.partitionBy("qid").orderBy("dist", "id")
    asked = queries.select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    while True:
        ranked = seen.withColumn("__r", F.row_number().over(w))
        frontier = ranked.where((F.col("__r") <= beam) & F.col("open")).select("qid", "id")
        if frontier.limit(1).count() == 0:
            break
        reached = frontier.join(graph.select("id", "to").hint("merge"), "id").select("qid", F.col("to").alias("id")).distinct()
        new = reached.join(seen.select("qid", "id").hint("merge"), ["qid", "id"], "left_anti")
        new = new.join(nodes.hint("merge"), "id").join(asked.hint("merge"), "qid").select("qid", "id", l2sqr(F.col("v"), F.col("qv")).alias("dist"), F.lit(True).alias("open"))
        old = ranked.select("qid", "id", "dist", (F.col("open") & (F.col("__r") > beam)).alias("open"))
        after = staged(old.unionByName(new), "seen")
        discard(seen)
        seen = after
    best = seen.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", F.col("rank").cast("int").alias("rank"), "id", "dist")
    others = entries.count()
    counts = seen.join(entries.select("id", F.lit(1).alias("e")).hint("merge"), "id", "left").groupBy("qid").agg((F.count_if(F.col("e").isNull()) + others).alias("seen"))
    return best, counts
