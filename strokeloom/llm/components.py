"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strokeloom import runtime

#: Links that one task contracts: some 50 MB of arrays.
LINKS_PER_TASK = 1 << 20


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links and for each the smallest node of its component: roots hang on smaller roots, then paths are cut short, until no link joins two."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while True:
        p, q = up[x], up[y]
        if (p == q).all():
            return nodes, nodes[up]
        np.minimum.at(up, np.maximum(p, q), np.minimum(p, q))
        while True:
            shorter = up[up]
            if (shorter == up).all():
                break
            up = shorter


def contracted(links: DataFrame) -> DataFrame:
    """Links (u, v) of a forest of stars for every partition of links (u, v), v the smaller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            nodes, least = roots(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            own = nodes != least
            yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(least[own])], names=["u", "v"])

    return links.mapInArrow(run, "u long, v long")


def components(links: DataFrame, max_rounds: int = 60, per_task: int = LINKS_PER_TASK) -> DataFrame:
    """node, component (the smallest node reachable) for every node of links (a, b).

    Every ``per_task`` links are contracted to stars by one task; where that took several tasks, the
    stars are joined by alternating: a large star hangs a node's larger neighbours, a small star its
    smaller ones and itself, on its smallest neighbour; when neither changes anything every edge leads
    to the smallest node of its component. Edges are never more than links and nodes together.
    Smallest neighbours come from an aggregation, so a node with very many links is combined before
    the shuffle, and are joined back by a join that can split such a node's edges.
    """
    edges = runtime.table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    tasks = -(-edges.count() // per_task)
    edges = runtime.table(contracted(edges.coalesce(1) if tasks < 2 else edges.repartition(tasks)))
    before = None
    for _ in range(max_rounds if tasks > 1 else 0):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = runtime.table(large)
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.col("v").alias("x"), "u", "m")
        small = small.select(F.col("x").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = runtime.table(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        if tasks > 1:
            raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
