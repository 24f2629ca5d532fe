"""Connected components of a graph that is given as an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonority.llm.common import forget, written

#: Edges that a task holds at once in :func:`contracted`.
CONTRACTED = 1 << 20


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every node of ``edges(a, b)`` with the smallest node that it can reach.

    Alternates the large-star and small-star steps, so that long chains shrink by about half each round
    and no step gathers the neighbours of a node: each is a group-by minimum and a join back.
    Nulls and loops are ignored. Nodes without edges are not in the result. Each round's table replaces the last one's.

    :return: ``node, root`` with one row per node that has an edge to another node.
    """
    pairs = edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = written(pairs.distinct(), "cc-edges")
    rows, seen = now.count(), None
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node is hung on the node's smallest neighbour
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: smaller neighbours and the node itself are hung on the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "cc-edges", rows)
        told = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.count_distinct("u")).first())
        forget(now)
        now = new
        if told[0] == told[2] and told == seen:
            break
        seen, rows = told, told[0]
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that these edges lead to a smaller node, and the smallest one that each of them reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        # the larger of two roots is hung on the smallest root that it meets, then paths are shortened to their ends
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def contracted(edges: DataFrame) -> DataFrame:
    """Stars ``a, b`` that connect what ``edges(a, b)``, two longs, connect: each task puts together the edges that it holds.

    A task goes on with the stars of up to ``CONTRACTED`` edges, and hands them over when they alone are half as many. Edges with nulls and loops
    are left out.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def put_together() -> tuple[np.ndarray, np.ndarray]:
            return stars(*(np.concatenate(x) for x in zip(*held)))

        def told(of: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in of], ["a", "b"])

        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy() for c in ("a", "b")))
            size += batch.num_rows
            if size >= CONTRACTED:
                held = [put_together()]
                size = len(held[0][0])
                if 2 * size > CONTRACTED:
                    yield told(held[0])
                    held, size = [], 0
        if held:
            yield told(put_together())

    return edges.select("a", "b").where("a <> b").mapInArrow(each, "a long, b long")


def contracted_components(edges: DataFrame) -> DataFrame:
    """As :func:`components`, for edges between two longs: tasks put together what they hold before nodes are shuffled.

    Edges that fit in one task need no shuffle at all.
    """
    held = written(edges.select("a", "b").where("a <> b").distinct(), "cc-links")
    tasks = -(-held.count() // CONTRACTED)
    found = written(contracted(held.coalesce(max(1, tasks))), "cc-stars")
    if tasks > 1:
        return components(found)
    return found.select(F.col("a").alias("node"), F.col("b").alias("root")).union(found.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
