"""Connected components of a distributed graph.

Edges are dealt to as many tasks as hold EDGES of them each, and each task shrinks its own to stars
(union by smallest id); where one task holds all, that is the answer.  Else rounds of large-star and
small-star follow until nothing changes, O(log n) of them in practice; every round is a written table.  The steps are aggregates and equi-joins on node ids, so a hub's edges
pre-aggregate before the shuffle and a skewed join is split by AQE.  No edge reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def star_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node number that each of n nodes reaches over the edges a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            hop = new[new]
            if (hop == new).all():
                break
            new = hop
        if (new == root).all():
            return root
        root = new


#: Edges that a task shrinks at once.
EDGES_A_TASK = 1_000_000


def _contract(most: int):
    """Task function: edges as stars (root, id), a root with itself too; works off about `most` edges at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def stars() -> np.ndarray:
            e = np.concatenate(held)
            ids, at = np.unique(e, return_inverse=True)
            at = at.reshape(e.shape)
            return np.column_stack([ids[star_labels(len(ids), at[:, 0], at[:, 1])], ids])

        size = 0
        for b in batches:
            if b.num_rows:
                held.append(np.column_stack([b.column(0).to_numpy(), b.column(1).to_numpy()]))
                size += b.num_rows
            if size > 2 * most:
                held = [stars()]
                size = len(held[0])
                if size > most:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][:, 0]), pa.array(held[0][:, 1])], schema=EDGES)
                    held, size = [], 0
        if held:
            e = stars()
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], schema=EDGES)

    return run


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id on an edge (columns u, v of longs): root is the smallest id reachable.

    Self-loops and repeated edges are allowed; rows with a null end are ignored.
    An empty edge table gives an empty result.
    """
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter("u is not null and v is not null")
    e = written(e, "edges")
    while True:
        tasks = 1 + e.count() // EDGES_A_TASK
        before, e = e, written(e.coalesce(tasks).mapInArrow(_contract(EDGES_A_TASK), "u long, v long"), "stars")
        discard(before)
        if tasks == 1:
            return e.select(F.col("v").alias("id"), F.col("u").alias("root"))
        # Settled: every id has one root and each root is its own.
        if e.dropDuplicates().groupBy("v").count().filter("count > 1").isEmpty():
            return e.dropDuplicates().select(F.col("v").alias("id"), F.col("u").alias("root"))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).dropDuplicates()
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").filter("v >= u").select(F.col("m").alias("u"), "v").dropDuplicates()
        large = written(large, "large")
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v")
        small = small.select(F.col("m").alias("u"), F.col("u").alias("v")).unionByName(small.select(F.col("m").alias("u"), "v"))
        before, e = e, written(small.dropDuplicates(), "small")
        discard(before, large)
