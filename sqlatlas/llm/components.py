"""Connected components of an undirected edge list: contracted in tasks of bounded size, then by narrow joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Edges that one task contracts: a bound of its memory.
EDGES_A_TASK = 1_000_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a task's edges: each node with the smallest one that they connect it with."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node of the component. edges: (a, b), 64-bit numbers.

    Tasks contract their edges to stars; if one task had them all, that is the result. Otherwise every round takes the smallest
    label of the neighbours, then the label's own label, so labels jump along paths; a round is written to the
    shared folder, and the loop ends when nothing changes.
    """
    spark = edges.sparkSession
    tasks = max(1, -(-edges.count() // EDGES_A_TASK))
    stars = written(spark, edges.select("a", "b").repartition(tasks).mapInArrow(_contract, "a long, b long"), "stars")
    if tasks == 1:
        return stars.select(F.col("a").alias("node"), F.col("b").alias("label"))
    both = written(spark, stars.filter("a <> b").select("a", "b").union(stars.filter("a <> b").select("b", "a")).distinct(), "edges")
    labels = written(spark, both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("m")), "b").groupBy("a").agg(F.min("m").alias("m"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "m").alias("now"))
        jump = labels.select(F.col("node").alias("now"), F.col("label").alias("far"))
        step = written(spark, step.join(jump, "now").select("node", F.least("now", "far").alias("label"), (F.least("now", "far") != F.col("label")).alias("moved")), "labels")
        labels = step.select("node", "label")
        if step.filter("moved").isEmpty():
            return labels
