"""Connected components: of links that fit one task by hooking roots there, of more by minimum labels with pointer jumping in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import cut

#: Most links that one task takes whole (some 300 MB there).
WHOLE = 1 << 22


def rooted(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links in ascending order, and the smallest node that each can reach. A round hooks each root that has a link to a smaller one, so at
    most half of the roots that are joined to others are left."""
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    left, right = at[: len(x)], at[len(x) :]
    label = np.arange(len(nodes))
    while len(left):
        left, right = label[left], label[right]
        low, high = np.minimum(left, right), np.maximum(left, right)
        apart = low != high
        left, right = low[apart], high[apart]
        np.minimum.at(label, right, left)
        while True:
            far = label[label]
            if (far == label).all():
                break
            label = far
    return nodes, nodes[label]


def components(links: DataFrame, a: str = "a", b: str = "b", whole: int = WHOLE) -> DataFrame:
    """(node, component) for the nodes of ``links``: the smallest node that can be reached. Nulls link nothing; nodes are whole numbers.

    Up to ``whole`` links are joined in one task: steps over them would cost the driver more than the links are worth. Of more, every step takes the
    smallest label around each node and then that label's own label, so the number of steps
    grows with the logarithm of a component's width. Labels are cut to the shared folder each step.
    """
    ends = cut(links.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).where("x is not null and y is not null and x != y"))
    if ends.count() <= whole:

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
            for batch in batches:
                for k, part in enumerate(parts):
                    part.append(batch.column(k).to_numpy())
            nodes, roots = rooted(*map(np.concatenate, parts))
            for low in range(0, len(nodes), 1 << 16):
                yield pa.record_batch({"node": pa.array(nodes[low : low + (1 << 16)]), "component": pa.array(roots[low : low + (1 << 16)])})

        return cut(ends.coalesce(1).mapInArrow(join, "node long, component long"))
    edges = cut(ends.union(ends.select("y", "x")).distinct())
    labels = cut(edges.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("component")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("y"), "component"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("component", "near").alias("via"), F.col("component").alias("was"))
        # the label's label as it was, which is at most the label
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("far"))
        stepped = cut(lower.join(jump, "via").select("node", F.least("via", "far").alias("component"), "was"))
        labels = stepped.select("node", "component")
        if stepped.where("component != was").isEmpty():
            return labels
