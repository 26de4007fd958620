"""Connected components of a distributed list of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialize

#: So many links (16 bytes each) are contracted by one task; more are made fewer first, by rounds of joins.
ONE_TASK = 1 << 20


def joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """labels (each a root's place) after linking a[k] with b[k]."""
    while True:
        one, two = labels[a], labels[b]
        apart = one != two
        if not apart.any():
            return labels
        a, b, one, two = a[apart], b[apart], one[apart], two[apart]
        np.minimum.at(labels, np.maximum(one, two), np.minimum(one, two))
        while (labels[labels] != labels).any():
            labels = labels[labels]


def _contracted(links: DataFrame) -> DataFrame:
    """node, to for each node but one of each component; at most ONE_TASK links."""

    def run(batches):
        held = [np.stack([batch[c].to_numpy() for c in "ab"]) for batch in batches]
        if held:
            ends = np.concatenate(held, axis=1)
            nodes, at = np.unique(ends, return_inverse=True)
            at = at.reshape(ends.shape)
            labels = joined(np.arange(len(nodes)), at[0], at[1])
            moved = np.flatnonzero(labels != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[labels[moved]])], ["node", "to"])

    return links.coalesce(1).mapInArrow(run, "node long, to long")


def components(links: DataFrame) -> DataFrame:
    """Of links a, b (long): node, label for each node whose label isn't itself; nodes of one component share a label.

    Each round every node takes the name of the neighbour (or itself) that comes first in a pseudorandom order that
    changes with the round, and links are rewritten to names. The number of names shrinks by a constant factor a
    round, whatever the shape; links within one name go. All sides of the joins are written tables, whose hot keys
    adaptive execution can split. Once ONE_TASK links or fewer are left, one task does the rest.
    """
    left = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    while there := left.count():
        if there <= ONE_TASK:
            steps.append(materialize(_contracted(left)))
            break
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c, k=len(steps): F.xxhash64(F.lit(k), F.col(c))
        first = both.groupBy(F.col("a").alias("node")).agg(F.min_by("b", order("b")).alias("best"), F.min(order("b")).alias("rank"))
        step = materialize(first.where(F.col("rank") < order("node")).select("node", F.col("best").alias("to")))
        steps.append(step)
        for end in ("a", "b"):
            left = left.join(step.select(F.col("node").alias(end), F.col("to").alias(f"{end}_to")), end, "left").withColumn(end, F.coalesce(f"{end}_to", end)).drop(f"{end}_to")
        left = materialize(left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
    named = steps[0].select("node", F.col("to").alias("label"))
    for step in steps[1:]:
        later = step.select(F.col("node").alias("label"), F.col("to").alias("next"))
        # Nodes that first take a new name in a later round join the list there.
        moved = named.join(later, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
        fresh = step.join(named.select("node"), "node", "left_anti").select("node", F.col("to").alias("label"))
        named = materialize(moved.unionByName(fresh))
    return named
