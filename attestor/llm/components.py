"""Distributed connected components with DataFrame operations only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Links that one task joins.
TASK_LINKS = 1_000_000


def stars(edges: DataFrame, many: int, each: int = TASK_LINKS) -> DataFrame:
    """``a, b``: links that join the same nodes as ``edges`` (longs, about ``many`` rows), each node at most once in a
    task as ``a``, with the smallest node that it reaches there. A dense group of g nodes leaves fewer than g links for
    each ``each`` of its edges."""

    def run(batches):
        ends = [np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) for batch in batches]
        nodes, at = np.unique(np.concatenate(ends, axis=1) if ends else np.empty((2, 0), np.int64), return_inverse=True)
        least = list(range(len(nodes)))
        for x, y in at.reshape(2, -1).T.tolist():
            while least[x] != x:
                least[x] = x = least[least[x]]
            while least[y] != y:
                least[y] = y = least[least[y]]
            least[max(x, y)] = min(x, y)
        for x, y in enumerate(least):  # least[x] <= x, and those before are settled
            least[x] = least[y]
        top = np.array(least, np.int64)
        own = np.flatnonzero(top != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own], pa.int64()), pa.array(nodes[top[own]], pa.int64())], ["a", "b"])

    edges = edges.select("a", "b").where("a is not null and b is not null")
    return edges.repartition(max(1, -(-int(many) // each))).mapInArrow(run, "a long, b long")


def joined(parts: DataFrame) -> DataFrame:
    """Links ``a, b`` that join the same nodes as those that gave the components ``parts``."""
    return parts.select(F.col("node").alias("a"), F.col("component").alias("b"))


def connected_components(edges: DataFrame, work: Workspace, name: str = "cc", max_rounds: int = 100) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    ``edges`` has columns ``a`` and ``b`` of one orderable type. Null ends and loops are ignored, repeated edges
    count once, an empty table gives an empty result. Returns ``node, component``; a component's smallest node is
    returned too.

    Alternating large-star and small-star steps: each node's neighbours are rehung on the smallest node seen, so a
    long chain takes a logarithmic number of rounds. A hub with very many neighbours is never gathered: its minimum
    is a partially aggregated state, written first, and its edges meet that one row in a join that AQE may split. Every
    round is written to the shared folder, and only a row count and a checksum reach the driver.
    """
    ends = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    current = work.save(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}_0")
    state = None
    for turn in range(1, max_rounds + 1):
        now = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now["n"] == 0 or (now["n"], now["h"]) == state:
            break
        state = (now["n"], now["h"])
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = work.save(least, f"{name}_least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = work.save(large, f"{name}_large")
        low = work.save(large.groupBy("a").agg(F.min("b").alias("m")), f"{name}_low")
        rest = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = rest.unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        new = work.save(small, f"{name}_{turn}")
        work.drop(f"{name}_{turn - 1}")
        current = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
