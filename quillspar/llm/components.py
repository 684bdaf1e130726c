"""Connected components of a link table, without the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle

#: Links that one task may join by itself; more are joined by stars over all tasks.
TASK_LINKS = 500_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not got:
        return
    a, b = (np.concatenate(x) for x in zip(*got, strict=True))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while not (jump := new[new]) is new and (jump != new).any():
            new = jump
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["key", "component"])


def components(links: DataFrame, *, task_links: int = TASK_LINKS) -> DataFrame:
    """(key, component) of each node of ``links`` (a, b): the smallest node it is joined with.

    Links may repeat, run either way or from a node to itself. Few links are
    joined in one task, which the count before it bounds; more by alternating
    large and small stars, a written table after each round, until nothing moves.
    """
    links = links.select("a", "b")
    if links.count() <= task_links:
        return settle(links.coalesce(1).mapInArrow(_joined, "key long, component long"), "components")
    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = settle(small, "components")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    tops = edges.select(F.col("v").alias("key"), F.col("v").alias("component")).distinct()
    return settle(edges.select(F.col("u").alias("key"), F.col("v").alias("component")).unionByName(tops), "components")
