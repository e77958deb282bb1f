"""Connected components of a large link table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventfold.llm.base import written

_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, their smallest reachable node and the same by index, for links ``a[i]``-``b[i]``."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        lo, hi = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        open_ = lo != hi
        if not open_.any():
            return nodes, nodes[root], root
        np.minimum.at(root, hi[open_], lo[open_])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the links of a batch by a star per component: fewer rows, same components."""
    for batch in batches:
        if batch.num_rows:
            nodes, root, _ = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            far = nodes != root
            yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(root[far])], schema=_EDGE)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Smallest reachable node of every node that has a link: rows (node, root).

    ``edges`` has bigint columns ``a`` and ``b``, in any direction, repeated or not; loops
    are ignored. A node without links has no row. Each round is written to the shared
    folder, so rounds are never recomputed. Minima combine before the shuffle and go back
    by a join, which the adaptive planner splits where one node has very many links.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    links = written(links.distinct().mapInArrow(_contract, "u bigint, v bigint"), name)
    seen = None
    while True:
        both = links.union(links.select("v", "u")).toDF("x", "y")
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select("e.u", F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        links = written(small, name)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
