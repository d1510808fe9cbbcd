"""Typed links between pages, followed to a depth of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.scratch import materialize

# How far links of each type are followed, in the order of their priority; None is to the end.
DEPTHS = {"dependencies": 3, "related": 1, "feature": 1, "inherits": 5, "composed": 4, "specializes": 3, "aggregates": 2, "complements": 2, "precedes": 3, "similar": 1, "alternative": 1, "up": None}


def follow(edges: DataFrame, starts: DataFrame, depths: dict[str, int | None] | None = None) -> DataFrame:
    """start, node, type, depth: what each start reaches over links of one type within that type's depth, by the shortest way; a type
    without a depth is followed until nothing new is met, so cycles end. edges(src, type, dst), starts(node). Each round joins the new
    frontier only, which is written and read back, so plans stay small."""
    depths = depths or DEPTHS
    most = max([d for d in depths.values() if d is not None], default=0)
    limit = F.create_map(*[F.lit(x) for k, d in depths.items() for x in (k, 2**31 - 1 if d is None else d)])
    known = edges.where(F.col("type").isin(*depths))
    front = starts.select(F.col("node").alias("start"), F.col("node").alias("at")).join(known, F.col("at") == F.col("src")).select("start", "type", F.col("dst").alias("node"), F.lit(1).alias("depth")).distinct()
    seen = front = materialize(front, "links")
    depth = 2
    while depth <= most or None in depths.values():
        step = front.join(known.select(F.col("src").alias("node"), "type", "dst"), ["node", "type"]).where(limit[F.col("type")] >= depth)
        front = step.select("start", "type", F.col("dst").alias("node"), F.lit(depth).alias("depth")).distinct().join(seen.select("start", "type", "node"), ["start", "type", "node"], "left_anti")
        front = materialize(front, "links")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        depth += 1
    return seen.where("start <> node")
