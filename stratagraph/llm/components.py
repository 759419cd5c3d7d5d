"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: Up to so many links (16 bytes each) are joined up within one task, without rounds; more go the distributed way.
ONE_TASK = 100_000


def _joined_up(batches):
    """Union-find over the links of one task; roots are the smallest ids."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for pdf in batches:
        for u, v in zip(pdf.u.tolist(), pdf.v.tolist()):
            a, b = find(u) if u in parent else parent.setdefault(u, u), find(v) if v in parent else parent.setdefault(v, v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    yield pd.DataFrame({"id": list(parent), "component": [find(x) for x in parent]}, dtype="int64")


def _state(df: DataFrame) -> tuple:
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame, a: str = "a", b: str = "b", one_task: int = ONE_TASK) -> DataFrame:
    """(id, component): every id that a link names, with the smallest id that links reach from it.

    Few links are joined up by one task, behind a count. Beyond it no neighbour list is ever gathered: each round is two minimum aggregations, combined before the shuffle, each
    joined back to the links. Empty input gives an empty result; null ends and self links are ignored."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges, state = cut(edges), None
    if edges.count() <= one_task:
        return edges.coalesce(1).mapInPandas(_joined_up, "id long, component long")
    while True:  # each round shortens every path; it ends when nothing moves
        now = _state(edges)
        if now == state or not now[0]:
            break
        state = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = cut(small.select("u", F.col("m").alias("v")).union(small.select(F.col("v"), F.col("m"))).where("u <> v").distinct())
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
