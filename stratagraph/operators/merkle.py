"""Merkle trees over path ranges: two states of a table are compared from the root, and only ranges that differ are read.

A node stands for a path prefix of some components. Its digest is made of sums of row digests, which don't depend on order
or partitions and add up: a parent's sums are those of its children, a merged table's those of its parts. Sums are exact
decimals of 48-bit parts of SHA-256, 240 bits in all."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .stats import canonical

PARTS = [f"p{i}" for i in range(5)]


def _sums(df: DataFrame, *keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(p).cast("decimal(38,0)").alias(p) for p in PARTS])


def digest() -> Column:
    """The digest of a node by its number of rows and its sums."""
    return F.sha2(F.concat_ws("-", F.col("n").cast("string"), *[F.col(p).cast("string") for p in PARTS]), 256)


def leaves(rows: DataFrame, path: str, columns: list[str], depth: int) -> DataFrame:
    """(prefix, n, sums): one row for each prefix of `depth` components; shorter paths end earlier."""
    row = F.sha2(canonical(*columns), 256)
    parts = [F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)").alias(p) for i, p in enumerate(PARTS)]
    return _sums(rows.select(F.substring_index(path, "/", depth).alias("prefix"), F.lit(1).cast("long").alias("n"), *parts), "prefix")


@dataclass(frozen=True)
class Tree:
    """nodes: level, parent, prefix, n, sums; level 0 is the root, with the empty prefix. rows: prefix beside the row."""

    nodes: DataFrame
    rows: DataFrame
    depth: int

    @property
    def root(self) -> str:
        """The digest of the whole table; that of no rows where it is empty."""
        row = self.nodes.where("level = 0").select(digest().alias("d")).first()
        return row["d"] if row else ""


def build(rows: DataFrame, path: str, columns: list[str], depth: int = 3) -> Tree:
    """A tree of `depth` levels below the root over rows with a slash-separated path. Rows are read once; each level is the
    sum of the level below."""
    level = cut(leaves(rows, path, columns, depth))
    levels = [level.withColumn("level", F.lit(depth))]
    for d in range(depth - 1, -1, -1):
        above = F.substring_index("prefix", "/", d) if d else F.lit("")
        level = _sums(level.withColumn("prefix", above), "prefix")
        levels.append(level.withColumn("level", F.lit(d)))
    parent = F.when(F.col("level") > 1, F.array_join(F.slice(F.split("prefix", "/"), F.lit(1), F.col("level") - 1), "/")).otherwise("")
    nodes = reduce(DataFrame.unionByName, levels).select("level", parent.alias("parent"), "prefix", "n", *PARTS)
    return Tree(cut(nodes), rows.select(F.substring_index(path, "/", depth).alias("prefix"), *columns), depth)


def merged(trees: list[DataFrame]) -> DataFrame:
    """Nodes of the union of tables without common rows, from the nodes of their trees."""
    return _sums(reduce(DataFrame.unionByName, trees), "level", "parent", "prefix")


def changed_ranges(before: Tree, after: Tree) -> DataFrame:
    """(level, prefix, n_before, n_after) of the nodes that differ, level by level below those that do; 0 rows where a range
    isn't there."""
    side = lambda t, name, level: t.nodes.where(F.col("level") == level).select("parent", "prefix", F.col("n").alias(f"n_{name}"), digest().alias(f"d_{name}"))
    out, differing = None, None
    for level in range(before.depth + 1):
        a, b = side(before, "before", level), side(after, "after", level)
        if differing is not None:
            a, b = (x.join(differing, "parent", "left_semi") for x in (a, b))
        both = a.join(b, ["parent", "prefix"], "full").where(~F.col("d_before").eqNullSafe(F.col("d_after")))
        found = cut(both.select(F.lit(level).alias("level"), "prefix", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after")))
        out = found if out is None else out.unionByName(found)
        if not found.take(1):
            break
        differing = found.select(F.col("prefix").alias("parent"))
    return out


def changed_rows(before: Tree, after: Tree, key: str, ranges: DataFrame | None = None) -> DataFrame:
    """(key, change): added, removed or changed rows; only rows of the deepest ranges that differ are compared. A key names
    one row of a state."""
    ranges = changed_ranges(before, after) if ranges is None else ranges
    deep = ranges.where(F.col("level") == before.depth).select("prefix")
    side = lambda t, name: t.rows.join(deep, "prefix", "left_semi").select(F.col(key), canonical(*[c for c in t.rows.columns if c != "prefix"]).alias(name))
    both = side(before, "was").join(side(after, "is"), key, "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "changed")
    return both.select(key, change.alias("change")).where("change is not null")
