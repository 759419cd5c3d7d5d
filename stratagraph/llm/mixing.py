"""Mixing sources to target weights by min-cost flow, with overlapping sources.

Spark adds up the documents of each membership pattern (the set of sources a document belongs to). The driver's graph has
one node for each pattern and source; it grows with their number, not with the corpus. An arc from pattern to source
costs more with each repetition (1 for the first pass, 2 for the second, ...), so flow repeats documents no more than
quotas need. The flow gives each pattern its total of words; whole passes go to all its documents and the rest to the
first documents in a seeded order. That order is cut by a histogram of hash ranges, and only the range where the cut
falls is sorted, so no source is sorted as a whole.

Edge cases: null and empty texts have size 0 and are never taken; a null source is a source of its own, after all others;
with nothing to mix all targets are 0; repeated rows count each, and which of identical ones the cut takes is left to
Spark's row order; a very long text is counted in place and only its size moves; of equally good fillers the largest hash
is taken; rows without doc_id take part; an empty table gives no rows; other columns are ignored or kept as they are. More
than MOST_PATTERNS sets of sources raise an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 1 << 12
#: The flow's graph is held by the driver, so there is a bound on its patterns: so many, of up to six of 300 sources each,
#: take 20 s and 0.5 GB. Beyond it the operator refuses.
MOST_PATTERNS = 500_000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict, total: float, weights: dict, limit: float) -> dict:
    """Quota of each source: shares by weight; what exceeds limit * size is shared again among the others."""
    out, open_, left = dict.fromkeys(sizes, 0.0), {s for s in sizes if sizes[s]}, float(total)
    while open_:
        whole = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / whole > limit * sizes[s]}
        if not over:
            for s in open_:
                out[s] = left * weights[s] / whole
            break
        for s in over:
            out[s] = float(limit * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def min_cost_flow(sizes: list[int], members: list[list[int]], quota: list[int], repeats: int) -> list[int]:
    """Words that flow through each pattern to its sources (members), which take no more than their quota.

    The k-th pass over a pattern costs k a word, whichever source it serves. A way that frees words of other patterns gets
    back what it pays for them, so the cheapest way left always costs what its first pattern's pass costs. Hence the passes
    are opened one after another, and each time a maximum flow is added by shortest ways, many of one length at once."""
    flow, used, left = [dict.fromkeys(m, 0) for m in members], [0] * len(sizes), list(quota)
    back: list[dict] = [{} for _ in quota]  # patterns that serve a source
    for k in range(1, repeats + 1):
        while last := _layers(sizes, members, k, used, left, back):
            of_pattern, of_source, depth = last
            serving = {s: list(back[s]) for s, d in of_source.items() if d < depth}
            at_source, at_pattern = dict.fromkeys(of_pattern, 0), dict.fromkeys(serving, 0)
            for start in [p for p, d in of_pattern.items() if d == 0]:
                trail = [start]  # pattern, source, pattern, source, ...
                while trail:
                    here = trail[-1]
                    if len(trail) % 2:
                        if at_source[here] == len(members[here]):
                            trail.pop()
                            if trail:
                                at_pattern[trail[-1]] += 1
                        elif of_source.get(s := members[here][at_source[here]]) == of_pattern[here] + 1:
                            trail.append(s)
                        else:
                            at_source[here] += 1
                    elif of_source[here] < depth:
                        if at_pattern[here] == len(serving[here]):
                            trail.pop()
                            at_source[trail[-1]] += 1
                        elif of_pattern.get(p := serving[here][at_pattern[here]]) == of_source[here] and flow[p][here]:
                            trail.append(p)
                        else:
                            at_pattern[here] += 1
                    elif not left[here]:
                        trail.pop()
                        at_source[trail[-1]] += 1
                    else:
                        freed = list(zip(trail[2::2], trail[1::2]))
                        push = min(sizes[start] * k - used[start], left[here], *(flow[p][s] for p, s in freed))
                        used[start] += push
                        left[here] -= push
                        for p, s in freed:
                            flow[p][s] -= push
                            if not flow[p][s]:
                                del back[s][p]
                        for p, s in zip(trail[::2], trail[1::2]):
                            flow[p][s] += push
                            back[s][p] = None
                        trail = [start] if used[start] < sizes[start] * k else []
    return used


def _layers(sizes, members, k, used, left, back) -> tuple[dict, dict, int] | None:
    """Distances of patterns and sources from those patterns that have words left, up to the nearest sources that want some;
    None where none is in reach."""
    of_pattern = {p: 0 for p, n in enumerate(sizes) if used[p] < n * k}
    of_source: dict[int, int] = {}
    layer, depth = list(of_pattern), 0
    while layer:
        depth += 1
        new = []
        for p in layer:
            for s in members[p]:
                if s not in of_source:
                    of_source[s] = depth
                    new.append(s)
        if any(left[s] for s in new):
            return of_pattern, of_source, depth
        layer = []
        for s in new:
            for p in back[s]:
                if p not in of_pattern:
                    of_pattern[p] = depth
                    layer.append(p)
    return None


def allot(patterns: dict[tuple, int], quota: dict, repeats: int) -> dict[tuple, int]:
    """Words that each membership pattern gives."""
    place = {s: i for i, s in enumerate(quota)}
    given = min_cost_flow(list(patterns.values()), [[place[s] for s in p] for p in patterns], [round(w) for w in quota.values()], repeats)
    return dict(zip(patterns, given))


def mix_sources(docs: DataFrame, sources: Column | None = None, weights=(1, 2, 3), repeats: int = 3, seed: int = 17, with_row: bool = False) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row; taken: words that the mix takes, repeats counted.

    with_row adds a struct `row` of all columns of docs. sources: array of the sources a row belongs to, `array(source)` by default; source_size and target are those of a
    row's first source. weights repeat over the sources in code point order, null last."""
    member = F.array_sort(F.array_distinct(sources if sources is not None else F.array("source")))
    key = F.xxhash64(F.lit(seed), "doc_id", "text")
    keep = ["doc_id", "row"] if with_row else ["doc_id"]
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if with_row else []
    rows = docs.select("doc_id", *row, member.alias("_pattern"), words_in(F.col("text")).alias("size"), key.alias("_key"))
    rows = rows.withColumn("_bin", F.pmod(F.col("_key"), F.lit(BINS)).cast("int"))
    sums = rows.groupBy("_pattern").agg(F.sum("size").alias("n")).limit(MOST_PATTERNS + 1).collect()
    if len(sums) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} different sets of sources: give coarser sources")
    patterns = {tuple(r["_pattern"]): r["n"] for r in sums}
    names = sorted({s for p in patterns for s in p}, key=lambda s: (s is None, s.encode("utf-8") if s is not None else b""))
    sizes = {s: sum(n for p, n in patterns.items() if s in p) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    quota = targets(sizes, sum(patterns.values()), weight, repeats)
    given = allot(patterns, quota, repeats)

    spark = docs.sparkSession
    plan = [(list(p), sizes[p[0]] if p else 0, float(quota[p[0]]) if p else 0.0, given[p] // n if n else 0, given[p] % n if n else 0) for p, n in patterns.items()]
    table = spark.createDataFrame(plan, "_p array<string>, source_size long, target double, _passes long, _rest long")
    rows = rows.join(F.broadcast(table), F.col("_pattern").eqNullSafe(F.col("_p"))).drop("_p")

    # Where the cut falls: at most BINS rows for each pattern.
    upto = Window.partitionBy("_pattern").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = rows.where("_rest > 0").groupBy("_pattern", "_bin", "_rest").agg(F.sum("size").alias("_n")).withColumn("_end", F.sum("_n").over(upto))
    cut_at = bins.where("_end >= _rest and _end - _n < _rest").select(F.col("_pattern").alias("_q"), F.col("_bin").alias("_edge"), (F.col("_rest") - F.col("_end") + F.col("_n")).alias("_room"))
    rows = rows.join(F.broadcast(cut_at), F.col("_pattern").eqNullSafe(F.col("_q")), "left").drop("_q")
    whole = rows.where("_edge is null or _bin <> _edge").withColumn("_extra", F.coalesce((F.col("_bin") < F.col("_edge")).cast("int"), F.lit(0)))
    before = Window.partitionBy("_pattern").orderBy("_key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = rows.where("_bin = _edge").withColumn("_sum", F.sum("size").over(before)).withColumn("_extra", (F.col("_sum") <= F.col("_room")).cast("int"))
    # The document that crosses the cut gives way to the one that fills what is left best.
    full = edge.groupBy(F.col("_pattern").alias("_p")).agg(F.max(F.when(F.col("_extra") == 1, F.col("_sum"))).alias("_full"))
    left = cut_at.join(F.broadcast(full), F.col("_q").eqNullSafe(F.col("_p")), "left")
    left = left.select(F.col("_q").alias("_l"), (F.col("_room") - F.coalesce("_full", F.lit(0))).alias("_gap"))
    rows = whole.unionByName(edge.drop("_sum")).join(F.broadcast(left), F.col("_pattern").eqNullSafe(F.col("_l")), "left").drop("_l")
    # Rows that repeat each other can't be told apart, so none of them fills it.
    fillers = rows.where("_extra = 0 and size > 0 and size <= _gap").groupBy("_pattern", "size", "_key").count().where("count = 1")
    filler = fillers.groupBy(F.col("_pattern").alias("_f")).agg(F.max(F.struct("size", "_key")).alias("_best"))
    rows = rows.join(F.broadcast(filler), F.col("_pattern").eqNullSafe(F.col("_f")), "left")
    best = (F.col("_key") == F.col("_best._key")) & (F.col("size") == F.col("_best.size"))
    rows = rows.withColumn("_extra", F.when((F.col("_extra") == 0) & best, 1).otherwise(F.col("_extra")))
    taken = (F.col("size") * (F.col("_passes") + F.col("_extra"))).alias("taken")
    return rows.select(*keep, "size", "source_size", "target", taken)
