"""N-gram Jaccard join: rare-first prefix filtering, verified once per pair.

A document's set holds its distinct word shingles. Documents with equal sets form one class, and only the smallest
doc_id of a class goes on. A total order of shingles, rare first, comes from a counter table of fixed size (any order
gives exact results, since counts only decide which shingles come first). The first shingles of each set are joined;
length, positional and suffix filters drop pairs before the exact check.

Large groups of near copies: every posting list first links its members to one pivot. Lists that then lie within one
component need no further pair; in the others only pairs across components are made, so a group's pairs grow with its
size and not with its square, and still every link between components is found.

Edge cases: null and empty texts have an empty set and link with nothing; texts of fewer than `width` words have one
shingle, the whole sequence; rows that repeat id and text are one document; different texts of one doc_id are documents of
their own, each with its own class; rows without doc_id get no component; ties can't occur, as a component is named by its
smallest id; very long texts are shingled whole, in one row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small
from .common import as_bytes, attach_totals, columns, cut, gentle, keep, map_frames, mix, repeated_ids, shingles, text_hash, tokenize
from .components import components

#: Counters of the frequency table, and slices it travels in. Fixed, so that the table may be broadcast (4 MB).
COUNTERS, SLICES = 1 << 22, 64
#: Up to so many ids (8 bytes each) are broadcast to pick documents; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Rounds that link to pivots before the comparison across components, and the most pivots that a document tries in the
#: first, the second and each later one. More rounds follow, up to MOST_ROUNDS, while lists could give more than CROWD
#: pairs for each entry. What the rounds leave is compared in full, so these decide the work and not the result.
PIVOT_ROUNDS, MOST_ROUNDS, PIVOTS, CROWD = 2, 5, (2, 8, 32), 40


def _sets(texts, width: int):
    """Distinct shingle hashes, ascending, of each text."""
    h, counts = tokenize([as_bytes(t) for t in texts])
    at = 0
    for n in counts:
        words = h[at : at + n]
        at += n
        if n >= width:
            yield np.unique(shingles(words, width))
        elif n:
            yield mix(np.asarray([np.bitwise_xor.reduce(mix(words + np.arange(1, n + 1, dtype=np.uint64))) + np.uint64(n)], dtype=np.uint64))
        else:
            yield np.zeros(0, dtype=np.uint64)


def _signature(s: np.ndarray) -> tuple[int, int]:
    if not len(s):
        return 0, 0
    return int(np.add.reduce(mix(s)).view(np.int64)), int(np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64))


def _ranges(s: np.ndarray) -> bytes:
    """How many hashes fall into each of 2**k equal ranges, one or two in each: the counts' width in bytes, then the counts."""
    k = max(len(s), 1).bit_length() - 1
    where = (s >> np.uint64(64 - k)).astype(np.int64) if k else np.zeros(len(s), np.int64)
    counts = np.bincount(where, minlength=1 << k)
    width = 1 if not len(counts) or counts.max() < 256 else 4
    return bytes([width]) + counts.astype(f"u{width}").tobytes()


def _counts(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"u{data[0]}", offset=1)


def _profile(width: int):
    def run(batches):
        seen = np.zeros(COUNTERS, dtype=np.uint32)
        for pdf in batches:
            rows = []
            for doc, s in zip(pdf.doc_id, _sets(pdf.text, width)):
                np.add.at(seen, (s & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
                rows.append((doc, len(s), *_signature(s), -1, _ranges(s)))
            yield columns(rows, "doc_id n s1 s2 slice data")
        if seen.any():
            pack = zstandard.ZstdCompressor(level=1)
            yield columns([(None, 0, 0, 0, k, pack.compress(part.tobytes())) for k, part in enumerate(np.split(seen, SLICES))], "doc_id n s1 s2 slice data")

    return run


def _add_slices(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(COUNTERS // SLICES, dtype=np.int64)
    for data in pdf["data"]:
        total += np.frombuffer(zstandard.decompress(data), dtype=np.uint32)
    rank = np.minimum(8 * np.log2(total + 1), 255).astype(np.uint8)  # fine steps: most counters hold many shingles
    return pd.DataFrame({"slice": [int(pdf["slice"].iloc[0])], "data": [rank.tobytes()]})


def _prefixes(width: int, table):
    def run(batches):
        ranks = table.value
        for pdf in batches:
            keep = {k: [] for k in ("gram", "doc_id", "pos", "sig")}
            for doc, s in zip(pdf.doc_id, _sets(pdf.text, width)):
                n = len(s)
                if not n:
                    continue
                size = n - (8 * n + 9) // 10 + 1
                rank = ranks[(s & np.uint64(COUNTERS - 1)).astype(np.int64)]
                first = s[np.lexsort((s, rank))[:size]]
                keep["doc_id"].append(np.full(size, doc, dtype=np.int64))
                keep["sig"].append((mix(first ^ np.int64(_signature(s)[0]).view(np.uint64)) >> np.uint64(32)).astype(np.uint32).view(np.int32))
                keep["pos"].append(np.arange(size, dtype=np.int32))
                keep["gram"].append(first.view(np.int64))
            if keep["sig"]:
                yield pd.DataFrame({k: np.concatenate(v) for k, v in keep.items()})

    return run


def _arrays(width: int):
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "arr": [s.tobytes() for s in _sets(pdf.text, width)]})

    return run


def _suffix_filter(batches):
    """Drops pairs whose counts by hash range leave too small an overlap: the sum of the smaller counts bounds it."""
    for pdf in batches:
        ok = np.zeros(len(pdf), dtype=bool)
        for i, (x, y) in enumerate(zip(pdf.data_a, pdf.data_b)):
            x, y = _counts(x), _counts(y)
            parts = min(len(x), len(y))
            x, y = (z.reshape(parts, -1).sum(axis=1, dtype=np.int64) for z in (x, y))
            ok[i] = 180 * int(np.minimum(x, y).sum()) >= 80 * int(x.sum() + y.sum())
        yield pdf.loc[ok, ["a", "b"]]


def _check(batches):
    """The exact overlap."""
    for pdf in batches:
        ok = np.zeros(len(pdf), dtype=bool)
        for i, (x, y) in enumerate(zip(pdf.arr_a, pdf.arr_b)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok[i] = 100 * both >= 80 * (len(x) + len(y) - both)
        yield pdf.loc[ok, ["a", "b"]]


def _both(pairs: DataFrame, side: DataFrame, value: str) -> DataFrame:
    """pairs with `value` of both documents."""
    out = pairs
    for end in "ba":
        out = out.join(side.select(F.col("doc_id").alias(end), F.col(value).alias(f"{value}_{end}")), end)
    return out.select("a", "b", f"{value}_a", f"{value}_b")


def near_classes(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: documents link at a Jaccard similarity of 0.8 or more.

    Where ids repeat with another text, each such text goes by a number of its own, below all ids."""
    docs, texts = gentle(docs).select("doc_id", "text"), repeated_ids(docs)
    if texts is None:
        return _classes(docs, width)
    low = F.lit(min(docs.agg(F.min("doc_id")).first()[0], 0))
    texts = cut(texts.select(F.col("doc_id").alias("_doc"), "h", (low - 1 - F.monotonically_increasing_id()).alias("key")))
    own = (F.col("doc_id") == F.col("_doc")) & (text_hash() == F.col("h"))
    keyed = docs.join(broadcast_if_small(texts), own, "left").select(F.coalesce("key", "doc_id").alias("doc_id"), "text")
    found = keep(_classes(keyed, width).withColumnRenamed("doc_id", "key"))
    named = found.join(broadcast_if_small(texts.select("_doc", "key")), "key", "left").withColumn("doc_id", F.coalesce("_doc", "key"))
    least = named.groupBy("component_id").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    return attach_totals(named, cut(least), "component_id", "n").select("doc_id", "n_shingles", F.col("least").alias("component_id"))


def _classes(docs: DataFrame, width: int) -> DataFrame:
    """As `near_classes`, where a doc_id names one text."""
    spark = docs.sparkSession
    profile = cut(map_frames(docs, _profile(width), "doc_id long, n int, s1 long, s2 long, slice int, data binary"))
    parts = profile.where("slice >= 0").select("slice", "data").groupBy("slice").applyInPandas(_add_slices, "slice int, data binary").collect()
    ranks = np.zeros(COUNTERS, dtype=np.uint8)
    for row in parts:
        step = COUNTERS // SLICES
        ranks[row["slice"] * step : (row["slice"] + 1) * step] = np.frombuffer(row["data"], dtype=np.uint8)
    table = spark.sparkContext.broadcast(ranks)

    rows = profile.where("slice < 0")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    reps = cut(rows.join(classes, ["n", "s1", "s2"], "left").select("doc_id", "n", "rep", "data"))
    heads = reps.where("rep = doc_id").select("doc_id", "n", "data").dropDuplicates(["doc_id"])

    entries = docs.where("doc_id is not null").mapInPandas(_prefixes(width, table), "gram long, doc_id long, pos int, sig int")
    shared = entries.groupBy("gram").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo <> hi").select("gram")
    entries = entries.drop("sig").join(shared, "gram").join(heads.select("doc_id", "n"), "doc_id")
    entries = cut(entries.select("gram", "doc_id", "n", "pos"))
    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = cut(_both(pairs, heads, "data").mapInPandas(_suffix_filter, "a long, b long"))
        ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        arrays = docs.join(ids, "doc_id", "left_semi").mapInPandas(_arrays(width), "doc_id long, arr binary")
        return cut(_both(pairs, arrays, "arr").mapInPandas(_check, "a long, b long"))

    def near(n1, p1, n2, p2):
        """Length filter and positional filter; both only drop pairs that can't link."""
        need = F.ceil((F.col(n1) + F.col(n2)) * F.lit(8) / F.lit(18))
        return (F.least(n1, n2) * 10 >= F.greatest(n1, n2) * 8) & (F.least(F.col(n1) - F.col(p1), F.col(n2) - F.col(p2)) >= need)

    def mixed(entries: DataFrame, label: DataFrame) -> DataFrame:
        """The entries of lists that still hold two components or more, with their components."""
        named = entries.select("gram", "doc_id", "n", "pos").join(label.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        named = named.withColumn("component", F.coalesce("component", "doc_id"))
        several = named.groupBy("gram").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2")
        return cut(named.join(several, "gram").select("gram", "doc_id", "n", "pos", "component", "c1"))

    def pair(a: str, b: str) -> list:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    label = heads.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("component")).limit(0)
    tried = label.select(F.col("id").alias("a"), F.col("id").alias("b"))
    entries = entries.withColumn("component", F.col("doc_id"))
    for k in range(MOST_ROUNDS):
        if k >= PIVOT_ROUNDS:
            # Lists where many components meet many entries need more rounds before all their pairs are worth a look.
            crowd = entries.groupBy("gram").agg((F.count_if(F.col("component") != F.col("c1")) * F.count("*")).alias("p")).agg(F.sum("p"), F.count("*")).first()
            if (crowd[0] or 0) <= CROWD * max(entries.count(), 1):
                break
        # A list's pivot is its smallest set at first, then some of its members; a document tries those it shares most lists with.
        whole = ("n", "doc_id", "pos", "component")
        first = F.array(F.min(F.struct(*whole))) if not k else F.array(*[F.min_by(F.struct(*whole), F.xxhash64(F.lit(4 * k + i), "gram", "doc_id")) for i in range(4)])
        pivots = entries.groupBy("gram").agg(first.alias("p")).select("gram", F.explode(F.array_distinct("p")).alias("pivot"))
        stars = entries.join(pivots, "gram").where("component <> pivot.component").where(near("n", "pos", "pivot.n", "pivot.pos"))
        stars = stars.groupBy(F.col("pivot.doc_id").alias("p"), F.col("doc_id").alias("d")).agg(F.count("*").alias("lists"))
        stars = stars.withColumns({"a": F.least("p", "d"), "b": F.greatest("p", "d")}).join(tried, ["a", "b"], "left_anti")
        place = F.row_number().over(Window.partitionBy("d").orderBy(F.desc("lists"), "p"))
        stars = cut(stars.withColumn("place", place).where(F.col("place") <= PIVOTS[min(k, 2)]).select("a", "b").distinct())
        tried = tried.union(stars)
        label = cut(components(label.select(F.col("id").alias("a"), F.col("component").alias("b")).union(confirmed(stars))))
        entries = mixed(entries, label)

    # What is left is compared across components. An entry's index prefix is shorter than its probe prefix.
    # A pair is made at the first list that it shares, as far as a document's first six lists tell.
    ahead = entries.where("pos < 12").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "gram"))).alias("_l"))
    ahead = ahead.select("doc_id", F.transform(F.slice("_l", 1, 6), lambda x: x["gram"]).alias("ahead"))
    entries = entries.join(ahead, "doc_id", "left")
    index = "p{0} < n{0} - ceil(n{0} * 8 / 9) + 1"
    some = entries.where("component <> c1").select("gram", F.col("doc_id").alias("d1"), F.col("n").alias("n1"), F.col("pos").alias("p1"), F.col("component").alias("k1"), F.col("ahead").alias("a1"))
    rest = entries.select("gram", F.col("doc_id").alias("d2"), F.col("n").alias("n2"), F.col("pos").alias("p2"), F.col("component").alias("k2"), F.col("ahead").alias("a2"), (F.col("component") == F.col("c1")).alias("leading"))
    short = F.expr(f"case when n1 < n2 or (n1 = n2 and d1 < d2) then {index.format(1)} else {index.format(2)} end")
    pairs = some.join(rest, "gram").where("k1 <> k2 and (leading or d1 < d2)").where(near("n1", "p1", "n2", "p2")).where(short)
    pairs = pairs.where(F.coalesce(F.get(F.array_intersect("a1", "a2"), F.lit(0)) == F.col("gram"), F.lit(True)))
    pairs = cut(pairs.select(*pair("d1", "d2")).distinct().join(tried, ["a", "b"], "left_anti"))
    more = confirmed(pairs)
    final = components(label.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))

    out = reps.join(final.select(F.col("id").alias("rep"), "component"), "rep", "left")
    own = F.when(F.col("rep").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "rep"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))
