"""Centroid clustering by delta Lloyd, exact in whole numbers.

Vectors become integers once and are written bucketed by a key of their content. Each round's assignments are a small table
in the same buckets, so the two meet without a shuffle. A vector whose owner has not moved keeps its distance and is
compared only with centroids that have; one whose owner has moved is compared with all. Vectors that change hands are
summed, signed, in the task that sees them; Spark adds up those transfers, and the driver adds at most k rows of them to the
global sums. When no centroid moves, the remaining rounds would change nothing and are left out.

The transfers of a task travel in its own bucket of the assignment table, in rows without an owner, so a round is one pass
and one write, and a task that runs again replaces both.

Edge cases: vectors that are null, of another length, or hold a null, NaN or infinite component are left out. Rows that
repeat id and vector stay, as often as they occur. Ties between centroids go to the smaller number; ties of the hash that
picks the first centroids (a repeated id) to the smaller vector. A null id hashes as the empty text and stays a row. Vectors
fewer than k make fewer centroids; an empty table gives no rows. A component of 2**27 or more after scaling leaves no room
for a 64-bit distance: such a row stays, with null results, and moves no centroid; an inertia beyond 64 bits is null.
Vectors have a fixed length, so no row is long; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import checkpoint_dir, gentle, remove, remove_at_exit

#: Integers from here on are beyond exact 64-bit distances.
BEYOND = 1 << 27
#: Rows that a bucket holds, about.
BUCKET_ROWS = 1_000_000
_FAR = np.iinfo(np.int64).max
_KEYS = ("k1", "k2")
_STATE = "k1 long, k2 long, owner int, distance long, to int, n long, sums array<long>"


def finite(vector: str, length: int | None = None) -> Column:
    """Whether a vector is there, has `length` components if given, and no null, NaN or infinite one."""
    fits = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return fits if length is None else fits & (F.size(vector) == length)


def scaled(vector: str, scale: int, beyond: int) -> Column:
    """floor(scale * x) of each component, x as double, as array<int>; null where one reaches `beyond`."""
    high = F.col(vector).cast("array<double>")
    inside = F.forall(high, lambda x: F.abs(x) < F.lit(beyond / scale))
    return F.when(inside, F.transform(high, lambda x: F.floor(x * F.lit(float(scale))).cast("int")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column without nulls as rows of int64."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


class _Buckets:
    """Tables in one bucketing, in the shared checkpoint folder."""

    def __init__(self, df: DataFrame, buckets: int):
        self.spark, self.n = df.sparkSession, buckets

    def write(self, df: DataFrame) -> tuple[str, str]:
        name = f"lloyd_{uuid.uuid4().hex}"
        path = remove_at_exit(self.spark, f"{checkpoint_dir(self.spark)}/tables/{name}")
        df.write.bucketBy(self.n, *_KEYS).option("path", path).saveAsTable(name)
        return name, path

    def drop(self, table: tuple[str, str]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table[0]}")
        remove(self.spark, table[1])


def _compare(x, owner, distance, centroids, moved):
    """Owner and distance after some centroids moved; a negative owner is none."""
    loose = np.flatnonzero((owner < 0) | moved[np.maximum(owner, 0)])
    best, who = distance.copy(), owner.copy()
    best[loose], who[loose] = _FAR, len(centroids)
    for c, at in enumerate(centroids):
        rows = np.arange(len(x)) if moved[c] else loose
        if len(rows):
            d = x[rows] - at
            d = np.einsum("ij,ij->i", d, d)
            closer = (d < best[rows]) | ((d == best[rows]) & (c < who[rows]))
            best[rows[closer]], who[rows[closer]] = d[closer], c
    return who, best


def _round(centroids: np.ndarray, moved: np.ndarray):
    k, width = centroids.shape
    schema = to_arrow_schema(StructType.fromDDL(_STATE))

    def run(batches):
        sums, counts, last = np.zeros((k, width), np.int64), np.zeros(k, np.int64), None
        for b in batches:
            if not b.num_rows:
                continue
            x, times = matrix(b.column("x"), width), b.column("n").to_numpy(zero_copy_only=False)
            owner, distance = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("owner", "distance"))
            who, best = _compare(x, owner, distance, centroids, moved)
            change = np.flatnonzero(who != owner)
            x, times, gone, come = x[change] * times[change, None], times[change], owner[change], who[change]
            np.add.at(sums, come, x)
            np.add.at(counts, come, times)
            np.subtract.at(sums, gone[gone >= 0], x[gone >= 0])
            np.subtract.at(counts, gone[gone >= 0], times[gone >= 0])
            last = b.column("k1")[-1].as_py(), b.column("k2")[-1].as_py()
            none = [None] * b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip((b.column("k1"), b.column("k2"), who, best, none, none, none), schema)], schema=schema)
        rows = [c for c in range(k) if counts[c] or sums[c].any()] if last else []
        if rows:
            m = len(rows)
            values = ([last[0]] * m, [last[1]] * m, [None] * m, [None] * m, rows, counts[rows].tolist(), sums[rows].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(values, schema)], schema=schema)

    return run


def delta_lloyd(vectors: DataFrame, *, length: int = 64, scale: int = 1024, k: int = 8, seed: str = "3:", rounds: int = 10, buckets: int | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector.

    The first centroids are the k vectors whose `seed` + vec_id has the smallest SHA-256. Each round assigns all vectors and
    replaces each centroid that owns any by the floor of their mean; after the last round they are assigned once more."""
    spark = vectors.sparkSession
    kept = gentle(vectors).select("vec_id", "embedding").where(finite("embedding", length)).select("vec_id", scaled("embedding", scale, BEYOND).alias("x"))
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.where("x is not null").orderBy(digest, "x").limit(k).select("x").collect()
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return kept.select("vec_id", *[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(out).fields[1:]])
    centroids = np.asarray([r["x"] for r in first], dtype=np.int64)
    k = len(centroids)

    # Rows that repeat id and vector are one entry with a count, so a key of the content is enough and comes out the same when a task runs again.
    keyed = kept.groupBy("vec_id", "x").agg(F.count("*").alias("n")).withColumns({"k1": F.xxhash64("vec_id", "x"), "k2": F.xxhash64(F.lit(1), "x", "vec_id")})
    if buckets is None:
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-vectors.count() // BUCKET_ROWS))
    tables = _Buckets(vectors, buckets)
    base = tables.write(keyed.repartition(buckets, *_KEYS))
    entries = spark.table(base[0])
    usable = entries.where("x is not null")

    sums, counts = [[0] * length for _ in range(k)], [0] * k
    moved, state = np.ones(k, dtype=bool), None
    for turn in range(rounds + 1):
        if state is None:
            seen = usable.select(*_KEYS, "x", "n", F.lit(-1).alias("owner"), F.lit(0).cast("long").alias("distance"))
        else:
            owners = spark.table(state[0]).where("owner is not null").select(*_KEYS, "owner", "distance")
            seen = usable.join(owners.hint("shuffle_hash"), [*_KEYS]).select(*_KEYS, "x", "n", "owner", "distance")
        now = tables.write(seen.mapInArrow(_round(centroids, moved), _STATE))
        if state is not None:
            tables.drop(state)
        state = now
        exact = lambda c: F.sum(c.cast("decimal(38,0)"))
        moves = spark.table(state[0]).where("to is not null").groupBy("to")
        for row in moves.agg(exact(F.col("n")).alias("n"), F.array(*[exact(F.get("sums", F.lit(i))) for i in range(length)]).alias("sums")).collect():
            counts[row["to"]] += int(row["n"])
            sums[row["to"]] = [a + int(b) for a, b in zip(sums[row["to"]], row["sums"])]
        if turn == rounds:
            break
        new = np.asarray([[s // counts[c] for s in sums[c]] if counts[c] else centroids[c].tolist() for c in range(k)], dtype=np.int64)
        moved, centroids = (new != centroids).any(axis=1), new
        if not moved.any():
            break

    owners = spark.table(state[0]).where("owner is not null").select(*_KEYS, "owner", "distance")
    each = entries.select("vec_id", *_KEYS, "n").join(owners.hint("shuffle_hash"), [*_KEYS], "left")
    sizes = {r["owner"]: int(r["s"]) for r in each.where("owner is not null").groupBy("owner").agg(F.sum(F.col("distance").cast("decimal(38,0)") * F.col("n")).alias("s")).collect()}
    whole = sum(sizes.values())
    fits = lambda v: v if v < 1 << 63 else None
    text = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(c, fits(s), fits(whole), text[c]) for c, s in sizes.items()], "owner int, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = each.join(F.broadcast(facts), "owner", "left").withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "n")))  # facts: k rows
    return rows.select("vec_id", F.col("owner").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")
