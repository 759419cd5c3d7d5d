"""Helpers shared by the training-data operators: inputs, checkpoints, byte tokenising and hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..runtime import broadcast_if_small, importable

#: White space of the contracts: space and 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
_CHUNK = 1 << 21


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; one of our own only where none is set and all tasks run on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage, in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_written: list[tuple] = []


@atexit.register
def _remove_written() -> None:
    """Removes the tables of `keep` when the driver ends; a driver that is killed leaves them to the folder's own retention."""
    for gateway, path in _written:
        try:
            at = gateway.jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(gateway.jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)
        except Exception:  # the JVM has gone first
            return


def remove_at_exit(spark: SparkSession, path: str) -> str:
    _written.append((spark.sparkContext._gateway, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the checkpoint folder that nothing will read again."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def keep(df: DataFrame) -> DataFrame:
    """As `cut`, as a compressed table in the checkpoint folder; for many rows."""
    path = remove_at_exit(df.sparkSession, f"{checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Up to so many rows of 100 bytes or less are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: A key with more than one in so many rows is hot; so there are fewer hot keys than this, whatever the input.
HOT_SHARE = 1000


def attach_totals(rows: DataFrame, totals: DataFrame, key: str, count: str) -> DataFrame:
    """rows, each with what `totals` (one row a key, nulls being one key) says of its key; `count` there is the key's number of
    rows and stays away. Both are read twice, so they are best tables.

    Few totals are broadcast, behind a count. Of many, only those of hot keys are, which are fewer than HOT_SHARE; the others
    meet their rows by a shuffle, in which no key holds much."""
    totals = totals.withColumnRenamed(key, "_key")
    same = rows[key].eqNullSafe(F.col("_key"))
    if totals.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(totals.drop(count)), same, "left").drop("_key")
    total = totals.agg(F.sum(count)).first()[0]
    totals = totals.withColumn("_hot", F.col(count) * HOT_SHARE > total).drop(count)
    hot = F.broadcast(totals.where("_hot").drop("_hot"))
    return rows.join(hot, same, "inner").unionByName(rows.join(hot.select("_key"), same, "left_anti").join(totals.where("not _hot").drop("_hot"), same, "left")).drop("_key")


def text_hash() -> Column:
    """What tells the texts of one doc_id apart."""
    return F.xxhash64("text")


def repeated_ids(docs: DataFrame) -> DataFrame | None:
    """(doc_id, h): the different texts of each doc_id that rows repeat with another text; None where no id does."""
    rows = docs.where("doc_id is not null").select("doc_id", text_hash().alias("h"))
    ids = cut(rows.groupBy("doc_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("doc_id"))
    if not ids.take(1):
        return None
    return cut(rows.join(broadcast_if_small(ids), "doc_id", "left_semi").distinct())


#: Rows in one Arrow batch to a Python worker: texts of some KB make batches of some MB. Spark itself ends a batch at 64 MB.
BATCH_ROWS = 1000


#: Python workers give freed memory back rather than keep it in pools of their own.
WORKER_ENV = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": "33554432", "MALLOC_MMAP_THRESHOLD_": "8388608"}


def gentle(df: DataFrame) -> DataFrame:
    """The frame, with the session's Arrow batches held small enough for long texts, and workers that give memory back."""
    importable(df.sparkSession)
    for name, value in WORKER_ENV.items():
        df.sparkSession.sparkContext.environment.setdefault(name, value)
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)
    return df


def map_frames(df: DataFrame, run, schema: str) -> DataFrame:
    """As mapInPandas, but whole numbers stay exact beside nulls, where pandas would make them doubles.

    run takes pandas frames, with whole numbers and None in columns that hold nulls, and gives columns by name."""
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def exact(batches):
        for out in run(b.to_pandas(integer_object_nulls=True) for b in batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type, from_pandas=True) for f in kind], schema=kind)

    return df.mapInArrow(exact, schema)


def columns(rows: list[tuple], names: str) -> dict[str, list]:
    """Rows as columns by name."""
    return {name: [r[i] for r in rows] for i, name in enumerate(names.split())}


def as_bytes(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, _CHUNK + 4096)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if size <= 4 * _CHUNK:
            _powers[base] = have
    return have[:n]


def _word_hashes(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of a lower-cased buffer that ends in white space."""
    arr = np.frombuffer(buf, dtype=np.uint8)
    gap = SPACE[arr]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    total = np.zeros(len(arr) + 1, dtype=np.uint64)
    np.cumsum((arr.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(arr)), out=total[1:])
    raw = (total[end] - total[start]) * _power(_BASE_INV, len(arr))[start]
    return mix(raw ^ ((end - start).astype(np.uint64) << np.uint64(56))), start


def tokenize(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all A-Z-lower-cased words of the texts, in order, and the words in each text.

    Works through about 2 MB of text at a time, so its memory follows the longest text."""
    counts, hashes, i = np.zeros(len(blobs), dtype=np.int64), [], 0
    while i < len(blobs):
        j, size = i, 0
        while j < len(blobs) and (j == i or size + len(blobs[j]) < _CHUNK):
            size += len(blobs[j]) + 1
            j += 1
        buf = (b" ".join(blobs[i:j]) + b" ").lower()
        h, start = _word_hashes(buf)
        ends = np.cumsum([len(b) + 1 for b in blobs[i:j]])
        counts[i:j] = np.diff(np.searchsorted(start, ends), prepend=0)
        hashes.append(h)
        i = j
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def shingles(h: np.ndarray, width: int = 5) -> np.ndarray:
    """Hash of every run of `width` words."""
    n = len(h) - width + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return out
