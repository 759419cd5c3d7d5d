"""A table as append-only deltas: upserts, inserts and deletes are small files with a sequence number, merged at read.

For each id the last upsert or delete counts; an insert counts only where nothing is there, so the first one after that wins.
Nothing is rewritten until `compact` folds the deltas up to a number into a base. A delta is written under a folder of its
own and counts once its marker is there, so a write that fails or runs twice leaves no half of it."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

OPERATIONS = ("upsert", "insert", "delete")
_MARKER = "seq long, folder string, op string, base long"


class DeltaTable:
    """Rows of `schema`, which has the columns id and ord, in a folder. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _markers(self) -> list:
        """The deltas that count, in order: those after the newest base, and it."""
        try:
            rows = self.spark.read.schema(_MARKER).parquet(f"{self.path}/log").collect()
        except AnalysisException:
            return []
        rows = sorted({r["seq"]: r for r in sorted(rows, key=lambda r: r["folder"])}.values(), key=lambda r: r["seq"])
        base = max((r["base"] for r in rows), default=-1)
        return [r for r in rows if r["seq"] > base or r["op"] == "base" and r["base"] == base]

    def _append(self, rows: DataFrame, op: str, base: int = -1) -> int:
        known = self._markers()
        seq, folder = max((r["seq"] for r in known), default=-1) + 1, uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{folder}")
        self.spark.createDataFrame([(seq, folder, op, base)], _MARKER).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return seq

    def upsert(self, rows: DataFrame) -> int:
        """Rows that replace those of their ids; of equal ids the last by ord. Returns the delta's number."""
        return self._append(rows.select(*self.schema.names), "upsert")

    def insert(self, rows: DataFrame) -> int:
        """Rows whose ids are new; of equal ids the first by ord."""
        return self._append(rows.select(*self.schema.names), "insert")

    def delete(self, ids: DataFrame) -> int:
        """Removes rows by id; returns how many were there."""
        gone = self.read().join(ids.select("id").distinct(), "id", "left_semi")
        count = gone.count()
        self._append(ids.select(*[(F.col("id") if f.name == "id" else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema]), "delete")
        return count

    def changes(self) -> DataFrame:
        """All rows of the deltas that count, with seq and op; a base is like an insert into nothing."""
        kinds = StructType([*self.schema.fields, StructField("seq", LongType()), StructField("op", StringType())])
        parts = [
            self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{r['folder']}").select("*", F.lit(-1 if r["op"] == "base" else r["seq"]).cast("long").alias("seq"), F.lit("insert" if r["op"] == "base" else r["op"]).alias("op"))
            for r in self._markers()
        ]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], kinds)

    def read(self) -> DataFrame:
        """The rows as they are now."""
        return merged(self.changes(), self.schema.names)

    def compact(self) -> int:
        """Folds all deltas so far into a new base; returns its number. Readers of the old files keep them."""
        upto = max((r["seq"] for r in self._markers()), default=-1)
        return self._append(self.read(), "base", base=upto)


def merged(changes: DataFrame, names: list[str]) -> DataFrame:
    """The state after changes (seq, op and the columns `names`, of which id and ord), by aggregations that combine before
    the shuffle: the last upsert or delete of an id, else, or after a delete, the first insert behind it."""
    row, place = F.struct(*names), F.struct("seq", "ord")
    set_ = changes.where("op <> 'insert'").groupBy("id").agg(F.max("seq").alias("_seq"), F.max_by(F.struct("op", row.alias("row")), place).alias("_last"))
    live = set_.where("_last.op = 'upsert'").select("_last.row.*")
    behind = changes.where("op = 'insert'").join(set_, "id", "left").where("_seq is null or (_last.op = 'delete' and seq > _seq)")
    return live.unionByName(behind.groupBy("id").agg(F.min_by(row, place).alias("_row")).select("_row.*"))
