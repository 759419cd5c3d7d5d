"""A training-data pipeline over `documents`: each stage is one operator of `stratagraph.llm`, applied to all that the
stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.llm.common import cut, keep, load
from stratagraph.runtime import broadcast_if_small


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject."""
    from stratagraph.llm.quality import keep_good

    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that with the smallest doc_id. Rows without an id stay.

    Rows that share a doc_id but not the text are documents of their own."""
    from stratagraph.llm.near_join import near_classes

    several = cut(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not several.take(1):
        heads = near_classes(docs).where("doc_id = component_id").select("doc_id")
        return docs.join(heads, "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).select(*docs.columns)
    several = broadcast_if_small(several.withColumn("again", F.lit(True)))
    rows = docs.where("doc_id is not null").select(F.struct("*").alias("row"), "doc_id", "text").join(several, "doc_id", "left")
    own = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)
    rows = rows.select("row", "doc_id", "text", F.when(F.col("again"), own).otherwise(F.col("doc_id")).alias("key"), "again")
    classes = near_classes(rows.select(F.col("key").alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "component_id")
    head = classes.join(rows.select("key", "doc_id").distinct(), "key").groupBy("component_id").agg(F.min(F.struct("doc_id", "key")).alias("head"))
    kept = rows.join(head.select(F.col("head.key").alias("key")), "key", "left_semi")
    once = kept.where("again").groupBy("key").agg(F.min("row").alias("row"))  # rows that repeat id and text
    return kept.where("again is null").select("row.*").unionByName(once.select("row.*")).unionByName(docs.where("doc_id is null")).select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 100 bytes or more that an earlier document, or the same one, already holds.

    A character that a cut splits goes whole; n_chars is that of the text that is left."""
    from stratagraph.llm.suffix_dedup import remove_repeats

    left = remove_repeats(docs, with_row=True, as_text=True)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return left.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources to their targets: a document that the mix takes k times gives k rows."""
    from stratagraph.llm.mixing import mix_sources

    mixed = mix_sources(docs, weights=(1, 2, 3), repeats=3, with_row=True).where("taken > 0")
    times = F.sequence(F.lit(1).cast("long"), F.expr("taken div size"))
    return mixed.select("row", F.explode(times)).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of 2048."""
    import public_tokenizers

    from stratagraph.llm.packing import pack

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("passages", passages), ("mixing", mixing), ("packing", packing)]

#: SQL expresses neither the fitted rules nor the packing; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = keep(docs) if i < len(STAGES) - 1 else docs
    return docs
