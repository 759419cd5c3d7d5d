"""Rows that repeat a doc_id with another text: documents of their own in deduplication, joins and the pipeline's stages."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratagraph.llm import near_join, suffix_dedup
from test_operators import brute_classes, prose


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def in_order(spark, rows):
    """The different (doc_id, text) in the operators' order: by id, then by the hash of the text."""
    found = frame(spark, rows).where("doc_id is not null").distinct().orderBy("doc_id", F.xxhash64("text")).collect()
    return [tuple(r) for r in found]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    shared, other = prose(rng, 60), prose(rng, 40)
    rows = [(1, shared), (1, f"prefix {shared} tail"), (2, shared), (2, shared), (3, f"{other} {prose(rng, 9)}"), (3, f"{prose(rng, 5)} {other}"), (3, None), (4, f"{other} x {other}")]
    rows += [(9, prose(rng, 30)) for _ in range(4)] + [(None, shared), (7, ""), (-5, f"{shared} start")]
    return rows


@pytest.mark.parametrize("hot", [20_000, 0])
def test_suffix_dedup(spark, rows, hot):
    order = in_order(spark, rows)
    want = suffix_dedup.brute_force({k: (t or "").encode() for k, (_, t) in enumerate(order)})
    of = {r: want[k] for k, r in enumerate(order)}
    docs = frame(spark, rows).withColumn("again", F.col("text")).withColumn("sub", F.lit("s"))
    got = suffix_dedup.remove_repeats(docs, hot=hot, with_row=True).collect()
    assert len(got) == len(rows)
    for r in got:
        expected = of[(r.doc_id, r.row.again)] if r.doc_id is not None else (0, 0, hashlib.sha256((r.row.again or "").encode()).hexdigest())
        assert (r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) == expected and r.row["sub"] == "s"
    assert sum(w[0] for w in of.values()) > 500


def test_near_join(spark):
    """Links of every text of an id are found, and the class is named by its smallest id."""
    rng = random.Random(22)
    a, b, c = prose(rng, 40), prose(rng, 40), prose(rng, 40)
    rows = [(1, a), (1, b), (5, f"{b} x"), (7, f"{a} y"), (5, c), (6, f"{c} z"), (6, "too short"), (8, None), (8, ""), (None, a), (9, a), (9, a)]
    order = list(dict.fromkeys(r for r in rows if r[0] is not None))
    sets = brute_classes({k: t for k, (_, t) in enumerate(order)})
    least = {}
    for k, (i, _) in enumerate(order):
        least[sets[k][1]] = min(i, least.get(sets[k][1], i))
    want = sorted((i, sets[k][0], least[sets[k][1]]) for k, (i, _) in enumerate(order)) + [(9, sets[0][0], 1)]
    got = [tuple(r) for r in near_join.near_classes(frame(spark, rows)).collect()]
    assert sorted(r for r in got if r[0] is not None) == sorted(want) and [r for r in got if r[0] is None] == [(None, sets[0][0], None)]


def test_stages_one_after_another(spark, rows):
    """Each stage takes all that the stage before keeps; no text is lost where an id repeats."""
    wide = frame(spark, rows).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    docs = corpus_pipeline.near_duplicates(spark, wide, "").cache()
    order = in_order(spark, [(r.doc_id, r.text) for r in docs.collect()])
    want = suffix_dedup.brute_force({k: (t or "").encode() for k, (_, t) in enumerate(order)})
    left = corpus_pipeline.passages(spark, docs, "").cache()
    kept = sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in left.collect() if r.doc_id is not None)
    assert kept == sorted(want[k][2] for k in range(len(order)))
    mixed = corpus_pipeline.mixing(spark, left, "")
    assert corpus_pipeline.packing(spark, mixed, "").count() >= mixed.count() > 0
