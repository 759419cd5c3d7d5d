"""The pipeline's stages, each against brute force on its own input."""

import collections
import random

import pytest

import corpus_pipeline
from stratagraph.llm import suffix_dedup
from test_operators import brute_classes, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows = random.Random(11), []
    for i in range(80):
        rows.append((i, prose(rng, rng.randint(30, 90)), "en", f"src{i % 3}"))
    passage = prose(rng, 40)
    for i in range(80, 90):
        rows.append((i, f"{prose(rng, 30)}\n{passage}\n{prose(rng, 30)} Ünd", "de", "src0"))
    rows += [(90, rows[3][1], "en", "src1"), (91, " ".join([*rows[4][1].split(), "end"]), "en", None), (92, "too short", "en", "src1"), (93, None, "en", "src1")]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, kept = [n for n, _ in corpus_pipeline.STAGES], [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], folder).cache())
    assert names == ["quality", "near_duplicates", "passages", "mixing", "packing"]
    assert all(df.columns == docs.columns for df in kept[1:5])
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    good = texts(kept[1])
    assert set(good) == set(range(92))
    classes = brute_classes(good)
    assert set(texts(kept[2])) == {i for i, (_, c) in classes.items() if c == i} and 90 not in texts(kept[2]) and 91 not in texts(kept[2])
    left, before = texts(kept[3]), texts(kept[2])
    want = suffix_dedup.brute_force({i: t.encode() for i, t in before.items()})
    assert {i: len(before[i].encode()) - want[i][0] for i in before} == {i: len(t.encode()) for i, t in left.items()}
    assert {r.doc_id: r.n_chars for r in kept[3].collect()} == {i: len(t) for i, t in left.items()}
    times = collections.Counter(r.doc_id for r in kept[4].collect())
    assert set(times) <= set(left) and max(times.values()) <= 3
    packed = collections.Counter(r.doc_id for r in kept[5].where("piece = 0").collect())
    assert packed == times
    sizes = collections.defaultdict(int)
    for r in kept[5].collect():
        sizes[r.sequence_id] += r.length
    assert max(sizes.values()) <= 2048


def test_run_reads_the_tables(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 50


def test_clashing_columns_and_repeated_ids(spark):
    """Extra columns with the operators' own names pass through; rows with one id and two texts are two documents."""
    rng = random.Random(14)
    texts = [prose(rng, 60) for _ in range(4)]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[1]), (2, texts[1]), (3, texts[2] + " \N{REPLACEMENT CHARACTER} é"), (4, "ü" * 3 + texts[2]), (None, texts[3]), (None, None)]
    extra = "n_bytes spans kept size taken row key _key _pattern again text2 n_chars path"
    names = extra.split()
    docs = spark.createDataFrame([(i, t, "s", *([str(k)] * len(names))) for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names)).drop("n_chars")
    for stage in (corpus_pipeline.quality, corpus_pipeline.near_duplicates, corpus_pipeline.passages, corpus_pipeline.mixing):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and all(r.n_bytes == r["taken"] == r.path for r in out.collect())
    kept = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect() if r.text)
    assert kept == sorted([(1, texts[0]), (1, texts[1]), (3, rows[4][1]), (0, texts[3])])
    left = {r.doc_id: r.text for r in corpus_pipeline.passages(spark, docs.where("doc_id > 2"), "").collect()}
    assert left == {3: rows[4][1], 4: "ü" * 3}
    assert corpus_pipeline.packing(spark, docs, "").count() == 8
