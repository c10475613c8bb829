"""The pipeline's stages, each on its own input."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from tests.llm.helpers import AWKWARD, documents, prose
from tests.llm.test_near_dedup import brute, edited
from trailweave.llm.common import drop_staged, stage

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with planted cases: toxic, exact and near copies, and a benchmark passage."""
    r = random.Random(9)
    item = prose(r, 40)
    rows = list(AWKWARD)
    rows += [(100 + i, prose(r, 60) + (" vile scum wretch " if i % 2 else " ") + prose(r, 60)) for i in range(120)]
    base = prose(r, 200)
    rows += [(300, base), (301, base), (302, edited(r, base, 2)), (303, prose(r, 60) + " " + item + " " + prose(r, 60))]
    path = tmp_path_factory.mktemp("tables")
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(100 + i, 1, i % 2) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows


def test_stages_one_by_one(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = []
    for name, step in list(corpus_pipeline.STAGES)[:-1]:
        out = stage(step(spark, docs, path), "test")
        assert out.columns == docs.columns, name
        kept.append(sorted(((r.doc_id, r.text) for r in out.collect()), key=repr))
        before, docs = docs, out
        assert out.count() <= before.count()
    clean, distinct, apart, unseen = ({i for i, _ in k} for k in kept)
    toxic = {100 + i for i in range(120) if i % 2}
    assert len(toxic & clean) <= 3
    assert len({100 + i for i in range(120)} - toxic - clean) <= 3
    assert {1, 2, 300, 302, 303} - clean == set()
    assert distinct & {300, 301} == {300}
    assert distinct & {1, 2} == {1}  # null and empty texts are equal
    stay = {i for i, _, c in brute(kept[1], 80) if i == c}
    assert apart == stay
    assert apart & {300, 302} == {300}
    assert 303 in apart
    assert unseen == apart - {303}
    drop_staged(spark)


def test_the_whole_run_packs_what_is_left(spark, folder):
    path, _ = folder
    got = corpus_pipeline.run(spark, path).collect()
    ids = {r.doc_id for r in got}
    assert 303 not in ids
    assert {300, 1} <= ids
    assert all(r.offset + r.length <= 2048 for r in got)
    assert drop_staged(spark) > 0


def test_an_empty_corpus(spark, folder, tmp_path):
    path, _ = folder
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/labels.parquet").where("doc_id < 0").write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").where("item_id < 0").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
