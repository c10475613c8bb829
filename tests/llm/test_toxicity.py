"""The text network: gradients, whole texts, and ranking of held-out labels."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from tests.llm.helpers import AWKWARD, documents, prose, with_clashes
from trailweave.llm import queries
from trailweave.llm.toxicity import CHUNK, FILTERS, WIDTHS, TextCNN, drop_toxic, score, train, words_of


@pytest.fixture(scope="module")
def sample():
    import random

    r = random.Random(6)
    texts = [prose(r, 30) + (" vile scum " if k % 2 else " kind friend ") + prose(r, 30) for k in range(160)]
    return texts, np.array([k % 2 for k in range(160)])


@pytest.fixture(scope="module")
def model(sample):
    m = TextCNN()
    m.learn_languages(sample[0], ["en"] * len(sample[0]))
    m.fit(*sample)
    m.calibrate(*sample)
    return m


def test_it_learns_the_phrase(model, sample):
    assert ((model.score(sample[0]) >= 0.5) == sample[1]).mean() > 0.97


def test_features_are_maxima_of_convolutions(model):
    text = "alpha beta vile gamma"
    ids, owner = next(words_of([text]))
    e = model.embedding[ids].sum(1)
    want = []
    for w, f, b in zip(WIDTHS, model.filters, model.bias, strict=True):
        starts = [sum(e[i + j] @ f[j] for j in range(min(w, len(e) - i))) + b for i in range(len(e))]
        want += np.maximum(np.max(starts, axis=0), 0).tolist()
    assert model._features(ids, owner, 1)[0][0] == pytest.approx(want, abs=1e-5)
    assert len(want) == FILTERS * len(WIDTHS)


def test_letters_beyond_the_third_plane_make_words():
    ids, owner = next(words_of(["\U00030000\U00031350 x", "\U00031350"]))
    assert owner.tolist() == [0, 0, 1]
    assert len({tuple(x) for x in ids.tolist()}) == 3


def test_neighbours_in_a_batch_do_not_leak(model, sample):
    texts = [*sample[0][:7], "", "vile", "scum " * 500]
    assert model.score(texts) == pytest.approx([model.score([t])[0] for t in texts], abs=1e-5)


def test_a_phrase_at_the_end_of_a_long_text_counts(model):
    assert model.score(["kind friend " * 150_000 + " vile scum vile scum"])[0] > model.score(["kind friend " * 150_000])[0]


def test_awkward_rows(spark, model):
    got = score(with_clashes(documents(spark, AWKWARD)), model).collect()
    assert len(got) == len(AWKWARD)
    assert all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.5) for g in got)
    assert score(documents(spark, []), model).collect() == []


def test_without_labels_nothing_is_toxic(spark):
    docs = documents(spark, AWKWARD)
    for rows in ([], [(1, 0), (2, 0)], [(1, None), (None, 1)]):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        assert all(g.predicted == 0 for g in score(docs, train(docs, labels)).collect())
        assert drop_toxic(docs, labels).count() == len(AWKWARD)


def test_dropping_keeps_columns_and_clean_rows(spark, sample):
    rows = list(enumerate(sample[0]))
    docs = with_clashes(documents(spark, rows))
    labels = spark.createDataFrame([(i, int(y)) for i, y in enumerate(sample[1])], "doc_id long, toxic int")
    left = drop_toxic(docs, labels)
    assert left.columns == docs.columns
    got = {r.doc_id for r in left.collect()}
    clean = {i for i, y in enumerate(sample[1]) if y == 0}
    assert len(clean - got) <= 3
    assert len(got - clean) <= 3


def auc(scores, y):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(y))
    ranks[order] = np.arange(1, len(y) + 1)
    return (ranks[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_held_out_ranking(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.1")
    y = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = queries.op7_toxicity(spark, d).collect()
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 5 == 0) for g in got)
    own = [g for g in got if g.held_out and y.get(g.doc_id) is not None]
    truth, scores = np.array([y[g.doc_id] for g in own]), np.array([g.score for g in own])
    assert auc(scores, truth) > 0.9
    assert ((scores >= 0.5) == truth).mean() > 0.9


@pytest.mark.parametrize("before", [6, 10])
def test_phrases_across_a_cut_are_seen(before):
    """Filters over pieces of a long text give what they give over all its words at once."""
    text = "a " * ((CHUNK - before) // 2) + "foo bar baz" + " a" * 1000
    texts = ["short one", text, "", "last"]
    pieces = list(words_of(texts))
    ids, owner = (np.concatenate(x) for x in zip(*pieces, strict=True))
    assert len(pieces) > 1
    m = TextCNN()
    m.learn_languages(["a"], ["en"])
    whole = m._features(ids, owner, len(texts))[0] @ m.out + m.out_bias
    assert m.raw(texts)[0] == pytest.approx(whole, abs=1e-5)
