"""Language identification: the models' probabilities, and held-out accuracy."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.helpers import AWKWARD, documents, with_clashes
from trailweave.llm import queries
from trailweave.llm.langid import ORDER, CharModels, SortedHashes, identify, learn, learn_and_identify

TRAIN = {"aa": ["banana bandana", "an ananas banana"], "bb": ["mississippi", "missing sip"]}


def kneser_ney(texts, alphabet=1 << 16, d=0.75):
    """Interpolated Kneser-Ney of order ORDER in dictionaries: a function of (context, character)."""
    counts = [Counter() for _ in range(ORDER + 1)]
    for t in texts:
        s = " " * (ORDER - 1) + t
        for i in range(ORDER - 1, len(s)):
            counts[ORDER][s[i - ORDER + 1 : i + 1]] += 1
    for n in range(ORDER - 1, 0, -1):
        for gram in counts[n + 1]:
            counts[n][gram[1:]] += 1
    totals = [defaultdict(lambda: [0, 0]) for _ in range(ORDER + 1)]
    for n in range(1, ORDER + 1):
        for gram, c in counts[n].items():
            totals[n][gram[:-1]][0] += c
            totals[n][gram[:-1]][1] += 1

    def p(context, c):
        n = len(context) + 1
        lower = p(context[1:], c) if n > 1 else 1 / alphabet
        total, kinds = totals[n][context] if context in totals[n] else (0, 0)
        return max(counts[n][context + c] - d, 0) / total + d * kinds / total * lower if total else lower

    return p


def test_entropies_are_kneser_ney():
    model = CharModels(TRAIN)
    for text in ("banana", "mi sap", "zzz", "ananas missing"):
        e, _ = model.entropies([text])
        for k, lang in enumerate(model.languages):
            p, s = kneser_ney(TRAIN[lang]), " " * (ORDER - 1) + text
            want = -sum(math.log(p(s[i - ORDER + 1 : i], s[i])) for i in range(ORDER - 1, len(s))) / len(text)
            assert e[0, k] == pytest.approx(want, rel=1e-4)


def test_batches_and_pieces_do_not_change_scores(monkeypatch):
    import trailweave.llm.langid as langid

    model = CharModels(TRAIN)
    texts = ["banana " * 50, "", "mississippi sip " * 30, "x"]
    alone = [model.entropies([t])[0][0] for t in texts]
    assert np.allclose(model.entropies(texts)[0], alone)
    monkeypatch.setattr(langid, "CHUNK", 64)
    assert np.allclose(model.entropies(texts)[0], alone)


def test_sorted_hashes_find_what_is_there():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    table = SortedHashes(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    assert (table.find(keys + np.uint64(1)) == -1).sum() >= len(keys) - 1
    assert SortedHashes(np.zeros(0, np.uint64)).find(keys).max() == -1


def test_awkward_texts_and_und(spark):
    rows = AWKWARD + [(20, "12345 !?"), (21, "banana bandana banana")]
    model = CharModels(TRAIN)
    model.calibrate(["banana ananas", "missing mississippi"], ["aa", "bb"])
    got = {(g.id, g.cross_entropy): g for g in identify(with_clashes(documents(spark, rows)), model).collect()}
    by_id = {g.id: g for g in got.values()}
    assert [by_id[i].lang_pred for i in (1, 2, 3, 20)] == ["und"] * 4
    assert all(by_id[i].score == 0 and by_id[i].rejected for i in (1, 2, 3, 20))
    assert by_id[21].lang_pred == "aa"
    assert by_id[9].rejected  # nothing like either language
    assert identify(documents(spark, []), model).collect() == []


def test_letters_beyond_the_third_plane(spark):
    """U+30000 and U+31350 are letters, U+E0100 is a mark."""
    ext = "".join(chr(0x30000 + i % 40) for i in range(60))
    model = CharModels(TRAIN | {"zz": [ext]})
    rows = [(1, ext[5:30]), (2, "\U00031350"), (3, "\U000e0100"), (4, "banana")]
    assert {g.id: g.lang_pred for g in identify(documents(spark, rows), model).collect()} == {1: "zz", 2: model.predict(["\U00031350"])["lang"][0], 3: "und", 4: "aa"}
    assert model.predict(["\U00031350"])["lang"][0] != "und"


def test_very_many_languages():
    """Each of 300 languages keeps a model, and the tables are as large as the texts and not times the languages."""
    r = np.random.default_rng(5)
    alphabets = [[chr(0x4E00 + 40 * k + i) for i in range(40)] for k in range(300)]
    texts = {f"l{k:03}": ["".join(r.choice(a, 200)) for _ in range(8)] for k, a in enumerate(alphabets)}
    model = CharModels(texts)
    assert len(model.languages) == 300
    assert sum(x.value.size for x in (*model.grams, *model.contexts)) <= 2 * ORDER * sum(len(t) for ts in texts.values() for t in ts)
    probes = ["".join(r.choice(a, 300)) for a in alphabets]
    assert (model.predict(probes)["lang"] == model.languages).mean() > 0.95


def test_a_rare_language_of_long_texts_is_learnt(spark):
    rows = [(i, "banana bandana ananas " * 3, "aa") for i in range(400)] + [(1000 + i, "mississippi missing sip " * 9000, "bb") for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = learn(df)
    assert model.languages == ["aa", "bb"]
    assert model.predict(["missing mississippi"])["lang"][0] == "bb"


def test_nothing_to_learn_from(spark):
    empty = documents(spark, [])
    assert [g.lang_pred for g in identify(documents(spark, [(1, "abc")]), learn(empty)).collect()] == ["und"]
    assert learn_and_identify(empty).collect() == []


def test_held_out_accuracy(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op1_language_id(spark, d).collect()
    assert {g.doc_id for g in got} == set(truth)
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 3 == 1) for g in got)
    own = [g for g in got if g.held_out and g.lang_pred != "und" and truth[g.doc_id]]
    assert np.mean([g.lang_pred == truth[g.doc_id] for g in own]) > 0.97
    assert all(0 <= g.score <= 1 for g in got)
