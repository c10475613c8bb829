"""License scans against regular expressions and planted notices."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tests.llm.helpers import AWKWARD, documents, with_clashes
from trailweave.llm import queries
from trailweave.llm.licenses import BASE, TEMPLATES, RareIndex, scan_licenses, words


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    at, labels = [], set()
    for phrase, label in BASE.items():
        p = phrase.split()
        hits = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += hits
        labels |= {label} if hits else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


ROWS = [
    (100, "Released under the MIT License. See under the mit-license!"), (101, "Apache License, Version 2.0"), (102, "CC-BY-NC 4.0; cc by nd"), (103, "under the MITlicense"),
    (104, "ccby nc under the mit"), (105, "license apache license version 20"), (106, "Ünder the MIT license under thé mit license under the mit license"),
]


@pytest.mark.parametrize("copies", [1, 300])
def test_base_phrases(spark, copies):
    rows = (AWKWARD + ROWS) * copies
    got = scan_licenses(with_clashes(documents(spark, rows))).collect()
    assert sorted(((g.id, g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) for g in got), key=repr) == sorted(((i, *brute(t)) for i, t in rows), key=repr)
    for g in got:
        assert set(g.base_labels.split(",")) <= set(g.labels.split(",")) or not g.base_labels
        assert 0 <= g.score <= 1
        assert (g.score > 0) == bool(g.labels)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "mit"),
        ("Permission is hereby granted, free of charge, to anybody obtaining a copy", ""),
        ("Some code. Licensed under the GNU General Public License version 3 or later. This work is licensed under the GNU General Public License version 3.", "gpl-3"),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "bsd"),
        ("restriction without Software the in deal to", ""),
        ("(c) 2020 Someone. All rights reserved.", "all-rights-reserved"),
    ],
)
def test_templates_need_all_mandatory_phrases(text, labels):
    assert RareIndex().scan([text])[0][5] == labels


def test_postings_are_relative_positions():
    index = RareIndex({"x": ("one [two three] four [five]",)}, {})
    assert index.scan(["zero one two three four five"])[0][5:] == ("x", 1.0)
    label, share = index.scan(["two three filler five"])[0][5:]
    assert label == "x"
    assert share == pytest.approx(3 / 5)
    assert index.scan(["five then two three"])[0][5] == ""
    assert words("A-b_c 1é") == ["a", "b", "c", "1é"]


def all_templates(text, slack=3):
    """Labels and largest share by trying every template at every start."""
    w, labels, score = words(text), set(), 0.0
    for phrase, label in BASE.items():
        p = phrase.split()
        if any(w[i : i + len(p)] == p for i in range(len(w))):
            labels.add(label)
            score = 1.0
    for label, notice in ((x, n) for x, ns in TEMPLATES.items() for n in ns):
        whole = words(notice)
        phrases = [(len(words(notice[: m.start()])), words(m[1])) for m in re.finditer(r"\[(.*?)\]", notice)]
        for start in range(-len(whole) - slack, len(w) + slack):
            low = 0
            for o, p in phrases:
                at = [i for i in range(max(low, start + o - slack), start + o + slack + 1) if w[i : i + len(p)] == p]
                if not at:
                    break
                low = at[0] + len(p)
            else:
                labels.add(label)
                score = max(score, sum(0 <= start + j < len(w) and w[start + j] == x for j, x in enumerate(whole)) / len(whole))
    return ",".join(sorted(labels)), score


@pytest.mark.parametrize("seed", range(12))
def test_files_with_several_licences(seed):
    """Third-party notices: no template is lost to the words of others, whatever the words' IDF."""
    r = random.Random(seed)
    notices = [re.sub(r"[\[\]]", "", n) for ns in TEMPLATES.values() for n in ns]
    index = RareIndex()
    index.idf = np.random.default_rng(seed).random(len(index.hashes))
    texts = ["\n\n".join(notices)]
    for n in (2, 3, 5, 8):
        ws = " own code ".join(r.sample(notices, n)).split()
        for _ in range(n):  # words lost, put in and moved
            ws.insert(r.randrange(len(ws)), r.choice(("x", ws.pop(r.randrange(len(ws))))))
        texts.append(" ".join(ws))
    for text, got in zip(texts, index.scan(texts), strict=True):
        labels, score = all_templates(text)
        assert got[5] == labels
        assert got[6] == pytest.approx(score)


def test_an_empty_table(spark):
    assert scan_licenses(documents(spark, [])).collect() == []


def test_query_over_the_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.op2_license_scan(spark, sf_dir).collect()
    assert sorted((g.doc_id, g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) for g in got) == sorted((i, *brute(t)) for i, t in rows)
