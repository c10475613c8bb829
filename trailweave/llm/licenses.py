"""License scans with a positional index of rare tokens.

The document frequencies of all licence words are counted over the whole
corpus. A file that holds all mandatory words of a template is searched for it:
of each mandatory key phrase the word of the highest IDF is looked up, and its
occurrences where the rest of the phrase agrees support placements of the
template. A placement counts where all mandatory key phrases stand, in order,
near their places. Every such template is looked up, whatever else a file holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, word_hashes

_BETWEEN = np.array([not (b >= 128 or 48 <= b <= 57 or 97 <= b <= 122) for b in range(256)])
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Phrases that are reported at every place, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: label: notices, each with its mandatory phrases in square brackets.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": ("[permission is hereby granted free of charge] to any person [obtaining a copy] of this software and associated documentation files the software [to deal in the software without restriction]", "released under [the mit license]", "licensed under [the mit license]"),
    "apache-2": ("licensed under the [apache license version 2] 0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www [apache org licenses license 2]"),
    "cc-by-nc": ("licensed under [cc by nc] 4 0", "creative commons [attribution noncommercial] 4 0 international license"),
    "cc-by": ("licensed under [cc by 4]", "licensed under a [creative commons attribution 4] 0 international license"),
    "cc-by-sa": ("licensed under [cc by sa] 4 0", "creative commons [attribution sharealike]"),
    "cc0": ("dedicated to the public domain under [cc0 1] 0", "creative commons [zero] v1 0 [universal]"),
    "gpl-3": ("this work is licensed under the [gnu general public license version 3]", "it [under the terms of the gnu general public license] as published by the free software foundation either [version 3 of the license]"),
    "gpl-2": ("licensed under the [gnu general public license version 2]", "[under the terms of the gnu general public license] as published by the free software foundation either [version 2 of the license]"),
    "lgpl": ("licensed under the [gnu lesser general public license]",),
    "agpl-3": ("licensed under the [gnu affero general public license]",),
    "bsd": ("[redistribution and use in source and binary forms] with or without modification [are permitted provided that the following conditions are met]", "licensed under the [bsd 3 clause license]", "licensed under the [bsd 2 clause license]"),
    "mpl-2": ("this source code form is subject to the terms of the [mozilla public license v 2] 0", "licensed under the [mozilla public license version 2]"),
    "isc": ("[permission to use copy modify and or distribute this software for any purpose] with or without fee is hereby granted", "licensed under the [isc license]"),
    "unlicense": ("this is [free and unencumbered software released into the public domain]",),
    "all-rights-reserved": ("copyright c [all rights reserved]",),
}


def words(text: str) -> list[str]:
    return _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


class RareIndex:
    """Templates, their mandatory phrases by position, and the words' IDF."""

    def __init__(self, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, base: Mapping[str, str] = BASE, slack: int = 3):
        self.slack = slack
        self.labels, self.texts, self.phrases = [], [], []
        for label, notices in templates.items():
            for notice in notices:
                parts, place, whole = [], 0, []
                for inner, part in ((i % 2, p) for i, p in enumerate(re.split(r"[\[\]]", notice))):
                    if inner:
                        parts.append((place, words(part)))
                    whole += words(part)
                    place = len(whole)
                self.labels.append(label)
                self.texts.append(whole)
                self.phrases.append(parts)
        self.base = [(words(p), label) for p, label in base.items()]
        vocabulary = sorted({w for t in [*self.texts, *(p for p, _ in self.base)] for w in t})
        h = word_hashes([" ".join(vocabulary).encode()], _BETWEEN)[0]
        order = np.argsort(h)
        self.hashes = h[order]
        code = {vocabulary[i]: k for k, i in enumerate(order)}
        code_all = lambda ws: np.array([code[w] for w in ws])
        self.texts = [code_all(t) for t in self.texts]
        self.phrases = [[(o, code_all(p)) for o, p in ps] for ps in self.phrases]
        self.base = [(code_all(p), label) for p, label in self.base]
        self.needs = np.zeros((len(self.texts), len(h)), bool)
        for need, ps in zip(self.needs, self.phrases, strict=True):
            need[np.concatenate([p for _, p in ps])] = True
        self.idf = np.ones(len(h))

    def codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of words by text; for all words their code (-1 if no licence word), and the text of each."""
        h, owner = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts], _BETWEEN)
        k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.bincount(owner, minlength=len(texts)), np.where(self.hashes[k] == h, k, -1), owner

    def places(self, code: np.ndarray, phrase: np.ndarray) -> np.ndarray:
        """Where a phrase starts in a file's word codes, looked up by its word of the highest IDF."""
        rare = int(self.idf[phrase].argmax())
        at = np.flatnonzero(code == phrase[rare]) - rare
        at = at[(at >= 0) & (at <= len(code) - len(phrase))]
        for j, w in enumerate(phrase):
            at = at[code[at + j] == w]
        return at

    def placements(self, code: np.ndarray, present: np.ndarray) -> list[tuple[int, int, float]]:
        """Of each template with a verified placement in one file's word codes the best: (template, start, share of its words in place)."""
        out = []
        for t in np.flatnonzero(~(self.needs & ~present).any(1)).tolist():
            found = [self.places(code, phrase) for _, phrase in self.phrases[t]]
            fewest = min(range(len(found)), key=lambda i: len(found[i]))
            if not len(found[fewest]):
                continue
            start = np.unique(found[fewest][:, None] - self.phrases[t][fewest][0] + np.arange(-self.slack, self.slack + 1))
            low, ok = start - self.slack, np.ones(len(start), bool)
            for (o, phrase), at in zip(self.phrases[t], found, strict=True):
                k = np.searchsorted(at, np.maximum(low, start + o - self.slack))
                here = at[np.minimum(k, len(at) - 1)]
                ok &= (k < len(at)) & (here <= start + o + self.slack)
                low = here + len(phrase)
            if not len(start := start[ok]):
                continue
            text = self.texts[t]
            edge = np.full(len(text) + self.slack, -1)
            padded, n = np.concatenate((edge, code, edge)), np.zeros(len(start), np.int64)
            for j, w in enumerate(text):
                n += padded[start + len(edge) + j] == w
            best = int(n.argmax())
            out.append((t, int(start[best]), float(n[best] / len(text))))
        return out

    def scan(self, texts: list[str | None]) -> list[tuple]:
        n_words, code, owner = self.codes(texts)
        ends = np.cumsum(n_words)
        places: list[list[int]] = [[] for _ in texts]
        found: list[set[str]] = [set() for _ in texts]
        for phrase, label in self.base:
            ok = np.ones(max(len(code) - len(phrase) + 1, 0), bool)
            for j, w in enumerate(phrase):
                ok &= code[j : j + len(ok)] == w
            at = np.flatnonzero(ok)
            for i in at[owner[at] == owner[at + len(phrase) - 1]]:
                d = owner[i]
                places[d].append(int(i - ends[d] + n_words[d]))
                found[d].add(label)
        present = np.zeros((len(texts), len(self.hashes)), bool)
        hit = code >= 0
        present[owner[hit], code[hit]] = True
        some = np.zeros(len(texts), bool)
        for need in self.needs:
            some |= present[:, need].all(1)
        labels, score = [set(f) for f in found], [1.0 if f else 0.0 for f in found]
        for d in np.flatnonzero(some):
            for t, _, share in self.placements(code[ends[d] - n_words[d] : ends[d]], present[d]):
                labels[d].add(self.labels[t])
                score[d] = max(score[d], share)
        return [(int(n), len(p), min(p, default=None), max(p, default=None), ",".join(sorted(f)), ",".join(sorted(x)), s) for n, p, f, x, s in zip(n_words, places, found, labels, score, strict=True)]


def document_frequencies(docs: DataFrame, index: RareIndex, text_col: str = "text") -> tuple[int, np.ndarray]:
    """Documents, and for each licence word the documents that hold it, over all of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(len(index.hashes), np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                texts = b.column(0).slice(lo, 500).to_pylist()
                _, code, owner = index.codes(texts)
                hit = code >= 0
                present = np.zeros((len(texts), len(df)), bool)
                present[owner[hit], code[hit]] = True
                df += present.sum(0)
                n += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(df))), pa.array(np.append(n, df))], names=["w", "n"])

    counts = {r.w: r.n for r in docs.select(F.col(text_col).cast("string")).mapInArrow(lean(run), "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    return counts.get(-1, 0), np.array([counts.get(w, 0) for w in range(len(index.hashes))])


def scan_licenses(docs: DataFrame, index: RareIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII
    characters, over whole texts. n_base counts the places of the base phrases,
    first_word and last_word are their smallest and largest start (null without
    one). labels holds the base labels and those of verified templates, score
    the largest share of a template's words that stand in place (1 for a base
    phrase, 0 for no label). A null text counts as empty; repeated rows and null
    ids are scanned as they come; an empty table gives an empty result.
    """
    index = index or RareIndex()
    n, df = document_frequencies(docs, index, text_col)
    index.idf = np.log((n + 1) / (df + 1))
    sent = docs.sparkSession.sparkContext.broadcast(index)
    kinds: list[Any] = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                got = zip(*sent.value.scan(part.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(got, kinds, strict=True))], names=["id", *names])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
