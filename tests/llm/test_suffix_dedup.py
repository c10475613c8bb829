"""Removal of repeated byte strings against a dictionary of all substrings."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import AWKWARD, documents, prose, with_clashes
from trailweave.llm import queries
from trailweave.llm import suffix_dedup as whole
from trailweave.llm.common import drop_staged, offsets
from trailweave.llm.suffix_dedup import suffix_dedup
from trailweave.llm.suffix_sort import Aligned, PrefixHashes, SuffixSort


def brute(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + length] for _, b in raw for p in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone[: len(b)]])).hexdigest()))
    return sorted(out, key=repr)


def table(seed, n=60):
    r = random.Random(seed)
    shared = [prose(r, k) for k in (20, 40, 80)]
    rows = list(AWKWARD)
    for i in range(n):
        parts = [prose(r, r.randrange(5, 60))]
        for _ in range(r.randrange(0, 3)):
            s = r.choice(shared)
            a = r.randrange(len(s) // 2)
            parts += [s[a:], prose(r, 10)]
        rows.append((100 + i, "".join(parts)))
    rows += [(900, "ab" * 400), (901, "x" * 130), (902, "x" * 131), (903, "é" * 200), (904, rows[20][1]), (905, rows[20][1]), (906, "y" + rows[21][1])]
    return rows


@pytest.mark.parametrize(("length", "part"), [(100, 1 << 20), (130, 1), (64, 300), (100, 2000)])
def test_removed_bytes(spark, length, part):
    rows = table(length)
    got = suffix_dedup(with_clashes(documents(spark, rows)), length=length, part=part).collect()
    assert sorted(((g.id, g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got), key=repr) == brute(rows, length)
    for g in got:
        assert sum(e - a for a, e in zip(g.spans[::2], g.spans[1::2], strict=True)) == g.n_removed


def sorted_suffixes(segments, length):
    buffer = np.frombuffer(b"".join(segments), np.uint8)
    ends = offsets(map(len, segments))
    at = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(ends, ends[1:], strict=False)])
    return SuffixSort(buffer, PrefixHashes(buffer), at, length), [buffer[p : p + length].tobytes() for p in at]


def test_suffixes_are_sorted_by_hash_comparisons():
    r = random.Random(1)
    s, keys = sorted_suffixes([bytes(r.choice(b"ab") for _ in range(r.randrange(70, 200))) for _ in range(12)] + [b"a" * 150, b"a" * 90], 64)
    assert [keys[i] for i in s.order] == sorted(keys)
    twice, lead = s.classes()
    counts = Counter(keys)
    assert twice.tolist() == [counts[k] > 1 for k in keys]
    assert lead.sum() == len(counts)


def test_stretches_are_sorted_from_their_anchors_both_ways():
    r = random.Random(2)
    anchor = bytes(r.randrange(97, 123) for _ in range(64))
    some = lambda n: bytes(r.choice(b"ab") for _ in range(n))
    segments = [some(n) + anchor + some(r.randrange(26 - n, 27)) for n in (r.randrange(27) for _ in range(80))]
    buffer, ends = np.frombuffer(b"".join(segments), np.uint8), offsets(map(len, segments))
    group = np.repeat([1, 5], 40)
    at = ends[:-1] + [s.index(anchor) for s in segments]
    got = Aligned(buffer, PrefixHashes(buffer), group, ends[:-1], at, ends[1:], 90)
    after = [s[s.index(anchor) :] for s in segments]
    before = [s[: s.index(anchor)][::-1] for s in segments]
    for back, side in ((False, after), (True, before)):
        assert [(group[i], side[i]) for i in got.sort(back)] == sorted((g, x) for g, x in zip(group, side, strict=True))
    row, at_j, seen, led, may = got.shared()
    chosen = lambda flag: {(int(i), int(j)) for i, j in zip(row[flag], at_j[flag], strict=True)}
    assert -1 not in {j for _, j in chosen(seen | led | may)}
    windows = {}
    for i, s in enumerate(segments):
        for p in range(len(s) - 90 + 1):
            windows.setdefault((group[i], s[p : p + 90]), []).append((i, s.index(anchor) - p))
    twice = {x for v in windows.values() if len(v) > 1 for x in v}
    assert chosen(seen) <= twice <= chosen(may)
    assert chosen(at_j >= 0) == {x for v in windows.values() for x in v}
    assert all(set(v) - chosen(led) for v in windows.values())  # one of each class stands for the rest


def test_a_hash_collision_is_found(monkeypatch):
    """With hashes that say that all is equal, the bytes decide."""
    monkeypatch.setattr(PrefixHashes, "of", lambda self, at, n: np.zeros(len(at), np.uint64))
    s, keys = sorted_suffixes([b"a" * 70, b"a" * 40 + b"b" * 40], 64)
    twice, _ = s.classes()
    assert twice.tolist() == [Counter(keys)[k] > 1 for k in keys]


def thue_morse(n):
    out = "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out


@pytest.mark.parametrize("part", [1 << 20, 1])
def test_texts_that_collide_modulo_two_to_the_64(spark, part):
    """Thue-Morse words and their complements have equal polynomial hashes, whatever the odd base."""
    r = random.Random(4)
    x = thue_morse(2048)
    y = x.translate(str.maketrans("ab", "ba"))
    buffer = np.frombuffer((x + y).encode(), np.uint8)
    h = PrefixHashes(buffer)
    assert h.of(np.array([0]), 2048) == h.of(np.array([2048]), 2048)
    shared = prose(r, 60)
    rows = [(1, x), (2, y), (3, shared + x + shared), (4, shared + y + shared), (5, prose(r, 50) + y), (6, "q" + x[:1024] + shared), (7, "z" + y[:1024] + shared)]
    got = suffix_dedup(documents(spark, rows), length=1100, part=part).collect()
    assert sorted(((g.id, g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got), key=repr) == brute(rows, 1100)


@pytest.mark.parametrize("part", [1 << 20, 1])
def test_hashes_that_hardly_tell_anything(spark, part, monkeypatch):
    """Anchors and comparisons by hashes of two bits: only the bytes and digests can be right."""
    real = PrefixHashes.of
    monkeypatch.setattr(PrefixHashes, "of", lambda self, at, n: real(self, at, n) & np.uint64(3))
    rows = [(i, t) for i, t in table(9, 12)]
    raw = [(t or "").encode() for _, t in rows]
    got, digests = whole.stretches(raw, 100)
    pieces = [raw[t][a : b + 100] for t, a, b in zip(got["text"], got["s0"], got["s1"], strict=True)]
    assert len({*pieces}) == len({*digests})
    keep = {p: i for i, p in enumerate(pieces)}
    some = sorted(keep.values())
    some.sort(key=lambda i: got["m"][i])
    m = got["m"][some].view(np.uint64)
    seg, first, last, *_ = whole.repeated([pieces[i] for i in some], m, m, np.zeros(len(some), bool), 100)
    shown = {(int(s), p) for s, a, b in zip(seg, first, last, strict=True) for p in range(a, b + 1)}
    counts = Counter(pieces[i][p : p + 100] for i in some for p in range(len(pieces[i]) - 99))
    assert shown == {(k, p) for k, i in enumerate(some) for p in range(len(pieces[i]) - 99) if counts[pieces[i][p : p + 100]] > 1}


def test_nothing_is_left_in_the_catalog(spark):
    before = {t.name for t in spark.catalog.listTables()}
    suffix_dedup(documents(spark, [(1, "a" * 500), (2, "b" + "a" * 500)])).collect()
    assert {t.name for t in spark.catalog.listTables()} == before
    drop_staged(spark)


def test_an_empty_table(spark):
    assert suffix_dedup(documents(spark, [])).collect() == []


def test_query_over_the_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.op5_suffix_array_dedup(spark, sf_dir).collect()
    assert sorted(((g.doc_id, g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got), key=repr) == brute(rows, 400)
