"""Minimum bin slack: optimal fill of each bin, and whole documents back from the pieces."""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import AWKWARD, documents, with_clashes
from trailweave.llm import queries
from trailweave.llm.packing import byte_bpe, fullest, minimum_bin_slack, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9), st.integers(0, 40))
def test_the_fullest_combination(lengths, room):
    counts = np.bincount(lengths, minlength=64) if lengths else np.zeros(64, np.int64)
    got = fullest(counts, room)
    best = max(sum(c) for k in range(len(lengths) + 1) for c in itertools.combinations(lengths, k) if sum(c) <= room)
    assert sum(got) == best
    assert all(got.count(x) <= lengths.count(x) for x in got)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_every_piece_is_placed_once(lengths):
    counts = np.bincount(lengths, minlength=31) if lengths else np.zeros(31, np.int64)
    plan = minimum_bin_slack(counts, 30)
    placed = np.zeros(31, np.int64)
    for bin_, times in plan:
        assert sum(bin_) <= 30
        np.add.at(placed, bin_, times)
    assert (placed == counts).all()


def test_counts_do_not_slow_it_down():
    counts = np.zeros(2049, np.int64)
    counts[1:] = 10**9
    assert sum(times for _, times in minimum_bin_slack(counts, 2048)) <= 1.001 * (counts * np.arange(2049)).sum() / 2048


def checked(rows, got, capacity):
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    want = []
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        sizes = [len(ids) % capacity or capacity] + [capacity] * ((len(ids) - 1) // capacity)
        for piece, size in enumerate(sizes):
            want.append((i, piece, at, size, zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())))
            at += size
    assert sorted(((g.id, g.piece, g.start, g.length, g.ids_crc32) for g in got), key=repr) == sorted(want, key=repr)
    bins = defaultdict(list)
    for g in got:
        bins[g.sequence_id].append((g.offset, g.length))
    for own in bins.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= capacity
    return bins


@pytest.mark.parametrize("capacity", [16, 2048])
def test_round_trip(spark, capacity):
    rows = AWKWARD + [(100 + i, "word " * (i % 40)) for i in range(200)] + [(500, "special <|endoftext|> text")]
    got = pack(with_clashes(documents(spark, rows)), PATH, capacity=capacity).collect()
    checked(rows, got, capacity)


def test_an_empty_table(spark):
    assert pack(documents(spark, []), PATH).collect() == []


def test_both_encoders_agree():
    import trailweave.llm.packing as packing

    slow = Tokenizer.from_file(PATH)
    slow.encode_special_tokens = True
    fast = packing.byte_bpe(PATH)
    for text in ("a  b\n\n c", "Üñí 🙂 x1234", "<|endoftext|>", "", "it's 12 o'clock\t\r\n"):
        assert np.frombuffer(fast(text), "<u4").tolist() == slow.encode(text, add_special_tokens=False).ids
    assert byte_bpe(PATH)("x") == fast("x")


def test_query_packs_nearly_full(spark, sf_dir):
    got = queries.op9_best_fit_packing(spark, sf_dir).withColumnRenamed("doc_id", "id").collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    bins = checked(rows, got, 2048)
    assert len(bins) <= -(-sum(g.length for g in got) // 2048) + 1
