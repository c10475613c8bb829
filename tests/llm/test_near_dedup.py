"""MinHash near-dedup against all pairs in Python."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import AWKWARD, documents, prose, with_clashes
from trailweave.llm import common, near_dedup, queries
from trailweave.llm.components import connected_components
from trailweave.llm.near_dedup import enough_collections, minhash_dedup, shingle_sets, words_of

_WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_set(text):
    w = _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, brute_set(t))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted(((i, len(brute_set(t)), None if i is None else find(i)) for i, t in rows), key=repr)


def edited(r, text, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    out = list(AWKWARD)
    for k in range(12):
        base = prose(r, 150)
        out += [(100 * k + 100 + j, edited(r, base, r.randrange(0, 7))) for j in range(8)]
    return [*out, (9001, "Short TEXT"), (9002, "short text"), (9003, "short text!")]


@pytest.mark.parametrize(("percent", "block", "weight"), [(85, 256, 400_000), (80, 2, 300), (85, 1, 100), (85, 5, 400_000)])
def test_links_and_components(spark, rows, percent, block, weight):
    got = minhash_dedup(with_clashes(documents(spark, rows)), percent=percent, block=block, weight=weight).collect()
    assert sorted(((g.id, g.n_shingles, g.component_id) for g in got), key=repr) == brute(rows, percent)
    assert all(g.kept == (g.id is None or g.id == g.component_id) for g in got)


def test_sets_match_python(rows):
    texts = [t for _, t in rows]
    assert [len(s) for s in shingle_sets(texts)[0]] == [len(brute_set(t)) for t in texts]
    assert shingle_sets([]) == ([], [])


def test_long_texts_are_read_piece_by_piece(monkeypatch):
    r = random.Random(3)
    texts = [prose(r, 300) + " \t" + "q" * 500 + "\x0b" + prose(r, 40), "Z" * 999, " " * 700, "a " * 400]
    whole = shingle_sets(texts)
    monkeypatch.setattr(near_dedup, "PIECE", 64)
    monkeypatch.setattr(common, "PIECE", 64)
    assert [len(s) for s in shingle_sets(texts)[0]] == [len(s) for s in whole[0]]
    assert shingle_sets(texts)[0][1].tolist() != whole[0][1].tolist()  # a word longer than a piece has a hash of another kind
    for i in (2, 3):
        assert shingle_sets(texts)[0][i].tolist() == whole[0][i].tolist()
    assert shingle_sets(texts)[1] == whole[1]
    assert [[w for part in words_of(t) for w in part] for t in texts] == [t.lower().encode().split() for t in texts]


def thue_morse(n):
    out = "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out


def test_words_that_collide_modulo_two_to_the_64(spark):
    """Thue-Morse words and their complements have equal polynomial hashes, whatever the odd base."""
    x = thue_morse(4096)
    y = x.translate(str.maketrans("ab", "ba"))
    tail = " one two three four five six seven"
    rows = [(1, x), (2, y), (3, "other"), (4, x + tail), (5, y + tail), (6, f"{x} {y} {x} {y} {x}"), (7, f"{y} {x} {y} {x} {y}")]
    got = minhash_dedup(documents(spark, rows)).collect()
    assert sorted(((g.id, g.n_shingles, g.component_id) for g in got), key=repr) == brute(rows, 80)
    assert {g.component_id for g in got} == {1, 2, 3, 4, 5, 6, 7}


def test_links_are_confirmed_on_words(spark, monkeypatch):
    """Links don't use the hashes."""
    r = random.Random(6)
    texts = [prose(r, 30) for _ in range(12)]
    rows = list(enumerate([*texts, texts[3] + " tail", texts[5]], 1))
    ids, texts = [i for i, _ in rows], [t for _, t in rows]
    made = [pa.RecordBatch.from_arrays([pa.array([7] * len(rows)), pa.array(ids), pa.array(texts)], names=["g", "id", "text"])]
    monkeypatch.setattr(near_dedup, "word_hashes", None)
    found = {(a, b) for out in near_dedup._verified(80)(iter(made)) for a, b in zip(*(c.to_pylist() for c in out.columns), strict=True)}
    assert found == {(4, 13), (6, 14)}


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_chunks_meet_across_batches(size):
    """Runs that batches cut, against all rows at once."""
    r = random.Random(size)
    rows = sorted((r.randrange(30), r.randrange(1000), r.random() < 0.3) for _ in range(100))
    table = pa.Table.from_pydict({"key": [k for k, _, _ in rows], "id": [i for _, i, _ in rows], "met": [m for *_, m in rows]})
    often = {k for k in range(30) if sum(x[0] == k for x in rows) > 1}
    got = pa.Table.from_batches(near_dedup._again(iter(table.to_batches(max_chunksize=size)))).to_pylist()
    assert sorted((x["key"], x["id"]) for x in got) == sorted((k, i) for k, i, m in rows if k in often and not m)
    stars = pa.Table.from_batches(near_dedup._stars(iter(table.select(["key", "id"]).to_batches(max_chunksize=size)))).to_pylist()
    least = {k: min(i for q, i, _ in rows if q == k) for k, _, _ in rows}
    assert {(x["a"], x["b"]) for x in stars} == {(i, least[k]) for k, i, _ in rows if i != least[k]}


@pytest.mark.parametrize("hot", [0, 1, 3])
def test_hot_values_change_no_component(spark, rows, hot, monkeypatch):
    """Chunks of a few rows with a low bound, against all pairs; the functions run here, so that the bound holds."""
    monkeypatch.setattr(near_dedup, "HOT", hot)
    some = [(i, t) for i, t in rows if i is not None and i >= 100]
    ids, texts = [i for i, _ in some], [t for _, t in some]
    sketch = next(near_dedup._sketch(35, 5)(iter([pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts)], names=["id", "text"])])))
    value = pa.Table.from_batches(near_dedup._met(iter([sketch.select(["id", "keys"])]), most=500)).to_pandas()
    sent = value[value.sent].sort_values(["key", "id"])
    again = pa.Table.from_batches(near_dedup._again(iter([pa.RecordBatch.from_pandas(sent[["key", "id", "met"]], preserve_index=False)]))).to_pandas()
    shared = value[value.met][["id", "key"]]._append(again).groupby("id").key.agg(list)
    batch = pa.RecordBatch.from_arrays([pa.array(shared.index.to_list()), pa.array(shared.to_list(), pa.list_(pa.int64()))], names=["id", "values"])
    table = pa.Table.from_batches(near_dedup._tables(iter(batch.slice(k, 4) for k in range(0, batch.num_rows, 4)), most=2000)).to_pandas()
    named = table[table.key.notna()].astype({"key": "int64", "a": "int64"}).sort_values(["key", "a"])
    across = pa.Table.from_batches(near_dedup._stars(iter([pa.RecordBatch.from_pandas(named[["key", "a"]], preserve_index=False)]))).to_pandas()
    edges = [(int(a), int(b)) for part in (table[table.key.isna()][["a", "b"]], across) for a, b in part.itertuples(index=False)]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    for i, _, c in brute(some, 80):
        assert find(i) == find(c)  # what a link joins is in one family


def test_a_hot_value_sends_one_row_a_chunk():
    n = 5000
    keys = pa.array([[77, 1000 + i] for i in range(n)], pa.list_(pa.int64()))
    batches = pa.RecordBatch.from_arrays([pa.array(range(n)), keys], names=["id", "keys"])
    out = pa.Table.from_batches(near_dedup._met(iter([batches.slice(i, 100) for i in range(0, n, 100)]), most=1000)).to_pylist()
    assert len(out) == 2 * n
    assert sum(x["sent"] for x in out if x["key"] == 77) == 10
    assert all(x["sent"] for x in out if x["key"] != 77)
    assert all(x["met"] == (x["key"] == 77) for x in out)
    rows = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([[1, 2]] * n, pa.list_(pa.int64()))], names=["id", "values"])
    out = pa.Table.from_batches(near_dedup._tables(iter([rows]), most=500)).to_pylist()
    assert sum(x["key"] is not None for x in out) == 10
    assert sum(x["key"] is None for x in out) == n - 10


def test_a_chain_is_one_component(spark):
    r = random.Random(2)
    words = prose(r, 400).split()
    rows = []
    for k in range(12):  # neighbours are alike, the ends are not
        rows.append((k, " ".join(words)))
        words[k * 30 : k * 30 + 4] = [f"c{k}{j}" for j in range(4)]
    got = {g.id: g.component_id for g in minhash_dedup(documents(spark, rows)).collect()}
    assert set(got.values()) == {0}
    assert 100 * len(brute_set(rows[0][1]) & brute_set(rows[-1][1])) < 80 * len(brute_set(rows[0][1]) | brute_set(rows[-1][1]))


def test_enough_collections_meet_the_bound():
    for s in (0.8, 0.85):
        m = enough_collections(s, 5)
        p = s**5
        assert (1 - p) ** m + m * p * (1 - p) ** (m - 1) < 2e-5


def test_components_by_contraction(spark):
    r = random.Random(4)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(330)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, x) for x in range(5001, 5200)] + [(None, 1), (7777, 7777)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {g.node: g.component for g in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_an_empty_table(spark):
    assert minhash_dedup(documents(spark, [])).collect() == []


def test_query_finds_the_links_of_the_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.op6_minhash_near_dedup(spark, sf_dir).collect()
    assert sorted(((g.doc_id, g.n_shingles, g.component_id) for g in got), key=repr) == brute(rows, 85)
    assert np.mean([g.kept for g in got]) > 0.5
