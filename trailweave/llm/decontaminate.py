"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters may differ in e = floor(rate * n) of them. It is split
into e + 1 pieces, of which a match within the budget leaves at least one
untouched, so exact hits of pieces (one automaton over the pieces of all items)
find every candidate. The pieces are the leaves of a tree in which a node with
budget k has children whose budgets add up to k - 1; a hit is checked with
Myers' bit-parallel distance at its leaf's parent first and climbs only while
each node stays within its budget, which the same pigeonhole argument allows.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator
from itertools import chain
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, stage


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


class _Node:
    __slots__ = ("lo", "hi", "budget", "parent", "masks", "item")

    def __init__(self, lo: int, hi: int, budget: int, parent: _Node | None, item: int):
        self.lo, self.hi, self.budget, self.parent, self.item = lo, hi, budget, parent, item
        self.masks: dict[str, int] = {}


def _grow(text: str, lo: int, hi: int, budget: int, parent: _Node | None, item: int, leaves: list[_Node]) -> None:
    node = _Node(lo, hi, budget, parent, item)
    if budget == 0:  # a leaf is looked up, no distance to it is worked out
        leaves.append(node)
        return
    for i, c in enumerate(text[lo:hi]):
        node.masks[c] = node.masks.get(c, 0) | 1 << i
    left = (budget - 1) // 2
    mid = lo + (hi - lo) * (left + 1) // (budget + 1)
    _grow(text, lo, mid, left, node, item, leaves)
    _grow(text, mid, hi, budget - 1 - left, node, item, leaves)


def myers(masks: dict[str, int], m: int, text: str) -> int:
    """The least edit distance of the pattern of m characters to any substring of text."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            best = min(best, score)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
    return best


class PieceIndex:
    """The pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = items
        self.automaton = ahocorasick.Automaton()
        leaves: list[_Node] = []
        for k, (_, text) in enumerate(items):
            if text:
                _grow(text, 0, len(text), min(int(rate * len(text)), len(text) - 1), None, k, leaves)
        pieces: dict[str, list[_Node]] = {}
        for leaf in leaves:
            pieces.setdefault(items[leaf.item][1][leaf.lo : leaf.hi], []).append(leaf)
        for piece, nodes in pieces.items():
            self.automaton.add_word(piece, (len(piece), nodes))
        self.empty = not pieces
        self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, int]:
        """The items found in a normalised text, each with its least distance."""
        found: dict[int, int] = {}
        tried: dict[tuple[int, int], int] = {}
        if self.empty:
            return found
        for end, (width, nodes) in self.automaton.iter(text):
            start = end + 1 - width
            for leaf in nodes:
                if found.get(leaf.item) == 0:
                    continue
                node, at, distance = leaf, start - leaf.lo, 0
                while (up := node.parent) is not None:
                    slack = up.budget
                    lo, hi = max(0, at + up.lo - slack), at + up.hi + slack
                    if (key := (id(up), at)) not in tried:
                        tried[key] = myers(up.masks, up.hi - up.lo, text[lo:hi])
                    distance = tried[key]
                    if distance > up.budget:
                        break
                    node = up
                else:
                    found[leaf.item] = min(distance, found.get(leaf.item, distance))
        return {self.items[k][0]: d for k, d in found.items()}


_indexes: dict[str, PieceIndex] = {}


def _blocks(items: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for r in items.select(id_col, text_col).where(F.col(id_col).isNotNull()).toLocalIterator():
        text = normal(r[1])
        if block and size + len(text) > most:
            yield block
            block, size = [], 0
        block.append((r[0], text))
        size += len(text)
    if block:
        yield block


def match_items(docs: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", text_col: str = "text", rate: float = 0.1, block_chars: int = 1_000_000) -> DataFrame:
    """docs with a column `hits`: an array of (item, distance), sorted by item.

    Texts are compared in lower case with white space collapsed. An item is
    found where some stretch of the text is within floor(rate * length) edits
    of it; an item too short for one edit must occur exactly, an empty or null
    one is never found, nor is anything in a null or empty text. All columns of
    docs stay, as do repeated rows; a column `hits` of docs is replaced. An
    empty table gives an empty result, without items every array is empty.

    Items are sent to the executors in blocks of at most `block_chars`
    characters, of which a worker holds one at a time, about 200 bytes a
    character. One block is a narrow pass over docs. For more, docs are written
    once with numbered rows; each block is a pass over the texts that writes
    its hits alone, and the hits are joined to the rows in the end.
    """
    spark = docs.sparkSession
    kind = "array<struct<item:long,distance:int>>"
    blocks = _blocks(items, item_id, item_text, block_chars)
    block, following = next(blocks, None), next(blocks, None)
    if following is None:
        out = docs.withColumn("hits", F.array().cast(kind))
        return out if block is None else out.mapInArrow(lean(_matched(spark.sparkContext.broadcast(block), rate, out.columns.index(text_col), out.columns.index("hits"))), out.schema)
    row = f"row_{uuid.uuid4().hex}"
    base = stage(docs.drop("hits").withColumn(row, F.monotonically_increasing_id()), "numbered")
    narrow = base.select(row, text_col, F.array().cast(kind).alias("hits"))
    found = []
    for some in chain((block, following), blocks):
        made = narrow.mapInArrow(lean(_matched(spark.sparkContext.broadcast(some), rate, 1, 2)), narrow.schema).where(F.size("hits") > 0)
        found.append(stage(made.select(row, "hits"), "hits"))
    hits = functools.reduce(DataFrame.union, found).groupBy(row).agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))  # of one row, so no more than there are items
    return base.join(hits, row, "left").withColumn("hits", F.coalesce("hits", F.array().cast(kind))).select(*docs.withColumn("hits", F.lit(0)).columns)


def _matched(sent: Any, rate: float, text_at: int, hits_at: int) -> Callable:
    """Fills the column of hits from the items of a block."""
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _indexes:  # one index is kept by each worker
            _indexes.clear()
            _indexes[key] = PieceIndex(sent.value, rate)
        index = _indexes[key]
        for b in batches:
            hits = [[{"item": k, "distance": d} for k, d in sorted(index.find(normal(t)).items())] for t in b.column(text_at).to_pylist()]
            yield b.set_column(hits_at, "hits", pa.array(hits, b.column(hits_at).type))

    return run


def decontaminate(docs: DataFrame, items: DataFrame, **options: Any) -> DataFrame:
    """docs without those in which an item is found; every column kept."""
    return match_items(docs, items, **options).where(F.size("hits") == 0).drop("hits")
