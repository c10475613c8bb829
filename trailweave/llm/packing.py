"""Best-fit packing by minimum bin slack.

Tokenised documents become pieces of at most `capacity` tokens. For each bin a
bitset subset-sum program over the lengths still available finds the fullest
feasible combination with the longest piece left, and removes it. The program
sees lengths and counts alone (at most `capacity` of them, however many
documents there are) and takes one combination as often as the counts allow,
which is what equal bins one after another would have done. Pieces then find
their place by their rank within their length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, stage

_PIECES = "id long, piece int, start long, length long, ids_crc32 long, rank long, pid int"


def byte_bpe(path: str) -> Callable[[str], bytes]:
    """text -> little-endian uint32 ids of the byte-level BPE in `path` (a tokenizers JSON file).

    The strings of special tokens are ordinary text. The same vocabulary as
    ranks, where it lies beside the file, gives the same ids several times
    faster.
    """
    try:
        import base64

        import public_tokenizers
        import tiktoken

        with open(re.sub(r"\.json$", ".tiktoken", path), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: np.array(fast.encode_ordinary(text), "<u4").tobytes()
    except (ImportError, OSError):
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        slow.encode_special_tokens = True
        return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_encoders: dict[str, Callable[[str], bytes]] = {}


def _cut(path: str, capacity: int, end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = byte_bpe(path)
        pid, last = TaskContext.get().partitionId(), np.uint32(end).astype("<u4").tobytes()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            rows: list[tuple] = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = _encoders[path](text or "") + last
                n = len(ids) // 4
                at, size = 0, n % capacity or capacity
                for piece in range(-(-n // capacity)):
                    rows.append((key, piece, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), int(seen[size]), pid))
                    seen[size] += 1
                    at, size = at + size, capacity
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "piece", "start", "length", "ids_crc32", "rank", "pid"])

    return run


def fullest(counts: np.ndarray, room: int) -> list[int]:
    """Lengths, each at most counts[length] times, whose sum is the largest that is no more than room.

    Bit s of `reach` says that some choice among the lengths seen so far sums
    to s; copies of a length are added one bit-shift at a time.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in np.flatnonzero(counts[1 : room + 1])[::-1] + 1:
        for _ in range(min(int(counts[length]), room // int(length))):
            new = (reach | reach << int(length)) & mask
            if new == reach:
                break
            steps.append((int(length), reach))
            reach = new
            if reach >> room:
                break
        if reach >> room:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> total & 1:
            chosen.append(length)
            total -= length
    return chosen


def minimum_bin_slack(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Combinations of lengths, each with the number of bins that hold it; counts[l] pieces have length l."""
    counts, plan = counts.copy(), []
    longest = capacity
    while longest > 0:
        if not counts[longest]:
            longest -= 1
            continue
        counts[longest] -= 1
        bin_ = [longest, *fullest(counts, capacity - longest)]
        counts[longest] += 1
        used = np.bincount(bin_, minlength=len(counts))
        times = int((counts[used > 0] // used[used > 0]).min())
        counts -= times * used
        plan.append((bin_, times))
    return plan


def _places(plan: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first rank of each run of pieces, the sequence of that piece, and their offset."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    given: dict[int, int] = {}
    sequence = 0
    for bin_, times in plan:
        at = 0
        for length in bin_:
            runs.setdefault(length, []).append((given.get(length, 0), sequence, at))
            given[length] = given.get(length, 0) + times
            at += length
        sequence += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in runs.items()}


def _place(places) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            order = np.argsort(length, kind="stable")
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                first, sequence, offset = places.value[int(length[own[0]])]
                k = np.searchsorted(first, rank[own], "right") - 1
                seq[own], off[own] = sequence[k] + rank[own] - first[k], offset[k]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(5)] + [pa.array(seq), pa.array(off)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end: int = 0) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its whole text and then `end`; null and empty
    texts are `end` alone. Only a document of more than `capacity` ids is cut:
    into pieces of `capacity`, of which the first may be shorter. ids_crc32 is
    that of the piece's ids as little-endian uint32. Repeated rows and null ids
    are packed as they come. Sequences are numbered from 0 and filled without
    gaps from offset 0. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = stage(base.mapInArrow(lean(_cut(tokenizer, capacity, end)), _PIECES), "pieces")
    per = pieces.groupBy("length", "pid").agg(F.count("*").alias("n"))
    before = per.select("length", "pid", (F.sum("n").over(Window.partitionBy("length").orderBy("pid")) - F.col("n")).alias("before"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most `capacity` rows
        counts[r.length] = r.n
    places = spark.sparkContext.broadcast(_places(minimum_bin_slack(counts, capacity)))
    ranked = pieces.join(before, ["length", "pid"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(lean(_place(places)), "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
