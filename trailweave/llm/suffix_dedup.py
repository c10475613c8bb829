"""Removal of repeated byte strings by hash-compared suffix sort.

A byte goes if some string of `length` bytes that covers it starts anywhere
else too. Exact reductions keep the sort small. Texts that are equal are one
text. Of the 64-byte grams in a window of `length` bytes the one with the least
hash is its anchor, equal windows have equal anchors, so only stretches of
windows whose anchor occurs twice are looked at. Stretches that are equal as a
whole (by a 128-bit cryptographic digest) are repeated as a whole. The rest,
the edges of repeated passages, is settled by suffix sorting (`suffix_sort`):
prefix polynomial hashes and binary search give the common extension of two
suffixes in a logarithmic number of steps, which is all the comparison that
mergesort needs, and the order found is borne out byte by byte. Anchors with
very many different stretches are sorted in parts; windows that parts have in
common are found by their cryptographic digests, in buckets of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, lean, mix, offsets, partitions, release, stage
from .suffix_sort import GRAM, PrefixHashes, digest, repeated

SLAB, LONGEST = 1 << 20, 2048


def _sliding(x: np.ndarray, width: int, best: np.ufunc, fill: int) -> np.ndarray:
    """best over x[i : i + width] for every i that has so many."""
    n = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, fill, x.dtype)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    ahead = best.accumulate(blocks, axis=1).reshape(-1)
    behind = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return best(behind[:n], ahead[width - 1 : width - 1 + n])


def stretches(texts: list[bytes], length: int) -> tuple[dict[str, np.ndarray], list[bytes]]:
    """Stretches of windows with one anchor: text, first and last window start, anchor, and 2 where the anchor occurs again nearby, else 1; and the digests of their bytes."""
    span = length - GRAM + 1
    slabs = [(i, lo, t[lo : lo + SLAB + length - 1]) for i, t in enumerate(texts) for lo in range(0, len(t) - length + 1, SLAB)]
    out: dict[str, list[np.ndarray]] = {k: [np.zeros(0, np.int64)] for k in ("text", "s0", "s1", "m", "again")}
    digests: list[bytes] = []
    group: list[tuple[int, int, bytes]] = []
    for k, slab in enumerate(slabs):
        group.append(slab)
        if k < len(slabs) - 1 and sum(len(b) for _, _, b in group) < SLAB:
            continue
        raw = b"".join(b for _, _, b in group)
        buffer = np.frombuffer(raw, np.uint8)
        starts = offsets(len(b) for _, _, b in group)
        owner = np.repeat(np.arange(len(group)), np.diff(starts))
        h = PrefixHashes(buffer)
        gram = mix(h.of(np.arange(len(buffer) - GRAM + 1), GRAM))
        least = _sliding(gram, span, np.minimum, 2**64 - 1)
        whole = owner[: len(least)] == owner[length - 1 :]
        # A gram is an anchor where the largest minimum of the windows around it is its own hash.
        inside = np.where(whole, least, 0)
        around = _sliding(np.concatenate((np.zeros(span - 1, np.uint64), inside, np.zeros(span - 1, np.uint64))), span, np.maximum, 0)
        at = np.flatnonzero((around == gram) & (gram > 0))
        values, count = np.unique(np.stack([owner[at].astype(np.uint64), gram[at]], 1), axis=0, return_counts=True)
        twice = np.unique(values[count > 1, 1])
        new = np.concatenate(([True], (least[1:] != least[:-1]) | (owner[1 : len(least)] != owner[: len(least) - 1]) | (whole[1:] != whole[:-1])))
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(least)))
        first, size = first[whole[first]], size[whole[first]]
        parts = -(-size // LONGEST)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        s0 = np.repeat(first, parts) + step * LONGEST
        s1 = np.minimum(s0 + LONGEST, np.repeat(first + size, parts)) - 1
        own = owner[s0]
        shift = np.array([lo for _, lo, _ in group]) - starts[:-1]
        k2 = np.minimum(np.searchsorted(twice, least[s0]), max(len(twice) - 1, 0))
        out["text"].append(np.array([i for i, _, _ in group])[own])
        out["s0"].append(s0 + shift[own])
        out["s1"].append(s1 + shift[own])
        out["m"].append(least[s0].view(np.int64))
        digests += [digest(raw[a:e]) for a, e in zip(s0.tolist(), (s1 + length).tolist(), strict=True)]
        out["again"].append(1 + (twice[k2] == least[s0]) if len(twice) else np.ones(len(s0), np.int64))
        group = []
    return {k: np.concatenate(v) for k, v in out.items()}, digests


def _anchor(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                got, digests = stretches([t.encode("utf-8", "surrogatepass") for t in part.column(2).to_pylist()], length)
                who = pa.array(got.pop("text"))
                yield pa.RecordBatch.from_arrays([part.column(0).take(who), part.column(1).take(who), *map(pa.array, got.values()), pa.array(digests, pa.binary())], names=["k", "k2", *got, "d"])

    return run


def _fetch(length: int) -> Callable:
    """The bytes of the stretches asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                rows = []
                for text, wanted in zip(*(c.slice(lo, 500).to_pylist() for c in b.columns), strict=True):
                    raw = text.encode("utf-8", "surrogatepass")
                    rows += [(w["g"], w["m"], w["d"], w["parts"], raw[w["s0"] : w["s1"] + length]) for w in wanted]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()), strict=True)], names=["g", "m", "d", "parts", "bytes"])

    return run


_MARKS = "m long, d binary, r0 int, r1 int, bucket int, pm array<long>, pd array<binary>, po array<int>, ph array<long>, pk array<long>"


def _sort_parts(length: int, buckets: int, most: int = 1 << 20) -> Callable:
    """Sorts whole parts, several small ones together; gives the ranges of repeated windows, and the digests of those that are to be held against other parts."""

    def solve(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        m, parts = np.array([h[1] for h in held], np.int64), np.array([h[3] for h in held])
        group = mix(np.array([h[0] for h in held], np.int64).view(np.uint64)) ^ m.view(np.uint64)
        seg, first, last, who, start, bytes_ = repeated([h[4] for h in held], m.view(np.uint64), group, parts > 1, length)
        d = pa.array([h[2] for h in held], pa.binary())
        keys = np.frombuffer(b"".join(bytes_), np.int64).reshape(-1, 2)
        bucket = (mix(keys[:, 0].view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0))) if len(order) else np.zeros(0, np.int64)
        ends, none = pa.array(np.append(cut, len(order)), pa.int32()), len(seg)
        lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(m[who[order]]), d.take(pa.array(who[order])), pa.array(start[order], pa.int32()), pa.array(keys[order, 0]), pa.array(keys[order, 1]))]
        heads = [pa.array(m[seg]), d.take(pa.array(seg)), pa.array(first, pa.int32()), pa.array(last, pa.int32())]
        columns = [pa.concat_arrays([x, pa.nulls(len(cut), x.type)]) for x in heads] + [pa.array([None] * none + bucket[order][cut].tolist(), pa.int32())] + [pa.concat_arrays([pa.nulls(none, x.type), x]) for x in lists]
        yield pa.RecordBatch.from_arrays(columns, names=["m", "d", "r0", "r1", "bucket", "pm", "pd", "po", "ph", "pk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, group = 0, None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[0] != group and size >= most:
                    yield from solve(held)
                    held, size = [], 0
                group = row[0]
                held.append(row)
                size += len(row[4])
        if held:
            yield from solve(held)

    return run


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket, the windows whose digest two places have."""

    def found(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        m, o, h, k = (np.concatenate([r.column(i).flatten().to_numpy() for r in rows]) for i in (1, 3, 4, 5))
        d = pa.concat_arrays([r.column(2).flatten() for r in rows])
        order = np.lexsort((k, h))
        same = (h[order][1:] == h[order][:-1]) & (k[order][1:] == k[order][:-1])
        hit = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        return pa.RecordBatch.from_arrays([pa.array(m[hit]), d.take(pa.array(hit)), pa.array(o[hit], pa.int32()), pa.array(o[hit], pa.int32())], names=["m", "d", "r0", "r1"])

    held: list[pa.RecordBatch] = []
    bucket = None
    for b in batches:
        own = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo < hi:
                if held and own[lo] != bucket:
                    yield found(held)
                    held = []
                bucket = own[lo]
                held.append(b.slice(lo, hi - lo))
    if held:
        yield found(held)


def _cut(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for sha, text, copies, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                if copies > 1 and len(raw) >= length:
                    merged = [[0, len(raw)]]
                else:
                    merged: list[list[int]] = []
                    for a, e in sorted((s["a"], s["e"]) for s in spans or ()):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(e, merged[-1][1])
                        else:
                            merged.append([a, e])
                rest, at = [], 0
                for a, e in merged:
                    rest.append(raw[at:a])
                    at = e
                rest.append(raw[at:])
                rows.append((sha, len(raw), sum(e - a for a, e in merged), len(merged), hashlib.sha256(b"".join(rest)).hexdigest(), [x for ae in merged for x in ae]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())), strict=True)], names=["sha", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, part: int = 1 << 18, bucket: int = 1 << 20) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    Texts are UTF-8 bytes, null counts as empty. Each byte is removed that a
    string of `length` bytes covers which starts anywhere else as well, in the
    same row or another; strings overlap and are judged on the input, and none
    crosses rows. spans: first byte and end of each maximal removed run, flat.
    kept_sha256: of the remaining bytes. Rows that repeat an id, or have none,
    count like any other, since ids play no part. An empty table gives an empty
    result.

    part: how many bytes of stretches of one anchor are sorted together, about;
    bucket: how many windows of an anchor with more are held against each other.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    rows = stage(base.select("id", "sha"), "rows")
    distinct = base.groupBy(F.xxhash64("sha").alias("k"), F.hash("sha").alias("k2"), "sha").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    texts = bucketed(distinct.repartition(n, "k"), n, "k")

    found = stage(texts.where(F.octet_length("text") >= length).select("k", "k2", "text").mapInArrow(lean(_anchor(length)), "k long, k2 int, s0 long, s1 long, m long, again long, d binary"), "stretches")
    twice = stage(found.groupBy("m").agg(F.sum("again").alias("n")).where("n > 1").select("m"), "anchors")
    known = stage(found.join(twice, "m"), "repeated-anchors")
    release(found, twice)
    kinds = stage(known.groupBy("m", "d").agg(F.count("*").alias("n"), F.max("again").alias("again"), F.min(F.struct("k", "k2", "s0", "s1")).alias("at")), "kinds")
    per = kinds.groupBy("m").agg(F.count("*").alias("kinds"), F.max("again").alias("any"), F.sum(F.col("at.s1") - F.col("at.s0") + length).alias("bytes")).where("kinds > 1 or any > 1")
    per = stage(per.select("m", "bytes", F.ceil(F.col("bytes") / part).cast("int").alias("parts")), "open-anchors")
    windows = per.where("parts > 1").agg(F.sum("bytes")).first()[0] or 0  # of anchors that are sorted in parts: more than their windows
    asked = kinds.join(per, "m").select("at.*", F.struct(F.xxhash64("m", F.pmod(F.hash("d"), "parts")).alias("g"), "m", "d", "parts", "at.s0", "at.s1").alias("w"))
    asked = stage(asked.groupBy("k", "k2").agg(F.collect_list("w").alias("wanted")), "asked")  # of one text, so no longer than that
    here = lambda other: (F.col("t.k") == F.col(f"{other}.k")) & (F.col("t.k2") - F.col(f"{other}.k2") == 0)
    pieces = texts.alias("t").join(asked.alias("a"), here("a")).select("text", "wanted").mapInArrow(lean(_fetch(length)), "g long, m long, d binary, parts int, bytes binary")
    marks = stage(pieces.repartition(n, "g").sortWithinPartitions("g", "m").mapInArrow(lean(_sort_parts(length, max(n, -(-windows // bucket)))), _MARKS), "marks")
    open_ = marks.where("bucket is not null").select("bucket", "pm", "pd", "po", "ph", "pk")
    across = open_.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_across), "m long, d binary, r0 int, r1 int")
    inside = stage(marks.where("bucket is null").select("m", "d", "r0", "r1").union(across), "inside")
    release(asked, per, marks)

    whole = known.join(kinds.where("n > 1").select("m", "d"), ["m", "d"]).select("k", "k2", F.col("s0").alias("a"), (F.col("s1") + length).alias("e"))
    single = kinds.where("n = 1").select("m", "d", "at.*").join(inside, ["m", "d"]).select("k", "k2", (F.col("s0") + F.col("r0")).alias("a"), (F.col("s0") + F.col("r1") + length).alias("e"))
    spans = stage(whole.union(single).groupBy("k", "k2").agg(F.collect_list(F.struct("a", "e")).alias("spans")), "spans")
    release(known, kinds, inside)
    cut = texts.alias("t").join(spans.alias("s"), here("s"), "left").select("sha", "text", "copies", "spans")
    result = stage(cut.mapInArrow(lean(_cut(length)), "sha string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"), "cut")
    release(texts, spans)
    return rows.join(result, "sha").drop("sha")
