"""Exact dedup by content sort.

Sampled splitters range-partition the normalised bytes, the external sort of
each partition places equals adjacent, and neighbours are compared in full.
Sort order is (64-byte prefix, digest, id), so splitters stay small whatever
the texts' length, and a text with any number of copies spreads over as many
partitions as its share asks for. A run that crosses a border is closed from
two rows per partition.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, partitions, stage

_OUT = "id long, sha string, size long, keep long, kept boolean, edge int, pid int, border string"
_FIRST, _LAST = 1, 2


def _scan(largest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def closed(ids: pa.Array, shas: list[str], sizes: np.ndarray, edges: np.ndarray, texts: list[str | None], pid: int) -> pa.RecordBatch:
        """The rows of whole runs: ids in order, and a digest, size, edge mark and border text for each run."""
        ends = np.cumsum(sizes)
        nulls = np.concatenate(([0], np.cumsum(ids.is_null().to_numpy(zero_copy_only=False))))
        none = nulls[ends] - nulls[ends - sizes]
        at = np.where((none == sizes) | largest, ends - 1, ends - sizes + np.minimum(none, sizes - 1))
        row = np.repeat(np.arange(len(sizes)), sizes)
        stays = np.zeros(len(ids), bool)
        stays[at] = True
        border = [None] * len(ids)
        for r in np.flatnonzero(edges):
            border[ends[r] - sizes[r]] = texts[r]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(shas, pa.string()).take(row), pa.array(sizes[row]), ids.take(at).take(row), pa.array(stays), pa.array(edges[row], pa.int32()), pa.array(np.full(len(ids), pid, np.int32)), pa.array(border, pa.string())],
            names=["id", "sha", "size", "keep", "kept", "edge", "pid", "border"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, text, sha, held, first = TaskContext.get().partitionId(), None, None, [], True
        for b in batches:
            if not (n := b.num_rows):
                continue
            ids, texts, shas = b.column(0), b.column(1), b.column(2)
            new = np.ones(n, bool)
            new[0] = texts[0].as_py() != text
            new[1:] = pc.not_equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            if not len(starts := np.flatnonzero(new)):
                held.append(ids)
                continue
            held.append(ids.slice(0, starts[0]))
            before = sum(map(len, held))
            tail = int(starts[-1])
            sizes = np.concatenate(([before] if before else [], np.diff(starts))).astype(np.int64)
            if len(sizes):
                edges = np.zeros(len(sizes), np.int32)
                edges[0] = _FIRST * first
                known = ([sha] if before else []) + shas.take(pa.array(starts[:-1])).to_pylist()
                lead = text if before else texts[int(starts[0])].as_py()
                yield closed(pa.concat_arrays([*held, ids.slice(starts[0], tail - starts[0])]), known, sizes, edges, [lead] + [None] * (len(sizes) - 1), pid)
                first = False
            held, text, sha = [ids.slice(tail)], texts[tail].as_py(), shas[tail].as_py()
        if held:
            whole = pa.concat_arrays(held)
            yield closed(whole, [sha], np.array([len(whole)]), np.array([_LAST | _FIRST * first], np.int32), [text], pid)

    return run


def content_sort_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per row of docs: id, sha (of the normalised text), size, keep, kept.

    docs: any table with an integer id and a text; other columns are ignored.
    normalise: a Column function from text to the text that is compared; none
    compares the texts as they are. keep: "min" (the smallest identifier stays)
    or "max". A null text counts as empty. A null id belongs to its group and
    to its size but stays only where the group has no other id; keep is null
    then. Rows repeated with one id count each, and exactly one row of a group
    has kept = true. An empty table gives an empty result. Equal texts are
    found by comparing neighbours in full, digests only order them.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("id"), (normalise(text) if normalise else text).alias("text"))
    keyed = base.select("id", "text", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.substring("text", 1, 64).alias("head"))
    order = ["head", "sha", "id"]
    dealt = keyed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    runs = stage(dealt.select("id", "text", "sha").mapInArrow(lean(_scan(keep == "max")), _OUT), "content-runs")

    ends = sorted(runs.where("border is not null").select("pid", "edge", "sha", "size", "keep").collect())  # at most two rows a partition
    near = [(a.pid, b.pid) for a, b in itertools.pairwise(ends) if a.pid != b.pid and a.sha == b.sha]
    fixes: list[tuple[int, int, int, int | None, bool]] = []
    if near:
        text_of = runs.where("border is not null").select("pid", "edge", "border")
        a = text_of.where(F.col("edge").bitwiseAND(_LAST) > 0).select(F.col("pid").alias("p"), F.col("border").alias("a"))
        b = text_of.where(F.col("edge").bitwiseAND(_FIRST) > 0).select(F.col("pid").alias("q"), F.col("border").alias("b"))
        joined = {(r.p, r.q) for r in spark.createDataFrame(near, "p int, q int").join(a, "p").join(b, "q").where("a = b").select("p", "q").collect()}
        chains = [[ends[0]]]
        for x, y in itertools.pairwise(ends):
            chains[-1:] = [chains[-1] + [y]] if (x.pid, y.pid) in joined else [chains[-1], [y]]
        for chain in (c for c in chains if len(c) > 1):
            known = [r for r in chain if r.keep is not None]
            best = (known[-1] if keep == "max" else known[0]) if known else chain[-1]
            fixes += [(r.pid, r.edge, sum(x.size for x in chain), best.keep, r is best) for r in chain]
    if fixes:  # at most two rows a partition, so a broadcast has a bound
        fix = F.broadcast(spark.createDataFrame(fixes, "pid int, edge int, size2 long, keep2 long, wins boolean"))
        runs = runs.join(fix, ["pid", "edge"], "left").withColumns({"kept": F.col("kept") & F.coalesce("wins", F.lit(True)), "keep": F.when(F.col("wins").isNull(), F.col("keep")).otherwise(F.col("keep2")), "size": F.coalesce("size2", "size")})
    return runs.select("id", "sha", "size", "keep", "kept")


def _leaders(text_at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows of a sorted partition whose text differs from that of the row before; the last two columns say which partition, and which of them are its first and last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, text, held, first = TaskContext.get().partitionId(), None, None, True

        def marked(rows: pa.RecordBatch, last: bool) -> pa.RecordBatch:
            edge = np.zeros(rows.num_rows, np.int32)
            edge[0] |= _FIRST * first
            edge[-1] |= _LAST * last
            n = rows.num_columns
            return rows.set_column(n - 2, rows.schema.field(n - 2), pa.array(np.full(len(edge), pid, np.int32))).set_column(n - 1, rows.schema.field(n - 1), pa.array(edge))

        for b in (whole.slice(lo, 500) for whole in batches for lo in range(0, whole.num_rows, 500)):
            texts = pc.fill_null(b.column(text_at), "")
            new = np.ones(b.num_rows, bool)
            new[0] = texts[0].as_py() != text
            new[1:] = pc.not_equal(texts.slice(1), texts.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
            text = texts[b.num_rows - 1].as_py()
            if new.any():
                if held is not None:
                    yield marked(held, False)
                    first = False
                held = b.filter(pa.array(new))
        if held is not None:
            yield marked(held, True)

    return run


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each text, that of the smallest id; all columns kept.

    Rows are sorted whole, so texts move once. A null text counts as empty; a
    row with a null id stays only where its text has no other, and rows that
    repeat id and text count once. An empty table gives an empty result.
    """
    spark, tag = docs.sparkSession, f"_{uuid.uuid4().hex}"
    head, sha, pid, edge = (f"{k}{tag}" for k in ("head", "sha", "pid", "edge"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.lit(0).cast("int")
    keyed = docs.withColumns({head: F.substring(text, 1, 64), sha: F.sha2(text.cast("binary"), 256), pid: none, edge: none})
    order = [F.col(head), F.col(sha), F.col(id_col).asc_nulls_last()]
    dealt = keyed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).drop(head)
    rows = stage(dealt.mapInArrow(lean(_leaders(docs.columns.index(text_col))), dealt.schema), "leaders")

    ends = sorted(rows.where(F.col(edge) > 0).select(pid, edge, sha).collect())  # at most two rows a partition
    near = [(a[0], b[0]) for a, b in itertools.pairwise(ends) if a[0] != b[0] and a[2] == b[2]]
    if near:
        side = lambda which, p, t: rows.where(F.col(edge).bitwiseAND(which) > 0).select(F.col(pid).alias(p), text.alias(t))
        again = spark.createDataFrame(near, "p int, q int").join(side(_LAST, "p", "a"), "p").join(side(_FIRST, "q", "b"), "q").where("a = b").select(F.col("q"))
        rows = rows.join(F.broadcast(again), (F.col(pid) == F.col("q")) & (F.col(edge).bitwiseAND(_FIRST) > 0), "left_anti")
    return rows.select(docs.columns)
