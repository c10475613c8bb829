"""MinHash near-dedup with tensored banding and verification on full sets.

`collections` small collections of `width` minhashes are computed per document;
a table key is a pair of them, so m collections give m(m-1)/2 tables of
2 * width minhashes each while only m * width are computed. Two documents meet
in some table as soon as any two of their collections agree. A collection value
that no second document has can't, and is dropped before pairs are formed.
Documents with equal words stand in for each other. What shares table keys
directly or through others forms a block family; links inside it are verified
on the full shingle sets, word by word. Large families are verified in blocks
that share some centers, then, where that leaves several components, between
these. A value or table key that very many documents have is settled chunk by
chunk first, so that only one row of it is sent on.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE, constants, lean, mix, offsets, partitions, release, stage, word_hashes
from .components import connected_components

SHINGLE = 5
_PLACE = constants(SHINGLE, 47)
#: Of a value or table key that more documents of a chunk have, the chunk sends one on.
HOT = 64
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_BLANK = re.compile(rb"[ \t-\r]")


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased and split at ASCII white space, piece by piece."""
    raw, lo = (text or "").encode("utf-8", "surrogatepass"), 0
    while lo < len(raw):
        cut = _BLANK.search(raw, lo + PIECE) if len(raw) > lo + PIECE else None
        hi = cut.start() if cut else len(raw)
        yield raw[lo:hi].lower().split()
        lo = hi


def shingle_sets(texts: list[str | None]) -> tuple[list[np.ndarray], list[bytes]]:
    """Sorted distinct 64-bit hashes of each text's shingles (fewer words than SHINGLE give one shingle, none an empty set), and a cryptographic digest of its words."""
    if not texts:
        return [], []
    digests = []
    for text in texts:
        sha = hashlib.sha256()
        for part in words_of(text):
            sha.update(b" ".join([*part, b""]))
        digests.append(sha.digest()[:16])
    words, owner = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts], _SPACE)
    n = np.bincount(owner, minlength=len(texts))
    total = np.full(max(len(words) - SHINGLE + 1, 0), SHINGLE, np.uint64)
    for j in range(SHINGLE):
        total += words[j : j + len(total)] * _PLACE[j]
    total = mix(total)
    short = lambda w: mix((w * _PLACE[: len(w)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(w)))
    return [np.unique(total[e - k : e - SHINGLE + 1]) if k >= SHINGLE else short(words[e - k : e]) if k else np.zeros(0, np.uint64) for e, k in zip(np.cumsum(n), n, strict=True)], digests


def _sketch(collections: int, width: int):
    flips, odds, place = mix(constants(collections * width, 53)), constants(collections * width, 59), constants(width, 61)

    def keys(sets: list[np.ndarray]) -> np.ndarray:
        """A value for each set and collection."""
        starts = offsets(map(len, sets))[:-1]
        whole = np.concatenate(sets)
        least = np.stack([np.minimum.reduceat((whole ^ x) * a, starts) for x, a in zip(flips, odds, strict=True)], 1).reshape(len(sets), collections, width)
        return mix((least * place).sum(2, dtype=np.uint64) + np.arange(collections, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                sets, digest = shingle_sets(part.column(1).to_pylist())
                some = [i for i, s in enumerate(sets) if len(s)]
                values = np.zeros((len(sets), collections), np.uint64)
                if some:
                    values[some] = keys([sets[i] for i in some])
                flat = pa.array(values.reshape(-1).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * collections, pa.int32()), flat)], names=["id", "n", "digest", "keys"])

    return run


def _chunks(columns: Iterator[tuple[np.ndarray, np.ndarray]], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Columns (key, id) in sorted chunks of about `most` rows; with the first row of each run of equal keys, and the runs' sizes."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for pair in chain(columns, [None]):
        if pair is not None:
            held.append(pair)
        if held and (pair is None or sum(len(k) for k, _ in held) >= most):
            key, who = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((who, key))
            key, who, held = key[order], who[order], []
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))[: len(key)])
            yield key, who, start, np.diff(np.append(start, len(key)))


def _met(batches: Iterator[pa.RecordBatch], most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The values of documents, chunk by chunk: `met` where more than HOT documents of the chunk have it, `sent` on all others, and on one row of each such value."""

    def columns() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in batches:
            keys = b.column(1)
            yield keys.flatten().to_numpy(), np.repeat(b.column(0).to_numpy(), np.diff(keys.offsets.to_numpy()))

    for key, who, start, size in _chunks(columns(), most):
        met = np.repeat(size > HOT, size)
        sent = ~met
        sent[start] = True
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(who), pa.array(met), pa.array(sent)], names=["key", "id", "met", "sent"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of batches sorted by the first, regrouped so that no run of equal values is cut; a run has HOT rows for each chunk at most."""
    held: list[np.ndarray] | None = None
    for b in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        cut = np.searchsorted(held[0], held[0][-1]) if len(held[0]) else 0
        if cut:
            yield [c[:cut] for c in held]
            held = [c[cut:] for c in held]
    if held is not None and len(held[0]):
        yield held


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, id, met) the rows whose key another chunk has, as far as their own chunk has not said so."""
    for key, who, met in _runs(batches):
        same = key[1:] == key[:-1]
        keep = (np.concatenate(([False], same)) | np.concatenate((same, [False]))) & ~met.astype(bool)
        yield pa.RecordBatch.from_arrays([pa.array(who[keep]), pa.array(key[keep])], names=["id", "key"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each table key, the smallest document of all chunks with that of each; once for a batch."""
    for key, who in _runs(batches):
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        least = np.repeat(who[start], np.diff(np.append(start, len(key))))
        pairs = np.unique(np.stack([who, least], 1)[who != least], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _tables(batches: Iterator[pa.RecordBatch], most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Table keys are pairs of a document's values. (key, a, null) sends a document on to meet others; of a key that more than HOT documents of a chunk have only the smallest is, and (null, a, b) links the rest to it."""
    left, right = constants(2, 67)

    def columns() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in batches:
            for who, values in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = np.sort(values.values.to_numpy()).view(np.uint64)
                i, j = np.triu_indices(len(v), 1)
                yield mix(v[i] * left + v[j] * right).view(np.int64), np.full(len(i), who)

    for key, who, start, size in _chunks(columns(), most):
        least = np.repeat(who[start], size)
        hot = np.repeat(size > HOT, size)
        pairs = np.unique(np.stack([who, least], 1)[hot & (who != least)], axis=0)
        sent = ~hot
        sent[start] = True
        none = lambda n: pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in ((none(len(pairs)), pa.array(key[sent])), (pa.array(pairs[:, 0]), pa.array(who[sent])), (pa.array(pairs[:, 1]), none(int(sent.sum()))))], names=["key", "a", "b"])


def _verified(percent: int):
    def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the distinct shingles of each text, and the text of each; equal numbers mean equal words."""
        numbers: dict[bytes, int] = {}
        short: dict[tuple[int, ...], int] = {}
        words, owner, short_owner = [], [], []
        for i, text in enumerate(texts):
            w = [numbers.setdefault(x, len(numbers)) for part in words_of(text) for x in part]
            if len(w) >= SHINGLE:
                words.append(np.array(w, np.int64))
                owner.append(np.full(len(w), i))
            elif w:
                short_owner.append((i, short.setdefault(tuple(w), len(short))))
        flat, own = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (words, owner))
        n = max(len(flat) - SHINGLE + 1, 0)
        at = np.flatnonzero(own[:n] == own[len(own) - n :])
        code = flat[at]
        for j in range(1, SHINGLE):  # pairs of numbers get numbers in turn, so that nothing rests on hashes
            code = np.unique(code * len(numbers) + flat[at + j], return_inverse=True)[1]
        both = np.concatenate([np.stack([own[at], code + len(short)], 1), np.array(short_owner, np.int64).reshape(-1, 2)])
        both = np.unique(both, axis=0)
        return both[:, 1], both[:, 0]

    def links(ids: list[int], texts: list[str | None]) -> list[tuple[int, int]]:
        """A spanning forest of all links among the documents of a group."""
        code, owner = shingles(texts)
        size = np.bincount(owner, minlength=len(ids))
        _, column, seen = np.unique(code, return_inverse=True, return_counts=True)
        often = np.flatnonzero(seen > 1)
        place = np.full(len(seen), -1)
        place[often] = np.arange(len(often))
        column = place[column]
        owner, column = owner[column >= 0], column[column >= 0]
        common = np.zeros((len(ids), len(ids)), np.float32)
        wide = max(1, (1 << 23) // len(ids))
        for lo in range(0, len(often), wide):
            m = np.zeros((len(ids), min(wide, len(often) - lo)), np.float32)
            here = (column >= lo) & (column < lo + wide)
            m[owner[here], column[here] - lo] = 1
            common += m @ m.T
        inter = common.astype(np.int64)
        root = list(range(len(ids)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for i, j in zip(*np.nonzero(np.triu(100 * inter >= percent * (size[:, None] + size - inter), 1) & (inter > 0)), strict=True):
            a, b = find(int(i)), find(int(j))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((ids[i], ids[j]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        texts: list[str | None] = []
        group = None
        done: list[tuple[int, int]] = []

        def batch() -> pa.RecordBatch:
            a, b = zip(*done, strict=True) if done else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for part in batches:
            for g, i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                if g != group and ids:
                    done += links(ids, texts) if len(ids) > 1 else []
                    ids, texts = [], []
                group = g
                ids.append(i)
                texts.append(t)
            yield batch()
            done = []
        if len(ids) > 1:
            done += links(ids, texts)
        yield batch()

    return run


def enough_collections(similarity: float, width: int, missed: float = 2e-5) -> int:
    """The least number of collections that misses a pair of that similarity with a probability under `missed`."""
    p = similarity**width
    return next(m for m in range(2, 1 << 16) if (1 - p) ** m + m * p * (1 - p) ** (m - 1) < missed)


def _salted(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner", salts: int = 32) -> DataFrame:
    """A join with some rows by family: the members of a large family are dealt over `salts` tasks."""
    spread = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.hash("node"), F.lit(salts))).join(spread, [*keys, "salt"], how).drop("salt")


def _split_families(families: DataFrame, sizes: DataFrame, block: int, weight: int) -> tuple[DataFrame, DataFrame]:
    """(id, g): the groups in which links are looked for first; (node, component): the members of families that need more than one.

    A group is a block of a family and the family's centers: its smallest
    member and four of least hash, which most others resemble.
    """
    sized = families.join(sizes, "node")
    total = stage(sized.groupBy("component").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles")), "family-sizes")
    small = (F.col("docs") <= 2 * block) & (F.col("shingles") <= 2 * weight)
    blocks = F.when(small, 1).otherwise(F.greatest(F.ceil(F.col("docs") / block), F.ceil(F.col("shingles") / weight), F.lit(2)))
    split = total.select("component", blocks.cast("int").alias("blocks")).where("blocks > 1")
    dealt = _salted(families, split, ["component"], "left").select("node", "component", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    large = dealt.where("blocks > 1")
    least = large.groupBy("component", "blocks", F.pmod(F.hash("node"), F.lit(4))).agg(F.min(F.struct(F.xxhash64("node"), "node"))["node"].alias("node")).select("node", "component", "blocks")
    centers = least.union(large.where("node = component").select("node", "component", "blocks"))
    group = F.xxhash64("component", "b").alias("g")
    own = dealt.select(F.col("node").alias("id"), "component", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("b"))
    everywhere = centers.select(F.col("node").alias("id"), "component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    return own.union(everywhere).distinct().select("id", group), large.select("node", "component")


def _split_rest(open_: DataFrame, block: int, weight: int) -> DataFrame:
    """(id, g) such that every two members of a family (node, component, part, n) that are in different parts meet in some group.

    Large parts are units of their own, small ones share units; two units meet
    block by block. Blocks of one large part don't meet, they are linked.
    """
    parts = stage(open_.groupBy("component", "part").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles")), "parts")
    big = (F.col("docs") >= block) | (F.col("shingles") >= weight)
    pieces = lambda: F.greatest(F.ceil(F.col("docs") / block), F.ceil(F.col("shingles") / weight)).cast("int")
    mixed = parts.where(~big).groupBy("component").agg(F.sum("docs").alias("docs"), F.sum("shingles").alias("shingles")).select("component", pieces().alias("mixed"))
    unit = F.when(big, F.struct(F.lit(True).alias("big"), F.col("part").alias("u"))).otherwise(F.struct(F.lit(False).alias("big"), F.pmod(F.xxhash64("part"), F.col("mixed")).alias("u")))
    dealt = stage(parts.join(mixed, "component", "left").select("component", "part", unit.alias("unit"), F.when(big, pieces()).otherwise(1).alias("pieces")), "units")
    units = stage(dealt.select("component", "unit", "pieces").distinct(), "distinct-units")
    a, b = units.toDF("component", "ua", "na"), units.toDF("component", "ub", "nb")
    pairs = a.join(b, "component").where("ua < ub or (ua = ub and not ua.big)")
    pairs = stage(pairs, "unit-pairs")
    one = open_.join(dealt.where("not unit.big"), ["component", "part"])
    node = one.unionByName(_salted(open_, dealt.where("unit.big"), ["component", "part"])).select("component", "node", "unit", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int").alias("p"))

    def side(own: str, others: str, p: str, q: str) -> DataFrame:
        met = _salted(node, pairs.withColumnRenamed(own, "unit"), ["component", "unit"])
        ua, ub = ("unit", "ub") if own == "ua" else ("ua", "unit")
        return met.withColumn("o", F.explode(F.sequence(F.lit(0), F.col(others) - 1))).select(F.col("node").alias("id"), F.xxhash64("component", ua, ub, p, q).alias("g"))

    return side("ua", "nb", "p", "o").union(side("ub", "na", "o", "p")).distinct()


def minhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, collections: int | None = None, width: int = 5, block: int = 128, weight: int = 400_000) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept.

    Documents are linked whose sets of distinct five-word shingles (A-Z
    lower-cased, words split at ASCII white space; a shorter text is one
    shingle) have a Jaccard similarity of at least percent / 100. component_id
    is the smallest id reachable, kept says that it is the row's own. Null,
    empty and blank texts have no shingles and link with nothing. Rows with one
    id count as one document; a row with a null id links with nothing, has a
    null component and is kept. An empty table gives an empty result.

    At the least similarity s a linked pair is missed with probability
    (1-p)^m + m p (1-p)^(m-1), p = s^width, m = collections, and far less often
    if it is more similar; by default m is the least for which that is under
    2e-5 (24 for s = 0.85, 35 for s = 0.8). A family of more than 2 * block
    documents or 2 * weight shingles is first verified in blocks, each with the
    family's centers. Where that leaves several components, documents of
    different ones are verified in pairs of blocks. So no group in a task
    outgrows two blocks, and no documents stay apart that a link joins.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    collections = collections or enough_collections(percent / 100, width)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketch = stage(base.mapInArrow(lean(_sketch(collections, width)), "id long, n long, digest binary, keys array<long>"), "sketches")
    known = sketch.where("id is not null and n > 0")
    classes = stage(known.groupBy("digest").agg(F.min(F.struct("id", "n", "keys")).alias("m")).select("digest", "m.*"), "classes")

    value = stage(classes.select("id", "keys").mapInArrow(lean(_met), "key long, id long, met boolean, sent boolean"), "values")
    by_key = lambda rows, *order: rows.repartition(n, "key").sortWithinPartitions("key", *order)
    again = by_key(value.where("sent").select("key", "id", "met")).mapInArrow(lean(_again), "id long, key long")
    shared = value.where("met").select("id", "key").union(again)
    keyed = stage(shared.groupBy("id").agg(F.collect_list("key").alias("values")).where("size(values) > 1"), "shared-values")
    rows = stage(keyed.mapInArrow(lean(_tables), "key long, a long, b long"), "tables")
    across = by_key(rows.where("key is not null").select("key", "a"), "a").mapInArrow(lean(_stars), "a long, b long")
    stars = rows.where("key is null").select("a", "b").union(across).distinct()
    families = stage(connected_components(stage(stars, "candidates")), "families")
    release(value, keyed, rows)

    def verified(grouped: DataFrame) -> DataFrame:
        texts = stage(grouped, "groups").join(base, "id").select("g", "id", "text")
        return stage(texts.repartition(n, "g").sortWithinPartitions("g", "id").mapInArrow(lean(_verified(percent)), "a long, b long"), "links")

    sizes = classes.select(F.col("id").alias("node"), "n")
    grouped, large = _split_families(families, sizes, block, weight)
    links = verified(grouped)
    found = stage(connected_components(links), "components")
    parts = large.join(found.toDF("node", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    several = parts.groupBy("component").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("component")
    open_ = stage(_salted(parts, several, ["component"]).join(sizes, "node").select("node", "component", "part", "n"), "open-families")
    if not open_.isEmpty():
        found = stage(connected_components(links.union(verified(_split_rest(open_, block, weight)))), "components")

    named = stage(classes.join(found.withColumnRenamed("node", "id"), "id", "left").select("digest", F.coalesce("component", "id").alias("component_id")), "named")
    alone = F.col("id").isNull() | (F.col("n") == 0)
    linked = sketch.where(~alone).join(named, "digest").select("id", "n", "component_id")
    rest = sketch.where(alone).select("id", "n", F.col("id").alias("component_id"))
    return linked.union(rest).select("id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
