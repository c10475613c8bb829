"""Records from documents: merging, citation search, reconciliation, decisions."""

from __future__ import annotations

import itertools

import pandas as pd
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pyarrow as pa

from ..functions.order import checkpointed, positions


def merge_candidates(rows: DataFrame, key: str, order: str, firsts: list[str], unions: list[str], least: list[str]) -> DataFrame:
    """One row per key: the first non-empty value in order, the distinct values in order, the least."""
    field = lambda c: lambda s: s[c]
    filled = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    return rows.groupBy(key).agg(
        *(F.min_by(c, F.when(filled(c), F.col(order))).alias(c) for c in firsts),
        *(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(order, c))), field(c))).alias(c) for c in unions),
        *(F.min(c).alias(c) for c in least),
    )


def citation_search(seeds: DataFrame, edges: DataFrame, hops: int, frontier: int | None = None, gate: DataFrame | None = None) -> DataFrame:
    """(node, hops) within a number of hops over undirected edges(a, b).

    From the second hop on only nodes of `gate`, where it is given, are followed
    further, of these at most `frontier`: those that most links led to, then by
    node. What is reached but not followed still counts as found.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    seen = seeds.select("node").distinct().withColumn("hops", F.lit(0))
    front = seen.select("node", F.lit(0).cast("long").alias("links"))
    for h in range(1, hops + 1):
        if h > 1 and gate is not None:
            front = front.join(gate.select("node"), "node", "left_semi")
        if h > 1 and frontier:
            front = front.orderBy(F.desc("links"), "node").limit(frontier)
        grown = both.join(front.select(F.col("node").alias("a")), "a").groupBy(F.col("b").alias("node")).agg(F.count("*").alias("links"))
        front = checkpointed(grown.join(seen, "node", "left_anti"))  # each hop is worked out once
        seen = seen.union(front.select("node", F.lit(h)))
    return seen


#: Statuses of a record in the order of an export; others come last.
STATUSES = ("gold", "silver", "needs_review", "results_only", "reject")


def in_status_order(rows: DataFrame, key: str) -> DataFrame:
    """rows with `place`, from 0, by status and then by an integer key that is their own; no task sorts all."""
    status = F.coalesce(*(F.when(F.col("status") == s, i) for i, s in enumerate(STATUSES)), F.lit(9))
    both = F.format_string("%d %020d", status, F.col(key))
    placed = rows.withColumn("_order", both)
    return placed.join(positions(placed, "_order").withColumnRenamed("idx", "place"), "_order").drop("_order")


def _runs(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for whole in batches:
        for start in range(0, whole.num_rows, rows):
            key, tokens = whole.slice(start, rows).columns
            flat, row = pc.list_flatten(tokens).dictionary_encode(), pc.list_parent_indices(tokens).to_numpy()
            code = flat.indices.to_numpy()
            order = np.lexsort((code, row))
            r, c = row[order], code[order]
            first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (c[1:] != c[:-1])][: len(r)])
            at = (np.arange(len(row)) - np.searchsorted(row, row))[order]
            places = pa.ListArray.from_arrays(pa.array(np.r_[first, len(r)], pa.int32()), pa.array(at, pa.int32()))
            ends = np.cumsum(np.bincount(r[first], minlength=len(key)))
            yield pa.RecordBatch.from_arrays([key, pa.MapArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), flat.dictionary.take(pa.array(c[first])), places)], ["id", "inverted"])


def inverted_index(rows: DataFrame) -> DataFrame:
    """(id, inverted): a map of token to positions from (id, tokens), each from its own row; empty without tokens."""
    rows = rows.select("id", "tokens")
    return rows.mapInArrow(_runs, f"id {rows.schema['id'].dataType.simpleString()}, inverted map<string,array<int>>")


def rebuild_inverted(index: DataFrame, key: str = "id", inverted: str = "inverted") -> DataFrame:
    """Texts from maps of token to positions, each from its own row."""
    some = index.where(F.exists(F.map_values(inverted), lambda v: F.size(v) > 0))
    none = F.array().cast("array<int>")
    pairs = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(F.coalesce(e["value"], none), lambda p: F.struct(p.alias("at"), e["key"].alias("token")))))
    return some.select(key, F.array_join(F.transform(F.sort_array(pairs), lambda x: x["token"]), " ").alias("text"))


def keyword_gate(text: Column, *patterns: str) -> Column:
    """Whether every pattern occurs, whatever the case."""
    hit = F.lit(True)
    for p in patterns:
        hit &= F.coalesce(text.rlike(f"(?i){p}"), F.lit(False))
    return hit


def decision(value: Column, evidence: Column) -> Column:
    """A criterion's decision; unknown words, and a yes or no without evidence, are unclear."""
    v = F.lower(F.trim(value))
    supported = F.length(F.trim(F.coalesce(evidence, F.lit("")))) > 0
    return F.when(v.isin("yes", "no") & supported, v).otherwise("unclear")


def status(core: list[Column], teachers: Column, complete: Column, flagged: Column, public: tuple[Column, Column], found: tuple[Column, Column], separable: Column, matched: Column) -> Column:
    """reject, needs_review, results_only, silver or gold; the first rule that applies decides."""
    any_of = lambda v: F.exists(F.array(*core), lambda c: c == v)
    claims = (public[0] == "yes") & (public[1] == "yes")
    verified = F.coalesce(found[0], F.lit(False)) & F.coalesce(found[1], F.lit(False))
    missing = F.coalesce(~found[0], F.lit(False)) | F.coalesce(~found[1], F.lit(False))
    return (
        F.when(any_of("no") | (teachers < 2), "reject")
        .when(any_of("unclear") | ~complete | flagged, "needs_review")
        .when((public[0] == "no") | (public[1] == "no"), "results_only")
        .when(claims & missing, "needs_review")
        .when(F.coalesce(found[1], F.lit(False)) & (separable == "no"), "needs_review")
        .when(~claims & ~verified, "results_only")
        .when((teachers < 3) | (matched != "yes") | ~verified | (separable != "yes"), "silver")
        .otherwise("gold")
    )


def field_diff(a: DataFrame, b: DataFrame, key: str, strict: list[str], loose: list[str], numeric: list[str]) -> DataFrame:
    """(key, field, left, right) where two sources differ: as they are, without case and punctuation, or beyond 1e-6."""

    def long(df: DataFrame) -> DataFrame:
        fields = [*strict, *loose, *numeric]
        return df.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields))).alias("x")).select(key, "x.*")

    norm = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    j = long(a).withColumnRenamed("v", "left").join(long(b).withColumnRenamed("v", "right"), [key, "field"])
    same = (
        F.when(F.col("left").isNull() | F.col("right").isNull(), F.col("left").isNull() & F.col("right").isNull())
        .when(F.col("field").isin(*loose), norm(F.col("left")) == norm(F.col("right")))
        .when(F.col("field").isin(*numeric), F.coalesce(F.abs(F.col("left").try_cast("double") - F.col("right").try_cast("double")) <= 1e-6, F.col("left") == F.col("right")))
        .otherwise(F.col("left") == F.col("right"))
    )
    return j.where(~same)


def resolve(diffs: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Each differing field with the adjudicated side's value; NULL and unresolved without a verdict."""
    j = diffs.join(verdicts, [key, "field"], "left")
    value = F.when(F.col("side") == "left", F.col("left")).when(F.col("side") == "right", F.col("right"))
    return j.select(key, "field", value.alias("value"), value.isNull().alias("unresolved"))


def greedy_alignment(left: DataFrame, right: DataFrame, group: str, threshold: float = 3.0) -> DataFrame:
    """One-to-one matches of two sources' experiments within each group, best score first; both residues follow.

    left, right: (group, id, names ARRAY<STRING>). The score of a pair is the
    number of shared names; pairs under the threshold stay apart.
    """

    def pair(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        scored = sorted(((-len(set(x.names) & set(y.names)), x.id, y.id) for x, y in itertools.product(a.itertuples(), b.itertuples())), key=lambda s: s)
        used_a, used_b, out = set(), set(), []
        for minus, x, y in scored:
            if -minus >= threshold and x not in used_a and y not in used_b:
                used_a.add(x)
                used_b.add(y)
                out.append((key[0], x, y, float(-minus)))
        out += [(key[0], x, None, 0.0) for x in a.id if x not in used_a] + [(key[0], None, y, 0.0) for y in b.id if y not in used_b]
        return pd.DataFrame(out, columns=[group, "left_id", "right_id", "score"])

    return left.groupBy(group).cogroup(right.groupBy(group)).applyInPandas(pair, f"{group} string, left_id string, right_id string, score double")


def primary_benchmark(rows: DataFrame, key: str) -> DataFrame:
    """The declared benchmark, else that of most teachers, else the first by name."""
    w = Window.partitionBy(key).orderBy(F.desc("declared"), F.desc("teachers"), "benchmark")
    return rows.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Last row of each key (caches, upserts)."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_r")).select(key, "_r.*")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without the keys of new, and new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def mention(name: Column) -> Column:
    """A pattern for loose mentions of a name: its tokens with any short separators."""
    return F.concat(F.lit("(?i)"), F.array_join(F.regexp_extract_all(name, F.lit("([A-Za-z]+|[0-9]+)"), F.lit(1)), "[ ._-]{0,2}"))


def prescreened(rows: DataFrame, limit: int) -> DataFrame:
    """The first candidates for full reading: seeds, then yes before unclear by confidence, then those with a preprint, near ones first; a `no` never."""
    order = [~F.array_contains("sources", "seed"), F.col("relevant") != "yes", F.desc(F.coalesce("confidence", F.lit(0.0))), F.col("arxiv_id").isNull(), "hops", "key"]
    return rows.where("relevant <> 'no'").orderBy(*order).limit(limit)


def recent(rows: DataFrame, least: int) -> DataFrame:
    """Rows of a year or later; an unknown year stays."""
    return rows.where(F.col("year").isNull() | (F.col("year") >= least))


def run_counts(rows: DataFrame, column: str = "status") -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


#: Names that the signal scan counts.
SCANNED = ("GPT", "Claude", "DeepSeek", "Qwen", "Gemini", "Llama")


def signal(text: Column) -> Column:
    """Strength of signs that a text compares several teachers' data: named sources, tuning, and ablations."""
    low = F.lower(text)
    names = sum((F.regexp_count(text, F.lit(n)) for n in SCANNED), F.lit(0))
    score = F.when((names >= 3) & low.rlike("sft|supervised fine"), 1).otherwise(0)
    for n in SCANNED[:4]:
        score += F.when(F.contains(text, F.lit(f"from {n}")) | F.contains(low, F.lit(f"trajectories from {n}")), 2).otherwise(0)
    several = F.contains(low, F.lit("ablation")) & text.rlike("|".join(SCANNED[:3])) & ((F.regexp_count(low, F.lit("sft")) >= 2) | (F.regexp_count(low, F.lit("training")) >= 3))
    return F.coalesce(score + F.when(several, 1).otherwise(0), F.lit(0))


def scan_verdict(text: Column) -> Column:
    """fail_retrieval without text, fail_scan without a sign, else a provisional pass."""
    return F.when(text.isNull(), "fail_retrieval").when(signal(text) == 0, "fail_scan").otherwise("pass")


def artifact_role() -> Column:
    """The judged role of an artifact; what a paper names for a role keeps it unless the judge says otherwise."""
    judged = F.nullif(F.col("judged_role"), F.lit("unclear"))
    return F.when(F.col("role").isin("tasks", "trajectories"), F.coalesce(judged, F.col("role"))).otherwise(F.coalesce("judged_role", F.lit("unclear")))


def artifact_status(checked: DataFrame, role: str) -> DataFrame:
    """(paper, verified, ids, separable): whether a paper's artifacts of one role exist and can be read.

    verified is true with a matching artifact, false if one was named in vain,
    null without either. separable: yes if any judgment says so, no if all say
    no and no teacher is mentioned, else unclear.
    checked: paper, id, kind, role, judged_role, exists, accessible, separable, mentioned.
    """
    good = F.col("kind").isin("datasets", "models") & (artifact_role() == role) & F.col("exists") & F.col("accessible")
    c = checked.withColumn("_good", F.coalesce(good, F.lit(False)))
    mine = F.col("_good")
    per = c.groupBy("paper").agg(
        F.bool_or(mine).alias("any_good"), F.bool_or(F.coalesce(F.col("role") == role, F.lit(False))).alias("named"),
        F.array_sort(F.collect_list(F.when(mine, F.col("id")))).alias("ids"), F.coalesce(F.bool_or(F.when(mine, F.col("separable") == "yes")), F.lit(False)).alias("yes"),
        F.coalesce(F.bool_and(F.when(mine & F.col("separable").isNotNull(), F.col("separable") == "no")), F.lit(True)).alias("all_no"), F.coalesce(F.bool_or(F.when(mine, F.col("mentioned"))), F.lit(False)).alias("seen"),
    )
    verified = F.when(F.col("any_good"), True).when(F.col("named"), False)
    separable = F.when(F.col("any_good"), F.when(F.col("yes"), "yes").when(F.col("all_no") & ~F.col("seen"), "no").otherwise("unclear"))
    return per.select("paper", verified.alias("verified"), F.when(F.col("any_good"), F.col("ids")).otherwise(F.array().cast("array<string>")).alias("ids"), separable.alias("separable"))


def key_tokens(name: Column) -> Column:
    """Distinctive tokens of a name: three characters or more, with a letter."""
    parts = F.transform(F.split(F.lower(name), r"[\s\-_/():]+"), lambda t: F.regexp_replace(t, "[^a-z0-9]", ""))
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) >= 3) & t.rlike("[a-z]")))


def dedicated_links(teachers: DataFrame, datasets: DataFrame) -> DataFrame:
    """(paper, teacher, dataset): the first dataset by id whose name has a token of that teacher and none of the paper's other teachers; null without one.

    Names meet tokens by equality of their pieces, so no name is held against
    every teacher. A piece is cut only where three characters begin some token
    and in lengths that those tokens have; there are 36 ** 3 such beginnings at
    most, whatever the input.
    """
    t = teachers.select("paper", "teacher", key_tokens(F.col("teacher")).alias("mine")).distinct()
    owned = t.select("paper", "teacher", "mine", F.explode("mine").alias("token"))
    tokens = owned.groupBy("paper", "token").agg(F.count("*").alias("owners"))
    begins = tokens.groupBy(F.substring("token", 1, 3).alias("begin")).agg(F.collect_set(F.length("token")).alias("lengths"))
    norm = F.regexp_replace(F.lower(F.substring_index("dataset", "/", -1)), "[^a-z0-9]+", "")
    d = datasets.select("paper", "dataset", norm.alias("_n")).where("length(_n) >= 3")
    at = d.select("*", F.explode(F.sequence(F.lit(1), F.length("_n") - 2)).alias("at")).withColumn("begin", F.expr("substring(_n, at, 3)"))
    pieces = at.join(F.broadcast(begins), "begin").select("paper", "dataset", "_n", "at", F.explode("lengths").alias("length")).where("at + length <= length(_n) + 1")
    found = pieces.select("paper", "dataset", F.expr("substring(_n, at, length)").alias("token")).join(tokens, ["paper", "token"])
    # A name is a teacher's if all that it holds is that teacher's; names that hold the same are one, found by the token of fewest teachers.
    per = found.groupBy("paper", "dataset").agg(F.array_sort(F.collect_set(F.struct("owners", "token"))).alias("held")).groupBy("paper", "held").agg(F.min("dataset").alias("dataset"))
    rarest = per.select("paper", "dataset", F.transform("held", lambda h: h["token"]).alias("held"), F.col("held")[0]["token"].alias("token"))
    hit = owned.join(rarest, ["paper", "token"]).where(F.size(F.array_except("held", "mine")) == 0).groupBy("paper", "teacher").agg(F.min("dataset").alias("dataset"))
    return teachers.select("paper", "teacher").join(hit, ["paper", "teacher"], "left")


def review_queue(records: DataFrame) -> DataFrame:
    """What a person should look at: records that need review, and fields on which the sources disagree."""
    return records.where((F.col("status") == "needs_review") | (F.size(F.coalesce("disagreements", F.array().cast("array<string>"))) > 0))


def flat_record(records: DataFrame, fields: list[str], evidence: str = "evidence") -> DataFrame:
    """A wide row for export: chosen fields in order, null where a record lacks one, and all evidence joined as `field: text`."""
    kept = [F.col(f) if f in records.columns else F.lit(None).cast("string").alias(f) for f in fields]
    joined = F.array_join(F.transform(F.array_sort(F.map_entries(evidence)), lambda e: F.concat_ws(": ", e["key"], e["value"])), " | ")
    return records.select(*kept, joined.alias("all_evidence"))
