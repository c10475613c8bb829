"""Sinks: JSON lines, hashed arms, reports, fixed CSV, content-addressed parts."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def missing_only(new: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows that an earlier run has not written."""
    return new.join(done.select(*keys).distinct(), list(keys), "left_anti")


def write_arm(arm: DataFrame, path: str, order: str = "task") -> dict[str, Any]:
    """One selection as JSON lines in task order, with the digest and count of what was written.

    The rows of an arm are one per selected task; they stream through the
    driver to be hashed in order.
    """
    lines = arm.orderBy(order).select(F.to_json(F.struct(*sorted(arm.columns))).alias("value"))
    lines.coalesce(1).write.mode("overwrite").text(path)
    digest, n = hashlib.sha256(), 0
    for r in lines.toLocalIterator():
        digest.update(r.value.encode() + b"\n")
        n += 1
    return {"rows": n, "sha256": digest.hexdigest()}


def id_digest(ids: Sequence[str], final_newline: bool) -> str:
    return hashlib.sha256(("\n".join(ids) + "\n" * final_newline).encode()).hexdigest()


def report(values: Mapping[str, Any]) -> str:
    return json.dumps(values, sort_keys=True, indent=2, ensure_ascii=False)


def markdown(df: DataFrame, columns: Sequence[str]) -> str:
    """A small result as a table."""
    show = lambda v: "n/a" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    rows = [" | ".join(map(show, r)) for r in df.select(*columns).toLocalIterator()]
    return "\n".join(f"| {x} |" for x in [" | ".join(columns), " | ".join("---" for _ in columns), *rows]) + "\n"


def write_csv(df: DataFrame, path: str, columns: Sequence[str], order: str) -> None:
    """A fixed projection in order, as one file."""
    present = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
    df.select(*present).orderBy(order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def artifact_hashes(files: DataFrame) -> DataFrame:
    """(path, sha256) of a binaryFile table; text is scrubbed of volatile pieces first."""
    from ..functions.text import scrub

    is_text = ~F.contains(F.col("content"), F.lit(b"\x00"))
    return files.select("path", F.when(is_text, F.sha2(scrub(F.decode("content", "UTF-8")).cast("binary"), 256)).otherwise(F.sha2("content", 256)).alias("sha256"))


def artifact_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Paths that one side lacks or whose digests differ."""
    j = a.withColumnRenamed("sha256", "left").join(b.withColumnRenamed("sha256", "right"), "path", "full")
    return j.where(~F.col("left").eqNullSafe(F.col("right")))
