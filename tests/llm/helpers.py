"""Small tables with everything that an operator must bear."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
#: Columns of docs whose names the operators use themselves.
CLASHES = "id long, n long, key string, hits int, sha string, kept boolean, size int, digest string, value int, component string, k long, g long, m long, rank int, length int, pid int, y int, w int"


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) for _ in range(n))


def documents(spark: SparkSession, rows: list[tuple[int | None, str | None]], partitions: int = 3) -> DataFrame:
    """(doc_id, text, lang, source, n_chars)."""
    full = [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(partitions)


def with_clashes(docs: DataFrame) -> DataFrame:
    """docs with columns of other meaning under names that operators use."""
    return docs.selectExpr("*", *(f"cast(null as {kind}) as `{name}`" for name, kind in (c.strip().split() for c in CLASHES.split(","))))


AWKWARD: list[tuple[int | None, str | None]] = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "é" * 50), (None, "no id"), (None, None), (7, "same row twice"), (7, "same row twice"), (8, "\x00 control \x7f"), (9, "🙂 astral 𝒳"), (10, "alpha beta " * 3000)]
