"""Query batches as a caller sends them, and what is refused in them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most neighbours and the deepest candidate list that may be asked for.
MOST_K, MOST_DEPTH = 512, 512


def decode_binary(spark: SparkSession, body: bytes, dim: int) -> DataFrame:
    """(qid, q) of little-endian 32-bit floats, ``dim`` a query, without header."""
    if not body or len(body) % (4 * dim):
        raise ValueError(f"a batch is whole queries of {4 * dim} bytes, not {len(body)} bytes")
    x = np.frombuffer(body, "<f4").reshape(-1, dim)
    bad = np.argwhere(~np.isfinite(x))
    if len(bad):
        raise ValueError(f"component {bad[0][1]} of query {bad[0][0]} is not finite")
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "qid long, q array<float>")


def decode_text(lines: DataFrame, dim: int) -> DataFrame:
    """(line_no, q, refused) of lines (line_no, line) of numbers parted by commas, spaces or tabs; blank lines are skipped."""
    parts = F.filter(F.split("line", "[, \\t\\r]+"), lambda x: x != "")
    q = F.transform(parts, lambda x: x.try_cast("double"))
    return lines.withColumn("q", q).where(F.size("q") > 0).select("line_no", "q", refusal(F.col("q"), dim).alias("refused"))


def refusal(q: Column, dim: int) -> Column:
    """Why a query is refused: its dimension, or its first component that is no finite number; else null."""
    bad = F.array_position(F.transform(q, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True))), True)
    return F.when(F.size(q) != dim, F.concat(F.lit("dimension "), F.size(q).cast("string"))).when(bad > 0, F.concat(F.lit("component "), (bad - 1).cast("string")))


def decode(spark: SparkSession, body: bytes, dim: int, content_type: str | None = None) -> DataFrame:
    """(qid, q) of a request's body: text if it says so, binary by default."""
    if content_type is None or not content_type.lower().startswith("text/"):
        return decode_binary(spark, body, dim)
    lines = spark.createDataFrame(list(enumerate(body.decode("utf-8").split("\n"))), "line_no long, line string")
    rows = decode_text(lines, dim).orderBy("line_no").collect()  # a request's own lines
    if not rows or any(r.refused for r in rows):
        raise ValueError(next((f"line {r.line_no}: {r.refused}" for r in rows if r.refused), "no query"))
    return spark.createDataFrame([(i, list(r.q)) for i, r in enumerate(rows)], "qid long, q array<double>")


def limits(k: int, depth: int | None, own: int) -> tuple[int, int]:
    """(k, depth) as they count: k from 1 to MOST_K, no depth or 0 means the index's own."""
    depth = depth or own
    if depth > MOST_DEPTH:
        raise ValueError(f"a depth of {depth} is above {MOST_DEPTH}")
    return max(1, min(MOST_K, k)), depth
