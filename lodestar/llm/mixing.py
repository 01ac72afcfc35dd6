"""Mixing sources to target weights by entropy balancing.

The rates r of the documents minimise sum(size * r * (log r - 1)), the relative
entropy of the mix's tokens to the corpus's, subject to one token constraint a
source, sum(size * r) = target. The solution is an exponential tilt, r =
exp(lambda_source); the convex dual sum(size * exp(lambda)) - lambda * target is
solved by Newton iterations whose gradients and Hessians are distributed sums over
(source, size) classes. Rates are then rounded into copies: each document gets
floor(r), and the extra copies of a class of equal sizes are set by error diffusion
along the source's classes from large to small, so a source misses its target by
about its smallest documents' size. Which documents of a class get the extra copy
goes by a hash of id and text.

Defined results: null text has size 0 and takes nothing; a null source is a source
of its own, after all others; repeated rows are documents of their own and
interchangeable; an empty table gives an empty table; if all sizes are 0 all
targets are 0; texts of any length are counted whole; only the three named columns are
read, so others may have any name. Sources, their targets and multipliers are tables
too: the driver sees sums only, so hosts may serve as sources.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, drop, save, table

#: The weights that sources take in turn, and the most copies of a document.
WEIGHTS, MOST = (5.0, 2.0, 1.0), 3
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def number(sources: DataFrame, key: str) -> DataFrame:
    """sources with s: their place by code point, nulls last, from 0; ranges are counted, no task orders all."""
    dealt, path = save(sources.repartitionByRange(F.col(key).asc_nulls_last()).withColumn("__p", F.spark_partition_id()), "ranges")
    counts = {r["__p"]: r.n for r in dealt.groupBy("__p").agg(F.count("*").alias("n")).collect()}  # one a range
    ahead, seen = [], 0
    for p in sorted(counts):
        ahead.append((p, seen))
        seen += counts[p]
    place = F.row_number().over(Window.partitionBy("__p").orderBy(F.col(key).asc_nulls_last())) - 1
    ahead = sources.sparkSession.createDataFrame(ahead, "__p int, __ahead long")
    return dealt.withColumn("__r", place).join(ahead, "__p").withColumn("s", F.col("__r") + F.col("__ahead")).drop("__p", "__r", "__ahead")


def targets(sources: DataFrame, most: float = MOST) -> DataFrame:
    """sources (tokens, weight, ...) with target: shares of all tokens by weight, at most ``most`` times the
    source's own, the excess reshared by weight. A source is at its limit if that, by weight, is below the
    level of the others, and the level only rises as limits are met."""
    limit = F.col("tokens") * F.lit(float(most))
    zero = F.lit(0.0)
    level, met = 0.0, -1
    while True:
        under = (limit / F.col("weight")) < F.lit(level)
        r = sources.where("tokens > 0").agg(
            F.coalesce(F.sum("tokens"), zero).alias("all"), F.coalesce(F.sum(F.when(under, limit)), zero).alias("spent"), F.coalesce(F.sum(F.when(~under, F.col("weight"))), zero).alias("free"), F.count_if(under).alias("met")
        ).first()
        if not r.free or r.met == met:
            break
        met, level = r.met, (float(r["all"]) - r.spent) / r.free
    return sources.withColumn("target", F.when(F.col("tokens") > 0, F.least(limit, F.col("weight") * F.lit(level))).otherwise(0.0))


def balance(classes: DataFrame, goals: DataFrame, rounds: int = 30) -> DataFrame:
    """(s, lam) by Newton iterations on the dual; classes (s, size, n); goals (s, target)."""
    spark = classes.sparkSession
    now, path = save(goals.where("target > 0").select("s", "target", F.lit(0.0).alias("lam"), F.lit(1.0).alias("off")), "dual")
    for _ in range(rounds):
        # with constant features gradient and Hessian share the tilted token sum
        tilted = classes.join(now.select("s", "lam"), "s").groupBy("s").agg(F.sum(F.col("n") * F.col("size") * F.exp("lam")).alias("tilted"))
        gradient = F.col("tilted") - F.col("target")
        step = F.greatest(F.lit(-2.0), F.least(F.lit(2.0), gradient / F.col("tilted")))
        new, new_path = save(now.join(tilted, "s").select("s", "target", (F.col("lam") - step).alias("lam"), (F.abs(gradient) / F.col("target")).alias("off")), "dual")
        drop(spark, path)
        now, path = new, new_path
        if (now.agg(F.max("off")).first()[0] or 0.0) < 1e-9:
            break
    return now.select("s", "lam")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: int = MOST, buckets: int = 1024) -> DataFrame:
    """(id, text_hash, source, size, source_size, target, rate, copies) of every row."""
    rows = docs.select(column(id_col).alias("id"), F.xxhash64(column(id_col), column(text_col)).alias("h"), F.xxhash64(column(text_col)).alias("th"), column(source_col).cast("string").alias("source"), n_words(column(text_col)).alias("size"))
    rows, _ = save(rows, "sizes")
    classes, _ = save(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "classes")
    sources = classes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("tokens"))
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("s") % len(weights) + 1).cast("int"))
    index, _ = save(targets(save(number(sources, "source").withColumn("weight", share), "sources")[0], most).select("s", "source", F.col("tokens").alias("source_size"), "target"), "targets")
    numbered = classes.join(index, classes["source"].eqNullSafe(index["source"])).select("s", "size", "n")
    lam = balance(numbered, index.select("s", "target"))
    rates = index.select("s").join(lam, "s", "left").select("s", F.coalesce(F.least(F.lit(float(most)), F.exp("lam")), F.lit(0.0)).alias("rate"))

    def diffuse(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False, ignore_index=True)
        rate = float(pdf.rate[0])
        base = min(most, int(rate + 1e-9))
        extra, more, carry = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64), 0.0
        for i, (size, n) in enumerate(zip(pdf["size"], pdf.n, strict=True)):
            if size and base < most:
                want = n * max(0.0, rate - base) * size + carry
                total = min(n * (most - base), max(0, round(want / size)))
                more[i], extra[i] = divmod(total, n)  # small classes may make up what large ones left
                carry = want - total * size
        return pd.DataFrame({"s": pdf.s, "size": pdf["size"], "base": base + more, "extra": extra})

    # a source's classes are its distinct sizes: as many as the longest text allows, not as many as documents
    chosen = numbered.join(rates, "s").groupBy("s").applyInPandas(diffuse, "s long, size long, base long, extra long")
    chosen, _ = save(chosen, "copies")
    # rank within a class by hash, over hash buckets so that a hot class is dealt to many tasks
    all_rows = rows.join(index, rows["source"].eqNullSafe(index["source"])).select("id", "h", "th", rows["source"], "size", "s", "source_size", "target", F.pmod(F.shiftright("h", 20), F.lit(buckets)).alias("b"))
    per = all_rows.groupBy("s", "size", "b").agg(F.count("*").alias("m"))
    before = Window.partitionBy("s", "size").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("ahead", F.coalesce(F.sum("m").over(before), F.lit(0))).join(chosen, ["s", "size"]).select("s", "size", "b", "base", (F.col("extra") - F.col("ahead")).alias("quota"))
    rank = F.row_number().over(Window.partitionBy("s", "size", "b").orderBy("h"))
    out = all_rows.withColumn("k", rank).join(per, ["s", "size", "b"]).join(rates, "s")
    return out.select(F.col("id").alias(id_col), F.col("th").alias("text_hash"), F.col("source").alias(source_col), "size", "source_size", "target", "rate", (F.col("base") + (F.col("k") <= F.col("quota")).cast("long")).alias("copies"))


def op7_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate", "copies")
