"""Blocks, checksums, manifests, replicas, Galois-field parity, faults and allocation."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the storage format: block and erase-unit bytes, field polynomial.
BLOCK, UNIT, POLY = 512, 4096, 0x11D


def stored(vec_id: Column, built: int, appended_from: int, n: int) -> Column:
    """Ids below built, or from appended_from to n; what lies between was never written."""
    return (vec_id < built) | ((vec_id >= appended_from) & (vec_id < n))


def status(vec_id: Column, built: int, appended_from: int, n: int) -> Column:
    return F.when(stored(vec_id, built, appended_from, n), "stored").when((vec_id >= 0) & (vec_id < n), "absent").otherwise("out of range")


def blocks(codes: DataFrame, m: int) -> DataFrame:
    """(block_no, bytes, crc): codes packed one byte each in id order, padded with 0xFF."""
    per = BLOCK // m
    hexed = F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), "")
    rows = codes.select(F.expr(f"vec_id div {per}").alias("block_no"), (F.col("vec_id") % per).alias("slot"), hexed.alias("h"))
    filler = "FF" * m
    packed = rows.groupBy("block_no").agg(F.map_from_entries(F.collect_list(F.struct("slot", "h"))).alias("slots"))
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(per - 1)), lambda i: F.coalesce(F.col("slots")[i.cast("long")], F.lit(filler))), "")
    data = F.unhex(F.rpad(body, 2 * BLOCK, "F"))
    return packed.select("block_no", data.alias("bytes")).withColumn("crc", F.crc32("bytes"))


def verify(data: DataFrame, crcs: DataFrame) -> DataFrame:
    """(block_no, ok) of all blocks either side has."""
    d = data.select("block_no", F.crc32("bytes").alias("now"))
    return d.join(crcs.select("block_no", F.col("crc").alias("want")), "block_no", "full_outer").select("block_no", F.coalesce(F.col("now") == F.col("want"), F.lit(False)).alias("ok"))


def live_manifest(slots: DataFrame, *keys: str) -> DataFrame:
    """The valid manifest of the highest sequence, of each volume if keys name one."""
    return slots.where("valid").groupBy(*keys).agg(F.max_by(F.struct(*slots.columns), "sequence").alias("m")).select("m.*")


def gf_mul(a: Column, b: Column) -> Column:
    """Product in GF(256), carry-less and reduced, a bit at a time."""
    step = lambda s, i: F.struct(
        F.when(F.shiftright(b, 0).bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0, s["r"].bitwiseXOR(s["a"])).otherwise(s["r"]).alias("r"),
        F.when(s["a"] >= 128, (s["a"] * 2).bitwiseXOR(F.lit(POLY))).otherwise(s["a"] * 2).alias("a"),
    )
    return F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.struct(F.lit(0).alias("r"), a.cast("int").alias("a")), step, lambda s: s["r"])


def _mul(a: int, b: int) -> int:
    r = 0
    while b:
        if b & 1:
            r ^= a
        a <<= 1
        if a & 256:
            a ^= POLY
        b >>= 1
    return r


def _inverse(a: int) -> int:
    return next(x for x in range(1, 256) if _mul(a, x) == 1)


def cauchy(n: int, k: int) -> list[list[int]]:
    """Parity rows of a systematic code: 1 / (x_i + y_j) with x_i = k + i, y_j = j."""
    return [[_inverse((k + i) ^ j) for j in range(k)] for i in range(n - k)]


def rs_decode(shards: dict[int, np.ndarray], n: int, k: int) -> np.ndarray:
    """The k data shards from any k of n, by Gauss-Jordan elimination in GF(256)."""
    rows = sorted(shards)[:k]
    if len(rows) < k:
        raise ValueError("fewer than k shards survive")
    full = [[int(i == j) for j in range(k)] for i in range(k)] + cauchy(n, k)
    a = [list(full[r]) for r in rows]
    y = [np.array(shards[r], np.int64) for r in rows]
    mul = np.array([[_mul(i, j) for j in range(256)] for i in range(256)], np.int64)
    for c in range(k):
        p = next(r for r in range(c, k) if a[r][c])
        a[c], a[p], y[c], y[p] = a[p], a[c], y[p], y[c]
        inv = _inverse(a[c][c])
        a[c], y[c] = [_mul(v, inv) for v in a[c]], mul[inv][y[c]]
        for r in range(k):
            if r != c and a[r][c]:
                f = a[r][c]
                a[r], y[r] = [v ^ _mul(f, w) for v, w in zip(a[r], a[c], strict=True)], y[r] ^ mul[f][y[c]]
    return np.stack(y)


def best_rates(groups: DataFrame, rates: list[tuple[int, int, int]], budget: int) -> DataFrame:
    """Exhaustive protection allocation over few groups: least sum(weight * residual), then least cost.

    The choice is over len(rates) ** groups combinations of driver-sized inputs (at most 8 groups)."""
    rows = groups.orderBy("bucket").limit(9).collect()
    if len(rows) > 8:
        raise ValueError("at most 8 groups")
    best = None
    for pick in itertools.product(range(len(rates)), repeat=len(rows)):
        spent = sum(rates[p][1] for p in pick)
        if spent <= budget:
            value = (sum(r.weight * rates[p][2] for r, p in zip(rows, pick, strict=True)), spent)
            best = min(best or value, value)
    return groups.sparkSession.createDataFrame([best] if best else [], "objective long, spent long")


def events_of(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """A deterministic program / erase log of a flash device: (seq, page, op)."""
    i = F.col("id")
    return spark.range(n).select(i.alias("seq"), ((i * 7 + seed) % 16).alias("page"), F.when((i * 5 + seed) % 3 == 0, "erase").otherwise("program").alias("op"))


def flash_faults(log: DataFrame, limit: int) -> DataFrame:
    """(double_programs, worn_pages): programs without an erase since the last, pages erased more than limit times."""
    w = Window.partitionBy("page").orderBy("seq")
    marked = log.withColumn("before", F.lag("op").over(w))
    worn = log.where("op = 'erase'").groupBy("page").count().where(F.col("count") > limit).agg(F.count("*").alias("worn_pages"))
    return marked.agg(F.count_if((F.col("op") == "program") & (F.col("before") == "program")).alias("double_programs")).join(worn)


def gf_inverse(a: Column) -> Column:
    """1 / a in GF(256), from the table of all; 0 for 0."""
    return F.get(F.lit([0, *map(_inverse, range(1, 256))]), a.cast("int"))


def rs_encode(data: DataFrame, n: int, k: int) -> DataFrame:
    """(stripe, shard, p, v): the bytes of n - k parity shards of every k blocks (block_no, bytes); absent blocks
    count as zeros. A byte's products come from a table of coefficients by byte value; sums are exclusive or."""
    rows = cauchy(n, k)
    products = F.lit([[[_mul(f, b) for b in range(256)] for f in row] for row in rows])  # (n - k) x k x 256
    each = F.transform(F.sequence(F.lit(1), F.octet_length("bytes")), lambda i: F.conv(F.hex(F.substring("bytes", i, F.lit(1))), 16, 10).cast("int"))
    cells = data.select(F.expr(f"block_no div {k}").alias("stripe"), (F.col("block_no") % k).cast("int").alias("j"), F.posexplode(each).alias("p", "b"))
    terms = cells.select("stripe", "p", F.explode(F.sequence(F.lit(0), F.lit(n - k - 1))).alias("shard"), "j", "b")
    return terms.groupBy("stripe", "shard", "p").agg(F.bit_xor(F.get(F.get(F.get(products, F.col("shard")), F.col("j")), F.col("b"))).alias("v"))


def access_stats(reads: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """(key, reads, bytes, blocks, straddling, blocks_per_read_centi) of reads (addr, len)."""
    rows = reads.withColumn("lo", F.expr(f"addr div {block}")).withColumn("hi", F.expr(f"(addr + greatest(len, 1) - 1) div {block}"))
    out = rows.groupBy(key).agg(F.count("*").alias("reads"), F.sum("len").alias("bytes"), F.sum(F.col("hi") - F.col("lo") + 1).alias("blocks"), F.count_if(F.col("hi") > F.col("lo")).alias("straddling"))
    return out.withColumn("blocks_per_read_centi", F.expr("blocks * 100 div reads"))
