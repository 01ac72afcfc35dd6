"""Append planning, repair, scrubbing and validity of stored volumes, as relations over blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .integrity import BLOCK, UNIT

#: Regions by urgency of scrubbing, and those whose loss is fatal.
PRIORITY = {"codebook": 0, "codebook_replica": 0, "payload": 1, "payload_crc": 1, "rerank": 2, "rerank_crc": 2}
FATAL = ("codebook", "codebook_replica")


def is_erased(data: Column) -> Column:
    """All bytes are 0xFF."""
    return F.hex(data) == F.repeat(F.lit("FF"), F.octet_length(data))


def capacity(blocks: DataFrame, per_block: int) -> DataFrame:
    """(head, erased, slots): the first erased block, how many there are, and the records they take."""
    erased = is_erased(F.col("bytes"))
    return blocks.agg(F.min(F.when(erased, F.col("block_no"))).alias("head"), F.count_if(erased).alias("erased"), (F.count_if(erased) * per_block).alias("slots"))


def written_runs(manifests: DataFrame, per_block: int) -> DataFrame:
    """Half-open block runs of each manifest (id, built, appended_from, n): one, or two around a gap."""
    up = lambda c: F.ceil(F.col(c) / per_block).cast("long")
    first = F.struct(F.lit(0).cast("long").alias("lo"), up("built").alias("hi"))
    second = F.struct(F.expr(f"appended_from div {per_block}").alias("lo"), up("n").alias("hi"))
    merged = F.struct(F.lit(0).cast("long").alias("lo"), up("n").alias("hi"))
    runs = F.when(F.col("n") <= F.col("appended_from"), F.array(first)).when(second["lo"] <= first["hi"], F.array(merged)).otherwise(F.array(first, second))
    return manifests.select("id", F.explode(runs).alias("r")).select("id", F.col("r.lo").alias("from_block"), F.col("r.hi").alias("to_block"))


def drift(volumes: DataFrame, threshold_ppm: int) -> DataFrame:
    """volumes (id, built, appended, error_sum) with mean error in 1024ths, appended share in millionths, rebuild."""
    out = volumes.withColumn("mean_error_x1024", F.expr("case when appended = 0 then 0 else error_sum * 1024 div appended end"))
    out = out.withColumn("appended_ppm", F.expr("case when built + appended = 0 then 0 else appended * 1000000 div (built + appended) end"))
    return out.withColumn("rebuild", F.col("appended_ppm") > threshold_ppm)


def consequences(bad: DataFrame) -> DataFrame:
    """Of (id, n, centroids, m, d, codebook_blocks, bad_payload, bad_rerank, bad_codebook): vectors with wrong codes,
    candidates that drop, vectors wrongly reconstructed."""
    out = bad.withColumn("wrong_codes", F.expr(f"least(n, bad_payload * ({BLOCK} div m))"))
    out = out.withColumn("will_drop", F.expr(f"least(n, bad_rerank * greatest(1, {BLOCK} div d))"))
    each = "cast(ceil(centroids / greatest(1, codebook_blocks)) as long)"
    return out.withColumn("misread", F.expr(f"least(n, bad_codebook * {each} * n div centroids)"))


def first_good(copies: DataFrame) -> DataFrame:
    """(block_no, copy): the first copy that verifies, null if none does; copies (block_no, copy, bytes, crc)."""
    ok = F.crc32("bytes") == F.col("crc")
    return copies.groupBy("block_no").agg(F.min(F.when(ok, F.col("copy"))).alias("copy"))


def repair(copies: DataFrame, detect_only: bool = False) -> DataFrame:
    """(block_no, outcome, from_copy): what repairing the primary (copy 0) of each block comes to."""
    best = first_good(copies)
    outcome = F.when(F.col("copy") == 0, "clean").when(F.lit(detect_only), "dropped").when(F.col("copy").isNull(), "unrepairable").otherwise("repaired")
    return best.select("block_no", outcome.alias("outcome"), F.when(outcome == "repaired", F.col("copy")).alias("from_copy"))


def repair_totals(report: DataFrame) -> DataFrame:
    """One row: examined, clean, repaired, dropped, erases (of a unit each repair)."""
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return report.agg(F.count("*").alias("examined"), n("clean").alias("clean"), n("repaired").alias("repaired"), n("dropped", "unrepairable").alias("dropped"), n("repaired").alias("erases"))


def scrub(data: DataFrame, cursor: int, budget: int) -> DataFrame:
    """Verify ``budget`` blocks (region, block_no, bytes, crc) of each region from a cursor on: verified, failed,
    the cursor to go on from (0 at the end) and whether the end was met."""
    here = (F.col("block_no") >= cursor) & (F.col("block_no") < cursor + budget)
    total = F.max("block_no") + 1
    end = total <= cursor + budget
    return data.groupBy("region").agg(
        F.count_if(here).alias("verified"), F.count_if(here & (F.crc32("bytes") != F.col("crc"))).alias("failed"), F.when(end, F.lit(0).cast("long")).otherwise(F.lit(cursor + budget).cast("long")).alias("cursor"), end.alias("completed")
    )


def by_priority(regions: DataFrame) -> DataFrame:
    """regions (place, kind) with their turn: most urgent first, ties in input order."""
    urgency = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("kind")]
    # a volume has a handful of regions
    return regions.withColumn("priority", urgency).withColumn("turn", F.row_number().over(Window.partitionBy("volume").orderBy("priority", "place")))


def region_valid(regions: DataFrame) -> DataFrame:
    """regions (base, block_bytes, blocks) with the first rule they break, or null."""
    size = F.col("blocks") * F.col("block_bytes")
    why = F.when(F.col("base") % UNIT != 0, "unaligned").when((F.col("block_bytes") == 0) | (F.lit(UNIT) % F.nullif(F.col("block_bytes"), F.lit(0)) != 0), "block size")
    return regions.withColumn("refused", why.when(size % UNIT != 0, "extent").when(F.col("base") + size > (1 << 32) - 1, "overflow"))


def groups_valid(groups: DataFrame, total: int, centroid_bytes: int) -> DataFrame:
    """(volume, valid): 4 to 8 groups (volume, g, first, centroids, units) that are a partition in whole erase units."""
    ahead = F.lag(F.col("first") + F.col("centroids"), 1, 0).over(Window.partitionBy("volume").orderBy("g"))
    units = F.ceil(F.col("centroids") * centroid_bytes / UNIT)
    ok = (F.col("first") == F.col("ahead")) & (F.col("centroids") > 0) & (F.col("units") == units)
    marked = groups.withColumn("ahead", ahead).withColumn("ok", ok)
    return marked.groupBy("volume").agg((F.bool_and("ok") & F.count("*").between(4, 8) & (F.max(F.col("first") + F.col("centroids")) == total)).alias("valid"))


def layout(profiles: DataFrame) -> DataFrame:
    """profiles (m, b, d, n, copies) with the sizes of all regions in bytes and blocks."""
    up = lambda x, y: f"cast(ceil(({x}) / ({y})) as long)"
    steps = [
        ("payload_bytes", "cast(m * b div 8 as long)"), ("codebook_bytes", "cast(shiftleft(1, b) * d as long)"), ("table_bytes", "cast(4 * m * shiftleft(1, b) as long)"), ("macs", "cast(shiftleft(1, b) * d as long)"),
        ("per_block", f"{BLOCK} div payload_bytes"), ("slack", f"{BLOCK} - per_block * payload_bytes"), ("payload_blocks", up("n", "per_block")),
        ("blocks_per_record", up("d", BLOCK)), ("records_per_block", f"cast(greatest(1, {BLOCK} div d) as long)"), ("rerank_blocks", "cast(ceil(n / records_per_block) as long) * blocks_per_record"),
        ("payload_region", f"{up(f'payload_blocks * {BLOCK}', UNIT)} * {UNIT}"), ("crc_region", f"{up('payload_blocks * 4', UNIT)} * {UNIT}"), ("rerank_region", f"{up(f'rerank_blocks * {BLOCK}', UNIT)} * {UNIT}"),
        ("codebook_copy", f"{up('codebook_bytes', UNIT)} * {UNIT}"), ("replica_region", "(copies - 1) * codebook_copy"),
        ("stored_centi", "(payload_bytes + d) * 100 + 400 div per_block + 400 div records_per_block"), ("image_bytes", f"2 * codebook_bytes + {BLOCK + 4} * (payload_blocks + rerank_blocks)"),
    ]
    for name, sql in steps:
        profiles = profiles.withColumn(name, F.expr(sql).cast("long"))
    return profiles
