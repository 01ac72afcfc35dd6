"""Faults in stored codes, what they do to recall, and how protection is allocated against them."""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MASK = (1 << 64) - 1
#: Marks of rows of a clean list and of the truth in place of a code.
_WAS, _TRUE = -1, -2


def xorshift(state: int, count: int, shifts: tuple[int, int, int] = (12, 25, 27), multiplier: int = 0x2545F4914F6CDD1D) -> list[int]:
    """Values of a seeded xorshift* generator; (13, 7, 17) with multiplier 1 is the plain one."""
    out = []
    a, b, c = shifts
    for _ in range(count):
        if multiplier == 1:
            state ^= (state << a) & _MASK
            state ^= state >> b
            state ^= (state << c) & _MASK
        else:
            state ^= state >> a
            state ^= (state << b) & _MASK
            state ^= state >> c
        out.append(state * multiplier & _MASK)
    return out


def flip_codes(codes: DataFrame, flips: DataFrame) -> DataFrame:
    """(vec_id, j, code) with the masks of (vec_id, j, mask) applied, several of one place together."""
    masks = flips.groupBy("vec_id", "j").agg(F.expr("bit_xor(mask)").alias("mask"))
    return codes.join(masks, ["vec_id", "j"], "left").select("vec_id", "j", F.col("code").bitwiseXOR(F.coalesce("mask", F.lit(0))).alias("code"))


def torn_write(data: Column, valid: Column) -> Column:
    """A hexadecimal text of bytes of which only the first ``valid`` were written; the rest stays erased."""
    return F.concat(F.substring(data, F.lit(1), 2 * valid), F.repeat(F.lit("FF"), (F.length(data) / 2).cast("int") - valid))


def kill(data: Column, fill: str) -> Column:
    """All bytes of a hexadecimal text lost to a fill value (00 or FF)."""
    return F.repeat(F.lit(fill), (F.length(data) / 2).cast("int"))


def aims(codes: DataFrame, truth: DataFrame, j: int) -> DataFrame:
    """(qid, neighbour, outsider): the centroid of the nearest true neighbour in subspace j, and the fullest
    one that no true neighbour uses, the first on ties; codes (vec_id, j, code)."""
    mine = codes.where(F.col("j") == j).select("vec_id", F.col("code").alias("c"))
    used = truth.join(mine, "vec_id").groupBy("qid").agg(F.min_by("c", "rank").alias("neighbour"), F.collect_set("c").alias("used"))
    full = mine.groupBy("c").agg(F.count("*").alias("n"))
    # at most 2**b rows, one a centroid
    order = full.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "c"))), lambda x: x["c"]).alias("order"))
    return used.crossJoin(F.broadcast(order)).select("qid", "neighbour", F.get(F.filter("order", lambda c: ~F.array_contains("used", c)), F.lit(0)).alias("outsider"))


def compared(clean: DataFrame, hurt: DataFrame, truth: DataFrame, codes: DataFrame, aim: Column, k: int) -> DataFrame:
    """(qid, clean_hits, hurt_hits, intruders) of two candidate lists; intruders are new ones of the damaged centroid.
    codes (vec_id, code) are those of the damaged subspace, ``aim`` tests them."""
    t = truth.where(F.col("rank") <= k).select("qid", "vec_id")
    hits = lambda found, name: t.join(found.select("qid", "vec_id"), ["qid", "vec_id"], "leftsemi").groupBy("qid").agg(F.count("*").alias(name))
    new = hurt.select("qid", "vec_id").join(clean.select("qid", "vec_id"), ["qid", "vec_id"], "leftanti").join(codes, "vec_id").where(aim)
    out = t.select("qid").distinct()
    for part in (hits(clean, "clean_hits"), hits(hurt, "hurt_hits"), new.groupBy("qid").agg(F.count("*").alias("intruders"))):
        out = out.join(part, "qid", "left")
    return out.na.fill(0)


def loss_bound(depths: DataFrame, intruders: DataFrame, r: int, k: int) -> DataFrame:
    """(qid, bound): the share of true neighbours at risk: those that use the damaged centroid, and, if there are
    intruders, those deeper than r less their number; depths (qid, depth, affected), of the first k."""
    rows = depths.join(intruders.select("qid", "intruders"), "qid", "left").na.fill(0, ["intruders"])
    risk = F.col("affected") | ((F.col("intruders") > 0) & (F.col("depth") > F.greatest(F.lit(0), r - F.col("intruders"))))
    return rows.groupBy("qid").agg((F.least(F.count_if(risk), F.lit(k)) / k).alias("bound"))


def ranked_weights(exposure: DataFrame) -> DataFrame:
    """exposure (c, inflate, deflate) with weight, the larger of the two, and rank, ties by centroid."""
    # at most 2**b rows
    out = exposure.withColumn("weight", F.greatest("inflate", "deflate"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("weight"), "c")))


def envelope(rates: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The lower convex envelope of (cost, residual): each step protects less a byte than the one before.

    Of equal costs the lower residual counts."""
    best: dict[int, int] = {}
    for cost, residual in rates:
        best[cost] = min(residual, best.get(cost, residual))
    points = [p for i, p in enumerate(sorted(best.items())) if all(p[1] < q[1] for q in sorted(best.items())[:i])]
    # a point is on the envelope unless one before and one after it span a line that is not above it
    below = lambda a, p, b: (b[1] - a[1]) * (p[0] - a[0]) <= (p[1] - a[1]) * (b[0] - a[0])
    return [p for i, p in enumerate(points) if not any(below(a, p, b) for a, b in itertools.product(points[:i], points[i + 1 :]))]


def allocate(weights: dict[int, int], sizes: dict[int, int], rates: list[tuple[int, int]], budget: int) -> dict[int, tuple[int, int]]:
    """group -> (cost, residual): the step of the best gain a byte next, while the budget lasts; rates are
    (cost of 256 bytes, residual). At most eight groups, on the driver."""
    steps = {g: envelope([(c * sizes[g] // 256, r) for c, r in rates]) for g in weights}
    at = dict.fromkeys(weights, 0)
    spent = sum(s[0][0] for s in steps.values())
    while True:
        open_steps = []
        for g, s in steps.items():
            if at[g] + 1 < len(s):
                extra, gain = s[at[g] + 1][0] - s[at[g]][0], weights[g] * (s[at[g]][1] - s[at[g] + 1][1])
                if spent + extra <= budget:
                    open_steps.append((gain // extra, gain, -g, extra))
        if not open_steps:
            return {g: s[at[g]] for g, s in steps.items()}
        _, _, g, extra = max(open_steps)
        at[-g] += 1
        spent += extra


def verdicts(claims: DataFrame) -> DataFrame:
    """claims (predicted, measured, tolerance) with relative_error (null against zero) and verdict."""
    off = F.when(F.col("predicted") != 0, F.abs(F.col("measured") - F.col("predicted")) / F.abs("predicted"))
    holds = F.coalesce(off <= F.col("tolerance"), F.col("measured") == 0)
    return claims.withColumn("relative_error", off).withColumn("verdict", F.when(holds, "holds").otherwise("refuted"))


def draws(seed: int, count: int) -> list[tuple[int, int]]:
    """(place, bit) of ``count`` faults: a longer list of one seed starts with the shorter one."""
    values = [v >> 1 for v in xorshift(seed, 2 * count)]
    return [(place, bit % 8) for place, bit in zip(values[::2], values[1::2], strict=True)]


def flip_book(w: np.ndarray, faults: list[tuple[int, int]]) -> np.ndarray:
    """int8 centroids [subspace, centroid, component] with one bit flipped a fault, places modulo the size."""
    flat = w.astype(np.int8).ravel().view(np.uint8).copy()
    for place, bit in faults:
        flat[place % len(flat)] ^= np.uint8(1 << bit)
    return flat.view(np.int8).reshape(w.shape)


def kill_unit(w: np.ndarray, place: int, unit: int) -> tuple[np.ndarray, int]:
    """Centroids with one erase unit of ``unit`` bytes lost (0xFF, as int8 -1), and how many bytes that are."""
    flat = w.astype(np.int8).ravel().copy()
    lo = place % -(-len(flat) // unit) * unit
    lost = len(flat[lo : lo + unit])
    flat[lo : lo + unit] = -1
    return flat.reshape(w.shape), lost


def flip_stored(codes: DataFrame, faults: list[tuple[int, int]], n: int, m: int, bits: int) -> DataFrame:
    """(vec_id, codes) with a bit of one code flipped a fault; place p is code p % m of row p div m, modulo n * m.

    The faults are a list on the driver, so their frame is as small as that and is broadcast."""
    masks: dict[int, list[int]] = {}
    for place, bit in faults if n else []:
        row, j = divmod(place % (n * m), m)
        masks.setdefault(row, [0] * m)[j] ^= 1 << bit % bits
    few = codes.sparkSession.createDataFrame(list(masks.items()), "vec_id long, masks array<int>")
    hit = codes.join(F.broadcast(few), "vec_id", "left")
    return hit.select("vec_id", F.when(F.col("masks").isNull(), F.col("codes")).otherwise(F.zip_with("codes", "masks", lambda c, x: c.bitwiseXOR(x))).alias("codes"))


def recall_after(found: DataFrame, truth: DataFrame, doses: DataFrame) -> DataFrame:
    """(doses' columns, recall): mean share of the true rows (qid, vec_id) that the lists found
    (doses' columns, qid, vec_id) hold; a list that lost all candidates counts as 0."""
    t = truth.select("qid", "vec_id")
    hits = found.join(t, ["qid", "vec_id"], "leftsemi").groupBy(*doses.columns).agg(F.count("*").alias("hits"))
    # a row a dose, and one row in all
    return doses.join(hits, doses.columns, "left").crossJoin(t.agg(F.count("*").alias("all"))).select(*doses.columns, F.try_divide(F.coalesce("hits", F.lit(0)), F.col("all")).alias("recall"))


def shift_sweep(few: DataFrame, clean: DataFrame, truth: DataFrame, k: int, delta: int, depth: int) -> DataFrame:
    """(qid, c, s, lost, intruders) of every centroid c of k with its score moved by s * delta, s = 1 or -1: true
    rows the list of ``depth`` loses, and new rows of that centroid in it.

    A shift changes the scores of one code only, so a shifted list is drawn from the best of that code and the best of
    the others: few (qid, vec_id, score, code) has the best ``depth`` rows of each code. A query's rows meet in one
    place, and all its shifts are made there, one query at a time."""
    parts = [few.select("qid", "vec_id", F.col("score").cast("long").alias("score"), F.col("code").cast("int").alias("code"))]
    parts += [x.select("qid", "vec_id", F.lit(None).cast("long").alias("score"), F.lit(mark).alias("code")) for x, mark in ((clean, _WAS), (truth, _TRUE))]
    # dealt anew by a key of its own: a union passes for partitioned as its parts are, which need not be alike at run time
    rows = functools.reduce(DataFrame.unionByName, parts).withColumn("deal", F.xxhash64("qid")).repartition("deal").sortWithinPartitions("qid", "vec_id").drop("deal")
    at, sign = np.repeat(np.arange(k), 2), np.tile([1, -1], k)

    def one(ids, score, code):
        was, true = ids[code == _WAS], ids[code == _TRUE]
        ids, score, code = (x[code >= 0] for x in (ids, score, code))
        if not len(ids) or not len(was) + len(true):
            return None
        moved = -(score[None] + (sign * delta)[:, None] * (code[None] == at[:, None]))
        top = np.argsort(moved, axis=1, kind="stable")[:, :depth]  # ids rise
        new = ~np.isin(ids, was)[top] & (code[top] == at[:, None])
        lost = np.isin(true, was).sum() - np.isin(ids, true)[top].sum(1)
        return np.maximum(0, lost), new.sum(1)

    def run(batches):
        left = None
        for batch in itertools.chain(batches, [None]):
            whole = left
            if batch is not None:
                table = pa.table({"qid": batch.column(0), "vec_id": batch.column(1), "score": pc.fill_null(batch.column(2), 0), "code": batch.column(3)})
                whole = table if left is None else pa.concat_tables([left, table])
            if whole is None or not len(whole):
                continue
            qid, ids, score, code = (c.to_numpy() for c in whole.columns)
            ends = np.append(np.flatnonzero(np.diff(qid)) + 1, len(qid))
            if batch is not None:  # its last query may go on in the next
                ends = ends[:-1]
            begin, out = 0, []
            for end in ends.tolist():
                got = one(ids[begin:end], score[begin:end], code[begin:end])
                if got is not None:
                    out.append((qid[begin], *got))
                begin = end
            left = whole.slice(begin)
            if out:
                q, lost, new = zip(*out, strict=True)
                cells = [np.repeat(np.array(q), 2 * k), np.tile(at, len(q)).astype(np.int32), np.tile(sign, len(q)).astype(np.int32), np.concatenate(lost).astype(np.int64), np.concatenate(new).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cells], ["qid", "c", "s", "lost", "intruders"])

    return rows.mapInArrow(run, "qid long, c int, s int, lost long, intruders long")


def exposure(seen: DataFrame) -> DataFrame:
    """(c, inflate, deflate): true rows lost by raising and by lowering each centroid, over all queries."""
    total = lambda s: F.sum(F.when(F.col("s") == s, F.col("lost")).otherwise(0))
    return seen.groupBy("c").agg(total(1).alias("inflate"), total(-1).alias("deflate"))


def findings(seen: DataFrame, truth: DataFrame, clean: DataFrame, codes: DataFrame, k: int, depth: int, top: int) -> DataFrame:
    """(claim, x, y, verdict: held, refuted or inconclusive) of what a sweep says about four claims:

    fan-out: raising the fullest centroid loses at least as much (x) as raising the emptiest used one (y);
    deflation channel: lowering the nearest true row's centroid loses rows (x) without intruders (y);
    directed sampling: that loses more (x) than lowering the next centroid (y);
    margin bridge: of both signs at that centroid, losses above their bound (x), of all losses (y).
    codes (vec_id, c) are those of the swept subspace."""
    pops = codes.groupBy("c").agg(F.count("*").alias("n"))
    # one row each
    ends = pops.agg(F.max_by("c", F.struct("n", "c")).alias("heavy"), F.min_by("c", F.struct("n", "c")).alias("light"), F.max("n").alias("most"), F.min("n").alias("least"))
    at = lambda name: F.sum(F.when(F.col("c") == F.col(name), F.col("lost")).otherwise(0))
    fan = seen.where("s = 1").crossJoin(F.broadcast(ends)).agg(at("heavy").alias("x"), at("light").alias("y"), F.max("most").alias("most"), F.max("least").alias("least"))
    fan = fan.select("x", "y", F.when(F.col("most") < 2 * F.col("least"), "inconclusive").when(F.col("x") >= F.col("y"), "held").otherwise("refuted").alias("verdict"))
    near = truth.where(F.col("rank") == 1).join(codes, "vec_id").select("qid", F.col("c").alias("near"))
    aimed = seen.join(near, "qid").withColumn("next", (F.col("near") + 1) % k)
    lower = aimed.where("s = -1")
    deflation = lower.where("c = near").agg(F.sum("lost").alias("x"), F.sum("intruders").alias("y"))
    deflation = deflation.select("x", "y", F.when(F.col("y") > 0, "refuted").when(F.col("x") > 0, "held").otherwise("inconclusive").alias("verdict"))
    directed = lower.agg(at("near").alias("x"), at("next").alias("y"))
    directed = directed.select("x", "y", F.when(F.col("x") > F.col("y"), "held").when((F.col("x") == 0) & (F.col("y") == 0), "inconclusive").otherwise("refuted").alias("verdict"))
    places = truth.select("qid", "vec_id").join(codes.withColumnRenamed("c", "code"), "vec_id").join(clean.select("qid", "vec_id", F.col("rank").alias("at")), ["qid", "vec_id"], "left")
    risk = ((F.col("s") == -1) & (F.col("code") == F.col("c"))) | ((F.col("intruders") > 0) & (F.coalesce(F.col("at") - 1, F.lit(depth)) > F.greatest(F.lit(0), depth - F.col("intruders"))))
    bounds = aimed.where("c = near").join(places, "qid").groupBy("qid", "s").agg(F.max("lost").alias("lost"), F.least(F.count_if(risk), F.lit(top)).alias("bound"))
    bridge = bounds.agg(F.count_if(F.col("lost") > F.col("bound")).alias("x"), F.count_if(F.col("lost") > 0).alias("y"))
    bridge = bridge.select("x", "y", F.when(F.col("y") == 0, "inconclusive").when(F.col("x") == 0, "held").otherwise("refuted").alias("verdict"))
    parts = (("fan-out", fan), ("deflation channel", deflation), ("directed sampling", directed), ("margin bridge", bridge))
    out = [part.select(F.lit(claim).alias("claim"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "verdict") for claim, part in parts]
    return functools.reduce(DataFrame.unionByName, out)
