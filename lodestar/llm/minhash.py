"""Near-duplicate documents by MinHash with tensored banding.

Two collections of SKETCHES small sketches (BAND minima each) are computed once;
every pair of one sketch of each collection is a table key. 2 * 12 sketches, 72
minima, so stand for 144 tables of 6 minima, which would need 864. Two documents of
similarity s share a table unless all sketches of a collection differ: at s = 0.85
that happens to 2 pairs in 100,000, at 0.9 to 1 in 10 million.

Documents with equal shingle sets are one class from the start. Classes whose
sketches are all alone drop out before any pair of sketches is formed; buckets with
the same members are one bucket. Classes that buckets chain together are a cluster,
and links are looked for, on full shingle sets, inside clusters only, by blocks of
at most BLOCK classes: a block's intersections are one matrix product, and it gives
back only links that join components. In a cluster of several blocks, members are
first compared with their buckets' smallest member. A cluster none of whose buckets
then holds two components is done: no pair that shares a table is left. The others
are compared as a whole or bucket by bucket, whichever takes fewer comparisons (a
dense group is one of the first kind, a long chain of small buckets of the second);
either way, what belongs to the largest component there is never compared with
itself, only with the rest. No group is held by one task, no list of a group's pairs
is ever made, and nothing that the tables show is lost.

Defined results: null or white-only text has an empty set, is linked with nothing
and is its own component; fewer than five words form one shingle; repeated rows are
one class; a null id takes part and is smaller than none (a component of null ids
only has a null id and its rows are kept); an empty table gives an empty table; texts
of any length are taken whole; only the two named columns are read, so others may
have any name.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, column, drop, lean, mix64, save, signed, slices, splitmix, table, text_buffers, word_hashes, word_spans

SHINGLE, SKETCHES, BAND, BLOCK = 5, 12, 3, 128
_STEP = splitmix(SHINGLE, 77)
_FACTORS, _SALTS = splitmix(2 * SKETCHES * BAND, 1) | np.uint64(1), splitmix(2 * SKETCHES * BAND, 2)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending, and their offsets."""
    n = len(offs) - 1
    low = LOWER[buf]
    start, end, doc = word_spans(low, offs)
    h = word_hashes(low, start, end)
    per = np.bincount(doc, minlength=n)
    m = len(h)
    lead = np.cumsum(per) - per
    rest = per[doc] - (np.arange(m) - lead[doc])  # words of the document from this one on
    s = np.zeros(m, np.uint64)
    for j in range(k):
        part = h[j:] * _STEP[j]
        part[rest[: m - j] <= j] = 0  # only in documents of fewer than k words
        s[: m - j] += part
    first = (rest >= k) | ((per[doc] < k) & (rest == per[doc]))
    s = mix64(s[first] + np.minimum(per[doc[first]], k).astype(np.uint64))
    d = doc[first]
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    s, d = s[new], d[new]
    return s, np.concatenate([[0], np.cumsum(np.bincount(d, minlength=n))])


def signatures(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(128-bit set keys as two columns, sketches) of the non-empty documents."""
    starts = at[:-1][np.diff(at) > 0]
    if not len(starts):
        return np.zeros((0, 2), np.uint64), np.zeros((0, 2 * SKETCHES), np.uint64)
    key = np.stack([np.add.reduceat(mix64(sets ^ np.uint64(0xA5A5)), starts), np.bitwise_xor.reduceat(mix64(sets + np.uint64(0x1234567)), starts)], 1)
    out = np.zeros((len(starts), 2 * SKETCHES), np.uint64)
    for i in range(2 * SKETCHES):
        for j in range(i * BAND, (i + 1) * BAND):
            out[:, i] = out[:, i] * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((sets ^ _SALTS[j]) * _FACTORS[j], starts)
    return key, mix64(out + np.arange(2 * SKETCHES, dtype=np.uint64))


def components(edges: DataFrame) -> DataFrame:
    """(c, root) of every node of the edges (a, b): large-star and small-star rounds
    on minima and joins, no neighbourhood is ever collected."""
    spark = edges.sparkSession
    e, path = save(edges.select("a", "b").where("a <> b").distinct(), "edges")
    if not e.take(1):
        return e.select(F.col("a").alias("c"), F.col("b").alias("root"))
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large, p1 = save(large, "large")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        small = down.groupBy("a").agg(F.min("b").alias("m"))
        new = down.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).distinct()
        new, p2 = save(new, "small")
        drop(spark, path, p1)
        e, path = new, p2
        # stars already: every node points to one other, and none of those to any
        ends = e.select("a", F.lit(1).alias("from"), F.lit(0).alias("to")).union(e.select(F.col("b").alias("a"), F.lit(0).alias("from"), F.lit(1).alias("to")))
        ends = ends.groupBy("a").agg(F.sum("from").alias("from"), F.max("to").alias("to"))
        if not ends.where("from > 1 or (from = 1 and to = 1)").take(1):
            tops = e.select(F.col("b").alias("c"), F.col("b").alias("root")).distinct()
            return e.select(F.col("a").alias("c"), F.col("b").alias("root")).union(tops)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) with 100 * intersection >= percent * union of the full sets."""

    def test(batches):
        for batch in batches:
            xs, ys = batch.column(2), batch.column(3)
            ok = np.zeros(len(batch), bool)
            for i in range(len(batch)):
                x, y = (np.frombuffer(v[i].as_buffer(), np.uint64) for v in (xs, ys))
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    x = sets.select(F.col("c").alias("a"), F.col("s").alias("x"))
    y = sets.select(F.col("c").alias("b"), F.col("s").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(lean(test), "a binary, b binary")


def joins(sets: list[np.ndarray], roots: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Pairs of rows that are linked and join components of different roots; a spanning choice."""
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    order: dict[bytes, int] = {}
    comp = np.array([order.setdefault(r, len(order)) for r in roots])
    if len(order) < 2:
        return []
    row = np.repeat(np.arange(n), size)
    values, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(df > 1) - 1
    keep = df[inverse] > 1
    row, col = row[keep], shared[inverse[keep]]
    by = np.argsort(col, kind="stable")
    row, col = row[by], col[by]
    both, width, last = np.zeros((n, n), np.float32), 8192, int(col[-1]) + 1 if len(col) else 0
    for c in range(0, last, width):
        lo, hi = np.searchsorted(col, [c, c + width])
        x = np.zeros((n, min(width, last - c)), np.float32)
        x[row[lo:hi], col[lo:hi] - c] = 1
        both += x @ x.T
    ok = 100 * both.astype(np.int64) >= percent * (size[:, None] + size[None, :] - both.astype(np.int64))
    i, j = np.nonzero(np.triu(ok, 1) & (comp[:, None] != comp[None, :]))
    found = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        if comp[a] != comp[b]:
            found.append((a, b))
            comp[comp == comp[b]] = comp[a]
    return found


def _link_blocks(batches, percent: int):
    """Rows (block, class, root, set) in block order to links (a, b)."""
    held: list[tuple] = []

    def flush():
        found = joins([np.frombuffer(x[3], np.uint64) for x in held], [x[2] for x in held], percent)
        return pa.RecordBatch.from_arrays([pa.array([held[i][1] for i, _ in found], pa.binary()), pa.array([held[j][1] for _, j in found], pa.binary())], ["a", "b"])

    for batch in batches:
        for x in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if held and x[0] != held[-1][0]:
                if len(held) > 1:
                    yield flush()
                held = []
            if not held or held[-1][1] != x[1]:
                held.append(x)
    if len(held) > 1:
        yield flush()


def _groups(rows: DataFrame) -> DataFrame:
    """(g, id, m, k): members and those of the largest component, of groups with several; rows (g, id, root)."""
    per = rows.groupBy("g", "id", "root").agg(F.count("*").alias("n"))
    return per.groupBy("g", "id").agg(F.sum("n").alias("m"), F.max("n").alias("k")).where("m > k")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id, kept, text_hash) of every row."""
    spark = docs.sparkSession
    id_type = docs.select(column(id_col)).schema[0].dataType.simpleString()
    texts = docs.select(column(id_col).alias("id"), F.xxhash64(column(text_col)).alias("h"), column(text_col).cast("string").alias("text"))

    def sign(batches):
        for batch in batches:
            buf, offs = text_buffers(batch.column(2))
            for a, b in slices(offs):
                sets, at = shingle_sets(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                n = np.diff(at)
                key, sketches = signatures(sets, at)
                there = n > 0
                where = np.where(there, np.cumsum(there) - 1, 0)
                empty = pa.array(~there)
                keys = pa.array([key[i].tobytes() for i in range(len(key))] or [b""], pa.binary()).take(pa.array(where))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1) * 2 * SKETCHES, pa.int32()), pa.array(signed(sketches.ravel()))) if len(key) else pa.array([[]], pa.list_(pa.int64()))
                none = lambda x: pa.compute.if_else(empty, pa.scalar(None, x.type), x)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n.astype(np.int64)), none(keys), none(lists.take(pa.array(where)))], ["id", "h", "n", "c", "sk"])

    rows, _ = save(texts.mapInArrow(lean(sign), f"id {id_type}, h long, n long, c binary, sk array<long>"), "signatures")
    classes = rows.where("n > 0").groupBy("c").agg(F.min(F.struct("id", "h")).alias("rep"), F.first("n").alias("n"), F.first("sk").alias("sk"))
    classes, p_classes = save(classes, "classes")

    # sketches met by one class only can't be part of a shared table key
    sk = classes.select("c", "n", F.posexplode("sk").alias("pos", "key"))
    shared = sk.groupBy("pos", "key").agg(F.count("*").alias("m")).where("m > 1").select("pos", "key")
    left = sk.join(shared, ["pos", "key"]).groupBy("c", "n").agg(F.collect_set(F.when(F.col("pos") < SKETCHES, F.col("key"))).alias("x"), F.collect_set(F.when(F.col("pos") >= SKETCHES, F.col("key"))).alias("y"))
    keyed = left.select("c", "n", F.explode("x").alias("kx"), "y").select("c", "n", "kx", F.explode("y").alias("ky")).select("c", "n", F.xxhash64("kx", "ky").alias("t"))
    keyed, p_keyed = save(keyed, "tables")
    members = keyed.groupBy("t").agg(F.count("*").alias("m"), F.expr("bit_xor(xxhash64(c))").alias("x"), F.expr("bit_xor(xxhash64(c, 1))").alias("y"), F.min("c").alias("center")).where("m > 1")
    once = members.groupBy("m", "x", "y").agg(F.min_by("t", "t").alias("t"), F.min_by("center", "t").alias("center"))
    buckets, p_buckets = save(keyed.join(once.select("t", "center"), "t"), "buckets")
    drop(spark, p_keyed)

    # full sets of one document of each class that shares a bucket
    wanted = buckets.select("c").distinct().join(classes.select("c", "rep"), "c").select("c", F.col("rep.id").alias("i"), F.col("rep.h").alias("g"))

    def full(batches):
        for batch in batches:
            buf, offs = text_buffers(batch.column(1))
            for a, b in slices(offs):
                sets, at = shingle_sets(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([sets[at[i] : at[i + 1]].tobytes() for i in range(b - a)], pa.binary())], ["c", "s"])

    # repeated rows give a class's set more than once: one row of them is enough
    source = texts.join(wanted.hint("shuffle_hash"), (texts["h"] == wanted["g"]) & texts["id"].eqNullSafe(wanted["i"])).select("c", "text")
    sets, p_sets = save(source.mapInArrow(lean(full), "c binary, s binary"), "sets")
    if sets.groupBy("c").count().where("count > 1").take(1):
        sets, p_sets = save(sets.groupBy("c").agg(F.first("s").alias("s")), "sets")

    # clusters of several blocks: members against their buckets' smallest
    parts = components(buckets.select(F.col("c").alias("a"), F.col("center").alias("b"))).withColumnRenamed("root", "g")
    parts, p_parts = save(parts, "clusters")
    large = parts.groupBy("g").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK)
    sizes = classes.select(F.col("c").alias("b"), F.col("n").alias("nb"))
    star = buckets.where("c <> center").select(F.col("c").alias("a"), F.col("center").alias("b"), "n").distinct()
    star = star.join(parts.join(large, "g").select(F.col("c").alias("a")), "a").join(sizes, "b").where(100 * F.least("n", "nb") >= percent * F.greatest("n", "nb")).select("a", "b")
    edges, _ = save(verified(star, sets, percent), "star")
    near, p_near = save(parts.join(components(edges), "c", "left").select("g", "c", F.coalesce("root", "c").alias("root")), "roots")
    # pairs that share a table but no component yet, by cluster and by bucket
    where = buckets.select("t", "c").join(near, "c")
    by_bucket = _groups(where.withColumn("id", F.xxhash64("t", F.lit(1))))
    by_cluster = _groups(near.withColumn("id", F.xxhash64("g", F.lit(2))))
    cost = lambda m, top: F.sum(m * (m - top))
    left = by_bucket.groupBy("g").agg(cost(F.col("m"), F.col("k")).alias("sparse")).join(by_cluster.groupBy("g").agg(cost(F.col("m"), F.col("k")).alias("dense")), "g")
    left, p_left = save(left.select("g", (F.col("dense") <= F.col("sparse")).alias("whole")), "left")
    some = near.join(left.where("whole").select("g"), "g").select(F.xxhash64("g", F.lit(2)).alias("g"), "c", "root")
    some = some.union(where.join(left.where("not whole").select("g"), "g").join(by_bucket.select(F.col("id").alias("t2")), F.xxhash64("t", F.lit(1)) == F.col("t2"), "leftsemi").select(F.xxhash64("t", F.lit(1)).alias("g"), "c", "root"))
    some, p_some = save(some, "compared")
    # in large groups, members of the largest component meet only the others
    per = some.groupBy("g", "root").agg(F.count("*").alias("k"))
    top = per.groupBy("g").agg(F.max(F.struct("k", "root")).alias("top"), F.sum("k").alias("m")).where(F.col("m") > BLOCK).select("g", F.col("top.root").alias("top"), F.ceil(F.col("top.k") / (BLOCK // 2)).alias("nb"), F.ceil((F.col("m") - F.col("top.k")) / (BLOCK // 2)).alias("ns"))
    placed = some.join(top, "g", "left").withColumn("in_top", F.coalesce(F.col("root") == F.col("top"), F.lit(False)))
    slot = F.when(F.col("top").isNull(), 0).otherwise(F.pmod(F.xxhash64("c", F.lit(3)), F.when(F.col("in_top"), F.col("nb")).otherwise(F.greatest("ns", F.lit(1)))))
    placed = placed.withColumn("slot", slot.cast("int"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    mine = F.col("slot")
    cells = (
        F.when(F.col("top").isNull(), F.array(cell(0, F.lit(0), F.lit(0))))
        .when(F.col("in_top"), F.transform(upto(F.col("ns")), lambda i: cell(1, i, mine)))
        .otherwise(F.concat(F.transform(upto(F.col("nb")), lambda j: cell(1, mine, j)), F.transform(upto(F.col("ns")), lambda j: cell(2, F.least(mine, j), F.greatest(mine, j)))))
    )
    work = placed.select("g", "c", "root", F.explode(cells).alias("cell")).select(F.xxhash64("g", "cell").alias("w"), "c", "root")
    work = work.join(sets, "c").select("w", "c", "root", "s").repartition("w").sortWithinPartitions("w", "c")
    more, _ = save(work.mapInArrow(lean(functools.partial(_link_blocks, percent=percent)), "a binary, b binary"), "links")
    roots = components(edges.union(more))
    drop(spark, p_sets, p_parts, p_buckets, p_near, p_left, p_some)

    # the smallest id of a component, by way of its classes
    first = rows.where("n > 0 and id is not null").groupBy("c").agg(F.min("id").alias("low"))
    linked = classes.select("c").join(first, "c", "left").join(roots, "c", "left").select("c", "low", F.coalesce("root", "c").alias("root"))
    lows = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    of_class, _ = save(linked.join(lows, "root").select("c", "component_id"), "components")
    out = rows.select("id", "h", "n", "c").join(of_class, "c", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), F.col("h").alias("text_hash"))


def op9_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
