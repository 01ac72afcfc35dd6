"""Removal of repeated byte strings by suffix arrays of shards.

Every byte covered by a string of ``length`` bytes (op5: LENGTH) that also starts
anywhere else (in any document, the same one included) is removed. Suffix arrays over
all of a corpus are out of reach, so content decides what a suffix array must see:

1. Anchors. Of the gram hashes in the window's positions from p on, the least one
   (leftmost) is the anchor of the string at p. Equal strings have equal anchors at
   equal distances, followed by equal bytes, the key, so a string whose anchor's key
   occurs once in the corpus is not repeated. An anchor owns a run of such positions;
   their strings together are its segment. Equal segments are counted, not compared.
2. Shards. Where a key occurs in several different segments, one of each goes
   to a shard with the others. A segment that itself occurs twice is repeated whole
   (it has weight 2 in the suffix array); the others are decided by the shard's suffix
   array, sorted by Larsson-Sadakane refinement in numpy (ranks of doubled depth, only
   in groups not yet single), and Kasai's common prefixes of its neighbours.
3. Merge. Keys with more than GROUP different segments are dealt to several shards by
   segment. What a shard leaves undecided is merged across shards: each shard gives one
   fingerprint of each distinct window, sorted, cut into a range of values for every
   RANGE shards, and binary search in the merged order finds those that another shard has.

Defined results: null text is empty; texts under ``length`` bytes keep everything;
repeated rows are texts of their own, so both lose what is ``length`` bytes or longer;
cut bytes may split a character, the rest of which the text output drops (the
digests are of the exact bytes); columns named like the outputs are replaced; texts
longer than PIECE are looked at in overlapping parts and cut as a whole; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Poly, column, drop, lean, mix64, save, signed, table, text_buffers

LENGTH, GRAM, MOST_OWNED = 400, 32, 1 << 12
PIECE, SHARD, GROUP, RANGE = 1 << 20, 1 << 19, 256, 2
_PRINT = np.dtype([("wa", "<u8"), ("wb", "<u8"), ("h1", "<i8"), ("h2", "<i8"), ("p", "<i8"), ("need", "u1")])
TIMES = (1 << 20) - 1  # a count less one: a piece's windows start at PIECE positions at most
_A, _B = Poly(0xA11CE), Poly(0xB0B)


def shape(length: int) -> tuple[int, int, int]:
    """(positions of a window, bytes of a key, bytes of a gram) for strings of ``length`` bytes."""
    window = max(1, min(length * 18 // 25, MOST_OWNED))
    key = length - window + 1
    return window, key, min(GRAM, key)


def pieces(offs: np.ndarray, length: int = LENGTH, limit: int = PIECE):
    """(rows, first byte, one past the last) of slices of whole documents, or of overlapping parts of a longer one."""
    n, a = len(offs) - 1, 0
    while a < n:
        b = min(max(int(np.searchsorted(offs, offs[a] + limit, "right")) - 1, a + 1), n)
        if b == a + 1 and offs[b] - offs[a] > limit:
            for c in range(int(offs[a]), int(offs[b]), limit):
                yield a, b, c, min(int(offs[b]), c + limit + length - 1)
        else:
            yield a, b, int(offs[a]), int(offs[b])
        a = b


def anchors(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH) -> dict[str, np.ndarray]:
    """Segments of the documents of a slice: document, p0, each (positions owned), times, kh, sh.
    Adjacent equal segments are one row that counts them."""
    n = len(buf)
    window, key, gram = shape(length)
    empty = {k: np.zeros(0, np.int64) for k in ("doc", "p0", "each", "times", "kh", "sh")}
    if n < length:
        return empty
    a, b = _A.prefix(buf), _B.prefix(buf)
    m = n - gram + 1
    start = np.arange(m)
    low = np.uint64((1 << 23) - 1)  # more than a piece has
    x = (mix64(_A.spans(a, start, start + gram)) & ~low) | start.astype(np.uint64)
    s = 1
    while s < window:
        more = min(s, window - s)
        x = np.minimum(x[:-more], x[more:])
        s += more
    at = (x & low).astype(np.int64)  # anchor of each position
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    p = np.arange(min(len(at), n - length + 1))
    p = p[doc[p] == doc[p + length - 1]]
    if not len(p):
        return empty
    new = np.ones(len(p), bool)
    new[1:] = (at[p[1:]] != at[p[:-1]]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    p0, size = p[first], np.diff(np.append(first, len(p)))
    anchor = at[p0]
    kh = mix64(_A.spans(a, anchor, anchor + key) ^ _B.spans(b, anchor, anchor + key) * np.uint64(0x9E3779B97F4A7C15))
    end = p0 + size - 1 + length
    sh = mix64(_B.spans(b, p0, end) + mix64(_A.spans(a, p0, end)) + size.astype(np.uint64))
    # periodic texts: equal segments one after another
    new = np.ones(len(p0), bool)
    new[1:] = (kh[1:] != kh[:-1]) | (sh[1:] != sh[:-1]) | (p0[1:] != p0[:-1] + size[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(p0)))
    return {"doc": doc[p0[first]], "p0": p0[first], "each": size[first], "times": times, "kh": signed(kh[first]), "sh": signed(sh[first])}


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(array, ranks) by Larsson-Sadakane refinement: doubled depths, only unsorted groups."""
    n = len(symbols)
    base, depth = int(symbols.max()) + 2, 1
    while base ** (depth + 1) < 1 << 62:
        depth += 1
    padded = np.concatenate([symbols.astype(np.int64) + 1, np.zeros(depth, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(depth):
        key *= base
        key += padded[j : j + n]
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    del key, padded
    rank = np.empty(n, np.int32)
    head = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    rank[order] = head
    places = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(places):
        rows, group = order[places], head[places]
        behind = rows + depth
        second = np.where(behind < n, rank[np.minimum(behind, n - 1)], -1)
        joint = group.astype(np.int64) * (n + 1) + second + 1
        sub = np.argsort(joint)
        rows, joint = rows[sub], joint[sub]
        order[places] = rows
        fresh = np.ones(len(rows), bool)
        fresh[1:] = joint[1:] != joint[:-1]
        # a group's first place is its rank; groups are runs of places
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(rows)), 0))
        head[places] = places[first]
        rank[rows] = head[places]
        places = places[~(fresh & np.append(fresh[1:], True))]
        depth *= 2
    return order, rank


def kasai(data: np.ndarray, order: np.ndarray, rank: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common prefixes of each suffix with the one before and the one after it in the array.

    ``rest``: bytes up to the end of the suffix's own text. By Kasai's rule a prefix is its left
    neighbour's in the text less one where the two suffixes have the same byte before them;
    only the others are compared, all at once and eight bytes at a time."""
    n = len(data)
    phi = np.full(n, -1, np.int64)
    phi[order[1:]] = order[:-1]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(n, "<u8", padded.data, strides=(1,))
    at = np.arange(n)
    follows = (at > 0) & (phi > 0)
    follows[1:] &= (rest[:-1] == rest[1:] + 1) & (phi[:-1] >= 0)
    prior = np.maximum(phi - 1, 0)
    follows &= (rest[prior] == rest[np.maximum(phi, 0)] + 1) & (data[np.maximum(at - 1, 0)] == data[prior])
    i = np.flatnonzero(~follows & (phi >= 0))
    j, most = phi[i], np.minimum(rest[i], rest[phi[i]])
    found, h, live = np.zeros(n, np.int64), np.zeros(len(i), np.int64), np.arange(len(i))
    while len(live):
        a, b = i[live] + h[live], j[live] + h[live]
        x = eight[np.minimum(a, n - 1)] ^ eight[np.minimum(b, n - 1)]
        low = np.log2(np.maximum(x & (~x + np.uint64(1)), np.uint64(1)).astype(np.float64)).astype(np.int64) >> 3
        h[live] = np.minimum(h[live] + np.where(x == 0, 8, low), most[live])
        live = live[(x == 0) & (h[live] < most[live])]
    found[i] = h
    source = np.maximum.accumulate(np.where(follows, 0, at))
    before = np.where(phi >= 0, found[source] - (at - source), 0)
    after = np.zeros(n, np.int64)
    later = rank + 1 < n
    after[later] = before[order[rank[later] + 1]]
    return before, after


def decide(texts: list[bytes], owned: np.ndarray, weight: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a shard's segments: (segment, position, repeated here, first of its equals) of every owned position."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    offs = np.concatenate([[0], np.cumsum(size + 1)])
    symbols = np.empty(offs[-1], np.int64)
    is_end = np.zeros(offs[-1], bool)
    is_end[offs[1:] - 1] = True
    joined = np.frombuffer(b"".join(texts), np.uint8)
    there = np.zeros(256, bool)
    there[joined] = True
    symbols[~is_end] = (np.cumsum(there) - 1)[joined] + len(texts)
    symbols[is_end] = np.arange(len(texts))  # every end is a symbol of its own
    data = np.zeros(offs[-1], np.uint8)
    data[~is_end] = joined
    rest = np.repeat(offs[1:] - 1, size + 1) - np.arange(offs[-1])
    order, rank = suffix_array(symbols)
    before, after = kasai(data, order, rank, rest)
    segment = np.repeat(np.arange(len(texts)), owned)
    position = np.arange(len(segment)) - np.repeat(np.cumsum(owned) - owned, owned)
    at = offs[segment] + position
    return segment, position, (before[at] >= length) | (after[at] >= length) | (weight[segment] > 1), before[at] < length


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """docs' columns with ``text_col`` cut where ``length`` bytes repeat, and n_bytes, n_removed, n_spans, kept_sha256."""
    spark = docs.sparkSession
    docs = docs.select(*[column(c) for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept_sha256")])
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    keyed = docs.withColumns({"__h1": F.xxhash64(text), "__h2": F.xxhash64(F.lit(1), text)})
    rows = keyed.select(F.col("__h1").alias("h1"), F.col("__h2").alias("h2"), text.alias("text"))

    def segments(batches):
        for batch in batches:
            h1, h2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            buf, offs = text_buffers(batch.column(2))
            for a, b, c, d in pieces(offs, length):
                part = np.clip(offs[a : b + 1], c, d) - c
                s = anchors(buf[c:d], part, length)
                doc = s["doc"] + a
                p0 = s["p0"] + c - offs[doc]
                # bits: a text's bytes 31, a window's positions 13, equal segments of a piece one after another less one 20
                at = (p0 << 33) | (s["each"].astype(np.int64) << 20) | (s["times"] - 1)
                yield pa.RecordBatch.from_arrays([pa.array(s["kh"]), pa.array(s["sh"]), pa.array(h1[doc]), pa.array(h2[doc]), pa.array(at)], ["kh", "sh", "h1", "h2", "at"])

    found, p_found = save(rows.mapInArrow(lean(segments), "kh long, sh long, h1 long, h2 long, at long"), "segments")
    times, each, p0 = F.col("at").bitwiseAND(F.lit(TIMES)) + 1, F.shiftright("at", 20).bitwiseAND(F.lit(2 * MOST_OWNED - 1)), F.shiftrightunsigned("at", 33)
    # most keys occur once: what is left of the others is small
    often = found.groupBy("kh").agg(F.sum(times).alias("w")).where("w > 1").select("kh")
    found, p_shared = save(found.join(often, "kh").select("kh", "sh", "h1", "h2", times.alias("times"), each.alias("each"), p0.alias("p0")), "shared")
    drop(spark, p_found)
    kinds = found.groupBy("kh", "sh").agg(F.sum("times").alias("w"), F.min(F.struct("h1", "h2", "p0", "each")).alias("at"))
    kinds, p_kinds = save(kinds, "kinds")
    keys = kinds.groupBy("kh").agg(F.count("*").alias("d"), F.min("w").alias("lo")).where("d > 1 and lo = 1").select("kh", "d")
    wanted = kinds.join(keys, "kh").select("kh", "sh", "w", "d", "at.h1", "at.h2", "at.p0", "at.each")
    wanted = wanted.groupBy("h1", "h2").agg(F.collect_list(F.struct("kh", "sh", "w", "d", "p0", "each")).alias("segs"))

    def fetch(batches):
        for batch in batches:
            texts = batch.column(1)
            out: list[list] = [[] for _ in range(9)]
            for i, segs in enumerate(batch.column(0).to_pylist()):
                raw, h = texts[i].as_buffer(), (batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
                for s in segs:
                    for col, v in zip(out, (s["kh"], s["sh"], s["w"], s["d"], *h, s["p0"], s["each"], raw[s["p0"] : s["p0"] + s["each"] - 1 + length].to_pybytes()), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:8]), pa.array(out[8], pa.binary())], ["kh", "sh", "w", "d", "h1", "h2", "p0", "each", "s"])

    one = rows.groupBy("h1", "h2").agg(F.first("text").alias("text"))  # copies are thrown away before they meet
    texts = one.join(wanted.hint("shuffle_hash"), ["h1", "h2"]).select("segs", "text", "h1", "h2")
    cut = texts.mapInArrow(lean(fetch), "kh long, sh long, w long, d long, h1 long, h2 long, p0 long, each long, s binary")
    shard = F.when(F.col("d") > GROUP, F.pmod("sh", F.ceil(F.col("d") / GROUP))).otherwise(F.lit(0))
    cut = cut.withColumn("g", shard).repartition("kh", "g").sortWithinPartitions("kh", "g", "sh")

    names = ["h1", "h2", "p0", "n", "kh", "part", "prints"]

    def runs(h1, h2, p):
        """Runs of positions of texts."""
        order = np.lexsort((p, h2, h1))
        h1, h2, p = h1[order], h2[order], p[order]
        new = np.ones(len(p), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (p[1:] != p[:-1] + 1)
        f = np.flatnonzero(new)
        n, none = np.diff(np.append(f, len(p))), pa.nulls(len(f), pa.int64())
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x[f])) for x in (h1, h2, p)), pa.array(n), none, none, pa.nulls(len(f), pa.binary())], names)

    def decide_shards(batches):
        held: list[tuple] = []
        size, last = 0, None

        def flush():
            kh, w, d, h1, h2, p0, each = (np.array([x[i] for x in held], np.int64) for i in (0, 2, 3, 4, 5, 6, 7))
            strings = [x[8] for x in held]
            seg, pos, repeated, first = decide(strings, each, w, length)
            hit = repeated & (w[seg] == 1)
            yield runs(h1[seg[hit]], h2[seg[hit]], (p0[seg] + pos)[hit])
            more = np.flatnonzero(first & (d[seg] > GROUP))
            if not len(more):
                return
            at = np.concatenate([[0], np.cumsum([len(s) for s in strings])])[seg[more]] + pos[more]
            data, prints = np.frombuffer(b"".join(strings), np.uint8), np.empty(len(more), _PRINT)
            for name, k in (("wa", _A), ("wb", _B)):
                prints[name] = mix64(k.spans(k.prefix(data), at, at + length))
            seg = seg[more]
            prints["h1"], prints["h2"], prints["p"], prints["need"] = h1[seg], h2[seg], p0[seg] + pos[more], ~repeated[more]
            ranges = -(-d[seg] // (GROUP * RANGE))
            part = (prints["wa"] >> np.uint64(32)) * ranges.astype(np.uint64) >> np.uint64(32)
            by = np.lexsort((prints["wa"], part, kh[seg]))
            prints, part, keys = prints[by], part[by].astype(np.int64), kh[seg][by]
            edge = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (part[1:] != part[:-1])]))
            parts = [prints[a:b].tobytes() for a, b in zip(edge, [*edge[1:], len(keys)], strict=True)]
            none = pa.nulls(len(edge), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(keys[edge]), pa.array(part[edge]), pa.array(parts, pa.binary())], names)

        for batch in batches:
            for x in zip(*(batch.column(i).to_pylist() for i in range(10)), strict=True):
                if held and x[:2] == held[-1][:2]:
                    continue
                if size > SHARD and (x[0], x[9]) != last:
                    yield from flush()
                    held, size = [], 0
                held.append(x)
                size, last = size + len(x[8]), (x[0], x[9])
        if held:
            yield from flush()

    decided, p_decided = save(cut.mapInArrow(lean(decide_shards), "h1 long, h2 long, p0 long, n long, kh long, part long, prints binary"), "decided")

    def merge(batches):
        held, last = [], None

        def flush():
            got = np.sort(np.concatenate([np.frombuffer(x, _PRINT) for x in held]), order=("wa", "wb"))
            same = (got["wa"][1:] == got["wa"][:-1]) & (got["wb"][1:] == got["wb"][:-1])
            hit = got[(np.append(same, False) | np.append(False, same)) & (got["need"] > 0)]
            return runs(hit["h1"], hit["h2"], hit["p"]).select(["h1", "h2", "p0", "n"])

        for batch in batches:
            for kh, part, prints in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held and (kh, part) != last:
                    yield flush()
                    held = []
                held.append(prints)
                last = (kh, part)
        if held:
            yield flush()

    prints = decided.where("prints is not null").select("kh", "part", "prints").repartition("kh", "part").sortWithinPartitions("kh", "part")
    across = prints.mapInArrow(lean(merge), "h1 long, h2 long, p0 long, n long")
    whole = found.join(kinds.where("w > 1").select("kh", "sh"), ["kh", "sh"]).select("h1", "h2", "p0", (F.col("each") * F.col("times")).alias("n"))
    spans = whole.union(decided.where("prints is null").select("h1", "h2", "p0", "n")).union(across)
    spans, _ = save(spans.groupBy("h1", "h2").agg(F.collect_set(F.struct("p0", "n")).alias("__spans")), "spans")
    drop(spark, p_shared, p_kinds, p_decided)

    columns = docs.columns
    where = columns.index(text_col)
    schema = docs.schema
    inner = [f"c{i}" for i in range(len(columns))]
    joined = keyed.join(spans.hint("shuffle_hash"), (keyed["__h1"] == spans["h1"]) & (keyed["__h2"] == spans["h2"]), "left").select(*[keyed[f"`{c}`"].alias(i) for c, i in zip(columns, inner, strict=True)], "__spans")

    def cut_out(batches):
        for batch in batches:
            buf, offs = text_buffers(batch.column(where))
            out, removed, runs, digests = [], [], [], []
            for i, marks in enumerate(batch.column(len(columns)).to_pylist()):
                raw = buf[offs[i] : offs[i + 1]]
                if not marks:
                    kept, n = raw.tobytes(), 0
                else:
                    edge = np.zeros(len(raw) + 1, np.int64)
                    lo = np.array([m["p0"] for m in marks], np.int64)
                    hi = lo + np.array([m["n"] for m in marks], np.int64) - 1 + length
                    np.add.at(edge, lo, 1)
                    np.add.at(edge, hi, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    kept = raw[~gone].tobytes()
                    n = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                removed.append(len(raw) - len(kept))
                runs.append(n)
                digests.append(hashlib.sha256(kept).hexdigest())
                out.append(kept.decode("utf-8", "ignore"))
            texts = pa.array(out, pa.string())
            if batch.column(where).null_count:
                texts = pa.compute.if_else(batch.column(where).is_null(), pa.scalar(None, pa.string()), texts)
            cols = [*batch.columns[:where], texts, *batch.columns[where + 1 : len(columns)]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(offs)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests)], [*inner, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    ddl = ", ".join(f"{i} {'string' if k == where else f.dataType.simpleString()}" for k, (i, f) in enumerate(zip(inner, schema, strict=True)))
    return joined.mapInArrow(lean(cut_out), f"{ddl}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").toDF(*columns, "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_suffix_array_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
