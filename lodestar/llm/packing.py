"""Packing whole documents into training sequences by non-negative least squares.

A document's ids (an end id added) are cut into full windows, which are sequences
by themselves, and one remainder shorter than the window. The histogram of the
remainders' lengths (at most ``window - 1`` numbers, whatever the corpus) goes to
the driver. There, shallow combinations of two or three lengths that exactly fill
a window are enumerated; non-negative least squares finds how often each should be
used so that together they use up the histogram; the counts are rounded down to
what there is. What is left is packed greedily: laid end to end and cut at the
window, so only one sequence of all has padding. Combinations touch only the
histogram; a remainder finds its sequence by its rank within its length, which
comes from counts by (task, length) and needs no global sort.

Defined results: null text is an empty document (just the end id); repeated rows
are packed each; an empty table gives no pieces; a null id is carried through.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, lean, save, slices, table, text_buffers
from .tokens import encoder, vocabulary

WINDOW, END_ID = 1024, 0
#: Lengths with the largest counts whose triples are enumerated; rounds of the solver.
TRIPLE_LENGTHS, ROUNDS = 24, 400


def combinations(hist: np.ndarray, window: int) -> np.ndarray:
    """Rows of 2 or 3 lengths (0: none) that fill the window, of lengths that occur."""
    there = hist > 0
    a = np.arange(1, window // 2 + 1)
    a = a[there[a] & there[window - a]]
    rows = [np.stack([a, window - a, np.zeros_like(a)], 1)]
    for x in np.argsort(-hist, kind="stable")[:TRIPLE_LENGTHS]:
        if hist[x] > 0 and window - x >= 2:
            b = np.arange(1, (window - x) // 2 + 1)
            c = window - x - b
            ok = there[b] & there[c]
            rows.append(np.sort(np.stack([np.full(ok.sum(), x), b[ok], c[ok]], 1), 1))
    return np.unique(np.concatenate(rows), axis=0)


def nnls(combos: np.ndarray, hist: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - hist|^2, A's columns being the
    combinations; multiplicative updates, which keep x non-negative and never raise
    the error."""
    if not len(combos):
        return np.zeros(0)
    h = hist.astype(float)
    h[0] = 0
    used = combos > 0
    back = lambda y: (y[combos] * used).sum(1)
    target = back(h)
    x = np.full(len(combos), h.sum() / max(1, 3 * len(combos)))
    for _ in range(rounds):
        y = np.bincount(combos.ravel(), (x[:, None] * used).ravel(), len(h))
        x = x * target / np.maximum(back(y), 1e-12)
    return x


def plan(hist: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Rules (length, first rank, ranks, first sequence, offset): rank k in the range
    stands at that offset of sequence first + k - first rank. Ranks beyond a length's
    rules are residuals."""
    left, taken = hist.astype(np.int64).copy(), np.zeros(len(hist), np.int64)
    left[0] = 0
    combos = combinations(hist, window)
    x = nnls(combos, hist)
    order = np.lexsort((np.arange(len(x)), -x))
    repeats = np.zeros(len(x), np.int64)
    for floor in (True, False):  # the rounded solution first, then greedily more of the same
        for i in order:
            lengths, counts = np.unique(combos[i][combos[i] > 0], return_counts=True)
            most = int((left[lengths] // counts).min())
            n = min(most, int(x[i])) if floor else most
            if n > 0:
                repeats[i] += n
                left[lengths] -= n * counts
    rules, sequence = [], 0
    for i in np.flatnonzero(repeats):
        offset = 0
        for length in combos[i][combos[i] > 0]:
            rules.append((int(length), int(taken[length]), int(repeats[i]), sequence, offset))
            taken[length] += repeats[i]
            offset += int(length)
        sequence += int(repeats[i])
    return rules


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces (id, start, length, ids_crc32, doc_tokens, sequence_id, offset, whole).

    ``whole`` tells whether the piece is a document's uncut remainder or full window."""
    path = tokenizer or vocabulary()
    id_type = docs.select(column(id_col)).schema[0].dataType.simpleString()
    packed = "<u2" if path.endswith(("50k.json", "49k.json", "32k.model")) else "<u4"

    def encode(batches):
        enc, part = encoder(path), TaskContext.get().partitionId()
        seen, full = np.zeros(window, np.int64), 0
        for batch in batches:
            buf, offs = text_buffers(batch.column(1))
            for a, b in slices(offs):
                raw = buf[offs[a] : offs[b]].tobytes()
                tokens, crcs, firsts, rems, ranks, lens, rem_crcs = [], [], [], [], [], [], []
                for i in range(a, b):
                    ids = enc.encode(raw[offs[i] - offs[a] : offs[i + 1] - offs[a]])
                    ids = np.append(ids, end_id).astype("<u4")
                    k, r = divmod(len(ids), window)
                    tokens.append(len(ids))
                    crcs.append([zlib.crc32(ids[j * window : (j + 1) * window].tobytes()) for j in range(k)])
                    firsts.append(full)
                    full += k
                    rem = ids[k * window :]
                    rems.append(rem.astype(packed).tobytes())
                    rem_crcs.append(zlib.crc32(rem.tobytes()))
                    lens.append(r)
                    ranks.append(int(seen[r]))
                    seen[r] += 1
                n = b - a
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, n), pa.array([part] * n, pa.int64()), pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(firsts, pa.int64()), pa.array(lens, pa.int32()), pa.array(ranks, pa.int64()), pa.array(rem_crcs, pa.int64()), pa.array(rems, pa.binary())],
                    ["id", "part", "doc_tokens", "crcs", "first", "r", "rank", "rem_crc", "rem"],
                )

    rows = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"))
    rows, _ = save(rows.mapInArrow(lean(encode), f"id {id_type}, part long, doc_tokens long, crcs array<long>, first long, r int, rank long, rem_crc long, rem binary"), "packed")

    counts, _ = save(rows.where("r > 0").groupBy("r", "part").agg(F.count("*").alias("n")), "lengths")
    hist = np.zeros(window, np.int64)
    for r in counts.groupBy("r").agg(F.sum("n").alias("n")).collect():  # at most window - 1 rows
        hist[r.r] = r.n
    rules = plan(hist, window)
    consumed = np.zeros(window, np.int64)
    for length, _first, n, _seq, _off in rules:
        consumed[length] += n
    residual = (hist - consumed) * np.arange(window)
    stream = np.concatenate([[0], np.cumsum(residual)[:-1]])
    combined = max([s + n for _, _, n, s, _ in rules], default=0)
    by_length: dict[int, np.ndarray] = {}
    for length in {x[0] for x in rules}:
        by_length[length] = np.array(sorted(x[1:] for x in rules if x[0] == length), np.int64)
    bits = 40  # full windows: (task, number within it); then combinations; then residuals

    def place(batches):
        base = 1 << 62
        for batch in batches:
            cols = {k: batch.column(i) for i, k in enumerate(batch.schema.names)}
            r, rank = cols["r"].to_numpy(), cols["rank"].to_numpy() + cols["base"].to_numpy()
            part, first, total = cols["part"].to_numpy(), cols["first"].to_numpy(), cols["doc_tokens"].to_numpy()
            crcs, rems, rem_crc = cols["crcs"].to_pylist(), cols["rem"], cols["rem_crc"].to_numpy()
            out: list[list] = [[] for _ in range(8)]

            def put(i, *values):
                for col, v in zip(out, (i, *values), strict=True):
                    col.append(v)

            for i in range(len(r)):
                n = int(total[i])
                for j, crc in enumerate(crcs[i]):
                    put(i, j * window, window, crc, n, (int(part[i]) << bits) + int(first[i]) + j, 0, True)
                length, k, start = int(r[i]), int(rank[i]), n - int(r[i])
                if not length:
                    continue
                if k < consumed[length]:
                    rule = by_length[length]
                    f, _, seq, off = rule[np.searchsorted(rule[:, 0], k, "right") - 1]
                    put(i, start, length, int(rem_crc[i]), n, base + int(seq) + k - int(f), int(off), True)
                    continue
                at = int(stream[length]) + (k - int(consumed[length])) * length
                ids, done = np.frombuffer(rems[i].as_py(), packed).astype("<u4"), 0
                while done < length:
                    seq, off = divmod(at + done, window)
                    m = min(length - done, window - off)
                    put(i, start + done, m, zlib.crc32(ids[done : done + m].tobytes()), n, base + combined + seq, off, m == length)
                    done += m
            take = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([cols["id"].take(take), *(pa.array(c, pa.int64()) for c in out[1:7]), pa.array(out[7], pa.bool_())], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "whole"])

    before = Window.partitionBy("r").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("r", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    joined = rows.join(bases, ["r", "part"], "left").select("id", "part", "doc_tokens", "crcs", "first", "r", "rank", "rem_crc", "rem", F.coalesce("base", F.lit(0)).alias("base"))
    return joined.mapInArrow(lean(place), f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, whole boolean").withColumnRenamed("id", id_col)


def op1_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "whole")
