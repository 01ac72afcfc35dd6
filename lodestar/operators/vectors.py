"""Vector search operators: narrowing, codebooks, encoding, tables, scans, rescoring.

Every scan scores ROWS rows by STEP queries at a time and keeps a task's best rows of
each query only, under the total order (score, then id); one shuffle by query then picks
the final ones. A score is a product of two rows, so of whole numbers it is exact in the
narrowest type that holds all its sums. Nothing is collected but the codebook and blocks
of queries, whose size is bounded by what a scan keeps of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed scale and limit of the int8 narrowing (see narrow()).
SCALE, PEAK = 40.0, 127
#: Queries that are scored in one scan at most, and best rows that it keeps in a task at most.
BLOCK, KEPT = 1 << 16, 1 << 21
#: Rows and queries that are scored at a time.
ROWS, STEP = 4096, 512


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, not once a lambda element."""
    return F.transform(F.array(value), body)[0]


def quantize_peak(v: Column) -> Column:
    """Narrow by the row's own peak: round(x / peak * 127); all zeros stay zeros."""
    peak = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    return let(F.struct(v.alias("v"), peak.alias("p")), lambda s: F.transform(s["v"], lambda x: F.when(s["p"] == 0, 0).otherwise(F.round(x.cast("double") / s["p"] * PEAK)).cast("int")))


def quantize_subspaces(v: Column, ds: int) -> Column:
    """Narrow with one integer ratio scale a subspace: num = max(1, ceil(extent)), den = 127."""
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / ds).cast("int") - 1), lambda j: F.slice(v, j * ds + 1, ds))
    num = lambda part: F.greatest(F.lit(1), F.ceil(F.array_max(F.transform(part, lambda x: F.abs(x.cast("double"))))))
    one = lambda part: let(F.struct(part.alias("p"), num(part).alias("n")), lambda s: F.transform(s["p"], lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") * 127 / s["n"]))).cast("int")))
    return F.flatten(F.transform(parts, one))


def narrow(v: Column, factor: Column | None = None) -> Column:
    """One global scale for all rows: clamp(round(x * SCALE), -127, 127)."""
    k = F.lit(SCALE) if factor is None else factor * SCALE
    return F.transform(v, lambda x: F.greatest(F.lit(-PEAK), F.least(F.lit(PEAK), F.round(x.cast("double") * k))).cast("int"))


def matrix(col: pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


class Best:
    """The best r rows so far of each of n queries, ties by smaller id; new ones wait until as many have come."""

    def __init__(self, n: int, r: int, kind=np.int64):
        self.n, self.r, self.warm = n, r, False
        self.q, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0, kind), np.zeros(0, np.int64)
        self.least = np.full(n, np.iinfo(np.int64).min if kind == np.int64 else -np.inf, kind)
        self.last = np.full(n, np.iinfo(np.int64).max)
        self.waiting: list[tuple] = []

    def offer(self, s: np.ndarray, ids: np.ndarray, exact=None, slack: np.ndarray | int = 0) -> None:
        """Scores [query, row]; if a query's are off by up to its ``slack``, exact(query, row) gives those of places."""
        least, slack = self.least.astype(s.dtype), np.asarray(slack, s.dtype)
        if s.dtype.kind == "f":
            least = np.nextafter(least, s.dtype.type(-np.inf)) - slack
        if not self.warm and len(ids) > self.r:
            cut = np.partition(s, len(ids) - self.r, axis=1)[:, len(ids) - self.r]
            least = np.maximum(least, cut - 2 * slack)
        at = np.flatnonzero(s >= least[:, None])
        q, c = np.divmod(at, len(ids))
        score = (s.ravel()[at] if exact is None else exact(q, c)).astype(self.score.dtype)
        better = (score > self.least[q]) | (score == self.least[q]) & (ids[c] < self.last[q])
        self.waiting.append((q[better], score[better], ids[c[better]]))
        if sum(len(w[0]) for w in self.waiting) >= self.n * self.r:
            self.merge()

    def merge(self) -> None:
        q, score, ids = (np.concatenate(x) for x in zip((self.q, self.score, self.ids), *self.waiting, strict=True))
        self.waiting = []
        order = np.lexsort((ids, -score, q))
        q = q[order]
        keep = np.arange(len(q)) - np.searchsorted(q, np.arange(self.n))[q] < self.r
        self.q, self.score, self.ids = q[keep], score[order[keep]], ids[order[keep]]
        size = np.bincount(self.q, minlength=self.n)
        full, end = size == self.r, np.cumsum(size) - 1
        self.least[full], self.last[full], self.warm = self.score[end[full]], self.ids[end[full]], bool(full.all())


def narrowest(x: np.ndarray) -> np.ndarray:
    """The same values in the smallest type that holds them."""
    for kind in (np.int8, np.int16, np.int32, np.float32):
        with np.errstate(invalid="ignore"):
            y = x.astype(kind)
        if (y == x).all():
            return y
    return x


def _pieces(batches, size: int):
    """(ids, vectors) of ``size`` rows each but the last, whatever the batches' sizes."""
    ids, x, n = [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, x, n = [*ids, batch.column(0).to_numpy()], [*x, matrix(batch.column(1))], n + batch.num_rows
        if n >= size:
            ids, x = np.concatenate(ids), np.concatenate(x)
            for at in range(0, n - n % size, size):
                yield ids[at : at + size], x[at : at + size]
            ids, x, n = [ids[n - n % size :]], [x[n - n % size :]], n % size
    if n:
        yield np.concatenate(ids), np.concatenate(x)


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left @ right.T of whole numbers, in the narrowest type in which no sum is rounded."""
    most = float(np.abs(left).max(0, initial=0).astype(float) @ np.abs(right).max(0, initial=0).astype(float))
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return left.astype(kind) @ right.astype(kind).T


def far(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Inner products, or negated squared distances, of pairs of rows, summed in the order of the components."""
    out = np.zeros(len(a))
    for t in range(a.shape[1]):
        out += a[:, t] * b[:, t] if metric == "ip" else -((a[:, t] - b[:, t]) ** 2)
    return out


def ranked(found: DataFrame, r: int, *keys: str) -> DataFrame:
    """(keys, qid, vec_id, score, rank): the best r of each query's lists, or of each query and value of the keys."""
    rank = F.row_number().over(Window.partitionBy(*keys, "qid").orderBy(F.desc("score"), "vec_id"))
    return found.select(*keys, "qid", "vec_id", "score").withColumn("rank", rank).where(F.col("rank") <= r)


def lists(corpus: DataFrame, vec: str, qids: np.ndarray, left, right, r: int, exact=None, by=None, groups: int = 1) -> DataFrame:
    """(qid, vec_id, score, code): a task's best r rows of each query by left() [query, f] times right(rows) [row, f], of
    whole numbers; exact(query, row vectors) scores floats, for which the product is off by its rounding.
    ``by``: the group (code) of each row, below ``groups``; the best r of each are kept."""
    kind = np.int64 if exact is None else np.float64

    def run(batches):
        all_ = left()
        best = [[Best(len(qids[at : at + STEP]), r, kind) for _ in range(groups)] for at in range(0, len(qids), STEP)]
        for ids, x in _pieces(batches, ROWS * min(groups, 4)):
            if exact is not None:
                finite = np.isfinite(x).all(1)  # a row that is not is no nearer than any
                ids, x = ids[finite], x[finite]
            feature, code = right(x), None if by is None else by(x)
            for g in range(groups):
                mine = slice(None) if by is None else np.flatnonzero(code == g)
                f, some = feature[mine], ids[mine]
                if not len(some):
                    continue
                for b, part in enumerate(best):
                    lo = b * STEP
                    queries = all_[lo : lo + STEP]
                    if exact is None:
                        part[g].offer(product(queries, f), some)
                        continue
                    y, s = x[mine], queries.astype(np.float32) @ f.astype(np.float32).T
                    slack = np.abs(queries) @ np.abs(f).max(0) * (f.shape[1] + 8) * 2.0**-23
                    score = lambda q, c, lo=lo, y=y: np.concatenate([np.zeros(0), *(exact(lo + q[i : i + (1 << 16)], y[c[i : i + (1 << 16)]]) for i in range(0, len(q), 1 << 16))])
                    part[g].offer(s, some, score, slack)
        for b, part in enumerate(best):
            for g, one in enumerate(part):
                one.merge()
                code = pa.array(np.full(len(one.q), g, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(qids[b * STEP + one.q]), pa.array(one.ids), pa.array(one.score), code], ["qid", "vec_id", "score", "code"])

    # as a task keeps its best rows only, few tasks for all cores leave less to shuffle
    some = corpus.select("vec_id", vec).coalesce(4 * corpus.sparkSession.sparkContext.defaultParallelism)
    return some.mapInArrow(run, f"qid long, vec_id long, score {'long' if exact is None else 'double'}, code int")


def query_block(queries: DataFrame, vec: str) -> tuple[np.ndarray, np.ndarray]:
    """A block of queries on the driver; query_blocks() splits larger batches."""
    got = queries.select("vec_id", vec).toArrow().sort_by("vec_id")
    return got.column(0).to_numpy(), matrix(got.column(1)).astype(np.float64)


def query_blocks(queries: DataFrame, vec: str, each: int = 1):
    """Blocks (ids, vectors) of at most about BLOCK queries, of which ``each`` rows are kept, dealt by a hash of the id;
    each takes one scan."""
    parts = -(-queries.count() // max(1, min(BLOCK, KEPT // each)))
    for b in range(parts):
        yield query_block(queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == b) if parts > 1 else queries, vec)


def in_blocks(queries: DataFrame, vec: str, scan, each: int, kind: str = "long") -> DataFrame:
    """The union of the lists of scan(ids, vectors) over blocks of queries."""
    out = None
    for qids, q in query_blocks(queries, vec, each):
        one = scan(qids, narrowest(q))
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = queries.sparkSession.createDataFrame([], f"qid long, vec_id long, score {kind}, code int")
    return out


def exact_search(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "ip", vec: str = "v", exact: bool = True) -> DataFrame:
    """Exact top-k by inner product, or by negated squared distance; ``exact``: of integers."""

    def scan(qids, q):
        kind = np.int64 if exact else np.float64

        def left():
            a = q.astype(kind)
            return a if metric == "ip" else np.column_stack([2 * a, np.full(len(a), -1), -(a * a).sum(1)])

        def right(x):
            a = x.astype(kind)
            return a if metric == "ip" else np.column_stack([a, (a * a).sum(1), np.ones(len(a), kind)])

        floats = None if exact else lambda at, rows: far(q[at].astype(np.float64), rows.astype(np.float64), metric)
        return lists(corpus, vec, qids, left, right, k, floats)

    return ranked(in_blocks(queries, vec, scan, k, "long" if exact else "double"), k)


class Codebook:
    """Integer centroids [subspace, centroid, component]; of bounded size."""

    def __init__(self, w: np.ndarray):
        self.w = w.astype(np.int64)
        self.m, self.k, self.ds = w.shape

    @staticmethod
    def of_rows(rows: DataFrame, m: int, vec: str = "v") -> "Codebook":
        """Centroid c of each subspace is the sub-vector of the c-th row by id."""
        _, x = query_block(rows, vec)
        return Codebook(x.reshape(len(x), m, -1).transpose(1, 0, 2))

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Nearest centroid of each sub-vector, the lowest on ties."""
        parts = x.astype(np.float64).reshape(len(x), self.m, self.ds)
        out = np.empty((len(x), self.m), np.int32)
        for j in range(self.m):
            w = self.w[j].astype(np.float64)
            out[:, j] = ((w * w).sum(1)[None, :] - 2 * parts[:, j] @ w.T).argmin(1)
        return out

    def tables(self, q: np.ndarray, metric: str) -> np.ndarray:
        """[query, subspace, centroid]: inner products, or 2 <q, c> - <c, c>."""
        parts = q.reshape(len(q), self.m, self.ds).astype(np.int64)
        ip = np.einsum("qjt,jct->qjc", parts, self.w)
        return ip if metric == "ip" else 2 * ip - (self.w**2).sum(2)[None]

    def lloyd(self, corpus: DataFrame, rounds: int, vec: str = "v") -> "Codebook":
        """k-means rounds: per-batch sums, one aggregate of m * k rows; empty clusters keep their place."""
        book = self
        for _ in range(rounds):

            def sums(batches, book=book):
                s, n = np.zeros(book.w.shape), np.zeros(book.w.shape[:2], np.int64)
                for batch in batches:
                    x = matrix(batch.column(0))
                    codes = book.encode(x)
                    parts = x.reshape(len(x), book.m, book.ds)
                    for j in range(book.m):
                        np.add.at(s[j], codes[:, j], parts[:, j])
                        n[j] += np.bincount(codes[:, j], minlength=book.k)
                j, c = np.nonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(j), pa.array(c), pa.array(n[j, c]), pa.array(s[j, c].tolist(), pa.list_(pa.float64()))], ["j", "c", "n", "s"])

            got = corpus.select(vec).mapInArrow(sums, "j long, c long, n long, s array<double>").groupBy("j", "c").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[t]).alias(f"s{t}") for t in range(book.ds)]).collect()
            w = book.w.astype(float).copy()
            for r in got:
                w[r.j, r.c] = [r[f"s{t}"] / r.n for t in range(book.ds)]
            new = Codebook(np.rint(w))
            if (new.w == book.w).all():
                break
            book = new
        return book


def encode(corpus: DataFrame, book: Codebook, vec: str = "v") -> DataFrame:
    """(vec_id, codes); a narrow stage."""

    def run(batches):
        for batch in batches:
            codes = book.encode(matrix(batch.column(1)).reshape(len(batch), book.m * book.ds))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * book.m, pa.int32()), pa.array(codes.ravel()))], ["vec_id", "codes"])

    return corpus.select("vec_id", vec).mapInArrow(run, "vec_id long, codes array<int>")


def adc_scan(codes: DataFrame, queries: DataFrame, book: Codebook, r: int, metric: str = "l2", vec: str = "v", shift: tuple[int, int, int] | None = None, by: int | None = None) -> DataFrame:
    """Compressed scan to r candidates a query; a code beyond the table adds nothing.
    ``shift``: (subspace, centroid, amount) added to the score of all rows with that code.
    ``by``: a subspace, of whose every code the best r are kept, with a column code."""
    found = adc_lists(codes, queries, book, r, metric, vec, shift, by)
    return ranked(found, r) if by is None else ranked(found.repartition("qid"), r, "code")


def adc_lists(codes: DataFrame, queries: DataFrame, book: Codebook, r: int, metric: str = "l2", vec: str = "v", shift: tuple[int, int, int] | None = None, by: int | None = None) -> DataFrame:
    """(qid, vec_id, score, code): what each task of adc_scan() finds, for ranked().

    What the tables add up to is the product with the centroids of the codes, side by side."""

    def scan(qids, q):
        def left():
            a = q.astype(np.int64)
            parts = [a] if metric == "ip" else [2 * a, np.full((len(a), 1), -1)]
            return np.column_stack(parts + ([np.full((len(a), 1), shift[2])] if shift else []))

        def right(x):
            c = x.astype(np.int64).reshape(len(x), book.m)
            ok = (c >= 0) & (c < book.k)
            w = (book.w[np.arange(book.m), np.clip(c, 0, book.k - 1)] * ok[:, :, None]).reshape(len(c), book.m * book.ds)
            parts = [w] if metric == "ip" else [w, (w * w).sum(1)]
            return np.column_stack(parts + ([c[:, shift[0]] == shift[1]] if shift else []))

        code = None if by is None else lambda x: x.reshape(len(x), book.m)[:, by]
        return lists(codes, "codes", qids, left, right, r, None, code, 1 if by is None else book.k)

    return in_blocks(queries, vec, scan, r if by is None else r * book.k)


def scored(pairs: DataFrame, records: DataFrame, queries: DataFrame, vec: str = "v", metric: str = "ip", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, qid, vec_id, score): exact scores of pairs whose record is stored."""
    far = F.aggregate(F.zip_with("q", "v", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s - x)
    dot = F.aggregate(F.zip_with("q", "v", lambda a, b: a.cast("long") * b), F.lit(0).cast("long"), lambda s, x: s + x)
    q = queries.select(F.col("vec_id").alias("qid"), F.col(vec).alias("q"))
    met = pairs.select(*keep, "qid", "vec_id").join(records.select("vec_id", F.col(vec).alias("v")), "vec_id").join(q, "qid")
    return met.select(*keep, "qid", "vec_id", (dot if metric == "ip" else far).alias("score"))


def rerank(candidates: DataFrame, records: DataFrame, queries: DataFrame, k: int, vec: str = "v", metric: str = "ip", tags: tuple[str, ...] = ()) -> DataFrame:
    """Exact scores of candidates whose record is stored; absent ones drop, nothing fills their place.
    ``metric``: ip of integers, or l2: negated squared distances of floats. ``tags``: columns that tell lists apart."""
    return ranked(scored(candidates, records, queries, vec, metric, tags), k, *tags)


def rerank_lists(found: DataFrame, n: int, records: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """rerank() of n lists, up to 63, with a column list, its number: found (qid, vec_id, mask) has a bit for each list
    that a row is in. What several lists hold is scored once."""
    pairs = scored(found.groupBy("qid", "vec_id").agg(F.bit_or("mask").alias("mask")), records, queries, keep=("mask",))
    each = F.explode(F.filter(F.lit(list(range(n))), lambda i: F.getbit(F.col("mask"), i) == 1)).alias("list")
    return ranked(pairs.select(each, "qid", "vec_id", "score"), k, "list")


def search(corpus: DataFrame, codes: DataFrame, queries: DataFrame, book: Codebook, k: int, r: int, metric: str = "l2") -> DataFrame:
    """Two stages: compressed scan to r candidates, exact rescore of those, top k."""
    return rerank(adc_scan(codes, queries, book, r, metric), corpus, queries, k)


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, hits, recall): found rows of rank <= k that truth's first k have, over min(k, truth's size)."""
    t = truth.where(F.col("rank") <= k)
    size = t.groupBy("qid").agg(F.least(F.count("*"), F.lit(k)).alias("size"))
    hits = found.where(F.col("rank") <= k).join(t.select("qid", "vec_id"), ["qid", "vec_id"], "leftsemi").groupBy("qid").agg(F.count("*").alias("hits"))
    return size.join(hits, "qid", "left").select("qid", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), (F.coalesce("hits", F.lit(0)) / F.col("size")).alias("recall"))


def score_histogram(corpus: DataFrame, queries: DataFrame, vec: str = "v") -> DataFrame:
    """(score, n) of all queries' integer inner products with all rows: counts only leave a task."""
    out = None
    for _, q in query_blocks(queries, vec):
        q = narrowest(q)

        def run(batches, q=q):
            score, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for _, x in _pieces(batches, ROWS):
                for at in range(0, len(q), STEP):
                    s, one = np.unique(product(q[at : at + STEP].astype(np.int64), x.astype(np.int64)).astype(np.int64), return_counts=True)
                    score, place = np.unique(np.concatenate([score, s]), return_inverse=True)
                    n = np.bincount(place, np.concatenate([n, one]), len(score)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(score), pa.array(n)], ["score", "n"])

        one = corpus.select("vec_id", vec).mapInArrow(run, "score long, n long")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("score").agg(F.sum("n").alias("n"))


def percentiles(histogram: DataFrame, at: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles, one row, of values counted in (score, n)."""
    w = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    # distinct integer scores: bounded by the arithmetic, not by the rows
    run = histogram.withColumn("upto", F.sum("n").over(w)).crossJoin(histogram.agg(F.sum("n").alias("all")))
    return run.agg(*[F.min(F.when(F.col("upto") >= F.ceil(F.lit(share) * F.col("all")), F.col("score"))).alias(name) for name, share in at.items()])
