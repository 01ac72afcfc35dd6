"""What a query holds, repeats or shuffles must not grow faster than its tables."""

import functools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.operators import codes as C
from lodestar.operators import damage
from lodestar.operators import vectors as V


def test_overlapping_pairs_are_met_once_and_not_sorted_out_later(spark, monkeypatch):
    monkeypatch.setattr(C, "SLICE", 8)
    rng = np.random.default_rng(5)
    rows = [(str(i), int(b), int(e)) for i, (b, e) in enumerate(zip(rng.integers(-300, 3000, 120), rng.integers(0, 90, 120) * rng.integers(0, 5, 120), strict=True))]
    rows += [("x", 100, 50)] * 2 + [(f"y{i}", 500, 40) for i in range(30)] + [("big", 0, 100_000), ("none", None, 5)]
    known = [r for r in rows if r[1] is not None]
    want = sorted((a, b) for a, ab, ae in known for b, bb, be in known if a < b and ab < bb + be and bb < ab + ae)
    got = C.intervals_overlap(spark.createDataFrame(rows, "name string, base long, extent long"))
    assert sorted(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert not any("Aggregate" in line for line in plan.split("SortMergeJoin" if "SortMergeJoin" in plan else "Join")[0].splitlines())
    assert C.intervals_overlap(spark.createDataFrame([], "name string, base long, extent long")).count() == 0


@pytest.fixture(scope="module")
def corpus(spark):
    """Far more rows than a batch has; many equal scores, and one row in four the same."""
    rng = np.random.default_rng(2)
    x = rng.integers(-6, 7, (9000, 8))
    x[::4] = 3
    return x, spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, v array<int>").repartition(2)


def _best(s, r):
    return [list(np.lexsort((np.arange(s.shape[1]), -row))[:r]) for row in s]


def test_a_scan_keeps_its_best_rows_in_blocks_and_pieces(spark, corpus, monkeypatch):
    x, rows = corpus
    queries, q = rows.where("vec_id % 450 = 0"), x[::450]
    book = V.Codebook.of_rows(rows.where("vec_id between 1 and 3 or vec_id = 5"), 2)
    near = np.concatenate([book.w[j][c] for j, c in enumerate(book.encode(x).T)], 1)
    code = book.encode(x)[:, 1]
    score = {"ip": q @ x.T, "l2": -((q[:, None] - x[None]) ** 2).sum(2)}
    adc = 2 * q @ near.T - (near**2).sum(1)
    for block, step, size in ((V.BLOCK, V.STEP, V.ROWS), (7, 3, 500)):
        monkeypatch.setattr(V, "BLOCK", block)
        monkeypatch.setattr(V, "STEP", step)
        monkeypatch.setattr(V, "ROWS", size)
        lists = lambda found: [[r.vec_id for r in sorted(found[int(i)], key=lambda r: r["rank"])] for i in range(0, 9000, 450)]
        per = lambda df: functools.reduce(lambda d, r: d.setdefault(r.qid, []).append(r) or d, df.collect(), {})
        for metric, s in score.items():
            assert lists(per(V.exact_search(rows, queries, 12, metric))) == _best(s, 12)
            floats = rows.select("vec_id", F.transform("v", lambda c: c / F.lit(8.0)).alias("v"))
            assert lists(per(V.exact_search(floats, floats.where("vec_id % 450 = 0"), 12, metric, exact=False))) == _best(s, 12)
        codes = V.encode(rows, book)
        assert lists(per(V.adc_scan(codes, queries, book, 12))) == _best(adc, 12)
        assert lists(per(V.adc_scan(codes, queries, book, 12, shift=(1, 2, 50)))) == _best(adc + 50 * (code == 2), 12)
        grouped = V.adc_scan(codes, queries, book, 3, by=1).collect()
        for c in range(4):
            mine = np.flatnonzero(code == c)
            want = [mine[b].tolist() for b in _best(adc[:, mine], 3)]
            assert [[r.vec_id for r in sorted((r for r in grouped if r.qid == i and r.code == c), key=lambda r: r["rank"])] for i in range(0, 9000, 450)] == want
        got = dict(map(tuple, V.score_histogram(rows, queries).collect()))
        values, n = np.unique(score["ip"], return_counts=True)
        assert got == dict(zip(values.tolist(), n.tolist(), strict=True))


def test_what_a_scan_holds_does_not_grow_with_its_rows(spark, corpus):
    x, rows = corpus
    shapes = []

    class Seen(V.Best):
        def offer(self, s, *args):
            shapes.append((*s.shape, sum(len(w[0]) for w in self.waiting)))
            super().offer(s, *args)

    q = np.repeat(x[:900], 2, axis=0)
    best = Seen(len(q[: V.STEP]), 5)
    for ids, some in V._pieces([pa.RecordBatch.from_pydict({"vec_id": np.arange(len(x)), "v": x.tolist()})], V.ROWS):
        best.offer(V.product(q[: V.STEP], some), ids)
    assert all(a * b <= V.ROWS * V.STEP and waiting < best.n * best.r for a, b, waiting in shapes)
    # a task sends the best rows of each query once, not once a batch
    sent = V.lists(rows.repartition(1), "v", np.arange(900), lambda: x[:900], lambda y: y.astype(np.int64), 5)
    assert sent.count() == 900 * 5


def test_products_are_exact_in_any_type():
    for size in (100, 10**5, 10**9):
        a, b = np.full((2, 3), size), np.array([[size, -size, 1], [1, 1, -size]])
        want = [[int(sum(int(u) * int(v) for u, v in zip(p, r, strict=True))) for r in b] for p in a]
        assert V.product(a, b).astype(np.int64).tolist() == want
    assert V.narrowest(np.array([[300.0]])).dtype == np.int16 and V.narrowest(np.array([[0.1]])).dtype == np.float64


def test_equal_floats_are_ranked_by_id(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 64))
    x[rng.integers(0, 6000, 3000)] = x[0]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, v array<double>").repartition(1)
    got = V.exact_search(rows, rows.where("vec_id = 0"), 20, "l2", exact=False).orderBy("rank").collect()
    assert [r.vec_id for r in got] == np.flatnonzero((x == x[0]).all(1))[:20].tolist() and {r.score for r in got} == {0.0}


def test_a_shift_sweep_multiplies_no_rows(spark):
    few = spark.createDataFrame([(q, v, 50 - v, v % 4) for q in range(40) for v in range(12)], "qid long, vec_id long, score long, code int").repartition(3, "qid")
    clean, truth = few.where("vec_id < 3"), few.where("vec_id in (0, 5)")
    seen = damage.shift_sweep(few, clean, truth, 4, 100, 3)
    plan = seen._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan
    # one centroid raised: its rows alone; lowered: the next ones of the others
    for r in seen.collect():
        now = [v for v in range(12) if v % 4 == r.c][:3] if r.s == 1 else [v for v in range(12) if v % 4 != r.c][:3]
        assert (r.lost, r.intruders) == (max(0, 1 - len({0, 5} & set(now))), sum(v > 2 and v % 4 == r.c for v in now))


def test_candidates_of_many_lists_are_scored_once(spark, corpus):
    x, rows = corpus
    queries = rows.where("vec_id in (0, 450)")
    lists = [[(q, v) for q in (0, 450) for v in range(lo, lo + 40)] for lo in (1, 1, 20)]
    marked = [(*pair, 1 << i) for i, found in enumerate(lists) for pair in found]
    found = spark.createDataFrame(marked, "qid long, vec_id long, mask long")
    got = V.rerank_lists(found, 3, rows.where("vec_id <> 7"), queries, 5)
    for i, pairs in enumerate(lists):
        want = V.rerank(spark.createDataFrame(pairs, "qid long, vec_id long"), rows.where("vec_id <> 7"), queries, 5)
        cols = ["qid", "vec_id", "score", "rank"]
        assert sorted(got.where(F.col("list") == i).select(cols).collect()) == sorted(want.select(cols).collect())
