import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.operators import codes as C
from lodestar.operators import damage
from lodestar.operators import integrity as I
from lodestar.operators import vectors as V


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(v, [((13 * v + 7 * j) % 41) - 20 for j in range(16)]) for v in range(300)]
    return spark.createDataFrame(rows, "vec_id long, v array<int>")


def test_exact_search_agrees_with_brute_force(corpus):
    x = np.array([[((13 * v + 7 * j) % 41) - 20 for j in range(16)] for v in range(300)])
    queries = corpus.where("vec_id < 4")
    for metric, s in (("ip", x[:4] @ x.T), ("l2", -((x[:4, None] - x[None]) ** 2).sum(2))):
        got = {(r.qid, r["rank"]): (r.vec_id, r.score) for r in V.exact_search(corpus, queries, 5, metric).collect()}
        for q in range(4):
            order = np.lexsort((np.arange(300), -s[q]))[:5]
            assert [got[q, k + 1] for k in range(5)] == [(i, s[q, i]) for i in order]


def test_full_depth_two_stage_search_is_exact(corpus):
    queries = corpus.where("vec_id < 3")
    book = V.Codebook.of_rows(corpus.where("vec_id < 16"), 4)
    two = V.search(corpus, V.encode(corpus, book), queries, book, 5, 300)
    cols = ["qid", "vec_id", "score", "rank"]
    assert sorted(two.select(cols).collect()) == sorted(V.exact_search(corpus, queries, 5).select(cols).collect())


def test_dropped_candidates_are_not_replaced(corpus):
    queries = corpus.where("vec_id < 2")
    cand = V.exact_search(corpus, queries, 4)
    lost = cand.where("rank = 1").select("vec_id")
    assert V.rerank(cand, corpus.join(lost, "vec_id", "leftanti"), queries, 4).count() <= 6


def test_lloyd_never_raises_the_error(corpus):
    x = np.array([r.v for r in corpus.orderBy("vec_id").collect()])
    book = V.Codebook.of_rows(corpus.where("vec_id < 8"), 4)

    def error(b):
        c = b.encode(x)
        return sum(((x.reshape(300, 4, 4)[:, j] - b.w[j][c[:, j]]) ** 2).sum() for j in range(4))

    assert error(book.lloyd(corpus, 3)) <= error(book)


def test_rotation_is_undone(spark):
    df = spark.createDataFrame([(1, [3, -5, 7, 1, 0, 2, -9, 4])], "id long, v array<int>")
    there = df.select("v", C.rotate(F.col("v"), 8, 2).alias("w")).select("v", C.unrotate(F.col("w"), 8, 2).alias("u"))
    r = there.first()
    assert list(r.v) == list(r.u)


def test_parity_decodes_any_loss():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, (4, 32))
    parity = []
    for row in I.cauchy(6, 4):
        acc = np.zeros(32, np.int64)
        for f, shard in zip(row, data, strict=True):
            acc ^= np.array([I._mul(f, int(b)) for b in shard])
        parity.append(acc)
    shards = dict(enumerate([*data, *parity]))
    for lost in ((0, 1), (2, 5), (3, 4)):
        left = {k: v for k, v in shards.items() if k not in lost}
        assert (I.rs_decode(left, 6, 4) == data).all()


def test_entry_and_oracles_have_the_same_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_fault_draws_nest_and_hit_single_places():
    short, long = damage.draws(7, 4), damage.draws(7, 64)
    assert long[:4] == short
    w = np.arange(-128, 128).reshape(4, 8, 8)
    one = damage.flip_book(w, [(300, 7)])
    assert (one != w).sum() == 1 and one.ravel()[300 % 256] == (w.ravel()[300 % 256] ^ -128)
    assert (damage.flip_book(w, [(5, 2), (5, 2)]) == w).all()
    dead, lost = damage.kill_unit(w, 2, 100)
    assert lost == 56 and (dead.ravel()[200:] == -1).all() and (dead.ravel()[:200] == w.ravel()[:200]).all()


def test_stored_flips_and_recall_after(spark):
    codes = spark.createDataFrame([(0, [1, 2]), (1, [3, 4])], "vec_id long, codes array<int>")
    got = {r.vec_id: r.codes for r in damage.flip_stored(codes, [(3, 0), (7, 1)], 2, 2, 4).collect()}
    assert got == {0: [1, 2], 1: [3, 4 ^ 3]}
    assert damage.flip_stored(codes.limit(0), [(3, 0)], 0, 2, 4).count() == 0
    doses = spark.createDataFrame([(0,), (1,)], "dose int")
    truth = spark.createDataFrame([(9, 0), (9, 1)], "qid long, vec_id long")
    found = truth.withColumn("dose", F.lit(0)).where("vec_id = 1")
    assert {r.dose: r.recall for r in damage.recall_after(found, truth, doses).collect()} == {0: 0.5, 1: 0.0}
    assert {r.recall for r in damage.recall_after(found, truth.limit(0), doses).collect()} == {None}


def test_shift_sweep_against_brute_force(spark):
    rng = np.random.default_rng(3)
    k, depth, delta = 4, 8, 30
    score = {(q, v): int(rng.integers(0, 60)) for q in range(3) for v in range(40)}
    ranked = lambda s: {q: sorted(range(40), key=lambda v: (-s[q, v], v)) for q in range(3)}
    clean = {q: r[:depth] for q, r in ranked(score).items()}
    true_ = {q: set(rng.choice(40, 5, replace=False).tolist()) | set(clean[q][:3]) for q in range(3)}
    want = {}
    for c in range(k):
        for s in (1, -1):
            hurt = ranked({(q, v): x + s * delta * (v % k == c) for (q, v), x in score.items()})
            for q in range(3):
                now = hurt[q][:depth]
                lost = max(0, len(true_[q] & set(clean[q])) - len(true_[q] & set(now)))
                want[q, c, s] = (lost, sum(v not in clean[q] and v % k == c for v in now))
    rows = spark.createDataFrame([(q, v, x, v % k) for (q, v), x in score.items()], "qid long, vec_id long, score long, code int")
    best = Window.partitionBy("qid", "code").orderBy(F.desc("score"), "vec_id")
    few = rows.withColumn("r", F.row_number().over(best)).where(F.col("r") <= depth).drop("r")
    lists = spark.createDataFrame([(q, v, i + 1) for q, r in clean.items() for i, v in enumerate(r)], "qid long, vec_id long, rank int")
    truth = spark.createDataFrame([(q, v, i + 1) for q, r in true_.items() for i, v in enumerate(sorted(r))], "qid long, vec_id long, rank int")
    seen = damage.shift_sweep(few, lists, truth, k, delta, depth)
    assert {(r.qid, r.c, r.s): (r.lost, r.intruders) for r in seen.collect()} == want
    codes = spark.range(40).selectExpr("id as vec_id", f"cast(id % {k} as int) as c")
    got = {r.claim: (r.x, r.y, r.verdict) for r in damage.findings(seen, truth, lists, codes, k, depth, 8).collect()}
    near = {q: min(r) % k for q, r in true_.items()}
    x, y = sum(want[q, near[q], -1][0] for q in near), sum(want[q, (near[q] + 1) % k, -1][0] for q in near)
    assert got["fan-out"][2] == "inconclusive"  # all codes are equally full
    assert got["directed sampling"][:2] == (x, y) and got["deflation channel"][0] == x
    assert got["margin bridge"][0] == 0
