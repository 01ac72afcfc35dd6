import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar import cli
from lodestar.index import Index, seeds, train
from lodestar.operators import damage as D
from lodestar.operators import labels as L
from lodestar.operators import vectors as V
from lodestar.sources import batches as B


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(v, [((13 * v + 7 * j) % 41) - 20 for j in range(16)]) for v in range(300)], "vec_id long, v array<int>")


def test_round_trip_append_and_pinned_readers(spark, corpus, tmp_path):
    path = str(tmp_path / "index")
    book = train(corpus, 4, 16, 3)
    index = Index.build(corpus.where("vec_id < 200"), path, book, 200)
    queries = corpus.where("vec_id % 20 = 0")
    cols = ["qid", "vec_id", "score", "rank"]
    assert sorted(index.search(queries, 5).select(cols).collect()) == sorted(V.exact_search(corpus.where("vec_id < 200"), queries, 5).select(cols).collect())
    now = index.append(corpus.where("vec_id >= 200"))
    assert now.records().count() == 300 and index.records().count() == 200 and Index.load(spark, path, 0).codes().count() == 200
    with pytest.raises(ValueError):
        now.append(corpus.where("vec_id = 7"))
    with pytest.raises(ValueError):
        index.append(corpus.where("vec_id >= 200"))  # opened before the append
    with pytest.raises(ValueError):
        now.append(spark.createDataFrame([(900, [1, 2])], "vec_id long, v array<int>"))
    assert not now.verify().where("not ok").take(1)
    codes = now.codes().where("vec_id >= 200").withColumn("codes", F.transform("codes", lambda c, i: F.when((F.col("vec_id") == 250) & (i == 0), (c + 1) % 16).otherwise(c)))
    codes.cache().count()
    codes.write.mode("overwrite").parquet(f"{path}/codes/batch=1")
    assert [(r.batch, r.block_no) for r in now.verify().where("not ok").collect()] == [(1, 250 // 128)]
    (tmp_path / "index/manifest/00000009.json").write_text(json.dumps({"body": "{}", "crc": 1}))  # a torn one counts for nothing
    assert Index.load(spark, path).live["sequence"] == 1
    with pytest.raises(ValueError):
        Index.load(spark, str(tmp_path / "none"))


def test_command_line(spark, corpus, tmp_path, capsys):
    rows = corpus.select("vec_id", F.transform("v", lambda x: x / F.lit(40.0)).alias("embedding"))
    rows.write.parquet(str(tmp_path / "rows"))
    index = str(tmp_path / "index")
    assert cli.main(["build", index, str(tmp_path / "rows"), "--m", "4", "--b", "4", "--iterations", "2"], spark) == 0
    for command in ("inspect", "stats", "verify", "vectors"):
        assert cli.main([command, index], spark) == 0
    assert cli.main(["query", index, str(tmp_path / "rows"), "--k", "1"], spark) == 0
    assert cli.main(["append", index, str(tmp_path / "rows")], spark) == 2
    assert cli.main(["build", index + "2", str(tmp_path / "rows"), "--m", "5"], spark) == 2
    assert cli.main(["selftest", str(tmp_path)], spark) == 0 and "passed" in capsys.readouterr().out


def test_seeds_are_spread():
    x = np.array([[0.0], [0.1], [100.0], [100.1], [200.0]])
    assert len(set((seeds(x, 3, 1)[:, 0] // 50).tolist())) == 3
    assert len(seeds(np.zeros((2, 1)), 4, 1)) == 4


def test_batches(spark):
    x = np.arange(6, dtype="<f4").reshape(2, 3)
    assert [list(r.q) for r in B.decode(spark, x.tobytes(), 3).collect()] == x.tolist()
    assert [list(r.q) for r in B.decode(spark, b"1,2 3\n\n4\t5, 6\n", 3, "text/plain").collect()] == [[1, 2, 3], [4, 5, 6]]
    x[1, 2] = np.nan
    for body, kind in ((x.tobytes(), None), (b"123", None), (b"", None), (b"1 2", "text/plain"), (b"1 x 3", "text/plain"), (b"\n", "text/plain")):
        with pytest.raises(ValueError):
            B.decode(spark, body, 3, kind)
    assert B.limits(0, 0, 50) == (1, 50) and B.limits(9999, 10, 50) == (512, 10)
    with pytest.raises(ValueError):
        B.limits(1, 513, 50)


def test_label_search_only_lowers_displacement(spark):
    rng = np.random.default_rng(4)
    rows = [(j, c, t, int(rng.integers(-100, 100))) for j in range(2) for c in range(8) for t in range(3)]
    book = spark.createDataFrame(rows, "j int, c int, t int, w int")
    seed = L.gray_seed(book)
    found = L.optimise(book, seed).collect()
    for j in range(2):
        w = np.array([[x[3] for x in rows if x[0] == j and x[1] == c] for c in range(8)], float)
        position = np.argsort([r.label for r in sorted(seed.collect(), key=lambda r: r.c) if r.j == j])
        mine = [r for r in found if r.j == j]
        assert sorted(r.label for r in mine) == list(range(8))
        assert mine[0].after <= L.displacement(w, position) + 1e-9 and mine[0].before == L.displacement(w, np.arange(8))
        assert abs(mine[0].after - L.displacement(w, np.argsort([r.label for r in sorted(mine, key=lambda r: r.c)]))) < 1e-9


def test_allocation_is_near_the_exhaustive_one():
    rates = [(0, 1000), (32, 100), (64, 90), (128, 1), (40, 400)]
    assert D.envelope(rates) == [(0, 1000), (32, 100), (128, 1)]
    got = D.allocate({1: 50, 2: 5}, {1: 256, 2: 256}, rates, 70)
    assert got == {1: (32, 100), 2: (32, 100)}
    assert D.allocate({1: 50, 2: 5}, {1: 256, 2: 256}, rates, 0) == {1: (0, 1000), 2: (0, 1000)}


def test_generators():
    assert D.xorshift(1, 2) != D.xorshift(2, 2) and D.xorshift(1, 3)[:2] == D.xorshift(1, 2)
    assert D.xorshift(1, 1, (13, 7, 17), 1) == [1 << 13 ^ 1 ^ (1 << 13 ^ 1) >> 7 ^ ((1 << 13 ^ 1 ^ (1 << 13 ^ 1) >> 7) << 17)]


def test_torn_and_killed_bytes(spark):
    r = spark.sql("select 'AABBCC' as h").select(D.torn_write(F.col("h"), F.lit(1)).alias("t"), D.kill(F.col("h"), "00").alias("k")).first()
    assert (r.t, r.k) == ("AAFFFF", "000000")
