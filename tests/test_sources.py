import numpy as np
import pytest

from lodestar.operators.vectors import Codebook
from lodestar.sources.vecs import probe, read_vecs
from lodestar.streaming.ingest import append, ingest, snapshot


def _write(path, x, code):
    with open(path, "wb") as f:
        for row in x:
            f.write(np.array([len(row)], "<u4").tobytes() + np.array(row, code).tobytes())


def test_vector_files(spark, tmp_path):
    x = np.arange(60).reshape(20, 3)
    for kind, code in (("fvecs", "<f4"), ("bvecs", "u1"), ("ivecs", "<i4")):
        path = str(tmp_path / f"x.{kind}")
        _write(path, x, code)
        assert probe(spark, path) == (kind, 3, 20)
        got = read_vecs(spark, path).orderBy("vec_id").collect()
        assert [list(r.embedding) for r in got] == x.tolist()
    assert read_vecs(spark, path, 5).count() == 5


def test_malformed_files_are_refused(spark, tmp_path):
    for name, data in (("a.fvecs", b"\x02\0\0\0" + b"\0" * 7), ("b.fvecs", b"\0\0\0\0"), ("c.txt", b"")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(ValueError):
            probe(spark, str(tmp_path / name))


def test_ingest_is_insert_only_and_idempotent(spark, tmp_path):
    book = Codebook(np.arange(16).reshape(2, 4, 2))
    rows = spark.createDataFrame([(i, [i % 5, 1, 2, i % 3]) for i in range(20)], "vec_id long, v array<int>")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("vec_id long, v array<int>").parquet(str(tmp_path / "in"))
    ingest(stream, book, str(tmp_path / "index"), str(tmp_path / "ck")).awaitTermination(60)
    assert snapshot(spark, str(tmp_path / "index")).count() == 20
    append(rows, book, str(tmp_path / "index"), 0)
    assert snapshot(spark, str(tmp_path / "index")).count() == 20
    append(rows.where("vec_id < 3"), book, str(tmp_path / "index"), 9)
    assert snapshot(spark, str(tmp_path / "index")).count() == 23
    assert snapshot(spark, str(tmp_path / "index"), 1).count() == 20
