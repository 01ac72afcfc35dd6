"""A stored index: build, open, search, append, describe and verify.

A folder holds ``codebook``, ``codes``, ``records`` and ``crcs`` as Parquet, the last
three by batch, and one manifest a batch. A manifest's file is created, never
overwritten, and written last: creating it is the commit, so of two writers of one
sequence one fails, and what no manifest names is not there. Readers may pin a
sequence. One encoder and one narrowing serve build and append.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import codes as C
from .operators import integrity as I
from .operators import maintenance as M
from .operators import vectors as V

#: Defaults of a build, and the rows that are trained on and that seeds are taken from.
SUBSPACES, CENTROIDS, DEPTH, ROUNDS, TRAIN, SEEDING = 16, 256, 100, 25, 100_000, 4096


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def seeds(rows: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k rows by k-means++: each next one with a chance in proportion to its squared distance to those taken."""
    rng = np.random.default_rng(seed)
    at = [int(rng.integers(len(rows)))]
    d = ((rows - rows[at[0]]) ** 2).sum(1).astype(float)
    while len(at) < k:
        upto = np.cumsum(d)
        at.append(int(np.searchsorted(upto, rng.random() * upto[-1], "right")) if upto[-1] > 0 else int(rng.integers(len(rows))))
        d = np.minimum(d, ((rows - rows[min(at[-1], len(rows) - 1)]) ** 2).sum(1))
    return rows[np.minimum(at, len(rows) - 1)]


def train(corpus: DataFrame, m: int, k: int, rounds: int = ROUNDS, first: int = TRAIN, seed: int = 42) -> V.Codebook:
    """A codebook of (vec_id, v): seeds from SEEDING rows of the first ``first``, then k-means rounds over those."""
    some = corpus.where(F.col("vec_id") < first)
    n = max(1, some.count())
    sample = some.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, SEEDING / n) * (1 << 30))))
    _, x = V.query_block(sample, "v")
    if not len(x):
        raise ValueError("nothing to train on")
    parts = x.reshape(len(x), m, -1)
    return V.Codebook(np.stack([seeds(parts[:, j], k, seed + j) for j in range(m)])).lloyd(some, rounds)


class Index:
    """An opened index at one manifest."""

    def __init__(self, spark: SparkSession, path: str, live: dict, batches: list[int]):
        self.spark, self.path, self.live, self.batches = spark, path, live, batches
        rows = spark.read.parquet(f"{path}/codebook").orderBy("j", "c").collect()  # of bounded size
        self.book = V.Codebook(np.array([r.w for r in rows]).reshape(live["m"], live["k"], -1))

    @staticmethod
    def build(corpus: DataFrame, path: str, book: V.Codebook, depth: int = DEPTH) -> "Index":
        """Write an index of (vec_id, v) of whole numbers, and open it."""
        spark = corpus.sparkSession
        rows = [(j, c, book.w[j, c].tolist()) for j in range(book.m) for c in range(book.k)]
        spark.createDataFrame(rows, "j int, c int, w array<long>").coalesce(1).write.parquet(f"{path}/codebook")
        Index._write(corpus, path, book, 0, {"m": book.m, "k": book.k, "d": book.m * book.ds, "depth": depth})
        return Index.load(spark, path)

    @staticmethod
    def _write(rows: DataFrame, path: str, book: V.Codebook, sequence: int, shape: dict) -> None:
        spark, at = rows.sparkSession, f"batch={sequence}"
        rows.select("vec_id", "v").write.mode("overwrite").parquet(f"{path}/records/{at}")
        stored = spark.read.parquet(f"{path}/records/{at}")
        V.encode(stored, book).write.mode("overwrite").parquet(f"{path}/codes/{at}")
        codes = spark.read.parquet(f"{path}/codes/{at}")
        I.blocks(codes, book.m).select("block_no", "crc").write.mode("overwrite").parquet(f"{path}/crcs/{at}")
        n, low, high = codes.agg(F.count("*"), F.min("vec_id"), F.max("vec_id")).first()
        body = json.dumps(shape | {"sequence": sequence, "rows": n, "first": low, "last": high}, sort_keys=True)
        fs, p = _path(spark, f"{path}/manifest/{sequence:08d}.json")
        out = fs.create(p, False)  # fails if another writer was first
        out.write(bytearray(json.dumps({"body": body, "crc": zlib.crc32(body.encode())}).encode()))
        out.close()

    @staticmethod
    def manifests(spark: SparkSession, path: str) -> list[dict]:
        """Those whose digest fits, by sequence."""
        fs, p = _path(spark, f"{path}/manifest")
        if not fs.exists(p):
            return []
        out = []
        for r in spark.read.text(f"{path}/manifest/*.json", wholetext=True).collect():  # one a batch
            outer = json.loads(r.value) if r.value.endswith("}") else {"body": "", "crc": -1}
            if zlib.crc32(outer["body"].encode()) == outer["crc"]:
                out.append(json.loads(outer["body"]))
        return sorted(out, key=lambda x: x["sequence"])

    @staticmethod
    def load(spark: SparkSession, path: str, sequence: int | None = None) -> "Index":
        """At its newest manifest, or as it was at a sequence."""
        found = [x for x in Index.manifests(spark, path) if sequence is None or x["sequence"] <= sequence]
        if not found:
            raise ValueError(f"no valid manifest at {path}")
        return Index(spark, path, found[-1], [x["sequence"] for x in found])

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/batch={b}" for b in self.batches])

    def codes(self) -> DataFrame:
        return self._read("codes").select("vec_id", "codes")

    def records(self) -> DataFrame:
        return self._read("records").select("vec_id", "v")

    def search(self, queries: DataFrame, k: int = 10, depth: int | None = None, metric: str = "l2", exact_stage: bool = True) -> DataFrame:
        """(qid, vec_id, score, rank) of queries (vec_id, v) from the stored codes, rescored from the records."""
        found = V.adc_scan(self.codes(), queries, self.book, depth or self.live["depth"], metric)
        return V.rerank(found, self.records(), queries, k) if exact_stage else found.where(F.col("rank") <= k)

    def append(self, rows: DataFrame) -> "Index":
        """Rows with larger ids than any stored, as one batch; only the newest state can be appended to."""
        newest = Index.manifests(self.spark, self.path)[-1]
        if newest["sequence"] != self.live["sequence"]:
            raise ValueError("the index was appended to since it was opened")
        low, bad = rows.agg(F.min("vec_id"), F.count_if(F.size("v") != self.live["d"])).first()
        if bad:
            raise ValueError(f"{bad} rows are not of dimension {self.live['d']}")
        if low is None:
            return self
        ends = [x["last"] for x in Index.manifests(self.spark, self.path) if x["last"] is not None]
        if ends and low <= max(ends):
            raise ValueError("stored ids are never written again")
        shape = {k: self.live[k] for k in ("m", "k", "d", "depth")}
        Index._write(rows, self.path, self.book, newest["sequence"] + 1, shape)
        return Index.load(self.spark, self.path)

    def vectors(self, first: int, count: int) -> DataFrame:
        """(vec_id, v, status) of a range of ids: stored or absent."""
        ids = self.spark.range(first, first + count).select(F.col("id").alias("vec_id"))
        return ids.join(self.records(), "vec_id", "left").withColumn("status", F.when(F.col("v").isNull(), "absent").otherwise("stored"))

    def describe(self) -> DataFrame:
        """One row a batch, with the sizes its rows take."""
        names = "sequence long, m long, k long, d long, depth long, n long, first long, last long"
        rows = [(x["sequence"], x["m"], x["k"], x["d"], x["depth"], x["rows"], x["first"], x["last"]) for x in Index.manifests(self.spark, self.path) if x["sequence"] in self.batches]
        out = self.spark.createDataFrame(rows, names)
        return M.layout(out.withColumn("b", F.ceil(F.log2("k")).cast("int")).withColumn("m", F.col("m").cast("int")).withColumn("copies", F.lit(1)))

    def stats(self) -> DataFrame:
        """Population and skew of each subspace."""
        return C.skew(C.populations(self.codes(), self.live["m"], self.live["k"]))

    def verify(self) -> DataFrame:
        """(batch, block_no, ok) of all blocks, from the stored codes and checksums."""
        out = None
        for b in self.batches:
            data = I.blocks(self.spark.read.parquet(f"{self.path}/codes/batch={b}"), self.live["m"])
            one = I.verify(data, self.spark.read.parquet(f"{self.path}/crcs/batch={b}")).select(F.lit(b).alias("batch"), "block_no", "ok")
            out = one if out is None else out.union(one)
        return out
