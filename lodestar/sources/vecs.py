"""Readers of .fvecs, .bvecs and .ivecs files (records of a 32-bit dimension and that many components).

Records have one width, so the files are read by fixed-length splits from any store
Spark can open; the dimension is taken from the first record and checked in all."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Component type by extension, and the largest plausible dimension.
COMPONENTS = {"fvecs": ("<f4", "float"), "bvecs": ("u1", "smallint"), "ivecs": ("<i4", "int")}
MOST_DIMENSIONS = 100_000


def probe(spark: SparkSession, path: str) -> tuple[str, int, int]:
    """(extension, dimension, records); refuses unknown extensions, implausible dimensions and ragged files."""
    kind = path.rsplit(".", 1)[-1]
    if kind not in COMPONENTS:
        raise ValueError(f"unknown vector file extension: {kind}")
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    length = fs.getFileStatus(p).getLen()
    if length < 4:
        raise ValueError("the file is shorter than a record's dimension")
    stream = fs.open(p)
    try:
        dim = sum(stream.read() << (8 * i) for i in range(4))
    finally:
        stream.close()
    if not 0 < dim <= MOST_DIMENSIONS:
        raise ValueError(f"implausible dimension: {dim}")
    record = 4 + dim * np.dtype(COMPONENTS[kind][0]).itemsize
    if length % record:
        raise ValueError("the file does not hold whole records")
    return kind, dim, length // record


def read_vecs(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """(vec_id, embedding) of the file's records in order, or of the first ``first``."""
    kind, dim, n = probe(spark, path)
    code, sql = COMPONENTS[kind]
    record = 4 + dim * np.dtype(code).itemsize
    rows = spark.sparkContext.binaryRecords(path, record).zipWithIndex().map(lambda x: (x[1], bytearray(x[0])))
    raw = spark.createDataFrame(rows, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("raw", T.BinaryType())]))

    def decode(batches):
        for batch in batches:
            data = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(batch), record)
            if (np.ascontiguousarray(data[:, :4]).view("<u4") != dim).any():
                raise ValueError("a record has another dimension")
            x = np.ascontiguousarray(data[:, 4:]).view(code)
            x = x.astype(np.int16) if code == "u1" else x
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * dim, pa.int32()), pa.array(x.ravel()))], ["vec_id", "embedding"])

    out = raw.mapInArrow(decode, f"vec_id long, embedding array<{sql}>")
    return out if first is None else out.where(out["vec_id"] < min(first, n))
