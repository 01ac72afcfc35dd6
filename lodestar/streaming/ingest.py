"""Insert-only ingest of new vectors from a stream.

Each micro-batch is encoded with the index's own codebook and appended; the
manifest row that makes it visible is written last and carries the batch's number,
so a batch that is run again after a failure is written once. A reader that pins a
manifest's sequence sees what was there then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.vectors import Codebook, encode

MANIFEST = "sequence long, batch long, rows long, first_id long, last_id long"


def manifests(spark: SparkSession, path: str) -> DataFrame:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def append(batch: DataFrame, book: Codebook, path: str, number: int) -> None:
    spark = batch.sparkSession
    seen = manifests(spark, path)
    if seen.where(F.col("batch") == number).take(1):
        return
    target = f"{path}/codes/batch={number}"
    encode(batch, book).write.mode("overwrite").parquet(target)
    got = spark.read.parquet(target).agg(F.count("*"), F.min("vec_id"), F.max("vec_id")).first()
    last = seen.agg(F.max("sequence")).first()[0]
    spark.createDataFrame([((last or 0) + 1, number, got[0], got[1], got[2])], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def ingest(vectors: DataFrame, book: Codebook, path: str, checkpoint: str) -> StreamingQuery:
    """Start ingesting a streaming frame (vec_id, v); ends when what is there is taken in."""
    return vectors.writeStream.foreachBatch(lambda df, number: append(df, book, path, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(spark: SparkSession, path: str, sequence: int | None = None) -> DataFrame:
    """(vec_id, codes) of all batches up to a manifest's sequence; what has no manifest is not there."""
    live = manifests(spark, path)
    if sequence is not None:
        live = live.where(F.col("sequence") <= sequence)
    numbers = [r.batch for r in live.select("batch").collect()]  # one a committed batch
    if not numbers:
        return spark.createDataFrame([], "vec_id long, codes array<int>")
    return spark.read.parquet(*[f"{path}/codes/batch={n}" for n in numbers]).select("vec_id", "codes")
