"""The corpus pipeline: stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a frame that run() writes as
Parquet to the shared folder and reads again as the next stage's docs. All but the
last return the columns of documents. Nothing is sampled, and no row is dropped but
by a stage's own decision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import drop, save, table
from lodestar.llm.langid import UND, identify
from lodestar.llm.minhash import near_duplicates
from lodestar.llm.mixing import mix
from lodestar.llm.packing import pack
from lodestar.llm.repeats import remove_repeats

#: The least posterior of a document's language.
LEAST_SCORE = 0.5
#: Bytes of the shortest passage of more than 50 words: 51 words of one byte and what parts them.
LEAST_REPEAT = 101
#: Percent of shared shingles from which documents are near-duplicates. At exactly 0.8, two
#: documents share no table (1 - 0.8**3)**12 * 2 times: 4 in 10,000.
LIKENESS = 80


def _by_row(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """docs with decisions (doc_id, text_hash, ...) of their rows; rows without any go."""
    d = decisions.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"}).hint("shuffle_hash")
    keyed = docs.withColumn("__h", F.xxhash64("text"))
    return keyed.join(d, (keyed["__h"] == d["__hash"]) & keyed["doc_id"].eqNullSafe(d["__id"])).drop("__h", "__id", "__hash")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or without a clear language go."""
    out = identify(docs, F.lit(True))
    return out.where((F.col("lang_pred") != UND) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id."""
    marked, _ = save(near_duplicates(docs, percent=LIKENESS).select("doc_id", "text_hash", "kept"), "kept")
    keys, _ = save(marked.where("kept").groupBy("doc_id", "text_hash").agg(F.count("*").alias("rows")), "kept-keys")
    # texts of one component may share its smallest id only if the id repeats: the first of them stays
    again = keys.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("rows").alias("m")).where("doc_id is not null and (n > 1 or m > 1)").take(1)
    out = _by_row(docs, keys.drop("rows"))
    return out.dropDuplicates(["doc_id", "text"]) if again else out


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of LEAST_REPEAT that start anywhere else too are cut out; every document stays."""
    return remove_repeats(docs, length=LEAST_REPEAT).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for."""
    copies, _ = save(mix(docs, id_col="doc_id").groupBy("doc_id", "text_hash").agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows")), "mix")
    if copies.where("__rows > 1").take(1):  # repeated rows share their copies
        docs = docs.dropDuplicates(["doc_id", "text"])
    out = _by_row(docs, copies.where("__copies > 0").drop("__rows"))
    keyed = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))
    return out.withColumn("__copy", keyed).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return pack(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("mixing", mixing), ("packing", packing)]
#: No stage but the counting in mixing can be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = save(stage(spark, docs, sf_dir), name)
        if before:
            drop(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
