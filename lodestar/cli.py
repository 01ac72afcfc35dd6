"""Command line: python -m lodestar.cli COMMAND INDEX ...; exit 0: done, 1: a negative result, 2: refused."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .index import CENTROIDS, DEPTH, ROUNDS, SUBSPACES, TRAIN, Index, train
from .operators import vectors as V
from .sources.vecs import read_vecs


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, v) of a vector file or a Parquet table (vec_id, embedding), narrowed by the one global scale."""
    raw = read_vecs(spark, path) if path.endswith("vecs") else spark.read.parquet(path)
    return raw.select("vec_id", V.narrow(F.col("embedding")).alias("v"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestar")
    parser.add_argument("command", choices=["build", "append", "vectors", "inspect", "query", "stats", "verify", "repair", "selftest", "version"])
    parser.add_argument("index", nargs="?")
    parser.add_argument("input", nargs="?")
    for name, default in (("m", SUBSPACES), ("b", CENTROIDS.bit_length() - 1), ("r", DEPTH), ("k", 10), ("iterations", ROUNDS), ("train-n", TRAIN), ("seed", 42), ("from", 0), ("count", 10)):
        parser.add_argument(f"--{name}", type=int, default=default)
    a = vars(parser.parse_args(argv))
    spark = spark or SparkSession.builder.appName("lodestar").getOrCreate()
    command = a["command"]
    try:
        if command == "version":
            print("lodestar 0.2")
            return 0
        if command == "selftest":
            return selftest(spark, a["index"])
        if command == "build":
            rows = _rows(spark, a["input"])
            d = len(rows.first().v)
            if d % a["m"]:
                raise ValueError(f"{d} components do not fall into {a['m']} equal subspaces")
            Index.build(rows, a["index"], train(rows, a["m"], 1 << a["b"], a["iterations"], a["train_n"], a["seed"]), a["r"]).describe().show()
            return 0
        index = Index.load(spark, a["index"])
        if command == "append":
            index.append(_rows(spark, a["input"])).describe().show()
        elif command == "query":
            index.search(_rows(spark, a["input"]), a["k"], a["r"]).orderBy("qid", "rank").show(1 << 20)
        elif command == "vectors":
            index.vectors(a["from"], a["count"]).orderBy("vec_id").show(a["count"])
        elif command in ("inspect", "stats"):
            (index.describe() if command == "inspect" else index.stats()).show(1000)
        else:
            bad = index.verify().where("not ok")
            if command == "repair" and bad.take(1):
                print("codes have no second copy here: build them anew from the records")
            bad.show()
            return int(bool(bad.take(1)))
        return 0
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2


def selftest(spark: SparkSession, folder: str) -> int:
    """Build, search and verify a small index: a full-depth search must be exact."""
    rows = spark.range(400).selectExpr("id as vec_id", "transform(sequence(0, 15), j -> cast((13 * id + 7 * j) % 41 - 20 as int)) as v")
    index = Index.build(rows, f"{folder}/selftest", train(rows, 4, 16, 3), 400)
    queries = rows.where("vec_id % 20 = 0")
    same = index.search(queries, 5).exceptAll(V.exact_search(rows, queries, 5).select("qid", "vec_id", "score", "rank"))
    good = not same.take(1) and not index.verify().where("not ok").take(1)
    print("selftest passed" if good else "selftest failed")
    return int(not good)


if __name__ == "__main__":
    sys.exit(main())
