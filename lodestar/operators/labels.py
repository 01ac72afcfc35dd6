"""Labels of centroids: permutations under which near centroids differ in few bits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Passes of the transposition search at most.
PASSES = 8


def widest_axis(book: DataFrame) -> DataFrame:
    """(j, t): the component of widest spread of each subspace of (j, c, t, w), the first on ties."""
    spread = book.groupBy("j", "t").agg((F.max("w") - F.min("w")).alias("s"))
    return spread.groupBy("j").agg(F.min_by("t", F.struct(-F.col("s"), F.col("t"))).alias("t"))


def gray_seed(book: DataFrame) -> DataFrame:
    """(j, c, label): Gray codes in the order of the widest component."""
    # a subspace has at most 256 centroids
    r = F.row_number().over(Window.partitionBy("j").orderBy("w", "c")) - 1
    ranked = book.join(widest_axis(book), ["j", "t"]).withColumn("r", r)
    return ranked.select("j", "c", F.col("r").bitwiseXOR(F.shiftright("r", 1)).alias("label"))


def displacement(w: np.ndarray, position: np.ndarray) -> float:
    """Mean squared distance of centroids whose labels differ in one bit; position[label] is a centroid."""
    x, bits = w[position], len(position).bit_length() - 1
    return float(np.mean([((x - x[np.arange(len(x)) ^ (1 << b)]) ** 2).sum(1).mean() for b in range(bits)]))


def optimise(book: DataFrame, seed: DataFrame, passes: int = PASSES) -> DataFrame:
    """(j, c, label, before, after, swaps): transpositions kept while they lower the displacement.

    Sequential by nature, but over one subspace of at most 256 centroids a group."""

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf.c.max()) + 1
        w = pdf.sort_values(["c", "t"]).w.to_numpy(float).reshape(k, -1)
        label = pdf.groupby("c").label.first().sort_index().to_numpy()
        far = ((w[:, None] - w[None]) ** 2).sum(2)
        position = np.argsort(label)
        before, swaps, bits = displacement(w, np.arange(k)), 0, k.bit_length() - 1
        around = np.arange(k)[:, None] ^ (1 << np.arange(bits))[None]

        def cost(i: int, j: int) -> float:
            """What the pairs of one or both of two labels add up to."""
            both = far[position[i], position[around[i]]].sum() + far[position[j], position[around[j]]].sum()
            return both - (far[position[i], position[j]] if (i ^ j).bit_count() == 1 else 0.0)

        for _ in range(passes):
            better = False
            for i in range(k):
                for j in range(i + 1, k):
                    was = cost(i, j)
                    position[[i, j]] = position[[j, i]]
                    if cost(i, j) < was - 1e-9:
                        better, swaps = True, swaps + 1
                    else:
                        position[[i, j]] = position[[j, i]]
            if not better:
                break
        out = np.empty(k, np.int64)
        out[position] = np.arange(k)
        return pd.DataFrame({"j": int(pdf.j.iloc[0]), "c": np.arange(k), "label": out, "before": before, "after": displacement(w, position), "swaps": swaps})

    return book.join(seed, ["j", "c"]).groupBy("j").applyInPandas(search, "j int, c int, label int, before double, after double, swaps int")


def permute_book(book: DataFrame, labels: DataFrame) -> DataFrame:
    """Centroids moved to their labels."""
    return book.join(labels.select("j", "c", "label"), ["j", "c"]).select("j", F.col("label").alias("c"), "t", "w")


def permute_codes(codes: DataFrame, labels: DataFrame) -> DataFrame:
    """(vec_id, j, code) under the same permutation."""
    return codes.join(labels.select("j", F.col("c").alias("code"), "label"), ["j", "code"]).select("vec_id", "j", F.col("label").alias("code"))


def is_permutation(labels: DataFrame) -> DataFrame:
    """(j, valid): labels are distinct and below their number."""
    return labels.groupBy("j").agg(((F.count_distinct("label") == F.count("*")) & (F.min("label") >= 0) & (F.max("label") < F.count("*"))).alias("valid"))
