"""Quality rules judged by an isolation forest.

Rule statistics of whole texts are computed by vectorised byte kernels. A forest of
TREES isolation trees over all statistics together, and one for each family of them,
each tree over SAMPLE labelled documents (about TREES * SAMPLE labelled rows at most
are read for them, those with the least hashes), splits random statistics at random
values; a document's anomaly score is 2 ** (-mean path length / expected length). Each
forest's threshold is calibrated on
all labelled rows: of the scores that reject few good ones, the one with the best
difference of rejection rates. Both look at labelled documents that pass the base
rules. With no labelled rows nothing is judged anomalous.

Defined results: null text has no words and fails the base rules; repeated rows are
judged alike; a null id has no label; labels of one id that disagree count each; texts
of any length are measured whole; only the named columns are read, so others may have
any name; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, WORD_HASH, column, lean, mix64, save, slices, table, text_buffers, word_spans

TREES, SAMPLE, LIMIT = 64, 256, 10
#: All statistics (columns of features()) and families of them, each judged by a forest and a threshold of
#: its own, so that harmless oddities of one family do not hide the anomalies of another.
FAMILIES = ([0, 1, 2, 3, 4, 5, 6], [0], [3], [4], [1, 2], [5, 6])
#: A threshold may reject this share of the good labelled rows, and one good row for GOOD_FOR_BAD bad ones.
MOST_GOOD_LOST, GOOD_FOR_BAD = 0.005, 10
MIN_WORDS, MOST_REPEATED = 50, 50
#: The characters counted as symbols.
SYMBOLS = np.isin(np.arange(256), list(b"[#*$%&|<>]"[1:-1]))
_PUNCT = np.isin(np.arange(256), list(b"!\"'(),-./:;?@[]^_`{}~\\+="))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_punct", "n_distinct"]


def _later(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (group, key) pairs: how many equal pairs there are, and whether an earlier one is equal."""
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
    run = np.cumsum(new) - 1
    times, earlier = np.empty(len(g), np.int64), np.empty(len(g), bool)
    times[order] = np.bincount(run)[run] if len(g) else 0
    earlier[order] = ~new
    return times, earlier


def statistics(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offs) - 1
    per_doc = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offs])
    start, end, doc = word_spans(buf, offs)
    prefix = WORD_HASH.prefix(buf)
    of = lambda s, e: mix64(WORD_HASH.spans(prefix, s, e) + (e - s).astype(np.uint64))
    words = np.bincount(doc, minlength=n)
    out = {"n_words": words, "word_chars": per_doc(~WHITE[buf] & ((buf & 0xC0) != 0x80)), "n_symbols": per_doc(SYMBOLS[buf]), "n_upper": per_doc(_UPPER[buf]), "n_punct": per_doc(_PUNCT[buf])}
    # lines with a word
    head = np.zeros(len(buf) + 1, bool)
    head[1:] = buf == 0x0A
    head[offs] = True
    ls = np.flatnonzero(head[: len(buf)])
    le = np.append(ls[1:], len(buf))[: len(ls)]
    le = np.where((le > ls) & (buf[np.maximum(le - 1, 0)] == 0x0A), le - 1, le) if len(ls) else le
    some = np.searchsorted(start, le) > np.searchsorted(start, ls)
    ls, le = ls[some], le[some]
    ldoc = np.searchsorted(offs, ls, "right") - 1
    _, earlier = _later(ldoc, of(ls, le))
    out["n_lines"] = np.bincount(ldoc, minlength=n)
    out["n_dup_lines"] = np.bincount(ldoc, earlier, n).astype(np.int64)
    # words in repeated 3-word windows
    h = of(start, end)
    _, again = _later(doc, h)
    out["n_distinct"] = words - np.bincount(doc, again, n).astype(np.int64)
    cover = np.zeros(len(h), bool)
    if len(h) >= 3:
        at = np.flatnonzero(doc[2:] == doc[:-2])
        tri = mix64(h[at] + mix64(h[at + 1] + mix64(h[at + 2])))
        times, _ = _later(doc[at], tri)
        hit = at[times > 1]
        for j in range(3):
            cover[hit + j] = True
    out["n_repeat_words"] = np.bincount(doc, cover, n).astype(np.int64)
    return out


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    w, c = np.maximum(stats["n_words"], 1), np.maximum(stats["word_chars"], 1)
    return np.stack([stats["n_symbols"] / w, stats["n_dup_lines"] / np.maximum(stats["n_lines"], 1), stats["n_repeat_words"] / w, stats["n_upper"] / c, stats["n_punct"] / w, stats["word_chars"] / w, stats["n_distinct"] / w], 1).astype(float)


class Forest:
    """Isolation trees as arrays: feature (-1: leaf), cut, child, length at the leaf."""

    def __init__(self, x: np.ndarray, trees: int = TREES, sample: int = SAMPLE, limit: int = LIMIT, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.trees, self.size = [], min(sample, len(x))
        for _ in range(trees if len(x) else 0):
            rows = x[rng.choice(len(x), self.size, replace=False)]
            feature, cut, child, length = [], [], [], []

            def grow(part, depth, feature=feature, cut=cut, child=child, length=length):
                me = len(feature)
                feature.append(-1), cut.append(0.0), child.append(0), length.append(depth + self.expected(len(part)))
                varied = np.flatnonzero(part.max(0) > part.min(0))
                if depth < limit and len(part) > 1 and len(varied):
                    f = int(rng.choice(varied))
                    lo, hi = part[:, f].min(), part[:, f].max()
                    c = float(rng.uniform(lo, hi))
                    feature[me], cut[me] = f, c
                    grow(part[part[:, f] <= c], depth + 1)
                    child[me] = len(feature)
                    grow(part[part[:, f] > c], depth + 1)
                return me

            grow(rows, 0)
            self.trees.append(tuple(np.array(a) for a in (feature, cut, child, length)))

    @staticmethod
    def expected(n: int) -> float:
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.zeros(len(x))
        total = np.zeros(len(x))
        for feature, cut, child, length in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[np.arange(len(x)), np.maximum(f, 0)] > cut[at]
                at = np.where(inner, np.where(right, child[at], at + 1), at)
            total += length[at]
        return 2.0 ** (-total / len(self.trees) / max(self.expected(self.size), 1e-9))


def threshold(rows: list[tuple[int, int, int]], most_good_lost: float = MOST_GOOD_LOST) -> float:
    """From (score in thousandths, quality, rows): reject scores of at least this many thousandths."""
    good, bad = (sum(n for _, q, n in rows if q == k) for k in (1, 0))
    if not good or not bad:
        return float("inf")
    best, at, g, b = 0.0, float("inf"), 0, 0
    by: dict[int, list[int]] = {}
    for s, q, n in rows:
        by.setdefault(s, [0, 0])[q] += n
    for s in sorted(by, reverse=True):
        b, g = b + by[s][0], g + by[s][1]
        if g > most_good_lost * good:
            break
        if GOOD_FOR_BAD * g <= b and b / bad - g / good > best:
            best, at = b / bad - g / good, s
    return at


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", quality_col: str = "quality") -> DataFrame:
    """(id, the statistics, base_failed, anomaly, kept) of every row."""
    spark = docs.sparkSession
    id_type = docs.select(column(id_col)).schema[0].dataType.simpleString()

    def measure(batches):
        for batch in batches:
            buf, offs = text_buffers(batch.column(1))
            for a, b in slices(offs):
                s = statistics(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(np.asarray(s[k], np.int64)) for k in STATS)], ["id", *STATS])

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    texts = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"))
    stats, _ = save(texts.mapInArrow(lean(measure), f"id {id_type}, " + ", ".join(f"{k} long" for k in STATS)), "statistics")
    truth = labels.select(column(label_id).alias("id"), column(quality_col).cast("int").alias("q")).where("q in (0, 1) and id is not null")
    # what fails the base rules is rejected anyway: the forest learns and is calibrated on the rest
    labelled, _ = save(stats.where(~failed).join(truth, "id"), "labelled")
    share = TREES * SAMPLE / max(1, labelled.count())
    sample = labelled.where(F.pmod(F.xxhash64("id", *STATS), F.lit(1 << 40)) < F.lit(int(min(1.0, share) * (1 << 40)))).toPandas().sort_values(STATS, ignore_index=True)
    x = features({k: sample[k].to_numpy() for k in STATS})
    forests = spark.sparkContext.broadcast([Forest(x[:, f], seed=9 + i) for i, f in enumerate(FAMILIES)])
    names = [f"s{i}" for i in range(len(FAMILIES))]

    def rate(batches):
        for batch in batches:
            cols = {k: batch.column(i) for i, k in enumerate(batch.schema.names)}
            x = features({k: cols[k].to_numpy() for k in STATS})
            scores = [pa.array(np.floor(t.scores(x[:, f]) * 1000).astype(np.int64)) for t, f in zip(forests.value, FAMILIES, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *scores], [*batch.schema.names, *names])

    schema = ", ".join(f"{k} long" for k in [*STATS, *names])
    rated = labelled.select("q", *STATS).mapInArrow(lean(rate), f"q int, {schema}")
    rated = rated.select("q", F.posexplode(F.array(*names)).alias("i", "s")).groupBy("i", "s", "q").agg(F.count("*").alias("n"))
    known = rated.collect()  # at most families x 1000 scores x 2
    limits = [threshold([(r.s, r.q, r.n) for r in known if r.i == i]) for i in range(len(FAMILIES))]
    out = stats.select("id", *STATS).mapInArrow(lean(rate), f"id {id_type}, {schema}")
    ok = ~failed
    for name, limit in zip(names, limits, strict=True):
        ok &= F.col(name) < F.lit(limit)
    return out.select(F.col("id").alias(id_col), *STATS, failed.alias("base_failed"), *[(F.col(n) / 1000).alias(f"anomaly_{i}") for i, n in enumerate(names)], ok.alias("kept"))


def op2_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *(f"anomaly_{i}" for i in range(len(FAMILIES))))
