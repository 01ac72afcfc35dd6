"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary. A text is lower-cased and read as
its runs of letters, each after a word mark. In each language a word's probability is
the sum, over all its segmentations into pieces, of the product of the pieces'
probabilities: a forward algorithm over positions, done for all words of a length
and all languages at once. A character that is no piece is one unknown piece. Piece
probabilities start from occurrence counts and are refined by expectation
maximisation (forward-backward expected counts) on the distinct words of at most
SAMPLE learning documents a language, taken by a hash of the id (all, where there
are fewer). A text's language maximises its words' summed log probabilities; its
score is that language's posterior, with equal priors, from the evidence of one average
word: words are not independent, and their summed evidence would call every text certain.

Defined results: null text, or one without letters, is ``und`` with score 0; nulls
in the language column are not learnt from; with nothing to learn from everything is
``und``; ties go to the first language by code point; repeated rows are judged alike;
an empty table gives an empty table; texts of any length are judged whole, a slice of
documents at a time, and a worker remembers the probabilities of MEMO words at most. The
number of distinct languages is held on the driver.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, crc32_of_id, drop, lean, save, slices, table, text_buffers

SAMPLE, ROUNDS, MEMO, BLOCK = 4000, 2, 200_000, 8_000
UND = "und"
LETTERS = re.compile(r"[^\W\d_]+")
_MARK, _STEP = "▁", np.uint64(0x9E3779B97F4A7C15 | 1)


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


class Pieces:
    """The vocabulary's pieces of letters, with or without a word mark, by hash."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        found = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
        self.pieces = sorted({p for p in found if p and (p.removeprefix(_MARK).isalpha() or p == _MARK) and p == p.lower()})
        h = np.array([self._one(p) for p in self.pieces], np.uint64)
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        self.longest = max(map(len, self.pieces))
        self.unknown = len(self.pieces)

    @staticmethod
    def _one(piece: str) -> int:
        h = 0
        for ch in piece:
            h = (h * int(_STEP) + ord(ch) + 1) & ((1 << 64) - 1)
        return h

    def lattice(self, words: list[str]):
        """Blocks of words of one length: (row numbers, ids[start, size - 1, word]); -1: no such piece."""
        marked = [_MARK + w for w in words]
        lengths = np.fromiter(map(len, marked), np.int64, len(marked))
        order = np.argsort(lengths, kind="stable")
        edge = np.flatnonzero(np.diff(lengths[order], prepend=-1))
        runs = [(a + k, min(a + k + BLOCK, b)) for a, b in zip(edge, [*edge[1:], len(order)], strict=True) for k in range(0, b - a, BLOCK)]
        for a, b in runs:
            rows = order[a:b]
            n = int(lengths[rows[0]])
            text = np.frombuffer("".join(marked[i] for i in rows).encode("utf-32-le"), "<u4").reshape(len(rows), n).T.astype(np.uint64)
            ids = np.full((n, min(n, self.longest), len(rows)), -1, np.int32)
            h = np.zeros((n, len(rows)), np.uint64)
            for size in range(1, ids.shape[1] + 1):
                m = n - size + 1
                h = h[:m] * _STEP + text[size - 1 :] + np.uint64(1)
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                got = np.where(self.hashes[at] == h, self.order[at], -1)
                ids[:m, size - 1] = np.where((got < 0) & (size == 1), self.unknown, got)
            yield rows, ids


def forward(ids: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """alpha[position, word, language] scaled to sum 1 at each position, and log scale[position, word]."""
    n, sizes, rows = ids.shape
    alpha = np.zeros((n + 1, rows, p.shape[1]))
    scale = np.zeros((n + 1, rows))
    alpha[0] = 1.0
    for j in range(1, n + 1):
        total = np.zeros((rows, p.shape[1]))
        for size in range(1, min(sizes, j) + 1):
            piece = ids[j - size, size - 1]
            hit = np.flatnonzero(piece >= 0)
            if len(hit):
                # positions have scales of their own
                total[hit] += alpha[j - size, hit] * p[piece[hit]] * np.exp(scale[j - size, hit] - scale[j - 1, hit])[:, None]
        top = np.maximum(total.max(1), 1e-300)
        alpha[j] = total / top[:, None]
        scale[j] = scale[j - 1] + np.log(top)
    return alpha, scale


def marginals(pieces: Pieces, p: np.ndarray, words: list[str]) -> np.ndarray:
    """log probability of each word in each language, summed over all segmentations."""
    out = np.zeros((len(words), p.shape[1]))
    for rows, ids in pieces.lattice(words):
        alpha, scale = forward(ids, p)
        out[rows] = np.log(np.maximum(alpha[-1], 1e-300)) + scale[-1][:, None]
    return out


def expected(pieces: Pieces, p: np.ndarray | None, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected piece counts [piece, language]; counts[word, language]. Without p: occurrences."""
    out = np.zeros((pieces.unknown + 1, counts.shape[1]))
    for at, ids in pieces.lattice(words):
        c = counts[at]
        n, sizes, rows = ids.shape
        if p is None:
            for i in range(n):
                for s in range(min(sizes, n - i)):
                    hit = np.flatnonzero(ids[i, s] >= 0)
                    np.add.at(out, ids[i, s, hit], c[hit])
            continue
        alpha, scale = forward(ids, p)
        # beta in units of exp(scale[n] - scale[j]) / alpha[n], so that alpha * p * beta is the posterior
        beta = np.zeros((n + 1, rows, p.shape[1]))
        beta[n] = 1.0 / np.maximum(alpha[n], 1e-300)
        for j in range(n - 1, -1, -1):
            for s in range(min(sizes, n - j)):
                piece = ids[j, s]
                hit = np.flatnonzero(piece >= 0)
                if len(hit):
                    k = j + s + 1
                    part = p[piece[hit]] * beta[k, hit] * np.exp(scale[j, hit] - scale[k, hit])[:, None]
                    beta[j, hit] += part
                    np.add.at(out, piece[hit], np.minimum(alpha[j, hit] * part, 1.0) * c[hit])
    return out


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, pieces_path: str, sample: int = SAMPLE, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """(languages, p[piece, language]) from rows with a language."""
    spark = docs.sparkSession
    rows = docs.where(column(lang_col).isNotNull()).select(column(id_col).alias("id"), column(lang_col).cast("string").alias("lang"), column(text_col).cast("string").alias("text"))
    per = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(per)
    if not langs:
        return [], np.zeros((0, 0))
    share = spark.createDataFrame([(k, min(1.0, sample / n)) for k, n in per.items()], "lang string, share double")
    chosen = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < F.col("share") * (1 << 30))

    def count(batches):
        from collections import Counter

        for batch in batches:
            by: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, Counter()).update(words_of(text or ""))
            for lang, c in by.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["lang", "w", "n"])

    words, path = save(chosen.select("lang", "text").mapInArrow(lean(count), "lang string, w string, n long").groupBy("lang", "w").agg(F.sum("n").alias("n")), "language-words")
    place = {k: i for i, k in enumerate(langs)}
    p = None
    for _ in range(rounds + 1):
        now = spark.sparkContext.broadcast(p)

        def tally(batches, now=now):
            pieces = Pieces(pieces_path)
            out = np.zeros((pieces.unknown + 1, len(langs)))
            for batch in batches:
                ws, where = np.unique(np.array(batch.column(1).to_pylist(), object), return_inverse=True)
                counts = np.zeros((len(ws), len(langs)))
                np.add.at(counts, (where, np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)), batch.column(2).to_numpy())
                out += expected(pieces, now.value, list(ws), counts)
            i, j = np.nonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(out[i, j])], ["i", "j", "n"])

        sums = words.mapInArrow(lean(tally), "i long, j long, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).toArrow()  # pieces x languages
        size = len(Pieces(pieces_path).pieces) + 1
        total = np.zeros((size, len(langs)))
        total[sums.column(0).to_numpy(), sums.column(1).to_numpy()] = sums.column(2).to_numpy()
        total += 0.01
        p = total / total.sum(0)
    drop(spark, path)
    return langs, p


def identify(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", pieces_path: str | None = None) -> DataFrame:
    """Every row with lang_pred and score (columns of these names in docs are replaced);
    ``train`` tells the rows that may be learnt from."""
    if pieces_path is None:
        import public_tokenizers

        pieces_path = public_tokenizers.path("piece_bpe_32k.model")
    docs = docs.select(*[column(c) for c in docs.columns if c not in ("lang_pred", "score")], train.alias("__train"))
    langs, p = learn(docs.where("__train"), id_col, text_col, lang_col, pieces_path)
    shared = docs.sparkSession.sparkContext.broadcast(p)
    docs = docs.drop("__train")
    schema = docs.schema
    at = docs.columns.index(text_col)

    def judge(batches):
        pieces = Pieces(pieces_path)
        memo: dict[str, int] = {}
        known = np.zeros((0, max(1, len(langs))))
        for batch in batches:
            texts = batch.column(at)
            pred, score = [UND] * len(batch), np.zeros(len(batch))
            _, offs = text_buffers(texts)
            for a, b in slices(offs, 1 << 20):
                lists = [words_of(t) if t else [] for t in texts.slice(a, b - a).to_pylist()]
                if not langs:
                    continue
                if len(memo) > MEMO:
                    memo, known = {}, known[:0].copy()
                new = list({w for ws in lists for w in ws}.difference(memo))
                if new:
                    memo.update(zip(new, range(len(memo), len(memo) + len(new)), strict=True))
                    known = np.concatenate([known, marginals(pieces, shared.value, new)])
                per = np.array([len(ws) for ws in lists])
                flat = np.fromiter((memo[w] for ws in lists for w in ws), np.int64, per.sum())
                full = np.flatnonzero(per)
                if not len(full):
                    continue
                sums = np.add.reduceat(known[flat], (np.cumsum(per) - per)[full])
                best = sums.argmax(1)
                average = (sums - sums.max(1, keepdims=True)) / per[full, None]
                posterior = 1 / np.exp(average).sum(1)
                for i, k, s in zip(full, best, posterior, strict=True):
                    pred[a + i], score[a + i] = langs[k], s
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    names = [f"c{i}" for i in range(len(schema))]
    ddl = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, schema, strict=True))
    out = docs.toDF(*names).mapInArrow(lean(judge), f"{ddl}, lang_pred string, score double")
    return out.toDF(*docs.columns, "lang_pred", "score")


def op8_segmentation_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(crc32_of_id(F.col("doc_id")), F.lit(5)) == 0
    out = identify(docs, ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
