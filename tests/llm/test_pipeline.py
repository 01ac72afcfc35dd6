"""Stages of the corpus pipeline against what they promise on planted rows."""

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lodestar.llm import repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], SCHEMA)


def _words(seed, n, low=4, high=9):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("abcdefghij"), rng.integers(low, high))) for _ in range(n)]


def test_shared_passages_of_51_words_are_cut(spark):
    short, usual = " ".join(_words(1, 51, 1, 2)), " ".join(_words(2, 51))
    assert len(short) == 101 and len(usual) < 400
    own = [" ".join(_words(s, 90)) for s in range(10, 18)]
    texts = [f"{own[0]} \n{short}\t {own[1]}", f"{own[2]}\r{short}\v{own[3]}", f"{own[4]} \n{usual}\t {own[5]}", f"{own[6]}\r{usual}\v{own[7]}"]
    out = {r.doc_id: r.text for r in corpus_pipeline.suffix_dedup(spark, _frame(spark, texts), "").collect()}
    assert out == {0: f"{own[0]} \n\t {own[1]}", 1: f"{own[2]}\r\v{own[3]}", 2: f"{own[4]} \n\t {own[5]}", 3: f"{own[6]}\r\v{own[7]}"}


@pytest.mark.parametrize("length", [101, 150])
def test_repeats_of_other_lengths_match_brute_force(spark, length):
    rng = np.random.default_rng(3)
    pool = [" ".join(_words(s, 40)) for s in range(20, 24)]
    texts = [" ".join([*_words(100 + i, 30), *(pool[j][a : a + n] for j, a, n in zip(rng.integers(0, 4, 3), rng.integers(0, 60, 3), rng.integers(80, 180, 3)))]) for i in range(20)] + ["ab " * 120, "x" * 300]
    starts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    want = {}
    for d, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                gone[i : i + length] = True
        want[d] = "".join(c for c, g in zip(t, gone, strict=True) if not g)
    assert {r.doc_id: r.text for r in repeats.remove_repeats(_frame(spark, texts), length=length).collect()} == want
    assert sum(map(len, want.values())) < sum(map(len, texts))


def test_near_copies_of_four_fifths_go(spark):
    texts = []
    for s in range(40):  # 100 shingles; two changed words leave 90 of them and add 10
        words = _words(200 + s, 104)
        other = list(words)
        other[30], other[70] = "changed", "words"
        texts += [" ".join(words), " ".join(other)]
    for k in (20, 50, 85):  # three of them are too many
        words[k] = "changed"
    texts.append(" ".join(words))
    out = corpus_pipeline.near_dedup(spark, _frame(spark, texts), "")
    assert sorted(r.doc_id for r in out.collect()) == [*range(0, 80, 2), 80]


def test_stages_with_nulls_repeats_and_long_texts(spark, tmp_path):
    rng = np.random.default_rng(9)
    vocab = {k: ["".join(rng.choice(list(letters), rng.integers(3, 8))) for _ in range(200)] for k, letters in (("en", "abcdefgh"), ("de", "stuvwxyz"))}
    text = lambda k, n: " ".join(rng.choice(vocab[k], n))
    rows = [(i, text(k := ["en", "de"][i % 2], 60), k, f"s{i % 3}", 1) for i in range(40)]
    rows += [rows[4], (40, None, None, None, None), (41, "", "en", None, 0), (42, "12 34 !?", "de", "s1", 8), (None, text("en", 70), "en", "s2", 1), (43, text("de", 30_000), "de", None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = corpus_pipeline.language_id(spark, docs, "")
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter([*range(40), 4, None, 43])
    once = corpus_pipeline.near_dedup(spark, kept, "")
    assert once.columns == docs.columns and Counter(r.doc_id for r in once.collect()) == Counter([*range(40), None, 43])
    mixed = corpus_pipeline.mixing(spark, once, "").collect()
    size = Counter()
    for r in mixed:
        size[r.source] += len(r.text.split())
    assert max(Counter(r.doc_id for r in mixed).values()) <= 3 and set(size) <= {"s0", "s1", "s2", None}
    pieces = corpus_pipeline.packing(spark, docs, "").collect()
    assert {r.doc_id for r in pieces} == {r[0] for r in rows} and max(r.length for r in pieces) <= 1024
    for name, some in (("rows", docs), ("none", docs.limit(0))):
        some.write.parquet(str(tmp_path / name / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert bool(out) == (name == "rows") and not {r.doc_id for r in out} & {40, 41, 42}


def test_long_texts_are_cut_whole(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 4000)
    shared = " ".join(_words(7, 400))
    texts = [" ".join(_words(s, 1500)) + shared + " ".join(_words(s + 50, 1500)) for s in (1, 2)]
    out = repeats.remove_repeats(_frame(spark, texts), length=400).collect()
    starts = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    for r in out:
        t, gone = texts[r.doc_id], set()
        for i in range(len(t) - 399):
            if starts[t[i : i + 400]] > 1:
                gone |= set(range(i, i + 400))
        assert r.text == "".join(c for i, c in enumerate(t) if i not in gone) and r.n_removed == len(gone) > 2000


def test_one_byte_repeated_over_whole_pieces_goes_whole(spark):
    texts = ["x" * (k * repeats.PIECE + 399 + more) for k, more in ((1, 0), (1, -1), (2, 0))]
    texts = [t.replace("x", c) for t, c in zip(texts, "xyz", strict=True)]  # no text repeats another's strings
    out = repeats.remove_repeats(_frame(spark, texts), length=400).collect()
    assert {r.doc_id: (r.n_removed, r.n_spans, r.text) for r in out} == {i: (len(t), 1, "") for i, t in enumerate(texts)}
