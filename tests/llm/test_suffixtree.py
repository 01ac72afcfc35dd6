"""Lookups and numberings of the suffix tree, and counts that are handed on in parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import common, suffixtree


@pytest.mark.parametrize("n", [0, 1, 5, 3000])
def test_hashes_are_found_by_their_first_bits(n):
    rng = np.random.default_rng(n)
    ends = np.array([np.iinfo(np.int64).min, -1, 0, 1, np.iinfo(np.int64).max])
    for low, high in ((-(1 << 63), 1 << 63), (7, 7 + 4 * n + 1)):  # spread, and all with the same first bits
        table = np.unique(rng.integers(low, high, n))
        keys = np.concatenate([table, table + 1, ends, rng.integers(low, high, 2000)])
        at, hit = suffixtree.Hashed(table).find(keys)
        assert (hit == np.isin(keys, table)).all() and (table[at[hit]] == keys[hit]).all()
    at, hit = suffixtree.Hashed(ends).find(ends)
    assert hit.all() and (at == np.arange(5)).all()


def test_keys_are_numbered_in_order():
    keys = np.random.default_rng(3).integers(-50, 50, 400)
    distinct, number = suffixtree.numbered(keys)
    assert distinct.tolist() == sorted(set(keys.tolist())) and (distinct[number] == keys).all()
    assert [len(x) for x in suffixtree.numbered(keys[:0])] == [0, 0]


def test_strings_after_contexts():
    rng = np.random.default_rng(4)
    symbols = rng.integers(0, 6, 500)
    place = np.arange(500) % 50
    key = suffixtree.strings(symbols, place, 2)
    contexts = np.unique(key >> suffixtree.BITS)[::5]
    assert suffixtree.strings(symbols, place, 2, contexts).tolist() == key[np.isin(key >> suffixtree.BITS, contexts)].tolist()


def test_words_hashed_by_parts_are_the_same(monkeypatch):
    texts = [b"", b"one two", b"three", b"", b" four five  six", b"seven" * 9, b""]
    low, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    start, end, doc = common.word_spans(low, offs)
    want = [x.tolist() for x in (start, end, doc, common.word_hashes(low, start, end))]
    for part in (1, 20, 1000):
        monkeypatch.setattr(suffixtree, "PART", part)
        assert [x.tolist() for x in suffixtree.hashed_words(low, offs)] == want


def test_counts_handed_on_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vocab = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(60)]
    texts = [" ".join(rng.choice(vocab, 40)) for _ in range(120)] + [None, "", " \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    run = lambda: sorted(map(tuple, suffixtree.score(docs, F.col("doc_id") % 3 > 0).collect()))
    whole = run()
    monkeypatch.setattr(suffixtree, "HELD", 0)
    assert run() == whole and len(whole) == len(texts)
