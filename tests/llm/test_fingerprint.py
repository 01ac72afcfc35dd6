"""Fingerprints of planted groups and short texts."""

import glob
import os
import time

import numpy as np

from lodestar.llm import common, fingerprint


def _words(rng, n):
    return ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(n)]


def test_a_group_above_the_band_is_alike(spark):
    rng = np.random.default_rng(1)
    base, texts = _words(rng, 300), []
    for _ in range(30):  # half of all rows
        words = list(base)
        words[int(rng.integers(300))] = _words(rng, 1)[0]
        texts.append(" ".join(words))
    texts += [" ".join(_words(rng, 300)) for _ in range(30)]
    rows = fingerprint.compare(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert np.median([r.near_next for r in rows if 0 < r.doc_id < 30]) > 0.5
    assert np.median([r.near_edited for r in rows if 0 < r.doc_id < 30]) > 0.5
    assert max(r.near_next for r in rows if r.doc_id > 30) < 0.2


def test_short_texts_use_all_their_terms(spark):
    rng = np.random.default_rng(2)
    vocab = _words(rng, 400)
    texts = [" ".join(rng.choice(vocab, 6, replace=False)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = fingerprint.compare(docs).collect()
    assert fingerprint.lexicon(docs, docs["text"]).count() == sum(sum(w in t for t in map(str.split, texts)) > 1 for w in vocab)
    assert not any(r.fingerprint.startswith("text") for r in rows)
    assert min(r.near_edited for r in rows) > 0


def test_steps_leave_no_files_behind(spark):
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, " ".join(_words(rng, 300))) for i in range(40)], "doc_id long, text string")
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffled = lambda: {f for d in folders for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}
    tables = lambda: set(glob.glob(f"{common.shared_dir(spark)}/lodestar-*"))
    had, held, setting = shuffled(), tables(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    out = fingerprint.compare(docs)
    assert [t.rsplit("-", 1)[1] for t in tables() - held] == ["prints"]
    bytes_left = lambda: sum(os.path.getsize(f) for f in shuffled() - had)
    until = time.time() + 10  # they go in the background
    while bytes_left() > 5000 and time.time() < until:
        time.sleep(0.2)
    assert bytes_left() <= 5000  # a few rows' counts; the texts are 96,000 bytes
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting
    assert out.count() == 40
