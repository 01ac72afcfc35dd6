"""Small fixtures against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import fingerprint, langid, minhash, mixing, packing, quality, repeats, suffixtree, tokens
from lodestar.llm.common import crc32_of_id

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_bytes long"


def _texts():
    rng = np.random.default_rng(5)
    vocab = ["".join(rng.choice(list("abcdeéß"), rng.integers(1, 8))) for _ in range(300)]
    base = [" ".join(rng.choice(vocab, rng.integers(5, 160))) for _ in range(30)]
    words = base[0].split()
    words[len(words) // 2] = "changed"
    passage = " ".join(rng.choice(vocab, 120))
    return [*base, base[0], " ".join(words), base[1] + " " + passage, passage + "\n" + base[2], "", None, " \n\t", "one two", "x" * 3000, "ab " * 900, "Ünïcödé <|endoftext|> it's 12", passage * 40]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], len(t or ""), 0.5, 7) for i, t in enumerate(_texts())]
    rows += [rows[3], (None, "a null id", None, None, 9, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def local(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_token_counts_and_splices(docs, local):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.vocabulary())
    want = Counter((d, len(t.encode()), len(own.encode(t, add_special_tokens=False).ids)) for d, t in local)
    assert Counter(map(tuple, tokens.count_tokens(docs).collect())) == want
    assert Counter(map(tuple, tokens.count_tokens(docs, chunk=64, overlap=4).collect())) == want
    assert tokens.count_tokens(docs.limit(0)).count() == 0


def test_packing_covers_each_id_once(docs, local):
    enc, out = tokens.encoder(tokens.vocabulary()), packing.pack(docs).collect()
    want = Counter()
    for d, t in local:
        want[d] += len(enc.ids(t.encode())) + 1
    got, spans = Counter(), {}
    for p in out:
        got[p.doc_id] += p.length
        spans.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert got == want
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(s[-1]) <= 1024
    one = {p.start: p for p in out if p.doc_id == 0}
    ids, at = np.append(enc.ids((dict(local)[0]).encode()), 0).astype("<u4"), 0
    while at < len(ids):
        assert zlib.crc32(ids[at : at + one[at].length].tobytes()) == one[at].ids_crc32
        at += one[at].length
    assert packing.pack(docs.limit(0)).count() == 0


def test_combinations_use_the_histogram():
    hist = np.zeros(1024, np.int64)
    hist[[700, 324, 512, 100, 224]] = [50, 20, 11, 30, 30]
    used = np.zeros(1024, np.int64)
    for length, first, n, _, _ in packing.plan(hist):
        assert first == used[length]
        used[length] += n
    assert (used <= hist).all() and used[324] == 20 and used[512] == 10 and used[700] >= 40


def _filled(sizes):
    weight, limit = [[5, 2, 1][i % 3] for i in range(len(sizes))], [3.0 * x for x in sizes]
    out, free = [0.0] * len(sizes), {i for i, x in enumerate(sizes) if x}
    while free:
        left = sum(sizes) - sum(out[i] for i in range(len(sizes)) if i not in free)
        share = {i: left * weight[i] / sum(weight[j] for j in free) for i in free}
        over = {i for i in free if share[i] > limit[i]}
        for i in over or free:
            out[i] = limit[i] if over else share[i]
        free = free - over if over else set()
    return out


@pytest.mark.parametrize("sizes", [[100, 100, 1], [1, 1, 1, 500], [0, 7, 0, 90, 2, 3, 1000], [0, 0]])
def test_targets_match_brute_force(spark, sizes):
    rows = spark.createDataFrame([(f"{i:02}", x) for i, x in enumerate(sizes)], "source string, tokens long")
    rows = mixing.number(rows, "source").withColumn("weight", F.expr("array(5.0D, 2.0D, 1.0D)[int(s % 3)]"))
    got = [r.target for r in mixing.targets(rows).orderBy("source").collect()]
    assert np.allclose(got, _filled(sizes))


def test_mixing_reaches_targets(docs, local):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(local) and all(0 <= r.copies <= 3 for r in rows)
    for s in {r.source for r in rows}:
        mine = [r for r in rows if r.source == s]
        assert sum(r.size for r in mine) == mine[0].source_size
        assert abs(sum(r.copies * r.size for r in mine) - mine[0].target) <= max(5, 0.05 * mine[0].target)
    # targets by brute force: sources by code point, null last
    names = sorted({r.source for r in rows}, key=lambda x: (x is None, x or ""))
    sizes = [sum(len(WORD.findall(r.text.encode())) for r in docs.collect() if r.source == s and r.text) for s in names]
    goals = {r.source: r.target for r in rows}
    assert np.allclose([goals[s] for s in names], _filled(sizes))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_near_duplicates_match_brute_force(docs, local):
    sets = {}
    for d, t in local:
        w = WORD.findall(t.encode().lower())
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    up = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a is not None and b is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    up[a] = up[b] = min(up[a], up[b])
    for r in minhash.near_duplicates(docs).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), up[r.doc_id], r.doc_id == up[r.doc_id])
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_links_of_blocks():
    a = np.arange(100, dtype=np.uint64)
    sets = [a, a[:95], a[50:], np.arange(900, 1000, dtype=np.uint64)]
    assert minhash.joins(sets, [b"a", b"b", b"c", b"d"], 85) == [(0, 1)]
    assert minhash.joins(sets, [b"a", b"a", b"c", b"d"], 85) == []


@pytest.mark.parametrize("group", [256, 1])
def test_repeats_match_brute_force(docs, local, group, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", group)
    starts = Counter(b[i : i + 400] for _, t in local for b in [t.encode()] for i in range(len(b) - 399))
    want = Counter()
    for d, t in local:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if starts[b[i : i + 400]] > 1:
                gone[i : i + 400] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[d, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()] += 1
    out = repeats.remove_repeats(docs)
    assert out.columns.count("n_bytes") == 1
    assert Counter(map(tuple, out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())) == want
    assert sum(k[2] for k in want) > 0
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(0)
    t = np.concatenate([rng.integers(0, 3, 400), np.zeros(90, int), rng.integers(0, 2, 300)])
    order, rank = repeats.suffix_array(t)
    assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist()) and (rank[order] == np.arange(len(t))).all()


def test_suffix_tree_base_and_gain(docs, local):
    count = Counter()
    toks = [(d, [*WORD.findall(t.encode().lower()), None]) for d, t in local]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    for d, t in toks:
        if not held(d):
            count.update(t)
    n, v = sum(count.values()), len(count)
    want = sorted((str(d), len(t), sum(count[w] > 0 for w in t), round(sum(np.log10((count[w] + 1) / (n + v + 1)) for w in t), 6)) for d, t in toks)
    rows = suffixtree.score(docs, F.pmod(crc32_of_id(F.col("doc_id")), F.lit(7)) != 2).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score <= 0 and r.train_tokens == n for r in rows)
    assert suffixtree.score(docs.limit(0), F.lit(True)).count() == 0


def test_language_marginals_sum_over_segmentations(docs):
    pieces = langid.Pieces(__import__("public_tokenizers").path("piece_bpe_32k.model"))
    rng = np.random.default_rng(1)
    p = rng.random((pieces.unknown + 1, 2)) / 50
    index = {s: i for i, s in enumerate(pieces.pieces)}

    def total(word, k):
        text, alpha = "▁" + word, [1.0]
        for j in range(1, len(text) + 1):
            alpha.append(sum(alpha[i] * (p[index[text[i:j]], k] if text[i:j] in index else p[-1, k] if j == i + 1 else 0) for i in range(j)))
        return np.log(alpha[-1])

    words = ["the", "häuser", "x", "internationalization"]
    got = langid.marginals(pieces, p, words)
    assert np.allclose(got, [[total(w, k) for k in range(2)] for w in words])
    out = langid.identify(docs, F.lit(True))
    assert out.columns.count("score") == 1
    for r in out.collect():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1
    assert langid.identify(docs.limit(0), F.lit(True)).count() == 0


def test_statistics_and_forest(docs, local, spark):
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(30)], "doc_id long, quality int, toxic int")
    rows = quality.judge(docs, labels).collect()
    want = Counter()
    for d, t in local:
        w = WORD.findall(t.encode())
        tri = Counter(zip(w, w[1:], w[2:]))
        again = {i + j for i in range(len(w) - 2) if tri[w[i], w[i + 1], w[i + 2]] > 1 for j in range(3)}
        lines = [x for x in t.encode().split(b"\n") if WORD.search(x)]
        want[d, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again)] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    x = np.concatenate([np.random.default_rng(0).normal(0, 1, (300, 2)), [[9, 9]]])
    assert quality.Forest(x).scores(x).argmax() == 300
    assert quality.threshold([(900, 0, 10), (300, 1, 90)]) == 900 and quality.threshold([]) == float("inf")
    assert quality.judge(docs.limit(0), labels).count() == 0


def test_fingerprints(docs, local):
    rows = fingerprint.compare(docs).collect()
    distinct = sorted({(d, t) for d, t in local if d is not None}, reverse=True) + [(d, t) for d, t in local if d is None]
    edited = {}
    for (d, t), (_, nxt) in zip(distinct, [*distinct[1:], distinct[0]], strict=True):
        k = len(t) // 3
        edited[d] = hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()
    assert len(rows) == len(local)
    by_text = {}
    text = dict(local)
    for r in rows:
        assert r.n_chars == len(text[r.doc_id]) and r.edited_sha256 == edited[r.doc_id]
        assert by_text.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert fingerprint.compare(docs.limit(0)).count() == 0
