"""Language-model scores from a probabilistic suffix tree over words.

The tree's symbols are the words above FREQUENT of all tokens (at most 1 / FREQUENT
of them), a class for each last two bytes of all other words, a start and an end. A
context of one, two or three symbols is a state if its next-symbol distribution
diverges from that of its longest retained suffix (likelihood-ratio test over the
strings seen LEAST times or more, and the rest). Distributions are smoothed by
discounting towards that suffix, down to the root; each token is scored by the
longest retained suffix of what precedes it. Within a class a word has its share of
the class's smoothed count. The root is exactly the add-one unigram of the base
score, so a text's score is its base score plus the log ratios of tree and root.

The stem of the tree is small and travels to all tasks: contexts of one symbol, and
of those of two the hot ones (above HOT of all tokens, at most 1 / HOT), with strings
that make up P_MIN of all symbols, so at most 2 / P_MIN entries. All other contexts
are leaves of the stem: they are kept by their counts alone, however many there are,
and so grow with the corpus. No task sees them all. Each token goes, 9 bytes wide,
compressed and packed by slice of documents, to the bucket of its last two symbols (three, if those
are hot), where the states of that bucket are learnt and its tokens scored; a bucket
has about BUCKET tokens, whatever the corpus. Per-document sums come back by slice, by
place in it: a slice's keys are written once. (Rows of a lost task must come again in
their order, as those of a stored table do; otherwise the job fails.)

Word counts are exact and shuffled by word (they grow with the corpus). Words above
COMMON of all tokens, at most 1 / COMMON of them, are looked up in a broadcast
table; the others are joined by hash, and none of them can be a hot key.

Defined results: null text is empty (one end token); a null id counts as the empty
text in the split; repeated rows are rows of their own; texts of any length are scored
whole; only the two named columns and those of ``train`` are read, so others may have
any name; an empty table gives an empty table; without training rows all counts are 0
and the root is all there is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, column, crc32_of_id, lean, mix64, save, signed, slices, table, text_buffers, word_hashes, word_spans

P_MIN, FREQUENT, COMMON, DISCOUNT, LEAST = 2e-6, 1e-5, 1e-6, 0.75, 2
HOT, BUCKET = 1e-3, 500_000
HELD, PART = 1 << 19, 1 << 19  # counts held by a task before they are handed on; bytes hashed at once
WIDE = 9  # bytes of four symbols
END_WORD = b"\n"  # white space: no word is equal to it
END_HASH = int(signed(mix64(np.array([0xE0D], np.uint64)))[0])
#: Symbols: start, end, 65536 classes, frequent words; 18 bits hold them while 1 / FREQUENT <= 100000.
START, END, CLASSES, WORDS, BITS = 0, 1, 2, 2 + 65536, 18


def gather(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans as a binary column."""
    size = end - start
    offs = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(offs[-1]) - np.repeat(offs[:-1], size) + np.repeat(start, size)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(buf[at]))])


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hits) of keys in an ascending table."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Hashed:
    """An ascending table of hashes, searched by their first bits."""

    def __init__(self, table: np.ndarray):
        bits = min(22, max(1, len(table)).bit_length() + 1)
        self.n, self.shift = len(table), np.uint64(64 - bits)
        self.table = np.append(table, np.iinfo(np.int64).max)
        self.first = np.searchsorted(self.top(table), np.arange(1 << bits)).astype(np.int32)

    def top(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) ^ np.uint64(1 << 63)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, hits) of keys; a place without a hit may be one past the last."""
        at = self.first[self.top(keys)]
        there = self.table[at]
        late = np.flatnonzero(there < keys)
        while len(late):
            at[late] += 1
            there[late] = self.table[at[late]]
            late = late[there[late] < keys[late]]
        return at, (there == keys) & (at < self.n)


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, ascending; number of each key among them)."""
    order = np.argsort(keys)
    first, ordered = runs(keys[order])
    number = np.empty(len(keys), np.int64)
    number[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
    return ordered[first], number


def runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first places of equal keys, the keys) of keys in order."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(new), ordered


def tail_class(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    before = np.where(end - start > 1, low[np.maximum(end - 2, 0)], 0).astype(np.int64)
    return CLASSES + before * 256 + low[end - 1]


def hashed_words(low: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document, hash) of every word, by parts of whole documents: hashing takes many times their bytes."""
    parts = []
    for a, b in slices(offs, PART):
        part = low[offs[a] : offs[b]]
        start, end, doc = word_spans(part, offs[a : b + 1] - offs[a])
        parts.append((start + offs[a], end + offs[a], doc + a, word_hashes(part, start, end)))
    start, end, doc, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    return start, end, doc, h


def sequence(low: np.ndarray, offs: np.ndarray, frequent: Hashed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, token number within the document, document) of start, words and end of each document."""
    rows = len(offs) - 1
    start, end, doc, h = hashed_words(low, offs)
    per = np.bincount(doc, minlength=rows)
    at, hit = frequent.find(signed(h))
    out = np.full(len(doc) + 2 * rows, END, np.int64)
    first = np.cumsum(per + 2) - (per + 2)
    out[first] = START
    out[np.arange(len(doc)) + 2 * doc + 1] = np.where(hit, WORDS + at, tail_class(low, start, end) if len(doc) else at)
    who = np.repeat(np.arange(rows), per + 2)
    return out, np.arange(len(out)) - first[who], who


def strings(symbols: np.ndarray, place: np.ndarray, order: int, contexts: np.ndarray | None = None) -> np.ndarray:
    """Keys of all symbols with ``order`` symbols before them; of those after ``contexts`` (ascending) only."""
    at = np.flatnonzero(place >= max(order, 1))
    if contexts is not None:
        for j in range(order, 0, -1):  # few symbols occur in contexts
            there = np.zeros(1 << BITS, bool)
            there[(contexts >> BITS * (j - 1)) & ((1 << BITS) - 1)] = True
            at = at[there[symbols[at - j]]]
    key = np.zeros(len(at), np.int64)
    for j in range(order, -1, -1):
        key = (key << BITS) | symbols[at - j]
    return key if contexts is None else key[find(contexts, key >> BITS)[1]]


class Tree:
    """States (contexts) with back-off weights, entries (context, symbol) with their own part."""

    def __init__(self, root: np.ndarray, single: np.ndarray):
        """root: probability of each symbol; single: how often each is followed by another."""
        self.root, self.totals = root, single
        self.states, self.back, self.entries, self.own = [], [], [], []

    def grow(self, keys: np.ndarray, counts: np.ndarray, totals: np.ndarray) -> None:
        """Add the states of the next order; keys ascending, totals: occurrences of each key's context."""
        c, context = counts.astype(float), keys >> BITS
        ids, first, per = np.unique(context, return_index=True, return_counts=True)
        if not len(ids):
            for x in (self.states, self.entries):
                x.append(keys)
            self.back.append(np.zeros(0)), self.own.append(np.zeros(0))
            return
        summed = np.add.reduceat(c, first)
        total = np.maximum(totals[first].astype(float), summed)
        order = len(self.states) + 1
        parent = self.probability(keys, order - 1)
        keep = diverges(np.add.reduceat(c * np.log(c / np.repeat(total, per) / parent), first), total, total - summed, np.add.reduceat(parent, first), per)
        kept = np.repeat(keep, per)
        self.states.append(ids[keep])
        self.back.append(((total - summed + DISCOUNT * per) / total)[keep])
        self.entries.append(keys[kept])
        self.own.append(((c - DISCOUNT) / np.repeat(total, per))[kept])

    def probability(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Of each key's symbol, after the longest retained suffix of at most ``order`` symbols."""
        p = self.root[keys & ((1 << BITS) - 1)]
        for k in range(1, order + 1):
            p = self.step(keys & ((1 << BITS * (k + 1)) - 1), k, p)
        return p

    def step(self, keys: np.ndarray, k: int, p: np.ndarray) -> np.ndarray:
        at, hit = find(self.states[k - 1], keys >> BITS)
        if not hit.any():
            return p
        to, own = find(self.entries[k - 1], keys)
        return np.where(hit, np.where(own, self.own[k - 1][to], 0.0) + self.back[k - 1][at] * p, p)


def diverges(gain: np.ndarray, total: np.ndarray, rest: np.ndarray, mass: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Likelihood-ratio test of contexts: ``gain`` sums c * log(p / parent's p) of their ``per`` strings, which have
    ``mass`` by the parent; what else followed, ``rest`` of ``total`` times, is one string more."""
    other = np.where(rest > 0, rest * np.log(np.maximum(rest, 1e-300) / np.maximum(total, 1e-300) / np.maximum(1 - mass, 1e-9)), 0.0)
    return (per > 0) & (2 * (gain + other) > per + 4 * np.sqrt(2.0 * per))


def leaves(string: np.ndarray, context: np.ndarray, weight: np.ndarray, p: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Probability of each string's symbol after its context if that is retained, else ``p``, its parent's. ``string``
    numbers the tokens' strings, ``context`` the strings' contexts; weight 1: learnt from."""
    c = np.bincount(string, weight, len(p))
    ok = c >= least
    add = lambda x: np.bincount(context, np.where(ok, x, 0.0))
    total, per, summed = np.bincount(context, c), add(1.0), add(c)
    safe = np.maximum(total, 1.0)
    keep = diverges(add(c * np.log(np.maximum(c, 1.0) / safe[context] / p)), safe, total - summed, add(p), per)
    own, back = np.where(ok, (c - DISCOUNT) / safe[context], 0.0), (total - summed + DISCOUNT * per) / safe
    return np.where(keep[context], own + back[context] * p, p)


def windows(symbols: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, keys of the last two symbols and the next, symbol before those) of all tokens; starts repeat."""
    at = np.flatnonzero(place > 0)
    back = [np.where(place[at] >= j, symbols[np.maximum(at - j, 0)], START) for j in range(4)]
    return at, (((back[2] << BITS) | back[1]) << BITS) | back[0], back[3]


def pack_tokens(key: np.ndarray, third: np.ndarray) -> np.ndarray:
    """[token, WIDE] bytes of four symbols of BITS bits."""
    low = key.astype(np.uint64) | ((third & 1023).astype(np.uint64) << np.uint64(3 * BITS))
    return np.concatenate([low[:, None].view(np.uint8), (third >> 10).astype(np.uint8)[:, None]], 1)


def unpack_tokens(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, third symbols) from [WIDE, token] bytes."""
    low = np.ascontiguousarray(columns[:8].T).view("<u8")[:, 0]
    third = (low >> np.uint64(3 * BITS)).astype(np.int64) | (columns[8].astype(np.int64) << 10)
    return (low & np.uint64((1 << 3 * BITS) - 1)).astype(np.int64), third


def squeeze(numbers: np.ndarray) -> bytes:
    """Small numbers of 32 bits, compressed by byte column, after the size of that."""
    packed = pa.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)
    return np.uint32(len(packed)).tobytes() + packed


def unsqueeze(packed: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    """(the n numbers squeezed at that place, the place after them)."""
    end = at + 4 + int(np.frombuffer(packed, "<u4", 1, at)[0])
    columns = np.frombuffer(pa.decompress(packed[at + 4 : end], 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(columns.T).view("<u4")[:, 0].astype(np.int64), end


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", p_min: float = P_MIN, frequent: float = FREQUENT, common: float = COMMON) -> DataFrame:
    """(id, in_training, n_tokens, n_known, train_tokens, base_score, score) of every row;
    ``train`` tells the rows that are learnt from."""
    spark = docs.sparkSession
    id_type = docs.select(column(id_col)).schema[0].dataType.simpleString()
    texts = docs.select(column(id_col).alias("id"), train.alias("train"), column(text_col).cast("string").alias("text"))

    def count(batches):
        held: list[tuple] = []

        def flush():
            """One row for each word of the slices held."""
            h, c, m = (np.concatenate([x[i] for x in held]) for i in (0, 2, 3))
            order = np.argsort(h)
            first, h = runs(h[order])
            words = pa.concat_arrays([x[1] for x in held]).take(pa.array(order[first]))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(signed(h[first])), words, *(pa.array(np.add.reduceat(x[order], first)) for x in (c, m))], ["h", "w", "c", "m"])

        for batch in batches:
            learn = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            buf, offs = text_buffers(batch.column(1))
            for a, b in slices(offs, 4 << 20):
                low = LOWER[buf[offs[a] : offs[b]]]
                start, end, doc, h = hashed_words(low, offs[a : b + 1] - offs[a])
                if not len(h):
                    continue
                order = np.argsort(h)
                first, h = runs(h[order])
                one = order[first]
                held.append((h[first], gather(low, start[one], end[one]), np.add.reduceat(learn[a:b][doc[order]], first), np.diff(np.append(first, len(h)))))
                if sum(len(x[0]) for x in held) > HELD:
                    yield flush()
            yield pa.RecordBatch.from_arrays([pa.array([END_HASH]), pa.array([END_WORD], pa.binary()), pa.array([int(learn.sum())]), pa.array([len(batch)])], ["h", "w", "c", "m"])
        if held:
            yield flush()

    counted = texts.select("train", "text").mapInArrow(lean(count), "h long, w binary, c long, m long")
    words, _ = save(counted.groupBy("h", "w").agg(F.sum("c").alias("c"), F.sum("m").alias("m")), "words")
    zero = F.lit(0).cast("long")
    n, v, every = words.agg(F.coalesce(F.sum("c"), zero), F.count_if(F.col("c") > 0), F.coalesce(F.sum("m"), zero)).first()

    # at most 1 / common words, the first 1 / frequent of them symbols of the tree
    often = words.where((F.col("m") >= F.lit(common * every)) & (F.col("h") != END_HASH)).select("h", "c", "m").toArrow().sort_by("h")
    hs, cs, ms = (often.column(i).to_numpy().astype(np.int64) for i in range(3))
    ends = words.where(F.col("h") == END_HASH).agg(F.coalesce(F.sum("c"), zero)).first()[0]
    hs, cs, ms = np.append(hs, END_HASH), np.append(cs, ends), np.append(ms, every + 1)
    order = np.argsort(hs)
    hs, cs, ms = hs[order], cs[order], ms[order]
    is_symbol = (cs >= frequent * n) & (cs > 0) & (hs != END_HASH)
    symbol_hashes, symbol_counts = hs[is_symbol], cs[is_symbol]

    # counts of the root's symbols: classes from the words that are no symbols themselves
    z, single = np.zeros(1 << BITS), np.zeros(1 << BITS)
    last = F.conv(F.hex(F.substring("w", -2, 2)), 16, 10).cast("int")
    rest = words.where((F.col("c") > 0) & (F.col("h") != END_HASH) & ~((F.col("m") >= F.lit(common * every)) & (F.col("c") >= F.lit(frequent * n))))
    for r in rest.groupBy(last.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():  # at most 65536
        z[CLASSES + r.k], single[CLASSES + r.k] = r.c + r.v, r.c
    z[WORDS : WORDS + len(symbol_counts)] = symbol_counts + 1
    single[WORDS : WORDS + len(symbol_counts)] = symbol_counts
    z[END] = ends + 1
    single[START] = ends
    tree = Tree(np.maximum(z, 1.0) / (n + v + 1), single)

    def count_strings(order: int, contexts: np.ndarray | None):
        """Strings of one order that make up p_min of all, after those contexts."""

        def run(batches):
            frequent = Hashed(symbol_hashes)
            held: list[np.ndarray] = []

            def flush():
                key, c = np.unique(np.concatenate(held), return_counts=True)
                held.clear()
                return pa.RecordBatch.from_arrays([pa.array(key), pa.array(c)], ["k", "c"])

            for batch in batches:
                buf, offs = text_buffers(batch.column(0))
                for a, b in slices(offs, 4 << 20):
                    symbols, place, _ = sequence(LOWER[buf[offs[a] : offs[b]]], offs[a : b + 1] - offs[a], frequent)
                    held.append(strings(symbols, place, order, contexts))
                    if sum(map(len, held)) > 4 * HELD:
                        yield flush()
            if held:
                yield flush()

        found = texts.where("train").select("text").mapInArrow(lean(run), "k long, c long").groupBy("k").agg(F.sum("c").alias("c"))
        found = found.where(F.col("c") >= F.lit(max(float(LEAST), p_min * n))).toArrow().sort_by("k")  # at most 1 / p_min
        return found.column(0).to_numpy().astype(np.int64), found.column(1).to_numpy().astype(np.int64)

    keys, counts = count_strings(1, None)
    tree.grow(keys, counts, single[keys >> BITS])
    hot, times = (x[counts >= max(1.0, HOT * n)] for x in (keys, counts))
    keys, counts = count_strings(2, hot) if len(hot) else (keys[:0], counts[:0])
    tree.grow(keys, counts, times[find(hot, keys >> BITS)[0]] if len(hot) else counts)
    shared = spark.sparkContext.broadcast((tree, hs, cs, hot))
    floor = float(np.log10(n + v + 1))
    buckets = max(32, int(every) // BUCKET)

    def deal(batches):
        """Each slice's tokens by bucket: documents' places in the slice, tokens a document and the use, symbols. One
        row more, of no documents, has the keys of all of the slice's."""
        hot = Hashed(np.sort(signed(mix64(shared.value[3].astype(np.uint64)))))
        frequent = Hashed(symbol_hashes)
        for batch in batches:
            buf, offs = text_buffers(batch.column(2))
            who_is = batch.column(1).to_numpy().view(np.uint64)
            learn = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint32)
            for a, b in slices(offs, 16 << 20):
                symbols, place, doc = sequence(LOWER[buf[offs[a] : offs[b]]], offs[a : b + 1] - offs[a], frequent)
                at, key, third = windows(symbols, place)
                doc = doc[at]
                context = (key >> BITS).astype(np.uint64)
                mixed = mix64(context)
                wide = np.flatnonzero(hot.find(signed(mixed))[1])
                mixed[wide] = mix64(mix64(context[wide] + np.uint64(1)) ^ third[wide].astype(np.uint64))
                # numbers of 16 bits are sorted fastest
                to = ((mixed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
                by = np.argsort(to, kind="stable")
                to, doc, tokens = to[by].astype(np.int64), doc[by], pack_tokens(key[by], third[by])
                edge = np.flatnonzero(np.diff(to, prepend=-1))
                packed = []
                for x, y in zip(edge, [*edge[1:], len(to)], strict=True):
                    d = np.flatnonzero(np.diff(doc[x:y], prepend=-1))
                    of = doc[x:y][d]
                    size = (np.diff(np.append(d, y - x)).astype(np.uint32) << np.uint32(1)) | learn[a:b][of]
                    packed.append(np.uint32(len(d)).tobytes() + squeeze(np.append(np.diff(of, prepend=0), size)) + pa.compress(tokens[x:y].T.tobytes(), codec="zstd", asbytes=True))
                source = int(signed(mix64(np.bitwise_xor.reduce(mix64(who_is[a:b] + np.arange(b - a, dtype=np.uint64)), keepdims=True)))[0])
                packed.append(np.uint32(0).tobytes() + who_is[a:b].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(np.append(to[edge], source % buckets)), pa.array(np.full(len(packed), source)), pa.array(packed, pa.binary())], ["bucket", "source", "packed"])

    def judge(batches):
        """Learn a bucket's states and sum what its tokens gain, by slice and document."""
        tree = shared.value[0]
        held: list[tuple] = []

        def flush():
            steps, per, learnt, tokens = [], [], [], []
            for _, _, x in held:
                d = int(np.frombuffer(x, "<u4", 1)[0])
                head, end = unsqueeze(x, 4, 2 * d)
                steps.append(head[:d])
                per.append(head[d:] >> 1)
                learnt.append(head[d:] & 1)
                t = int(per[-1].sum())
                tokens.append(np.frombuffer(pa.decompress(x[end:], WIDE * t, codec="zstd", asbytes=True), np.uint8).reshape(WIDE, t))
            docs = np.array([len(x) for x in steps])
            per = np.concatenate(per)
            key, third = unpack_tokens(np.concatenate(tokens, 1))
            weight = np.repeat(np.concatenate(learnt), per).astype(float)
            last = (1 << BITS) - 1
            keys, string = numbered(key)
            p = tree.probability(keys, 2)
            context = np.cumsum(np.diff(keys >> BITS, prepend=keys[:1] >> BITS) != 0)
            second = leaves(string, context, weight, p)
            # the stem has the states of hot contexts
            p = np.where(find(shared.value[3], keys >> BITS)[1], p, second)
            longer, number = numbered((string << BITS) | third)
            of = longer >> BITS  # the shorter string of each
            p = leaves(number, numbered((context[of] << BITS) | (longer & last))[1], weight, p[of])
            gain = np.log10(p / tree.root[keys[of] & last])[number]
            of = np.repeat(np.arange(len(per)), per)
            gain, ends = np.bincount(of, gain, len(per)).astype("<f4"), np.bincount(of, key & last == END, len(per))
            at = np.concatenate([[0], np.cumsum(docs)])
            out = [np.uint32(len(d)).tobytes() + squeeze(np.append(d, ends[x:y])) + gain[x:y].tobytes() for d, x, y in zip(steps, at[:-1], at[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([x[1] for x in held], pa.int64()), pa.array(out, pa.binary())], ["source", "gained"])

        for batch in batches:
            for x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if x[2][:4] == bytes(4):  # a slice's keys go on to where its documents' sums meet
                    yield pa.RecordBatch.from_arrays([pa.array([x[1]], pa.int64()), pa.array([x[2]], pa.binary())], ["source", "gained"])
                    continue
                if held and held[-1][0] != x[0]:
                    yield flush()
                    held = []
                held.append(x)
        if held:
            yield flush()

    def collect(batches):
        held: list[bytes] = []
        last = None

        def flush():
            """Slices of the same documents in the same order have one source, and are summed."""
            who = [np.frombuffer(x, "<u8", -1, 4) for x in held if x[:4] == bytes(4)]
            if not who:
                raise ValueError("a slice changed between attempts: the input must keep its order")
            gain, ends = np.zeros(len(who[0])), np.zeros(len(who[0]), np.int64)
            for x in held:
                if d := int(np.frombuffer(x, "<u4", 1)[0]):
                    head, end = unsqueeze(x, 4, 2 * d)
                    of = np.cumsum(head[:d])  # ascending, so none occurs twice
                    gain[of] += np.frombuffer(x, "<f4", d, end)
                    ends[of] += head[d:]
            return pa.RecordBatch.from_arrays([pa.array(signed(who[0])), pa.array(gain), pa.array(ends)], ["who", "gain", "ends"])

        for batch in batches:
            for source, gained in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and source != last:
                    yield flush()
                    held = []
                held.append(gained)
                last = source
        if held:
            yield flush()

    who = F.xxhash64("id", "text")
    dealt = texts.select("train", who.alias("who"), "text").mapInArrow(lean(deal), "bucket long, source long, packed binary")
    judged = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(judge), "source long, gained binary")
    gains = judged.repartition("source").sortWithinPartitions("source").mapInArrow(lean(collect), "who long, gain double, ends long")
    # equal rows gain alike: each of them its share
    gains, _ = save(gains.groupBy("who").agg((F.sum("gain") / F.sum("ends")).alias("gain")), "gains")

    def add(batches):
        _, hs, cs, _ = shared.value
        often = Hashed(hs)
        base_lp, rid = np.log10(cs + 1.0) - floor, TaskContext.get().partitionId() << 33
        for batch in batches:
            buf, offs = text_buffers(batch.column(3))
            for a, b in slices(offs, 4 << 20):
                low, rows = LOWER[buf[offs[a] : offs[b]]], b - a
                _, _, doc, h = hashed_words(low, offs[a : b + 1] - offs[a])
                h = np.concatenate([signed(h), np.full(rows, END_HASH)])
                doc = np.concatenate([doc, np.arange(rows)])
                at, hit = often.find(h)
                got, owner = at[hit], doc[hit]
                base, known = (np.bincount(owner, x[got], rows) for x in (base_lp, (cs > 0).astype(float)))
                rest = np.flatnonzero(~hit)  # words in order of documents: ends are all in the table
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[rest], minlength=rows))]), pa.int32()), pa.array(h[rest]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(rid, rid + rows)), *(batch.column(i).slice(a, rows) for i in range(3)), pa.array(np.bincount(doc, minlength=rows).astype(np.int64)), pa.array(base), pa.array(known.astype(np.int64)), lists],
                    ["rid", "id", "train", "who", "n", "base", "known", "rest"],
                )
                rid += rows

    part, _ = save(texts.select("id", "train", who.alias("who"), "text").mapInArrow(lean(add), f"rid long, id {id_type}, train boolean, who long, n long, base double, known long, rest array<long>"), "partial")
    rare = part.select("rid", F.explode("rest").alias("h")).join(words.where(F.col("m") < F.lit(common * every)).select("h", "c"), "h")
    rare = rare.groupBy("rid").agg(F.sum(F.log10(F.col("c") + F.lit(1.0)) - floor).alias("b"), F.count_if(F.col("c") > 0).alias("k"))
    out = part.drop("rest").join(rare, "rid", "left").join(gains, "who", "left")
    z0 = lambda c: F.coalesce(c, F.lit(0))
    base = F.col("base") + z0("b")
    return out.select(F.col("id").alias(id_col), F.col("train").alias("in_training"), F.col("n").alias("n_tokens"), (F.col("known") + z0("k")).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("gain")).alias("score"))


def op4_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, F.pmod(crc32_of_id(F.col("doc_id")), F.lit(7)) != 2)
    return out.select("doc_id", (~F.col("in_training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
