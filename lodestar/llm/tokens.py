"""Token counts of whole texts, huge documents by overlap resynchronisation.

A huge document is encoded in overlapping chunks whose token offsets are known.
Two neighbouring chunks are spliced at a byte position that begins a token in
both encodings and is a *proven* stable boundary: a printable ASCII byte followed
by white space. No alternative of the byte-level pre-tokeniser's pattern can match
across such a position (white space only opens a match, or matches white space
alone) and no special token holds white space, so what stands on either side of it
is encoded alike with or without the other side. Where the overlap has no such
position it is widened to the left, and past the chunk's start the chunk itself is
grown; a document without any white space thus ends as one piece.

Defined results: null text counts as empty (0 bytes, 0 tokens); a null id stays
null; repeated rows each get a row; an empty table gives an empty table; only the
named columns are read, so others may have any name.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, lean, slices, table, text_buffers

#: Fixed value: the byte-level pre-tokeniser's pattern, in its possessive public form.
BYTE_LEVEL = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
CHUNK, OVERLAP = 1 << 16, 256
_ENCODERS: dict[str, "Encoder"] = {}


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids(bytes) -> numpy array, as the file's own library gives them.

    For a byte-level ``.json`` whose vocabulary also exists as ranks beside it, the
    rank encoder is used: the same ids (checked when loaded), about six times faster."""

    def __init__(self, path: str):
        self.path, self.core, self.bounded = path, None, False
        if path.endswith(".model"):
            import sentencepiece

            self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.hf = Tokenizer.from_file(path)
        self.bounded = "ByteLevel" in repr(self.hf.pre_tokenizer)
        ranks_file = path.removesuffix(".json") + ".tiktoken"
        if self.bounded and os.path.exists(ranks_file):
            import tiktoken

            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {t.content: i for i, t in self.hf.get_added_tokens_decoder().items()}
            enc = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)
            probe = "It's 12 naïve  words,\n\n'll <|endoftext|> end 　x  "
            if enc.encode(probe, allowed_special="all") == self.hf.encode(probe, add_special_tokens=False).ids:
                self.core, self.special = enc._core_bpe, set(special)
                size = max([*ranks.values(), *special.values()]) + 1
                self.lengths = np.zeros(size, np.int64)
                for token, i in [*ranks.items(), *((s.encode(), i) for s, i in special.items())]:
                    self.lengths[i] = len(token)

    def ids(self, data: bytes) -> np.ndarray:
        text = data.decode("utf-8", "replace")
        if self.core is not None:
            try:
                return np.frombuffer(self.core.encode_to_tiktoken_buffer(text, self.special), "<u4")
            except BaseException as e:  # the rank encoder panics on some pathological inputs
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
        if hasattr(self, "sp"):
            return np.array(self.sp.encode(text), "<u4")
        return np.array(self.hf.encode(text, add_special_tokens=False).ids, "<u4")

    def with_offsets(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(ids, byte position after each token)."""
        if self.core is not None:
            ids = self.ids(data)
            ends = np.cumsum(self.lengths[ids])
            if not len(ids) or ends[-1] == len(data):
                return ids, ends
        text = data.decode("utf-8", "replace")
        e = self.hf.encode(text, add_special_tokens=False)
        at = np.zeros(len(text) + 1, np.int64)
        cp = np.frombuffer(text.encode("utf-32-le"), "<u4")
        at[1:] = np.cumsum(1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF))
        return np.array(e.ids, "<u4"), at[np.array([o[1] for o in e.offsets], np.int64)]

    def encode(self, data: bytes, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
        """Ids of a whole text, by chunks if it is longer than ``chunk`` bytes."""
        if len(data) <= chunk or not self.bounded:
            return self.ids(data)
        return np.concatenate(list(spliced(data, self.with_offsets, chunk, overlap)))


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def stable(raw: np.ndarray, start: int, end: int) -> np.ndarray:
    """Proven boundaries p in (start, end): printable ASCII at p-1, white space at p."""
    a, b = raw[start : end - 1], raw[start + 1 : end]
    white = (b == 0x20) | (b == 0x0A) | (b == 0x0D) | (b == 0x09)
    return np.flatnonzero((a > 0x20) & (a < 0x7F) & white) + start + 1


def spliced(data: bytes, encode, chunk: int, overlap: int):
    """Runs of ids of ``data``; encode(bytes) gives (ids, end offsets)."""
    raw, n = np.frombuffer(data, np.uint8), len(data)

    def character(p: int) -> int:
        while 0 < p < n and (raw[p] & 0xC0) == 0x80:
            p -= 1
        return p

    done, start, end = 0, 0, character(min(chunk, n))
    ids, ends = encode(data[start:end])
    while end < n:
        wide = overlap
        while True:
            lo = character(max(done, end - wide))
            hi = character(min(n, max(end + 1, lo + chunk)))
            if hi <= end:
                hi = n
            common = stable(raw, lo, end)
            if len(common):
                more, more_ends = encode(data[lo:hi])
                common = common[np.isin(common, ends + start) & np.isin(common, more_ends + lo)]
            if len(common):
                p = int(common[-1])
                yield ids[np.searchsorted(ends + start, done, "right") : np.searchsorted(ends + start, p, "right")]
                done, start, end, ids, ends = p, lo, hi, more, more_ends
                break
            if lo > done:
                wide *= 4
            else:  # nothing stable in all that is undecided: grow the chunk itself
                start, end = done, character(min(n, done + 2 * (end - done)))
                if end <= start:
                    end = n
                ids, ends = encode(data[start:end])
                if end == n:
                    break
    yield ids[np.searchsorted(ends + start, done, "right") :]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row. One narrow stage, no shuffle."""
    path = tokenizer or vocabulary()
    id_type = docs.select(column(id_col)).schema[0].dataType.simpleString()

    def count(batches):
        enc = encoder(path)
        for batch in batches:
            buf, offs = text_buffers(batch.column(1))
            n = np.empty(len(batch), np.int64)
            for a, b in slices(offs):
                part = buf[offs[a] : offs[b]].tobytes()
                for i in range(a, b):
                    n[i] = len(enc.encode(part[offs[i] - offs[a] : offs[i + 1] - offs[a]], chunk, overlap))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offs)), pa.array(n)], ["id", "n_bytes", "n_tokens"])

    out = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"))
    return out.mapInArrow(lean(count), f"id {id_type}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 512)
