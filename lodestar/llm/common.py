"""Shared pieces of the pipeline operators: the shared folder, Arrow access and
vectorised byte kernels.

Texts reach Python as Arrow string columns; the kernels look at the UTF-8 buffer
in place, a few megabytes of whole documents at a time, so a batch of very long
documents needs no more memory than its largest document.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES, BATCH_BYTES = 2 << 20, 4 << 20
#: A fixed value: the odd constant of 64-bit golden-ratio mixing.
GOLDEN = 0x9E3779B97F4A7C15
_MASK64 = (1 << 64) - 1


# ---- shared folder ------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only where it is unset and the master is local, as in tests, a temporary folder is made and set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="lodestar-")
        atexit.register(shutil.rmtree, root, True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Spark's setting that removes the files of a query's shuffles when it ends, not when the driver's memory is next collected.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, name: str, tidy: bool = False) -> tuple[DataFrame, str]:
    """Write a frame as Parquet to the shared folder and read it back (cuts lineage).

    tidy: the files of its shuffles go as soon as it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestar-{uuid.uuid4().hex}-{name}"
    before = spark.conf.get(_TIDY, None)
    if tidy:
        spark.conf.set(_TIDY, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if tidy and before is None:
            spark.conf.unset(_TIDY)
        elif tidy:
            spark.conf.set(_TIDY, before)
    _keep(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


_KEPT: dict[str, tuple] = {}


def _keep(spark: SparkSession, path: str) -> None:
    """Tables that a returned plan still reads go when the driver ends."""
    if not _KEPT:
        atexit.register(_sweep)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    _KEPT[path] = (p.getFileSystem(spark._jsc.hadoopConfiguration()), p)


def _sweep() -> None:
    for fs, p in _KEPT.values():
        try:
            fs.delete(p, True)
        except Exception:  # the JVM is gone: nothing more can be done
            return


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove intermediate tables that no later plan reads."""
    jvm = spark._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _KEPT.pop(path, None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


# ---- memory of Python workers ---------------------------------------------


def release() -> None:
    """Give freed memory back to the system: a worker serves later stages too."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(function):
    """A mapInArrow function fed by batches of about BATCH_BYTES, whatever the length of
    texts, that gives freed memory back as it goes and when it ends."""
    SparkSession.active().conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches):
        def counted():
            size = 0
            for batch in batches:
                size += batch.nbytes
                yield batch
                if size > 16 * BATCH_BYTES:
                    size = 0
                    release()

        yield from function(counted())
        release()

    return run


# ---- hashing constants ----------------------------------------------------


def splitmix(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit values, the same on every machine."""
    z = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(GOLDEN)) + np.uint64(seed & _MASK64)
    return mix64(z)


def mix64(z: np.ndarray) -> np.ndarray:
    z = z ^ (z >> np.uint64(30))
    z = z * np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


class Poly:
    """Polynomial hashes of substrings modulo 2**64 over a random byte table."""

    def __init__(self, seed: int):
        self.table = splitmix(256, seed)
        self.base = int(splitmix(1, seed ^ 0xABCDEF)[0]) | 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self._pow = self._inv = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._pow) < n:
            m = max(n, 2 * len(self._pow))
            for attr, b in (("_pow", self.base), ("_inv", self.inverse)):
                f = np.full(m, b, np.uint64)
                f[0] = 1
                setattr(self, attr, np.cumprod(f, dtype=np.uint64))
        return self._pow[:n], self._inv[:n]

    def prefix(self, buf: np.ndarray) -> np.ndarray:
        out = np.zeros(len(buf) + 1, np.uint64)
        if len(buf):
            np.cumsum(self.table[buf] * self.powers(len(buf))[0], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inv = self.powers(len(prefix))[1]
        return (prefix[end] - prefix[start]) * inv[start]


# ---- Arrow access ---------------------------------------------------------


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64 if large else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges [a, b) of whole documents, each of about ``limit`` bytes at most."""
    n, a = len(offs) - 1, 0
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


# ---- words ----------------------------------------------------------------

#: The six ASCII white-space bytes that separate words.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every maximal run of non-white bytes; none crosses documents."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    black = ~WHITE[buf]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    first = black.copy()
    first[1:] &= ~black[:-1] | cut[1:n]
    last = black
    last[:-1] &= ~black[1:] | cut[1:n]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


WORD_HASH = Poly(0x5EED)


def word_hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word; length is mixed in."""
    h = WORD_HASH.spans(WORD_HASH.prefix(low), start, end)
    return mix64(h + (end - start).astype(np.uint64) * np.uint64(GOLDEN))


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def crc32_of_id(id_col: Column) -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))
