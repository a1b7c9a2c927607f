"""Byte-level helpers that the corpus operators share.

A batch of texts is one UTF-8 byte buffer with document offsets. Words, their
64-bit hashes and per-document counts come from a few vectorised passes over
that buffer, so a Python worker spends some tens of nanoseconds on a word and
never loops over rows. Null texts are empty texts throughout.

Hashes are 64 bits wide: a polynomial for words below ``LONG`` bytes, and a weight for each
place for longer ones, since patterns of repeats can cancel in long polynomials. Two
different words of one corpus share a hash with a probability of about
(distinct words)**2 / 2**58 at most, as differences of bytes may share up to seven bits.
"""

from __future__ import annotations

import contextlib
import ctypes
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone import sources

U64 = np.uint64
#: White space of the word contracts: blank and \x09 to \x0D.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {}
#: Bytes from which on a span's places have weights of their own: from 1,024 on, patterns of repeats can cancel in a polynomial modulo 2**64.
LONG = 256
#: Bytes of text handled at once; a longer document is handled alone.
CHUNK = 1 << 20
#: Bytes of an Arrow batch, and Spark's own default.
BATCH_BYTES, _DEFAULT_BATCH = 1 << 20, "67108864b"


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        step = np.full(max(n, CHUNK + 1), _BASE if kind == "up" else _INVERSE, dtype=U64)
        step[0] = 1
        have = np.cumprod(step, dtype=U64)
        if n <= CHUNK + 1:
            _powers[kind] = have
    return have


def buffer(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array and its document offsets; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    n = len(texts)
    if n == 0 or offsets is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes each; all documents, in order."""
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, side="right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def spans(part: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True in ``part`` that no document boundary
    splits, and the index of each document's first run (one more at the end)."""
    n = len(part)
    if n == 0:
        zero = np.zeros(0, dtype=np.int64)
        return zero, zero, np.zeros(len(offs), dtype=np.int64)
    begin, end = part.copy(), part.copy()
    begin[1:] &= ~part[:-1]
    end[:-1] &= ~part[1:]
    inner = offs[(offs > 0) & (offs < n)]
    begin[inner] = part[inner]
    end[inner - 1] = part[inner - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offs)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from one running polynomial over the buffer; of long spans
    from a weight for each place."""
    n, size = len(raw), ends - starts
    run = np.zeros(n + 1, dtype=U64)
    np.cumsum((raw.astype(U64) + U64(1)) * _power("up", n + 1)[:n], out=run[1:])
    h = (run[ends] - run[starts]) * _power("down", n + 1)[starts]
    long = np.flatnonzero(size >= LONG)
    if len(long):
        place = np.arange(size[long].sum()) - np.repeat(np.cumsum(size[long]) - size[long], size[long])
        weight = mix((place.astype(U64) + U64(1)) * U64(_BASE)) | U64(1)
        part = (raw[place + np.repeat(starts[long], size[long])].astype(U64) + U64(1)) * weight
        h[long] = np.add.reduceat(part, np.cumsum(size[long]) - size[long])
    return mix(h + size.astype(U64) * U64(0x2545F4914F6CDD1D))


def word_hashes(raw: np.ndarray, offs: np.ndarray, word: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of a buffer and each document's first word.
    ``word``: which byte values make words; by default all but white space."""
    raw = LOWER[raw]
    starts, ends, first = spans(~WHITE[raw] if word is None else word[raw], offs)
    return hashes(raw, starts, ends), first


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in their order and the sums of their counts."""
    u, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return u, np.bincount(inverse, np.concatenate(counts), minlength=len(u)).astype(np.int64)


def owner(first: np.ndarray) -> np.ndarray:
    """The document of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def fold(key: Column, mod: int) -> Column:
    """crc32 of a key as text, modulo ``mod``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % mod


def free_names(columns: list[str], n: int) -> list[str]:
    """Names that no column has."""
    taken, out = {c.lower() for c in columns}, []
    for i in range(n):
        name = f"__own_{i}"
        while name in taken:
            name += "_"
        out.append(name)
    return out


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in batches of about a MB, where the session has not set their
    bytes: what a worker and its JVM hold must not depend on the length of texts. At a
    task's end the worker gives back the memory that it does not need."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == _DEFAULT_BATCH:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _trim()

    return df.mapInArrow(lean, schema)


def lean(run: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """A function of one group or of two; after each call the worker gives back the memory that it does not need."""

    def one(group: pa.Table) -> pa.Table:
        try:
            return run(group)
        finally:
            _trim()

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            _trim()

    return one if run.__code__.co_argcount == 1 else two


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


#: Seconds between two times that ``written`` has the driver give memory back, at least; when it last did.
GIVE_BACK_S, _given = 2, [0.0]


def written(df: DataFrame, name: str) -> DataFrame:
    """``sources.written``; now and then the driver then gives back the memory that it does not need, so that a
    step of many tables does not let its heap grow to the most that it may have."""
    out = sources.written(df, name)
    if time.monotonic() - _given[0] >= GIVE_BACK_S:
        give_back(df.sparkSession)
    return out


def give_back(spark: SparkSession) -> None:
    """Garbage of the driver goes and its heap shrinks; so does what its Python holds for nothing."""
    spark.sparkContext._jvm.System.gc()
    _trim()
    _given[0] = time.monotonic()


def settled(df: DataFrame, name: str) -> DataFrame:
    """``written``, and the shuffles of the step removed: Spark drops their files only after
    the driver collects garbage, the first time what refers to them, then themselves."""
    out = sources.written(df, name)
    for _ in range(2):
        give_back(df.sparkSession)
        time.sleep(0.3)
    return out


def discard(table: DataFrame) -> None:
    """Removes the files of what ``written`` has returned, once nothing reads it any more."""
    jvm, conf = table.sparkSession._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def zipped(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the column ``text`` as compressed UTF-8, for texts that are dealt out; null is empty."""
    place = df.columns.index(text)
    schema = T.StructType([T.StructField(f.name, T.BinaryType()) if i == place else f for i, f in enumerate(df.schema.fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            packed = pa.array([press(x.as_buffer()) if x.is_valid else press(b"") for x in b.column(place)], pa.binary())
            yield pa.RecordBatch.from_arrays([packed if i == place else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return mapped(df, run, schema)


def unzipped(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    import zstandard

    loose = zstandard.ZstdDecompressor().decompress
    return pa.array([loose(x.as_buffer()) for x in texts], pa.large_binary()).cast(pa.large_string())


def text_bytes(docs: DataFrame, text: str) -> int:
    """Bytes of all texts, from one narrow scan."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0)
