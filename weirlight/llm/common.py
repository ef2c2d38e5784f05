"""What the corpus operators share: tables, keys of rows, the shared folder and words as byte spans."""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import os
import shutil
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multiplier of the polynomial hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
M64 = (1 << 64) - 1
INVERSE = pow(BASE, -1, 1 << 64)
LONG = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MADE: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only where that is unset and all runs on one machine (tests) a folder beside the warehouse is taken instead."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset; it has to name a folder that the driver and all executors share")
        at = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_weirlight_shared")
    return at.rstrip("/")


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage and survives the loss of executors. It is removed when the driver's program ends."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/weirlight-{uuid.uuid4().hex}"
    _MADE.add(at)
    df.write.option("compression", "zstd").parquet(at, partitionBy=list(partition_by) or None)
    return spark.read.schema(df.schema).parquet(at)


def _removed() -> None:
    """Deletes what stored has written, through the file system of Spark while it runs, else where it is local."""
    sc = SparkContext._active_spark_context
    for at in _MADE:
        if sc is not None and sc._jvm is not None:
            path = sc._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        elif at.startswith(("file:", "/")):
            shutil.rmtree("/" + at.removeprefix("file:").lstrip("/"), ignore_errors=True)
    _MADE.clear()


atexit.register(_removed)


BATCH, BATCH_UNSET, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python in batches of about BATCH_BYTES in this session, unless it has a limit of its own: the JVM, outside of its heap, and the worker hold several copies of a batch."""
    if spark.conf.get(BATCH, None) == BATCH_UNSET:
        spark.conf.set(BATCH, BATCH_BYTES)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker gives the memory that is free back to the system; it lives on beside what comes next."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
            if trim is not None:
                trim(0)

    return own


#: In keys, a null doc_id counts as larger than all others.
LAST = (1 << 63) - 1


def row_key() -> list[Column]:
    """owner, which is doc_id or LAST for null, and text_key, a hash of the text and of what is null. Rows that share both are the same document repeated, so whatever is derived from the text is the same for them."""
    return [F.coalesce(F.col("doc_id"), F.lit(LAST)).alias("owner"), F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull(), F.col("doc_id").isNull()).alias("text_key")]


KEY = ["owner", "text_key"]


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def joined(texts: list[bytes], sep: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, each followed by sep; where each starts, and the end."""
    lengths = np.fromiter((len(t) + len(sep) for t in texts), np.int64, len(texts))
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths, out=starts[1:])
    return np.frombuffer(sep.join(texts) + sep if texts else b"", np.uint8), starts


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without \\x20 and \\x09-\\x0D."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~_SPACE[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def powers(n: int, base: int = BASE) -> np.ndarray:
    out = np.full(n, base & M64, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64; x is uint64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """H[i]: sum of (byte + 1) * BASE**j over the bytes j before i, modulo 2**64."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(len(buf)), out=out[1:])
    return out


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span that depends on nothing but its bytes."""
    h = prefix_hash(buf)
    raw = (h[ends] - h[starts]) * powers(len(buf) + 1, INVERSE)[starts]
    return mixed(raw ^ mixed((ends - starts).astype(np.uint64)))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, eight bytes after eight through a mixer, so that no structure of the bytes makes two alike; above LONG bytes BLAKE2b's."""
    n = ends - starts
    lanes = np.ndarray((len(buf),), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), 0, (1,))
    h = mixed(n.astype(np.uint64) + np.uint64(BASE))
    at, i = np.flatnonzero((n > 0) & (n <= LONG)), 0
    while len(at):
        left = n[at] - i
        x = lanes[starts[at] + i]
        part = left < 8
        x[part] &= (np.uint64(1) << (left[part] * 8).astype(np.uint64)) - np.uint64(1)
        h[at] = mixed(h[at] * np.uint64(BASE) ^ x)
        i += 8
        at = at[left > 8]
    for k in np.flatnonzero(n > LONG).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(buf[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def pieces(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together, so that arrays stay small; a longer text is alone."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by prefix and suffix minima of blocks."""
    n = len(x)
    if n < w:
        return x[:0]
    if w == 1:
        return x.copy()
    full = -(-n // w) * w
    pad = np.full(full, np.iinfo(x.dtype).max, x.dtype)
    pad[:n] = x
    blocks = pad.reshape(-1, w)
    fore = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], fore[w - 1 : n])
