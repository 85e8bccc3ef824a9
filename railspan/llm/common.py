"""Shared helpers: words, hashes, bounded Arrow batches and cut lineage."""

from __future__ import annotations

import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents in one Arrow batch: long texts must not pile up in a Python worker.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20

MULT = np.uint64(0x9E3779B97F4A7C15)


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small in rows and bytes, so a worker's memory does not follow the texts' length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="railspan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage is cut, any executor may be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class WordHashes(dict):
    """64-bit hash of each word (bytes); emptied when it holds too many words."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as UTF-8: bytes.split() cuts at these six characters alone."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit value."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Mixed hash of every k consecutive values; empty if there are fewer than k.

    Runs of doubling length are joined, so k costs log k passes over the array.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, part, size, left = None, 0, h, 1, k
    while True:
        if left & 1:
            piece = part[done : done + n]
            out = piece if out is None else out * _power(size) + piece
            done += size
        left >>= 1
        if not left:
            return mix(out)
        part = part[:-size] * _power(size) + part[size:]
        size *= 2


_POWERS: dict[int, np.uint64] = {}


def _power(n: int) -> np.uint64:
    if n not in _POWERS:
        _POWERS[n] = np.uint64(pow(int(MULT), n, 1 << 64))
    return _POWERS[n]


def sequence_hash(h: np.ndarray) -> np.ndarray:
    """One hash for the whole sequence, kept apart from those of k-grams by its length."""
    out = np.array([len(h)], np.uint64)
    for x in h:
        out = mix(out * MULT + x)
    return out


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    """An Arrow list column of 64-bit values, one list for each array."""
    ends = np.zeros(len(parts) + 1, np.int32)
    if parts:
        ends[1:] = np.cumsum([len(p) for p in parts])
    flat = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def sampled_labels(labels: DataFrame, name: str, most: int, unless: Column | None = None) -> DataFrame:
    """At most `most` ids with their label, chosen by a hash of the id; nulls and ids whose labels differ are left out."""
    known = only(labels, **{"doc_id": "long", name: "int"}).dropna().groupBy("doc_id").agg(F.min(name).alias(name), F.max(name).alias("other"))
    known = known.filter(F.col(name) == F.col("other")).select("doc_id", name)
    return (known if unless is None else known.filter(~unless)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def only(df: DataFrame, **cols: str) -> DataFrame:
    """Just the named columns with the wanted types: further columns cannot clash. name='type'."""
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in cols.items()])


#: The letters that ASCII folds.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column | str) -> Column:
    """A-Z lowered, all else as it is. Texts of ASCII alone take the fast way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def any_names(work):
    """For a transform of documents that keeps their columns: it sees doc_id, text and columns with plain names, and the real names come back by
    place, whatever they hold (dots, quotes, the same letters in another case)."""
    @functools.wraps(work)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        plain = [c if c in ("doc_id", "text") else f"further_{i}" for i, c in enumerate(docs.columns)]
        return work(docs.toDF(*plain), *args, **options).toDF(*docs.columns)

    return run
