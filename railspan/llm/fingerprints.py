"""Document fingerprints by locally consistent parsing.

Runs of one symbol are folded; deterministic coin tossing shrinks the alphabet while neighbours stay
different; places where the small labels peak begin a new phrase, and a phrase's name is a hash of its
symbols. Names are parsed again, level by level, until one phrase is left. A cut depends on a few neighbours only, so a
passage gets the same interior names wherever it stands. Hash minima of the names make up the fingerprint.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railspan.llm.common import bound_batches, mix, only, partitions

MINIMA = 64
#: Code points parsed at once.
CHUNK = 200_000

EDGE = np.uint64(0x5BD1E9955BD1E995)
POWERS = np.array([pow(0xD6E8FEB86659FD93, i, 1 << 64) for i in range(64)], np.uint64)


def _names(x: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Hash of the symbols of each phrase."""
    size = np.diff(np.append(begins, len(x)))
    place = np.arange(len(x)) - np.repeat(begins, size)
    return mix(np.add.reduceat(mix(x) * POWERS[np.minimum(place, 63)], begins) + size.astype(np.uint64))


def _fold_runs(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One symbol for each run of equal symbols; a longer run gets its own name."""
    new = first.copy()
    new[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(x)))
    out = x[at]
    many = size > 1
    out[many] = mix(out[many] * np.uint64(3) + size[many].astype(np.uint64))
    return out, first[at]


def _toss(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Twice the lowest bit in which a symbol differs from its left neighbour, plus that bit."""
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[first] = EDGE
    d = x ^ left
    low = d & (~d + np.uint64(1))
    k = np.where(low > 0, np.bitwise_count(low - np.uint64(1)), 63).astype(np.uint64)
    return np.uint64(2) * k + ((x >> np.minimum(k, np.uint64(63))) & np.uint64(1))


def _phrases(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x, first = _fold_runs(x, first)
    label = _toss(_toss(_toss(x, first), first), first)
    left, right = np.empty_like(label), np.empty_like(label)
    left[1:], right[:-1] = label[:-1], label[1:]
    left[first] = np.uint64(255)
    right[-1] = np.uint64(255)
    right[np.flatnonzero(first)[1:] - 1] = np.uint64(255)
    peak = (label > left) & (label >= right) | first
    at = np.flatnonzero(peak)
    return _names(x, at), first[at]


def fingerprints(texts: list[str]) -> list[str]:
    """Fingerprint of each text: its hash minima, 16 bits each, as hexadecimal digits. Equal texts have equal ones."""
    rng = np.random.default_rng(77)
    a = rng.integers(0, 1 << 63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, MINIMA, np.uint64)
    out: list[str] = []
    group: list[str] = []
    size = 0
    for text in [*texts, None]:
        if group and (text is None or size + len(text) > CHUNK):
            out += _chunk(group, a, b)
            group, size = [], 0
        if text is not None:
            group.append(text)
            size += len(text)
    return out


def _chunk(texts: list[str], a: np.ndarray, b: np.ndarray) -> list[str]:
    sizes = np.array([len(t) for t in texts])
    least = np.full((len(texts), MINIMA), ~np.uint64(0))
    full = np.flatnonzero(sizes)
    if len(full):
        x = mix(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64))
        first = np.zeros(len(x), bool)
        first[np.concatenate([[0], np.cumsum(sizes[full])[:-1]])] = True
        level = 0
        while len(full):  # the last symbol never begins a phrase, so every level has fewer
            level += 1
            x, first = _phrases(x, first)
            at = np.flatnonzero(first)
            for k in range(MINIMA):
                m = np.minimum.reduceat((x + np.uint64(level)) * a[k] + b[k], at)
                least[full, k] = np.minimum(least[full, k], m)
            phrases = np.diff(np.append(at, len(x)))
            parsed = np.repeat(phrases > 1, phrases)  # a text that is one phrase is done
            x, first, full = x[parsed], first[parsed], full[phrases > 1]
    short = (mix(least) >> np.uint64(48)).astype(">u2")
    return [row.tobytes().hex() for row in short]


def likeness(x: str, y: str) -> float:
    """Share of equal minima."""
    p, q = (np.frombuffer(bytes.fromhex(v), ">u2") for v in (x, y))
    return float((p == q).mean())


def _compare(batches):
    """Rows by part and doc_id; a part ends with a copy of the next part's first row, which is only looked at."""
    before = None  # part, doc_id, text, fingerprint

    for batch in batches:
        parts, ids, guests, texts = (batch.column(c).to_pylist() for c in ("part", "doc_id", "guest", "text"))
        prints = fingerprints(texts)
        todo = []
        for part, doc, guest, text, fp in zip(parts, ids, guests, texts, prints, strict=True):
            if before and before[0] == part:
                old = before[2]
                n = len(old) // 4
                todo.append((*before[1:], old[: len(old) - n] + text[:n], fp))
            before = None if guest else (part, doc, text, fp)
        edited = fingerprints([t[3] for t in todo])
        yield pa.RecordBatch.from_arrays(
            [pa.array([t[0] for t in todo], pa.int64()), pa.array([len(t[1]) for t in todo], pa.int64()),
             pa.array([hashlib.sha256(t[3].encode("utf-8", "surrogatepass")).hexdigest() for t in todo], pa.string()),
             pa.array([t[2] for t in todo], pa.string()), pa.array(edited, pa.string()),
             pa.array([likeness(t[2], e) for t, e in zip(todo, edited, strict=True)], pa.float64()),
             pa.array([likeness(t[2], t[4]) for t in todo], pa.float64())],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _prints(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(fingerprints([t or "" for t in batch.column("text").to_pylist()]), pa.string())], names=["doc_id", "fingerprint"])


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint for each row; no shuffle. A null text counts as empty."""
    bound_batches(docs.sparkSession)
    return only(docs, doc_id="long", text="string").mapInArrow(_prints, "doc_id long, fingerprint string")


def compare_with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row.

    A row is compared with its edited text (the last quarter replaced by the beginning of the next document's)
    and with the next document: by ascending doc_id, nulls first, ties by text; after the last comes the first.
    A single row is its own next. Null texts count as empty; two empty texts are alike. Other columns are
    ignored. Documents are sorted by ranges of doc_id; only a range's first row is sent to the range before.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = only(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    parts = 4 * partitions(spark)
    # Splits are at most `parts` ids, so they may go to the driver and into a literal.
    cuts = docs.filter("doc_id is not null").agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10_000).alias("at")).first()["at"] or []
    cuts = sorted(set(cuts))
    part = F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<long>"), lambda c: c <= F.col("doc_id"))), F.lit(0))
    dealt = docs.withColumn("part", F.when(F.col("doc_id").isNull(), 0).otherwise(part)).withColumn("guest", F.lit(False))
    head = F.struct(F.col("doc_id"), F.xxhash64("text").alias("tie"))
    heads = sorted((r["part"], *r["head"]) for r in dealt.groupBy("part").agg(F.min(head).alias("head")).collect())  # one row for each part
    sent = [(heads[i - 1][0], doc, tie) for i, (_, doc, tie) in enumerate(heads)]
    to = F.broadcast(spark.createDataFrame(sent, "to int, head_id long, tie long"))
    guests = (dealt.join(to, dealt.doc_id.eqNullSafe(to.head_id) & (F.xxhash64(dealt.text) == to.tie))
              .dropDuplicates(["to"]).select(F.col("to").alias("part"), "doc_id", F.lit(True).alias("guest"), "text"))
    rows = dealt.select("part", "doc_id", "guest", "text").union(guests)
    return (rows.repartition(parts, "part").sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
            .mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"))
