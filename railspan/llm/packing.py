"""Packing along a space-filling curve.

A document's hashed token counts are projected to a few dimensions; their Hilbert key orders the corpus so
that like documents are neighbours. The corpus is range-sorted by that key and cut, along the curve, into
sequences. A partition's last, partial sequence is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railspan.llm.bpe import read_ranks
from railspan.llm.common import bound_batches, materialize, mix, only, partitions

#: Hash bins of a document's vector; dimensions and bits of the curve.
BINS, DIMS, BITS = 256, 4, 12
#: Ids that one task packs, in bytes; fewer if the session has more shuffle partitions.
TASK_BYTES = 64 << 20
ID = np.dtype("<u2")


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer coordinates below 2 ** bits (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            hit = (x[i] & q) > 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(hit, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[-1] & q) > 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(documents: list[np.ndarray]) -> np.ndarray:
    """Hilbert key of each document's ids."""
    rng = np.random.default_rng(11)
    planes = rng.normal(size=(BINS, DIMS))
    bin_of = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(BINS)).astype(np.int64)
    vectors = np.zeros((len(documents), BINS))
    for row, ids in zip(vectors, documents, strict=True):
        row[:] = np.bincount(bin_of[ids], minlength=BINS)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1)
    side = 1 << BITS
    return hilbert_keys(np.clip(((vectors @ planes) / 8 + 0.5) * side, 0, side - 1).astype(np.int64), BITS)


#: Characters that libraries may split differently; texts with one of them, or with a special token of the file, are left to the tokenizers library.
ODD = r"[\x00-\x08\x0b-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]"


class Ids:
    """Ids by the tokenizers library's file.

    tiktoken reads the same vocabulary as ranks and is several times faster, so it encodes ordinary texts; the
    tokenizers library encodes all others and, in each batch, one text again, which must agree.
    """

    def __init__(self, spec: str, ranks: bytes, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.exact = Tokenizer.from_str(spec)
        if self.exact.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        special = [re.escape(t.content) for t in self.exact.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([ODD, *special]))
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks.splitlines()), special_tokens={})

    def by_file(self, text: str) -> np.ndarray:
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, ID)

    def batch(self, texts: list[str], separator: int) -> list[np.ndarray]:
        found = [self.by_file(t) if self.odd.search(t) else np.array(self.fast.encode_ordinary(t), ID) for t in texts]
        probe = min(range(len(texts)), key=lambda i: (not texts[i], len(texts[i])))
        if not np.array_equal(found[probe], self.by_file(texts[probe])):
            raise ValueError("the rank file is not the tokenizer's vocabulary")
        return [np.append(x, ID.type(separator)) for x in found]


def _tokenise(spec, ranks, pattern: str, separator: int):
    def run(batches):
        ids_of = Ids(spec.value, ranks.value, pattern)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = ids_of.batch([t or "" for t in batch.column("text").to_pylist()], separator)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(curve_keys(ids)), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([x.nbytes for x in ids], pa.int64())],
                names=["doc_id", "curve_key", "ids", "size"])

    return run


def _pack(length: int):
    def run(batches):
        number = TaskContext.get().partitionId() << 40
        held: list[list] = []  # pieces of the open sequence: doc_id, start, ids, doc_tokens
        filled = 0
        out: list[list] = [[] for _ in range(7)]

        def put(pieces, sequence):
            offset = 0
            for doc, start, ids, total in pieces:
                for col, v in zip(out, (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset), strict=True):
                    col.append(v)
                offset += len(ids)

        def flush():
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)
            for c in out:
                c.clear()
            return batch

        for batch in batches:
            for doc, blob in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids, at = np.frombuffer(blob, ID), 0
                while at < len(ids):
                    part = ids[at : at + length - filled]
                    held.append([doc, at, part, len(ids)])
                    at += len(part)
                    filled += len(part)
                    if filled == length:
                        put(held, number)
                        held, filled = [], 0
                        number += 1
            yield flush()
        while filled:  # the rest, by its powers of two, the largest first
            size = 1 << (filled.bit_length() - 1)
            taken, room, rest = [], size, []
            for doc, start, ids, total in held:
                if room:
                    taken.append([doc, start, ids[:room], total])
                if len(ids) > room:
                    rest.append([doc, start + room, ids[room:], total])
                room = max(0, room - len(ids))
            put(taken, number)
            held, filled = rest, filled - size
            number += 1
        yield flush()

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, ranks_path: str, pattern: str, length: int = 1024, separator: int = 0) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all rows of docs (doc_id, text).

    A document is its ids and then the separator; a null or empty text is the separator alone. Every id lies in
    one piece; a sequence's pieces are gapless from offset 0 and in the order of the curve. Sequences are full
    but for at most log2(length) at a partition's end, whose lengths are powers of two. Copies of one text
    share a key; doc_id then orders them, so that they are dealt to many partitions. Rows that repeat a doc_id
    are packed each; other columns are ignored. The tokenizer's two files (under 3 MB) are broadcast.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    with open(ranks_path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    keyed = materialize(only(docs, doc_id="long", text="string").mapInArrow(_tokenise(spec, ranks, pattern, separator), "doc_id long, curve_key long, ids binary, size long"), "curve")
    parts = max(partitions(spark), -(-(keyed.agg(F.sum("size")).first()[0] or 0) // TASK_BYTES))
    sorted_ = keyed.drop("size").repartitionByRange(parts, "curve_key", "doc_id").sortWithinPartitions("curve_key", "doc_id", "ids")
    return sorted_.mapInArrow(_pack(length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
