"""MinHash near-duplicate detection with exact confirmation.

Universal hash minima are cut into bands; documents that share a band are candidates. Copies with equal
shingle sets are folded into one representative first, so a group of thousands costs one document.
Within a bucket no pairs are enumerated: members are compared with the member that shares most buckets and
with the least one. Members of buckets that are still split between components meet by an exact prefix filter
on their full shingle sets: only a pair whose sizes and rarest shingles allow the similarity is a candidate, and
members of a bucket's largest component meet only the stragglers of other components.
Every link is confirmed on the full shingle sets. Components: alternating large-star and small-star.
"""

from __future__ import annotations

import math
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railspan.llm.common import WordHashes, bound_batches, grams, lists, materialize, mix, only, sequence_hash, signed
from railspan.llm.components import connected_components

#: 40 bands of 6 minima miss a pair of similarity 0.8 with probability 5e-6.
BANDS, ROWS = 40, 6
#: Copies of one text are dealt to this many keys; ratio of neighbouring classes of set sizes.
SALTS, CLASS_RATIO = 64, 1.05


def shingle_set(text: str | None, k: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; the whole sequence as one if there are fewer words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes.lower() changes A-Z alone
    if not words:
        return np.empty(0, np.uint64)
    h = known.array(words)
    return np.unique(grams(h, k)) if len(words) >= k else sequence_hash(h)


def _signatures(k: int, bands: int, rows: int):
    def run(batches):
        rng = np.random.default_rng(20_240_501)
        a = rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 1 << 63, bands * rows, np.uint64)
        weights = rng.integers(0, 1 << 63, rows, np.uint64) * np.uint64(2) + np.uint64(1)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        known = WordHashes()
        for batch in batches:
            digests, sizes, out = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, k, known)
                sizes.append(len(s))
                if not len(s):
                    digests.append(None)
                    out.append(np.empty(0, np.uint64))
                    continue
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                least = None
                for at in range(0, len(s), 128):
                    m = (s[at : at + 128, None] * a + b).min(axis=0)
                    least = m if least is None else np.minimum(least, m)
                out.append(mix((mix(least).reshape(bands, rows) * weights).sum(axis=1, dtype=np.uint64) ^ salt))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists(out)],
                names=["doc_id", "n_shingles", "digest", "bands"])

    return run


def _confirm(k: int, percent: int):
    def run(batches):
        known, sets = WordHashes(), OrderedDict()

        def get(i, text):
            s = sets.get(i)
            if s is None:
                s = sets[i] = shingle_set(text, k, known)
                if len(sets) > 64:
                    sets.popitem(last=False)
            return s

        for batch in batches:
            us, vs = [], []
            for u, v, tu, tv in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "tu", "tv")), strict=True):
                x, y = get(u, tu), get(v, tv)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and 100 * both >= percent * (len(x) + len(y) - both):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    left = texts.select(F.col("doc_id").alias("u"), F.col("text").alias("tu"))
    right = texts.select(F.col("doc_id").alias("v"), F.col("text").alias("tv"))
    return materialize(pairs.join(left, "u").join(right, "v").mapInArrow(_confirm(k, percent), "u long, v long"), "links")


def _shingles(k: int):
    """One row for each distinct shingle of each document."""

    def run(batches):
        known, ids, found = WordHashes(), [], []

        def put():
            sizes = [len(x) for x in found]
            whole = pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), sizes)), signed(np.concatenate(found))], names=["id", "shingle"])
            ids.clear()
            found.clear()
            return whole

        held = 0
        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append(i)
                found.append(shingle_set(text, k, known))
                held += len(found[-1])
                if held > 100_000:
                    yield put()
                    held = 0
        if found:
            yield put()

    return run


def _size_class(n) -> Column:
    return F.floor(F.log(n) / F.lit(math.log(CLASS_RATIO))).cast("int")


def _prefixes(apart: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(shingle, id, n, component, rest, pos): the first shingles of each document, from the rarest on.

    Of two sets alike to the percent, ordered alike from the rarest shingle on, each has its first shared one among
    its first n - ceil(percent n / 100) + 1. A shingle that no other document has leads to no partner, but counts as a place.
    """
    rows = texts.select(F.col("doc_id").alias("id"), "text").join(apart.select("id"), "id", "left_semi").mapInArrow(_shingles(k), "id long, shingle long")
    rows = materialize(rows, "shingles")
    often = rows.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
    shared = rows.join(often, "shingle")
    by_rank = Window.partitionBy("id").orderBy("df", "shingle")
    ranked = shared.withColumns({"rank": F.row_number().over(by_rank), "shared": F.count("*").over(Window.partitionBy("id"))})
    return (ranked.join(apart, "id").withColumn("pos", F.col("n") - F.col("shared") + F.col("rank") - 1)
            .filter(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * percent / 100)).select("shingle", "id", "n", "component", "rest", "pos"))


def _candidates(prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of different components, one of them a straggler, that sizes and places of a shared shingle still allow.

    Alike sets share percent / (100 + percent) of both sizes; what precedes their first shared shingle is lost to them. So the
    smaller set (x) meets only by a shorter prefix, and the larger one (y) only sets of the size classes that its place allows.
    """
    t = 100 + percent
    x = (prefixes.filter(t * (F.col("n") - F.col("pos")) >= 2 * percent * F.col("n"))
         .select("shingle", _size_class("n").alias("cls"), F.col("id").alias("ix"), F.col("n").alias("nx"), F.col("pos").alias("px"), F.col("component").alias("cx"), F.col("rest").alias("rx")))
    most = F.least(F.col("n"), F.floor(t * (F.col("n") - F.col("pos")) / percent) - F.col("n"))
    y = (prefixes.withColumns({"least": F.ceil(F.col("n") * percent / 100), "most": most}).filter("least <= most")
         .select("shingle", F.explode(F.sequence(_size_class("least"), _size_class("most"))).alias("cls"), F.col("id").alias("iy"), F.col("n").alias("ny"), F.col("pos").alias("py"), F.col("component").alias("cy"), F.col("rest").alias("ry")))
    before = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("ix") < F.col("iy")))
    fits = before & (F.col("cx") != F.col("cy")) & (100 * F.col("nx") >= percent * F.col("ny")) & (t * F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) >= percent * (F.col("nx") + F.col("ny")))
    key = ["shingle", "cls"]
    one = x.filter("rx").join(y, key).filter(fits).select(*_ordered("ix", "iy"))
    two = x.filter("not rx").join(y.filter("ry"), key).filter(fits).select(*_ordered("ix", "iy"))
    return one.union(two).distinct()


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("u"), F.greatest(x, y).alias("v")]


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text).

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of distinct shingles
    of `shingle` words (A-Z lower-cased). Documents without words (null, empty or white space) have no
    shingle and are linked with nothing. Fewer words than a shingle: the whole sequence is the one shingle.
    Rows with a null doc_id are kept, with a null component. Rows that repeat a doc_id share its links; each
    row is returned. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = only(docs, doc_id="long", text="string")
    signed_docs = materialize(
        docs.mapInArrow(_signatures(shingle, bands, rows), "doc_id long, n_shingles long, digest binary, bands array<long>"), "signatures")
    salted = signed_docs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))

    linkable = salted.filter("n_shingles > 0 and doc_id is not null")
    classes = linkable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.collect_set("salt").alias("salts"))
    reps = linkable.join(classes.select("rep", "digest"), (F.col("doc_id") == F.col("rep")) & (linkable.digest == classes.digest), "left_semi")
    rows_of = reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = rows_of.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = materialize(rows_of.join(shared, "bucket"), "buckets")

    wanted = members.groupBy("id").agg(F.sum("size").alias("degree"))
    texts = materialize(docs.join(wanted.select(F.col("id").alias("doc_id")), "doc_id", "left_semi"), "texts")

    # First the member that shares buckets with most others, then the least one, as the bucket's pivot.
    ranked = members.join(wanted, "id")
    pivots = ranked.groupBy("bucket").agg(
        F.max(F.struct("degree", (-F.col("id")).alias("neg"))).alias("top"), F.min("id").alias("least"))
    stars = ranked.join(pivots, "bucket").select("id", "n", F.explode(F.array_distinct(F.array(-F.col("top.neg"), F.col("least")))).alias("pivot"))
    links = _confirmed(stars.filter("id <> pivot").select(*_ordered("id", "pivot")).distinct(), texts, shingle, percent)
    found = connected_components(links)

    # A link that is still missing joins two components of a bucket, and not both its ends are in the bucket's largest one.
    placed = members.join(found.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("component"))
    held = placed.groupBy("bucket", "component").agg(F.count("*").alias("held"))
    split = held.groupBy("bucket").agg(F.count("*").alias("parts"), F.max(F.struct("held", (-F.col("component")).alias("neg"))).alias("main")).filter("parts > 1")
    apart = materialize(placed.join(split.select("bucket", (-F.col("main.neg")).alias("main")), "bucket")
                        .groupBy("id", "n", "component").agg(F.max(F.col("component") != F.col("main")).alias("rest")), "apart")
    prefixes = materialize(_prefixes(apart, texts, shingle, percent), "prefixes")
    more = _confirmed(_candidates(prefixes, percent), texts, shingle, percent)

    # The links found last join whole components: only these are nodes of the second graph.
    ends = [apart.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")) for c in ("u", "v")]
    merged = connected_components(more.join(ends[0], "u").join(ends[1], "v").select(F.col("cu").alias("u"), F.col("cv").alias("v")))
    first = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "salts", F.coalesce("component", "rep").alias("first"))
    joined = first.join(merged.select(F.col("node").alias("first"), "component"), "first", "left")
    placed_class = joined.select("digest", F.explode("salts").alias("salt"), F.coalesce("component", "first").alias("component"))
    return (salted.select("doc_id", "n_shingles", "digest", "salt").join(placed_class, ["digest", "salt"], "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
