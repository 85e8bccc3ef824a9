"""Removal of repeated passages by repeated-phrase automata.

A window is 20 consecutive words. Of each document the local minima of 8-word phrase hashes are taken such
that every window holds one; phrases seen twice are the seeds of all repeated windows. Seeds are sharded by
the document in which they come first, each shard compiles its phrases into an Aho-Corasick automaton, and
every document that holds one of them streams through it. Windows around a located phrase are compared: all
but the first in document order are repeats. A shard with many documents is dealt to several tasks, whose
first windows meet again in one more join.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railspan.llm.common import WordHashes, any_names, bound_batches, grams, lists, materialize, only, partitions

WINDOW = 20
#: Words of a phrase. Among any WINDOW - PHRASE + 1 consecutive phrases, one is taken.
PHRASE = 8
#: Phrases in a shard's automaton, and words of documents that one task streams through it.
SHARD_PHRASES, TASK_WORDS = 1000, 500_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f (minimum or maximum) over every `width` consecutive values."""
    size, out = 1, x
    while size * 2 <= width:
        out = f(out[:-size], out[size:])
        size *= 2
    return out if size == width else f(out[: len(x) - width + 1], out[width - size : width - size + len(x) - width + 1])


def seeds(phrases: np.ndarray, span: int) -> np.ndarray:
    """Whether each phrase hash is the least of some `span` consecutive ones."""
    if len(phrases) < span:
        return np.zeros(len(phrases), bool)
    least = _sliding(phrases, span, np.minimum)
    wide = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    return _sliding(wide, span, np.maximum) == phrases


def _profile(window: int, phrase: int):
    def run(batches):
        known = WordHashes()
        for batch in batches:
            sizes, digests, found, shas = [], [], [], []
            for text in batch.column("text").to_pylist():
                words = text.encode("utf-8", "surrogatepass").split() if text else []
                sizes.append(len(words))
                joined = b" ".join(words)
                digests.append(xxhash.xxh3_128_digest(joined))
                shas.append(_sha(joined))
                p = grams(known.array(words), phrase) if len(words) >= window else np.empty(0, np.uint64)
                p = np.sort(p[seeds(p, window - phrase + 1)])
                if len(p) > 2:  # two of a kind tell as much as more
                    p = p[np.concatenate([[True, True], p[2:] != p[:-2]])]
                found.append(p)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(shas, pa.string()), lists(found)],
                names=["doc_id", "key", "n_words", "digest", "sha", "seeds"])

    return run


def _sha(data: bytes) -> str:
    import hashlib

    return hashlib.sha256(data).hexdigest()


def _runs(flags: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Word intervals [start, end) covered by the windows that start where flags is set."""
    at = np.flatnonzero(flags)
    cut = np.flatnonzero(np.diff(at) > window) if len(at) else np.empty(0, int)
    return at[np.concatenate([[0], cut + 1])] if len(at) else at, at[np.concatenate([cut, [len(at) - 1]])] + window if len(at) else at


SPOTS = "doc_id long, key long, start long, end long, window long"


def _stream(window: int, phrase: int):
    """Rows ordered by shard and task: first the shard's phrases (in their home documents), then documents."""

    def run(batches):
        import ahocorasick

        known = WordHashes()
        group, automaton, ready, seen, before = None, None, False, set(), None
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            cols = [batch.column(c).to_pylist() for c in ("shard", "task", "tasks", "kind", "doc_id", "key", "text", "seeds")]
            for shard, task, tasks, kind, doc, key, text, wanted in zip(*cols, strict=True):
                if (shard, task) != group:
                    group, automaton, ready, seen, before = (shard, task), ahocorasick.Automaton(), False, set(), None
                if (kind, doc, key) == before:  # a repeated row of the table
                    continue
                before = (kind, doc, key)
                words = WORD.findall(text)
                h = known.array([w.encode("utf-8", "surrogatepass") for w in words])
                if kind == 0:
                    wanted = np.array(wanted, np.int64).view(np.uint64)
                    for i in np.flatnonzero(np.isin(grams(h, phrase), wanted)):
                        automaton.add_word(f" {' '.join(words[i : i + phrase])} ", 1)
                    continue
                if not ready:
                    automaton.make_automaton()
                    ready = True
                if automaton.kind != ahocorasick.AHOCORASICK:
                    continue
                ends = np.fromiter((e for e, _ in automaton.iter(f" {' '.join(words)} ")), np.int64)
                if not len(ends):
                    continue
                places = np.searchsorted(np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1), ends) - phrase + 1
                n = len(words) - window + 1
                near = np.zeros(n + window + 1, np.int64)
                np.add.at(near, np.maximum(places - (window - phrase), 0), 1)
                np.add.at(near, places + 1, -1)
                starts = np.flatnonzero(np.cumsum(near)[:n] > 0)
                hashes = grams(h, window)[starts]
                repeat = np.zeros(n, bool)
                first = []
                for s, x in zip(starts.tolist(), hashes.tolist(), strict=True):
                    if x in seen:
                        repeat[s] = True
                    else:
                        seen.add(x)
                        first.append((s, x))
                a, b = _runs(repeat, window)
                rows = [(doc, key, s, e, None) for s, e in zip(a.tolist(), b.tolist(), strict=True)]
                if tasks > 1:
                    rows += [(doc, key, s, s + window, x - (1 << 64) if x >> 63 else x) for s, x in first]
                for col, values in zip(out, zip(*rows, strict=True), strict=False):
                    col.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "key", "start", "end", "window"])

    return run


def _cut(batches):
    for batch in batches:
        texts, removed, n_words = [], [], []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            words = WORD.findall(text)
            gone = np.zeros(len(words) + 1, np.int64)
            for s in found:
                gone[s["start"]] += 1
                gone[s["end"]] -= 1
            gone = np.cumsum(gone)[:-1] > 0
            texts.append(" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
            removed.append(int(gone.sum()))
            n_words.append(len(words))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("key"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
            names=["doc_id", "key", "n_words", "n_removed", "kept"])


def _keyed(docs: DataFrame) -> DataFrame:
    return only(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("key", F.xxhash64("text"))


class Repeats:
    """What is repeated in docs (doc_id, text).

    profile: doc_id, key (hash of the text), n_words, sha (of all words) for each row; copies: whether the row
    repeats all words of an earlier document. cuts: doc_id, key, n_words, n_removed, kept for documents that
    lose some of their words.
    """

    def __init__(self, docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE):
        spark = docs.sparkSession
        bound_batches(spark)
        docs = _keyed(docs)
        found = materialize(
            docs.mapInArrow(_profile(window, phrase), "doc_id long, key long, n_words long, digest binary, sha string, seeds array<long>"), "profile")
        long_enough = found.filter(f"n_words >= {window} and doc_id is not null")
        firsts = long_enough.groupBy("digest").agg(F.min("doc_id").alias("first"))
        self.profile = found.select("doc_id", "key", "n_words", "sha")
        self.copies = long_enough.join(firsts, "digest").filter("doc_id > first").select("doc_id", "key").distinct()
        # Dealt by digest and doc_id: copies of one text spread over tasks, and repeated rows meet without another shuffle.
        own = long_enough.join(firsts, (long_enough["digest"] == firsts["digest"]) & (long_enough["doc_id"] == firsts["first"]), "left_semi")
        own = materialize(own.dropDuplicates(["digest", "doc_id", "key"]).select("doc_id", "key", "n_words", "seeds"), "own")

        occurrences = own.select("doc_id", "key", "n_words", F.explode("seeds").alias("seed"))
        repeated = materialize(
            occurrences.groupBy("seed").agg(F.count("*").alias("n"), F.min("doc_id").alias("home")).filter("n > 1").select("seed", "home"), "seeds")
        shards = max(1, -(-repeated.count() // SHARD_PHRASES))
        repeated = repeated.withColumn("shard", F.pmod(F.xxhash64("home"), F.lit(shards)))
        routes = materialize(occurrences.join(repeated.select("seed", "shard"), "seed").select("doc_id", "key", "n_words", "shard").distinct(), "routes")
        loads = routes.groupBy("shard").agg(F.sum("n_words").alias("words")).select("shard", F.ceil(F.col("words") / TASK_WORDS).cast("int").alias("tasks"))
        task = F.pmod(F.xxhash64("doc_id", "key"), F.col("tasks")).cast("int")
        visits = routes.join(loads, "shard").select("doc_id", "key", F.struct("shard", task.alias("first"), task.alias("last"), "tasks", F.lit(1).alias("kind"), F.lit(None).cast("array<long>").alias("seeds")).alias("visit"))
        homes = (repeated.groupBy("shard", "home").agg(F.collect_list("seed").alias("seeds")).join(loads, "shard").join(own.select(F.col("doc_id").alias("home"), "key"), "home")
                 .select(F.col("home").alias("doc_id"), "key", F.struct("shard", F.lit(0).alias("first"), (F.col("tasks") - 1).alias("last"), "tasks", F.lit(0).alias("kind"), "seeds").alias("visit")))
        # One row for each text, so texts move once to meet their visits and once to their tasks.
        calls = visits.union(homes).groupBy("doc_id", "key").agg(F.collect_list("visit").alias("visits"))
        visited = docs.join(routes.select("doc_id", "key").distinct(), ["doc_id", "key"], "left_semi")
        texts = materialize(visited.join(calls, ["doc_id", "key"]), "texts")
        streamed = (texts.select("doc_id", "key", "text", F.explode("visits").alias("v"))
                    .select(F.col("v.shard").alias("shard"), F.explode(F.sequence("v.first", "v.last")).alias("task"), F.col("v.tasks").alias("tasks"), F.col("v.kind").alias("kind"), "doc_id", "key", "text", F.col("v.seeds").alias("seeds"))
                    .repartition(2 * partitions(spark), "shard", "task").sortWithinPartitions("shard", "task", "kind", "doc_id", "key"))
        spots = materialize(streamed.mapInArrow(_stream(window, phrase), SPOTS), "spots")

        firsts_of = spots.filter("window is not null")
        earliest = firsts_of.groupBy("window").agg(F.min(F.struct("doc_id", "start")).alias("one"), F.max(F.struct("doc_id", "start")).alias("other")).filter("one < other")
        late = firsts_of.join(earliest, "window").filter(F.struct("doc_id", "start") > F.col("one"))
        spans = spots.filter("window is null").select("doc_id", "key", "start", "end").union(late.select("doc_id", "key", "start", "end"))
        spans = spans.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
        once = texts.select("doc_id", "key", "text").join(spans, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"])
        self.cuts = materialize(once.mapInArrow(_cut, "doc_id long, key long, n_words long, n_removed long, kept string"), "cuts")


def repeated_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs (doc_id, text).

    A word is removed if a window that covers it has a word sequence that also starts earlier: in a smaller
    doc_id, or before it in the same document. Null and empty texts have no words; texts of fewer words than
    a window lose nothing; rows with a null doc_id neither lose words nor count as earlier; rows that repeat
    doc_id and text are one document, each returned. Other columns are ignored.
    """
    found = Repeats(docs)
    cuts = found.cuts.select("doc_id", "key", "n_removed", F.sha2(F.col("kept"), 256).alias("cut"))
    copies = found.copies.withColumn("copy", F.lit(True))
    return (found.profile.join(cuts, ["doc_id", "key"], "left").join(copies, ["doc_id", "key"], "left")
            .select("doc_id", "n_words",
                    F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
                    F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut", "sha")).alias("kept_sha256")))


@any_names
def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated words of each text cut; texts without any, null and empty ones stay as they are.

    All rows and columns, whatever their names, are kept; an empty table stays empty.
    """
    found = Repeats(docs)
    new = found.cuts.filter("n_removed > 0").select("doc_id", "key", "kept").union(found.copies.select("doc_id", "key", F.lit("").alias("kept")))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("key"), F.struct(*docs.columns).alias("row"))
    cut = rows.join(new, ["doc_id", "key"], "left")
    return cut.select(*[(F.coalesce("kept", F.col("row")["text"]) if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
