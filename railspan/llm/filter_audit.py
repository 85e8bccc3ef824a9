"""Filter interaction audit: what five filters remove in each of their orders, from one cube over their failure flags.

Documents fold into cells of equal part and flags; the cube of the cells has, in its rows whose selected flags are all
false, the survivors of each subset of filters. A step of an order leads from the subset before it to the one with its filter.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railspan.llm.common import materialize, only

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
WORD = r"[^\x20\x09-\x0D]+"
NUMBERS = ("n", "good", "toxic")


def _bit(letter: str) -> int:
    """As grouping_id places it: the first filter highest."""
    return 1 << (len(FILTERS) - 1 - FILTERS.index(letter))


def flag_failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, A, B, C, D, E): which filters each row of docs (doc_id, text, source) fails.

    A: under 50 words. B: fewer than 65 % distinct words. C: more than 5 % of the code points are A-Z. D: a character of
    #$%&*|. E: the text of a smaller doc_id. The least id of each text (by its SHA-256) meets its own row by text and id, so copies stay spread.
    """
    text, words = F.coalesce("text", F.lit("")), F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    rows = only(docs, doc_id="long", text="string", source="string").select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("*", words.alias("words"))
    n = F.size("words")
    rows = rows.select("doc_id", "part", (n < 50).alias("A"), (100 * F.size(F.array_distinct("words")).cast("long") < 65 * n.cast("long")).alias("B"),
                       (100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 5 * F.length("text").cast("long")).alias("C"), F.col("text").rlike(r"[#$%&*|]").alias("D"), F.unhex(F.sha2("text", 256)).alias("digest"))
    rows = materialize(rows, "flags")
    least = rows.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    return rows.join(least, ["digest", "doc_id"], "left").select("doc_id", "part", *"ABCD", (F.col("doc_id").isNotNull() & F.col("first").isNull()).alias("E"))


def survivors(cells: DataFrame) -> DataFrame:
    """(part, subset, n, good, toxic): what fails no filter of the subset, for all 32 subsets of each part, zeros included."""
    cube = cells.cube("part", *FILTERS).agg(*[F.sum(x).alias(x) for x in NUMBERS], F.grouping_id("part", *FILTERS).alias("gid"))
    left = cube.filter((F.col("gid") <= ALL) & ~F.greatest(*[F.coalesce(F.col(f), F.lit(False)) for f in FILTERS]))
    left = left.select("part", F.col("gid").bitwiseXOR(F.lit(ALL)).cast("int").alias("subset"), *NUMBERS)
    every = cells.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(ALL))).alias("subset"))
    return every.join(left, ["part", "subset"], "left").fillna(0, list(NUMBERS))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each part, order and step.

    A null source is the part ''. Null texts count as empty. Each row of docs is a document; of rows that repeat an id none is
    smaller than the other; a null id is smaller than none and copies none. A document is good or toxic if some row of labels
    (doc_id, quality, toxic) says 1. Other columns are ignored. An empty table gives no row.
    """
    spark = docs.sparkSession
    says = only(labels, doc_id="long", quality="int", toxic="int").filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("q"), F.max(F.col("toxic") == 1).alias("t"))
    met = flag_failures(docs).join(says, "doc_id", "left")
    cells = materialize(met.groupBy("part", *FILTERS).agg(F.count("*").alias("n"), F.count_if("q").alias("good"), F.count_if("t").alias("toxic")), "cells")
    left = materialize(survivors(cells), "survivors")

    moves, steps = [], []  # fixed: 80 ways to add a filter to a subset, 600 steps
    for before in range(ALL + 1):
        for f in FILTERS:
            if not before & _bit(f):
                k = before.bit_count()
                moves.append((f, before, before | _bit(f), factorial(k) * factorial(len(FILTERS) - 1 - k)))
    for order in permutations(FILTERS):
        for i, f in enumerate(order):
            steps.append(("".join(order), i + 1, f, sum(map(_bit, order[:i]))))
    moves = spark.createDataFrame(moves, "filter string, before int, after int, orders long")
    steps = spark.createDataFrame(steps, "filter_order string, step int, filter string, before int")

    a = left.select("part", F.col("subset").alias("before"), *[F.col(x).alias(f"{x}_before") for x in NUMBERS])
    b = left.select("part", F.col("subset").alias("after"), *NUMBERS)
    drops = a.join(F.broadcast(moves), "before").join(b, ["part", "after"]).select(
        "part", "filter", "before", "orders", F.col("n").alias("kept"), (F.col("n_before") - F.col("n")).alias("removed"), (F.col("good_before") - F.col("good")).alias("good_lost"), (F.col("toxic_before") - F.col("toxic")).alias("toxic_lost"))
    drops = materialize(drops, "drops")
    alone = {f: ALL ^ _bit(f) for f in FILTERS}
    last = F.create_map(*[x for f, s in alone.items() for x in (F.lit(f), F.lit(s))])[F.col("filter")]
    facts = drops.groupBy("part", "filter").agg(F.max(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"), F.max(F.when(F.col("before") == last, F.col("removed"))).alias("unique_fails"),
                                                F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    return drops.join(F.broadcast(steps), ["filter", "before"]).join(facts, ["part", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
