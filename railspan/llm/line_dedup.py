"""Line dedup in DataFrame functions alone: lines that many documents share stay in the last of them only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railspan.llm.common import ascii_lower, materialize, only

#: What is stripped at both ends of a line.
SPACES = " \t\n\x0b\f\r"
#: Code points that a line's key needs, and documents in which it is common.
LEAST_CHARS, LEAST_DOCS = 40, 5


def long_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """(d1, d2, doc_id, pos, h1, h2, first) of each line with a long key: its row and key by 128 bits of hash, and whether the row has it here first.

    The lines of a row are sorted by key within the row, so documents are counted without a shuffle by row and line.
    """
    keys = F.transform(F.split(ascii_lower("text"), "\n", -1), lambda x, i: F.struct(F.btrim(x, F.lit(SPACES)).alias("key"), i.alias("pos")))
    hashed = F.transform(F.filter(keys, lambda x: F.length(x["key"]) >= least_chars), lambda x: F.struct(F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit(1), x["key"]).alias("h2"), x["pos"].alias("pos")))
    rows = docs.select("d1", "d2", "doc_id", F.sort_array(hashed).alias("x")).filter("size(x) > 0")
    before = F.concat(F.expr("array(cast(null as struct<h1:bigint,h2:bigint,pos:int>))"), F.slice("x", 1, F.size("x") - 1))
    each = rows.select("d1", "d2", "doc_id", F.inline(F.arrays_zip(F.col("x").alias("l"), before.alias("b"))))
    same = (F.col("l.h1") == F.col("b.h1")) & (F.col("l.h2") == F.col("b.h2"))
    return each.select("d1", "d2", "doc_id", "l.pos", "l.h1", "l.h2", (~F.coalesce(same, F.lit(False))).alias("first"))


def repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(d1, d2, gone): positions of the lines that go, for each row (d1, d2, doc_id, text) that loses some."""
    lines = materialize(long_lines(docs, least_chars), "lines")
    common = lines.groupBy("h1", "h2").agg(F.count_if("first").alias("docs"), F.max("doc_id").alias("last")).filter(F.col("docs") >= least_docs).select("h1", "h2", "last")
    common = materialize(common, "common")  # a written side: Spark can split the other where many documents share a line
    return lines.join(common, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("last"))).groupBy("d1", "d2").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def drop_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept for each row of docs (doc_id, text): kept is the text without lines that many documents share.

    A null or empty text is one empty line. Each row is a document: rows that repeat an id are counted one by one, and all rows of
    the largest id keep their lines; a null id is smaller than all others. Texts are moved once, to the positions that they lose.
    Other columns are ignored; an empty table gives an empty result.
    """
    rows = only(docs, doc_id="long", text="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("d1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("d2"))
    met = rows.join(repeated_lines(rows, least_chars, least_docs), ["d1", "d2"], "left").withColumn("lines", F.split("text", "\n", -1))
    n, none = F.size("lines"), F.array(F.lit(-1))
    # runs of lines between two that go
    ends = F.zip_with(F.concat(none, "gone"), F.concat("gone", F.array(n)), lambda a, b: F.struct((a + 2).alias("start"), (b - a - 1).alias("size")))
    kept = F.flatten(F.transform(ends, lambda r: F.slice("lines", r["start"], r["size"])))
    return met.select("doc_id", n.cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept"))
