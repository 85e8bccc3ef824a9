"""Source divergence audit: how the sources of a language differ in their counts of terms, in exact arithmetic.

Terms whose counts by source are the same vector fold into one class with a multiplicity. A pair of sources is worked
out once for each class that has counts in both; what one count alone decides is worked out once for each distinct
count of a source, and terms with neither once for the pair: the value of a pair is the sum of these corrections
over the value that it would have without any count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railspan.llm.common import ascii_lower, materialize, only

#: A term: letters and everything beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of its language that a term needs, scale of the shares, and ranks of terms that are reported.
LEAST_DOCS, SCALE, TOP = 3, 1_000_000_000, 200

WIDE = "decimal(38,0)"


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)); null where there are no terms."""
    top = (count + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    whole = F.call_function("div", top, F.nullif(total + terms, F.lit(0)).cast("decimal(19,0)"))
    return F.when(terms > 0, 1 + whole)


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, c, d): occurrences, and documents that hold it. Occurrences of a row are sorted, so each term's first is known without a shuffle."""
    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], F.sort_array(F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0))).alias("x"))
    pairs = F.arrays_zip(F.col("x").alias("term"), F.concat(F.array(F.lit(None).cast("string")), "x").alias("before"))
    each = rows.select("lang", "source", F.inline(pairs)).filter("term is not null")
    return each.groupBy("lang", "source", "term").agg(F.count("*").alias("c"), F.count_if(~F.col("term").eqNullSafe(F.col("before"))).alias("d"))


def audit_sources(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank of docs (text, lang, source).

    Part "pair": item is each other source of the language, value the divergence from it, by all ranks. Part "term": item is
    a term that the source has more often than its language, by ranks to `top`. Values fall; of equal ones the least item
    (by its UTF-8) comes first. Null texts, languages and sources count as empty; each row is a document, also if it repeats
    another; other columns are ignored; an empty table gives no row. A language without kept terms has pairs of value 0.
    """
    docs = only(docs, text="string", lang="string", source="string")
    counts = count_terms(docs)
    vectors = counts.groupBy("lang", "term").agg(F.sum("d").alias("df"), F.sort_array(F.collect_list(F.struct("source", "c"))).alias("counts")).filter(F.col("df") >= least_docs)
    vectors = materialize(vectors.select("lang", "term", "counts"), "vectors")
    classes = vectors.groupBy("lang", "counts").agg(F.count("*").alias("m"), F.min("term").alias("least"))
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda n, e: n + e["c"])
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("id"), "lang", "counts", "m", "least", total.alias("total")), "classes")

    # what is known of each group: occurrences of kept terms in it and in its language, and how many terms that has
    entries = classes.select("id", "lang", "m", "least", "total", F.inline("counts"))
    own = entries.groupBy("lang", "source").agg(F.sum(F.col("c") * F.col("m")).alias("n"))
    whole = classes.groupBy("lang").agg(F.sum("m").alias("terms"), F.sum(F.col("total") * F.col("m")).alias("n_lang"))
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct().join(own, ["lang", "source"], "left").join(whole, "lang", "left").fillna(0, ["n", "terms", "n_lang"])
    groups = materialize(groups.withColumn("z", share(F.lit(0), F.col("n"), F.col("terms"))), "groups")  # z: the share of a term that it lacks

    known = entries.join(groups, ["lang", "source"]).withColumn("p", share(F.col("c"), F.col("n"), F.col("terms")))
    pairs = _pairs(groups, known)
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.withColumn("rank", F.row_number().over(place)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").union(_terms(known, vectors, classes, top))


def _pairs(groups: DataFrame, known: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of a language's sources."""
    m, pa, za, pb, zb = F.col("m"), F.col("a.p"), F.col("a.z"), F.col("b.p"), F.col("b.z")
    rows = known.groupBy("id").agg(F.first("lang").alias("lang"), F.first("m").alias("m"), F.sort_array(F.collect_list(F.struct("source", "p", "z"))).alias("x"))
    met = rows.filter("size(x) > 1").select("lang", "m", "x", F.posexplode("x").alias("i", "a")).select("lang", "m", "a", F.explode(F.slice("x", F.col("i") + 2, F.size("x"))).alias("b"))

    def both(p, z, q, y):  # beyond what the counts of each side alone explain
        return (m * (gap(p, q) + gap(z, y) - gap(p, y) - gap(z, q))).cast(WIDE)

    met = met.groupBy("lang", F.col("a.source").alias("s"), F.col("b.source").alias("t")).agg(F.sum(both(pa, za, pb, zb)).alias("st"), F.sum(both(pb, zb, pa, za)).alias("ts"))
    met = met.select("lang", F.inline(F.array(F.struct(F.col("s").alias("source"), F.col("t").alias("item"), F.col("st").alias("v")), F.struct(F.col("t").alias("source"), F.col("s").alias("item"), F.col("ts").alias("v")))))

    other = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("y"))
    levels = known.groupBy("lang", "source", "p", "z").agg(F.sum("m").alias("m")).join(other, "lang").filter("source <> item")
    one = levels.groupBy("lang", "source", "item").agg(
        F.sum((m * (gap(F.col("p"), F.col("y")) - gap(F.col("z"), F.col("y")))).cast(WIDE)).alias("f"), F.sum((m * (gap(F.col("y"), F.col("p")) - gap(F.col("y"), F.col("z")))).cast(WIDE)).alias("g"))
    one = one.select("lang", F.inline(F.array(F.struct("source", "item", F.col("f").alias("v")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("g").alias("v")))))

    none = groups.select("lang", "source", "z", "terms").join(other, "lang").filter("source <> item").select(
        "lang", "source", "item", F.coalesce(F.col("terms").cast("decimal(19,0)") * gap(F.col("z"), F.col("y")).cast("decimal(19,0)"), F.lit(0)).cast(WIDE).alias("v"))
    return none.union(one).union(met).groupBy("lang", "source", "item").agg(F.sum("v").cast("long").alias("value"))


def _terms(known: DataFrame, vectors: DataFrame, classes: DataFrame, top: int) -> DataFrame:
    """The terms that a source has more often than its language. By (value, least term) the first `top` classes of a
    group hold its first `top` terms, since each class before another has a term before all of the other's."""
    q = share(F.col("total"), F.col("n_lang"), F.col("terms"))
    more = known.withColumn("q", q).filter("p > q").select("id", "lang", "source", "least", gap(F.col("p"), F.col("q")).alias("value"))
    first = more.withColumn("k", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "least", "id"))).filter(F.col("k") <= top).select("id", "source", "value")
    named = first.join(classes.select("id", "lang", "counts"), "id").join(vectors, ["lang", "counts"]).select("lang", "source", F.col("term").alias("item"), "value")
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).filter(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
