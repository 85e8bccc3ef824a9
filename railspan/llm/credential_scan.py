"""Credential scan with multipart linking, in DataFrame functions alone.

Three base kinds are always reported: assigned secrets, access identifiers and hexadecimal runs. Weak
candidates (a bare 40-character key, a login, an endpoint) say little alone: matches become rows, and each weak
one is interval-joined, within its document, with the parts that complement it; it is reported only if one lies
within the scope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railspan.llm.common import materialize, only

# Patterns of the base kinds, each with the group that is measured and its least length.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 18),
    "hex": (r"([0-9a-f]+)", 1, 16),
}
# A hexadecimal run is maximal, so asking for its least length in the pattern finds the same spans, sooner.
FAST = {"access": r"(AKIA[A-Z0-9]{14,})", "hex": r"([0-9a-f]{16,})"}
# Weak kinds, with their pattern, least length, the base kinds and the weak kinds that complement them. A bare
# key has 40 characters between its own bounds; a slash may stand in it or beside it.
WEAK = {
    "bare_key": (r"(?<![A-Za-z0-9+])([A-Za-z0-9+/]{40})(?![A-Za-z0-9+])", 40, ("access", "assign"), ("login", "endpoint")),
    "login": (r"((?i:user_?name|user|login|account|client_?id)\x20*[:=]\x20*[A-Za-z0-9._@-]+)", 6, ("assign",), ("bare_key",)),
    "endpoint": (r"((?:https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x00-\x20\x22\x27<>]+)", 8, ("access", "assign"), ("bare_key",)),
}
#: Code points between two parts that may still belong together.
SCOPE = 300


def _pieces(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """Array of the pattern's matches in page order: what lies between a match and the one before it, and the match, as lengths.

    The gaps between matches and the matches themselves tile the text, so running sums of these lengths give the places.
    """
    p = F.lit(pattern)
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("whole"), F.regexp_extract_all(text, p, F.lit(group)).alias("part"))

    def count(x, what):
        return (F.length(x) - F.length(F.replace(x, F.lit(what)))) / len(what)

    def measured(x, at):
        both = F.concat(x["gap"], F.coalesce(x["whole"], F.lit("")))
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), at.alias("at"), F.length(x["gap"]).cast("long").alias("gap"), F.length(x["whole"]).cast("long").alias("size"),
            (F.length(x["part"]) >= least).alias("fits"), count(both, "\n").cast("long").alias("lines"), count(both, "\n\n").cast("long").alias("blocks"))

    none = F.expr("cast(array() as array<struct<kind:string,rank:int,at:int,gap:bigint,size:bigint,fits:boolean,lines:bigint,blocks:bigint>>)")
    return F.when(text.rlike(pattern), F.filter(F.transform(zipped, measured), lambda x: x["size"].isNotNull())).otherwise(none)


def find_parts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id) and the parts found in them: row, kind, rank, start, end, line, block.

    The texts are read once; what is written is a row's number and the lengths of its matches. A block ends at an empty line.
    """
    text = F.coalesce("text", F.lit(""))
    kinds = {k: (FAST.get(k, p), g, n) for k, (p, g, n) in BASE.items()} | {k: (p, 1, n) for k, (p, n, _, _) in WEAK.items()}
    arrays = [_pieces(text, k, rank, *spec) for rank, (k, spec) in enumerate(kinds.items())]
    rows = materialize(only(docs, doc_id="long", text="string").select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(*arrays).alias("pieces")), "pieces")
    upto = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    pieces = rows.select("row", F.explode("pieces").alias("p")).select("row", "p.*")
    end = F.sum(F.col("gap") + F.col("size")).over(upto)
    parts = (pieces.withColumns({"end": end, "line": F.sum("lines").over(upto), "block": F.sum("blocks").over(upto)})
             .filter("fits").select("row", "kind", "rank", (F.col("end") - F.col("size")).alias("start"), "end", "line", "block"))
    return rows.select("row", "doc_id"), materialize(parts, "parts")


def link_parts(parts: DataFrame, scope: int, among_weak: bool) -> DataFrame:
    """Weak parts that a complementary part lies near to: row, kind, rank, start, end, links.

    An interval join: a weak part, widened by the scope on both sides, and each other part lie in the bins that they
    overlap, and meet by row and bin. links names, for each kind of complement, the nearest one (the first of equals) and
    the narrowest scope that holds both: line, block or near.
    """
    allowed = [f"{k}+{o}" for k, (_, _, wants, others) in WEAK.items() for o in (*wants, *(others if among_weak else ()))]
    loose = [f"{k}+{o}" for k, (_, _, wants, _) in WEAK.items() for o in wants if k != "bare_key"]  # may overlap
    size = 2 * scope

    def bins(begin, end):
        return F.explode(F.sequence(F.floor(F.greatest(begin, F.lit(0)) / size), F.floor(end / size))).alias("bin")

    weak = parts.filter(F.col("kind").isin(*WEAK)).select("row", F.struct("kind", "rank", "start", "end", "line", "block").alias("w"), bins(F.col("start") - scope, F.col("end") + scope))
    other = parts.select("row", F.struct("kind", "start", "end", "line", "block").alias("o"), bins(F.col("start"), F.col("end")))
    kinds = F.concat_ws("+", "w.kind", "o.kind")
    away = F.greatest(F.col("o.start") - F.col("w.end"), F.col("w.start") - F.col("o.end"))
    near = weak.join(other, ["row", "bin"]).filter(kinds.isin(*allowed) & (away <= scope) & ((away >= 0) | kinds.isin(*loose)))
    narrowest = F.when(F.col("w.line") == F.col("o.line"), "line").when(F.col("w.block") == F.col("o.block"), "block").otherwise("near")
    best = near.groupBy("row", "w", F.col("o.kind").alias("with")).agg(F.min(F.struct(F.greatest(away, F.lit(0)).alias("away"), F.col("o.start").alias("start"), F.col("o.end").alias("end"), narrowest.alias("scope"))).alias("b"))
    text = F.concat_ws(":", "with", F.col("b.start").cast("string"), F.col("b.end").cast("string"), "b.scope")
    return best.groupBy("row", "w").agg(F.array_sort(F.collect_list(text)).alias("links")).select("row", "w.kind", "w.rank", "w.start", "w.end", "links")


def joined(found: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    return F.concat_ws(",", F.transform(F.array_sort(found), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def find_credentials(docs: DataFrame, scope: int = SCOPE, among_weak: bool = False) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked, links for each row of docs (doc_id, text).

    Null texts count as empty: zero counts, the hash of the empty string and no spans. Repeated rows and null
    ids are returned row by row; other columns are ignored; an empty table gives an empty result. Only matches are
    shuffled, by row. With among_weak, weak parts that complement one another are linked too: a bare key with a login or endpoint.
    links lists the linked weak parts, each with its nearest complements: kind:start:end[kind:start:end:scope ...].
    """
    rows, parts = find_parts(docs)
    linked = link_parts(parts, scope, among_weak)
    one = F.struct("start", "rank", "end", "kind")
    base = parts.filter(F.col("kind").isin(*BASE)).groupBy("row").agg(F.collect_list(one).alias("base"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE])
    named = F.concat(F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")), F.lit("["), F.concat_ws(" ", "links"), F.lit("]"))
    weak = linked.groupBy("row").agg(F.collect_list(one).alias("weak"), F.array_sort(F.collect_list(F.struct("start", "rank", named.alias("text")))).alias("linked"))
    empty = F.expr("cast(array() as array<struct<start:bigint,rank:int,end:bigint,kind:string>>)")
    base_spans, weak_spans = F.coalesce("base", empty), F.coalesce("weak", empty)
    return rows.join(base, "row", "left").join(weak, "row", "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base_spans), 256).alias("base_sha256"), joined(F.concat(base_spans, weak_spans)).alias("spans"),
        F.size(weak_spans).cast("long").alias("n_linked"), F.concat_ws(",", F.transform(F.coalesce("linked", F.expr("cast(array() as array<struct<start:bigint,rank:int,text:string>>)")), lambda x: x["text"])).alias("links"))
