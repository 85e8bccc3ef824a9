"""The registered queries of this subpackage: one for each operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railspan.llm import bpe, credential_scan, divergence, filter_audit, fingerprints, html_extract, line_dedup, near_dup, packing, pii, quality, substring_dedup, toxicity
from railspan.llm.common import table


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op3_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credential_scan.find_credentials(table(spark, sf_dir, "documents"), among_weak=True)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_words(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(table(spark, sf_dir, "documents")).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


QUERIES = {f.__name__: f for f in (
    op1_near_duplicates, op2_main_text, op3_credentials, op4_packing, op5_quality, op6_substrings, op7_fingerprints, op8_pseudonyms, op9_toxicity, op10_bpe,
    op11_divergence, op12_filter_audit, op13_line_dedup)}

WORD = r"[^\x20\x09-\x0D]+"

#: Links by exact prefix filtering: of two sets that are alike, ordered from the rarest shingle on, the first n - ceil(0.8 n) + 1 share one.
NEAR_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, unnest(x) AS word, generate_subscripts(x, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS x FROM documents)),
g AS (SELECT doc_id, word || coalesce(' ' || lead(word) OVER o, '') AS shingle, lead(word) OVER o IS NULL AS ends, i FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS MATERIALIZED (SELECT DISTINCT doc_id, shingle FROM g WHERE NOT ends OR i = 1),
sets AS (SELECT doc_id, list_sort(list(shingle)) AS x FROM s GROUP BY 1),
classes AS MATERIALIZED (SELECT x, min(doc_id) AS rep, len(x) AS n FROM sets GROUP BY x),
e AS (SELECT rep, n, unnest(x) AS shingle FROM classes),
f AS (SELECT rep, n, shingle, count(*) OVER (PARTITION BY shingle) AS df FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY df, shingle) AS k FROM f),
p AS MATERIALIZED (SELECT rep, n, shingle FROM r WHERE k <= n - (4 * n + 4) // 5 + 1 AND df > 1),
c AS (SELECT DISTINCT a.rep AS u, b.rep AS v FROM p a JOIN p b ON a.shingle = b.shingle AND a.rep < b.rep AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
m AS (SELECT u, v, a.n + b.n AS total, len(list_intersect(a.x, b.x)) AS shared FROM c JOIN classes a ON a.rep = u JOIN classes b ON b.rep = v),
links AS (SELECT u, v FROM m WHERE 100 * shared >= 80 * (total - shared)),
edges AS MATERIALIZED (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT rep AS a, rep AS b FROM classes UNION SELECT a, v FROM reach JOIN edges ON b = u),
comp AS (SELECT a AS rep, min(b) AS component FROM reach GROUP BY 1)
SELECT doc_id, CAST(coalesce(len(sets.x), 0) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM documents LEFT JOIN sets USING (doc_id) LEFT JOIN classes ON classes.x = sets.x LEFT JOIN comp USING (rep)"""

#: Twenty words by runs of doubling length; a window is a repeat unless it is the first of its words.
REPEATS_SQL = rf"""
WITH w AS (
  SELECT doc_id, unnest(x) AS word, generate_subscripts(x, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS x FROM documents)),
w2 AS (SELECT *, word || ' ' || lead(word) OVER (PARTITION BY doc_id ORDER BY i) AS a2 FROM w),
w4 AS (SELECT *, a2 || ' ' || lead(a2, 2) OVER (PARTITION BY doc_id ORDER BY i) AS a4 FROM w2),
w8 AS (SELECT doc_id, i, word, a4, a4 || ' ' || lead(a4, 4) OVER (PARTITION BY doc_id ORDER BY i) AS a8 FROM w4),
w16 AS (SELECT doc_id, i, word, a4, a8 || ' ' || lead(a8, 8) OVER (PARTITION BY doc_id ORDER BY i) AS a16 FROM w8),
w20 AS (SELECT doc_id, i, word, a16 || ' ' || lead(a4, 16) OVER (PARTITION BY doc_id ORDER BY i) AS a20 FROM w16),
seen AS (SELECT doc_id, i, word, a20 IS NOT NULL AND row_number() OVER (PARTITION BY a20 ORDER BY doc_id, i) > 1 AS again FROM w20),
gone AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS out FROM seen),
k AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE out) AS gone, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT out) AS kept FROM gone GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN k USING (doc_id)"""

#: Every kept term of every group, and every pair of groups for every kept term, without folding.
DIVERGENCE_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
tok AS MATERIALIZED (SELECT lang, source, r, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM tok GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
vocab AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM tok SEMI JOIN kept USING (lang, term) GROUP BY ALL),
full0 AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
full1 AS (SELECT lang, source, term, n, sum(n) OVER (PARTITION BY lang, source) AS s, sum(n) OVER (PARTITION BY lang, term) AS nl, sum(n) OVER (PARTITION BY lang) AS sl FROM full0),
p AS MATERIALIZED (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (s + v) AS p, 1 + (1000000000::HUGEINT * (nl + 1)) // (sl + v) AS q FROM full1 JOIN vocab USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM
  (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts) WHERE part = 'pair' OR rank <= 200"""

#: Every order walked for every cell: a document goes at the first filter of the order that it fails.
FILTERS_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
f AS (SELECT part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, doc_id > min(doc_id) OVER (PARTITION BY t) AS e, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic FROM d LEFT JOIN labels USING (doc_id)),
cells AS (SELECT part, a, b, c, d, e, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT p.x || q.x || r.x || s.x || t.x AS o FROM l p, l q, l r, l s, l t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
walk AS (SELECT part, o, n, good, toxic, a, b, c, d, e, a::INT + b::INT + c::INT + d::INT + e::INT AS fails,
  least(CASE WHEN a THEN instr(o, 'A') ELSE 9 END, CASE WHEN b THEN instr(o, 'B') ELSE 9 END, CASE WHEN c THEN instr(o, 'C') ELSE 9 END, CASE WHEN d THEN instr(o, 'D') ELSE 9 END, CASE WHEN e THEN instr(o, 'E') ELSE 9 END) AS hit FROM cells, orders),
steps AS (SELECT *, substr(o, step, 1) AS x FROM walk, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
s AS (SELECT *, CASE x WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS bad FROM steps),
r AS (SELECT part, o, step, x, coalesce(sum(n) FILTER (WHERE hit > step), 0) AS kept, coalesce(sum(n) FILTER (WHERE hit = step), 0) AS removed, coalesce(sum(n) FILTER (WHERE bad AND hit < step), 0) AS redundant,
  coalesce(sum(n) FILTER (WHERE bad AND fails = 1), 0) AS unique_fails, coalesce(sum(good) FILTER (WHERE hit = step), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE hit = step), 0) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM r"""

LINES_SQL = r"""
WITH x AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM x),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT doc_id, i, line, coalesce(doc_id <> last, false) AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY 1"""

ORACLES: dict[str, str] = {"op1_near_duplicates": NEAR_SQL, "op6_substrings": REPEATS_SQL, "op11_divergence": DIVERGENCE_SQL, "op12_filter_audit": FILTERS_SQL, "op13_line_dedup": LINES_SQL}
