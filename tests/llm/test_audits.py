"""Operators 11 to 13 against plain Python, on nulls, repeats, ties, empty tables, long texts and further columns."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from railspan.llm import divergence, filter_audit, line_dedup

DOCS = "doc_id long, text string, lang string, source string, `a.b` int, term string, n long, part string"
LINE = "the same long licence line stands here in every text"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], DOCS)


def ascii_lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute_divergence(rows, least=3, top=200):
    rows = [tuple(x or "" for x in r[1:4]) for r in rows]
    terms = [(Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(t))), lang, s) for t, lang, s in rows]
    out = []
    for lang in {r[1] for r in rows}:
        df, by = Counter(), defaultdict(Counter)
        for c, g, s in terms:
            if g == lang:
                df.update(c.keys())
                by[s].update(c)
        kept = [w for w, k in df.items() if k >= least]
        whole = Counter()
        for c in by.values():
            whole.update(c)

        def shares(c):
            n = sum(c[w] for w in kept) + len(kept)
            return {w: 1 + 10**9 * (c[w] + 1) // n for w in kept}

        p, q = {s: shares(c) for s, c in by.items()}, shares(whole)
        for s in by:
            pair = [(-sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o) for o in by if o != s]
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, o) in enumerate(sorted(pair, key=lambda x: (x[0], x[1].encode())))]
            more = [(-((p[s][w] - q[w]) ** 2 // q[w]), w) for w in kept if by[s][w] and p[s][w] > q[w]]
            out += [(lang, s, "term", w, -v, i + 1) for i, (v, w) in enumerate(sorted(more, key=lambda x: (x[0], x[1].encode()))[:top])]
    return sorted(out)


ODD = [(1, "Haus haus Ärger über 𝔘 x", "de", "a"), (2, "haus Über über über x y", "de", "b"), (3, "haus über x y y", "de", None), (3, "haus über x y y", "de", None), (4, None, "de", "leer"), (5, "one two", None, "a"),
       (None, "", "en", "a"), (6, "kein wort dreimal", "xx", "a"), (7, None, "xx", "b"), (8, "y Ärger", "de", "b"), (9, "y ärger", "de", "a")]


@pytest.mark.parametrize("top", [1, 2, 200])
def test_divergence_equals_brute_force(spark, top):
    got = divergence.audit_sources(docs_of(spark, ODD), top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_divergence(ODD, top=top)


def test_divergence_of_many_equal_vectors_and_ties(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]  # one vector for all: the first 200 by name are reported
    rows = [(i, " ".join(words), "en", "hot") for i in range(3)] + [(9, "other other " * 9, "en", "cold"), (10, "other", "en", "cold"), (11, "other", "en", "mid")]
    got = sorted(map(tuple, divergence.audit_sources(docs_of(spark, rows)).collect()))
    assert got == brute_divergence(rows) and sum(r[2] == "term" and r[1] == "hot" for r in got) == 200


def test_divergence_of_long_text_and_nothing(spark):
    rows = [(i, f"Long text {i} " * 60_000, "en", f"s{i % 2}") for i in range(4)]
    assert sorted(map(tuple, divergence.audit_sources(docs_of(spark, rows)).collect())) == brute_divergence(rows)
    assert divergence.audit_sources(docs_of(spark, [])).count() == 0


def brute_filters(rows, labels):
    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", t)

    first, docs = {}, []
    for i, t, _, s in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, _, s in rows:
        t, w = t or "", words(t or "")
        bad = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        docs.append((s or "", bad, any(a == i and q == 1 for a, q, _ in labels if a is not None), any(a == i and x == 1 for a, _, x in labels if a is not None)))
    out = []
    for part in {d[0] for d in docs}:
        shapley = Counter()
        rows_of = []
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            for k, f in enumerate(order):
                gone, stay = [d for d in left if d[1][f]], [d for d in left if not d[1][f]]
                mine = [d for d in docs if d[0] == part and d[1][f]]
                shapley[f] += len(gone)
                rows_of.append([part, "".join(order), k + 1, len(stay), len(gone), len(mine) - len(gone), sum(sum(d[1].values()) == 1 for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)])
                left = stay
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in rows_of]
    return sorted(out)


PLAIN = " ".join(f"word{i}" for i in range(60))
FILTER_ROWS = [(1, PLAIN, "en", "a"), (2, PLAIN, "en", "b"), (2, PLAIN, "en", "b"), (None, PLAIN, "en", "a"), (3, None, "en", None), (4, "", "en", ""), (5, "same " * 80, "en", "a"), (6, "LOUD " * 60, "en", "a"),
               (7, PLAIN + " 100%", "en", "b"), (8, PLAIN + " 100%", "en", "a"), (9, "short # TEXT", "en", "c"), (10, "x" * 200_000 + " " + PLAIN, "en", "c"), (11, "Wort wort " * 32 + PLAIN, "de", "c")]
LABELS = [(1, 1, 0), (1, 0, 0), (2, 1, 1), (5, 0, 1), (6, None, 1), (None, 1, 1), (8, 1, None)]


def test_filters_equal_brute_force(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.audit_filters(docs_of(spark, FILTER_ROWS), labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == brute_filters(FILTER_ROWS, LABELS)


def test_filters_without_labels_and_without_documents(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.audit_filters(docs_of(spark, FILTER_ROWS[:2]), labels)
    assert sorted(map(tuple, got.collect())) == brute_filters(FILTER_ROWS[:2], [])
    assert filter_audit.audit_filters(docs_of(spark, []), labels).count() == 0


def brute_lines(rows):
    spaces = " \t\n\x0b\f\r"
    held = defaultdict(list)
    for k, r in enumerate(rows):
        for key in {ascii_lower(line.strip(spaces)) for line in (r[1] or "").split("\n")}:
            held[key].append((k, r[0]))
    out = []
    for i, t, *_ in rows:
        lines, kept = (t or "").split("\n"), []
        for line in lines:
            key = ascii_lower(line.strip(spaces))
            ids = [x for _, x in held[key]]
            last = max([x for x in ids if x is not None], default=None)
            if len(key) < 40 or len(ids) < 5 or i == last:
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def lines_of(spark, rows):
    return sorted(map(tuple, line_dedup.drop_lines(docs_of(spark, rows)).collect()), key=repr)


def test_lines_equal_brute_force(spark):
    other = "É" * 39 + "x"
    rows = [(i, f"head {i}\n {LINE.upper()}\t\r\n\n{LINE}\n{other}", "en", "a") for i in range(1, 7)]
    rows += [(7, None, "en", "a"), (8, "", "en", "a"), (None, f"{LINE}\nz", "en", "a"), (6, f"{LINE}", "en", "a"), (6, f"{LINE}", "en", "a"), (20, LINE[:39], "en", "b"), (21, f" {LINE}", "en", "b"), (22, other.lower(), "en", "b"), (23, "\n\n", "en", "b")]
    assert lines_of(spark, rows) == brute_lines(rows)


def test_lines_of_few_documents_nulls_only_and_long_texts(spark):
    four = [(i, f"{LINE}\n{LINE}\nx{i}", "en", "a") for i in range(4)]
    assert lines_of(spark, four) == brute_lines(four) and not any(r[2] for r in lines_of(spark, four))
    nulls = [(None, LINE, "en", "a")] * 6
    assert lines_of(spark, nulls) == brute_lines(nulls)
    long = [(i, "\n".join(f"{LINE} {k % 7} {k % (i + 2)}" for k in range(40_000)), "en", "a") for i in range(6)]
    assert lines_of(spark, long) == brute_lines(long)
    assert line_dedup.drop_lines(docs_of(spark, [])).count() == 0


def test_line_hashes_of_the_query(spark, data):
    from railspan.llm import queries

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    want = [(i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute_lines(docs)]
    assert sorted(map(tuple, queries.op13_line_dedup(spark, data).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())) == sorted(want)
