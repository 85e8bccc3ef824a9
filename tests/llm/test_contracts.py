"""Cases beyond the operators' own tests: clashing names, odd pages and values, stages on small tables."""

import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from railspan.llm import credential_scan, fingerprints, html_extract, packing, pii, quality, substring_dedup, toxicity
from tests.llm import brute

WORDS = "This is a sentence of the article, with commas, and enough words to count as text. " * 4
TEXT = WORDS.strip()
CLASHES = "doc_id long, text string, _score double, n_email long, _id long, _key long, _kept string, row string, key int, salt int, kept boolean"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, 7, 8, 9, "k", "r", 1, 2, False) for i, t in rows], CLASHES)


# ---- pages

@pytest.mark.parametrize(("page", "want"), [
    (f"<body><div><p>{WORDS}</p><p>{WORDS}</p></div><div><p>Short end.</p></div></body>", f"{TEXT} {TEXT} Short end."),
    (f"<body><div class=content><h1>Title</h1><div><p>{WORDS}</p><p>{WORDS}</p></div></div></body>", f"Title {TEXT} {TEXT}"),
    (f"<article><div class='legal-analysis'><p>{WORDS}</p></div><p class='search-results'>{WORDS}</p><p>{WORDS}</p></article>", f"{TEXT} {TEXT} {TEXT}"),
    (f"<article><p>{WORDS}</p><p>{WORDS}</p><div class='comments-area'><p>{WORDS}</p></div></article>", f"{TEXT} {TEXT}"),
    (f"<article><p>{WORDS}</p><div class='search-links'><a href=a>One more page here</a> <a href=b>Another page there</a></div></article>", TEXT),
    (f"<article><p>A teaser, <a href=x>more</a></p></article><div><p>{WORDS}</p><p>{WORDS}</p><p>{WORDS}</p><p>{WORDS}</p><p>{WORDS}</p></div>", " ".join([TEXT] * 5)),
    (f"<article><h1>Title</h1><div><div><div><div><p>{WORDS}</p></div></div></div></div></article><div><p>Other.</p><a href=x>Other pages, many</a></div>", f"Title {TEXT}"),
    (f"<article><div><p>{WORDS}</p><p>{WORDS}</p></div><div><p>{WORDS}</p></div><p title='a > b'>It's done.</p></article>", f"{TEXT} {TEXT} {TEXT} It's done."),
    (f"<article><p>{WORDS}</p><div class='related-work'><h2>Related work</h2><p>One of them, here. And two more.</p></div><p>{WORDS}</p></article>", f"{TEXT} Related work One of them, here. And two more. {TEXT}"),
    (f"<article><p>{WORDS}</p><section class='menu'><p>Soup of the day, with bread and butter, for five.</p><p>Fish with potatoes, in season, for ten.</p></section></article>",
     f"{TEXT} Soup of the day, with bread and butter, for five. Fish with potatoes, in season, for ten."),
    (f"<article><ul class=menu><li>Home<li>News of today<li>Weather</ul><div class=menu>{'<a href=a>Some page</a> ' * 20}</div><p>{WORDS}</p></article>", TEXT),
    (f"<article><p>Use <label>here</label> and now.</p><p>{WORDS}</p><label>Your name</label><input></article>", f"Use here and now. {TEXT}"),
    (f"<body><div><p>{WORDS}</p><p>{WORDS}</p></div><div>{WORDS.replace('.', ',')}and no stop</div><div>Site of 2024</div></body>", f"{TEXT} {TEXT} {WORDS.replace('.', ',')}and no stop"),
    (f"<article><p>{WORDS}</p><div class=comments><p>{WORDS}</p></div><div class='advert-box'>{WORDS}</div><div class=newsletter>{WORDS}</div></article>", TEXT),
    (f"<body><ul><li>One, two.<li>Three, four.</ul><p title=it's>{WORDS}<p class=\"x>y\">{WORDS}</body>", f"One, two. Three, four. {TEXT} {TEXT}"),
])
def test_pages_by_their_scores(page, want):
    assert html_extract.extract(page) == want


@pytest.mark.parametrize("page", [
    "<a " * 300_000 + "'", "<a " * 300_000 + "'>", "<b>x" * 150_000, "<p><td>" + "<b>x" * 40_000 + "<h1></h1>" * 40_000, "<i>" * 80_000 + "</b>" * 150_000,
    '<a ="' * 200_000, "<p class='" + "advert_" * 100_000 + ".'>x", "< " * 400_000, "<!-" * 300_000, "<div>x" * 100_000, "&#" * 300_000, "<![CDATA[" * 100_000, "<p a" + " " * 500_000 + "b>x"])
def test_hostile_pages_take_linear_time(page):
    html_extract.extract("<p>warm</p>")
    began = time.time()
    html_extract.extract(page)
    assert time.time() - began < 12  # a quadratic reader takes many minutes


# ---- personal data

@pytest.mark.parametrize("size", range(1, 65))
def test_addresses_of_every_length(size):
    p = pii.Pseudonyms(b"k")
    r = random.Random(size)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "ab9Z", "äöüéàñ", "жшщя"):
        local = "".join(r.choice(letters) for _ in range(size))
        new = p.replace(f"{local}@example.org")[0].partition("@")[0]
        assert len(new) == size and all(a.isalpha() == b.isalpha() and a.islower() == b.islower() for a, b in zip(local, new, strict=True))


@pytest.mark.parametrize("alphabet", ["äöüéàñ", "жшщя", "ÄÖ", "漢字"])
def test_letters_beyond_ascii_are_permuted(alphabet):
    f = pii.Feistel(b"k", "email")
    group = pii._letters(alphabet[0])
    assert len({pii._email(f"{c}@x.org", f) for c in group}) == len(group)
    assert {pii._email(f"{c}@x.org", f)[0] for c in group} == set(group)


def test_the_session_names_the_key(spark):
    spark.conf.set("spark.railspan.pseudonymKey", "secret")
    try:
        assert pii.session_key(spark) == b"secret"
    finally:
        spark.conf.unset("spark.railspan.pseudonymKey")
    assert pii.session_key(spark) == pii.DEFAULT_KEY


# ---- tokens

def test_packing_follows_the_files_special_tokens(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    special = next(iter(t.get_added_tokens_decoder().values())).content
    rows = [(1, f"x {special} y"), (2, special), (3, f"a{special}{special} b"), (4, "plain")]
    got = packing.pack_documents(clashing(spark, rows), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    for i, text in rows:
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        own = [x for x in got if x.doc_id == i]
        assert sum(x.length for x in own) == own[0].doc_tokens == len(ids)
        assert all(x.ids_crc32 == zlib.crc32(np.array(ids[x.start : x.start + x.length], "<u4").tobytes()) for x in own)


# ---- credentials

def test_linked_parts_equal_brute_force(spark):
    r = random.Random(6)
    makers = [
        lambda: "AKIA" + "".join(r.choice("ABCDEFGH234") for _ in range(16)), lambda: "".join(r.choice("abcXYZ019/+") for _ in range(40)),
        lambda: f"login: user{r.randrange(99)}", lambda: f"https://h{r.randrange(99)}.example/{'p' * r.choice((3, 900))}",
        lambda: f"password = {'s' * r.randrange(8, 20)}", lambda: "word " * r.randrange(1, 90), lambda: "\n", lambda: "\n\n", lambda: "0123456789abcdef0"]
    rows = [(i, "".join(r.choice(makers)() + r.choice((" ", "\n", " | ")) for _ in range(r.randrange(30)))) for i in range(150)] + [(900, None), (901, ""), (None, f"{'k' * 40} login: bob")]
    for among in (False, True):
        got = credential_scan.find_credentials(clashing(spark, rows), among_weak=among).collect()
        assert sorted((str(x.doc_id), x.spans, x.links) for x in got) == sorted((str(i), *brute.linked(t, among)) for i, t in rows)


# ---- lines

def test_line_labels_are_latent():
    r = np.random.default_rng(4)
    at = {n: i for i, n in enumerate(quality.FEATURES)}
    text, junk = [0, at["ends a sentence"], at["words>=20"]], [0, at["symbols>0"], at["pipes>=2"]]
    documents, labels, truth = [], [], []
    for _ in range(200):
        y = int(r.random() < 0.5)
        n = int(r.integers(4, 12))
        odd = set(r.choice(n, (n - 1) // 3, replace=False).tolist())
        own = [1 - y if i in odd else y for i in range(n)]
        documents.append([text if v else junk for v in own])
        labels.append(y)
        truth.append(own)
    model = quality.fit_lines(documents, labels)
    right = [a == b for d, t in zip(documents, truth, strict=True) for a, b in zip(model.decode(d), t, strict=True)]
    plain = quality.fit_chain(documents, labels)
    right_before = [a == b for d, t in zip(documents, truth, strict=True) for a, b in zip(plain.decode(d), t, strict=True)]
    assert np.mean(right) > 0.99 > np.mean(right_before)


def test_little_junk_is_kept(spark):
    at = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    model = quality.fit_quality(d, labels.filter("doc_id % 2 = 0"))
    rows = quality.judge_quality(d, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed").groupBy("quality", "kept").count().collect()
    n = Counter({(x["quality"], x["kept"]): x["count"] for x in rows})
    assert n[0, True] <= 0.1 * (n[0, True] + n[0, False]) and n[1, False] <= 0.02 * (n[1, True] + n[1, False])


def test_samples_do_not_depend_on_the_order_of_rows(spark):
    rows = [(i % 40, f"Text number {i}, with a few words.\n### $$$ {i} | {i} |\n" * (1 + i % 3)) for i in range(400)]
    labels = [(i, i % 2, i % 2) for i in range(40)] + [(3, 0, 0), (None, 1, 1), (5, None, None)]
    fits = []
    for parts in (1, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").repartition(parts)
        model = quality.fit_quality(docs, marks)
        fits.append((model.emit.tolist(), model.move.tolist(), toxicity.fit_toxicity(docs, marks)))
    assert fits[0] == fits[1]


# ---- tables with clashing names, stages

def test_tables_keep_clashing_columns(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    rows = [(1, f"mail a@b.org {passage}"), (2, f"again {passage} end"), (3, None), (None, passage), (4, "")]
    df = clashing(spark, rows)
    for out in (substring_dedup.remove_repeats(df), pii.pseudonymise_table(df), toxicity.drop_toxic(df, toxicity.ToxicityModel())):
        assert out.columns == df.columns and out.count() == len(rows)
        assert {tuple(r)[2:] for r in out.collect()} == {(0.5, 7, 8, 9, "k", "r", 1, 2, False)}
    assert {r.doc_id: r.text for r in substring_dedup.remove_repeats(df).collect()}[2] == "again end"


def test_stages_on_small_tables(spark, tmp_path):
    passage = " ".join(f"w{i}" for i in range(60))
    near = [f"n{i}" for i in range(100)]
    rows = [(1, " ".join(near)), (2, " ".join([*near[:-1], "x"])), (3, f"a {passage} b"), (4, f"c d e {passage} f g h i j k l m n o p q r s t u v w x y z " * 2), (5, None), (6, ""), (7, "mail a.b@c.org now"),
            (None, "no id here"), (None, "no id here"), (8, "same id"), (8, "other text")]
    for kind, own in (("empty", []), ("rows", rows)):
        at = f"{tmp_path}/{kind}"
        clashing(spark, own).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        docs = spark.read.parquet(f"{at}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, at)
            assert out.columns == docs.columns, name
            path = f"{tmp_path}/{kind}-{name}"
            out.write.parquet(path)
            out = spark.read.parquet(path)
            if not own:
                assert out.count() == 0
                continue
            had, has = [(r.doc_id, r.text) for r in docs.collect()], [(r.doc_id, r.text) for r in out.collect()]
            if name == "near_duplicates":
                linked = brute.near_duplicates([(i, t) for i, t in had if i is not None], 5)
                want = [(i, t) for i, t in had if i is None] + [(i, min(t or "" for j, t in had if j == i)) for i in sorted({i for i, _ in had if i is not None}) if linked[i][2]]
                assert sorted((str(i), t or "") for i, t in has) == sorted((str(i), t or "") for i, t in want)
            elif name == "substrings":
                want = brute.repeated_words([(i, t) for i, t in had if i is not None])
                for i, t in has:
                    if i is not None and want[i][1]:
                        assert len(t.split()) == want[i][0] - want[i][1]
                    else:
                        assert (i, t) in had
            elif name == "personal_data":
                p = pii.Pseudonyms(pii.DEFAULT_KEY)
                assert Counter(has) == Counter((i, p.replace(t)[0] if t else t) for i, t in had)
            else:
                assert Counter(has) == Counter(had)
            docs = out
        pieces = corpus_pipeline.pack(spark, docs, at)
        assert pieces.count() >= docs.count()
        docs = spark.read.parquet(f"{at}/documents.parquet")


def test_near_duplicate_stragglers(spark):
    """A chain of groups whose buckets stay split: links between components are found by the prefix filter."""
    from railspan.llm import near_dup

    r = random.Random(12)
    rows = []
    for g in range(25):
        words = [f"g{g}w{r.randrange(400)}" for _ in range(r.choice((12, 40, 160)))]
        for i in range(12):
            own = list(words)
            for _ in range(int(len(words) * r.choice((0.02, 0.05, 0.08, 0.1, 0.15)))):
                own[r.randrange(len(own))] = f"x{r.randrange(10**6)}"
            rows.append((g * 100 + i, " ".join(own)))
            words = own if i % 3 else words  # a chain: each text is like the one before, not like the first
    for k in (1, 2, 5):
        got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=k).collect()}
        assert got == brute.near_duplicates(rows, k)




def test_stages_keep_columns_of_any_names(spark, tmp_path):
    """Dots, backticks, spaces, and the names of own columns in other letters."""
    names = ["a.b", "x`y", "DOC_ID", "Text", "row", "kept", "k e y", "further_2", "doc_id.text"]
    rows = [(1, "mail a@b.org " + " ".join(f"w{i}" for i in range(40))), (2, "again " + " ".join(f"w{i}" for i in range(40))), (2, None), (None, "no id"), (5, "")]
    df = spark.createDataFrame([(*range(9), *r) for r in rows], ", ".join(f"`c{i}` int" for i in range(9)) + ", doc_id long, text string").toDF(*names, "doc_id", "text")
    spark.createDataFrame([(1, "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns, name
        got = out.collect()
        assert {tuple(r)[:9] for r in got} == {tuple(range(9))} and {r[9] for r in got} == {1, 2, None, 5}, name
    assert corpus_pipeline.pack(spark, df.toDF(*[f"n{i}" for i in range(9)], "doc_id", "text"), str(tmp_path)).count() >= 5


def test_long_addresses_and_long_keys():
    p = pii.Pseudonyms(pii.DEFAULT_KEY)
    for local, end in (("x" * 65, "org"), ("y" * 5000, "org"), ("a.b", "z" * 40)):
        text = f"write to {local}@example.{end} now"
        new, _ = p.replace(text)
        assert local not in new and f"@example.{end} now" in new
    long = b"k" * 64
    assert pii.Pseudonyms(long + b"1").replace("2019-02-01")[0] != pii.Pseudonyms(long + b"2").replace("2019-02-01")[0]


# ---- byte pairs: bounded caches, edits that stop, the ids themselves

def _blob():
    import public_tokenizers as P

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return type("Blob", (), {"value": f.read()}), P.PATTERN


def test_an_edit_stops_where_the_tables_agree():
    from railspan.llm import bpe

    e, r = bpe.PrefixEncoder(bpe.read_ranks(_blob()[0].value.splitlines())), random.Random(3)
    worked = []
    table = e.table
    e.table = lambda data, last=None, upto=None: worked.append(len(data) if upto is None else upto) or table(data, last, upto)
    for size in (0, 1, 40, 5000):
        data = "".join(r.choice("aeinorst ,.é\n0") for _ in range(size)).encode()
        last = table(data)
        for new in (b"", b"er", b"the " * 9):
            a, b = sorted((r.randrange(len(data) + 1), r.randrange(len(data) + 1)))
            b = min(b, a + 20)
            worked.clear()
            whole, got = e.edit(data, last, a, b, new)
            assert whole == data[:a] + new + data[b:] and got == table(whole)
            assert max(worked, default=0) - a <= len(new) + 4 * e.longest + 40


def test_matches_are_kept_within_their_bytes(monkeypatch):
    from railspan.llm import bpe

    monkeypatch.setattr(bpe.Matches, "LIMIT", 100_000)
    blob, pattern = _blob()
    found = bpe.Matches(bpe.PrefixEncoder(bpe.read_ranks(blob.value.splitlines())))
    r, split = random.Random(1), bpe.splitter(pattern)
    for n in range(3000):
        text = "".join(r.choice("abcdefgh") for _ in range(r.choice((3, 9, 300))))
        for m in split(f" the {text}"):
            assert found[m] == found[m] and b"".join(found.encoder.bytes_of[int(i)] for i in found[m][1].split()) == m.encode()
        assert len(found) + len(found.old) <= 2 * 100_000 / bpe.Matches.EACH + 2
    assert all(len(m) <= 64 for m in found)


def test_unspaced_texts_need_little_memory():
    import resource

    import pyarrow as pa

    from railspan.llm import bpe

    blob, pattern = _blob()
    r = random.Random(5)
    texts = ["".join(r.choice("abcdefghijklmnop0123456789,;") for _ in range(2000)) for _ in range(600)]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for _ in bpe._run(blob, pattern)(pa.RecordBatch.from_pydict({"doc_id": list(range(50)), "text": texts[i : i + 50]}) for i in range(0, 600, 50)):
        pass
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 400


def test_ids_of_texts_equal_the_library(spark):
    import public_tokenizers as P
    import tiktoken

    from railspan.llm import bpe

    path = P.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(open(path, "rb")), special_tokens={})
    texts = ["It's  two\n\n words", "", None, "\x1c x \x85 y é", "a" * 300]
    got = {x.doc_id: x.ids for x in bpe.token_ids(clashing(spark, list(enumerate(texts))), path, P.PATTERN).collect()}
    assert got == {i: own.encode_ordinary(t or "") for i, t in enumerate(texts)}


# ---- fingerprints

@given(st.lists(st.text(st.sampled_from("ab \u00e9\U0001f600") | st.characters(codec="utf-32")), max_size=6) | st.lists(st.text("ab", max_size=400), max_size=3))
@settings(max_examples=60, deadline=None)
def test_parsing_equals_one_symbol_at_a_time(texts):
    rng = np.random.default_rng(77)
    a, b = rng.integers(0, 1 << 63, 64, np.uint64), rng.integers(0, 1 << 63, 64, np.uint64)
    assert fingerprints.fingerprints(texts) == [brute.fingerprint(t, [2 * int(x) + 1 for x in a], [int(x) for x in b]) for t in texts]


def test_fingerprints_name_phrases_up_to_the_whole_text():
    text = " ".join(f"word{i * i % 997}" for i in range(3000))
    rng = np.random.default_rng(77)
    a, b = rng.integers(0, 1 << 63, 64, np.uint64), rng.integers(0, 1 << 63, 64, np.uint64)
    want = brute.fingerprint(text, [2 * int(x) + 1 for x in a], [int(x) for x in b])
    others = ["", "x", "a" * 5000, text[:700]]
    assert fingerprints.fingerprints([*others[:2], text, *others[2:], text]) == [*fingerprints.fingerprints(others[:2]), want, *fingerprints.fingerprints(others[2:]), want]
    seq, sizes = [brute.mix(ord(c)) for c in text], []
    while len(seq) > 1:
        seq = brute.parse(seq)
        sizes.append(len(seq))
    assert sizes == sorted(set(sizes), reverse=True) and sizes[-1] == 1 and len(sizes) > 4
