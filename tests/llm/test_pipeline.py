import corpus_pipeline
from tests.llm import brute


def test_stages_and_run(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, data).cache()
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and set(after) <= set(before)
        seen[name] = (before, after)
    before, after = seen["near_duplicates"]
    assert set(after) == {i for i, (_, _, kept) in brute.near_duplicates(list(before.items()), 5).items() if kept}
    before, after = seen["substrings"]
    want = brute.repeated_words(list(before.items()))
    assert set(after) == set(before) and all((after[i] == before[i]) == (not gone) for i, (_, gone, _) in want.items())
    assert set(seen["personal_data"][0]) == set(seen["personal_data"][1])
    assert {r.doc_id for r in corpus_pipeline.run(spark, data).collect()} == set(after)
