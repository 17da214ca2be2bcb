import corpus_pipeline
from tests.llm.test_tokens import expected
from waymark.llm import mixing, queries, simhash
from waymark.llm.decontaminate import hits


def test_stages_one_by_one(spark, sf_dir, docs, texts):
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        last, now = now, stage(spark, now, sf_dir).persist()
        seen[name] = (last, now)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert len(ids(seen["language ID"][1])) >= 0.98 * len(texts)
    before, after = seen["SimHash near-dedup"]
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(before, **simhash.STAGE).collect()}
    assert ids(after) == {d for d, c in groups.items() if d == c}
    assert len({texts[d] for d in ids(after)}) == len({texts[d] for d in ids(before)} & {texts[d] for d in ids(after)}) == after.count()
    before, after = seen["benchmark decontamination"]
    dirty = ids(hits(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    assert ids(after) == ids(before) - dirty and dirty
    before, after = seen["mixing sources to target weights"]
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in mixing.mix(before).collect())
    before, after = seen["token-ID output"]
    assert sorted(map(tuple, after.collect()), key=str) == expected([(r.doc_id, r.text) for r in before.collect()])


def test_run_and_names(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_stages_on_nothing(spark, sf_dir, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
