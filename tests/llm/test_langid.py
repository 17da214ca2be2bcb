import zlib

from waymark.llm import langid


def test_query_accuracy(spark, docs):
    rows = {r.doc_id: r for r in langid.op8_language_id(spark, "/root/testdata/sf0.01").collect()}
    known = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    assert all(rows[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d in known)
    held = [d for d in known if rows[d].held_out]
    assert sum(rows[d].lang_pred == known[d] for d in held) / len(held) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_odd_rows(odd, none, docs):
    model = langid.train(docs)
    out = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, model).collect() if r.doc_id}
    assert [out[k] for k in (2, 3, 5, 8)] == [("und", 0.0)] * 4 and out[6][0] == "en"
    assert langid.predict(none, model).count() == 0
    empty = langid.train(none)
    assert {r.lang_pred for r in langid.predict(odd, empty).collect()} == {"und"}
    assert langid.keep_known(none).count() == 0 and langid.keep_known(odd).columns == odd.columns


def test_weights_are_sparse_and_calibrated(docs):
    model = langid.train(docs)
    assert 0 < (model.weights != 0).mean() < 0.5 and 0.05 <= model.temperature <= 5


def test_ngrams():
    assert len(langid.ngram_counts("12 --")[0]) == 0
    a, b = langid.ngram_counts("Ab, cd"), langid.ngram_counts("aB...CD")
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()
