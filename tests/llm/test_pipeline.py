"""The corpus pipeline, stage by stage against the operators' brute-force versions."""

import collections

import corpus_pipeline as C
from tests.llm.test_operators import base_spans, counts, groups, library, prints


def test_stages(spark, sf, rows, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, columns = [], docs.columns
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        kept.append(docs)
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(C.STAGES) - 1:
            assert docs.columns == columns
    _, good, single, masked, mixed = kept
    want = collections.Counter((d, t) for d, t, *_ in rows if not ((n := counts(t))[0] < 50 or 100 * n[4] > 50 * n[0]) and "***" not in t)
    assert collections.Counter((r["doc_id"], r["text"]) for r in good.collect()) == want
    fps = [(d, prints(t)) for d, t in want.elements()]
    assert single.count() == len(set(groups(fps).values()))
    for r in masked.collect():
        assert not base_spans(r["text"])
    assert masked.count() == single.count() and set(r["doc_id"] for r in mixed.collect()) == set(r["doc_id"] for r in masked.collect())
    assert collections.Counter(r["doc_id"] for r in docs.collect()) == collections.Counter(r["doc_id"] for r in mixed.collect())
    lib = library()
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in docs.collect()) == collections.Counter((r["doc_id"], tuple(lib(r["text"]))) for r in mixed.collect())
    assert C.run(spark, sf).count() == docs.count()


def test_empty_and_null_texts(spark, empty, tmp_path):
    assert C.run(spark, empty).count() == 0
    spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", None, 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
