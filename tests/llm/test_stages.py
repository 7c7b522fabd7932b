"""Pipeline stages on nulls, empty tables, repeated rows and further columns whose names clash with theirs."""

import pytest

import corpus_pipeline

CLASHES = "spans string, sanitised int, kept string, host string, n_words int, base string, row_key long, all_spans string, gone_id long, key int, n_bytes string"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    columns = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHES
    extra = ("a", 1, "b", "c", 2, "d", 3, "e", 4, 5, "f")
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, *extra) for r in real]
    words = " ".join(f"word{i}" for i in range(60)) + " mail me@home.org"
    rows += [(None, words, None, None, None, *[None] * 11), (90001, None, "en", "src0", 0, *extra), (90002, "", "en", None, None, *extra)]
    rows += [(90003, words + " more", "en", "src1", 1, *extra)] * 2
    return spark.createDataFrame(rows, columns)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, sf_dir, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, sf_dir)
    if name == "packing":
        assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    else:
        assert out.dtypes == docs.dtypes
        held = {r.doc_id: r for r in out.collect()}
        assert all((r.spans, r.sanitised, r.kept, r.key) == ("a", 1, "b", 5) for i, r in held.items() if i is not None)
    assert stage(spark, docs.limit(0), sf_dir).count() == 0
