"""The pipeline's stages on small tables with known answers."""

import corpus_pipeline as c


def test_stages_keep_columns_and_act(spark, tmp_path):
    r = __import__("random").Random(2)
    words = lambda n: " ".join(r.choice("der die und nicht ist ein the and of was for is".split()) + r.choice(["", "er", "ing", "ung"]) for _ in range(n))
    texts = [words(120) for _ in range(40)]
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    rows += [(100, texts[0].upper(), "de", "s0", 1), (101, None, "en", "s0", 0), (102, "12 34 !!", "en", "s1", 8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = c.identify_language(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == set(range(40)) | {100}
    exact = c.exact_dedup(spark, kept, str(tmp_path))
    assert {x.doc_id for x in exact.collect()} == set(range(1, 40)) | {100}
    assert exact.columns == docs.columns
    out = c.run(spark, str(tmp_path))
    assert set(out.columns) == {*docs.columns, "ids", "n_tokens"} and 0 < out.count()
    assert {x.doc_id for x in out.collect()} <= set(range(1, 40)) | {100}


def test_documents_without_any_language_label_stay(spark, tmp_path):
    rows = [(1, "some words here", None, "s", 15), (2, "12 34 !!", None, "s", 8), (3, None, None, "s", 0), (4, "слово", None, "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(tuple(x) for x in c.identify_language(spark, docs, str(tmp_path)).collect()) == [rows[0], rows[3]]
