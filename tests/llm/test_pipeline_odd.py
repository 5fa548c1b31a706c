"""The pipeline's stages on odd tables: nulls, repeated rows, no rows, clashing names."""

import corpus_pipeline as c
import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, lang_score double, ids string, n_tokens string, row_ long, keep_ long, copies_ long"
MORE = ("p", 0.5, "i", "t", 1, 2, 3)
LONG = " ".join(f"wort{k}" for k in range(9000))
ROWS = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "das ist ein text mit worten", "de", None, 5), (2, "das ist ein text mit worten", "de", None, 5), (None, "das ist ein text mit worten", None, "a", 5), (3, "12 34", "en", "b", 5), (4, LONG, "de", "b", 9), (5, LONG + " mehr", "de", "a", 9), (6, "the text and the words of it", "en", "a", 3)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *MORE) for r in ROWS], DDL)


def test_stages_on_odd_rows(spark, odd):
    kept = {}
    docs = odd
    for name, stage in c.STAGES:
        out = stage(spark, docs, "")
        if name != "encode":
            assert out.columns == docs.columns
            assert {tuple(r)[5:] for r in out.collect()} <= {MORE}
        kept[name] = sorted((r.doc_id is None, r.doc_id, r.text) for r in out.collect())
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert [r[1] for r in kept["language"]] == [2, 2, 4, 5, 6, None]
    assert [r[1] for r in kept["exact_dedup"]] == [2, 4, 5, 6]
    assert [r[1] for r in kept["near_dedup"]] == [2, 4, 6]
    assert set(kept["encode"]) <= set(kept["near_dedup"]) and "_ids" in docs.columns and "_n_tokens" in docs.columns


def test_stages_on_an_empty_table(spark, odd):
    none = odd.limit(0)
    for _, stage in c.STAGES:
        assert stage(spark, none, "").count() == 0
