"""Pseudonyms that hold across runs."""

import pytest
from pyspark.sql import functions as F

from cloakwork.plans.corpus import corpus_pseudonyms, extend_dictionary
from cloakwork.plans.masking import detect, explode_spans
from cloakwork.sources.dictionary import committed_versions, read_dictionary, write_version

SHAPE = "doc_id bigint, text string"


def found(spark, rows):
    return detect(spark.createDataFrame(rows, SHAPE)).select("doc_id", "clean_text", "spans")


def texts(df):
    return sorted((str(r.doc_id), r.masked_text) for r in df.select("doc_id", "masked_text").collect())


def test_numbers_stay(spark, tmp_path):
    path = str(tmp_path / "names")
    first = [(1, "a@b.com and c@d.com"), (2, "10.0.0.1, then a@b.com"), (3, None)]
    one = texts(corpus_pseudonyms(found(spark, first), "doc_id", dictionary=path))
    assert one == texts(corpus_pseudonyms(found(spark, first), "doc_id"))
    assert committed_versions(spark, path) == [0]
    # The same again: nothing new, no new version.
    assert texts(corpus_pseudonyms(found(spark, first), "doc_id", dictionary=path)) == one
    assert committed_versions(spark, path) == [0]
    # More documents, also before the old ones: old values keep their numbers, new ones follow.
    more = [(0, "x@y.zz, c@d.com, 10.0.0.2"), (9, "u@v.ww x@y.zz 10.0.0.1")]
    two = dict(texts(corpus_pseudonyms(found(spark, first + more), "doc_id", dictionary=path)))
    assert {i: two[i] for i, _ in one} == dict(one)
    assert two["0"] == "[EMAIL_3], [EMAIL_2], [IP_2]" and two["9"] == "[EMAIL_4] [EMAIL_3] [IP_1]"
    assert committed_versions(spark, path) == [0, 1]
    assert read_dictionary(spark, path, 0).count() == 3 and read_dictionary(spark, path).count() == 6
    numbers = read_dictionary(spark, path).groupBy("type", "n").count()
    assert numbers.where("count > 1").count() == 0


def test_a_version_that_broke_off_is_not_read(spark, tmp_path):
    path = tmp_path / "names"
    spans = explode_spans(found(spark, [(1, "a@b.com")]), "doc_id")
    extend_dictionary(spans, "doc_id", str(path))
    more = explode_spans(found(spark, [(1, "c@d.com")]), "doc_id")
    extend_dictionary(more, "doc_id", str(path))
    (path / "version=1" / "_SUCCESS").unlink()
    assert committed_versions(spark, str(path)) == [0] and read_dictionary(spark, str(path)).count() == 1
    again = extend_dictionary(more, "doc_id", str(path))
    assert sorted((r.source, r.n) for r in again.collect()) == [("a@b.com", 1), ("c@d.com", 2)]
    with pytest.raises(ValueError, match="there already"):
        write_version(again, str(path), 1)
    assert committed_versions(spark, str(tmp_path / "none")) == [] and read_dictionary(spark, str(tmp_path / "none")).count() == 0


def test_documents_without_an_id(spark, tmp_path):
    rows = [(None, f"mail u{k}@x.org and v{k % 3}@x.org") for k in range(40)] + [(None, "mail u1@x.org and v1@x.org"), (7, "u1@x.org")]
    got = texts(corpus_pseudonyms(found(spark, rows), "doc_id", dictionary=str(tmp_path / "d")))
    assert got == texts(corpus_pseudonyms(found(spark, rows), "doc_id"))
    assert len(got) == 42 and all("@" not in m for _, m in got)
    assert len({m for _, m in got}) == 41  # the repeated text and no other has the names of another


def test_empty(spark, tmp_path):
    df = found(spark, [(1, "nothing"), (2, None)])
    assert texts(corpus_pseudonyms(df, "doc_id", dictionary=str(tmp_path / "d"))) == [("1", "nothing"), ("2", None)]
    assert corpus_pseudonyms(df.where(F.lit(False)), "doc_id", dictionary=str(tmp_path / "d")).count() == 0
