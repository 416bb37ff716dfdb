"""Restoring by position, and streams that write their mapping."""

import shutil

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloakwork.operators.pairs import restore_positions
from cloakwork.operators.review import apply_switches
from cloakwork.plans.masking import explode_spans, mapping, mask
from cloakwork.plans.roundtrip import restored, roundtrip_audit
from cloakwork.streaming import masking_stream as ms

ID = ["doc_id"]
TEXTS = [
    "keep [EMAIL_1] and [IP_2] but x@y.zz, x@y.zz and 10.0.0.1", "10.1.1.1 " + " ".join(f"10.0.{i // 250}.{i % 250}" for i in range(300)),
    "born 01.02.1990 or 03-04-1991, 😀 a@b.com", "", None, "nothing", "x@y.zz", "+1 555 123 4567x@y.zz4111 1111 1111 1111",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")


@pytest.mark.parametrize("mode", ["tag", "synthetic"])
def test_positions_bring_every_text_back(docs, mode):
    masked = mask(docs, mode=mode)
    got = {r.doc_id: r.restored_text for r in restored(masked, ID, by="positions").collect()}
    assert got == dict(enumerate(TEXTS))
    row = roundtrip_audit(masked, ID, by="positions").first()
    assert (row.documents, row.equal, row.different) == (len(TEXTS), len(TEXTS), 0)


def test_tags_cannot_tell_old_from_new(docs):
    assert roundtrip_audit(mask(docs), ID).first().different == 1
    with pytest.raises(ValueError):
        restored(mask(docs), ID, by="luck")


def test_switched_off_spans_stay(docs):
    masked = mask(docs, mode="synthetic")
    off = explode_spans(masked, *ID).where("type = 'EMAIL'").select("doc_id", "entity_id")
    shown = apply_switches(masked, off, ID)
    records = mapping(masked, *ID).join(off.withColumn("off", F.lit(True)), [*ID, "entity_id"], "left")
    records = records.withColumn("enabled", F.col("off").isNull()).drop("off")
    back = restore_positions(shown.drop("spans"), records, ID)
    assert {r.doc_id: r.restored_text for r in back.collect()} == dict(enumerate(TEXTS))


def test_wrong_texts_and_repeated_ids_fail(spark, docs):
    masked = mask(docs)
    records = mapping(masked, *ID)
    moved = masked.withColumn("masked_text", F.concat(F.lit("x"), "masked_text"))
    with pytest.raises(Exception, match="does not have the replacement"):
        restore_positions(moved, records, ID).collect()
    same = mask(spark.createDataFrame([(1, "mail a@b.com"), (1, "all of a@b.com now")], "doc_id bigint, text string"))
    with pytest.raises(Exception, match="overlap|does not have"):
        restore_positions(same, mapping(same, *ID), ID).collect()


def test_null_ids_equal_texts_and_empty_tables(spark):
    rows = [(None, "a@b.com or c@d.com"), (None, "a@b.com or c@d.com"), (2, "a@b.com")]
    masked = mask(spark.createDataFrame(rows, "doc_id bigint, text string"), mode="synthetic")
    assert sorted((r.doc_id or 0, r.restored_text) for r in restored(masked, ID, by="positions").collect()) == sorted((i or 0, t) for i, t in rows)
    assert restored(masked.limit(0), ID, by="positions").collect() == []


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="a1.@ []_EMAIL😀é:-+0\n", max_size=60), min_size=1, max_size=30), st.sampled_from(["tag", "synthetic"]))
def test_any_text_comes_back(spark, texts, mode):
    mixed = [t + " u@v.ww 10.0.0.7 " + t for t in texts]
    masked = mask(spark.createDataFrame(list(enumerate(mixed)), "doc_id bigint, text string"), mode=mode)
    back = restored(masked, ID, by="positions").where("NOT (restored_text <=> clean_text)")
    assert back.collect() == []


def _start(spark, folder):
    stream = ms.read_document_stream(spark, f"{folder}/in", "doc_id bigint, text string", max_files=1)
    query = ms.write_stream_with_mapping(ms.mask_stream(stream, mode="synthetic"), ID, f"{folder}/masked", f"{folder}/vault", f"{folder}/log")
    assert query.awaitTermination(180)


def _out(spark, folder):
    return ms.read_published(spark, f"{folder}/masked"), ms.read_published(spark, f"{folder}/vault")


def test_stream_and_its_mapping(spark, docs, tmp_path):
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    _start(spark, tmp_path)
    masked, records = _out(spark, tmp_path)
    assert "spans" not in masked.columns and "text" not in masked.columns
    want = mask(docs, mode="synthetic")
    assert sorted(map(str, records.collect())) == sorted(map(str, mapping(want, *ID).collect()))
    assert {r.doc_id: r.restored_text for r in restore_positions(masked, records, ID).collect()} == dict(enumerate(TEXTS))
    # More files: only they are added.
    docs.where("doc_id = 0").withColumn("doc_id", F.lit(100).cast("bigint")).write.mode("append").parquet(f"{tmp_path}/in")
    _start(spark, tmp_path)
    masked, records = _out(spark, tmp_path)
    assert masked.count() == len(TEXTS) + 1 and records.where("doc_id = 100").count() == 3


def test_a_batch_that_comes_again_adds_nothing(spark, docs, tmp_path):
    docs.coalesce(1).write.parquet(f"{tmp_path}/in")
    _start(spark, tmp_path)
    before = [sorted(map(str, df.collect())) for df in _out(spark, tmp_path)]
    # The log loses the commit, as if the driver had died after writing: Spark runs the batch again.
    commits = sorted((tmp_path / "log/commits").glob("[0-9]*"))
    for path in commits:
        path.unlink()
    for path in (tmp_path / "log/commits").glob(".*.crc"):
        path.unlink()
    _start(spark, tmp_path)
    assert [sorted(map(str, df.collect())) for df in _out(spark, tmp_path)] == before
    # A sink that broke off is written anew, the other is left alone.
    (tmp_path / "masked/batch=0/_SUCCESS").unlink()
    stamp = (tmp_path / "vault/batch=0/_SUCCESS").stat().st_mtime_ns
    ms.publish_batch(ms.mask_stream(docs, mode="synthetic"), 0, ID, f"{tmp_path}/masked", f"{tmp_path}/vault")
    assert [sorted(map(str, df.collect())) for df in _out(spark, tmp_path)] == before
    assert (tmp_path / "vault/batch=0/_SUCCESS").stat().st_mtime_ns == stamp
    shutil.copytree(tmp_path / "masked", tmp_path / "copy")  # nothing but finished batches is in the folder
    assert {p.name for p in (tmp_path / "copy").iterdir()} == {"batch=0"}


def test_paths_must_be_apart(spark, docs, tmp_path):
    with pytest.raises(ValueError):
        ms.write_stream_with_mapping(docs, ID, f"{tmp_path}/a", f"{tmp_path}/a/vault", f"{tmp_path}/log")
