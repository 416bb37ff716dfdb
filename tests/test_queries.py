"""A cross-section of the registered queries against their SQL counterparts (all: check_oracle.py)."""

import datetime
import sys
from pathlib import Path

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import TABLES, rows_of  # noqa: E402
from workload import inputs  # noqa: E402

SAMPLE = (
    "detect_documents", "mask_forms_tag", "mask_forms_synthetic", "validators", "replacement_templates", "gap_fill",
    "resolve_overlaps_table", "user_rules_spans", "switch_everywhere", "export_pairs", "apply_list_forward", "corpus_pseudonyms",
)


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("folder", [False, True])
def test_documents_in_one_file_or_several(spark, tmp_path, folder):
    rows = spark.createDataFrame([(i, f"mail a{i}@example.com") for i in range(8)], "doc_id bigint, text string")
    if folder:
        rows.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    else:
        pq.write_table(rows.toArrow(), f"{tmp_path}/documents.parquet")
    names = ("stream_mask", "stream_mapping", "stream_restore")
    assert [entry.queries()[n](spark, str(tmp_path)).count() for n in names] == [8, 8, 8]


def test_texts_of_orders_are_dealt_out(spark, tmp_path, monkeypatch):
    """One row group, null and repeated keys: no task gets all the texts."""
    monkeypatch.setattr(inputs, "ROWS_A_TASK", 100)
    day = datetime.date(2024, 1, 2)
    rows = [(i if i % 3 else None, i % 7, day) for i in range(1000)]
    orders = spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderdate date")
    pq.write_table(orders.toArrow(), f"{tmp_path}/orders.parquet")
    for made in (inputs.forms, inputs.notes, inputs.mail_notes, inputs.register):
        tasks = made(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) == 10 and max(t["count"] for t in tasks) <= 200
        assert sum(t["count"] for t in tasks) == 1000


def test_every_query_has_sql():
    assert set(entry.QUERIES) == set(entry.ORACLE)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, con, sf, name):
    df = entry.queries()[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(names, cur.fetchall())


@pytest.mark.parametrize("name", ["masked_with_null_ids", "present_types_and_regions", "switch_everywhere", "switch_local",
                                  "roundtrip_audit_tags", "roundtrip_audit_positions", "restore_forms_synthetic"])
def test_detection_runs_once(spark, sf, name):
    """Where several steps read a masking result, it is kept: nothing reads the texts again."""
    read = entry.queries()[name](spark, sf).inputFiles()
    assert read and not any("orders.parquet" in f or "documents.parquet" in f for f in read)
