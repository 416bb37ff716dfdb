"""Pair tables read once, restore without a shuffle, profiles that add up."""

import json

import pytest
from pyspark.sql import functions as F

from cloakwork.operators import pairs as P
from cloakwork.plans.masking import explode_spans, mapping, mask
from cloakwork.plans.profile import merged_profile, pii_profile, profile_sketches
from cloakwork.plans.roundtrip import restored
from cloakwork.sources import rule_pairs
from cloakwork.sources.documents import DOC_KEY, read_restorable, write_restorable

ID = ["doc_id"]
OTHERS = "doc_id bigint, ord bigint"


@pytest.fixture(scope="module")
def masked(spark):
    rows = [(k if k % 5 else None, f"mail u{k % 7}@x.org or v{k}@x.org, host 10.0.0.{k % 9}, card 4111 1111 1111 {1000 + k}") for k in range(60)] + [(900, None)]
    return mask(spark.createDataFrame(rows, "doc_id bigint, text string").where("doc_id IS NOT NULL OR text LIKE '%v5@%'")).cache()


def test_pairs_are_parsed_once(spark, masked, tmp_path):
    long = P.collect_pairs(explode_spans(masked, *ID), ID)
    rule_pairs.write_pairs(long.repartition(3), f"{tmp_path}/p", "now")
    twice = rule_pairs.read_pairs(spark, f"{tmp_path}/p", OTHERS)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("once", "")
    once = rule_pairs.read_pairs(spark, f"{tmp_path}/p", OTHERS, into=f"{tmp_path}/in")
    jobs = [j for j in tracker.getJobIdsForGroup("once")]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    tasks = sum(tracker.getStageInfo(s).numTasks for j in jobs for s in tracker.getJobInfo(j).stageIds)
    assert tasks <= 2 + len(list((tmp_path / "p" / "rules").glob("part-*")))  # the body once, the head once


@pytest.mark.parametrize("change", ["bad pair", "lost row", "version", "no head"])
def test_refused_pairs_leave_nothing(spark, masked, tmp_path, change):
    long = P.collect_pairs(explode_spans(masked, *ID), ID)
    rule_pairs.write_pairs(long.coalesce(1), f"{tmp_path}/p", "now")
    body = next((tmp_path / "p" / "rules").glob("part-*.json")).read_text()
    head = json.loads(next((tmp_path / "p" / "head").glob("part-*.json")).read_text())
    if change == "bad pair":
        body = body.replace('"source":"10.0.0.1"', '"source":"  "', 1)
    elif change == "lost row":
        body = body.split("\n", 1)[1]
    elif change == "version":
        head["schemaVersion"] = "3.0"
    odd = tmp_path / "odd"
    (odd / "rules").mkdir(parents=True)
    (odd / "head").mkdir()
    (odd / "rules" / "a.json").write_text(body)
    if change != "no head":
        (odd / "head" / "a.json").write_text(json.dumps(head))
    for into in (None, f"{tmp_path}/in"):
        with pytest.raises(rule_pairs.InvalidRulesFile):
            rule_pairs.read_pairs(spark, str(odd), OTHERS, into=into)
    assert not (tmp_path / "in").exists()


@pytest.mark.parametrize("by", ["tags", "positions"])
def test_restore_without_a_shuffle(spark, masked, tmp_path, by):
    names = (f"masked_{by}", f"vault_{by}")
    write_restorable(masked.drop("spans", "text", "clean_text"), mapping(masked, *ID), ID, names, 4, (f"{tmp_path}/m", f"{tmp_path}/v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = restored(*(lambda m, v: (m, [DOC_KEY], v))(*read_restorable(spark, names)), by=by, null_ids=False).select("doc_id", "restored_text")
        got = sorted(map(str, out.collect()))
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in names:
            spark.sql(f"DROP TABLE {name}")
    assert got == sorted(map(str, masked.select("doc_id", F.col("clean_text").alias("restored_text")).collect()))
    assert "Exchange" not in plan and "SelectedBucketsCount: 4 out of 4" in plan


def test_profiles_add_up(spark):
    spans = spark.range(60_000).selectExpr(
        "id % 4 AS run", "CASE WHEN id % 3 = 0 THEN 'EMAIL' ELSE 'IP' END AS type", "CASE WHEN id % 2 = 0 THEN 'EU' END AS region", "'r' AS rule_id",
        "concat('v', id % 20011) AS source", "CASE WHEN id % 5 = 0 THEN 0.9 ELSE 0.85D END AS confidence")
    by = ["type", "region", "rule_id"]
    exact = {tuple(r[c] for c in by): r for r in pii_profile(spans, by).collect()}
    parts = [profile_sketches(spans.where(F.col("run") == k), by) for k in range(4)]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    merged = {tuple(r[c] for c in by): r for r in merged_profile(union, by).collect()}
    assert set(merged) == set(exact) and len(exact) == 4
    for key, row in merged.items():
        assert (row.detections, row.mean_confidence) == (exact[key].detections, exact[key].mean_confidence)
        assert abs(row.distinct_values / exact[key].distinct_values - 1) < 0.04  # five deviations of the sketch
    assert merged_profile(union.limit(0), by).count() == 0
