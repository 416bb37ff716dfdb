import json
import random

import pytest

import brute
from cloakwork.operators import pairs as P
from cloakwork.operators import review as W
from cloakwork.operators import user_rules as U
from cloakwork.plans import corpus, profile, roundtrip
from cloakwork.plans.masking import detect, explode_spans, mapping, mask
from cloakwork.sources import documents, rule_pairs
from cloakwork.streaming import masking_stream

ID = ["doc_id"]
PAIRS = "ord int, entity_type string, origin string, source string, replacement string, region string, rule_id string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "mail a@b.com, c@d.com and a@b.com; ask Ann or Anna"),
        (2, "Ann called +1 555 123 4567 from 10.1.2.3 about a@b.com"),
        (3, "nothing here"),
        (4, "keep [EMAIL_1] but x@y.zz"),
        (5, None),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.fixture(scope="module")
def masked(docs):
    return mask(docs)


def test_null_text(masked):
    row = masked.where("doc_id = 5").first()
    assert row.masked_text is None and not row.spans


def test_mapping_and_roundtrip(spark, masked, tmp_path):
    records = mapping(masked, *ID)
    assert records.count() == 3 + 3 + 1
    first = records.where("doc_id = 1").orderBy("position.start").first()
    assert (first.entity_id, first.replacement, first.position.start, first.enabled) == ("EMAIL_5_12", "[EMAIL_1]", 5, True)
    audit = roundtrip.roundtrip_audit(masked, ID).first()
    # Document 4 held a literal tag before masking.
    assert (audit.documents, audit.equal, audit.different) == (5, 4, 1)
    documents.write_masked(masked.select("doc_id", "masked_text"), f"{tmp_path}/out", records, f"{tmp_path}/map")
    back = P.restore_tags(spark.read.parquet(f"{tmp_path}/out"), spark.read.parquet(f"{tmp_path}/map"), ID)
    assert back.where("doc_id = 2").first().restored_text == "Ann called +1 555 123 4567 from 10.1.2.3 about a@b.com"
    with pytest.raises(ValueError):
        documents.write_masked(masked, f"{tmp_path}/o2", records, f"{tmp_path}/o2/map")


def test_user_rules(spark, masked):
    rules = spark.createDataFrame(
        [("Ann", "PERSON", 0), ("Anna", "USER", 1), ("a@b.com", "ORG", 2), ("Ann", "PERSON", 3), ("absent", "USER", 4)],
        "source string, type string, ord int",
    )
    small = {r.doc_id: r for r in U.with_user_rules(masked, rules, ID).collect()}
    large = {r.doc_id: r for r in U.with_user_rules(masked, rules, ID, strategy="constant").collect()}
    assert small[1].masked_text == "mail [ORG_1], [EMAIL_2] and [ORG_1]; ask [PERSON_1] or [USER_1]"
    assert small[2].masked_text == "[PERSON_1] called [PHONE_1] from [IP_1] about [ORG_1]"
    assert small[1].spans[0].entity_id == "MANUAL_ORG_5_12"
    for k in small:
        assert small[k].masked_text == large[k].masked_text
        assert small[k].spans == large[k].spans


def test_rule_tables(spark):
    sel = spark.createDataFrame([("Ann \r\n", None), ("  ", None), ("Ann", "USER"), ("X", "ORG")], "source string, type string")
    rules = U.rules_from_selections(sel)
    assert {tuple(r) for r in rules.collect()} == {("Ann", "USER"), ("X", "ORG")}
    changes = spark.createDataFrame([("Ann", "USER", "PERSON")], "source string, type string, new_type string")
    assert {tuple(r) for r in U.retype_rules(rules, changes).collect()} == {("Ann", "PERSON"), ("X", "ORG")}
    gone = spark.createDataFrame([("X", "ORG")], "source string, type string")
    assert {tuple(r) for r in U.remove_rules(rules, gone).collect()} == {("Ann", "USER")}


def test_review_and_switches(spark, masked):
    rules = spark.createDataFrame([("Ann", "PERSON")], "source string, type string")
    merged = U.with_user_rules(masked, rules, ID)
    spans = explode_spans(merged, *ID)
    off = spark.createDataFrame([(1, "EMAIL_5_12"), (1, "EMAIL_26_33")], "doc_id bigint, entity_id string")
    groups = {(r.doc_id, r.type, r.source): r for r in W.review_groups(spans, ID, off).collect()}
    g = groups[(1, "EMAIL", "a@b.com")]
    assert (g.members, g.first_start, g.heading, g.all_disabled) == (2, 5, "Global", True)
    assert not groups[(1, "EMAIL", "c@d.com")].all_disabled
    assert {(r.type, r.source): r.n for r in W.frequencies(spans).collect()}[("EMAIL", "a@b.com")] == 3
    assert {r.type for r in W.present_types(spans).collect()} == {"EMAIL", "PHONE", "IP", "PERSON"}
    assert W.present_regions(spans).count() == 0
    assert W.filter_spans(spans, "EMAIL", "").count() == 5
    assert W.filter_spans(spans, region="RU").count() == 0
    assert W.total_detections(spans).first().detections == spans.count()

    ask = spark.createDataFrame([(1, "EMAIL_5_12"), (2, "EMAIL_47_54")], "doc_id bigint, entity_id string")
    one = {(r.doc_id, r.entity_id) for r in W.toggle_local(off, ask, ID).collect()}
    assert one == {(1, "EMAIL_26_33"), (2, "EMAIL_47_54")}
    every = {(r.doc_id, r.entity_id) for r in W.toggle_everywhere(spans, off, ask, ID).collect()}
    assert every == {(2, "EMAIL_47_54")}
    manual = spark.createDataFrame([(2, "MANUAL_PERSON_0_3")], "doc_id bigint, entity_id string")
    assert [tuple(r) for r in W.removed_by_requests(spans, manual, ID).collect()] == [(2, "Ann", "PERSON")]
    assert {tuple(r) for r in W.toggle_everywhere(spans, off, manual, ID).collect()} == {(1, "EMAIL_5_12"), (1, "EMAIL_26_33")}

    still_off, left = W.switch_everywhere(spans, off, rules, manual, ID)
    assert left.count() == 0 and still_off.count() == 2

    shown = {r.doc_id: r.masked_text for r in W.apply_switches(merged, off, ID).collect()}
    assert shown[1] == "mail a@b.com, [EMAIL_2] and a@b.com; ask [PERSON_1] or [PERSON_1]a"
    assert shown[3] == "nothing here"


def test_pairs_against_brute_force(spark):
    rng = random.Random(3)
    alphabet = "ab [1]😀"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) for _ in range(40)]
    pairs = []
    for _ in range(30):
        a, b = ("".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 9))) for _ in range(2))
        pairs.append((rng.choice(["system", "user"]), a, b))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = [(i, "USER", o, a, b, None, None) for i, (o, a, b) in enumerate(pairs)]
    pdf = spark.createDataFrame(rows, PAIRS)
    for direction in ("forward", "reverse"):
        for strategy in ("join", "constant"):
            for r in P.apply_pairs(df, pdf, ID, direction, strategy=strategy).collect():
                brute.check_pairs(r, pairs, direction)
    # Scoped by document: each document sees its own pairs only.
    scoped = spark.createDataFrame([(i, *rows[j]) for i in range(40) for j in range(i % 5)], "doc_id bigint, " + PAIRS)
    for r in P.apply_pairs(df, scoped, ID).collect():
        brute.check_pairs(r, pairs[: r.doc_id % 5], "forward")


def test_ids_null_repeated_and_partial(spark):
    """Null and repeated ids get the same from both strategies; no value crosses between documents, none gets out."""
    rows = [(None, "mail z@x.com foofoo"), (None, "foo b@x.com"), (7, "mail a@x.com"), (7, "mail c@x.com foo")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    rules = spark.createDataFrame([("foo", "USER")], "source string, type string")
    want = sorted(["mail [EMAIL_1] [USER_1][USER_1]", "[USER_1] [EMAIL_1]", "mail [EMAIL_1]", "mail [EMAIL_1] [USER_1]"])
    for strategy in ("join", "constant"):
        assert sorted(r.masked_text for r in U.with_user_rules(mask(df), rules, ID, strategy=strategy).collect()) == want
    names = {r.text: r.masked_text for r in corpus.corpus_pseudonyms(detect(df), "doc_id").collect()}
    assert not any("@" in t for t in names.values())
    assert len({t.split("[")[1] for t in names.values()}) == 4  # four mails, four names
    masked = mask(df)
    with pytest.raises(Exception, match="two sources"):
        roundtrip.restored(masked, ID).collect()
    one_null = mask(df.where("text like '%z@x.com%' or text like '%a@x.com%'"))
    assert all(r.restored_text == r.clean_text for r in roundtrip.restored(one_null, ID).collect())

    turns = spark.createDataFrame([(1, 1, "ask foo"), (1, 2, "foo"), (2, 1, "foo"), (None, 1, "foo")], "conv bigint, turn bigint, text string")
    pairs = spark.createDataFrame([(1, 0, "USER", "user", "foo", "<x>", None, None)], "conv bigint, " + PAIRS)
    got = {(r.conv, r.turn): (r.masked_text, r.applied, r.skipped) for r in P.apply_pairs(turns, pairs, ["conv", "turn"]).collect()}
    assert got == {(1, 1): ("ask <x>", 1, 0), (1, 2): ("<x>", 1, 0), (2, 1): ("foo", 0, 0), (None, 1): ("foo", 0, 0)}


def test_refusals(spark, docs):
    with pytest.raises(ValueError, match="clean_text"):
        mask(docs.withColumnRenamed("doc_id", "clean_text"))
    odd = spark.createDataFrame([("Y", "NOPE")], "source string, type string")
    with pytest.raises(Exception, match="unknown entity type"):
        U.rules_from_selections(odd).collect()
    with pytest.raises(ValueError, match="strategy"):
        P.apply_pairs(docs, spark.createDataFrame([], PAIRS), ID, strategy="auto")


def test_export_and_import(spark, masked, tmp_path):
    rules = spark.createDataFrame([("Ann", "PERSON")], "source string, type string")
    merged = U.with_user_rules(masked, rules, ID)
    out = rule_pairs.export_envelopes(merged, ID, "2024-01-01T00:00:00.000Z")
    data = {r.doc_id: json.loads(r.rules_json) for r in out.collect()}
    assert data[1]["schemaVersion"] == "2.0" and data[1]["total"] == 3 == len(data[1]["rules"])
    assert data[1]["rules"][0] == {"entityType": "EMAIL", "origin": "system", "source": "a@b.com",
                                   "replacement": "[EMAIL_1]", "ruleId": "universal.email"}
    assert data[1]["rules"][2]["origin"] == "user"
    pairs = rule_pairs.import_envelopes(out, "rules_json", ID)
    long = P.collect_pairs(explode_spans(merged, *ID), ID)
    cols = ["doc_id", *P.PAIR_FIELDS]
    assert sorted(map(str, pairs.select(*cols).collect())) == sorted(map(str, long.select(*cols).collect()))
    assert {tuple(r) for r in P.user_rules_of(pairs).collect()} == {("Ann", "PERSON")}
    again = {r.doc_id: r.masked_text for r in U.with_user_rules(masked, P.user_rules_of(pairs), ID).collect()}
    assert again == {r.doc_id: r.masked_text for r in merged.collect()}
    # Forward on the text gives the mask, reverse gives the text back.
    fwd = P.apply_pairs(merged.select("doc_id", "clean_text"), pairs, ID, text_col="clean_text")
    back = P.apply_pairs(merged.select("doc_id", "masked_text").withColumnRenamed("masked_text", "m"), pairs, ID, "reverse", "m")
    want = {r.doc_id: r for r in merged.collect()}
    assert all(r.masked_text == want[r.doc_id].masked_text for r in fwd.collect())
    assert all(r.masked_text == want[r.doc_id].clean_text for r in back.where("doc_id < 4").collect())
    # What was imported can be reviewed like what was detected.
    assert mapping(fwd, *ID).where("doc_id = 1").orderBy("position.start").first().entity_id == "IMPORTED_1"
    off = explode_spans(fwd, *ID).select("doc_id", "entity_id")
    assert all(r.masked_text == want[r.doc_id].clean_text for r in W.apply_switches(fwd, off, ID).collect())
    swapped = P.collect_pairs(explode_spans(merged, *ID), swap=True)
    assert {"[EMAIL_1]"} <= {r.source for r in swapped.collect()}
    assert P.swap_on_export("imported", "reverse") and not P.swap_on_export("analysis", None)

    rule_pairs.write_pairs(long.coalesce(1), f"{tmp_path}/p", "now")
    again = rule_pairs.read_pairs(spark, f"{tmp_path}/p", "doc_id bigint, ord bigint")
    key = ["doc_id", "ord", *P.PAIR_FIELDS]
    assert sorted(map(str, again.select(*key).collect())) == sorted(map(str, long.select(*key).collect()))
    body = next((tmp_path / "p" / "rules").glob("part-*.json"))
    odd = tmp_path / "odd"
    (odd / "rules").mkdir(parents=True)
    (odd / "rules" / "a.json").write_text(body.read_text().replace('"source":"a@b.com"', '"source":5'))
    (odd / "head").mkdir()
    (odd / "head" / "a.json").write_text(json.dumps({"schemaVersion": "2.0", "generatedAt": "now", "total": len(body.read_text().splitlines())}))
    with pytest.raises(rule_pairs.InvalidRulesFile):
        rule_pairs.read_pairs(spark, str(odd), "doc_id bigint, ord bigint")
    (tmp_path / "one.json").write_text(json.dumps(data[1], indent=2, ensure_ascii=False))
    assert rule_pairs.read_envelopes(spark, f"{tmp_path}/one.json").count() == 3


GOOD = {"entityType": "EMAIL", "origin": "system", "source": "a", "replacement": "b"}


@pytest.mark.parametrize("bad", [
    "not json", "[]", "{}", json.dumps({"schemaVersion": "1.0", "rules": [GOOD]}),
    json.dumps({"schemaVersion": 2.0, "rules": [GOOD]}), json.dumps({"schemaVersion": "2.0", "rules": {}}),
    json.dumps({"schemaVersion": "2.0", "rules": [GOOD, {**GOOD, "source": "  "}]}),
    json.dumps({"schemaVersion": "2.0", "rules": [{**GOOD, "replacement": ""}]}),
    json.dumps({"schemaVersion": "2.0", "rules": [{**GOOD, "origin": "other"}]}),
    json.dumps({"schemaVersion": "2.0", "rules": [{**GOOD, "entityType": "PLANET"}]}),
    json.dumps({"schemaVersion": "2.0", "rules": [{**GOOD, "source": 5}]}),
    json.dumps({"schemaVersion": "2.0", "rules": [None]}), json.dumps({"schemaVersion": "2.0", "rules": ["x"]}),
])
def test_import_refused(spark, bad):
    files = spark.createDataFrame([(json.dumps({"schemaVersion": "2.0", "rules": [GOOD]}),), (bad,)], "j string")
    parsed = [r.valid for r in rule_pairs.parse_envelopes(files, "j").collect()]
    assert parsed == [True, False]


def test_import_lenient_fields(spark):
    odd = json.dumps({"schemaVersion": "2.0", "rules": [{**GOOD, "region": 7, "ruleId": None}], "extra": 1})
    files = spark.createDataFrame([(odd,)], "j string")
    row = rule_pairs.import_envelopes(files, "j").first()
    assert (row.region, row.rule_id, row.source) == (None, None, "a")
    with pytest.raises(Exception, match="invalid-rules-file"):
        rule_pairs.import_envelopes(spark.createDataFrame([("x",)], "j string"), "j").collect()


def test_corpus_pseudonyms(spark, docs, tmp_path):
    got = {r.doc_id: r.masked_text for r in corpus.corpus_pseudonyms(detect(docs), "doc_id", checkpoint_dir=str(tmp_path)).collect()}
    assert got[1] == "mail [EMAIL_1], [EMAIL_2] and [EMAIL_1]; ask Ann or Anna"
    assert got[2] == "Ann called [PHONE_1] from [IP_1] about [EMAIL_1]"
    assert got[4] == "keep [EMAIL_1] but [EMAIL_3]"
    assert got[3] == "nothing here"


def test_rule_list_summary(spark, docs):
    pairs = spark.createDataFrame([(0, "PERSON", "user", "Ann", "[PERSON_9]", None, None)], PAIRS)
    row = corpus.rule_list_summary(corpus.apply_rule_list(docs.where("text is not null"), pairs, ID)).first()
    assert (row.documents, row.applied, row.documents_changed) == (4, 3, 2)


def test_profile(masked):
    spans = explode_spans(masked, *ID)
    rows = {r.type: r for r in profile.pii_profile(spans, ["type"]).collect()}
    assert (rows["EMAIL"].detections, rows["EMAIL"].distinct_values, rows["EMAIL"].mean_confidence) == (5, 3, 0.9)
    assert profile.pii_rollup(spans, "type", "rule_id").where("type is null").first().detections == 7
    assert profile.documents_with_pii(masked).first().with_pii == 3


def test_stream_equals_batch(spark, sf, tmp_path):
    source = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    source.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = masking_stream.read_document_stream(spark, f"{tmp_path}/in", "doc_id bigint, text string", max_files=1)
    q = masking_stream.write_masked_stream(masking_stream.mask_stream(stream), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    got = {r.doc_id: r.masked_text for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {r.doc_id: r.masked_text for r in mask(source).select("doc_id", "masked_text").collect()}
    assert got == want


def test_text_source(spark, tmp_path):
    (tmp_path / "a.txt").write_text("mail a@b.com\nline 2")
    row = mask(documents.read_documents(spark, str(tmp_path), "text")).first()
    assert row.masked_text == "mail [EMAIL_1]\nline 2" and row.doc_id.endswith("a.txt")


def test_no_shuffle_in_masking(spark, sf):
    plan = mask(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_spread(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert documents.spread(df).rdd.getNumPartitions() > 1
