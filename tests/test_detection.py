import re

import pytest
from pyspark.sql import functions as F

from cloakwork.catalogue import ALL_RULES, REGIONS, Rule, active_rules, register_rule
from cloakwork.functions import text as X
from cloakwork.operators.candidates import _pieces
from cloakwork.plans.masking import detect, explode_spans, find_candidates, mask

from texts import CASES


@pytest.fixture(scope="module")
def masked(spark):
    rows = [(k, t) for k, (t, _) in CASES.items()]
    df = mask(spark.createDataFrame(rows, "doc_id string, text string"))
    return {r.doc_id: r for r in df.collect()}


@pytest.mark.parametrize("case", list(CASES))
def test_spans(masked, case):
    got = [(s.start, s.end, s.type) for s in masked[case].spans]
    assert got == CASES[case][1]


def test_source_is_the_slice(masked):
    for row in masked.values():
        at = 0
        for s in row.spans:
            assert row.clean_text[s.start : s.end] == s.source
            assert at <= s.start
            at = s.end


def test_masked_text(masked):
    assert masked["mail_and_card"].masked_text == "Kontakt [EMAIL_1] Karte [CARD_1]"
    assert masked["same_value_twice"].masked_text == "von [EMAIL_1] und noch einmal [EMAIL_1]"
    assert masked["three_dates"].masked_text == "seen [DATE_1]\nin: [DATE_2]; out: [DATE_3];"
    assert masked["ru_signature"].masked_text == CASES["ru_signature"][0]
    assert masked["nbsp_crlf"].masked_text == "tel [PHONE_1]\nfine"


def test_span_fields(masked):
    s = masked["form"].spans[4]
    assert (s.entity_id, s.rule_id, s.region, s.detector_source) == (
        f"DOC_ID_{s.start}_{s.end}", "am.passport.alpha_numeric", "AM", "regional",
    )
    assert s.confidence == pytest.approx(0.90)
    assert masked["mail_and_card"].spans[0].confidence == pytest.approx(0.90)
    assert masked["mail_and_card"].spans[0].region is None


def test_synthetic(spark):
    df = spark.createDataFrame([("a", "born 27.12.2013, 2013-12-27 a@b.com 1.2.3.4; 4111 1111 1111 1111")], "doc_id string, text string")
    row = mask(df, mode="synthetic").first()
    assert row.masked_text == "born 01.01.1990, 1991-01-02 user1@example.test 10.0.0.1; 4111 **** **** 1001"


def test_regions(spark):
    df = spark.createDataFrame([("AB1234567 passport",), ], "text string")
    only_ru = detect(df, regions=["RU"]).first().spans
    assert list(only_ru) == []
    assert detect(df, regions=["AM"]).first().spans[0].region == "AM"
    with pytest.raises(ValueError):
        detect(df, regions=[])


def test_extended_profile(spark):
    rows = [(k, CASES[k][0]) for k in ("ru_passport", "ips", "ru_street_after_space", "ru_postcode")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: [(s.start, s.end, s.type, s.region) for s in r.spans] for r in detect(df, profile="extended").collect()}
    assert got["ru_passport"] == [(9, 21, "DOC_ID", "RU")]
    assert len(got["ips"]) == 3
    assert [g[2:] for g in got["ru_street_after_space"]] == [("ADDRESS", None)]
    assert [g[2:] for g in got["ru_postcode"]] == [("ADDRESS", None)]


def test_catalogue():
    assert len(ALL_RULES) == 31
    assert sum(r.region is None for r in ALL_RULES) == 22
    assert len(active_rules(["RU"])) == 25
    assert len({r.rule_id for r in ALL_RULES}) == 31


def test_registered_rule(spark):
    ticket = Rule(
        "custom.ticket", "DOC_ID", r"(?<!\w)TKT-\d+(?!\w)", 99, "format",
        validator=lambda v: F.length(v) >= 6, context=lambda w: F.contains(F.lower(w), F.lit("ticket")),
    )
    rules = register_rule(active_rules(REGIONS), ticket)
    df = spark.createDataFrame([("ticket TKT-123456, TKT-1",), ("see TKT-123456",)], "text string")
    got = [[(s.rule_id, s.source) for s in r.spans] for r in detect(df, rules=rules).collect()]
    assert got == [[("custom.ticket", "TKT-123456")], []]
    with pytest.raises(ValueError):
        register_rule(rules, ticket)


def test_rule_text_with_both_quotes(spark):
    quoted = Rule("custom.quoted", "USER", "[\"'][a-z]+[\"']", 99, "format")
    df = spark.createDataFrame([("say \"hey\" or 'ho'",)], "text string")
    assert [s.source for s in detect(df, rules=register_rule([], quoted)).first().spans] == ['"hey"', "'ho'"]


def test_long_runs_stay_linear(spark):
    """Texts that would make naive patterns quadratic or overflow the stack."""
    words = " ".join(["Wort"] * 30000)
    texts = [
        ("de", words + " Weg 5"),
        ("de_fail", words + "; " + words + " Weg x 1 Weg"),
        ("mail", "a-" * 40000 + " x@y.zz"),
        ("dash", "имя " + "-" * 60000 + " 1"),
    ]
    df = spark.createDataFrame(texts, "doc_id string, text string")
    got = {r.doc_id: [(s.start, s.end, s.type) for s in r.spans] for r in detect(df).collect()}
    assert got["de"] == [(0, len(texts[0][1]), "ADDRESS")]
    assert got["de_fail"] == []
    assert got["mail"] == [(80001, 80007, "EMAIL")]
    assert got["dash"] == []


def test_dense_document(spark):
    text = " ".join(f"u{i % 3000}@x{i % 3000}.com" for i in range(6000))
    df = spark.createDataFrame([("d", text)], "doc_id string, text string")
    spans = explode_spans(mask(df), "doc_id").orderBy("start").collect()
    assert len(spans) == 6000
    assert [s.replacement for s in spans] == [f"[EMAIL_{i % 3000 + 1}]" for i in range(6000)]
    assert all(text[s.start : s.end] == s.source for s in spans)


def test_one_pass_of_a_pattern(spark):
    """The texts come cut around their matches, also those that hold the character the cuts are made with."""
    texts = ["", "none", "12", "a12", "12b", "a12b345c6", "12\uFDD034", "\uFDD0", "\uFDD01\uFDD02"]
    sql = _pieces("text", r"\d+")
    assert sql.split("ELSE")[1].count(r"\d+") == 1
    cut = F.expr(sql)
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", cut.alias("p"), X.piece_positions(F.col("p")).alias("at")).collect()
    for r in got:
        assert r.p == re.split(r"(\d+)", r.text)
        assert [tuple(a) for a in r["at"]] == [(m.start(), m.end(), m.group()) for m in re.finditer(r"\d+", r.text)]
    assert len(got) == len(texts)


@pytest.mark.parametrize("n", [0, 1, 2, 15, 16, 17, 40])
def test_places_of_few_and_many(spark, n):
    text = "é".join(f"𝄞{i}" for i in range(n)) + "ж"
    cut = F.expr(_pieces("text", r"\d+"))
    at = spark.createDataFrame([(text,)], "text string").select(X.piece_positions(cut).alias("at")).first()["at"]
    assert [tuple(a) for a in at] == [(m.start(), m.end(), m.group()) for m in re.finditer(r"\d+", text)]


def test_gates_hold_for_every_match(spark):
    """An account of 20 digits, a Russian house and a town are found in texts with nothing else."""
    texts = ["12345678901234567890", "индекс 123456 г. Москва2", "2ул. Ленина, д. 5", "2ул. LENINA, \u1C81. 5"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {(r.doc_id, r.rule_id) for r in explode_spans(find_candidates(rows), "doc_id", spans_col="candidates").collect()}
    assert {(0, "universal.account20"), (1, "universal.address.ru.postcode_city"), (2, "universal.address.ru.street_house"),
            (3, "universal.address.ru.street_house")} <= got


def test_one_step_from_matches_to_spans(spark):
    """Spans are written out and read back once between the matches and the result, not after each step."""
    rows = spark.createDataFrame([(1, "mail a@b.com")], "doc_id int, text string")
    for made in (detect(rows), mask(rows), mask(rows, mode="synthetic")):
        assert made._jdf.queryExecution().executedPlan().toString().count("Generate explode") == 1
