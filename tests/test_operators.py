import random

import pytest
from pyspark.sql import functions as F

import brute
from cloakwork.functions import replacements as R
from cloakwork.functions import text as X
from cloakwork.functions import validators as V
from cloakwork.functions.arrays import first_seen_rank, lookup
from cloakwork.operators import overlaps
from cloakwork.operators.numbering import fill_replacements, number_spans
from cloakwork.operators.overlaps import resolve_overlaps, sort_key, sweep

SPAN = "array<struct<start:int,end:int,priority:int,ord:int>>"


def random_spans(rng, n, width):
    out = []
    for i in range(n):
        s = rng.randrange(width)
        out.append((s, s + rng.randrange(1, 12), rng.choice([60, 70, 80, 85, 90]), i))
    return out


@pytest.fixture(scope="module")
def span_cases():
    rng = random.Random(5)
    cases = [[], [(0, 10, 80, 0), (5, 15, 90, 1), (12, 20, 85, 2), (14, 22, 95, 3)], [(3, 9, 70, 0), (3, 9, 70, 1)]]
    return cases + [random_spans(rng, rng.randrange(1, 60), 80) for _ in range(120)] + [random_spans(rng, 900, 3000)]


def test_sweep_array_form(spark, span_cases):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(span_cases)], f"i int, spans {SPAN}")
    keys = F.transform("spans", lambda s: sort_key(s.start, s.end, s.priority, s.ord, s))
    got = {r.i: [tuple(k.payload) for k in r.k] for r in df.select("i", sweep(keys).alias("k")).collect()}
    assert got[1] == [(14, 22, 95, 3)]
    for i, c in enumerate(span_cases):
        assert got[i] == brute.sweep(c)


def test_sweep_of_few_and_many(spark):
    """The fold for short lists and the one for long ones agree, also where a place or a priority is null."""
    rng = random.Random(11)
    cases = [random_spans(rng, n, 90) for n in (2, 15, 31, 32, 33, 34, 64) for _ in range(12)]
    cases += [[(s if rng.random() > 0.15 else None, e, p if rng.random() > 0.15 else None, o) for s, e, p, o in c] for c in cases]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, spans {SPAN}")
    keys = F.transform("spans", lambda s: sort_key(s.start, s.end, s.priority, s.ord, s.ord))

    def swept(few):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(overlaps, "FEW", few)
            return {r.i: list(r.k) for r in df.select("i", F.transform(sweep(keys), lambda k: k.payload).alias("k")).collect()}

    short = swept(1000)
    assert short == swept(0) == swept(32)
    for i, c in enumerate(cases[: len(cases) // 2]):
        assert short[i] == [o for *_, o in brute.sweep(c)]


@pytest.mark.parametrize("n", [0, 1, 2, 31, 32, 33, 70])
def test_numbers_of_few_and_many(spark, n):
    rng = random.Random(n)
    spans = [(rng.choice(["USER", "EMAIL", "ORG"]), rng.choice([None, "RU", "EU"]), rng.choice("abcdef")) for _ in range(n)]
    df = spark.createDataFrame([(spans,), (None,)], "spans array<struct<type:string,region:string,source:string>>")
    got, none = df.select(number_spans(F.col("spans"), "tag").alias("s")).collect()
    seen, want = {}, []
    for t, region, source in spans:
        values = seen.setdefault(t, {})
        want.append(f"[{t}_{values.setdefault((region or '-', source), len(values) + 1)}]")
    assert [s.replacement for s in got.s] == want and none.s is None


@pytest.mark.parametrize("block", [7, 65536])
def test_sweep_table_form(spark, span_cases, block):
    rows = [(i, *s) for i, c in enumerate(span_cases) for s in c]
    df = spark.createDataFrame(rows, "i int, start int, end int, priority int, ord int")
    got = {}
    for r in resolve_overlaps(df, ["i"], block).collect():
        got.setdefault(r.i, []).append((r.start, r.end, r.priority, r.ord))
    for i, c in enumerate(span_cases):
        assert sorted(got.get(i, [])) == brute.sweep(c)


def test_fill_replacements(spark):
    rng = random.Random(9)
    fields = "entity_id:string,type:string,start:int,region:string,source:string,replacement:string"
    cases = [[("DOC_ID", None, "a", "[DOC_ID_1]"), ("DOC_ID", None, "b", "[DOC_ID_3]"), ("DOC_ID", None, "c", "[DOC_ID_4]"),
              ("DOC_ID", None, "d", None), ("DOC_ID", None, "e", None)]]
    for _ in range(150):
        case = []
        for _ in range(rng.randrange(1, 14)):
            t = rng.choice(["USER", "EMAIL"])
            rep = rng.choice([None, None, "", f"[{t}_{rng.randrange(0, 5)}]", "odd", "[EMAIL_2]"])
            case.append((t, rng.choice([None, "RU"]), rng.choice("abcd"), rep))
        cases.append(case)
    rows = [(i, [("x", t, j, reg, s, r) for j, (t, reg, s, r) in enumerate(c)]) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, f"i int, spans array<struct<{fields}>>")
    got = {r.i: [s.replacement for s in r.f] for r in df.select("i", fill_replacements(F.col("spans"), "tag").alias("f")).collect()}
    assert got[0][3:] == ["[DOC_ID_2]", "[DOC_ID_5]"]
    for i, c in enumerate(cases):
        brute.check_filled([(t, reg or "-", s, r) for t, reg, s, r in c], got[i])


def test_lookup_and_rank(spark):
    df = spark.createDataFrame(
        [(["b", "a", "z", "b"], [("a", 1), ("b", 2), ("b", 9)])], "k array<string>, e array<struct<k:string,v:int>>"
    )
    assert list(df.select(lookup(F.col("k"), F.col("e")).alias("v")).first().v) == [2, 1, None, 2]
    ranks = first_seen_rank(F.col("k"), lambda k: F.lit("g"), lambda k: k)
    assert list(df.select(ranks.alias("v")).first().v) == [1, 2, 3, 1]


def check(spark, fn, cases):
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r.v: r.x for r in df.select("v", fn(F.col("v")).alias("x")).collect()}
    assert got == cases


def test_validators(spark):
    check(spark, V.luhn, {"4222222222222": True, "4222222222223": False, "4111-1111 1111 1111": True, "12": False, "": False})
    check(spark, V.likely_card, {"1234567812345678": True, "1234  5678-1234 5678": True, " 1234567812345678 ": True,
                                 "1234   5678 1234 5678": False, "4222222222222": True, "12345678901234567890": False})
    check(spark, V.likely_phone, {"+7 (999) 123-45-67": True, "10.06.2026": False, "4111 1111 1111 1111": False,
                                  "12345678": False, "123456789": True, "1234567890123456": False, "2026-06-10": False})
    check(spark, V.valid_ipv4, {"1.2.3.4": True, "256.1.1.1": False, "1.2.3": False, "007.1.1.1": True, "1.2.3.4.5": False, " 1.2.3.4 ": True})
    check(spark, V.valid_ipv6, {"::": True, "::1": True, "1::2::3": False, ":::1": False, "1:2:3:4:5:6:7:8": True,
                                "1:2:3:4:5:6:7": False, "1:2:3:4:5:6:7::8": False, "12345::": False, ":1::2": False,
                                "1::": True, "1:2:3:4:5:6:7::": True, "g::1": False, "1": False})
    check(spark, V.date_like, {"1.2.2020": True, "2020/1/2": True, "32.1.2020": False, "1.2-1999": True, "1.2.2100": False})


def test_synthetic_templates(spark):
    cases = {
        ("USER", 3, None, "x"): "USER_3", ("EMAIL", 3, None, "x"): "user3@example.test",
        ("PHONE", 12345, None, "x"): "+000000012345", ("IP", 300, None, "x"): "10.0.0.254",
        ("ADDRESS", 2, None, "x"): "ADDRESS_2", ("CARD", 9000, None, "x"): "4111 **** **** 0000",
        ("IBAN", 7, None, "x"): "DE00TEST00000000000007", ("SWIFT_BIC", 7, None, "x"): "FAKE0007",
        ("ACCOUNT", 7, None, "x"): "***************00007", ("DOC_ID", 7, "RU", "x"): "RU-DOC-00007",
        ("DOC_ID", 7, None, "x"): "XX-DOC-00007", ("PERSON", 1, None, "x"): "PERSON_1", ("ORG", 1, None, "x"): "ORG_1",
        ("DATE", 30, None, "1/2/2020"): "02/03/1994", ("DATE", 30, None, "2020-1-2"): "1994-03-02",
        ("DATE", 30, None, "1.2/2020"): "01.01.1990", ("WHAT", 5, None, "x"): "REDACTED_5",
    }
    df = spark.createDataFrame(list(cases), "t string, n int, r string, s string")
    got = df.select("*", R.synthetic(F.col("t"), F.col("n"), F.col("r"), F.col("s")).alias("x")).collect()
    assert {(g.t, g.n, g.r, g.s): g.x for g in got} == cases


def test_parse_index(spark):
    tags = {("EMAIL", "[EMAIL_12]"): 12, ("EMAIL", "[EMAIL_0]"): None, ("EMAIL", "[USER_1]"): None,
            ("EMAIL", "[EMAIL_1"): None, ("EMAIL", "[EMAIL_x]"): None, ("DATE", "[DATE_2]"): 2, ("EMAIL", ""): None}
    made = {("USER", "USER_4"): 4, ("EMAIL", "user5@example.test"): 5, ("PHONE", "+00000000006"): 6,
            ("PHONE", "+000000012345"): None, ("IP", "10.0.0.7"): None, ("ORG", "PERSON_1"): None}
    for mode, cases in (("tag", tags), ("synthetic", made)):
        df = spark.createDataFrame(list(cases), "t string, v string")
        got = df.select("*", R.parse_index(mode, F.col("t"), F.col("v")).alias("x")).collect()
        assert {(g.t, g.v): g.x for g in got} == cases


def test_text_functions(spark):
    cases = [("abcabcab", "abc"), ("aaaa", "aa"), ("x\\Ey\\E", "\\E"), ("", "a"), ("abc", ""), ("a😀b😀", "😀"), ("a.b*c", ".")]
    df = spark.createDataFrame(cases, "t string, n string")
    for r in df.select("*", X.occurrences(F.col("t"), F.col("n")).alias("o")).collect():
        assert [tuple(o) for o in r.o] == brute.occurrences(r.t, r.n)
    text = "".join(chr(97 + i % 26) for i in range(5000)) + "😀" * 10
    one = spark.createDataFrame([(text, a, b) for a, b in [(-5, 3), (0, 0), (1020, 1030), (0, 5010), (1024, 2048), (4990, 6000)]], "t string, a int, b int")
    for r in one.select("*", X.slice_blocks(X.blocks(F.col("t")), F.col("a"), F.col("b")).alias("s")).collect():
        assert r.s == text[max(r.a, 0) : r.b]
    trimmed = spark.createDataFrame([("\u00a0\ufeff a b \n\u2029",)], "t string").select(X.trim_space(F.col("t"))).first()[0]
    assert trimmed == "a b"


def _fold_types(expr):
    if expr.getClass().getSimpleName() == "ArrayAggregate":
        yield expr.zero().dataType().catalogString()
    children = expr.children()
    for k in range(children.size()):
        yield from _fold_types(children.apply(k))


def test_folds_over_long_span_lists_carry_numbers_only(spark):
    """A fold copies all it has collected at every step, so texts in its states cost their length times the list's."""
    n = 700
    made = spark.range(1).selectExpr(
        f"transform(sequence(1, {n}), i -> struct(i * 3 AS start, i * 3 + 3 + i % 2 AS end, i % 5 AS priority, i AS ord, 'EMAIL' AS type, "
        "CAST(NULL AS STRING) AS region, concat('value ', i % 300) AS source, CAST(NULL AS STRING) AS replacement)) AS s"
    )
    keys = F.transform("s", lambda s: sort_key(s.start, s.end, s.priority, s.ord, s))
    out = made.select(F.transform(sweep(keys), lambda k: k.payload.start).alias("kept"), fill_replacements(F.col("s"), "tag").alias("filled"))
    types = list(_fold_types(out._jdf.queryExecution().analyzed().expressions().apply(0)))
    types += _fold_types(out._jdf.queryExecution().analyzed().expressions().apply(1))
    assert types and not [t for t in types if "string" in t]
    row = out.first()
    kept = []
    for i in range(1, n + 1):
        start, end, priority = i * 3, i * 3 + 3 + i % 2, i % 5
        if not kept or start >= kept[-1][1]:
            kept.append((start, end, priority, False))
        elif priority > kept[-1][2]:
            kept[-1] = (*kept[-1][:3], True)
            kept.append((start, end, priority, False))
    assert row["kept"] == [start for start, _, _, evicted in kept if not evicted]
    assert [s["replacement"] for s in row["filled"]] == [f"[EMAIL_{i % 300 or 300}]" for i in range(1, n + 1)]


def test_validators_in_one_pattern_each(spark):
    """Nothing is trimmed, split or put together again around a candidate, and the edges of the shapes stay where they were."""
    for test in (V.valid_ipv4, V.valid_ipv6, V.date_like, V.likely_phone):
        text = str(test(F.col("v")))
        assert "split" not in text and "regexp_replace" not in text
    check(spark, V.valid_ipv6, {"1:2:3:4:5:6:7::": True, "::2:3:4:5:6:7:8": True, "1:2:3:4:5:6:7::8": False, "1:2:3:4::5:6:7:8": False,
                                "::1:2:3:4:5:6:7:8": False, "1:2:3:4:5:6:7:8::": False, " 1::2\n": True, "a:b": False, "1:::2": False,
                                "1::2:": False, "12345::": False, "": False, ":": False, "1::2::": False})
    check(spark, V.valid_ipv4, {"255.249.199.99": True, "0.00.000.1": True, "1.2.3.260": False, "1.2.3.0255": False, "1.2.3.": False, "": False})
    check(spark, V.likely_phone, {"12345678": False, "123456789": True, "1-2-3-4-5-6-7-8-9-0-1-2-3-4-5": True, "1234567890123456": False,
                                  "12345678901234567": False, " 10.06.2026 ": False, " 4111 1111 1111 1111": False})
