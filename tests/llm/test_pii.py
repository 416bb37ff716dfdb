"""Personal data against the plain patterns, known numbers, and SQL."""

import hashlib
import random
import re
import time

import duckdb
import pytest

from cloakwork.llm import pii

CARD, IBAN = "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00"


def plain(text):
    """The fixed kinds as they are defined: leftmost matches, and what fails is dropped."""
    out = []
    for order, kind in enumerate(pii.BASE):
        for m in re.finditer(pii.PATTERNS[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            if kind == "card":
                total = 0
                for k, c in enumerate(reversed(digits)):
                    n = int(c) * (1 + k % 2)
                    total += n - 9 if n > 9 else n
                if not 12 <= len(digits) <= 19 or total % 10:
                    continue
            out.append((m.start(), order, m.end(), kind))
    return [(s, e, kind) for s, _, e, kind in sorted(out)]


@pytest.mark.parametrize("alphabet", ["ab@.- ", "01.25 ", "19 -", "+1 ().-2x", "aZ@.0+-_% é1 9"])
def test_fixed_kinds_of_random_texts(alphabet):
    rng = random.Random(alphabet)
    hits = 0
    for _ in range(6_000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        got = [s[:3] for s in pii.find(text) if s[2] in pii.BASE]
        assert got == plain(text), text
        hits += len(got)
    assert hits >= 10


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97(IBAN.replace(" ", "")) and not pii.mod97("DE88370400440532013000")
    assert pii.routing_sum("021000021") and not pii.routing_sum("021000022")


def kinds(text):
    return [(text[s:e], kind) for s, e, kind, _ in pii.find(text)]


def test_words_nearby():
    assert kinds("his SSN is 123-45-6789.") == [("123-45-6789", "ssn")]
    assert kinds("part 123-45-6789.") == [] and kinds("ssn 666-45-6789, 123-00-6789, 1-123-45-6789, 123-45-67890") == []
    assert kinds("an example ssn: 123-45-6789") == []
    assert kinds("routing no. 021000021") == [("021000021", "routing")] and kinds("no. 021000021" + " ." * 30 + " routing 021000022") == []
    assert kinds(f"pay to {IBAN} or GB82WEST12345698765432 now") == [(IBAN, "iban"), ("GB82WEST12345698765432", "iban")]
    assert kinds("XDE89370400440532013000 DE893704004405320130001 DE88370400440532013000 ZZ893704004405320130") == []
    with_word, without, against = (pii.find(t)[0][3] for t in (f"my visa {CARD}", f"paid {CARD}", f"a sample {CARD}"))
    assert with_word > without > against > 0


TEXTS = [
    None, "", f"Mail a.b@c.de, bad@host, IP 010.0.0.255 and 256.1.1.1, 1.2.3.4.5.6.7.8; card {CARD}; tel. +49 (30) 1234-567 ",
    f"é😀 {IBAN} @x.y@z.w and iban {IBAN[:-1]}1 ssn 123-45-6789 routing 021000021", "order 123-45-6789, SSN? 078-05-1120", "x@y@c.d a@b.c@d.e a@b.c_x@d.e",
    "+1 (415) 555-0132 +12 3 +()() +1" + ")" * 60, "4111-1111-1111-1111 4111  1111 1111 1111 4111 1111 1111 1111 1111", f"example {IBAN} example account",
    "NO9386011117947", "MT84MALT011000012345MTLCAST001S; mt84", "ip 1.2.3.4 AA" + " 1" * 200, "000000000 routing 000000000 aba 11100002 111000025",
]


def test_table_and_sql(spark, tmp_path):
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(TEXTS)] + [(None, TEXTS[2], "a", "b"), (2, TEXTS[2], "a", "b")],
                               "doc_id bigint, text string, spans string, score string")
    rows = pii.find_pii(df).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = TEXTS[2 if r["id"] is None else r["id"]] or ""
        assert [tuple(s) for s in r["spans"]] == [(s, e, k, v) for s, e, k, v in pii.find(text)]
        assert [tuple(s)[:3] for s in r["spans"] if s["kind"] in pii.BASE] == plain(text)
    assert pii.find_pii(df.limit(0)).collect() == []
    hidden = {r["id"]: r["text"] for r in pii.redact(df).collect()}
    assert hidden[4] == "order 123-45-6789, SSN? 078-05-1120" and hidden[3].startswith("é😀 <iban> ") and hidden[0] == ""
    df.select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"]).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    query = pii.op12_pii(spark, str(tmp_path))
    got = {r["doc_id"]: r.asDict() for r in query.collect()}
    for i, text in enumerate(TEXTS):
        base = plain(text or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(b[2] == k for b in base) for k in pii.BASE]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cursor = con.execute(pii.ORACLE["op12_pii"])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(query.columns)
    want = {r["doc_id"]: r for r in (dict(zip(names, row, strict=True)) for row in cursor.fetchall())}
    assert got == want
    assert sum(r["spans"].count("iban") + r["spans"].count("ssn") + r["spans"].count("routing") for r in got.values()) >= 6


def test_long_texts_take_linear_time():
    began = time.time()
    for text in ("a" * 400_000, "1" * 400_000, "1 " * 200_000, "1." * 200_000, "a@" * 200_000, "@a.b" * 100_000, "+1" + "-" * 400_000, "+1 " * 130_000, "AA11 " * 80_000, "123-45-" * 60_000):
        pii.find(text)
    assert time.time() - began < 30
