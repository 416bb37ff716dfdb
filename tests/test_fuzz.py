"""Random texts through the whole detector and through a plain model without gates or rewritten patterns."""

import random

import brute
from cloakwork.plans.masking import detect

WORDS = """Иванов Иван Иванович ИВАНОВ ИВАН ПЕТР-Рович Анна-Мария John Smith Mary-Jane VanDyke O'Neil Müller Ähren hren Köln Bad Homburg
фио ФИО: фамилия Имя заявителя данные address Address: адрес Anschrift plz surname xsurname First name applicant անուն հասցե
ул. улица 2ул. Xпр-кт Ленина Мира д. дом 5 12а кв. 7 г. город Москва Москвах 101000 10115 62704 62704-1234
Weg weg Str. str Straße straße Allee Ring ring Muster Am Alten 5 12 5a 5ab 12345 Baker Street St. Road Rd. Ave Lane Way Drive Blvd
a@b.com x.y+z@mail.example.org @ a@b .x@c.de -a@b.co_m 10.0.0.1 256.1.1.1 1.2.3.4.5 ::1 foo::bar 2001:db8::1 1:2:3:4:5:6:7:8 1:2:3:: a:b:c: :::
+1 (555) 123-4567 123-456-789 01 4111 1111 1111 1111 4111-1111--1111 4222222222222 4222222222223 12345678901234567890 1234567890 123456789012 12345678 45 11 123456
DE89370400440532013000 DEUTDEFF DEUTDEFFXXX AB1234567 C01X00T47 DE123456789 12AB12345 IBAN SWIFT passport Паспорт инн снилс ssn tin tax vat id permit residence
12.05.1996 1996-05-12 1/2-2020 32.1.2020 31/12/2099 --- ---- ------ - . , ; : ( ) _ x_ 1a a1 é ß 😀 ǅ""".split()
JOINS = [" ", " ", " ", " ", "\n", "  ", "\t", "", "", ", ", "; ", ": ", "\u00a0", "\u2003", "\u3000", "\ufeff", "\u2028", "\x0b", "\r\n", "-", ".", "_"]


def texts(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        pool = rng.sample(WORDS, rng.randrange(3, 40)) if rng.random() < 0.6 else WORDS
        out.append("".join(rng.choice(pool) + rng.choice(JOINS) for _ in range(rng.randrange(1, 40))))
    return out


def test_random_texts(spark):
    cases = texts(6000, 11)
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id int, text string").repartition(8)
    got = {r.doc_id: [(s.start, s.end, s.rule_id, s.priority, s.confidence) for s in r.spans] for r in detect(df).select("doc_id", "spans").collect()}
    used = set()
    for i, text in enumerate(cases):
        want = [(s, e, rule, p, min(0.99, (p + 5 * h) / 100)) for s, e, rule, p, h in brute.detect(text)]
        assert got[i] == want, (text, got[i], want)
        used |= {w[2] for w in want}
    assert len(used) >= 27, sorted(used)
