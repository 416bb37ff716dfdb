"""Fixture texts with the spans that must come out.

Spans are marked in the text: ``⟦TYPE|value⟧`` stands for the value, found as that type.
"""

import re

_MARK = re.compile(r"⟦([A-Z_]+)\|([^⟧]*)⟧")


def marked(text):
    """The text without marks, and its spans as (start, end, type)."""
    plain, spans, at = "", [], 0
    for m in _MARK.finditer(text):
        plain += text[at : m.start()]
        spans.append((len(plain), len(plain) + len(m[2]), m[1]))
        plain += m[2]
        at = m.end()
    return plain + text[at:], spans


FORM = """Applicant: ⟦PERSON|Nora Lindqvist⟧;
E-mail ⟦EMAIL|n.lindqvist@post.example⟧
Call ⟦PHONE|+49 (30) 901-82-73⟧
паспорт ⟦PHONE|46 07 654321⟧
passport ⟦DOC_ID|KL7654321⟧
document no ⟦DOC_ID|EU9081726⟧
Card ⟦CARD|5105 1051 0510 5100⟧
Account ⟦IBAN|FR7630006000011234567890189⟧
swift ⟦SWIFT_BIC|BNPAFRPP⟧
"""

LETTER = """Your request of ⟦DATE|03.02.2025⟧ has arrived, Ms Novak.

Applicant: ⟦PERSON|Clara Novak⟧
born ⟦DATE|17-09-1979⟧
reach her at ⟦PHONE|+44 (20) 794-60-18⟧ or ⟦EMAIL|clara@novak.example⟧ from ⟦IP|172.16.4.9⟧

Wohnung: Am ⟦ADDRESS|Neuen Ring 4⟧, first floor; before that ⟦ADDRESS|18 Mill Lane⟧ in the old town.

Refund to ⟦IBAN|GB29NWBK60161331926819⟧ or to card ⟦CARD|5500 0000 0000 0004⟧.
The branch"""

CASES = {
    name: marked(text)
    for name, text in {
        "mail_and_card": "Kontakt ⟦EMAIL|nora@post.example⟧ Karte ⟦CARD|5105 1051 0510 5100⟧",
        "ru_passport": "Паспорт: ⟦PHONE|46 07 654321⟧",
        "same_value_twice": "von ⟦EMAIL|k@l.org⟧ und noch einmal ⟦EMAIL|k@l.org⟧",
        "ru_label": "ФИО: ⟦PERSON|Орлова Вера Павловна⟧",
        "latin_label": "surname: ⟦PERSON|Clara Novak⟧",
        "ru_label_line_above": "ФИО клиента:\n⟦PERSON|Орлова Вера Павловна⟧",
        "ru_signature": "Всего доброго, Орлова Вера Павловна",
        "form": FORM,
        "letter": LETTER,
        "ips": "hosts ⟦IP|10.20.30.40⟧, fe80:0001:0002::7:9:11, or ⟦IP|::5⟧",
        "not_ips": "neither 300.1.1.1 nor 1.256.0.9 exists",
        "card_groups": "Karte: ⟦CARD|4000 0000 0000 0002⟧",
        "card_wide_gaps": "Karte: ⟦CARD|4000  0000  0000  0002⟧",
        "de_postcode_with_label": "Anschrift:\nLindenstraße 7\n⟦ADDRESS|50667 Bonn⟧",
        "de_postcode_alone": "Ticket 50667 Bonn goes with the return slip.",
        "two_dates": "The stay lasts from ⟦DATE|03.04.2027⟧ until ⟦DATE|02.05.2027⟧, not longer.",
        "three_dates": "seen ⟦DATE|14.02.2011⟧\nin: ⟦DATE|05.08.2025⟧; out: ⟦DATE|19.09.2025⟧;",
        "ru_street_after_space": "Адрес: ул. Мира, д. 12",
        "ru_postcode": "Адрес: 190000 г. Тверь",
        "scope_operator": "run qux⟦IP|::fa⟧st",
        "umlaut_start": "lebt am Ä⟦ADDRESS|hren Ring 8⟧ jetzt",
        "ipv6_and_mac": "v6 ⟦IP|2001:0db8:0001:0000:0000:00aa:0bcd:4321⟧ mac 0A:1B:2C:3D:4E:5F",
        "mark_in_text": "q﷐ ⟦EMAIL|r@s.tu⟧ ﷐ ⟦EMAIL|v@w.xy⟧",
        "blank": " \n  ",
        "empty": "",
        "astral": "q😀r ⟦EMAIL|s@t.uv⟧",
        "email_run": "⟦EMAIL|q@r.net⟧⟦EMAIL|.s@t.uk⟧",
        "de_two_words": "Im ⟦ADDRESS|Alten Weg 9b⟧, ⟦ADDRESS|Kleine Ring 6⟧",
        "snils": "СНИЛС ⟦PHONE|087-654-321 09⟧",
        "tax_number": "tin ⟦DOC_ID|87654321⟧",
        "permit": "permit ⟦DOC_ID|98ZY76543⟧",
        "vat": "VAT ⟦DOC_ID|AT123456789⟧",
        "luhn_decides": "⟦CARD|4222222222222⟧ x ⟦PHONE|4222222222223⟧",
        "account": "acc ⟦ACCOUNT|98765432109876543210⟧.",
        "nbsp_crlf": "tel ⟦PHONE|+1\u00a0555 987 6543⟧\r\nfine",
        "upper_ru": "⟦PERSON|ФАМИЛИЯ ОРЛОВА ВЕРА⟧ ПАВЛОВНА",
        "armenian_label": "անուն: ⟦PERSON|Clara Novak⟧",
        "window_cut_is_edge": "xsurname" + " " * 41 + "⟦PERSON|Clara Novak⟧",
        "window_too_far": "surname" + " " * 48 + "Clara Novak",
    }.items()
}
