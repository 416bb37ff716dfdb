"""SQL counterparts of the queries, for DuckDB.

DuckDB's regex has no look-around, so the person and IPv6 patterns are written without; on the
texts they run on (forms, and documents without labels or colons) that makes no difference.
"""

from __future__ import annotations

from workload.inputs import FORM_KIND, FORM_TEXT, MAIL_NOTE_TEXT, NOTE_TEXT, REGISTER_PARTS

# Rule number, id, type, region, priority, basis, pattern.
_RU, _LAT = r"[А-ЯЁ][а-яё-]{2,}", r"[A-Z][a-z-]{2,}"
_D, _M, _Y = r"(?:0?[1-9]|[12]\d|3[01])", r"(?:0?[1-9]|1[0-2])", r"(?:19\d{2}|20\d{2})"
_H = r"[A-F0-9]"
RULES = [
    (1, "universal.person.ru_fio", "PERSON", None, 76, "name-pattern+context", rf"{_RU}\s+{_RU}\s+{_RU}"),
    (2, "universal.person.ru_fio_upper", "PERSON", None, 74, "name-pattern+context", r"[А-ЯЁ-]{3,}\s+[А-ЯЁ-]{3,}\s+[А-ЯЁ-]{3,}"),
    (3, "universal.person.ru_fullname_2parts", "PERSON", None, 71, "name-pattern+context", rf"{_RU}\s+{_RU}"),
    (4, "universal.person.latin_fullname", "PERSON", None, 72, "name-pattern+context", rf"\b{_LAT}\s+{_LAT}\s+{_LAT}\b"),
    (5, "universal.person.latin_fullname_2parts", "PERSON", None, 69, "name-pattern+context", rf"\b{_LAT}\s+{_LAT}\b"),
    (6, "universal.email", "EMAIL", None, 90, "strict-format", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"),
    (7, "universal.phone", "PHONE", None, 85, "format", r"\+?\d[\d\s().-]{8,}\d"),
    (8, "universal.ipv4", "IP", None, 87, "format+validator", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    (9, "universal.ipv6.full", "IP", None, 87, "format+validator", rf"(?i)(?:{_H}{{1,4}}:){{2,7}}{_H}{{1,4}}"),
    (10, "universal.ipv6.compressed", "IP", None, 87, "format+validator", rf"(?i)(?:{_H}{{1,4}}:){{0,7}}::(?:{_H}{{1,4}}:){{0,7}}{_H}{{0,4}}"),
    (11, "universal.address.ru.street_house", "ADDRESS", None, 86, "strict-structure",
     r"(?i)\b(?:ул\.?|улица|пр-?кт|проспект|пер\.?|переулок|наб\.?|набережная|б-р|бульвар|ш\.?|шоссе|пл\.?|площадь)\s+[А-ЯЁA-Z][\p{L}\-.\s]{1,48}?,?\s*(?:д\.?|дом)\s*\d{1,4}[а-яa-z]?(?:\s*(?:кв\.?|квартира)\s*\d{1,4})?\b"),
    (12, "universal.address.de.street_house", "ADDRESS", None, 86, "strict-structure",
     r"(?i)\b[A-ZÄÖÜ][\p{L}\-]{2,}(?:\s+[A-ZÄÖÜ][\p{L}\-]{2,})*\s+(?:straße|str\.?|weg|allee|platz|gasse|ring|ufer)\s+\d{1,4}[a-zA-Z]?\b"),
    (13, "universal.address.en.street_house", "ADDRESS", None, 84, "strict-structure",
     r"(?i)\b\d{1,5}\s+[A-Za-z][A-Za-z.\- ]{1,50}\s(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Drive|Dr\.?|Boulevard|Blvd\.?|Court|Ct\.?|Place|Pl\.?|Way)\b"),
    (14, "universal.address.de.postcode_city", "ADDRESS", None, 80, "postcode+locality+context", r"\b\d{5}\s+[A-ZÄÖÜ][\p{L}\-]+(?:\s+[A-ZÄÖÜ][\p{L}\-]+){0,2}\b"),
    (15, "universal.address.ru.postcode_city", "ADDRESS", None, 80, "postcode+locality+context", r"\b\d{6}\s*,?\s*(?:г\.?|город)\s+[А-ЯЁ][\p{L}\- ]{1,40}\b"),
    (16, "universal.address.en.zip_city", "ADDRESS", None, 78, "postcode+locality+context", r"\b\d{5}(?:-\d{4})?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\b"),
    (17, "universal.card", "CARD", None, 95, "format+luhn-or-shape", r"\b(?:\d[ -]*?){13,19}\b"),
    (18, "universal.iban", "IBAN", None, 88, "format", r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b"),
    (19, "universal.swiftbic", "SWIFT_BIC", None, 78, "format", r"\b[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b"),
    (20, "universal.account20", "ACCOUNT", None, 80, "length", r"\b\d{20}\b"),
    (21, "universal.date", "DATE", None, 60, "format", rf"\b{_D}[./-]{_M}[./-]{_Y}\b"),
    (22, "universal.date_iso_like", "DATE", None, 60, "format", rf"\b{_Y}[./-]{_M}[./-]{_D}\b"),
    (23, "ru.passport.series_number", "DOC_ID", "RU", 80, "format+context", r"\b\d{2}\s?\d{2}\s?\d{6}\b"),
    (24, "ru.inn.person_or_company", "DOC_ID", "RU", 70, "format+hint", r"\b\d{10}(?:\d{2})?\b"),
    (25, "ru.snils", "DOC_ID", "RU", 75, "exact-format", r"\b\d{3}-\d{3}-\d{3}\s\d{2}\b"),
    (26, "am.passport.alpha_numeric", "DOC_ID", "AM", 80, "format+context", r"\b[A-Z]{2}\d{7}\b"),
    (27, "am.ssn_like", "DOC_ID", "AM", 65, "format+hint", r"\b\d{10}\b"),
    (28, "am.tax_identifier", "DOC_ID", "AM", 60, "format+hint", r"\b\d{8}\b"),
    (29, "eu.passport.alphanumeric_9", "DOC_ID", "EU", 72, "format+context", r"\b[A-Z0-9]{9}\b"),
    (30, "eu.vat.number", "DOC_ID", "EU", 66, "format+hint", r"\b[A-Z]{2}[A-Z0-9]{8,12}\b"),
    (31, "eu.residence_permit_like", "DOC_ID", "EU", 64, "format+hint", r"\b\d{2}[A-Z]{2}\d{5,7}\b"),
]
# Words that must be near a match of a rule.
HINTS = {
    23: ["паспорт", "серия", "номер", "выдан"],
    24: ["инн", "налог"],
    25: ["снилс"],
    26: ["passport", "անձնագիր", "document"],
    27: ["ssn", "social", "հաշվառում"],
    28: ["tin", "tax", "հարկ"],
    29: ["passport", "id card", "document no", "national id"],
    30: ["vat", "tax", "registration"],
    31: ["residence", "permit", "id"],
}
# Field labels near a person or a postcode.  True: the label stands alone.
PERSON_LABELS = [
    ("фио", True), ("фамили[яи]", True), ("имя", True), ("отчество", True), ("заявител(?:ь|я)", True), ("данные заявителя", False),
    ("first name", True), ("given name", True), ("middle name", True), ("last name", True), ("family name", True),
    ("surname", True), ("legal name", True), ("applicant", True),
    ("vorname", True), ("familienname", True), ("nachname", True), ("geburtsname", True), ("antragsteller(?:in)?", True), ("anrede", True),
    ("անուն", True), ("ազգանուն", True), ("հայրանուն", True), (r"դիմողի անուն,\s*ազգանուն,\s*հայրանունը", False),
]
ADDRESS_LABELS = [
    ("адрес", True), ("адрес проживания", False), ("адрес регистрации", False), ("место жительства", False), ("индекс", True),
    ("address", True), ("residential address", False), ("mailing address", False), ("postal address", False), ("place of residence", False),
    ("anschrift", True), ("adresse", True), ("wohnanschrift", False), ("meldeadresse", False), ("wohnort", True), ("postleitzahl", True), ("plz", True),
    ("հասցե", True), ("բնակության հասցե", False), ("գրանցման հասցե", False), ("փոստային ինդեքս", False),
]


def _labels(labels: list[tuple[str, bool]]) -> str:
    spaced = [(label.replace(" ", r"\s+"), alone) for label, alone in labels]
    return "(?i)" + "|".join(rf"(?:^|[^\p{{L}}])(?:{label})(?:[^\p{{L}}]|$)" if alone else label for label, alone in spaced)


PERSON, ADDRESS = _labels(PERSON_LABELS), _labels(ADDRESS_LABELS)

DATE_SHAPE = rf"(?:{_D}[./-]{_M}[./-]{_Y}|{_Y}[./-]{_M}[./-]{_D})"
CARD16 = r"(?:\d{16}|\d{4}(?:[ -]{1,2}\d{4}){3})"


def luhn(d: str) -> str:
    digit = f"CAST(substring({d}, length({d}) - i + 1, 1) AS INT)"
    return (
        f"(length({d}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({d}) + 1), lambda i: "
        f"CASE WHEN i % 2 = 1 THEN {digit} WHEN {digit} > 4 THEN {digit} * 2 - 9 ELSE {digit} * 2 END)) % 10 = 0)"
    )


def digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '', 'g')"


def card(v: str) -> str:
    return f"(regexp_full_match({v}, '{CARD16}') OR {luhn(digits(v))})"


def phone(v: str) -> str:
    return (
        f"(NOT regexp_full_match({v}, '{DATE_SHAPE}') AND NOT regexp_full_match({v}, '{CARD16}') "
        f"AND length({digits(v)}) BETWEEN 9 AND 15)"
    )


def ipv4(v: str) -> str:
    return f"(len(list_filter(string_split({v}, '.'), lambda o: CAST(o AS INT) > 255)) = 0)"


def ipv6(v: str) -> str:
    groups = f"len(list_filter(string_split({v}, ':'), lambda h: h <> ''))"
    return (
        f"(length({v}) BETWEEN 2 AND 39 AND NOT contains({v}, ':::') AND NOT regexp_matches({v}, '[^:]:$') "
        f"AND CASE WHEN contains({v}, '::') THEN {groups} < 8 ELSE {groups} = 8 END)"
    )


DOCS = "SELECT doc_id, text FROM documents"
FORMS = f"SELECT o_orderkey AS doc_id, {FORM_TEXT} AS text, {FORM_KIND} AS kind FROM orders"
NOTES = f"SELECT o_orderkey AS doc_id, {NOTE_TEXT} AS text, o_custkey FROM orders"
MAIL_NOTES = f"SELECT o_orderkey AS doc_id, {MAIL_NOTE_TEXT} AS text FROM orders"


def _clean(docs: str, key: str = "doc_id", text: str = "text") -> str:
    return (
        f"docs AS MATERIALIZED (SELECT {key} AS doc_id, replace(replace({text}, chr(160), ' '), chr(13) || chr(10), chr(10)) AS t FROM ({docs}))"
    )


def _window(size: int) -> str:
    return f"substring(t, greatest(s - {size}, 0) + 1, e + {size} - greatest(s - {size}, 0))"


def _candidates(rules: list) -> str:
    """CTEs up to ``cand``: everything that passes its rule's own tests."""
    raw = " UNION ALL ".join(
        f"SELECT doc_id, t, {r[0]} AS ord, regexp_extract_all(t, '{r[6]}') AS m, string_split_regex(t, '{r[6]}') AS g "
        f"FROM docs WHERE regexp_matches(t, '{r[6]}')"
        for r in rules
    )
    hits = " ".join(
        f"WHEN {n} THEN " + " + ".join(f"CAST(contains(low, '{h}') AS INT)" for h in hs) for n, hs in HINTS.items()
    )
    meta = ", ".join(
        f"({n}, '{i}', '{t}', {'NULL' if g is None else repr(g)}, {p}, '{b}')" for n, i, t, g, p, b, _ in rules
    )
    return f"""
rules(ord, rule_id, type, region, priority, basis) AS (VALUES {meta}),
raw AS ({raw}),
spots AS (
  SELECT doc_id, t, ord, m[u.i] AS source,
    CAST(list_sum(list_transform(g[1:u.i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:u.i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM raw, unnest(range(1, len(m) + 1)) AS u(i)
),
placed AS (SELECT *, s + length(source) AS e FROM spots),
seen AS (SELECT *, lower({_window(40)}) AS low FROM placed),
hinted AS (SELECT *, CASE ord {hits} ELSE 0 END AS hits FROM seen),
cand AS (
  SELECT doc_id, t, ord, source, s, e, rule_id, type, CAST(region AS STRING) AS region, priority, basis,
    least(0.99, (priority + 5 * hits) / 100.0) AS confidence
  FROM hinted JOIN rules USING (ord)
  WHERE CASE WHEN ord <= 5 THEN regexp_matches({_window(48)}, '{PERSON}')
    WHEN ord = 7 THEN {phone('source')} WHEN ord = 8 THEN {ipv4('source')} WHEN ord IN (9, 10) THEN {ipv6('source')}
    WHEN ord IN (14, 15, 16) THEN regexp_matches({_window(72)}, '{ADDRESS}')
    WHEN ord = 17 THEN {card('source')} WHEN ord >= 23 THEN hits > 0 ELSE true END
)"""


def _sweep(name: str, src: str) -> str:
    """CTEs resolving ``src(doc_id, s, e, priority, ord, ...)`` into ``name``."""
    return f"""
{name}_q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e DESC, priority DESC, ord) AS rn FROM {src}),
{name}_w AS (
  SELECT doc_id, rn, [{{'s': s, 'e': e, 'p': priority, 'rn': rn}}] AS acc FROM {name}_q WHERE rn = 1
  UNION ALL
  SELECT q.doc_id, q.rn,
    CASE WHEN len(list_filter(w.acc, lambda a: q.s < a.e AND q.e > a.s AND q.priority <= a.p)) > 0 THEN w.acc
    ELSE list_append(list_filter(w.acc, lambda a: NOT (q.s < a.e AND q.e > a.s)), {{'s': q.s, 'e': q.e, 'p': q.priority, 'rn': q.rn}}) END
  FROM {name}_w w JOIN {name}_q q ON q.doc_id = w.doc_id AND q.rn = w.rn + 1
),
{name}_k AS (
  SELECT doc_id, unnest(list_transform(arg_max(acc, rn), lambda a: a.rn)) AS rn FROM {name}_w GROUP BY doc_id
),
{name} AS (SELECT q.* FROM {name}_q q JOIN {name}_k k ON k.doc_id = q.doc_id AND k.rn = q.rn)"""


def pad(n: str, width: int) -> str:
    return f"lpad(CAST({n} AS STRING), CAST(greatest(length(CAST({n} AS STRING)), {width}) AS INT), '0')"


def synthetic(type_: str, n: str, region: str, source: str) -> str:
    k = f"({n} - 1)"
    day, month, year = pad(f"({k} % 28 + 1)", 2), pad(f"(({k} // 2) % 12 + 1)", 2), f"CAST({k} % 25 + 1990 AS STRING)"
    sep = f"regexp_extract({source}, '([./-])', 1)"
    same = f"{sep} = regexp_extract({source}, '([./-])[0-9]+$', 1)"
    return f"""CASE {type_} WHEN 'USER' THEN 'USER_' || {n} WHEN 'EMAIL' THEN 'user' || {n} || '@example.test'
 WHEN 'PHONE' THEN '+0000000' || {pad(n, 4)} WHEN 'IP' THEN '10.0.0.' || least(254, {n}) WHEN 'ADDRESS' THEN 'ADDRESS_' || {n}
 WHEN 'CARD' THEN '4111 **** **** ' || {pad(f"((1000 + {n}) % 10000)", 4)} WHEN 'IBAN' THEN 'DE00TEST0000000000' || {pad(n, 4)}
 WHEN 'SWIFT_BIC' THEN 'FAKE' || {pad(n, 4)} WHEN 'ACCOUNT' THEN '***************' || {pad(n, 5)}
 WHEN 'DOC_ID' THEN coalesce({region}, 'XX') || '-DOC-' || {pad(n, 5)} WHEN 'PERSON' THEN 'PERSON_' || {n} WHEN 'ORG' THEN 'ORG_' || {n}
 WHEN 'DATE' THEN CASE WHEN {same} AND regexp_full_match({source}, '[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{4}}') THEN {day} || {sep} || {month} || {sep} || {year}
   WHEN {same} AND regexp_full_match({source}, '[0-9]{{4}}[./-][0-9]{{1,2}}[./-][0-9]{{1,2}}') THEN {year} || {sep} || {month} || {sep} || {day}
   ELSE '01.01.1990' END
 ELSE 'REDACTED_' || {n} END"""


def _numbered(src: str, mode: str) -> str:
    value = "'[' || type || '_' || n || ']'" if mode == "tag" else synthetic("type", "n", "region", "source")
    return f"""
firsts AS (SELECT *, min(s) OVER (PARTITION BY doc_id, type, region, source) AS first_s FROM {src}),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, type ORDER BY first_s) AS n FROM firsts),
named AS (SELECT *, {value} AS replacement FROM ranked)"""


def _rewritten(src: str = "named", value: str = "replacement") -> str:
    return f"""
pieces AS (SELECT doc_id, s, e, substring(t, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) + 1,
  s - coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0)) || {value} AS piece FROM {src}),
joined AS (SELECT doc_id, string_agg(piece, '' ORDER BY s) AS head, max(e) AS last FROM pieces GROUP BY doc_id),
masked AS (SELECT d.doc_id, d.t, CASE WHEN j.doc_id IS NULL THEN d.t ELSE j.head || substring(d.t, j.last + 1) END AS masked_text
  FROM docs d LEFT JOIN joined j ON j.doc_id = d.doc_id)"""


def pipeline(docs: str, *, mode: str = "tag", regions: str = "RU AM EU", catalogue: list = RULES, **clean: str) -> str:
    """WITH clause up to ``masked`` over a source of documents."""
    rules = [r for r in catalogue if r[3] is None or r[3] in regions.split()]
    return "WITH RECURSIVE " + ", ".join(
        [_clean(docs, **clean), _candidates(rules), _sweep("resolved", "cand"), _numbered("resolved", mode), _rewritten()]
    )


_SPAN_FIELDS = (
    "doc_id, type || '_' || s || '_' || e AS entity_id, type, s AS start, e AS \"end\", source, rule_id, region, confidence, "
    "basis AS confidence_basis, CASE WHEN region IS NULL THEN 'universal' ELSE 'regional' END AS detector_source, CAST(priority AS BIGINT) AS priority"
)
_ENTITY = "type || '_' || s || '_' || e"
_PAIRS = (
    "pairs AS (SELECT DISTINCT doc_id, type AS entity_type, 'system' AS origin, source, replacement, region, rule_id FROM named)"
)


def _rule(number: int, docs: str) -> str:
    rules = [r for r in RULES if r[0] == number]
    head = "WITH " + ", ".join([_clean(f"SELECT doc_id, text FROM ({docs})"), _candidates(rules)])
    return f'{head} SELECT doc_id, s AS start, e AS "end", source, confidence FROM cand'


def _extended(rule: tuple) -> tuple:
    """Rules of the extended profile; its Cyrillic addresses want a word's edge, which forms do not have, so they are left out."""
    if rule[0] == 10:
        return (*rule[:6], rf"(?i)(?:{_H}{{1,4}}(?::{_H}{{1,4}}){{0,6}})?::(?:{_H}{{1,4}}(?::{_H}{{1,4}}){{0,6}})?")
    return (*rule[:4], 86, *rule[5:]) if rule[0] == 23 else rule


_EXTENDED = [_extended(r) for r in RULES if r[0] not in (11, 15)]
_FORMS2 = f"SELECT doc_id, text FROM ({FORMS})"
_TYPES = "['USER','EMAIL','PHONE','IP','ADDRESS','CARD','IBAN','SWIFT_BIC','ACCOUNT','DOC_ID','PERSON','ORG','DATE','OTHER']"
_RAW_SPANS = """SELECT l_orderkey AS doc_id, l_linenumber AS ord, l_partkey % 40 AS s, l_partkey % 40 + 1 + l_suppkey % 15 AS e,
 60 + 5 * (l_suppkey % 7) AS priority FROM lineitem"""
_RESOLVE = (
    f"WITH RECURSIVE raw AS ({_RAW_SPANS}), {_sweep('kept', 'raw')} "
    'SELECT doc_id, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", CAST(priority AS BIGINT) AS priority FROM kept'
)
_USER_RULES = [("thing", "USER"), ("ing th", "ORG"), ("example.com", "ORG"), ("er", "PERSON"), ("tion on", "USER"), ("absent!", "USER")]


_RULE_VALUES = "VALUES " + ", ".join(f"({i}, '{s}', '{t}')" for i, (s, t) in enumerate(_USER_RULES))


_IMPORTED = f"""WITH n AS ({NOTES}), hits AS (
 SELECT n.doc_id, 1 AS slot, a.c_custkey AS k, a.c_name AS name, length('order ' || n.doc_id || ' of ') AS s FROM n JOIN customer a ON a.c_custkey = n.o_custkey
 UNION ALL SELECT n.doc_id, 2, b.c_custkey, b.c_name, length('order ' || n.doc_id || ' of ') + 28 FROM n JOIN customer b ON b.c_custkey = (n.o_custkey * 7) % 100),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, s) AS i FROM hits)"""


def _user_rules(docs: str = DOCS, rules: str = _RULE_VALUES) -> str:
    return pipeline(docs) + f""",
user_rules(o, literal, utype) AS ({rules}),
gaps AS (SELECT doc_id, t, o, literal, utype, string_split(t, literal) AS g FROM docs JOIN user_rules ON contains(t, literal)),
manual AS (SELECT doc_id, t, o, literal, utype, CAST(list_sum(list_transform(g[1:u.i], lambda x: length(x))) + (u.i - 1) * length(literal) AS BIGINT) AS s
  FROM gaps, unnest(range(1, len(g))) AS u(i)),
both_kinds AS (
  SELECT doc_id, t, s, e, priority, ord, type, region, source, rule_id, replacement FROM named
  UNION ALL SELECT doc_id, t, s, s + length(literal), 1000, 1000 + o, utype, NULL, literal, 'manual.selection', NULL FROM manual),
{_sweep('merged', 'both_kinds')},
m_first AS (SELECT *, min(s) OVER (PARTITION BY doc_id, type, source) AS fs FROM merged),
filled AS (SELECT * REPLACE (coalesce(replacement, '[' || type || '_' || dense_rank() OVER (PARTITION BY doc_id, type ORDER BY fs) || ']') AS replacement) FROM m_first),
{_rewritten('filled').replace('pieces AS', 'pieces2 AS').replace('FROM pieces', 'FROM pieces2').replace('joined AS', 'joined2 AS').replace('JOIN joined', 'JOIN joined2').replace('masked AS', 'masked2 AS')}"""


ORACLE: dict[str, str] = {
    **{f"rule_{r[1].replace('.', '_')}": _rule(r[0], FORMS) for r in RULES},
    "documents_email": _rule(6, DOCS),
    "documents_phone": _rule(7, DOCS),
    "documents_ipv4": _rule(8, DOCS),
    "documents_card": _rule(17, DOCS),
    "documents_swiftbic": _rule(19, DOCS),
    "mask_documents_tag": pipeline(DOCS) + " SELECT doc_id, masked_text FROM masked",
    "mask_documents_synthetic": pipeline(DOCS, mode="synthetic") + " SELECT doc_id, masked_text FROM masked",
    "mask_forms_tag": pipeline(_FORMS2) + " SELECT doc_id, masked_text FROM masked",
    "mask_forms_synthetic": pipeline(_FORMS2, mode="synthetic") + " SELECT doc_id, masked_text FROM masked",
    "normalise_text": "SELECT doc_id, replace(replace(text, chr(160), ' '), chr(13) || chr(10), chr(10)) AS clean_text FROM documents",
    "detect_documents": pipeline(DOCS) + f" SELECT {_SPAN_FIELDS} FROM resolved",
    "detect_forms": pipeline(_FORMS2) + f" SELECT {_SPAN_FIELDS} FROM resolved",
    "detect_forms_ru_only": pipeline(_FORMS2, regions="RU") + f" SELECT {_SPAN_FIELDS} FROM resolved",
    "mask_conversations": pipeline("SELECT conv_id * 1000000 + turn AS doc_id, text FROM conversations")
    + " SELECT doc_id // 1000000 AS conv_id, doc_id % 1000000 AS turn, masked_text FROM masked",
    "mask_pages": pipeline("SELECT page_id, html FROM pages", key="page_id", text="html")
    + " SELECT doc_id AS page_id, masked_text FROM masked",
    "mapping_table": pipeline(DOCS)
    + f' SELECT doc_id, {_ENTITY} AS entity_id, type, region, source, replacement, rule_id, confidence, s AS start, e AS "end", true AS enabled FROM named',
    "validators": f"""WITH v AS (SELECT o_orderkey,
 concat('4', lpad(CAST(o_orderkey AS STRING), 9, '0'), CAST(1000 + o_custkey % 997 AS STRING)) AS card,
 concat('+', CAST(o_orderkey * 7919 AS STRING), ' ', CAST(o_custkey AS STRING)) AS phone,
 concat(CAST(o_custkey % 300 AS STRING), '.', CAST(o_orderkey % 257 AS STRING), '.0.1') AS ip,
 concat(CAST(o_orderkey % 34 AS STRING), '/', CAST(o_custkey % 14 AS STRING), '/', CAST(year(o_orderdate) AS STRING)) AS day FROM orders)
SELECT o_orderkey, {luhn('card')} AS luhn, {card('card')} AS card, {phone('phone')} AS phone, {ipv4('ip')} AS ipv4,
 regexp_full_match(day, '{DATE_SHAPE}') AS date_like FROM v""",
    "replacement_templates": f"""WITH r AS (SELECT o_orderkey, ({_TYPES})[CAST(o_orderkey % 14 + 1 AS INT)] AS type, o_custkey + 1 AS n,
 CASE WHEN o_orderkey % 3 = 0 THEN 'EU' END AS region,
 concat_ws(CASE o_orderkey % 3 WHEN 0 THEN '.' WHEN 1 THEN '/' ELSE '-' END, CAST(day(o_orderdate) AS STRING), CAST(month(o_orderdate) AS STRING), CAST(year(o_orderdate) AS STRING)) AS source FROM orders)
SELECT o_orderkey, '[' || type || '_' || n || ']' AS tag, {synthetic('type', 'n', 'region', 'source')} AS synthetic, n AS tag_index,
 CASE WHEN type IN ('USER', 'PERSON', 'ORG', 'EMAIL') THEN n WHEN type = 'PHONE' AND n <= 9999 THEN n END AS synthetic_index FROM r""",
    "literal_occurrences": """WITH g AS (SELECT doc_id, string_split(text, 'thth') AS g FROM documents WHERE contains(text, 'thth')),
o AS (SELECT doc_id, CAST(list_sum(list_transform(g[1:u.i], lambda x: length(x))) + (u.i - 1) * 4 AS BIGINT) AS start FROM g, unnest(range(1, len(g))) AS u(i))
SELECT doc_id, start, start + 4 AS "end" FROM o""",
    "resolve_overlaps_table": _RESOLVE,
    "resolve_overlaps_array": _RESOLVE,
    "gap_fill": """WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber * 1000000 + l_partkey AS start, CASE WHEN l_suppkey % 2 = 0 THEN 'EMAIL' ELSE 'DOC_ID' END AS type,
 CAST(l_partkey % 9 AS STRING) AS source, l_partkey % 9 AS v FROM lineitem),
g AS (SELECT *, CASE WHEN v % 3 = 0 THEN v // 3 * 2 + 1 END AS idx, min(start) OVER (PARTITION BY doc_id, type, source) AS first_start FROM r),
fresh AS (SELECT DISTINCT doc_id, type, source, first_start FROM g WHERE v % 3 <> 0 AND v <> 4),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY first_start) AS k FROM fresh),
free AS (SELECT d.doc_id, d.type, u.i, row_number() OVER (PARTITION BY d.doc_id, d.type ORDER BY u.i) AS k
 FROM (SELECT DISTINCT doc_id, type FROM k) d, unnest(range(1, 30)) AS u(i)
 WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = d.doc_id AND g.type = d.type AND g.idx = u.i)),
made AS (SELECT k.doc_id, k.type, k.source, free.i FROM k JOIN free ON free.doc_id = k.doc_id AND free.type = k.type AND free.k = k.k)
SELECT g.doc_id, CAST(g.start AS BIGINT) AS start, g.type, g.source,
 CASE WHEN g.idx IS NOT NULL THEN '[' || g.type || '_' || g.idx || ']' WHEN g.v = 4 THEN 'odd' ELSE '[' || g.type || '_' || made.i || ']' END AS replacement
FROM g LEFT JOIN made ON made.doc_id = g.doc_id AND made.type = g.type AND made.source = g.source""",
    "user_rules_merge": _user_rules() + " SELECT doc_id, masked_text FROM masked2",
    "user_rules_merge_joined": _user_rules() + " SELECT doc_id, masked_text FROM masked2",
    **{
        f"user_rules_null_ids_{strategy}": _user_rules()
        + " SELECT CASE WHEN doc_id % 5 <> 0 THEN doc_id - doc_id % 2 END AS doc_id, masked_text FROM masked2"
        for strategy in ("joined", "constant")
    },
    "user_rules_spans": _user_rules()
    + f" SELECT doc_id, CASE WHEN rule_id = 'manual.selection' THEN 'MANUAL_' ELSE '' END || {_ENTITY} AS entity_id, type, s AS start, e AS \"end\", source, rule_id, replacement FROM filled",
    "user_rules_long_list": _user_rules(MAIL_NOTES, "SELECT c_custkey, c_name, 'USER' FROM customer") + " SELECT doc_id, masked_text FROM masked2",
    "rule_table_edits": """WITH r AS (SELECT DISTINCT event_type AS source, CASE WHEN user_id % 2 = 0 THEN 'ORG' ELSE 'USER' END AS type FROM events),
c AS (SELECT DISTINCT source, CASE WHEN type = 'ORG' AND source < 'd' THEN 'PERSON' ELSE type END AS type FROM r)
SELECT source, type FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.source = c.source AND r.type = c.type AND r.type = 'USER' AND r.source >= 'p')""",
    "review_groups": pipeline(_FORMS2)
    + """ SELECT doc_id, type, source, count(*) AS members, min(s) AS first_start, coalesce(arg_min_null(region, s), 'Global') AS heading,
 doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS all_disabled FROM named GROUP BY doc_id, type, source""",
    "frequencies": pipeline(DOCS) + " SELECT type, source, count(*) AS n FROM named GROUP BY type, source",
    "present_types_and_regions": pipeline(_FORMS2)
    + " SELECT DISTINCT 'type' AS what, type AS value FROM named UNION ALL SELECT DISTINCT 'region', region FROM named WHERE region IS NOT NULL",
    "review_filter": pipeline(_FORMS2) + f" SELECT doc_id, {_ENTITY} AS entity_id, source FROM named WHERE type = 'DOC_ID' AND region = 'EU'",
    "total_detections": pipeline(DOCS)
    + " SELECT d.doc_id, count(named.doc_id) AS detections FROM docs d LEFT JOIN named ON named.doc_id = d.doc_id GROUP BY d.doc_id",
    "switch_local": pipeline(DOCS) + f" SELECT doc_id, {_ENTITY} AS entity_id FROM named WHERE type IN ('EMAIL', 'IP')",
    "switch_everywhere": pipeline(_FORMS2)
    + f""", targets AS (SELECT doc_id, source, NOT (type = 'DOC_ID' AND doc_id % 4 = 3) AS switch_off FROM named WHERE s = 9),
state AS (SELECT n.doc_id, {_ENTITY} AS entity_id, n.type = 'DOC_ID' AND n.doc_id % 4 = 3 AS off, g.switch_off
 FROM named n LEFT JOIN targets g ON g.doc_id = n.doc_id AND g.source = n.source)
SELECT doc_id, entity_id FROM state WHERE coalesce(switch_off, off)""",
    "masked_with_switches": "WITH RECURSIVE " + ", ".join(
        [_clean(DOCS), _candidates(RULES), _sweep("resolved", "cand"), _numbered("resolved", "tag"),
         _rewritten(value="CASE WHEN type IN ('CARD', 'IP') THEN source ELSE replacement END")]
    ) + " SELECT doc_id, masked_text FROM masked",
    "collect_pairs": pipeline(DOCS) + " SELECT DISTINCT type AS entity_type, 'system' AS origin, replacement AS source, source AS replacement, region, rule_id FROM named",
    "export_pairs": pipeline(DOCS) + f", {_PAIRS}" + """ SELECT doc_id, '{"schemaVersion":"2.0","generatedAt":"2024-01-01T00:00:00.000Z","total":' || count(*) || ',"rules":[' ||
 string_agg('{"entityType":"' || entity_type || '","origin":"system","source":' || CAST(to_json(source) AS STRING) || ',"replacement":"' || replacement || '"'
 || CASE WHEN region IS NULL THEN '' ELSE ',"region":"' || region || '"' END || ',"ruleId":"' || rule_id || '"}', ',' ORDER BY entity_type, source, replacement, region NULLS FIRST, rule_id) || ']}' AS rules_json
FROM pairs GROUP BY doc_id
UNION ALL SELECT doc_id, '{"schemaVersion":"2.0","generatedAt":"2024-01-01T00:00:00.000Z","total":0,"rules":[]}' FROM docs
WHERE doc_id NOT IN (SELECT doc_id FROM pairs)""",
    "import_pairs": pipeline(DOCS) + f", {_PAIRS}" + """ SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY entity_type, source, replacement, region NULLS FIRST, rule_id) - 1 AS ord,
 entity_type, origin, source, replacement, region, rule_id FROM pairs""",
    "apply_list_forward": f"""WITH n AS ({NOTES}) SELECT n.doc_id, 'order ' || n.doc_id || ' of ' || coalesce('<C' || a.c_custkey || '>', 'Customer#' || lpad(CAST(o_custkey AS STRING), 9, '0'))
 || ', copy to ' || coalesce('<C' || b.c_custkey || '>', 'Customer#' || lpad(CAST((o_custkey * 7) % 100 AS STRING), 9, '0')) || '; not Customer#' || o_custkey AS masked_text,
 CAST((a.c_custkey IS NOT NULL)::INT + (b.c_custkey IS NOT NULL)::INT AS BIGINT) AS applied,
 (SELECT count(*) FROM customer) - (a.c_custkey IS NOT NULL)::INT - (b.c_custkey IS NOT NULL AND coalesce(a.c_custkey, -1) <> b.c_custkey)::INT AS skipped
FROM n LEFT JOIN customer a ON a.c_custkey = n.o_custkey LEFT JOIN customer b ON b.c_custkey = (n.o_custkey * 7) % 100""",
    "imported_mapping": f"""{_IMPORTED} SELECT doc_id, 'IMPORTED_' || i AS entity_id, 'USER' AS type, CAST(NULL AS VARCHAR) AS region, name AS source,
 '<C' || k || '>' AS replacement, 'imported.' || CASE WHEN k % 2 = 0 THEN 'user' ELSE 'system' END AS rule_id, CAST(1 AS DOUBLE) AS confidence,
 s AS start, s + 18 AS "end", true AS enabled FROM numbered""",
    "imported_switches": f"""{_IMPORTED} SELECT n.doc_id, 'order ' || n.doc_id || ' of ' || CASE WHEN x.i > 1 THEN '<C' || x.k || '>' ELSE 'Customer#' || lpad(CAST(o_custkey AS STRING), 9, '0') END
 || ', copy to ' || CASE WHEN y.i > 1 THEN '<C' || y.k || '>' ELSE 'Customer#' || lpad(CAST((o_custkey * 7) % 100 AS STRING), 9, '0') END || '; not Customer#' || o_custkey AS masked_text
FROM n LEFT JOIN numbered x ON x.doc_id = n.doc_id AND x.slot = 1 LEFT JOIN numbered y ON y.doc_id = n.doc_id AND y.slot = 2""",
    "pairs_order": pipeline(_FORMS2) + f", {_PAIRS}" + """ SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY entity_type, source, replacement, region NULLS FIRST, rule_id) - 1 AS ord,
 entity_type, origin, source, replacement, region, rule_id FROM pairs""",
    "import_refusals": "SELECT o_orderkey, o_orderkey % 9 > 1 AS refused FROM orders",
    "extended_profile_forms": pipeline(_FORMS2, catalogue=_EXTENDED) + f" SELECT {_SPAN_FIELDS} FROM resolved",
    "registered_rule": f"""WITH n AS ({NOTES})
SELECT doc_id, length('order ' || doc_id || ' of ') AS start, 'Customer#' || lpad(CAST(o_custkey AS STRING), 9, '0') AS source, 'custom.quoted' AS rule_id FROM n
UNION ALL SELECT doc_id, length('order ' || doc_id || ' of ') + 28, 'Customer#' || lpad(CAST((o_custkey * 7) % 100 AS STRING), 9, '0'), 'custom.quoted' FROM n""",
    "blank_texts": "SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' ' || chr(10) || ' ' END AS masked_text, CAST(0 AS BIGINT) AS n FROM orders",
    "span_ids": f"""SELECT doc_id, CAST(ord AS BIGINT) AS ord, CASE WHEN ord % 2 = 0 THEN 'GIVEN_' || ord ELSE 'USER_' || s || '_' || e END AS entity_id FROM ({_RAW_SPANS})""",
    "apply_list_summary": f"""SELECT count(*) AS documents, CAST(sum((length(text) - length(replace(text, 'Customer#', ''))) // 9) AS BIGINT) AS applied,
 count(*) FILTER (WHERE contains(text, 'Customer#')) AS documents_changed FROM ({NOTES})""",
    "apply_scoped_reverse": pipeline(_FORMS2)
    + """, c AS (SELECT doc_id, count(*) AS applied FROM named GROUP BY doc_id)
SELECT d.doc_id, d.t AS restored_text, coalesce(c.applied, 0) AS applied, CAST(0 AS BIGINT) AS skipped FROM docs d LEFT JOIN c ON c.doc_id = d.doc_id""",
    "restore_documents": "SELECT doc_id, replace(replace(text, chr(160), ' '), chr(13) || chr(10), chr(10)) AS restored_text FROM documents",
    "roundtrip_audit": "SELECT count(*) AS documents, count(*) AS equal, CAST(0 AS BIGINT) AS different FROM documents",
    "pii_profile": pipeline(DOCS)
    + """ SELECT d.lang, type, rule_id, count(*) AS detections, count(DISTINCT named.source) AS distinct_values, round(avg(confidence), 4) AS mean_confidence
FROM named JOIN documents d ON d.doc_id = named.doc_id GROUP BY d.lang, type, rule_id""",
    "pii_rollup": pipeline(DOCS)
    + " SELECT d.lang, type, count(*) AS detections FROM named JOIN documents d ON d.doc_id = named.doc_id GROUP BY ROLLUP (d.lang, type)",
    "documents_with_pii": pipeline(DOCS)
    + """, c AS (SELECT doc_id, count(*) AS k FROM named GROUP BY doc_id)
SELECT d.lang, count(*) AS documents, count(c.k) AS with_pii, CAST(coalesce(sum(c.k), 0) AS BIGINT) AS detections FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.lang""",
    "corpus_pseudonyms": "WITH RECURSIVE " + ", ".join(
        [_clean(DOCS), _candidates(RULES), _sweep("resolved", "cand"),
         """keys AS (SELECT type, region, source, min(doc_id * 1000000000 + s) AS first FROM resolved GROUP BY type, region, source),
numbers AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY first) AS n FROM keys),
named AS (SELECT r.*, '[' || r.type || '_' || k.n || ']' AS replacement FROM resolved r JOIN numbers k
  ON k.type = r.type AND k.source = r.source AND k.region IS NOT DISTINCT FROM r.region)""",
         _rewritten()]
    ) + " SELECT doc_id, masked_text FROM masked",
    "stream_mask": pipeline(DOCS) + " SELECT doc_id, masked_text FROM masked",
}

ORACLE |= {
    "restore_synthetic": ORACLE["restore_documents"],
    "restore_forms_synthetic": f"SELECT doc_id, replace(replace(text, chr(160), ' '), chr(13) || chr(10), chr(10)) AS restored_text FROM ({_FORMS2})",
    "roundtrip_audit_positions": "SELECT count(*) AS documents, count(*) AS equal, CAST(0 AS BIGINT) AS different FROM orders",
    # Every note holds an address, so its old [EMAIL_1] is taken for the new one.
    "roundtrip_audit_tags": "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS equal, count(*) AS different FROM orders",
    "pii_profile_merged": ORACLE["pii_profile"],
    "restore_bucketed": ORACLE["restore_documents"],
    "import_pairs_once": ORACLE["import_pairs"],
    "stream_mapping": ORACLE["mapping_table"],
    "stream_restore": ORACLE["restore_documents"],
}

# The parts of a register entry that the extended profile detects: place in REGISTER_PARTS, type, region, rule, priority, basis, confidence.
_REGISTER = [(1, "ADDRESS", None, "universal.address.ru.street_house", 86, "strict-structure", 0.86),
             (3, "ADDRESS", None, "universal.address.ru.postcode_city", 80, "postcode+locality+context", 0.8),
             (5, "IP", None, "universal.ipv6.compressed", 87, "format+validator", 0.87),
             (7, "DOC_ID", "RU", "ru.passport.series_number", 86, "format+context", 0.91)]


def _register() -> str:
    rows = " UNION ALL ".join(
        f"SELECT o_orderkey AS doc_id, '{kind}' AS type, length(concat({', '.join(REGISTER_PARTS[:at])})) AS s, {REGISTER_PARTS[at]} AS source, "
        f"'{rule}' AS rule_id, {'NULL' if region is None else repr(region)}::VARCHAR AS region, {sure}::DOUBLE AS confidence, '{basis}' AS basis, {priority} AS priority FROM orders"
        for at, kind, region, rule, priority, basis, sure in _REGISTER
    )
    return f"SELECT {_SPAN_FIELDS} FROM (SELECT *, s + length(source) AS e FROM ({rows}))"


_NULLED = "CASE WHEN doc_id % 3 <> 0 THEN doc_id END AS doc_id, doc_id AS nr"
ORACLE["corpus_pseudonyms_over_runs"] = ORACLE["corpus_pseudonyms"].replace(
    "min(doc_id * 1000000000 + s) AS first", "coalesce(min(doc_id * 1000000000 + s) FILTER (doc_id % 2 = 0), 1000000000000000000 + min(doc_id * 1000000000 + s)) AS first"
)
ORACLE |= {
    "extended_profile_register": _register(),
    "switch_sequence": pipeline(_FORMS2)
    + f""", x AS (SELECT doc_id, {_ENTITY} AS entity_id, source, s, min(s) OVER d AS low, max(s) OVER d AS high, arg_min(source, s) OVER d AS first_source,
 type = 'DOC_ID' AND doc_id % 4 = 3 AS off, arg_min(type = 'DOC_ID', s) OVER d AND doc_id % 4 = 3 AS first_off FROM named WINDOW d AS (PARTITION BY doc_id)),
y AS (SELECT *, CASE WHEN source <> first_source THEN off WHEN s = low AND doc_id % 2 = 1 THEN first_off ELSE NOT first_off END AS then_off FROM x)
SELECT {_NULLED}, entity_id FROM y WHERE then_off <> (s = high AND s <> low)""",
    "masked_with_null_ids": "WITH RECURSIVE " + ", ".join(
        [_clean(_FORMS2), _candidates(RULES), _sweep("resolved", "cand"), _numbered("resolved", "tag"),
         _rewritten(value="CASE WHEN type IN ('DOC_ID', 'DATE') THEN source ELSE replacement END")]
    ) + f" SELECT {_NULLED}, masked_text FROM masked",
    "imported_user_rules": _user_rules() + " SELECT DISTINCT doc_id, trim(source) AS source, type FROM filled WHERE rule_id = 'manual.selection'",
    "export_after_reverse": """SELECT DISTINCT 'USER' AS entity_type, c_name AS source, '<C' || c_custkey || '>' AS replacement
FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders UNION ALL SELECT o_custkey * 7 % 100 FROM orders)""",
}
