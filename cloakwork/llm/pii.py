"""Personal data: patterns propose, checksums confirm, nearby words adjust the score.

1. Each kind has a pattern that proposes spans, leftmost and without overlaps inside the kind.
2. A validator looks at every proposal: Luhn for cards, mod-97 and the country's length for bank accounts
   (IBAN), the 3-7-1 sum for routing numbers, octets, digit counts and issued ranges for the others.  A proposal that fails is
   dropped; the search goes on behind it.
3. A confirmed span starts with its kind's prior.  Words that speak for the kind within :data:`WINDOW` characters on
   either side raise the score, words that speak against it lower it.

The kinds of :data:`BASE` are always reported, with their scores; the others only from :data:`THRESHOLD` on, so a
number that merely has the shape of a social security or routing number needs a word beside it.

Places are code points, the end exclusive.  Everything stays inside the row's task: no shuffle.

Defined cases: a null or empty text has no spans; repeated rows each get their row; an empty table gives an empty
result; very long texts are searched whole, in time linear in their length.  Only the id and text columns are read, so
clashing names of others do not matter.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm.common import LOWER, UPPER, ship, table, text_or_empty

# The kinds that are always reported, in their order in digests.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "routing")
# Patterns, as plain as they are defined.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z][A-Z][0-9][0-9](\x20?[A-Z0-9])+",
    "ssn": r"[0-9]+(-[0-9]+)+",
    "routing": r"[0-9]+",
}
# Characters of an account number of each country, country and check digits included.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31,
    "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
WINDOW = 40
THRESHOLD, FOR, AGAINST = 0.6, 0.25, 0.3
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.9, "ssn": 0.4, "routing": 0.4}
WORDS_FOR = {
    "email": ("mail", "e-mail", "email", "contact", "write", "correo", "kontakt"),
    "ip": ("ip", "address", "host", "client", "login", "logged"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "tarjeta", "karte", "carte"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "whatsapp", "telefon", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "taxpayer", "itin"),
    "routing": ("routing", "aba", "transit", "rtn"),
}
WORDS_AGAINST = ("example", "sample", "placeholder", "isbn", "version", "invoice", "order")
SPAN = "array<struct<start:bigint,end:bigint,kind:string,score:double>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))

_LOCAL = string.ascii_letters + string.digits + "._%+-"
_ALNUM = frozenset(string.ascii_letters + string.digits)
# The same matches as PATTERNS, written so that no text makes them start over: runs are taken whole, and not entered in their middle.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){11,}+")  # fewer digits are no card, and no chain of digits is entered in its middle with more
_PHONE = re.compile(PATTERNS["phone"])
_IBAN = re.compile(r"[A-Z][A-Z][0-9][0-9](?:\x20?[A-Z0-9])++")
_SSN = re.compile(r"(?<![0-9])(?<![0-9]-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-?[0-9])")  # the only chains that can pass
_ROUTING = re.compile(r"(?<![0-9])[0-9]{9}(?![0-9])")


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[::-2]))) % 10 == 0


def mod97(account: str) -> bool:
    """ISO 7064 check of an account number without spaces."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def routing_sum(digits: str) -> bool:
    return sum(w * int(d) for w, d in zip((3, 7, 1) * 3, digits, strict=True)) % 10 == 0


def _alone(text: str, start: int, end: int) -> bool:
    """No ASCII letter or digit touches the span."""
    return not (start and text[start - 1] in _ALNUM) and not (end < len(text) and text[end] in _ALNUM)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in _DOMAIN.finditer(text):
        before = text[done : m.start()]
        start = done + len(before.rstrip(_LOCAL))
        if start < m.start():
            done = m.end()
            yield start, done


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(m[0].count, string.digits)) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        size, seen = IBAN_LENGTHS.get(m[0][:2], 0), 0
        account = m[0][: 2 * size].replace(" ", "")[:size]
        if size and len(account) == size and mod97(account):
            for end, c in enumerate(m[0], m.start() + 1):
                seen += c != " "
                if seen == size:
                    if _alone(text, m.start(), end):
                        yield m.start(), end
                    break


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000" and _alone(text, *m.span()):
            yield m.span()


def _routings(text: str) -> Iterator[tuple[int, int]]:
    for m in _ROUTING.finditer(text):
        if m[0] != "0" * 9 and routing_sum(m[0]) and _alone(text, *m.span()):
            yield m.span()


_FINDERS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = dict(
    zip(KINDS, (_emails, _ips, _cards, _phones, _ibans, _ssns, _routings), strict=True)
)


def _any_word(words: tuple[str, ...]) -> str:
    return rf"(?:^|[^a-z])(?:{'|'.join(words)})(?:[^a-z]|$)"


_NEAR = {kind: re.compile(_any_word(words)) for kind, words in WORDS_FOR.items()}
_NOT = re.compile(_any_word(WORDS_AGAINST))
_TO_LOWER = str.maketrans(UPPER, LOWER)


def score(text: str, kind: str, start: int, end: int) -> float:
    """Prior of the kind, and what the words on either side add or take."""
    beside = [text[max(0, start - WINDOW) : start].translate(_TO_LOWER), text[end : end + WINDOW].translate(_TO_LOWER)]
    value = PRIOR[kind] + FOR * any(map(_NEAR[kind].search, beside)) - AGAINST * any(map(_NOT.search, beside))
    return min(1.0, max(0.0, value))


def find(text: str) -> list[tuple[int, int, str, float]]:
    """All reported spans of a text, by start and then kind."""
    spans = []
    for order, (kind, finder) in enumerate(_FINDERS.items()):
        for start, end in finder(text):
            value = score(text, kind, start, end)
            if order < len(BASE) or value >= THRESHOLD:
                spans.append((start, order, end, kind, value))
    return [(start, end, kind, value) for start, _, end, kind, value in sorted(spans)]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, spans`` per row: structs of ``start, end, kind, score``, by start and then kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("start", "end", "kind", "score")
        for batch in batches:
            spans = [[dict(zip(names, s, strict=True)) for s in find(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPAN)], names=["id", "spans"])

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, spans {SPAN}")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = THRESHOLD) -> DataFrame:
    """``id, text`` per row, where ``<kind>`` stands for every span that scores ``least`` or more; of overlapping ones the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(1):
                text, parts, at = value.as_py(), [], 0
                for start, end, kind, mark in find(text):
                    if mark >= least and start >= at:
                        parts += (text[at:start], f"<{kind}>")
                        at = end
                out.append("".join(parts) + text[at:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["id", "text"])

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, text string")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: counts and a digest of the fixed kinds, and all spans with their scores."""
    found = find_pii(table(spark, sf_dir, "documents"))

    def digest(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of(kind)).cast("bigint").alias(f"n_{kind}") for kind in BASE]
    scores = F.array_join(F.transform("spans", lambda s: F.round(100 * s["score"]).cast("int").cast("string")), ",")
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(digest(of(*BASE)).cast("binary"), 256).alias("base_sha256"),
                        digest(F.col("spans")).alias("spans"), scores.alias("scores_percent"))


def _oracle() -> str:
    def digits(x: str) -> str:
        return f"regexp_replace({x}, '[^0-9]', '', 'g')"

    def weighed(x: str, weight: str) -> str:
        return f"list_sum(list_transform(range(1, length({x}) + 1), lambda j: {weight}))"

    d, octet = digits("found"), "regexp_replace(o, '^0+', '')"
    twice = f"(CAST(substr({d}, length({d}) + 1 - j, 1) AS INT) * CASE WHEN j % 2 = 0 THEN 2 ELSE 1 END)"
    lengths = " ".join(f"WHEN '{k}' THEN {n}" for k, n in IBAN_LENGTHS.items())
    moved = "substr(account, 5) || substr(account, 1, 4)"
    value = f"CASE WHEN substr({moved}, j, 1) BETWEEN '0' AND '9' THEN ascii(substr({moved}, j, 1)) - 48 ELSE ascii(substr({moved}, j, 1)) - 55 END"
    mod = f"list_reduce(list_transform(range(1, length(account) + 1), lambda j: CAST({value} AS BIGINT)), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97)"
    valid = {
        "email": "true",
        "ip": f"len(list_filter(string_split(found, '.'), lambda o: length({octet}) > 3 OR coalesce(TRY_CAST({octet} AS INT), 0) > 255)) = 0",
        "card": f"length({d}) BETWEEN 12 AND 19 AND {weighed(d, f'{twice} - CASE WHEN {twice} > 9 THEN 9 ELSE 0 END')} % 10 = 0",
        "phone": f"length({d}) BETWEEN 9 AND 15",
        "iban": f"length(account) = size AND {mod} = 1 AND alone",
        "ssn": "regexp_full_match(found, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND NOT regexp_matches(found, '^(000|666|9)|-00-|-0000$') AND alone",
        "routing": f"length(found) = 9 AND found <> '000000000' AND {weighed('found', 'CAST(substr(found, j, 1) AS INT) * [3, 7, 1][(j - 1) % 3 + 1]')} % 10 = 0 AND alone",
    }
    hits = " UNION ALL ".join(
        f"SELECT doc_id, t, {k} AS o, '{kind}' AS kind, unnest(range(1, len(m) + 1)) AS i, m, g FROM (SELECT doc_id, t, regexp_extract_all(t, '{p}', 0) AS m, "
        f"regexp_split_to_array(t, '{p}') AS g FROM d)" for k, (kind, p) in enumerate(PATTERNS.items())
    )
    near = " ".join(f"WHEN '{kind}' THEN regexp_matches(l, '{_any_word(w)}') OR regexp_matches(r, '{_any_word(w)}')" for kind, w in WORDS_FOR.items())
    prior = " ".join(f"WHEN '{kind}' THEN {int(100 * p)}" for kind, p in PRIOR.items())
    against = _any_word(WORDS_AGAINST)
    base = f"o < {len(BASE)}"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({hits}),
placed AS (SELECT doc_id, t, o, kind, m[i] AS whole, CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))
 + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s FROM hits),
sized AS (SELECT *, CASE WHEN kind = 'iban' THEN CASE substr(whole, 1, 2) {lengths} ELSE 99 END ELSE 0 END AS size FROM placed),
cutted AS (SELECT *, CASE WHEN kind = 'iban' THEN substr(whole, 1, coalesce(list_filter(range(1, length(whole) + 1),
 lambda e: length(replace(substr(whole, 1, e), ' ', '')) = size)[1], length(whole))) ELSE whole END AS found FROM sized),
cand AS (SELECT *, replace(found, ' ', '') AS account, s + length(found) AS e,
 NOT regexp_matches(CASE WHEN s > 0 THEN substr(t, s, 1) ELSE '' END || substr(t, s + length(found) + 1, 1), '[A-Za-z0-9]') AS alone FROM cutted),
ok AS (SELECT * FROM cand WHERE CASE kind {' '.join(f"WHEN '{k}' THEN {v}" for k, v in valid.items())} END),
sides AS (SELECT *, translate(substr(t, greatest(1, s - {WINDOW - 1}), least(s, {WINDOW})), '{UPPER}', '{LOWER}') AS l, translate(substr(t, e + 1, {WINDOW}), '{UPPER}', '{LOWER}') AS r FROM ok),
scored AS (SELECT *, greatest(0, least(100, CASE kind {prior} END + CASE WHEN CASE kind {near} END THEN {int(100 * FOR)} ELSE 0 END
 - CASE WHEN regexp_matches(l, '{against}') OR regexp_matches(r, '{against}') THEN {int(100 * AGAINST)} ELSE 0 END)) AS score FROM sides),
agg AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
 string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER ({base}) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans,
 string_agg(CAST(score AS VARCHAR), ',' ORDER BY s, o) AS scores FROM scored WHERE {base} OR score >= {int(100 * THRESHOLD)} GROUP BY doc_id)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores_percent
FROM d LEFT JOIN agg USING (doc_id)"""


ORACLE = {"op12_pii": _oracle()}
QUERIES = {"op12_pii": op12_pii}
