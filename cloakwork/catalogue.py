"""The rule catalogue: what is detected, with which pattern, priority and extra checks.

Rules are plain rows.  ``context`` and ``validator`` hold the *name* of a column
expression (see :mod:`cloakwork.functions`), or, for rules a caller registers, the
expression builder itself.  ``gate`` names a cheap test that every text holding a match
must pass; it keeps most rows away from the costly patterns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column

# --------------------------------------------------------------------------------------
# Entity types, regions, modes.
ENTITY_TYPES = (
    "USER", "PERSON", "ORG", "DOC_ID", "EMAIL", "PHONE", "IP",
    "ADDRESS", "CARD", "ACCOUNT", "IBAN", "SWIFT_BIC", "DATE",
)
REGIONS = ("RU", "AM", "EU")
MODES = ("tag", "synthetic")

# Context windows, in characters on either side of a match.
HINT_WINDOW = 40
PERSON_WINDOW = 48
ADDRESS_WINDOW = 72

# Manual and imported spans.
MANUAL_RULE = "manual.selection"
MANUAL_BASIS = "user-selection"
MANUAL_PRIORITY = 1000
IMPORTED_BASIS = "imported-rules"

# --------------------------------------------------------------------------------------
# Dialect.  The rules are defined with ECMAScript meaning: ``\s`` covers Unicode spaces
# and the byte order mark, ``\b`` is a boundary of ASCII word characters.  Java's ``\s``
# is ASCII and its ``\b`` (JDK 17) is not, so both are spelled out.
SPACE = r"\s\p{Z}\uFEFF"
S = f"[{SPACE}]"
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
# With Unicode case folding the long s and the Kelvin sign are word characters too.
EDGE_FOLD = r"(?:(?<=[\wſ\u212A])(?![\wſ\u212A])|(?<![\wſ\u212A])(?=[\wſ\u212A]))"

# --------------------------------------------------------------------------------------
# Field labels that must be near a person or a postcode.  A label written
# as ``=label`` must stand alone (no letter on either side); others match anywhere.
# A blank in a label stands for any run of white space.
PERSON_LABELS = (
    # Russian
    "=фио", "=фамили[яи]", "=имя", "=отчество", "=заявител(?:ь|я)", "данные заявителя",
    # English
    "=first name", "=given name", "=middle name", "=last name", "=family name",
    "=surname", "=legal name", "=applicant",
    # German
    "=vorname", "=familienname", "=nachname", "=geburtsname", "=antragsteller(?:in)?", "=anrede",
    # Armenian
    "=անուն", "=ազգանուն", "=հայրանուն", "դիմողի անուն,\\s*ազգանուն,\\s*հայրանունը",
)
ADDRESS_LABELS = (
    # Russian
    "=адрес", "адрес проживания", "адрес регистрации", "место жительства", "=индекс",
    # English
    "=address", "residential address", "mailing address", "postal address", "place of residence",
    # German
    "=anschrift", "=adresse", "wohnanschrift", "meldeadresse", "=wohnort", "=postleitzahl", "=plz",
    # Armenian
    "=հասցե", "բնակության հասցե", "գրանցման հասցե", "փոստային ինդեքս",
)
# --------------------------------------------------------------------------------------


def _label_body(label: str) -> str:
    return label.lstrip("=").replace("\\s", S).replace(" ", f"{S}+")


def label_pattern(labels: Iterable[str]) -> str:
    """One alternation over all labels, applied to a text window."""
    alone = "|".join(_label_body(x) for x in labels if x.startswith("="))
    anywhere = "|".join(_label_body(x) for x in labels if not x.startswith("="))
    return rf"(?iu)(?:^|[^\p{{L}}])(?:{alone})(?:[^\p{{L}}]|\z)|{anywhere}"


_DE_TAIL_WORD = r"(?:straße|str\.?|weg|allee|platz|gasse|ring|ufer)"

# Cheap tests a text must pass before a rule's pattern is tried, by name.  Each is implied by
# any match of the rules that carry it, so gating loses nothing.  A full regex pass over a text
# is the main cost of detection, so every text gets three of them (DIGIT_CONTEXT, CAPS, NAMES)
# and the tests below look at what those found.  All tests of a gate must hold, in order:
#   ("has", x)       the text contains the literal
#   ("like", p)      a pattern search in the text
#   ("digits", p)    a pattern search in the digit context only
#   ("any_digit",)   the text has a digit
#   ("caps", p)      a pattern search in texts with a run of capitals or digits
#   ("names",)       the text has two words that could be parts of a Latin name
#   ("cyrillic", x)  the text has a letter of U+0400..U+043F (UTF-8 lead byte D0), or the
#                    literal x if there is one
#   ("words", w...)  the lower-cased text contains one of the words; a text with letters that
#                    only *fold* to the letters of a word passes as well
# Label gates use parts of the labels, as a window edge may cut a word anywhere.
DIGIT_CONTEXT = rf"[0-9]++{S}*+(?:,{S}*+)?+[^0-9]{{0,64}}+"
CAPS = r"[A-Z0-9]{8}"
NAMES = rf"[A-Z][a-z-]{{2,}}+{S}+[A-Z]"
# Long s, Kelvin sign, dotted and dotless i, and the lead bytes of U+1C80..U+1CBF, as UTF-8.
FOLDING_BYTES = ("C5BF", "E284AA", "C4B0", "C4B1", "E1B2")
GATES: dict[str, tuple[tuple[str, ...], ...]] = {
    "at_sign": (("has", "@"),),
    "digit_run": (("digits", rf"[0-9][0-9{SPACE}().-]{{8,}}[0-9]"),),
    "digit_groups": (("digits", r"[0-9][./-][0-9]{1,3}[./-][0-9]"),),
    "hextets": (("has", ":"), ("like", r":[0-9A-Fa-f]{1,4}:")),
    "double_colon": (("has", "::"),),
    "house_ru": (("any_digit",), ("cyrillic", "\u1C81"), ("like", rf"[дД\u1C81](?:\.|[оО\u1C82][мМ])?{S}*[0-9]")),
    "house_de": (("any_digit",), ("like", rf"(?iu){S}{_DE_TAIL_WORD}{S}+[0-9]")),
    "house_en": (
        ("digits", rf"[0-9]{S}+[A-Za-z][A-Za-z.\- ]{{1,50}}{S}(?i:st|rd|road|ave|lane|ln|dr|boul|blvd|court|ct|pl|way)"),
    ),
    "postcode": (("digits", rf"[0-9]{{5}}(?:-[0-9]{{4}})?{S}+\p{{Lu}}"),),
    "postcode_ru": (("has", "г"), ("digits", rf"[0-9]{{6}}{S}*+(?:,{S}*+)?г"),),
    "caps_digits": (("caps", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{5}"),),
    "caps_run": (("caps", r"[A-Z]{6}[A-Z0-9]{2}"),),
    "caps_nine": (("caps", r"[A-Z0-9]{9}"),),
    "eight_digits": (("digits", r"[0-9]{8}"),),
    "twenty_digits": (("digits", r"[0-9]{20}"),),
    "names": (("names",),),
    "names_ru": (("cyrillic",), ("like", rf"[А-ЯЁ][а-яё-]{{2,}}+{S}+[А-ЯЁ]")),
    "upper_ru": (("cyrillic", "---"), ("like", rf"[А-ЯЁ-]{{3}}{S}+[А-ЯЁ-]{{3}}")),
    "person_label": (
        ("words", "name", "applicant", "antrag", "anrede", "фио", "фамили", "имя", "отчество", "заявител", "անուն"),
    ),
    "address_label": (
        ("words", "address", "adresse", "anschrift", "wohnort", "postleitzahl", "plz", "place",
         "адрес", "жительства", "индекс", "հասցե", "ինդեքս"),
    ),
}


@dataclass(frozen=True)
class Rule:
    rule_id: str
    type: str
    pattern: str
    priority: int
    basis: str
    region: str | None = None
    hints: tuple[str, ...] = ()
    context: str | Callable[[Column], Column] | None = None
    validator: str | Callable[[Column], Column] | None = None
    gate: tuple[str, ...] = ()
    # A test on the matched text that a *real* match passes.  Some patterns also swallow a
    # long run that cannot hold a match, so that the search stays linear; those are dropped.
    real: str | None = None


# --------------------------------------------------------------------------------------
# The detection rules, in catalogue order (the last tie-break of overlap
# resolution).  Patterns are in the Java dialect, with the ECMAScript meaning above.  The first
# character is looked at before what is behind it, which costs more and mostly holds.
_RU_CAP = r"[А-ЯЁ][а-яё-]{2,}"
_LAT_CAP = r"[A-Z][a-z-]{2,}"
_MAIL_LOCAL = r"[A-Z0-9._%+-]"
_DAY = r"(?:0?[1-9]|[12]\d|3[01])"
_MONTH = r"(?:0?[1-9]|1[0-2])"
_YEAR = r"(?:19\d{2}|20\d{2})"
_HEX = r"[A-F0-9]"
_DE_WORD = r"[A-ZÄÖÜ][\p{L}-]{2,}+"
_DE_TAIL = rf"{_DE_TAIL_WORD}{S}+\d{{1,4}}[a-zA-Z]?(?![\wſ\u212A])"

_UNIVERSAL = (
    Rule("universal.person.ru_fio", "PERSON",
         rf"(?=[А-ЯЁ])(?<!\p{{L}}){_RU_CAP}{S}+{_RU_CAP}{S}+{_RU_CAP}(?!\p{{L}})",
         76, "name-pattern+context", context="person", gate=("names_ru", "person_label")),
    Rule("universal.person.ru_fio_upper", "PERSON",
         rf"(?=[А-ЯЁ-])(?<!\p{{L}})(?:[А-ЯЁ-]{{3,}}+{S}+[А-ЯЁ-]{{3,}}+{S}+[А-ЯЁ-]{{3,}}(?!\p{{L}})|[А-ЯЁ-]{{64,}}+)",
         74, "name-pattern+context", context="person", gate=("upper_ru", "person_label"), real=S),
    Rule("universal.person.ru_fullname_2parts", "PERSON",
         rf"(?=[А-ЯЁ])(?<!\p{{L}}){_RU_CAP}{S}+{_RU_CAP}(?!\p{{L}})",
         71, "name-pattern+context", context="person", gate=("names_ru", "person_label")),
    Rule("universal.person.latin_fullname", "PERSON",
         rf"(?=[A-Z])(?<!\p{{L}}){_LAT_CAP}{S}+{_LAT_CAP}{S}+{_LAT_CAP}(?!\p{{L}})",
         72, "name-pattern+context", context="person", gate=("names", "person_label")),
    Rule("universal.person.latin_fullname_2parts", "PERSON",
         rf"(?=[A-Z])(?<!\p{{L}}){_LAT_CAP}{S}+{_LAT_CAP}(?!\p{{L}})",
         69, "name-pattern+context", context="person", gate=("names", "person_label")),
    Rule("universal.email", "EMAIL",
         rf"(?i)(?={_MAIL_LOCAL}){EDGE}(?:{_MAIL_LOCAL}++@[A-Z0-9.-]+\.[A-Z]{{2,}}(?!\w)|{_MAIL_LOCAL}{{64,}}+)",
         90, "strict-format", gate=("at_sign",), real="@"),
    Rule("universal.phone", "PHONE",
         rf"\+?\d[\d{SPACE}().-]{{8,}}\d",
         85, "format", validator="phone", gate=("digit_run",)),
    Rule("universal.ipv4", "IP",
         r"(?=\d)(?<!\w)(?:\d{1,3}\.){3}\d{1,3}(?!\w)",
         87, "format+validator", validator="ipv4", gate=("digit_groups",)),
    Rule("universal.ipv6.full", "IP",
         rf"(?i)(?=[A-F0-9:])(?<![A-F0-9:])(?:{_HEX}{{1,4}}:){{2,7}}{_HEX}{{1,4}}(?![A-F0-9:])",
         87, "format+validator", validator="ipv6", gate=("hextets",)),
    Rule("universal.ipv6.compressed", "IP",
         rf"(?i)(?=[A-F0-9:])(?<![A-F0-9:])(?:{_HEX}{{1,4}}:){{0,7}}::(?:{_HEX}{{1,4}}:){{0,7}}{_HEX}{{0,4}}(?![A-F0-9:])",
         87, "format+validator", validator="ipv6", gate=("double_colon",)),
    Rule("universal.address.ru.street_house", "ADDRESS",
         rf"(?iu)(?<=[\wſ\u212A])(?:ул\.?|улица|пр-?кт|проспект|пер\.?|переулок|наб\.?|набережная|б-р|бульвар|ш\.?|шоссе|пл\.?|площадь)"
         rf"{S}+[А-ЯЁA-Z][\p{{L}}\-.{SPACE}]{{1,48}}?,?{S}*(?:д\.?|дом){S}*\d{{1,4}}[а-яa-z]?(?:{S}*(?:кв\.?|квартира){S}*\d{{1,4}})?{EDGE_FOLD}",
         86, "strict-structure", gate=("house_ru",)),
    Rule("universal.address.de.street_house", "ADDRESS",
         rf"(?iu)(?=[A-ZÄÖÜ]){EDGE_FOLD}(?:{_DE_WORD}(?:{S}+(?!{_DE_TAIL}){_DE_WORD})*+{S}+{_DE_TAIL}"
         rf"|{_DE_WORD}(?:{S}+(?!{_DE_TAIL}){_DE_WORD}){{15,}}+)",
         86, "strict-structure", gate=("house_de",), real=r"\d"),
    Rule("universal.address.en.street_house", "ADDRESS",
         rf"(?i)(?=\d)(?<!\w)\d{{1,5}}{S}+[A-Z][A-Z.\- ]{{1,50}}{S}"
         rf"(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Drive|Dr\.?|Boulevard|Blvd\.?|Court|Ct\.?|Place|Pl\.?|Way){EDGE}",
         84, "strict-structure", gate=("house_en",)),
    Rule("universal.address.de.postcode_city", "ADDRESS",
         rf"(?=\d)(?<!\w)\d{{5}}{S}+[A-ZÄÖÜ][\p{{L}}-]+(?:{S}+[A-ZÄÖÜ][\p{{L}}-]+){{0,2}}{EDGE}",
         80, "postcode+locality+context", context="address", gate=("postcode", "address_label")),
    Rule("universal.address.ru.postcode_city", "ADDRESS",
         rf"(?=\d)(?<!\w)\d{{6}}{S}*+(?:,{S}*+)?+(?:г\.?|город){S}+[А-ЯЁ][\p{{L}}\- ]{{1,40}}{EDGE}",
         80, "postcode+locality+context", context="address", gate=("postcode_ru", "address_label")),
    Rule("universal.address.en.zip_city", "ADDRESS",
         rf"(?=\d)(?<!\w)\d{{5}}(?:-\d{{4}})?{S}+[A-Z][a-z]+(?:{S}+[A-Z][a-z]+){{0,2}}(?!\w)",
         78, "postcode+locality+context", context="address", gate=("postcode", "address_label")),
    Rule("universal.card", "CARD",
         rf"(?=\d)(?<!\w)(?:\d[ -]*?){{13,19}}{EDGE}",
         95, "format+luhn-or-shape", validator="card", gate=("digit_run",)),
    Rule("universal.iban", "IBAN",
         r"(?=[A-Z])(?<!\w)[A-Z]{2}\d{2}[A-Z0-9]{10,30}(?!\w)",
         88, "format", gate=("caps_digits",)),
    Rule("universal.swiftbic", "SWIFT_BIC",
         r"(?=[A-Z])(?<!\w)[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?(?!\w)",
         78, "format", gate=("caps_run",)),
    Rule("universal.account20", "ACCOUNT",
         r"(?=\d)(?<!\w)\d{20}(?!\w)",
         80, "length", gate=("digit_run", "twenty_digits")),
    Rule("universal.date", "DATE",
         rf"(?=\d)(?<!\w){_DAY}[./-]{_MONTH}[./-]{_YEAR}(?!\w)",
         60, "format", gate=("digit_groups",)),
    Rule("universal.date_iso_like", "DATE",
         rf"(?=\d)(?<!\w){_YEAR}[./-]{_MONTH}[./-]{_DAY}(?!\w)",
         60, "format", gate=("digit_groups",)),
)
_RU = (
    Rule("ru.passport.series_number", "DOC_ID",
         rf"(?=\d)(?<!\w)\d{{2}}{S}?\d{{2}}{S}?\d{{6}}(?!\w)",
         80, "format+context", "RU", ("паспорт", "серия", "номер", "выдан"), gate=("digit_run",)),
    Rule("ru.inn.person_or_company", "DOC_ID",
         r"(?=\d)(?<!\w)\d{10}(?:\d{2})?(?!\w)",
         70, "format+hint", "RU", ("инн", "налог"), gate=("digit_run",)),
    Rule("ru.snils", "DOC_ID",
         rf"(?=\d)(?<!\w)\d{{3}}-\d{{3}}-\d{{3}}{S}\d{{2}}(?!\w)",
         75, "exact-format", "RU", ("снилс",), gate=("digit_run",)),
)
_AM = (
    Rule("am.passport.alpha_numeric", "DOC_ID",
         r"(?=[A-Z])(?<!\w)[A-Z]{2}\d{7}(?!\w)",
         80, "format+context", "AM", ("passport", "անձնագիր", "document"), gate=("caps_digits",)),
    Rule("am.ssn_like", "DOC_ID",
         r"(?=\d)(?<!\w)\d{10}(?!\w)",
         65, "format+hint", "AM", ("ssn", "social", "հաշվառում"), gate=("digit_run",)),
    Rule("am.tax_identifier", "DOC_ID",
         r"(?=\d)(?<!\w)\d{8}(?!\w)",
         60, "format+hint", "AM", ("tin", "tax", "հարկ"), gate=("eight_digits",)),
)
_EU = (
    Rule("eu.passport.alphanumeric_9", "DOC_ID",
         r"(?=[A-Z0-9])(?<!\w)[A-Z0-9]{9}(?!\w)",
         72, "format+context", "EU", ("passport", "id card", "document no", "national id"), gate=("caps_nine",)),
    Rule("eu.vat.number", "DOC_ID",
         r"(?=[A-Z])(?<!\w)[A-Z]{2}[A-Z0-9]{8,12}(?!\w)",
         66, "format+hint", "EU", ("vat", "tax", "registration"), gate=("caps_nine",)),
    Rule("eu.residence_permit_like", "DOC_ID",
         r"(?=\d)(?<!\w)\d{2}[A-Z]{2}\d{5,7}(?!\w)",
         64, "format+hint", "EU", ("residence", "permit", "id"), gate=("caps_nine",)),
)
ALL_RULES: tuple[Rule, ...] = _UNIVERSAL + _RU + _AM + _EU

# The optional "extended" overlay.  It lifts the RU passport above PHONE,
# accepts a double colon after hextets, and lets the Cyrillic address rules start and end
# at Cyrillic words.
_U_START, _U_END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def _extended(rule: Rule) -> Rule:
    if rule.rule_id == "ru.passport.series_number":
        return replace(rule, priority=86)
    if rule.rule_id == "universal.ipv6.compressed":
        return replace(rule, pattern=rf"(?i)(?=[A-F0-9:])(?<![A-F0-9:])(?:{_HEX}{{1,4}}(?::{_HEX}{{1,4}}){{0,6}})?::(?:{_HEX}{{1,4}}(?::{_HEX}{{1,4}}){{0,6}})?(?![A-F0-9:])")
    if rule.rule_id == "universal.address.ru.street_house":
        return replace(rule, pattern=rule.pattern.replace(EDGE_FOLD, _U_END).replace(r"(?<=[\wſ\u212A])", _U_START))
    if rule.rule_id == "universal.address.ru.postcode_city":
        return replace(rule, pattern=rule.pattern.replace(EDGE, _U_END))
    return rule


PROFILES = {"as_written": ALL_RULES, "extended": tuple(_extended(r) for r in ALL_RULES)}
# --------------------------------------------------------------------------------------


def active_rules(regions: Iterable[str] = REGIONS, profile: str = "as_written",
                 extra: Iterable[Rule] = (), types: Iterable[str] | None = None) -> list[Rule]:
    """Universal rules always, regional ones if their region is enabled, in catalogue order."""
    enabled = set(regions)
    if not enabled:
        raise ValueError("select at least one region")
    if enabled - set(REGIONS):
        raise ValueError(f"unknown region: {sorted(enabled - set(REGIONS))}")
    if profile not in PROFILES:
        raise ValueError(f"unknown profile: {profile}")
    rules = [r for r in (*PROFILES[profile], *extra) if r.region is None or r.region in enabled]
    if types is not None:
        wanted = set(types)
        rules = [r for r in rules if r.type in wanted]
    return rules


def register_rule(rules: Iterable[Rule], rule: Rule) -> list[Rule]:
    """Add a caller's rule at the end of a rule list.

    ``validator`` takes the matched text and ``context`` the text window around the match;
    both are functions from Column to Column, so custom rules stay native expressions.
    """
    rules = list(rules)
    if rule.type not in ENTITY_TYPES:
        raise ValueError(f"unknown entity type: {rule.type}")
    if rule.region is not None and rule.region not in REGIONS:
        raise ValueError(f"unknown region: {rule.region}")
    if any(r.rule_id == rule.rule_id for r in rules):
        raise ValueError(f"rule id already taken: {rule.rule_id}")
    unknown = set(rule.gate) - set(GATES)
    if unknown:
        raise ValueError(f"unknown gate: {sorted(unknown)}")
    return [*rules, rule]
