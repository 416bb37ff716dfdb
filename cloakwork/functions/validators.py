"""Validators: Column of matched text -> boolean Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.catalogue import S

# One pattern a test, white space around the value allowed: trimming, splitting and counting cost several times as much.
# Shapes of dates and of 16-digit card numbers.
_DAY = r"(?:0?[1-9]|[12]\d|3[01])"
_MONTH = r"(?:0?[1-9]|1[0-2])"
_YEAR = r"(?:19\d{2}|20\d{2})"
DATE_SHAPE = rf"^{S}*+(?:{_DAY}[./-]{_MONTH}[./-]{_YEAR}|{_YEAR}[./-]{_MONTH}[./-]{_DAY}){S}*+\z"
CARD16_SHAPE = rf"^{S}*+(?:\d{{16}}|\d{{4}}(?:[ -]{{1,2}}\d{{4}}){{3}}){S}*+\z"
PHONE_DIGITS = r"^(?:[^0-9]*+[0-9]){9,15}+[^0-9]*+\z"
_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d?\d)"
IPV4_SHAPE = rf"^{S}*+{_OCTET}(?:\.{_OCTET}){{3}}{S}*+\z"
# Eight hextets, or around a single double colon any number of them but eight or more.
_HEXTET = r"[0-9a-fA-F]{1,4}"
_HEXTETS = rf"(?:{_HEXTET}(?::{_HEXTET})*+)?"
IPV6_SHAPE = rf"^{S}*+(?:(?:{_HEXTET}:){{7}}{_HEXTET}|(?!:*(?:[^:]+:+){{7}}[0-9a-fA-F]){_HEXTETS}::{_HEXTETS}){S}*+\z"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """13 to 19 digits with a valid mod-10 check digit; other characters are ignored."""
    d = digits(value)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def card16_shape(value: Column) -> Column:
    return value.rlike(CARD16_SHAPE)


def likely_card(value: Column) -> Column:
    """A 16-digit card shape passes as it is; other lengths need the check digit."""
    return card16_shape(value) | luhn(value)


def date_like(value: Column) -> Column:
    return value.rlike(DATE_SHAPE)


def likely_phone(value: Column) -> Column:
    return value.rlike(PHONE_DIGITS) & ~date_like(value) & ~card16_shape(value)


def valid_ipv4(value: Column) -> Column:
    return value.rlike(IPV4_SHAPE)


def valid_ipv6(value: Column) -> Column:
    """Eight hextets, or fewer than eight around a single double colon."""
    return value.rlike(IPV6_SHAPE)


VALIDATORS = {"card": likely_card, "phone": likely_phone, "ipv4": valid_ipv4, "ipv6": valid_ipv6}
