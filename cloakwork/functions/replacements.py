"""Placeholders and synthetic stand-ins, and reading the index back out of one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.catalogue import ENTITY_TYPES, MODES


def pad(n: Column, width: int) -> Column:
    """Left-pad with zeros; longer numbers are kept whole."""
    s = n.cast("string")
    return F.lpad(s, F.greatest(F.length(s), F.lit(width)), F.lit("0"))


def tag(type_: Column, n: Column) -> Column:
    return F.concat(F.lit("["), type_, F.lit("_"), n.cast("string"), F.lit("]"))


def synthetic_date(source: Column, n: Column) -> Column:
    """A made-up date in the field order and with the separator of the source."""
    day_first = r"^\d{1,2}([./-])\d{1,2}\1\d{4}\z"
    year_first = r"^\d{4}([./-])\d{1,2}\1\d{1,2}\z"
    k = n - 1
    day = pad(F.pmod(k, F.lit(28)) + 1, 2)
    month = pad(F.pmod(F.shiftright(k, 1), F.lit(12)) + 1, 2)
    year = (F.pmod(k, F.lit(25)) + 1990).cast("string")
    return (
        F.when(source.rlike(day_first), _joined(source, day_first, day, month, year))
        .when(source.rlike(year_first), _joined(source, year_first, year, month, day))
        .otherwise(F.lit("01.01.1990"))
    )


def _joined(source: Column, shape: str, a: Column, b: Column, c: Column) -> Column:
    sep = F.regexp_extract(source, shape, 1)
    return F.concat(a, sep, b, sep, c)


def synthetic(type_: Column, n: Column, region: Column, source: Column) -> Column:
    # The stand-in of each entity type.
    return (
        F.when(type_ == "USER", F.concat(F.lit("USER_"), n.cast("string")))
        .when(type_ == "EMAIL", F.concat(F.lit("user"), n.cast("string"), F.lit("@example.test")))
        .when(type_ == "PHONE", F.concat(F.lit("+0000000"), pad(n, 4)))
        .when(type_ == "IP", F.concat(F.lit("10.0.0."), F.least(F.lit(254), n).cast("string")))
        .when(type_ == "ADDRESS", F.concat(F.lit("ADDRESS_"), n.cast("string")))
        .when(type_ == "CARD", F.concat(F.lit("4111 **** **** "), pad(F.pmod(n + 1000, F.lit(10000)), 4)))
        .when(type_ == "IBAN", F.concat(F.lit("DE00TEST0000000000"), pad(n, 4)))
        .when(type_ == "SWIFT_BIC", F.concat(F.lit("FAKE"), pad(n, 4)))
        .when(type_ == "ACCOUNT", F.concat(F.lit("***************"), pad(n, 5)))
        .when(type_ == "DOC_ID", F.concat(F.coalesce(region, F.lit("XX")), F.lit("-DOC-"), pad(n, 5)))
        .when(type_ == "PERSON", F.concat(F.lit("PERSON_"), n.cast("string")))
        .when(type_ == "ORG", F.concat(F.lit("ORG_"), n.cast("string")))
        .when(type_ == "DATE", synthetic_date(source, n))
        .otherwise(F.concat(F.lit("REDACTED_"), n.cast("string")))
    )


def replacement(mode: str, type_: Column, n: Column, region: Column, source: Column) -> Column:
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    return tag(type_, n) if mode == "tag" else synthetic(type_, n, region, source)


def parse_index(mode: str, type_: Column, value: Column) -> Column:
    """The index inside a tag or a synthetic value; null if there is none, or if it is 0."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if mode == "tag":
        head = F.concat(F.lit("["), type_, F.lit("_"))
        body = F.substring(value, F.length(head) + 1, F.length(value) - F.length(head) - 1)
        number = F.when(value.startswith(head) & value.endswith("]") & body.rlike(r"^[0-9]+\z"), body)
    else:
        number = F.when(
            type_.isin("USER", "PERSON", "ORG") & value.startswith(F.concat(type_, F.lit("_"))),
            F.regexp_extract(value, r"^[A-Z]+_([0-9]+)\z", 1),
        )
        number = F.coalesce(
            number,
            F.when(type_ == "EMAIL", F.regexp_extract(value, r"^user([0-9]+)@example\.test\z", 1)),
            F.when(type_ == "PHONE", F.regexp_extract(value, r"^\+0000000([0-9]{4})\z", 1)),
        )
    index = number.try_cast("bigint")
    return F.when(index > 0, index)


def is_entity_type(type_: Column) -> Column:
    return type_.isin(*ENTITY_TYPES)
