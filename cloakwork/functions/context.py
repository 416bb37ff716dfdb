"""Context tests on the text window around a match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.catalogue import (
    ADDRESS_LABELS,
    ADDRESS_WINDOW,
    HINT_WINDOW,
    PERSON_LABELS,
    PERSON_WINDOW,
    label_pattern,
)
from cloakwork.functions.arrays import once

_PERSON = label_pattern(PERSON_LABELS)
_ADDRESS = label_pattern(ADDRESS_LABELS)


def person_context(window: Column) -> Column:
    return window.rlike(_PERSON)


def address_context(window: Column) -> Column:
    return window.rlike(_ADDRESS)


def hint_hits(window: Column, hints: Column) -> Column:
    """How many of the (lower-case) hints occur in the window, ignoring its case."""
    return once(F.lower(window), lambda low: F.size(F.filter(hints, lambda h: F.contains(low, h))))


# name -> (window size, test)
CONTEXTS = {"person": (PERSON_WINDOW, person_context), "address": (ADDRESS_WINDOW, address_context)}
CUSTOM_WINDOW = HINT_WINDOW
