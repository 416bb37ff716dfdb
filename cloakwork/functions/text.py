"""Text expressions: normalisation, trimming, positions, slices, literal search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.catalogue import S
from cloakwork.functions.arrays import let, once, scan

BLOCK_BITS = 10
BLOCK = 1 << BLOCK_BITS


def normalise(text: Column) -> Column:
    """No-break space to space, CRLF to LF."""
    return F.replace(F.replace(text, F.lit("\u00a0"), F.lit(" ")), F.lit("\r\n"), F.lit("\n"))


def trim_space(text: Column) -> Column:
    """Strip white space of any script and the byte order mark (Spark's trim strips blanks only)."""
    return F.regexp_replace(text, rf"^{S}+|{S}+\z", "")


def blocks(text: Column) -> Column:
    """The text cut into blocks of :data:`BLOCK` characters, for cheap slices by offset.

    ``substring`` walks from the start of the string; with blocks a slice costs the same
    anywhere in a large document.
    """
    many = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}+"), F.lit(0))
    return F.when(F.length(text).between(1, BLOCK), F.array(text)).otherwise(many)


def slice_blocks(parts: Column, start: Column, end: Column) -> Column:
    """Characters ``[start, end)`` of a text held as blocks; ends outside the text are cut off."""
    lo = F.greatest(start, F.lit(0))
    first = F.shiftright(lo, BLOCK_BITS).cast("int")
    last = F.shiftright(end - 1, BLOCK_BITS).cast("int")
    many = F.substring(F.array_join(F.slice(parts, first + 1, last - first + 1), ""), lo - first * BLOCK + 1, end - lo)
    one = F.substring(F.get(parts, F.lit(0)), lo + 1, end - lo)  # as most texts are short
    return F.when(end > lo, F.when(F.size(parts) == 1, one).otherwise(many)).otherwise(F.lit(""))


def positions(found: Column, gaps: Column, **more: Column) -> Column:
    """Offsets of matches, from the matches and the lengths of the text pieces between them.

    Returns ``array<struct<start, end, source>>``, with ``more`` in each; offsets are 0-based, half-open, in characters.
    """
    others = [c.alias(n) for n, c in more.items()]
    places = scan(
        F.transform(found, lambda m, i: F.struct(F.get(gaps, i).alias("gap"), F.length(m).alias("size"))),
        F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")),
        lambda st, x: F.struct((st.end + x.gap).alias("start"), (st.end + x.gap + x["size"]).alias("end")),
    )
    return once(
        places,
        lambda at: F.transform(
            found,
            lambda m, i: F.struct(*others, F.get(at, i).start.alias("start"), F.get(at, i).end.alias("end"), m.alias("source")),
        ),
    )


FEW = 16  # up to so many matches of a text are placed by the length of all that is before them


def piece_positions(pieces: Column, **more: Column) -> Column:
    """The same from a text cut before and after each match: gap, match, gap, ..., gap."""
    size, before, match = F.length, F.get(pieces, F.lit(0)), F.get(pieces, F.lit(1))
    others = [c.alias(n) for n, c in more.items()]
    one = F.struct(*others, size(before).alias("start"), (size(before) + size(match)).alias("end"), match.alias("source"))
    places = F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2))

    def placed(i: Column) -> Column:
        return F.struct(
            *others,
            size(F.array_join(F.slice(pieces, F.lit(1), i), "")).alias("start"),
            size(F.array_join(F.slice(pieces, F.lit(1), i + 1), "")).alias("end"),
            F.get(pieces, i).alias("source"),
        )

    found = F.transform(places, lambda i: F.get(pieces, i))
    gaps = F.transform(places, lambda i: size(F.get(pieces, i - 1)))
    return (
        F.when(F.size(pieces) == 3, F.array(one))
        .when(F.size(pieces) < 3, F.slice(F.array(one), F.lit(1), F.lit(0)))
        .when(F.size(pieces) <= 2 * FEW + 1, F.transform(places, placed))
        .otherwise(positions(found, gaps, **more))
    )


def quote(literal: Column) -> Column:
    """A pattern that matches the literal text only."""
    return F.concat(F.lit(r"\Q"), F.replace(literal, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def occurrences(text: Column, literal: Column) -> Column:
    """Non-overlapping, case-sensitive, left-to-right occurrences of a literal: ``array<struct<start, end>>``."""
    size = F.length(literal)

    def walk(gaps: Column) -> Column:
        at = F.length(F.get(gaps, F.lit(0)))
        once = F.array(F.struct(at.alias("start"), (at + size).alias("end")))
        several = scan(
            F.slice(gaps, F.lit(1), F.size(gaps) - 1),
            F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")),
            lambda st, gap: F.struct(
                (st.end + F.length(gap)).alias("start"), (st.end + F.length(gap) + size).alias("end")
            ),
        )
        return F.when(F.size(gaps) == 2, once).otherwise(several)

    none = F.slice(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))), F.lit(1), F.lit(0))
    return F.when(
        (size > 0) & F.contains(text, literal), let(F.split(text, quote(literal), -1), walk)
    ).otherwise(none)
