"""Numbering: which replacement each span gets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.functions.arrays import first_seen_rank, let, once, scan
from cloakwork.functions.replacements import parse_index, replacement


def value_key(span: Column) -> Column:
    """What has to be equal for two spans of one type to share a replacement."""
    return F.concat(F.coalesce(span.region, F.lit("-")), F.lit("|"), span.source)


FEW = 32  # lists up to this length are numbered by comparing their values with each other


def _few_ranks(spans: Column, whole: Callable[[Column], Column], use: Callable[[Column], Column]) -> Column:
    """``first_seen_rank`` of a short list by type and value, for ``use``."""

    def pair(s: Column) -> Column:
        return F.struct(whole(s).type.alias("type"), value_key(whole(s)).alias("key"))

    def numbers(different: Column) -> Column:
        """The number of each different value: how many of its type there are up to it."""
        types = F.transform(different, lambda d: d.type)
        return once(
            types,
            lambda ts: F.transform(ts, lambda t, j: j + 1 - F.size(F.array_remove(F.slice(ts, F.lit(1), j + 1), t))),
        )

    return once(
        F.transform(spans, pair),
        lambda ps: once(
            F.array_distinct(ps),
            lambda ds: once(
                numbers(ds), lambda ns: use(F.transform(ps, lambda p: F.get(ns, F.array_position(ds, p).cast("int") - 1)))
            ),
        ),
    )


def number_spans(spans: Column, mode: str, whole: Callable[[Column], Column] = lambda s: s) -> Column:
    """Add ``replacement``: per type, 1, 2, ... in order of first appearance of the value.

    ``spans`` may hold less than whole spans; ``whole`` makes the span of an item.
    """

    def replaced(s: Column, n: Column) -> Column:
        return whole(s).withField("replacement", replacement(mode, whole(s).type, n, whole(s).region, whole(s).source))

    def numbered(items: Column, ranks: Column) -> Column:
        return once(ranks, lambda n: F.transform(items, lambda s, i: replaced(s, F.get(n, i))))

    return once(
        spans,
        lambda items: F.when(
            F.size(items) > FEW,
            numbered(items, first_seen_rank(items, lambda s: whole(s).type, lambda s: value_key(whole(s)))),
        ).otherwise(_few_ranks(items, whole, lambda ranks: numbered(items, ranks))),
    )


def _known_replacements(spans: Column, mode: str) -> Column:
    """Per span: the replacement it keeps or inherits (null for a new key), and its index if kept."""
    entries = F.sort_array(
        F.transform(
            spans,
            lambda s, i: F.struct(
                s.type.alias("type"),
                value_key(s).alias("key"),
                i.alias("i"),
                F.when(s.replacement != "", s.replacement).alias("given"),
                parse_index(mode, s.type, s.replacement).alias("index"),
            ),
        )
    )

    def same(x: Column, other: Column) -> Column:
        return x.type.eqNullSafe(other.type) & x.key.eqNullSafe(other.key)

    def known(e: Column) -> Column:
        # In text order within a key: the places of the nearest replacement with an index, and of the last one of
        # any kind, up to here.  Then backwards, so that all spans of the key learn the last one.
        none = F.lit(None).cast("int")
        forward = scan(
            F.transform(
                e,
                lambda x, j: F.struct(
                    F.when(x["index"].isNotNull(), j).alias("near"),
                    F.when(x.given.isNotNull(), j).alias("last"),
                    same(x, F.get(e, j - 1)).alias("before"),
                    same(x, F.get(e, j + 1)).alias("behind"),
                ),
            ),
            F.struct(none.alias("near"), none.alias("last"), F.lit(False).alias("behind")),
            lambda st, x: F.struct(
                F.coalesce(x.near, F.when(x.before, st.near)).alias("near"),
                F.coalesce(x["last"], F.when(x.before, st["last"])).alias("last"),
                x.behind.alias("behind"),
            ),
        )
        backward = scan(
            F.reverse(forward),
            F.struct(none.alias("near"), none.alias("last")),
            lambda st, x: F.struct(
                x.near.alias("near"), F.when(x.behind, st["last"]).otherwise(x["last"]).alias("last")
            ),
        )
        return let(
            F.reverse(backward),
            lambda places: F.transform(
                e,
                lambda x, j: F.struct(
                    x.i.alias("i"),
                    F.coalesce(
                        F.get(e, F.get(places, j).near).given, F.get(e, F.get(places, j)["last"]).given
                    ).alias("value"),
                    x["index"].alias("index"),
                    x.type.alias("type"),
                ),
            ),
        )

    return F.sort_array(let(entries, known))


def fill_replacements(spans: Column, mode: str) -> Column:
    """Give every span of a merged list a replacement (``spans`` in text order, ``replacement`` may be null).

    A replacement that carries an index is kept.  Otherwise the span takes the value already
    used for its key (the nearest one before it that carries an index, else the last one given
    to the key), and a new key takes the smallest index of its type that no kept replacement uses.
    """

    def new_values(known: Column, fresh: Column, ranks: Column) -> Column:
        """``struct<i, value>`` for the spans of new keys."""
        free = F.transform(
            F.array_distinct(F.transform(fresh, lambda f: f.s.type)),
            lambda t: let(
                F.array_distinct(
                    F.transform(
                        F.filter(known, lambda k: (k.type == t) & k["index"].isNotNull()), lambda k: k["index"]
                    )
                ),
                lambda used: F.struct(
                    t.alias("type"),
                    F.array_except(
                        F.sequence(F.lit(1).cast("bigint"), (F.size(used) + F.size(fresh)).cast("bigint")), used
                    ).alias("index"),
                ),
            ),
        )
        return let(
            free,
            lambda fr: F.transform(
                fresh,
                lambda f, j: F.struct(
                    f.i.alias("i"),
                    replacement(
                        mode,
                        f.s.type,
                        F.get(F.get(F.filter(fr, lambda x: x.type == f.s.type), F.lit(0))["index"], F.get(ranks, j) - 1),
                        f.s.region,
                        f.s.source,
                    ).alias("value"),
                ),
            ),
        )

    def fill(known: Column) -> Column:
        fresh = F.filter(
            F.transform(
                spans, lambda s, i: F.struct(i.alias("i"), s.alias("s"), F.get(known, i).value.isNull().alias("is_new"))
            ),
            lambda f: f.is_new,
        )
        kept = F.transform(
            F.filter(known, lambda k: k.value.isNotNull()),
            lambda k: F.struct(k.i.alias("i"), k.value.alias("value")),
        )
        made = let(
            fresh,
            lambda fs: let(
                first_seen_rank(fs, lambda f: f.s.type, lambda f: value_key(f.s)),
                lambda ranks: new_values(known, fs, ranks),
            ),
        )
        return let(
            F.sort_array(F.concat(kept, made)),
            lambda values: F.transform(spans, lambda s, i: s.withField("replacement", F.get(values, i).value)),
        )

    return F.when(F.size(spans) > 0, let(_known_replacements(spans, mode), fill)).otherwise(spans)
