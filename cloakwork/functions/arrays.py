"""Helpers over array columns.

``scan`` and ``lookup`` give array columns what ``last_value``/running windows and an
equi-join give to rows, so that work inside one document needs no shuffle.  Both stay
near-linear in the array length: a document with a hundred thousand spans is still fine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHUNK = 16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """The same without a copy of the result, which :func:`let` makes: a fold over nothing hands its first state to the last step."""
    return F.aggregate(F.expr("array()"), value, lambda acc, _: acc, body)


def scan(items: Column, init: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Running fold: the state after each item, ``[step(init, x0), step(.., x1), ...]``.

    ``aggregate`` copies all that it has collected at every step, strings and all.  States are therefore collected
    in chunks, and chunks in chunks of chunks; what is in a state should be small.
    """

    def run(chunk: Column, before: Column) -> Column:
        states = F.aggregate(
            chunk, F.array(before), lambda acc, x: F.array_append(acc, step(F.element_at(acc, -1), x))
        )
        return F.slice(states, F.lit(2), F.lit(_CHUNK))

    def chunked(arr: Column, size: int, before: Column, inner: Callable[[Column, Column], Column]) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(arr) - 1) / size).cast("int"))
        runs = F.aggregate(
            chunks,
            F.array(F.array(before)),
            lambda acc, c: F.array_append(
                acc,
                inner(F.slice(arr, c * size + 1, F.lit(size)), F.element_at(F.element_at(acc, -1), -1)),
            ),
        )
        return F.slice(F.flatten(runs), F.lit(2), F.size(arr))

    def some(part: Column, before: Column) -> Column:
        return once(part, lambda arr: chunked(arr, _CHUNK, before, run))

    none = F.slice(F.array(init), F.lit(1), F.lit(0))
    return once(
        items,
        lambda arr: F.when(F.size(arr) > _CHUNK, chunked(arr, _CHUNK * _CHUNK, init, some))
        .when(F.size(arr) > 0, run(arr, init))
        .otherwise(none),
    )


def lookup(keys: Column, entries: Column) -> Column:
    """For each key the value of the entry with that key, or null.

    ``keys`` is ``array<string>``; ``entries`` is ``array<struct<k: string, v: T>>``;
    the smallest value wins where a key repeats.  Sorts both together and carries the value forward.
    """
    tagged = F.concat(
        F.transform(entries, lambda e: F.struct(e.k.alias("k"), F.lit(-1).alias("pos"), e.v.alias("v"))),
        F.transform(
            keys,
            lambda k, i: F.struct(k.alias("k"), i.alias("pos"), F.get(F.slice(entries, 1, 0), F.lit(0)).v.alias("v")),
        ),
    )
    none = F.get(F.slice(tagged, 1, 0), F.lit(0))
    carried = scan(
        F.sort_array(tagged),
        none,
        lambda st, x: F.struct(
            x.k.alias("k"),
            x.pos.alias("pos"),
            F.when(st.k == x.k, st.v).when(x.pos < 0, x.v).alias("v"),
        ),
    )
    hits = F.sort_array(
        F.transform(F.filter(carried, lambda s: s.pos >= 0), lambda s: F.struct(s.pos.alias("pos"), s.v.alias("v")))
    )
    return F.transform(hits, lambda s: s.v)


def first_seen_rank(items: Column, group: Callable[[Column], Column], key: Callable[[Column], Column]) -> Column:
    """Number the distinct keys of each group in order of first appearance, from 1.

    Returns one number per item, aligned with ``items``.
    """
    entries = F.sort_array(
        F.transform(items, lambda s, i: F.struct(group(s).alias("g"), key(s).alias("k"), i.alias("i")))
    )

    def seen(e: Column) -> Column:
        """``struct<g, first, i>``, where ``first`` is the place of the key's first item."""
        heads = scan(
            F.transform(
                e,
                lambda x, j: F.struct(
                    x.i.alias("i"), ((j > 0) & (F.get(e, j - 1).g == x.g) & (F.get(e, j - 1).k == x.k)).alias("same")
                ),
            ),
            F.lit(-1),
            lambda st, x: F.when(x.same, st).otherwise(x.i),
        )
        return let(
            heads,
            lambda h: F.sort_array(
                F.transform(e, lambda x, j: F.struct(x.g.alias("g"), F.get(h, j).alias("first"), x.i.alias("i")))
            ),
        )

    def numbered(e: Column) -> Column:
        numbers = scan(
            F.transform(
                e,
                lambda x, j: F.struct(
                    ((j == 0) | (F.get(e, j - 1).g != x.g)).alias("new"), (F.get(e, j - 1)["first"] == x["first"]).alias("same")
                ),
            ),
            F.lit(0),
            lambda st, x: F.when(x.new, F.lit(1)).when(x.same, st).otherwise(st + 1),
        )
        return let(numbers, lambda n: F.transform(e, lambda x, j: F.struct(x.i.alias("i"), F.get(n, j).alias("n"))))

    ranked = let(let(entries, seen), numbered)
    aligned = F.sort_array(F.transform(ranked, lambda r: F.struct(r.i.alias("i"), r.n.alias("n"))))
    return F.transform(aligned, lambda r: r.n)


def sorted_distinct(arr: Column) -> Column:
    """Sorted array without repeats, for any orderable element type."""
    return let(
        F.array_sort(arr),
        lambda a: F.filter(a, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(a, i - 1))),
    )
