"""Candidate spans: run every active rule over a text column and filter by context and validator.

All of it is one map-side chain of projections: cheap gates, then matches, then positions.
The steps are separate columns on purpose, so that a match list that is used twice is
computed once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.catalogue import CAPS, DIGIT_CONTEXT, FOLDING_BYTES, GATES, HINT_WINDOW, NAMES, Rule
from cloakwork.functions.context import CONTEXTS, hint_hits
from cloakwork.functions.text import blocks, piece_positions, slice_blocks
from cloakwork.functions.validators import VALIDATORS
from cloakwork.operators.overlaps import sort_key, sweep
from cloakwork.operators.reuse import reuse
from cloakwork.operators.settle import settle

PREFIX = "_cw_"


def _sql(value: object) -> str:
    """A constant as SQL text.  Building 31 rules column by column costs seconds of driver
    calls; the repetitive parts are therefore written as SQL expressions."""
    if value is None:
        return "CAST(NULL AS STRING)"
    if isinstance(value, str):
        if "'" in value and '"' in value:
            return "concat(" + """, "'", """.join(f"r'{part}'" for part in value.split("'")) + ")"
        mark = '"' if "'" in value else "'"
        return f"r{mark}{value}{mark}"
    if isinstance(value, (tuple, list)):
        return f"CAST(array({', '.join(_sql(v) for v in value)}) AS ARRAY<STRING>)"
    return str(value)


def _test(test: tuple[str, ...], text_col: str) -> str:
    kind, *args = test
    if kind == "has":
        return f"contains({text_col}, {_sql(args[0])})"
    if kind == "like":
        return f"rlike({text_col}, {_sql(args[0])})"
    if kind == "digits":
        return f"rlike({PREFIX}digits, {_sql(args[0])})"
    if kind == "any_digit":
        return f"{PREFIX}digits <> ''"
    if kind == "caps":
        return f"({PREFIX}caps AND rlike({text_col}, {_sql(args[0])}))"
    if kind == "cyrillic":
        others = "".join(f" OR contains({text_col}, {_sql(a)})" for a in args)
        return f"(contains(CAST({text_col} AS BINARY), X'D0'){others})"
    if kind == "names":
        return f"{PREFIX}names"
    words = " OR ".join(f"contains({PREFIX}low, {_sql(w)})" for w in args)
    folds = " OR ".join(f"contains(CAST({text_col} AS BINARY), X'{b}')" for b in FOLDING_BYTES)
    return f"({words} OR (octet_length({text_col}) > length({text_col}) AND ({folds})))"


def _gate(name: str, text_col: str) -> str:
    return " AND ".join(_test(t, text_col) for t in GATES[name])


def _is_worded(name: str) -> bool:
    return any(t[0] == "words" for t in GATES[name])


def _hint_gate(rule: Rule) -> str:
    """A window that holds a hint lies in a text that holds it.  (Greek hints are left out:
    the lower case of a sigma depends on what follows it.)"""
    low = [h.lower() for h in rule.hints]
    if any("σ" in h or "ς" in h for h in low):
        return "true"
    return f"({' OR '.join(f'contains({PREFIX}low, {_sql(h)})' for h in low)})"


def _pick(values: Sequence, ord_: Column) -> Column:
    """The value of the rule with this number, from a constant array."""
    return F.element_at(F.expr(f"array({', '.join(_sql(v) for v in values)})"), ord_)


def _tests(rule: Rule, cand: Column, parts: Column) -> Column | None:
    """A rule's own tests, other than hints."""
    tests = []
    if rule.real is not None:
        tests.append(cand.source.rlike(rule.real))
    if rule.validator is not None:
        check = VALIDATORS[rule.validator] if isinstance(rule.validator, str) else rule.validator
        tests.append(check(cand.source))
    if rule.context is not None:
        if isinstance(rule.context, str):
            size, check = CONTEXTS[rule.context]
        elif isinstance(rule.context, tuple):
            size, check = rule.context
        else:
            size, check = HINT_WINDOW, rule.context
        tests.append(check(slice_blocks(parts, cand.start - size, cand.end + size)))
    return reduce(lambda a, b: a & b, tests) if tests else None


def _alike(rules: Sequence[Rule]) -> list[tuple]:
    """The different tests of rules, by number; number 0 is none."""
    return list(dict.fromkeys([(None, None, None), *((r.real, r.validator, r.context) for r in rules)]))


def _keep(rules: Sequence[Rule], cand: Column, parts: Column) -> Column:
    """Does the candidate pass its rule's tests?  Rules with the same tests share a branch."""
    verdict = F.when(cand.test == 0, F.lit(True))
    for number, tests in enumerate(_alike(rules)):
        if number:
            rule = next(r for r in rules if (r.real, r.validator, r.context) == tests)
            verdict = verdict.when(cand.test == number, F.coalesce(_tests(rule, cand, parts), F.lit(False)))
    return verdict


MARK = "'\\uFDD0'"


def _pieces(text_col: str, pattern: str, marked: str | None = None) -> str:
    """The text cut before and after each match: gap, match, gap, ..., gap.

    One pass of the pattern puts a character that is not in the text around the matches, and the split is by that
    character.  ``split`` by a pattern compiles it anew for every row, so only texts that hold the character are; ``marked``
    is a column that says so.
    """
    mark, p, marked = MARK, _sql(pattern), marked or f"contains({text_col}, {MARK})"
    cut = f"split({text_col}, {p}, -1)"
    pairs = f"flatten(transform(regexp_extract_all({text_col}, {p}, 0), (m, i) -> array(get({cut}, i), m)))"
    return (
        f"CASE WHEN {marked} THEN concat({pairs}, slice({cut}, -1, 1)) "
        f"ELSE split(regexp_replace({text_col}, {p}, concat({mark}, '$0', {mark})), {mark}, -1) END"
    )


def matches(df: DataFrame, text_col: str, rules: Sequence[Rule]) -> DataFrame:
    """Add ``_cw_hits``: for each rule with a match, the text cut before and after its matches.

    Also adds the text blocks as ``_cw_blocks`` (null where nothing matched), for the steps that follow.
    """
    text = F.col(text_col)
    gates = sorted({g for r in rules for g in r.gate if not _is_worded(g)})
    worded = sorted({g for r in rules for g in r.gate if _is_worded(g)})
    kinds = {t[0] for g in gates for t in GATES[g]}
    views = {
        "digits": (
            {"digits", "any_digit"},
            f"array_join(regexp_extract_all({text_col}, {_sql(DIGIT_CONTEXT)}, 0), '')",
        ),
        "caps": ({"caps"}, f"rlike({text_col}, {_sql(CAPS)})"),
        "names": ({"names"}, f"rlike({text_col}, {_sql(NAMES)})"),
    }
    df = df.withColumns({f"{PREFIX}{v}": F.expr(sql) for v, (used_by, sql) in views.items() if kinds & used_by})
    marked = F.expr(f"contains({text_col}, {MARK})")
    df = df.withColumns({f"{PREFIX}marked": marked, **{f"{PREFIX}g_{g}": F.expr(_gate(g, text_col)) for g in gates}})

    # Lower-casing is costly too: only texts that could match a rule with labels or hints need it.
    def shape(rs: Iterable[Rule]) -> str:
        conds = {" AND ".join(f"{PREFIX}g_{g}" for g in r.gate if g in gates) or "true" for r in rs}
        return " OR ".join(f"({c})" for c in sorted(conds))

    lowered = [r for r in rules if r.hints or set(r.gate) & set(worded)]
    if lowered:
        df = df.withColumn(f"{PREFIX}low", F.expr(f"CASE WHEN {shape(lowered)} THEN lower({text_col}) END"))
        df = df.withColumns(
            {
                f"{PREFIX}g_{g}": F.expr(f"({shape(r for r in rules if g in r.gate)}) AND {_gate(g, text_col)}")
                for g in worded
            }
        )

    arms, alike = [], _alike(rules)
    for number, rule in enumerate(rules, 1):
        test = alike.index((rule.real, rule.validator, rule.context))
        cut = f"struct({number} AS ord, {test} AS test, {_pieces(text_col, rule.pattern, f'{PREFIX}marked')} AS pieces)"
        tests = [f"{PREFIX}g_{g}" for g in rule.gate] + ([_hint_gate(rule)] if rule.hints else [])
        arms.append(f"CASE WHEN {' AND '.join(tests)} THEN {cut} END" if tests else cut)
    helpers = [f"{PREFIX}{v}" for v in (*views, "low", "marked")] + [f"{PREFIX}g_{g}" for g in (*gates, *worded)]
    # One expression over all rules: as columns of their own, their code is too long to be compiled at run time.
    hits = F.expr(f"filter(array({', '.join(arms)}), h -> size(h.pieces) > 1)")
    df = df.withColumn(f"{PREFIX}hits", hits).drop(*helpers)
    return df.withColumn(f"{PREFIX}blocks", F.when(F.size(f"{PREFIX}hits") > 0, blocks(text)))


def candidates(df: DataFrame, text_col: str, rules: Sequence[Rule], out_col: str) -> DataFrame:
    """Add ``out_col``: every match that passes its rule's tests, with rule number and hint hits.

    Element type: ``struct<ord, start, end, source, hits>``.  Leaves ``_cw_blocks`` behind.
    """
    found = matches(df, text_col, rules)
    return settle(found, out_col, reuse(("kept", tuple(rules)), lambda: _kept(rules, _candidate))).drop(f"{PREFIX}hits")


def _candidate(c: Column, hits: Column) -> Column:
    return F.struct(*(c[n].alias(n) for n in ("ord", "start", "end", "source")), hits.alias("hits"))


def _kept(rules: Sequence[Rule], make: Callable[[Column, Column], Column]) -> Column:
    """Located matches of all rules, filtered by the rules' tests and hints: ``make(match, hits)``, which has ``hits`` as a field."""
    parts = F.col(f"{PREFIX}blocks")
    located = F.flatten(
        F.transform(
            f"{PREFIX}hits",
            lambda h: piece_positions(h.pieces, ord=h.ord, test=h.test),
        )
    )
    kept = F.filter(located, lambda c: _keep(rules, c, parts))
    with_hints = [n for n, r in enumerate(rules, 1) if r.hints]
    if not with_hints:
        return F.transform(kept, lambda c: make(c, F.lit(0)))
    hint_lists = F.expr(f"array({', '.join(_sql([h.lower() for h in r.hints]) for r in rules)})")

    def hits(c: Column) -> Column:
        """How many of its rule's hints are near; null where there should be some."""
        window = slice_blocks(parts, c.start - HINT_WINDOW, c.end + HINT_WINDOW)
        near = F.nullif(hint_hits(window, F.element_at(hint_lists, c.ord)), F.lit(0))
        return F.when(c.ord.isin(*with_hints), near).otherwise(F.lit(0))

    return F.filter(F.transform(kept, lambda c: make(c, hits(c))), lambda c: c["hits"].isNotNull())


def describe(rules: Sequence[Rule], cand: Column | SimpleNamespace) -> Column:
    """The full span struct of a candidate."""
    type_ = _pick([r.type for r in rules], cand.ord)
    region = _pick([r.region for r in rules], cand.ord).cast("string")
    priority = _pick([r.priority for r in rules], cand.ord)
    return F.struct(
        F.concat_ws("_", type_, cand.start.cast("string"), cand.end.cast("string")).alias("entity_id"),
        type_.alias("type"),
        cand.start.alias("start"),
        cand.end.alias("end"),
        cand.source.alias("source"),
        _pick([r.rule_id for r in rules], cand.ord).alias("rule_id"),
        region.alias("region"),
        F.least(F.lit(0.99), (priority + cand.hits * 5) / F.lit(100.0)).alias("confidence"),
        _pick([r.basis for r in rules], cand.ord).alias("confidence_basis"),
        F.when(region.isNull(), F.lit("universal")).otherwise(F.lit("regional")).alias("detector_source"),
        priority.alias("priority"),
    )


def survivors(rules: Sequence[Rule]) -> Column:
    """Matches (:func:`matches`) -> disjoint candidates in text order, as their sort keys; :func:`describe_key` makes spans of them."""

    def key(c: Column, hits: Column) -> Column:
        made = sort_key(c.start, c.end, _pick([r.priority for r in rules], c.ord), c.ord, c.source)
        return made.withField("hits", hits)

    return sweep(_kept(rules, key))


def describe_key(rules: Sequence[Rule], k: Column) -> Column:
    """The full span struct of a candidate that is left as its sort key."""
    return describe(rules, SimpleNamespace(ord=k.ord, start=k.start, end=-k.neg_end, source=k.payload, hits=k["hits"]))


def resolved(rules: Sequence[Rule]) -> Column:
    """Matches -> disjoint spans in text order."""
    return F.transform(survivors(rules), lambda k: describe_key(rules, k))
