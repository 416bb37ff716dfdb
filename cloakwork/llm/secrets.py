"""Secret scan: three fixed patterns, and sliding-window entropy of candidate strings.

Candidates are runs of base64-like characters.  Each belongs to a character class, by the kinds of letters and
digits in it: hexadecimal, mixed (lower case, upper case and digits), lower case or upper case with digits (which holds
base32), letters of both cases, letters of one case, digits.  A window of ``WINDOW``
characters slides over the candidate; counts per character, packed into a few numbers, are updated by the character that comes
and the one that goes, and with them the sum of ``c * log2(c)`` that gives the Shannon entropy.  The span runs
from the first window above the threshold of its class to the last.  A candidate with fewer different
characters than any such window needs is not walked through.  Candidates that an allow-list
pattern matches as a whole are left out; the patterns for paths and examples count only if all parts are words.

Letters of one case are what ordinary long words are made of, so their threshold is one that few random strings reach either;
digits alone carry too little to tell a secret from a number, and have none.

Everything happens inside the row, on native columns, so nothing is shuffled.  Offsets are in code points.

Defined cases: a null or empty text has no spans; a text may be of any length; repeated rows are
scanned each; an empty table gives an empty result.  Only the id and text columns are read, so
clashing names of others do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.functions.arrays import let
from cloakwork.llm.common import table, text_or_empty
from cloakwork.operators.settle import settle

# Fixed values of the query's contract: kind, pattern, group whose length counts, least length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"(AKIA[A-Z0-9]+)", 0, 20),
    ("hex", r"([0-9a-f]+)", 0, 24),
)
# The same maximal runs, found without trying every character of a shorter run again.
GATES = {"hex": r"(?<![0-9a-f])[0-9a-f]{24}", "access": r"AKIA[A-Z0-9]{16}"}
LONG_RUNS = {"hex": r"(?<![0-9a-f])[0-9a-f]{24,}+"}

WINDOW = 20
ALPHABET = "A-Za-z0-9+/_=-"
THRESHOLDS = {"hex": 2.9, "mixed": 3.75, "lower_digits": 3.6, "upper_digits": 3.6, "letters": 3.85, "one_case": 4.05}  # bits a character
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",  # UUID
    r".*(?i:example|sample|placeholder|changeme).*",
    r"(?:[A-Za-z0-9]+[/_=-]){3,}[A-Za-z0-9]{0,12}",  # paths and names of several parts
    r"ABCDEFGHIJKLMNOPQRSTUVWXYZ.*",
)

# These two say little of a run that holds a random part, so they count only where every part between
# '/', '_' and '-' is a word, a short number or a placeholder.
LOOSE = ALLOWED[1:3]
HEX = "^(?:[0-9a-f]+|[0-9A-F]+)$"
_WORD = r"(?:(?:[A-Z]?[a-z]{1,15}|[A-Z]{1,15})[0-9]{0,4}|[0-9]{1,8}|[A-Za-z0-9]{0,8}(?i:example|sample|placeholder|changeme)[A-Za-z0-9]{0,8})"
WORDS = rf"^[/_-]*+(?:{_WORD}(?:[/_-]++|$))++$"


def _spans(text: Column, kind: str, order: int, pattern: str, group: int, least: int) -> Column:
    """``array<struct<start, order, kind, end, found>>`` of matches whose group is long enough."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("found"), counted.alias("counted"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,order:int,kind:string,end:int,found:string>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + F.length(x["gap"])
        end = begin + F.length(x["found"])
        one = F.struct(begin.alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), end.alias("end"), x["found"].alias("found"))
        hit = F.length(x["counted"]) >= least
        return F.struct(F.coalesce(end, begin).alias("at"), F.when(hit, F.concat(s["out"], F.array(one))).otherwise(s["out"]).alias("out"))

    return F.aggregate(zipped, start, step, lambda s: s["out"])


_NONE = "array<struct<start:int,order:int,kind:string,end:int,found:string>>"


def base_spans(text: Column) -> Column:
    """Spans of the three fixed patterns, by start and kind."""
    parts = []
    for order, (kind, pattern, group, least) in enumerate(BASE):
        gate = text.rlike(GATES.get(kind, pattern))
        runs = LONG_RUNS.get(kind, pattern)
        parts.append(F.when(gate, _spans(text, kind, order, runs, group, least)).otherwise(F.array().cast(_NONE)))
    return F.concat(*parts)


def char_class(run: Column) -> Column:
    """The class of a run, or null where it has no threshold.  Written for SQL too (see :func:`_class_sql`)."""
    lower, upper, digit = run.rlike("[a-z]"), run.rlike("[A-Z]"), run.rlike("[0-9]")
    return (
        F.when(run.rlike(HEX) & digit & (lower | upper), "hex")
        .when(lower & upper & digit, "mixed")
        .when(lower & digit, "lower_digits")
        .when(upper & digit, "upper_digits")
        .when(lower & upper, "letters")
        .when(lower | upper, "one_case")
    )


def _class_sql(run: str) -> str:
    def has(pattern: str) -> str:
        return f"regexp_matches({run}, '{pattern}')"

    lower, upper, digit = has("[a-z]"), has("[A-Z]"), has("[0-9]")
    return (f"CASE WHEN {has(HEX)} AND {digit} AND ({lower} OR {upper}) THEN 'hex' WHEN {lower} AND {upper} AND {digit} THEN 'mixed' WHEN {lower} AND {digit} THEN 'lower_digits' "
            f"WHEN {upper} AND {digit} THEN 'upper_digits' WHEN {lower} AND {upper} THEN 'letters' WHEN {lower} OR {upper} THEN 'one_case' END")


def window_hull(candidate: Column, threshold: Column, window: int = WINDOW) -> Column:
    """``struct<first, last>``: start of the first and end of the last window whose entropy reaches the threshold, or nulls.

    Counts are packed, twelve to a number, so a step rewrites seven numbers whatever the window.
    """
    if window >= 32:
        raise ValueError("a count has five bits")
    low, packs, per = 43, 7, 12  # '+' to 'z'
    weight = lambda c: F.when(c > 1, c * F.log2(c)).otherwise(0.0)
    start = F.struct(
        F.array_repeat(F.lit(0).cast("bigint"), packs).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("i"),
        F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"),
    )

    def pack(ch: Column) -> Column:
        return F.floor(ch / per).cast("int")

    def count(counts: Column, ch: Column) -> Column:
        shifted = F.call_function("shiftright", F.get(counts, pack(ch)), 5 * F.pmod(ch, F.lit(per)))
        return shifted.bitwiseAND(F.lit(31).cast("bigint"))

    def one(ch: Column, k: Column) -> Column:
        unit = F.call_function("shiftleft", F.lit(1).cast("bigint"), 5 * F.pmod(ch, F.lit(per)))
        return F.when(pack(ch) == k, unit).otherwise(F.lit(0).cast("bigint"))

    def step(s: Column, x: Column) -> Column:
        come = F.ascii(x["come"]) - low
        leaves = s["i"] >= window
        gone = F.when(leaves, F.ascii(x["gone"]) - low).otherwise(0)
        same = leaves & (come == gone)
        more, less = count(s["counts"], come), count(s["counts"], gone)
        change = F.when(same, 0.0).otherwise(
            weight(more + 1) - weight(more) + F.when(leaves, weight(less - 1) - weight(less)).otherwise(0.0)
        )
        total = s["sum"] + change
        counts = F.when(same, s["counts"]).otherwise(
            F.transform(s["counts"], lambda c, k: c + one(come, k) - F.when(leaves, one(gone, k)).otherwise(F.lit(0).cast("bigint")))
        )
        full = s["i"] + 1 >= window
        high = full & (F.lit(math.log2(window)) - total / window >= threshold)
        return F.struct(
            counts.alias("counts"), total.alias("sum"), (s["i"] + 1).alias("i"),
            F.when(high & s["first"].isNull(), s["i"] + 1 - window).otherwise(s["first"]).alias("first"),
            F.when(high, s["i"] + 1).otherwise(s["last"]).alias("last"),
        )

    def walk(letters: Column) -> Column:
        # Each character beside the one that leaves the window when it comes.
        behind = F.concat(F.array_repeat(F.lit(""), window), letters)
        items = F.slice(F.arrays_zip(letters.alias("come"), behind.alias("gone")), F.lit(1), F.size(letters))
        return F.aggregate(items, start, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))

    return let(F.split(candidate, ""), walk)


def entropy_spans(text: Column, order: int, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """Spans of kind ``entropy``."""
    pattern = rf"(?<![{ALPHABET}])[{ALPHABET}]{{{WINDOW},}}+"
    runs = _spans(text, "entropy", order, pattern, 0, WINDOW)
    whole = lambda patterns: "^(?:" + "|".join(patterns) + ")$" if patterns else "^$"
    strict, loose = ([a for a in allowed if (a in LOOSE) == kind] for kind in (False, True))
    listed = lambda c: c.rlike(whole(strict)) | (c.rlike(whole(loose)) & c.rlike(WORDS))

    def least(run: Column) -> Column:
        kind, out = char_class(run), F.lit(None).cast("double")
        for name, bits in THRESHOLDS.items():
            out = F.when(kind == name, bits).otherwise(out)
        return out

    # A window of n bits holds 2**n different characters at least.
    rich = lambda c, bits: F.size(F.array_distinct(F.split(c, ""))) >= F.pow(F.lit(2.0), bits)
    classed = F.transform(runs, lambda r: F.struct(r.alias("run"), least(r["found"]).alias("bits")))
    classed = F.filter(classed, lambda x: rich(x["run"]["found"], x["bits"]) & ~listed(x["run"]["found"]))
    hulls = F.transform(classed, lambda x: F.struct(x["run"].alias("run"), window_hull(x["run"]["found"], x["bits"]).alias("hull")))
    hulls = F.filter(hulls, lambda h: h["hull"]["first"].isNotNull())
    spans = F.transform(hulls, lambda h: F.struct(
        (h["run"]["start"] + h["hull"]["first"]).alias("start"), F.lit(order).alias("order"), F.lit("entropy").alias("kind"),
        (h["run"]["start"] + h["hull"]["last"]).alias("end"),
        F.substring(h["run"]["found"], h["hull"]["first"] + 1, h["hull"]["last"] - h["hull"]["first"]).alias("found")))
    return F.when(text.rlike(rf"(?<![{ALPHABET}])[{ALPHABET}]{{{WINDOW}}}"), spans).otherwise(F.array().cast(_NONE))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, base, spans`` per row: the spans of the fixed patterns, and all spans, as arrays of structs by start and kind."""
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    rows = settle(rows, "base", F.array_sort(base_spans(F.col("text"))))
    rows = settle(rows, "spans", F.array_sort(F.concat("base", entropy_spans(F.col("text"), len(BASE)))))
    return rows.select("id", "base", "spans")


def digest(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets."""
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind, *_ in BASE]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def _oracle() -> str:
    kinds = [(kind, pattern, group, least) for kind, pattern, group, least in BASE]
    kinds.append(("run", f"[{ALPHABET}]{{{WINDOW},}}", 0, WINDOW))
    parts = []
    for order, (kind, pattern, group, least) in enumerate(kinds):
        p = pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {order} AS o, '{kind}' AS kind, unnest(range(1, len(m) + 1)) AS i, m, g, c, {least} AS least FROM "
            f"(SELECT doc_id, regexp_extract_all(t, '{p}', 0) AS m, regexp_split_to_array(t, '{p}') AS g, "
            f"regexp_extract_all(t, '{p}', {group}) AS c FROM d)"
        )
    strict, loose = ("|".join(a for a in ALLOWED if (a in LOOSE) == kind).replace("'", "''") for kind in (False, True))
    words = WORDS.replace("*+", "*").replace("++", "+")  # nothing that a possessive loop takes could be given back
    bits = " ".join(f"WHEN '{name}' THEN {least}" for name, least in THRESHOLDS.items())
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({' UNION ALL '.join(parts)}),
placed AS (SELECT doc_id, o, kind, m[i] AS found,
 CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s
 FROM hits WHERE length(c[i]) >= least),
cand AS (SELECT *, CASE {_class_sql('found')} {bits} END AS bits FROM placed WHERE kind = 'run'),
wins AS (SELECT doc_id, s, list_filter(range(0, length(found) - {WINDOW} + 1),
 lambda k: list_aggregate(string_split(substr(found, k + 1, {WINDOW}), ''), 'entropy') >= bits) AS w
 FROM cand WHERE bits IS NOT NULL AND NOT regexp_full_match(found, '{strict}') AND NOT (regexp_full_match(found, '{loose}') AND regexp_matches(found, '{words}'))),
spans AS (SELECT doc_id, o, kind, s, s + length(found) AS e FROM placed WHERE kind <> 'run'
 UNION ALL SELECT doc_id, 3, 'entropy', s + w[1], s + w[-1] + {WINDOW} FROM wins WHERE len(w) > 0),
agg AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
 string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (o < 3) AS base,
 string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
 sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN agg USING (doc_id)"""


ORACLE = {"op5_secrets": _oracle()}
QUERIES = {"op5_secrets": op5_secrets}
