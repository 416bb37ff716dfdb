"""One Spark query per operator, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.catalogue import ALL_RULES, Rule, register_rule
from cloakwork.functions import replacements as R
from cloakwork.functions import text as X
from cloakwork.functions import validators as V
from cloakwork.operators import pairs as P
from cloakwork.operators import review as W
from cloakwork.operators import user_rules as U
from cloakwork.operators.numbering import fill_replacements
from cloakwork.operators.overlaps import resolve_overlaps, sort_key, sweep
from cloakwork.plans import corpus, profile, roundtrip
from cloakwork.plans.masking import detect, explode_spans, find_candidates, mapping, mask
from cloakwork.sources import rule_pairs
from cloakwork.sources.documents import DOC_KEY, read_restorable, write_restorable
from cloakwork.streaming import masking_stream
from workload.inputs import documents, forms, mail_notes, notes, register, table

ID = ["doc_id"]
Query = Callable[[SparkSession, str], DataFrame]

# The user rules of the review queries: literals of the documents' invented prose.
USER_RULES = [("thing", "USER"), ("ing th", "ORG"), ("example.com", "ORG"), ("er", "PERSON"), ("tion on", "USER"), ("absent!", "USER")]


def _scratch(spark) -> str:
    """The shared folder that the session names."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return named.rstrip("/")


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back."""
    path = f"{_scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _once(df: DataFrame, *columns: str) -> DataFrame:
    """Columns of a masking result that several steps read: detection runs once, and its result is read."""
    return _kept(df.select(*columns), "masked")


def _long(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("bigint").alias(c) if c in ("start", "end", "priority") else F.col(c) for c in df.columns])


def _spans_of(df: DataFrame) -> DataFrame:
    cols = ["entity_id", "type", "start", "end", "source", "rule_id", "region", "confidence", "confidence_basis", "detector_source", "priority"]
    return _long(explode_spans(df, *ID).select(*ID, *cols))


def _rule_query(rule_id: str, source: Callable) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rule = [r for r in ALL_RULES if r.rule_id == rule_id]
        found = find_candidates(source(spark, sf_dir).select("doc_id", "text"), rules=rule)
        spans = explode_spans(found, *ID, spans_col="candidates")
        return _long(spans.select(*ID, "start", "end", "source", "confidence"))

    return run


def normalise_text(spark, sf):
    return documents(spark, sf).select("doc_id", X.normalise(F.col("text")).alias("clean_text"))


def detect_documents(spark, sf):
    return _spans_of(detect(documents(spark, sf)))


def detect_forms(spark, sf):
    return _spans_of(detect(forms(spark, sf)))


def detect_forms_ru_only(spark, sf):
    return _spans_of(detect(forms(spark, sf), regions=["RU"]))


def _masked(source: Callable, mode: str) -> Query:
    def run(spark, sf):
        return mask(source(spark, sf), mode=mode).select("doc_id", "masked_text")

    return run


def mask_conversations(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return mask(turns).select("conv_id", "turn", "masked_text")


def mask_pages(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.col("html"))
    return mask(pages, text_col="html").select("page_id", "masked_text")


def _mapping_rows(m):
    return m.select(
        "doc_id", "entity_id", "type", "region", "source", "replacement", "rule_id", "confidence",
        F.col("position.start").cast("bigint").alias("start"), F.col("position.end").cast("bigint").alias("end"), "enabled",
    )


def mapping_table(spark, sf):
    return _mapping_rows(mapping(mask(documents(spark, sf)), *ID))


def validators(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    v = orders.selectExpr(
        "o_orderkey",
        "concat('4', lpad(CAST(o_orderkey AS STRING), 9, '0'), CAST(1000 + o_custkey % 997 AS STRING)) AS card",
        "concat('+', CAST(o_orderkey * 7919 AS STRING), ' ', CAST(o_custkey AS STRING)) AS phone",
        "concat(CAST(o_custkey % 300 AS STRING), '.', CAST(o_orderkey % 257 AS STRING), '.0.1') AS ip",
        "concat(CAST(o_orderkey % 34 AS STRING), '/', CAST(o_custkey % 14 AS STRING), '/', CAST(year(o_orderdate) AS STRING)) AS day",
    )
    return v.select(
        "o_orderkey",
        V.luhn(F.col("card")).alias("luhn"),
        V.likely_card(F.col("card")).alias("card"),
        V.likely_phone(F.col("phone")).alias("phone"),
        V.valid_ipv4(F.col("ip")).alias("ipv4"),
        V.date_like(F.col("day")).alias("date_like"),
    )


_TYPES = "array('USER','EMAIL','PHONE','IP','ADDRESS','CARD','IBAN','SWIFT_BIC','ACCOUNT','DOC_ID','PERSON','ORG','DATE','OTHER')"


def replacement_templates(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(
        "o_orderkey",
        f"element_at({_TYPES}, CAST(o_orderkey % 14 + 1 AS INT)) AS type",
        "CAST(o_custkey + 1 AS INT) AS n",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'EU' END AS region",
        "concat_ws(CASE o_orderkey % 3 WHEN 0 THEN '.' WHEN 1 THEN '/' ELSE '-' END, CAST(day(o_orderdate) AS STRING),"
        " CAST(month(o_orderdate) AS STRING), CAST(year(o_orderdate) AS STRING)) AS source",
    )
    t, n = F.col("type"), F.col("n")
    made = R.synthetic(t, n, F.col("region"), F.col("source"))
    return rows.select(
        "o_orderkey",
        R.tag(t, n).alias("tag"),
        made.alias("synthetic"),
        R.parse_index("tag", t, R.tag(t, n)).alias("tag_index"),
        R.parse_index("synthetic", t, made).alias("synthetic_index"),
    )


def literal_occurrences(spark, sf):
    docs = documents(spark, sf)
    hits = X.occurrences(F.col("text"), F.lit("thth"))
    return docs.select("doc_id", F.explode(hits).alias("o")).select(
        "doc_id", F.col("o.start").cast("bigint").alias("start"), F.col("o.end").cast("bigint").alias("end")
    )


def _raw_spans(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS doc_id",
        "CAST(l_linenumber AS INT) AS ord",
        "CAST(l_partkey % 40 AS INT) AS start",
        "CAST(l_partkey % 40 + 1 + l_suppkey % 15 AS INT) AS end",
        "CAST(60 + 5 * (l_suppkey % 7) AS INT) AS priority",
    )


def resolve_overlaps_table(spark, sf):
    return _long(resolve_overlaps(_raw_spans(spark, sf), ID)).select("doc_id", "start", "end", "priority")


def resolve_overlaps_array(spark, sf):
    packed = _raw_spans(spark, sf).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "priority", "ord")).alias("s"))
    keys = F.transform("s", lambda s: sort_key(s.start, s.end, s.priority, s.ord, s))
    kept = packed.select("doc_id", F.explode(F.transform(sweep(keys), lambda k: k.payload)).alias("k"))
    return _long(kept.select("doc_id", "k.start", "k.end", "k.priority"))


def gap_fill(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS doc_id",
        "CAST(l_linenumber * 1000000 + l_partkey AS INT) AS start",
        "CASE WHEN l_suppkey % 2 = 0 THEN 'EMAIL' ELSE 'DOC_ID' END AS type",
        "CAST(l_partkey % 9 AS STRING) AS source",
        "l_partkey % 9 AS v",
    ).selectExpr(
        "doc_id", "start", "type", "CAST(NULL AS STRING) AS region", "source",
        "CASE WHEN v % 3 = 0 THEN concat('[', type, '_', CAST(v / 3 * 2 + 1 AS INT), ']') WHEN v = 4 THEN 'odd' END AS replacement",
    )
    packed = rows.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "type", "region", "source", "replacement"))).alias("spans")
    )
    filled = packed.select("doc_id", F.explode(fill_replacements(F.col("spans"), "tag")).alias("s"))
    return _long(filled.select("doc_id", "s.start", "s.type", "s.source", "s.replacement"))


def _rules(spark):
    rows = [(s, t, i) for i, (s, t) in enumerate(USER_RULES)]
    return spark.createDataFrame(rows, "source string, type string, ord int")


def _merged(spark, sf, strategy="constant"):
    masked = mask(documents(spark, sf))
    if strategy == "join":  # which reads the texts more than once: detection runs once, and its result is read
        masked = _kept(masked, "masked")
    return U.with_user_rules(masked, _rules(spark), ID, strategy=strategy)


def user_rules_merge(spark, sf):
    return _merged(spark, sf).select("doc_id", "masked_text")


def user_rules_merge_joined(spark, sf):
    return _merged(spark, sf, "join").select("doc_id", "masked_text")


def _without_some_ids(strategy: str) -> Query:
    def run(spark, sf):
        docs = documents(spark, sf).withColumn("doc_id", F.expr("CASE WHEN doc_id % 5 <> 0 THEN doc_id - doc_id % 2 END"))
        masked = _kept(mask(docs), "masked") if strategy == "join" else mask(docs)
        return U.with_user_rules(masked, _rules(spark), ID, strategy=strategy).select("doc_id", "masked_text")

    return run


def user_rules_spans(spark, sf):
    spans = explode_spans(_merged(spark, sf), *ID)
    return _long(spans.select("doc_id", "entity_id", "type", "start", "end", "source", "rule_id", "replacement"))


def user_rules_long_list(spark, sf):
    customers = table(spark, sf, "customer").selectExpr("c_name AS source", "'USER' AS type")
    return U.with_user_rules(_kept(mask(mail_notes(spark, sf)), "masked"), customers, ID).select("doc_id", "masked_text")


def rule_table_edits(spark, sf):
    events = table(spark, sf, "events")
    picked = events.selectExpr("concat(event_type, CASE WHEN event_id % 2 = 0 THEN ' ' ELSE '' END) AS source",
                               "CASE WHEN user_id % 2 = 0 THEN 'ORG' END AS type")
    rules = U.rules_from_selections(picked)
    changes = rules.where("type = 'ORG' AND source < 'd'").select("source", "type", F.lit("PERSON").alias("new_type"))
    removed = rules.where("type = 'USER' AND source >= 'p'").select("source", "type")
    return U.remove_rules(U.retype_rules(rules, changes), removed)


def _doc_spans(spark, sf):
    return explode_spans(mask(documents(spark, sf)), *ID)


_REVIEWED = ("doc_id", "entity_id", "type", "source", "region", "rule_id", "start")


def review_groups(spark, sf):
    off = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    spans = _kept(explode_spans(mask(forms(spark, sf).select("doc_id", "text")), *ID).select(*_REVIEWED), "spans")  # detection runs once
    disabled = spans.join(off, "doc_id", "left_semi").select("doc_id", "entity_id")
    return _groups(W.review_groups(spans, ID, disabled))


def _groups(df):
    return df.select("doc_id", "type", "source", "members", F.col("first_start").cast("bigint").alias("first_start"), "heading", "all_disabled")


def frequencies(spark, sf):
    return W.frequencies(_doc_spans(spark, sf))


def present_types_and_regions(spark, sf):
    spans = _kept(explode_spans(mask(forms(spark, sf).select("doc_id", "text")), *ID).select("type", "region"), "spans")  # detection runs once
    return W.present_types(spans).select(F.lit("type").alias("what"), F.col("type").alias("value")).unionByName(
        W.present_regions(spans).select(F.lit("region").alias("what"), F.col("region").alias("value"))
    )


def review_filter(spark, sf):
    spans = explode_spans(mask(forms(spark, sf).select("doc_id", "text")), *ID)
    return W.filter_spans(spans, "DOC_ID", "EU").select("doc_id", "entity_id", "source")


def total_detections(spark, sf):
    return W.detections_per_document(mask(documents(spark, sf)), ID)


def switch_local(spark, sf):
    spans = _kept(_doc_spans(spark, sf).select("doc_id", "entity_id", "type"), "spans")  # detection runs once
    off = spans.where("type IN ('EMAIL', 'PHONE')").select("doc_id", "entity_id")
    ask = spans.where("type IN ('PHONE', 'IP')").select("doc_id", "entity_id")
    return W.toggle_local(off, ask, ID)


def switch_everywhere(spark, sf):
    spans = _kept(explode_spans(mask(forms(spark, sf).select("doc_id", "text")), *ID).select(*_REVIEWED), "spans")  # detection runs once
    ask = spans.where("start = 9").select("doc_id", "entity_id")
    off = spans.where("type = 'DOC_ID' AND doc_id % 4 = 3").select("doc_id", "entity_id")
    return W.toggle_everywhere(spans, off, ask, ID)


def _form_spans(spark, sf):
    """Spans of forms, some of which have no number; the order's key stays beside it."""
    return _masked_forms(spark, sf).select("doc_id", "nr", F.explode("spans").alias("_s")).select("doc_id", "nr", "_s.*")


def _masked_forms(spark, sf):
    return mask(forms(spark, sf).selectExpr("CASE WHEN doc_id % 3 <> 0 THEN doc_id END AS doc_id", "doc_id AS nr", "text"))


# Requests on the first span of each form, in order: everywhere, itself, in every other form everywhere again; on the last one, itself.
_LOG = """explode(CASE WHEN start = low THEN filter(array(struct(nr * 10 + 1 AS seq, true AS everywhere), struct(nr * 10 + 2 AS seq, false AS everywhere),
 struct(nr * 10 + 3 AS seq, true AS everywhere)), (x, i) -> i < 2 OR nr % 2 = 0) WHEN start = high THEN array(struct(nr * 10 + 4 AS seq, false AS everywhere)) END) AS r"""


def switch_sequence(spark, sf):
    ids = ["doc_id", "nr"]
    spans = _kept(_form_spans(spark, sf), "spans")  # detection runs once
    ends = spans.groupBy("nr").agg(F.min("start").alias("low"), F.max("start").alias("high"))
    log = spans.join(ends, "nr").selectExpr(*ids, "entity_id", _LOG).select(*ids, "entity_id", "r.*")
    off = spans.where("type = 'DOC_ID' AND nr % 4 = 3").select(*ids, "entity_id")
    rules = spark.createDataFrame([("none", "USER")], "source string, type string")
    return W.switch_sequence(spans, off, rules, log, ids)[0]


def masked_with_null_ids(spark, sf):
    """Switches of forms without a number are kept apart by the other key, and found although the number is null."""
    masked = _once(_masked_forms(spark, sf), "doc_id", "nr", "clean_text", "spans")
    off = masked.select("doc_id", "nr", F.explode("spans").alias("s")).where("s.type IN ('DOC_ID', 'DATE')").select("doc_id", "nr", "s.entity_id")
    return W.apply_switches(masked, off, ["doc_id", "nr"]).select("doc_id", "nr", "masked_text")


def imported_user_rules(spark, sf):
    """Pairs of user origin become user rules, which are then found in other texts (with the mail notes' detections)."""
    envelopes = rule_pairs.export_envelopes(_merged(spark, sf), ID, _AT)
    pairs = rule_pairs.import_envelopes(envelopes, "rules_json", ID)
    return P.user_rules_of(pairs, ID).select("doc_id", "source", "type")


def export_after_reverse(spark, sf):
    """Pairs imported in reverse are exported swapped, so files keep their direction."""
    restored = corpus.apply_rule_list(_coded_notes(spark, sf), _list_pairs(spark, sf), ID, direction="reverse")
    swap = P.swap_on_export("imported", "reverse")
    return P.collect_pairs(explode_spans(restored, *ID), swap=swap).select("entity_type", "source", "replacement")


def _coded_notes(spark, sf):
    """Notes in which the stand-ins of the list stand for the customers."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return orders.selectExpr("o_orderkey AS doc_id", "concat('order of <C', o_custkey, '>, copy to <C', o_custkey * 7 % 100, '>') AS text")


def masked_with_switches(spark, sf):
    masked = _once(mask(documents(spark, sf)), "doc_id", "clean_text", "spans")
    off = explode_spans(masked, *ID).where("type IN ('CARD', 'IP')").select("doc_id", "entity_id")
    return W.apply_switches(masked, off, ID).select("doc_id", "masked_text")


def collect_pairs(spark, sf):
    return P.collect_pairs(_doc_spans(spark, sf), swap=True).select(*P.PAIR_FIELDS)


_AT = "2024-01-01T00:00:00.000Z"


def export_pairs(spark, sf):
    return rule_pairs.export_envelopes(mask(documents(spark, sf)), ID, _AT)


def import_pairs(spark, sf):
    out = rule_pairs.export_envelopes(mask(documents(spark, sf)), ID, _AT)
    pairs = rule_pairs.import_envelopes(out, "rules_json", ID)
    return pairs.select("doc_id", F.col("ord").cast("bigint").alias("ord"), *P.PAIR_FIELDS)


def _list_pairs(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        "CAST(c_custkey AS INT) AS ord", "'USER' AS entity_type", "CASE WHEN c_custkey % 2 = 0 THEN 'user' ELSE 'system' END AS origin",
        "c_name AS source", "concat('<C', c_custkey, '>') AS replacement", "CAST(NULL AS STRING) AS region", "CAST(NULL AS STRING) AS rule_id",
    )


def apply_list_forward(spark, sf):
    out = corpus.apply_rule_list(notes(spark, sf), _list_pairs(spark, sf), ID)
    return out.select("doc_id", "masked_text", "applied", "skipped")


def _imported(spark, sf):
    return corpus.apply_rule_list(notes(spark, sf), _list_pairs(spark, sf), ID)


def imported_mapping(spark, sf):
    return _mapping_rows(mapping(_imported(spark, sf), *ID))


def imported_switches(spark, sf):
    applied = _imported(spark, sf)
    off = explode_spans(applied, *ID).where("entity_id = 'IMPORTED_1'").select("doc_id", "entity_id")
    return W.apply_switches(applied, off, ID, "text").select("doc_id", "masked_text")


def pairs_order(spark, sf):
    pairs = P.collect_pairs(explode_spans(mask(forms(spark, sf).select("doc_id", "text")), *ID), ID)
    return pairs.select("doc_id", "ord", *P.PAIR_FIELDS)


# Envelopes made of orders, one kind of fault for each remainder; the first two are sound.
_FAULTS = (
    """'{"schemaVersion":"2.0","rules":[{"entityType":"EMAIL","origin":"system","source":"a","replacement":"b"}]}'""",
    """'{"schemaVersion":"2.0","rules":[]}'""",
    """'{"schemaVersion":"1.0","rules":[]}'""",
    """'{"schemaVersion":"2.0","rules":{}}'""",
    """concat('{"schemaVersion":"2.0","rules":[{"entityType":"EMAIL","origin":"system","source":', o_custkey, ',"replacement":"b"}]}')""",
    """'{"schemaVersion":"2.0","rules":[{"entityType":"EMAIL","origin":"system","source":" ","replacement":"b"}]}'""",
    """'{"schemaVersion":"2.0","rules":[{"entityType":"EMAIL","origin":"other","source":"a","replacement":"b"}]}'""",
    """concat('{"schemaVersion":"2.0","rules":[{"entityType":"KIND', o_custkey, '","origin":"user","source":"a","replacement":"b"}]}')""",
    """concat('no json ', o_custkey)""",
)


def import_refusals(spark, sf):
    whens = " ".join(f"WHEN {i} THEN {text}" for i, text in enumerate(_FAULTS))
    files = table(spark, sf, "orders").selectExpr("o_orderkey", f"CASE o_orderkey % {len(_FAULTS)} {whens} END AS j")
    return rule_pairs.parse_envelopes(files, "j").select("o_orderkey", (~F.col("valid")).alias("refused"))


def extended_profile_forms(spark, sf):
    found = detect(forms(spark, sf).select("doc_id", "text"), profile="extended")
    return _spans_of(found)


def extended_profile_register(spark, sf):
    return _spans_of(detect(register(spark, sf), profile="extended"))


def registered_rule(spark, sf):
    """A rule of the caller with both quote marks, a validator and a context."""
    rule = Rule("custom.quoted", "DOC_ID", "[\"']?Customer#[0-9]+[\"']?", 99, "format",
                validator=lambda v: F.length(v) >= 18, context=lambda w: F.contains(w, F.lit("Customer#")))
    found = detect(notes(spark, sf), rules=register_rule([], rule))
    return explode_spans(found, *ID).select("doc_id", F.col("start").cast("bigint").alias("start"), "source", "rule_id")


def blank_texts(spark, sf):
    """Texts without any character or any word pass through."""
    rows = table(spark, sf, "orders").selectExpr("o_orderkey AS doc_id", "CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' \\n ' END AS text")
    return mask(rows).select("doc_id", "masked_text", F.coalesce(F.array_size("spans"), F.lit(0)).cast("bigint").alias("n"))


def span_ids(spark, sf):
    spans = _raw_spans(spark, sf).selectExpr("*", "CASE WHEN ord % 2 = 0 THEN concat('GIVEN_', ord) END AS given")
    made = W.entity_id(F.lit("USER"), F.col("start"), F.col("end"), F.col("given"))
    return spans.select("doc_id", F.col("ord").cast("bigint").alias("ord"), made.alias("entity_id"))


def apply_list_summary(spark, sf):
    pairs = spark.createDataFrame(
        [(0, "USER", "user", "Customer#00000000", "<few>", None, None), (1, "USER", "system", "Customer#", "<any>", None, None)],
        "ord int, entity_type string, origin string, source string, replacement string, region string, rule_id string",
    )
    return corpus.rule_list_summary(corpus.apply_rule_list(notes(spark, sf), pairs, ID, strategy="constant"))


def apply_scoped_reverse(spark, sf):
    masked = _once(mask(forms(spark, sf).select("doc_id", "text")), "doc_id", "spans", "masked_text")
    pairs = P.collect_pairs(explode_spans(masked, *ID), ID)
    back = P.apply_pairs(masked.select("doc_id", F.col("masked_text").alias("m")), pairs, ID, "reverse", "m")
    return back.select("doc_id", F.col("masked_text").alias("restored_text"), "applied", "skipped")


_RESTORED = ("doc_id", "spans", "masked_text")


def restore_documents(spark, sf):
    masked = _once(mask(documents(spark, sf)), *_RESTORED)
    return roundtrip.restored(masked, ID).select("doc_id", "restored_text")


def roundtrip_audit(spark, sf):
    return roundtrip.roundtrip_audit(_once(mask(documents(spark, sf)), *_RESTORED, "clean_text"), ID)


def restore_synthetic(spark, sf):
    """Synthetic values repeat (IP, cards, dates), so they are put back by position."""
    masked = _once(mask(documents(spark, sf), mode="synthetic"), *_RESTORED)
    return roundtrip.restored(masked, ID, by="positions").select("doc_id", "restored_text")


def restore_forms_synthetic(spark, sf):
    masked = _once(mask(forms(spark, sf).select("doc_id", "text"), mode="synthetic"), *_RESTORED)
    return roundtrip.restored(masked, ID, by="positions").select("doc_id", "restored_text")


def _with_old_tags(spark, sf):
    """Notes that hold texts like tags before they are masked."""
    return mail_notes(spark, sf).selectExpr("CASE WHEN doc_id % 7 <> 0 THEN doc_id END AS doc_id",
                                            "doc_id AS nr", "concat('[EMAIL_1] and [IP_', doc_id % 3, ']: ', text) AS text")


def roundtrip_audit_positions(spark, sf):
    """Texts that hold tags already, some ids null: ids and numbers identify them together."""
    masked = _once(mask(_with_old_tags(spark, sf)), *_RESTORED, "nr", "clean_text")
    return roundtrip.roundtrip_audit(masked, ["doc_id", "nr"], by="positions")


def roundtrip_audit_tags(spark, sf):
    """The same by tags, where an old tag that is also a new one cannot be told apart."""
    masked = _once(mask(_with_old_tags(spark, sf)), *_RESTORED, "nr", "clean_text")
    return roundtrip.roundtrip_audit(masked, ["doc_id", "nr"])


def pii_profile(spark, sf):
    docs = documents(spark, sf, "lang", "source").withColumnRenamed("source", "origin")
    return profile.pii_profile(explode_spans(mask(docs), *ID, "lang", "origin"), ["lang", "type", "rule_id"])


def pii_profile_merged(spark, sf):
    """Profiles of three runs, by the remainder of the id, stored and added up."""
    docs = documents(spark, sf, "lang", "source").withColumnRenamed("source", "origin")
    spans = explode_spans(mask(docs), *ID, "lang", "origin")
    by = ["lang", "type", "rule_id"]
    runs = _kept(profile.profile_sketches(spans.withColumn("run", F.col("doc_id") % 3), ["run", *by]), "profiles")
    return profile.merged_profile(runs, by)


def restore_bucketed(spark, sf):
    """Masked documents and mapping as bucketed tables, restored without a shuffle."""
    masked = mask(documents(spark, sf))
    mark = uuid.uuid4().hex
    names = (f"masked_{mark}", f"vault_{mark}")
    kept = _kept(masked.drop("text", "clean_text"), "masked")  # detection runs once
    write_restorable(kept.drop("spans"), mapping(kept, *ID), ID, names, 8, tuple(f"{_scratch(spark)}/{n}" for n in names))
    restored, records = read_restorable(spark, names)
    return roundtrip.restored(restored, [DOC_KEY], records, by="positions", null_ids=False).select("doc_id", "restored_text")


def import_pairs_once(spark, sf):
    """A pair table, written with its head and read back in one pass."""
    path = f"{_scratch(spark)}/pairs-{uuid.uuid4().hex}"
    long = P.collect_pairs(_doc_spans(spark, sf), ID)
    rule_pairs.write_pairs(long, f"{path}/out", _AT)
    pairs = rule_pairs.read_pairs(spark, f"{path}/out", "doc_id bigint, ord bigint", into=f"{path}/in")
    return pairs.select("doc_id", "ord", *P.PAIR_FIELDS)


def pii_rollup(spark, sf):
    docs = documents(spark, sf, "lang")
    return profile.pii_rollup(explode_spans(mask(docs), *ID, "lang"), "lang", "type")


def documents_with_pii(spark, sf):
    return profile.documents_with_pii(mask(documents(spark, sf, "lang")), "lang")


def corpus_pseudonyms(spark, sf):
    found = _kept(detect(documents(spark, sf)).select("doc_id", "clean_text", "spans"), "detected")  # detection runs once; both passes read it
    return corpus.corpus_pseudonyms(found, "doc_id", checkpoint_dir=_scratch(spark)).select("doc_id", "masked_text")


def corpus_pseudonyms_over_runs(spark, sf):
    """Two runs on one dictionary: first the documents whose id is even, then all; the values of the first keep their numbers."""
    found = _kept(detect(documents(spark, sf)).select("doc_id", "clean_text", "spans"), "detected")
    path = f"{_scratch(spark)}/dictionary-{uuid.uuid4().hex}"
    even = found.where("doc_id % 2 = 0")
    corpus.extend_dictionary(explode_spans(even, *ID), "doc_id", path, _scratch(spark))
    return corpus.corpus_pseudonyms(found, "doc_id", checkpoint_dir=_scratch(spark), dictionary=path).select("doc_id", "masked_text")


def _document_stream(spark, sf):
    """The documents as a stream, from one file or a folder of files: a plain path may name a folder only, a glob either."""
    schema = table(spark, sf, "documents").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{{documents.parquet}}").select("doc_id", "text")


def stream_mask(spark, sf):
    out = f"{_scratch(spark)}/stream-{uuid.uuid4().hex}"
    stream = _document_stream(spark, sf)
    masking_stream.write_masked_stream(masking_stream.mask_stream(stream), f"{out}/data", f"{out}/log").awaitTermination()
    return spark.read.parquet(f"{out}/data").select("doc_id", "masked_text")


def _published(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Masked documents and their mapping, both written by a stream and read back."""
    out = f"{_scratch(spark)}/stream-{uuid.uuid4().hex}"
    stream = _document_stream(spark, sf)
    paths = f"{out}/masked", f"{out}/vault"
    masking_stream.write_stream_with_mapping(masking_stream.mask_stream(stream), ID, *paths, f"{out}/log").awaitTermination()
    return tuple(masking_stream.read_published(spark, p) for p in paths)


def stream_mapping(spark, sf):
    _, records = _published(spark, sf)
    return _mapping_rows(records)


def stream_restore(spark, sf):
    masked, records = _published(spark, sf)
    return roundtrip.restored(masked, ID, records, by="positions").select("doc_id", "restored_text")


QUERIES: dict[str, Query] = {
    **{f"rule_{r.rule_id.replace('.', '_')}": _rule_query(r.rule_id, forms) for r in ALL_RULES},
    **{
        f"documents_{name}": _rule_query(f"universal.{name}", documents)
        for name in ("email", "phone", "ipv4", "card", "swiftbic")
    },
    "mask_documents_tag": _masked(documents, "tag"),
    "mask_documents_synthetic": _masked(documents, "synthetic"),
    "mask_forms_tag": _masked(lambda s, d: forms(s, d).select("doc_id", "text"), "tag"),
    "mask_forms_synthetic": _masked(lambda s, d: forms(s, d).select("doc_id", "text"), "synthetic"),
    "user_rules_null_ids_joined": _without_some_ids("join"),
    "user_rules_null_ids_constant": _without_some_ids("constant"),
    **{
        f.__name__: f
        for f in (
            normalise_text, detect_documents, detect_forms, detect_forms_ru_only, mask_conversations, mask_pages, mapping_table,
            validators, replacement_templates, literal_occurrences, resolve_overlaps_table, resolve_overlaps_array, gap_fill,
            user_rules_merge, user_rules_merge_joined, user_rules_spans, user_rules_long_list, rule_table_edits, review_groups, frequencies,
            present_types_and_regions, review_filter, total_detections, switch_local, switch_everywhere, switch_sequence, masked_with_switches, masked_with_null_ids,
            imported_user_rules, export_after_reverse,
            collect_pairs, pairs_order, export_pairs, import_pairs, import_refusals, apply_list_forward, apply_list_summary,
            imported_mapping, imported_switches, extended_profile_forms, extended_profile_register, registered_rule, blank_texts, span_ids, apply_scoped_reverse,
            restore_documents, restore_synthetic, restore_forms_synthetic, roundtrip_audit, roundtrip_audit_positions, roundtrip_audit_tags, pii_profile,
            pii_profile_merged, restore_bucketed, import_pairs_once, pii_rollup, documents_with_pii, corpus_pseudonyms, corpus_pseudonyms_over_runs, stream_mask,
            stream_mapping, stream_restore,
        )
    },
}
