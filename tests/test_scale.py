"""Long literal lists, one island of very many spans, and requests in order."""

import random

import pytest
from pyspark.sql import functions as F

from cloakwork.catalogue import MANUAL_RULE
from cloakwork.operators import literals as L
from cloakwork.operators import review as W
from cloakwork.operators.overlaps import resolve_overlaps
from tests import brute

ID = ["doc_id"]


def given(spark, texts, rules, strategy):
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    rules = spark.createDataFrame(rules, "source string, type string")
    out = L.attach_rules(df, rules, ID, "text", strategy)
    hits = out.select("doc_id", "text", L.literal_hits(F.col("text"), F.col(L.RULES)).alias("h"))
    return sorted((str(r.doc_id), str(r.text), sorted((h.rule.source, h.rule.type, h.start, h.end) for h in r.h or [])) for r in hits.collect())


def random_lists(seed):
    rng = random.Random(seed)
    letters = ["a", "b", "ab ", "é", "😀", "\n", "0"]
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    texts = [(rng.choice([None, 1, 2, 3, 4]), word(rng.randrange(60))) for _ in range(60)] + [(5, None), (5, ""), (None, "x" * 5000 + "ab 0ab 0ab 0")]
    rules = [(word(rng.randrange(1, 9)), rng.choice(["USER", "ORG"])) for _ in range(40)] + [("", "USER"), ("ab 0ab 0ab 0", "ORG"), ("x" * 30, "USER"), ("x" * 30, "USER")]
    return texts, rules


@pytest.mark.parametrize("seed", range(2))
def test_joined_lists_equal_constant_ones(spark, seed):
    texts, rules = random_lists(seed)
    assert given(spark, texts, rules, "join") == given(spark, texts, rules, "constant")


def test_frequent_grams_are_not_used_or_salted(spark, monkeypatch):
    """All literals share their beginning, one is a gram that every text holds, and grams count as hot from three texts on."""
    monkeypatch.setattr(L, "HOT_LEAST", 2)
    monkeypatch.setattr(L, "HOT_SHARE", 10**9)
    monkeypatch.setattr(L, "SALTS", 5)
    texts = [(i, f"order {i} of Customer#{i % 50:09d}, copy to Customer#{i * 7 % 50:09d}") for i in range(300)]
    rules = [(f"Customer#{i:09d}", "USER") for i in range(0, 400, 2)] + [("Customer", "ORG"), (" of ", "ORG")]
    assert given(spark, texts, rules, "join") == given(spark, texts, rules, "constant")
    # What the join hands on: filed under their beginning, all 200 literals would reach all 300 texts.
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    pairs = L._by_gram(df, spark.createDataFrame(rules, "source string, type string"), ID, "text")
    assert pairs.where("length(source) > 10").count() < 1_000


def test_empty_lists_and_tables(spark):
    texts, rules = random_lists(9)
    assert given(spark, texts, [("", "USER")], "join") == given(spark, texts, [("", "USER")], "constant")
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    none = spark.createDataFrame([], "source string, type string")
    assert L.attach_rules(df, none, ID, "text").where(F.size(L.RULES) > 0).count() == 0
    assert L.attach_rules(df.limit(0), spark.createDataFrame(rules, "source string, type string"), ID, "text").count() == 0


def test_a_long_list_is_no_constant(spark, monkeypatch):
    monkeypatch.setattr(L, "CONSTANT_RULES", 3)
    df = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    rules = spark.createDataFrame([(c, "USER") for c in "abcd"], "source string, type string")
    with pytest.raises(ValueError, match="too long"):
        L.attach_rules(df, rules, ID, "text", "constant")


@pytest.mark.parametrize("words", [64, 1 << 14])
def test_bit_table_lets_every_gram_through(spark, words, monkeypatch):
    monkeypatch.setattr(L, "MAX_WORDS", words)
    monkeypatch.setattr(L, "WORDS_PER_ROW", 1 << 8)
    texts, rules = random_lists(4)
    rules += [(f"{i}-{i * i}", "ORG") for i in range(3_000)]
    assert given(spark, texts + [(9, "17-289 and 2999-8994001")], rules, "join") == given(spark, texts + [(9, "17-289 and 2999-8994001")], rules, "constant")


# --- overlaps ---------------------------------------------------------------------------


def span_frame(spark, cases, ids):
    rows = [(a, b, *s) for (a, b), case in zip(ids, cases, strict=True) for s in case]
    return spark.createDataFrame(rows, "a bigint, b string, start int, end int, priority int, ord int")


@pytest.mark.parametrize("block", [1, 64])
def test_islands_over_many_blocks(spark, block):
    rng = random.Random(block)
    cases = []
    for _ in range(150):
        spans = []
        for i in range(rng.randrange(1, 80)):
            s = rng.randrange(120)
            spans.append((s, s + rng.choice([1, 2, 7, 30, 119]), rng.choice([60, 61, 70, 99]), i))
        cases.append(spans)
    ids = [(None if k % 3 == 0 else k, None if k % 2 else f"d{k}") if k > 10 else (k, "x") for k in range(150)]
    together = {}
    for key, case in zip(ids, cases, strict=True):  # rows with equal ids are one document
        together.setdefault(key, []).extend((s, e, p, 100 * len(together.get(key, [])) + i) for s, e, p, i in case)
    got = {}
    for r in resolve_overlaps(span_frame(spark, together.values(), together.keys()), ["a", "b"], block).collect():
        got.setdefault((r.a, r.b), []).append((r.start, r.end, r.priority, r.ord))
    for key, case in together.items():
        assert sorted(got.get(key, [])) == brute.sweep(case), key


def test_one_island_of_a_million_spans(spark):
    """Every span overlaps the next one; the strong ones are the survivors, and each evicts the one before."""
    n = 1_000_000
    spans = spark.range(n, numPartitions=8).selectExpr(
        "1 AS doc_id", "CAST(id * 3 AS INT) AS start", "CAST(id * 3 + 4 AS INT) AS end", "CAST(60 + id % 10 AS INT) AS priority", "0 AS ord")
    out = resolve_overlaps(spans, ID)
    kept = out.withColumn("task", F.spark_partition_id()).selectExpr("count(*) AS n", "min(priority) AS low", "count(DISTINCT task) AS tasks").first()
    # Priorities rise for ten spans, each stronger than the one it overlaps, so each evicts it; the next rise starts with a weaker one, which loses.
    # What follows a loser no longer meets the strong span, so the second of each rise is accepted and evicted in its turn.
    assert (kept.n, kept.low) == (n // 10, 69) and kept.tasks > 1


def test_exchanges_of_the_table_form(spark, tmp_path):
    spark.range(1000).selectExpr("id % 7 AS doc_id", "CAST(id AS INT) AS start", "CAST(id + 3 AS INT) AS end", "60 AS priority", "0 AS ord", "'x' AS note").write.parquet(str(tmp_path / "s"))
    out = resolve_overlaps(spark.read.parquet(str(tmp_path / "s")), ID)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count(" Exchange ") + plan.count("BroadcastExchange") <= 3


# --- switches ---------------------------------------------------------------------------


def replay(spans, off, rules, log):
    """Requests one by one, as a user makes them."""
    off, rules = set(off), set(rules)
    for doc, entity, _, everywhere in sorted(log, key=lambda r: r[2]):
        hit = [s for s in spans if (s[0], s[1]) == (doc, entity)]
        if not hit:
            continue
        _, _, source, manual, type_ = hit[0]
        if not everywhere:
            off ^= {(doc, entity)}
        elif manual:
            rules.discard((source, type_))
        else:
            state = (doc, entity) in off
            for d, e, s, m, _ in spans:
                if d == doc and s == source and not m:
                    off.discard((d, e)) if state else off.add((d, e))
    return off, rules


def test_requests_in_order(spark):
    rng = random.Random(2)
    docs = [None, *range(1, 25)]
    spans = [(d, f"e{k}", rng.choice("abc"), rng.random() < 0.2, rng.choice(["USER", "ORG"])) for d in docs for k in range(8)]
    off = [(d, e) for d, e, *_ in spans if rng.random() < 0.4] + [(None, "gone"), (3, "gone")]
    rules = [(s, t) for s in "abc" for t in ("USER", "ORG")]
    log = [(d, f"e{rng.randrange(9)}", 1000 * k + i, rng.random() < 0.5) for i, d in enumerate(docs) for k in range(rng.randrange(12))]
    frame = spark.createDataFrame([(d, e, s, MANUAL_RULE if m else "r", t) for d, e, s, m, t in spans], "doc_id bigint, entity_id string, source string, rule_id string, type string")
    off_frame = spark.createDataFrame(off, "doc_id bigint, entity_id string")
    rule_frame = spark.createDataFrame(rules, "source string, type string")
    requests = spark.createDataFrame(log, "doc_id bigint, entity_id string, seq bigint, everywhere boolean")
    got_off, got_rules = W.switch_sequence(frame, off_frame, rule_frame, requests, ID)
    want_off, want_rules = replay(spans, off, rules, log)
    assert {tuple(r) for r in got_off.collect()} == want_off and got_off.count() == len(want_off)
    assert {tuple(r) for r in got_rules.collect()} == want_rules
    # One request everywhere: both functions say the same.
    one = requests.where("everywhere").limit(1)
    assert sorted(map(str, W.toggle_everywhere(frame, off_frame, one, ID).collect())) == sorted(map(str, W.switch_sequence(frame, off_frame, rule_frame, one, ID)[0].collect()))


@pytest.mark.parametrize("seqs", [(1, 1), (None, 1)])
def test_requests_without_an_order_fail(spark, seqs):
    spans = spark.createDataFrame([(1, "e0", "a", "r", "USER"), (1, "e1", "a", "r", "USER")], "doc_id bigint, entity_id string, source string, rule_id string, type string")
    off = spark.createDataFrame([(1, "e0")], "doc_id bigint, entity_id string")
    rules = spark.createDataFrame([("a", "USER")], "source string, type string")
    log = spark.createDataFrame([(1, f"e{k}", s, True) for k, s in enumerate(seqs)], "doc_id bigint, entity_id string, seq int, everywhere boolean")
    with pytest.raises(Exception, match="without an order"):
        W.switch_sequence(spans, off, rules, log, ID)[0].collect()
    with pytest.raises(Exception, match="disagree"):
        W.toggle_everywhere(spans, off, log, ID).collect()
