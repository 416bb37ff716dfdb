"""Packing, language model, mixing, near dedup, toxicity and top-k search against plain models."""

import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cloakwork.llm import lm_scoring, mixing, near_dedup, packing, topk_search, toxicity
from cloakwork.llm.common import cut, remainder
from cloakwork.llm.tokens import encoder

PATH = packing.default_tokenizer()
TOKENIZER = Tokenizer.from_file(PATH)
CLASH = "doc_id bigint, text string, id string, n string, node string, rank string, source string"


def clash(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", f"s{k % 3}") for k, (i, t) in enumerate(rows)], CLASH)


EDGES = [(1, None), (2, ""), (3, " "), (4, "one"), (5, "a b c d"), (6, "A  b\tc\n d"), (7, "word " * 40_000), (7, "other text here to see"), (8, "same"), (8, "same"), (None, "no id at all here")]


PARTS = [*"ab1 '.\n\t  \u00e9\u4e2d\x1c\x85\u00a0\u3000", "<|endoftext|>", "'s", " the", "  "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=30).map("".join))
def test_cached_ids_are_the_tokenizers(text):
    assert np.frombuffer(encoder(PATH)(text), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def check_packing(texts, rows, size=packing.SEQUENCE):
    """``texts``: list of (id, text); every id list is cut and placed once."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    need = defaultdict(Counter)
    for i, t in texts:
        ids = np.array([*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for s in range(0, len(ids), size):
            need[i][(s, min(size, len(ids) - s), zlib.crc32(ids[s : s + size].tobytes()), len(ids))] += 1
    assert {i: Counter((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in part) for i, part in by_doc.items()} == dict(need)
    for part in by_seq.values():
        at = 0
        for r in sorted(part, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return sum(r["length"] for r in rows), len(by_seq)


def test_packing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    tokens, sequences = check_packing([tuple(r) for r in docs.collect()], packing.pack_documents(docs).collect())
    assert sequences <= math.ceil(tokens / 2048) * 1.02 + 1
    check_packing(EDGES, packing.pack_documents(clash(spark, EDGES)).collect())
    assert packing.pack_documents(docs.limit(0)).count() == 0


def first_fit(demand):
    bins = []
    for k in range(len(demand), 0, -1):
        for _ in range(demand[k - 1]):
            for j, room in enumerate(bins):
                if room >= k:
                    bins[j] -= k
                    break
            else:
                bins.append(len(demand) - k)
    return len(bins)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=20, max_size=20))
def test_plan_places_everything_and_is_near_the_bound(demand):
    demand = np.array(demand)
    plan = packing.plan_sequences(demand)
    assert (sum((p * n for p, n in plan), np.zeros(20, np.int64)) == demand).all()
    assert all((p * np.arange(1, 21)).sum() <= 20 and n > 0 for p, n in plan)
    used, volume = sum(n for _, n in plan), math.ceil((demand * np.arange(1, 21)).sum() / 20)
    assert volume <= used <= first_fit(demand) + 2


def test_known_cutting_stock():
    demand = np.zeros(20, np.int64)
    demand[[9, 6, 2]] = [40, 80, 40]  # 7 + 7 + 3 + 3 wastes nothing, nor does 10 + 10: 20 + 40 sequences
    assert 58 <= sum(n for _, n in packing.plan_sequences(demand)) <= 62


def plain_model(texts, held, mu, delta):
    uni, bi, n = Counter(), Counter(), 0
    split = {k: [*(t or "").encode().lower().split(), b"\n"] for k, (_, t) in enumerate(texts)}
    for k, words in split.items():
        if not held[k]:
            uni.update(words)
            bi.update(zip(words, words[1:], strict=False))
            n += len(words)
    v = len(uni)
    out = []
    for k, words in split.items():
        score = base = 0.0
        for j, w in enumerate(words):
            p = (uni[w] + delta) / (n + delta * (v + 1))
            if j:
                p = (bi[words[j - 1], w] + mu * p) / (uni[words[j - 1]] + mu)
            score += math.log10(p)
            base += math.log10((uni[w] + 1) / (n + v + 1))
        out.append((texts[k][0], held[k], len(words), sum(uni[w] > 0 for w in words), n, round(base, 5), round(score, 5)))
    return sorted(out, key=repr), v


@pytest.mark.parametrize("edges", [False, True])
def test_lm_against_plain_model(spark, sf, edges):
    docs = clash(spark, EDGES) if edges else spark.read.parquet(f"{sf}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in texts]
    got = lm_scoring.lm_scores(docs, remainder("doc_id", 7) != 2).collect()
    got = sorted(((r[0], r[1], r[2], r[3], r[4], round(r[5], 5), round(r[6], 5)) for r in got), key=repr)
    want, _ = plain_model(texts, held, lm_scoring.MU, lm_scoring.DELTA)
    assert got == want
    if not edges:
        assert sum(r[6] for r in got if r[1]) > sum(r[5] for r in got if r[1])  # better than the base on texts not seen


def test_lm_higher_order_and_empty(spark):
    docs = spark.createDataFrame([(i, "the cat sat on the mat") for i in range(5)] + [(9, "the cat sat on the dog")], "doc_id bigint, text string")
    two, three = (lm_scoring.lm_scores(docs, F.lit(True), order=o).where("doc_id = 0").first()["score"] for o in (2, 3))
    assert two < three < 0
    none = lm_scoring.lm_scores(docs, F.lit(False)).first()
    assert none["score"] == none["train_tokens"] == 0
    assert lm_scoring.lm_scores(docs.limit(0), F.lit(True)).count() == 0


def test_exponent():
    tokens = [1000, 100, 10]
    e = mixing.exponent_for(tokens, None, 4.0, 1.0)
    assert max(mixing.repetition(tokens, mixing.weights(tokens, e), 1.0)) == pytest.approx(4.0)
    e = mixing.exponent_for(tokens, 1.0, 1e9, 1.0)
    assert mixing.entropy(mixing.weights(tokens, e)) == pytest.approx(1.0)
    assert mixing.exponent_for([5, 5], None, 1.0, 1.0) == 0.0


def test_mixing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "big").otherwise(F.col("source"))).withColumn("_tokens", F.lit(1))
    plain = {r["doc_id"]: (r["source"], len((r["text"] or "").encode().split())) for r in docs.collect()}
    by = Counter()
    for s, t in plain.values():
        by[s] += t
    plan = {b.source: b for b in mixing.budgets([mixing.Share(s, t, 1) for s, t in sorted(by.items())])}
    report = mixing.mix(docs, with_report=True, block_rows=7).collect()
    drawn, count = Counter(), Counter()
    for r in report:
        drawn[r["source"]] += r["tokens"]
        count[r["id"]] += 1
    assert set(count) == set(plain)
    for s, b in plan.items():
        longest = max(t for x, t in plain.values() if x == s)
        assert b.tokens - longest < drawn[s] <= b.tokens
        assert all(b.whole <= count[i] <= b.whole + 1 for i, (x, _) in plain.items() if x == s)
    assert max(drawn[s] / by[s] for s in by) <= mixing.REPEATS + 1e-9
    out = mixing.mix(docs, block_rows=7)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == count


def test_mixing_edges(spark):
    df = clash(spark, EDGES).withColumn("source", F.when(F.col("doc_id") == 5, None).otherwise(F.col("source")))
    out = mixing.mix(df)
    assert out.columns == df.columns
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == set(EDGES)
    assert sum(r["doc_id"] == 8 for r in out.collect()) >= 2
    empty = df.where("text is null")
    assert mixing.mix(empty).count() == 1 and mixing.mix(df.limit(0)).count() == 0


def sets_of(text):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def plain_components(texts):
    sets = [sets_of(t) for _, t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
            root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(texts):
        r = find(k)
        low[r] = min(low.get(r, i), i)
    return sorted((i, len(sets[k]), low[find(k)], i == low[find(k)]) for k, (i, _) in enumerate(texts))


def near_fixture():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    texts = []
    for _ in range(25):  # chains: each text changes the one before a little, so only neighbours are alike
        words = [word() for _ in range(60)]
        for _ in range(rng.randint(1, 6)):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = word()
    passage = " ".join(word() for _ in range(40))
    texts += [f"{passage} {' '.join(word() for _ in range(rng.randint(5, 60)))}" for _ in range(120)]  # a shared passage alone links nothing
    texts += [None, "", " \n", "one two", "One  TWO", "one two three", texts[0].upper(), texts[0]]
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 6_000])
def test_near_components(spark, monkeypatch, block):
    texts = near_fixture()
    monkeypatch.setattr(near_dedup.links_between, "__defaults__", (block,))
    got = near_dedup.near_groups(clash(spark, texts)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == plain_components(texts)


@pytest.mark.parametrize("task", [7, 200_000])
def test_components_in_parts_and_whole(spark, task):
    rng = random.Random(5)
    pairs = [(k, k + 1) for k in range(100, 140)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(70)] + [(200, 200), (140, 100)]
    low = {k: k for k in range(300)}
    for _ in low:
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    got = near_dedup.components(spark.createDataFrame(pairs, "a bigint, b bigint").repartition(5), task).collect()
    assert sorted(map(tuple, got)) == [(k, v) for k, v in low.items() if k != v]


def test_components_of_few_links_take_few_steps(spark):
    """Every round of stars shuffles several times over all partitions, whatever the number of links."""
    edges = cut(spark.createDataFrame([(k, k + 1) for k in range(100)], "a bigint, b bigint"))
    spark.sparkContext.setJobGroup("few-links", "")
    try:
        assert near_dedup.components(edges).count() == 100
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-links")) <= 8
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_near_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain_components([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    got = near_dedup.near_groups(docs).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == want
    kept = near_dedup.drop_near(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [w[0] for w in want if w[3]]


def random_sets(rng, groups, size):
    """Sets that share cores of all shares, and small ones; hashes are sorted and distinct."""
    sets = []
    for _ in range(groups):
        core = rng.integers(0, 2**63, size)
        for _ in range(rng.integers(1, 9)):
            keep = core[: int(size * rng.choice([0.3, 0.7, 0.8, 0.85, 0.9, 1.0]))]
            own = rng.integers(0, 2**63, rng.integers(0, max(2, size // 4)))
            sets.append(np.unique(np.concatenate([keep, own])).astype(np.uint64))
    return [x for x in sets if len(x)]


@pytest.mark.parametrize("size", [1, 3, 8, 60])
@pytest.mark.parametrize("meetings", [3, 1 << 20])
def test_meetings_hold_every_link_between_components(monkeypatch, size, meetings):
    monkeypatch.setattr(near_dedup, "MEETINGS", meetings)
    rng = np.random.default_rng(size)
    sets = random_sets(rng, 25, size)
    component = rng.integers(0, len(sets) // 2, len(sets))
    want = {(a, b) for a, b in combinations(range(len(sets)), 2) if component[a] != component[b] and near_dedup._linked(sets[a], sets[b], 75)}
    met = {tuple(sorted(p)) for x, y in near_dedup.meetings(sets, component) for p in zip(x.tolist(), y.tolist(), strict=True)}
    assert want <= met and (want or size < 8)
    assert all(component[a] != component[b] for a, b in met)
    assert size < 8 or len(met) < 2 * len(want) + 40


def test_texts_that_share_a_core_hardly_meet():
    """3,000 texts at a similarity of 0.61: no pair of them is looked at."""
    rng = np.random.default_rng(4)
    core = rng.integers(0, 2**63, 76)
    sets = [np.unique(np.concatenate([core, rng.integers(0, 2**63, 24)])).astype(np.uint64) for _ in range(3_000)]
    assert sum(len(x) for x, _ in near_dedup.meetings(sets, np.arange(3_000))) == 0


def test_near_group_of_one_core(spark):
    """Texts at 0.61 to each other, some of which are near copies of another: components as all pairs have them."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    core, texts = [word() for _ in range(150)], []
    for k in range(400):
        own = [word() for _ in range(46)]
        texts.append((k, " ".join(core + own)))
        if k % 20 == 0:
            own[rng.randrange(46)] = word()
            texts.append((1_000 + k, " ".join(core + own)))
    got = near_dedup.near_groups(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    rows = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got)
    assert rows == plain_components(texts)
    assert sum(r[3] for r in rows) == 400


def test_near_many_rows_without_an_id(spark):
    """Rows are told apart by their texts: 3,000 null ids do not multiply."""
    words = [f"w{k}" for k in range(60)]
    texts = [(None, " ".join([*words[:50], str(k % 7), *words[50:]])) for k in range(3_000)] + [(5, " ".join(words))]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    ends = docs.select(F.lit(0).cast("bigint").alias("node"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"), "text").where("doc_id IS NULL").limit(1)
    mark = near_dedup._fingerprint(near_dedup.shingles(ends.first()["text"].encode(), near_dedup._Words()))
    near_dedup.ship(spark)
    made = near_dedup.item_sets(docs, ends.drop("text").withColumn("print", F.lit(mark)), "doc_id", "text")
    assert made.count() == 1
    got = near_dedup.near_groups(docs).collect()
    assert len(got) == 3_001 and {r["component_id"] for r in got} == {5}
    assert near_dedup.drop_near(docs).count() == 1


def test_near_edges(spark):
    df = clash(spark, EDGES)
    got = {(r["doc_id"], r["component_id"]) for r in near_dedup.near_groups(df).collect()}
    assert {(1, 1), (2, 2), (3, 3), (5, 5), (6, 5), (8, 8), (None, None)} <= got
    kept = Counter((r["doc_id"], r["text"]) for r in near_dedup.drop_near(df).collect())
    assert kept == Counter(x for x in set(EDGES) if x[0] != 6)
    assert near_dedup.near_groups(df.limit(0)).count() == near_dedup.drop_near(df.limit(0)).count() == 0


def test_circulant_minhash_estimates_jaccard():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.75, 0.9):
        both = rng.integers(0, 2**63, 400, dtype=np.uint64)
        n = int(400 * (1 / share - 1) / 2)
        a, b = (np.concatenate([both, rng.integers(0, 2**63, n, dtype=np.uint64)]) for _ in range(2))
        agree = [(near_dedup.signature(a ^ np.uint64(k)) == near_dedup.signature(b ^ np.uint64(k))).mean() for k in range(20)]
        assert abs(np.mean(agree) - share) < 0.03


def pair_rows(rng, n, label, noise=300):
    rows, y = [], []
    for _ in range(n):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.unique(np.concatenate([rng.integers(100, 100 + noise, 12), [11] * a, [22] * b])).astype(np.int32))
        y.append(int(label(a, b)))
    return rows, np.array(y)


def logits_of(machine, rows):
    return machine.logits(np.concatenate(rows).astype(np.int64), np.concatenate([[0], np.cumsum([len(r) for r in rows])]))


@pytest.mark.parametrize("label", [lambda a, b: a == b, lambda a, b: a != b])
def test_pairs_of_neutral_terms_are_learned(label):
    """Neither term says anything alone, so no additive weight could find them."""
    rng = np.random.default_rng(1)
    rows, y = pair_rows(rng, 4_000, label)
    assert max(abs(np.mean([v for r, v in zip(rows, y, strict=True) if t in r]) - y.mean()) for t in (11, 22)) < 0.05
    machine = toxicity.fit(rows[:3_000], y[:3_000])
    assert ((logits_of(machine, rows[3_000:]) > 0) == (y[3_000:] == 1)).mean() > 0.95


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    rows, y = pair_rows(rng, 600, lambda a, b: a and b)
    machine = toxicity.fit(rows, y)
    assert len(machine.weights) > 2
    for row, got in zip(rows[:50], logits_of(machine, rows[:50]), strict=True):
        at = [machine.index[t] for t in row]
        want = machine.bias + sum(machine.weights[i] for i in at) + sum(machine.pairs[i] @ machine.pairs[j] for i, j in combinations(at, 2))
        assert abs(got - want) < 1e-8
    assert toxicity.interactions(rows[:10], y[:10]) == [] and toxicity.interactions([], np.zeros(0)) == []


def test_pairs_of_terms_are_learned():
    rng = np.random.default_rng(0)
    insult, group = 11, 22  # toxic only together
    rows, y = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.4, rng.random() < 0.4
        rows.append(np.unique(np.concatenate([rng.integers(100, 200, 5), [insult] * a, [group] * b])).astype(np.int32))
        y.append(int(a and b))
    machine = toxicity.fit(rows[:2000], np.array(y[:2000]))
    flat, starts = np.concatenate(rows[2000:]), np.concatenate([[0], np.cumsum([len(r) for r in rows[2000:]])])
    found = machine.logits(flat.astype(np.int64), starts) > 0
    assert (found == np.array(y[2000:], bool)).mean() > 0.97


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    machine = toxicity.train(docs, labels, remainder("doc_id", 3) != 1)
    judged = toxicity.scores(docs, machine).join(labels.withColumnRenamed("doc_id", "id"), "id").where(remainder("id", 3) == 1)
    rows = [(r["score"] >= toxicity.THRESHOLD, r["toxic"] == 1) for r in judged.collect()]
    hit, shown, real = sum(a and b for a, b in rows), sum(a for a, _ in rows), sum(b for _, b in rows)
    assert hit / shown > 0.97 and hit / real > 0.7, (hit, shown, real)


def test_toxicity_edges(spark):
    df = clash(spark, EDGES)
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 0), (6, None), (None, 1), (99, 1)], "doc_id bigint, toxic int")
    machine = toxicity.train(df, labels, F.lit(True))
    assert sum(0 <= r["score"] <= 1 for r in toxicity.scores(df, machine).collect()) == len(EDGES)
    none = toxicity.train(df, labels.limit(0), F.lit(True))
    assert toxicity.keep_clean(df, none).count() == len(EDGES)
    assert toxicity.scores(df.limit(0), none).count() == toxicity.keep_clean(df.limit(0), none).count() == 0


def plain_top(rows, k, step):
    ints = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in ints:
        if q % step == 0:
            best = sorted(((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in ints if i != q and len(v) == len(qv)))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("dim", [3, 24])
def test_top_k(spark, dim):
    rng = np.random.default_rng(dim)
    rows = [(i, rng.normal(size=dim).round(1).tolist()) for i in range(700)]
    rows += [(i, rows[0][1]) for i in range(1000, 1200)]  # many copies of a query's vector
    rows += [(2000, None), (2001, [None] * dim), (2020, [float("nan")] * dim), (2040, [float("inf")] * dim), (2060, [0.0] * dim), (None, [1.0] * dim)]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id bigint, embedding array<float>, id string, rank string")
    got = topk_search.top_k(topk_search.usable(df), F.col("id") % 20 == 0, block_rows=300).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == plain_top(rows, 20, 20)
    assert topk_search.top_k(topk_search.usable(df.limit(0)), F.lit(True)).count() == 0


@pytest.mark.parametrize("dim", [2, 16])
def test_dual_tree_prunes_and_is_exact(dim):
    rng = np.random.default_rng(dim)
    points = rng.integers(-40, 40, (3000, dim)).astype(float)
    queries = points[::50]
    wanted = topk_search.indexed(np.arange(0, 3000, 50), queries, 16)
    blocks = [topk_search.indexed(np.arange(3000)[part], points[part], 16) for part in np.array_split(rng.permutation(3000), 4)]
    best = topk_search._merged(wanted, blocks, 5)
    for n, q in enumerate(queries):
        order = sorted((-(points[i] @ q), i) for i in range(3000) if i != 50 * n)[:5]
        assert [(-s, i) for s, i in order] == list(zip(best.score[n], best.id[n], strict=True))

    def spans(node):
        assert np.sqrt(((points[node.rows] - node.centre) ** 2).sum(axis=1)).max() <= node.radius + 1e-9
        assert not node.children or sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
        for c in node.children:
            spans(c)

    spans(topk_search.cover_tree(points, np.arange(3000), 16))


def test_repeated_rows_of_an_id_take_no_place(spark):
    """Id 0 ten times and ids 1 to 39, all with one vector, then others: nobody is lost to copies of the query."""
    rows = [(0, [1.0, 2.0])] * 10 + [(i, [1.0, 2.0]) for i in range(1, 40)] + [(i, [0.5, 0.25]) for i in range(100, 140)]
    rows += [(20, [1.0, 2.0])] * 30  # more copies of one id than places
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = topk_search.top_k(topk_search.usable(df), F.col("id") % 20 == 0, block_rows=16)
    by = defaultdict(list)
    for r in got.orderBy("query_id", "rank").collect():
        by[r["query_id"]].append((r["vec_id"], r["score"]))
    same = 64 * 64 + 128 * 128
    assert by[0] == [(i, same) for i in range(1, 20)] + [(20, same)]
    assert by[20] == [(0, same)] * 10 + [(i, same) for i in range(1, 11)]


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [-2.0]), (20, [3.0])], "vec_id bigint, embedding array<float>")
    got = topk_search.top_k(topk_search.usable(df), F.col("id") % 20 == 0).collect()
    assert sorted((r[0], r[1], r[2]) for r in got) == [(0, 1, 20), (0, 2, 1), (20, 1, 0), (20, 2, 1)]
