"""Periodic runs against their definition."""

import hashlib
import random
import zlib

import pytest

from cloakwork.llm import periodic_runs as pr

PAD = [b"begin", b"of", b"a", b"text"]


def brute(words, least):
    """Stretches that agree with themselves a period further, for each period; of equal stretches the smallest period."""
    best = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                best.setdefault((i, j - i + q), q)
            i = max(i + 1, j)
    return sorted((s, n, q) for (s, n), q in best.items())


def kept(words, runs):
    out = set()
    for s, n, q in runs:
        out |= set(range(s + q, s + n))
    return [w for i, w in enumerate(words) if i not in out]


@pytest.mark.parametrize("least", [2, 3, 4, 7, 12])
@pytest.mark.parametrize("letters", [1, 2, 3, 8])
def test_runs_of_random_words(least, letters):
    rng = random.Random(least * 10 + letters)
    texts = []
    for _ in range(60):
        words = [b"w%d" % rng.randrange(letters) for _ in range(rng.randrange(0, 70))]
        for _ in range(rng.randrange(3)):  # stretches that repeat, whole and cut off
            unit = [b"w%d" % rng.randrange(letters + 5) for _ in range(rng.randrange(1, 9))]
            words += (unit * 6)[: rng.randrange(1, 6 * len(unit) + 1)]
        texts.append(b" ".join(words))
    for text, (words, runs) in zip(texts, pr._documents(texts, least), strict=True):
        assert words == text.split()
        want = brute(words, least)
        assert sorted(runs) == want
        assert runs == sorted(want, key=lambda r: (r[0], r[2]))
        assert pr._kept(words, runs) == kept(words, want)


def test_words_like_fibonacci_and_long_powers():
    a, b = ["x"], ["x", "y"]
    while len(b) < 600:
        a, b = b, b + a
    words = [w.encode() for w in b]
    power = [b"same"] * 20_000
    near = ([b"a"] * 30 + [b"b"]) * 40
    got = list(pr._documents([b" ".join(words), b" ".join(power), b" ".join(near), b""], 12))
    assert sorted(got[0][1]) == brute(words, 12)
    assert got[1][1] == [(0, 20_000, 1)]
    assert sorted(got[2][1]) == brute(near, 12)
    assert got[3] == ([], [])


def test_lines_repeated_far_apart_are_no_runs():
    line = [b"one", b"line", b"that", b"comes", b"back", b"again", b"and", b"again"]
    words = []
    for k in range(2_000):
        words += [b"u%d" % k, *line, b"v%d" % k, b"w%d" % k]
    (_, runs), = pr._documents([b" ".join(words)], 12)
    assert runs == []


def test_table(spark):
    unit = "alpha beta gamma delta"
    rows = [(1, " ".join([unit] * 4), "x"), (2, None, None), (3, "", "x"), (4, " \t\n\x0b\x0c\r ", "x"), (5, "a b c", "x"), (1, " ".join([unit] * 4), "x"),
            (None, "start " + "one\ttwo\n" * 7 + "end", "x"), (7, "é " * 12, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string")
    got = {}
    for r in pr.find_runs(docs).collect():
        got.setdefault(r["id"], []).append(([tuple(x) for x in r["runs"]], r["collapsed"]))
    assert got[1] == [([(0, 16, 4)], unit)] * 2
    assert got[2] == got[3] == got[4] == [([], "")]
    assert got[5] == [([], "a b c")]
    assert got[None] == [([(1, 14, 2)], "start one two end")]
    assert got[7] == [([(0, 12, 1)], "é")]
    assert pr.find_runs(docs.limit(0)).collect() == []
    assert dict(pr.find_runs(docs).dtypes)["id"] == "bigint"


def expected(doc_id, text):
    """A row of the query, by its contract."""
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = sorted(brute(words, 12), key=lambda r: (r[0], r[2]))
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept(words, runs))).hexdigest())


def test_query_against_its_contract(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    short = {d["doc_id"] for d in docs if len((d["text"] or "").split()) <= 1_500}
    got = {r["doc_id"]: tuple(r) for r in pr.op11_periodic_runs(spark, sf).collect()}
    assert len(got) == len(docs) and len(short) > 100
    for d in docs:
        if d["doc_id"] in short:  # the plain definition takes long on the others
            assert got[d["doc_id"]] == expected(d["doc_id"], d["text"])
    assert any(r[1] for r in got.values())
