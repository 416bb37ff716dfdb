"""Token alignment against its contract, token by token."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from cloakwork.llm import alignment as al

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return al.Aligner(A, B)


def tokens(both, text):
    """Byte ranges of whole texts, from decoded bytes alone."""
    if not text:
        return None
    data, out = (" " + text).encode(), []
    for ids, table in ((both.a.encode(" " + text, add_special_tokens=False).ids, both.bytes_a), (both.b.encode(text), both.bytes_b)):
        if b"".join(table[i] for i in ids) != data:
            return None
        at, ranges = 0, []
        for i in ids:
            ranges.append((i, at, at + len(table[i])))
            at += len(table[i])
        out.append(ranges)
    return out


def brute(both, texts):
    """Rows of the query by its contract, for a corpus of these texts."""
    found = [tokens(both, t) for t in texts]
    links = [[(i, j) for i, s, e in got[0] for j, s_, e_ in got[1] if s < e_ and s_ < e] if got else [] for got in found]
    counts = Counter(x for own in links for x in own)
    top = {}
    for (_, j), n in counts.items():
        top[j] = max(top.get(j, 0), n)
    rows = []
    for got, own in zip(found, links, strict=True):
        if not got:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        cuts = sorted({e for _, _, e in got[0]} & {e for _, _, e in got[1]})
        groups, low = [], 0
        for high in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= high) for side in got))
            low = high
        text = ";".join(groups)
        rows.append((len(got[0]), len(got[1]), len(cuts), len(own), sum(counts[x] == top[x[1]] for x in own), sum(counts[x] for x in own), hashlib.sha256(text.encode()).hexdigest()))
    return rows


TEXTS = [
    "plain words twice plain words", "", None, " ", "\n", "  two  spaces at the ends  ", "tab\tand\r\nline ends\n \nhere ", "naïve café 😀😀 日本語 текст", "👩‍👩‍👧 𝔘𝔫𝔦", "▁ is no space", "a ▁b c",
    "<|endoftext|> <s> </s> <unk> <0x41> are plain", "x" * 3_000, "日" * 500, "a b " * 300, "word\nnext word\n", " nbsp wide ", "ﬁ ½ Ⅷ é", "\x00\x01 control", "5,000.50 + 3 = 5003.5!",
    "plain words twice plain words",
]


def test_tokens_have_the_ranges_of_their_bytes(both):
    rng = random.Random(3)
    letters = ["a", "b", "the", " ", "  ", "\n", "é", "😀", "日", "́", "<s>", "7", "-", "▁x", "\t"]
    texts = [t for t in TEXTS if t] + ["".join(rng.choice(letters[: rng.randrange(4, 16)]) for _ in range(rng.randrange(1, 40))) for _ in range(1_500)]
    lost = 0
    for text in texts:
        want, got = tokens(both, text), both.tokens(text)
        assert (want is None) == (got is None), text
        if got is None:
            lost += 1
            continue
        assert [x[0] for x in want[0]] == got[0].tolist() and [x[2] for x in want[0]] == got[1].tolist()
        assert [x[0] for x in want[1]] == got[2].tolist() and [x[2] for x in want[1]] == got[3].tolist()
    assert lost > 20
    # Cut into parts, each text has the same tokens as whole.
    book = al._Book(both)
    for text, numbers in zip(texts, al._numbers(book, texts), strict=True):
        want = brute(both, [text])[0]
        bad = any(book.n_a[k] < 0 for k in numbers)
        assert bad == (want[6] == ""), text
        if not bad:
            joined = ";".join(book.texts[k] for k in numbers)
            assert hashlib.sha256(joined.encode()).hexdigest() == want[6], text
            assert sum(book.first[k + 1] - book.first[k] for k in numbers) == want[3]


def test_forgotten_parts_come_back(both):
    book = al._Book(both)
    first = al._numbers(book, ["one two three", " two\n four"])
    text = [[book.texts[k] for k in n] for n in first]
    book.forget(2)
    assert len(book.texts) == len(book.first) - 1 == 2 and set(book.parts.values()) == {0, 1}
    again = al._numbers(book, ["one two three", " two\n four"])
    assert [[book.texts[k] for k in n] for n in again] == text


@pytest.mark.parametrize("block_chars", [1, 400, al.BLOCK_CHARS])
def test_table(spark, both, monkeypatch, block_chars):
    monkeypatch.setattr(al.blocks, "__defaults__", (block_chars,))
    rows = [(k, t, "x", "y", "z") for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, pairs string, block string, total string").repartition(3)
    got = {r["id"]: tuple(r)[1:] for r in al.align(docs, A, B).collect()}
    assert [got[k] for k in range(len(TEXTS))] == brute(both, TEXTS)


def test_empty_table_null_and_repeated_ids(spark, both):
    docs = spark.createDataFrame([(None, "a bc"), (None, "a bc"), (4, None), (4, "bc")], "doc_id bigint, text string")
    got = sorted((tuple(r) for r in al.align(docs, A, B).collect()), key=repr)
    texts = ["a bc", "a bc", None, "bc"]
    assert got == sorted(((i, *r) for i, r in zip((None, None, 4, 4), brute(both, texts), strict=True)), key=repr)
    assert al.align(docs.limit(0), A, B).collect() == []


def test_query_against_its_contract(spark, sf, both):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in al.op13_alignment(spark, sf).collect()}
    # Counts over whole texts by ranges in order, as the plain form above would take too long.
    linked, counts = [], Counter()
    for d in docs:
        pair = tokens(both, d["text"])
        own, j = [], 0
        if pair:
            for i, s, e in pair[0]:
                while pair[1][j][2] <= s:
                    j += 1
                k = j
                while k < len(pair[1]) and pair[1][k][1] < e:
                    own.append((i, pair[1][k][0]))
                    k += 1
        counts.update(own)
        linked.append((pair, own))
    top = {}
    for (_, j), n in counts.items():
        top[j] = max(top.get(j, 0), n)
    assert len(got) == len(docs)
    for d, (pair, own) in zip(docs, linked, strict=True):
        want = (len(pair[0]) if pair else 0, len(pair[1]) if pair else 0, len(own), sum(counts[x] == top[x[1]] for x in own), sum(counts[x] for x in own))
        row = got[d["doc_id"]]
        assert (row[0], row[1], *row[3:6]) == want
        assert bool(row[6]) == (pair is not None)
