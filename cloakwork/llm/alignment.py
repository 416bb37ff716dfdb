"""Alignment of two tokenizers over the same texts.

Tokenizer A is a byte-level BPE file of ``tokenizers``, tokenizer B a ``sentencepiece`` model that puts a space before
a text.  Both read the space and the text, and their tokens are laid over the same bytes.

1. Coarse cuts: the character offsets that ``tokenizers`` gives for A, and the byte spans of ``sentencepiece``'s
   immutable proto for B.  An offset is a byte place as it stands unless its token ends inside a character (A) or is a
   byte-fallback token (B).
2. Those are refined by the decoded bytes of the tokens up to there.  The joined bytes of all tokens must equal the
   text's on both sides, else the text has no tokens here.
3. Places where tokens of both end cut the text into groups.  Each stretch between neighbouring ends of either
   tokenizer belongs to one token of A and one of B: these pairs are the links.

Neither tokenizer looks across a single space between two other characters (checked when the files are
loaded; where it does not hold, texts are not cut).  So texts are cut there, each distinct part is aligned once, many
parts in one call, and a text's alignment is that of its parts in order.

How often an id pair is linked is counted over all texts.  Tasks pack rows into blocks; a block sends each of its
distinct pairs once, with the number of its links, and gets the corpus-wide total back.  So a pair that is in every
text is one row per block.  Blocks wait in the shared folder, compressed, and nothing is tokenized twice.  The
highest total of every id of B, a row per entry of its vocabulary, is the only broadcast.

Defined cases: a null or empty text has no tokens: zeros and an empty digest; strings of special tokens are plain
text; repeated rows each get their row and count each; an empty table gives an empty result; very long texts are
aligned whole.  Only the id and text columns are read, so clashing names of others do not matter.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm.common import ship, table, text_or_empty, written
from cloakwork.llm.tokens import byte_alphabet

BLOCK_CHARS = 1 << 23
CACHE = 250_000  # parts kept per Python worker: the first that come, so the frequent ones
LONG_PART = 100  # characters; longer parts are not kept
LINE = 30_000  # characters that are encoded in one call

_PLACES = re.compile(r"(?<=\S)(?= \S)")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class _Odd(Exception):
    """A space of the text stands beside white space, or at an end."""


def _ends(offsets: np.ndarray, torn: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte place where each token ends: its coarse offset, or where that is not exact, the bytes decoded so far."""
    decoded = np.cumsum(sizes)
    ends = np.where(torn, decoded, offsets)
    if not np.array_equal(ends, decoded):
        raise ValueError("a tokenizer's offsets contradict the bytes of its tokens")
    return ends


class Aligner:
    """Both tokenizers and the bytes of their entries."""

    def __init__(self, path_a: str, path_b: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        letters = byte_alphabet()
        vocab = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            known = all(c in letters for c in entry)
            self.bytes_a[i] = bytes(letters[c] for c in entry) if known else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.is_byte = np.array([_BYTE.fullmatch(p) is not None for p in pieces])
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.sizes_a, self.sizes_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        pre, proto = spec.get("pre_tokenizer") or {}, ModelProto()
        with open(path_b, "rb") as f:
            proto.ParseFromString(f.read())
        own = proto.normalizer_spec
        self.cuts = (
            not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and own.name == "identity" and own.add_dummy_prefix and own.escape_whitespaces and not proto.trainer_spec.treat_whitespace_as_suffix
            and not any(re.search("[^▁]▁", p) for p in pieces)
        )

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids and byte ends of both over a space and the text, or None where their bytes differ from it."""
        spaced = " " + text
        data = spaced.encode()
        coded = self.a.encode(spaced, add_special_tokens=False)
        a = np.array(coded.ids, np.int64)
        if b"".join(map(self.bytes_a.__getitem__, coded.ids)) != data:
            return None
        pieces = [(p.id, p.end) for p in self.b.encode(text, return_type="proto").pieces]
        b, spans = np.array(pieces, np.int64).reshape(-1, 2).T
        if b"".join(map(self.bytes_b.__getitem__, b.tolist())) != data:
            return None
        offsets = np.array(coded.offsets, np.int64).reshape(-1, 2)
        torn = np.append(offsets[1:, 0] < offsets[:-1, 1], False)
        places = offsets[:, 1]
        if len(data) != len(spaced):
            point = np.frombuffer(spaced.encode("utf-32-le"), "<u4")
            places = np.append(0, np.cumsum(1 + (point > 0x7F).astype(np.int64) + (point > 0x7FF) + (point > 0xFFFF)))[places]
        return a, _ends(places, torn, self.sizes_a[a]), b, _ends(spans + 1, self.is_byte[b], self.sizes_b[b])


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


class _Parts(dict):
    """Part of a text, without its leading space, to its number."""

    def __init__(self) -> None:
        self.new: list[str] = []  # not aligned yet
        self.known = 0  # numbers that are taken

    def __missing__(self, part: str) -> int:
        if not part or part[0].isspace() or part[-1].isspace():
            raise _Odd
        self[part] = number = self.known + len(self.new)
        self.new.append(part)
        return number


class _Book:
    """Alignments of parts, by number: digest text, numbers of tokens and groups, links as id pairs."""

    def __init__(self, both: Aligner) -> None:
        self.both = both
        self.parts = _Parts()
        self.texts: list[str] = []
        self.n_a, self.n_b, self.n_groups, self.first = array("q"), array("q"), array("q"), array("q", [0])
        self.links = array("q")  # id of A times 2^32 plus id of B; those of part k are from first[k] to first[k + 1]

    def _add(self, text: str, n_a: int, n_b: int, n_groups: int) -> None:
        self.texts.append(text)
        for column, n in zip((self.n_a, self.n_b, self.n_groups), (n_a, n_b, n_groups), strict=True):
            column.append(n)

    def _line(self, parts: list[str]) -> bool:
        """Align consecutive parts in one call; False where the bytes differ."""
        got = self.both.tokens(" ".join(parts))
        if got is None:
            return False
        a, ends_a, b, ends_b = got
        bounds = np.cumsum([len(p.encode()) + 1 for p in parts])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        if not np.isin(bounds, cuts).all():
            raise ValueError("a token crosses the place before a space")
        ends = np.union1d(ends_a, ends_b)
        self.links.frombytes(((a[np.searchsorted(ends_a, ends)] << 32) + b[np.searchsorted(ends_b, ends)]).tobytes())
        base = self.first[-1]
        self.first.extend((base + np.searchsorted(ends, bounds, "right")).tolist())
        to_a, to_b = (np.searchsorted(x, cuts, "right").tolist() for x in (ends_a, ends_b))
        of_a, of_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        groups, i, j = [], 0, 0
        for i_, j_ in zip(to_a, to_b, strict=True):
            groups.append(f"{','.join(of_a[i:i_])}|{','.join(of_b[j:j_])}")
            i, j = i_, j_
        at = [np.searchsorted(x, bounds, "right").tolist() for x in (ends_a, ends_b, cuts)]
        before = (0, 0, 0)
        for now in zip(*at, strict=True):
            self._add(";".join(groups[before[2] : now[2]]), *(n - m for n, m in zip(now, before, strict=True)))
            before = now
        return True

    def _alone(self, part: str) -> None:
        if not self._line([part]):
            self.first.append(self.first[-1])
            self._add("", -1, 0, 0)

    def learn(self, parts: list[str]) -> None:
        """Align these parts, none of which begins or ends with white space."""
        line: list[str] = []
        held = 0
        for k, part in enumerate(parts):
            line.append(part)
            held += len(part)
            if held >= LINE or k == len(parts) - 1:
                if not self._line(line):
                    for one in line:
                        self._alone(one)
                line, held = [], 0

    def forget(self, keep: int) -> None:
        """Keep the first parts only."""
        if keep < len(self.texts):
            for part in [p for p, k in self.parts.items() if k >= keep]:
                del self.parts[part]
            self.parts.known = keep
            del self.texts[keep:], self.n_a[keep:], self.n_b[keep:], self.n_groups[keep:], self.links[self.first[keep] :], self.first[keep + 1 :]


def _numbers(book: _Book, texts: list[str]) -> list[np.ndarray]:
    """Part numbers of each text; all parts are in the book afterwards."""
    out: list[np.ndarray] = []
    odd: list[tuple[int, list[str]]] = []
    for k, text in enumerate(texts):
        before = len(book.parts.new)
        try:
            if not text:
                out.append(np.zeros(0, np.int32))
                continue
            if not book.both.cuts:
                raise _Odd
            out.append(np.array(list(map(book.parts.__getitem__, text.split(" "))), np.int32))
        except _Odd:
            for part in book.parts.new[before:]:  # of the text that has just failed
                del book.parts[part]
            del book.parts.new[before:]
            out.append(np.zeros(0, np.int32))
            odd.append((k, [p[1:] for p in _PLACES.split(" " + text)] if book.both.cuts else [text]))
    for k, pieces in odd:  # the places hold, but a piece may begin or end with white space: then it is aligned by itself
        numbers = []
        for piece in pieces:
            try:
                numbers.append(book.parts[piece] if book.both.cuts and " " not in piece else -1)
            except _Odd:
                numbers.append(-1)
        out[k] = np.array(numbers, np.int32)
    book.learn(book.parts.new)
    book.parts.new = []
    for k, pieces in odd:
        for n in np.flatnonzero(out[k] < 0).tolist():
            out[k][n] = len(book.texts)
            book._alone(pieces[n])
    book.parts.known = len(book.texts)
    return out


def blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows packed as they come: numbers and digests per row, parts per row, and the block's distinct id pairs with their uses."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, part, seq = _Book(aligner(path_a, path_b)), TaskContext.get().partitionId(), 0
        ids: list = []
        texts: list[str] = []
        held, id_arrow, zip_ = 0, pa.int64(), zstandard.ZstdCompressor(level=1)

        def out() -> pa.RecordBatch:
            numbers = _numbers(book, texts)
            n_a, n_b, n_groups, first = (np.array(x, np.int64) for x in (book.n_a, book.n_b, book.n_groups, book.first))
            digests, sums = [], []
            for k, own in enumerate(numbers):
                if not len(own) or (n_a[own] < 0).any():
                    numbers[k] = own = own[:0]
                digests.append(hashlib.sha256(";".join(map(book.texts.__getitem__, own.tolist())).encode()).hexdigest() if len(own) else "")
                sums.append([int(x[own].sum()) for x in (n_a, n_b, n_groups, np.diff(first))])
            flat = np.concatenate(numbers)
            times = np.bincount(flat, minlength=len(book.texts))
            used = np.flatnonzero(times)  # parts, numbered anew inside the block
            anew = np.zeros(len(times), np.int32)
            anew[used] = np.arange(len(used))
            sizes = (first[used + 1] - first[used]).astype(np.int64)
            at = np.repeat(first[used] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            pairs, which = np.unique(np.array(book.links, np.int64)[at], return_inverse=True)
            uses = np.bincount(which, np.repeat(times[used], sizes), len(pairs)).astype(np.int64)
            packed = [zip_.compress(x.astype("<i4").tobytes()) for x in (anew[flat], sizes, which)]
            data = [
                pa.array([(part << 32) + seq], pa.int64()), pa.array([ids], pa.list_(id_arrow)), pa.array([digests], pa.list_(pa.string())),
                pa.array([sums], pa.list_(pa.list_(pa.int64()))), pa.array([[len(n) for n in numbers]], pa.list_(pa.int64())),
                *(pa.array([x], pa.binary()) for x in packed), pa.array([pairs.tolist()], pa.list_(pa.int64())), pa.array([uses.tolist()], pa.list_(pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(data, names=["block", "ids", "digests", "sums", "sizes", "parts", "link_sizes", "links", "pairs", "uses"])

        for batch in batches:
            id_arrow = batch.schema.field("id").type
            for i, text in zip(batch.column("id"), batch.column("text"), strict=True):
                ids.append(i.as_py())
                texts.append(text.as_py())
                held += len(texts[-1])
                if held >= block_chars or len(ids) >= 50_000:
                    yield out()
                    book.forget(CACHE)
                    ids, texts, held, seq = [], [], 0, seq + 1
        if ids:
            yield out()

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"block bigint, ids array<{id_type}>, digests array<string>, sums array<array<bigint>>, sizes array<bigint>, "
                                "parts binary, link_sizes binary, links binary, pairs array<bigint>, uses array<bigint>")


def totals(uses: DataFrame) -> DataFrame:
    """``pair, total, best`` of rows ``pair, uses``: links over all texts, and whether no pair of the same id of B has more."""
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    counted = uses.groupBy("pair").agg(F.sum("uses").alias("total")).withColumn("b", b)
    top = counted.groupBy("b").agg(F.max("total").alias("top"))  # a row per entry of B's vocabulary at most
    return counted.join(F.broadcast(top), "b").select("pair", "total", (F.col("total") == F.col("top")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per row."""
    id_type = docs.schema[id_col].dataType
    packed = written(blocks(docs, path_a, path_b, id_col, text_col), "alignment")
    uses = packed.select("block", F.posexplode(F.arrays_zip("pairs", "uses")).alias("pos", "x")).select("block", "pos", F.col("x.pairs").alias("pair"), F.col("x.uses").alias("uses"))
    answers = uses.select("block", "pos", "pair").join(totals(uses.select("pair", "uses")), "pair").select(F.col("block").alias("to"), "pos", "total", "best")
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")

    def read(data: pa.Scalar) -> np.ndarray:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(data.as_py()), "<i4")

    def settle(block: pa.Table, answer: pa.Table) -> pa.Table:
        row = {c: block.column(c)[0] for c in block.column_names}
        at = answer.column("pos").to_numpy()
        total, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        total[at], best[at] = answer.column("total").to_numpy(), answer.column("best").to_numpy()
        parts, sizes, links = (read(row[c]) for c in ("parts", "link_sizes", "links"))
        ends = np.cumsum(sizes, dtype=np.int64)
        per_doc = np.append(0, np.cumsum(np.array(row["sizes"].as_py(), np.int64)))
        sums = np.array(row["sums"].as_py(), np.int64).reshape(-1, 4)
        more = []
        for of_pair in (best, total):
            of_link = np.append(0, np.cumsum(of_pair[links]))
            of_part = of_link[ends] - of_link[ends - sizes]
            more.append(np.diff(np.append(0, np.cumsum(of_part[parts]))[per_doc]))
        columns = [row["ids"].values, *(pa.array(x, pa.int64()) for x in (*sums.T, *more)), row["digests"].values]
        return pa.Table.from_arrays(columns, names=["id", *names, "groups_sha256"])

    left = packed.drop("pairs", "uses").groupBy("block")
    return left.cogroup(answers.groupBy("to")).applyInArrow(settle, f"id {id_type.simpleString()}, {', '.join(f'{n} bigint' for n in names)}, groups_sha256 string")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens of both kinds, their groups and links, and how often their id pairs are linked in the corpus."""
    import public_tokenizers

    path = public_tokenizers.path
    found = align(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
    return found.select(F.col("id").cast("bigint").alias("doc_id"), *found.columns[1:])


ORACLE: dict[str, str] = {}  # tokenizers have no SQL; see tests/llm
QUERIES = {"op13_alignment": op13_alignment}
