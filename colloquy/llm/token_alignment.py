"""How the tokens of two vocabularies lie over the same texts.

Both encodings of a text are laid out as bytes. Where a token of either side ends at the same byte
the text is cut: the tokens between two cuts are a group, and the two tokens that end there are
linked. The counts of linked id pairs over the whole corpus then go back to each document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.bpe import byte_letters
from colloquy.llm.common import collect_garbage, cut, quoted, slices, texts_of

#: Different id pairs of documents, summed over a block's documents, at which the block is closed.
BLOCK_PAIRS = 1 << 19

#: Stretches of text that each of a worker's two generations of known ones holds, and the longest such stretch.
CACHE_STRETCHES, CACHE_LENGTH = 150_000, 64

_B_BITS = 32
_FIELDS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


class ByteTokens:
    """Encoder of one byte-level vocabulary, with each token's bytes; special tokens' strings are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.model.encode_special_tokens = True
        letters = byte_letters()
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in self.model.get_vocab(with_added_tokens=False).items()}

    def encode(self, text: str) -> list[int]:
        return self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids


class Pieces:
    """Encoder of one sentencepiece model, with each piece's bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        name = self.model.id_to_piece
        self.bytes_of = [bytes([int(name(i)[3:5], 16)]) if self.model.is_byte(i) else name(i).replace("▁", " ").encode() for i in range(self.model.vocab_size())]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


@lru_cache(2)
def sides_at(byte_vocabulary: str, piece_model: str) -> tuple[ByteTokens, Pieces]:
    return ByteTokens(byte_vocabulary), Pieces(piece_model)


class Aligner:
    """Both encoders, and what a text gives.

    A space after a character that is no white space begins a token on both sides: no word of A's pattern
    and, if the model's pieces allow it, no piece goes on over it. Texts are laid out in the stretches
    between such places, and what a stretch gives is remembered.
    """

    def __init__(self, byte_vocabulary: str, piece_model: str):
        self.a, self.b = sides_at(byte_vocabulary, piece_model)
        self.a_length = {i: len(x) for i, x in self.a.bytes_of.items()}
        self.b_length = [len(x) for x in self.b.bytes_of]
        self.a_text = {i: str(i) for i in self.a.bytes_of}
        self.b_text = [f"|{i}" for i in range(len(self.b_length))]
        apart = all(re.fullmatch("▁*[^▁]*", self.b.model.id_to_piece(i)) for i in range(len(self.b_length)))
        self.stretches = re.compile(r" [^ ]*(?:(?<=\s) [^ ]*)*" if apart else r"(?s).+")
        self.known: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def _laid_out(self, stretches: list[str]) -> Iterator[tuple]:
        """For each of some stretches, which follow one another: numbers of tokens and groups, the groups as text
        and the linked id pairs (a in the upper bits), or _UNLIKE. A byte-level vocabulary gives back every
        byte or leaves some out, so A's length tells."""
        text = "".join(stretches)
        whole = text.encode()
        a, b = self.a.encode(text), self.b.encode(text[1:])
        if b"".join(map(self.b.bytes_of.__getitem__, b)) != whole or sum(map(self.a_length.__getitem__, a)) != len(whole):
            return chain.from_iterable(self._laid_out([s]) for s in stretches) if len(stretches) > 1 else iter([_UNLIKE])
        a_ends, b_ends = [*accumulate(map(self.a_length.__getitem__, a))], [*accumulate(map(self.b_length.__getitem__, b))]
        groups, links = merged(a, b, a_ends, b_ends, self.a_text, self.b_text)
        if len(stretches) == 1:
            return iter([(len(a), len(b), len(groups), ";".join(groups), links)])
        return self._parts(stretches, a_ends, b_ends, groups, links)

    @staticmethod
    def _parts(stretches: list[str], a_ends: list[int], b_ends: list[int], groups: list[str], links: list[int]) -> Iterator[tuple]:
        ends = np.cumsum([len(s.encode()) for s in stretches])
        a, b = np.array(a_ends), np.array(b_ends)
        at = [np.searchsorted(x, ends, side="right").tolist() for x in (a, b, a[np.isin(a, b, assume_unique=True)])]
        i = j = k = 0
        for p, q, r in zip(*at, strict=True):
            yield p - i, q - j, r - k, ";".join(groups[k:r]), links[k:r]
            i, j, k = p, q, r

    def _missing(self, stretches: list[str], parts: list[tuple | None]) -> list[tuple]:
        """parts with what was not known."""
        fresh = {s: self.older.get(s) for s, p in zip(stretches, parts, strict=True) if p is None}
        new = [s for s, p in fresh.items() if p is None]
        for some in ([s for s in new if not s[-1].isspace()], *([s] for s in new if s[-1].isspace())):
            if some:
                fresh.update(zip(some, self._laid_out(some), strict=True))
        if len(self.known) >= CACHE_STRETCHES:
            self.known, self.older = {}, self.known
        self.known.update((s, p) for s, p in fresh.items() if len(s) <= CACHE_LENGTH)
        return [fresh[s] if p is None else p for s, p in zip(stretches, parts, strict=True)]

    def aligned(self, text: str) -> tuple[int, int, int, str, np.ndarray]:
        """Numbers of tokens of both sides and of groups, the groups as text and the linked id pairs; nothing
        of an empty text and of one that a side does not give back."""
        stretches = self.stretches.findall(f" {text}") if text else []
        if len(stretches) > 1 and stretches[-1] == " ":  # no text of its own: the model is not asked for an empty one
            stretches[-2:] = [f"{stretches[-2]} "]
        parts = [*map(self.known.get, stretches)]
        if None in parts:
            parts = self._missing(stretches, parts)
        if not parts or _UNLIKE in parts:
            return 0, 0, 0, "", np.zeros(0, dtype=np.int64)
        n_a, n_b, n_groups, groups, links = zip(*parts, strict=True)
        return sum(n_a), sum(n_b), sum(n_groups), ";".join(groups), np.fromiter(chain.from_iterable(links), dtype=np.int64)


#: What a stretch gives whose bytes a side does not give back.
_UNLIKE = (0, 0, 0, "", [])


def merged(a: list[int], b: list[int], a_ends: list[int], b_ends: list[int], a_text: dict[int, str], b_text: list[str]) -> tuple[list[str], list[int]]:
    """Groups and linked pairs of two token sequences, by one merge of their ascending ends."""
    groups, links = [], []
    i = j = a_from = b_from = 0
    n, m = len(a), len(b)
    while i < n and j < m:
        x, y = a_ends[i], b_ends[j]
        if x < y:
            i += 1
        elif y < x:
            j += 1
        else:
            p, q = a[i], b[j]
            links.append(p << _B_BITS | q)
            if i == a_from and j == b_from:
                groups.append(a_text[p] + b_text[q])
            else:
                groups.append(",".join([a_text[k] for k in a[a_from : i + 1]]) + "|" + ",".join([b_text[k][1:] for k in b[b_from : j + 1]]))
            i = a_from = i + 1
            j = b_from = j + 1
    return groups, links


class _Block:
    """Documents of one task whose id pairs are numbered together."""

    def __init__(self, number: int):
        self.number, self.rows, self.pairs, self.times, self.held = number, [], [], [], 0

    def add(self, row: tuple, pairs: np.ndarray) -> None:
        own, times = np.unique(pairs, return_counts=True)
        self.rows.append(row)
        self.pairs.append(own)
        self.times.append(times)
        self.held += len(own)

    def batch(self, kind: pa.DataType, groups: bool) -> pa.RecordBatch:
        """A row for each document, with its pairs as numbers in the block, and one for the block,
        with the pairs themselves and how many links hold each."""
        every, slot = np.unique(np.concatenate(self.pairs), return_inverse=True)
        total = np.bincount(slot, weights=np.concatenate(self.times), minlength=len(every)).astype(np.int64)
        ends = np.cumsum([len(p) for p in self.pairs])[:-1]
        n = len(self.rows)
        columns = [pa.array([*c, None], t) for c, t in zip(zip(*self.rows, strict=True), [kind, *[pa.int64()] * 4, pa.string(), pa.string()], strict=True)]
        lists = [pa.array([*np.split(x.astype(np.int32), ends), None], pa.list_(pa.int32())) for x in (slot, np.concatenate(self.times))]
        lists += [pa.array([*[None] * n, x], pa.list_(pa.int64())) for x in (every, total)]
        if not groups:
            columns.pop()
        return pa.RecordBatch.from_arrays([pa.array([self.number] * (n + 1)), *columns, *lists], names=[str(k) for k in range(len(columns) + 5)])


def _laid_out(docs: DataFrame, byte_vocabulary: str, piece_model: str, with_groups: bool) -> DataFrame:
    """Rows of blocks (see _Block.batch) of docs (id, text)."""
    schema = f"block long, id {dict(docs.dtypes)['id']}, {_FIELDS}" + ", groups string" * with_groups + ", slots array<int>, times array<int>, pairs array<bigint>, totals array<bigint>"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_vocabulary, piece_model)
        block = _Block(TaskContext.get().partitionId() << 32)
        kind = None
        for batch in slices(batches, 32):
            kind = batch.schema.field(0).type
            for i, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                n_a, n_b, n_groups, groups, pairs = aligner.aligned(text)
                digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
                block.add((i, n_a, n_b, n_groups, len(pairs), digest, groups if with_groups else None), pairs)
                if block.held >= BLOCK_PAIRS:
                    yield block.batch(kind, with_groups)
                    block = _Block(block.number + 1)
        if block.rows:
            yield block.batch(kind, with_groups)

    return docs.mapInArrow(rows, schema)


def _counted(pairs: DataFrame) -> DataFrame:
    """pair, count, and whether it is the highest of its A id and of its B id, from (pair, total)."""
    counts = pairs.groupBy("pair").agg(F.sum("total").alias("count")).withColumns({"a": F.shiftrightunsigned("pair", _B_BITS), "b": F.col("pair").bitwiseAND((1 << _B_BITS) - 1)})
    counts = cut(counts)
    most = {c: counts.groupBy(c).agg(F.max("count").alias(f"most_{c}")) for c in "ab"}
    return counts.join(most["a"], "a").join(most["b"], "b").select("pair", "a", "b", "count", (F.col("count") == F.col("most_a")).alias("best_a"), (F.col("count") == F.col("most_b")).alias("best_b"))


def _exploded(laid: DataFrame) -> DataFrame:
    blocks = laid.where("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "totals")).alias("slot", "x"))
    return blocks.select("block", "slot", F.col("x.pairs").alias("pair"), F.col("x.totals").alias("total"))


def pair_counts(docs: DataFrame, byte_vocabulary: str, piece_model: str, text_col: str = "text") -> DataFrame:
    """a_id, b_id, count, best_of_a and best_of_b for every id pair that a link holds."""
    laid = _laid_out(docs.select(F.lit(None).cast("long").alias("id"), F.col(quoted(text_col)).alias("text")), byte_vocabulary, piece_model, False)
    found = _counted(_exploded(laid.select("block", "pairs", "totals")))
    return found.select(F.col("a").cast("int").alias("a_id"), F.col("b").cast("int").alias("b_id"), "count", F.col("best_a").alias("best_of_a"), F.col("best_b").alias("best_of_b"))


def align_documents(docs: DataFrame, byte_vocabulary: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = True) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_best_a and, if wanted, groups
    (a1,a2|b1;a3|b2) for every row.

    A is a byte-level vocabulary, which reads a space and the text, B a sentencepiece model, which adds
    the space itself; both paths name files that every machine has. n_best counts links whose pair is the
    commonest of its B id, n_best_a of its A id, ties included; count_sum sums the pairs' counts.
    Null and empty texts, and texts whose bytes one side does not give back (those that the model
    normalises), have no tokens: zeros and ''. Repeated rows count each for themselves; a null id is kept;
    very long texts are laid out whole; other columns are not read.

    Documents are dealt in blocks of a bounded number of pairs. Counts meet each block's different pairs,
    not its links, so that a pair of half the corpus is one row of a block.
    """
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    laid = cut(_laid_out(rows, byte_vocabulary, piece_model, with_groups))
    blocks = _exploded(laid)
    counted = cut(_counted(blocks.select("pair", "total")).select("pair", "count", "best_a", "best_b"))
    collect_garbage(docs.sparkSession)
    known = blocks.select(F.col("block").alias("of_block"), "slot", "pair").join(counted, "pair").drop("pair")
    plain = ["id", "n_a", "n_b", "n_groups", "n_links"]
    after = ["groups_sha256"] + ["groups"] * with_groups
    there = laid.where("pairs IS NULL").select("block", *plain, *after, "slots", "times")

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        slot = right["slot"].to_numpy()
        values = np.zeros((3, len(slot)), dtype=np.int64)
        for k, name in enumerate(("best_b", "count", "best_a")):
            values[k, slot] = right[name].to_numpy().astype(np.int64)
        slots, times = (left[c].combine_chunks() for c in ("slots", "times"))
        at, n = slots.flatten().to_numpy(), times.flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(slots.value_lengths().to_numpy())])
        running = [np.concatenate([[0], np.cumsum(v[at] * n)]) for v in values]
        sums = [pa.array(r[ends[1:]] - r[ends[:-1]]) for r in running]
        return pa.table([*[left[c] for c in plain], sums[0], sums[1], *[left[c] for c in after], sums[2]], names=[*plain, "n_best", "count_sum", *after, "n_best_a"])

    schema = f"id {dict(rows.dtypes)['id']}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", groups string" * with_groups + ", n_best_a long"
    out = there.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(summed, schema)
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_best_a"] + ["groups"] * with_groups
    return out.select(F.col("id").alias(id_col), *columns)
