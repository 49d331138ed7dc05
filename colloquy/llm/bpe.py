"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word exactly one token can end its encoding. It is found among the tokens
that are suffixes of the prefix (a suffix-matching automaton over the vocabulary lists them) as
the one that is compatible with the last token of the prefix before it. Following these last
tokens back from the whole word gives the encoding that merging in rank order gives.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import quoted, slices, texts_of

#: Fixed value: the word pattern of the byte-level vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words that each of a worker's two generations of known words holds, and the longest such word.
CACHE_WORDS, CACHE_LENGTH = 150_000, 64


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 characters
    are themselves, all other bytes take the code points from 256 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixEncoder:
    """Encoder and decoder of one byte-level vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.bytes_of = {i: raw(t) for t, i in vocab.items()} | {i: s.encode() for s, i in special.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.special = special
        self.around_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.words = regex.compile(WORDS)
        self.rank_of: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: left part, right part, rank
        for rank, (a, b) in enumerate(merges):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank_of.setdefault((left, right), rank)
            self.parts.setdefault(whole, (left, right, rank))
        self.suffixes = ahocorasick.Automaton()
        for token, i in vocab.items():
            if len(token) == 1 or self._makes_itself(i):
                piece = raw(token).decode("latin-1")
                self.suffixes.add_word(piece, (i, len(piece)))
        self.suffixes.make_automaton()
        self.pairs: dict[int, bool] = {}  # pairs tested so far
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    @classmethod
    def from_file(cls, path: str) -> PrefixEncoder:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        return cls(spec["model"]["vocab"], merges, {t["content"]: t["id"] for t in spec["added_tokens"]})

    def _makes_itself(self, token: int) -> bool:
        """Whether the token's own bytes merge to it: its two parts must survive side by side until
        its own merge."""
        if token not in self.parts:
            return False
        left, right, rank = self.parts[token]
        return all(p not in self.parts or self._makes_itself(p) for p in (left, right)) and self._compatible(left, right, rank)

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at one edge while the token is built, latest first, each with the
        rank of the merge that ends it."""
        out, ends = [], float("inf")
        while True:
            out.append((token, ends))
            if token not in self.parts:
                return out
            left, right, ends = self.parts[token]
            token = right if side else left

    def _compatible(self, a: int, b: int, before: float = float("inf")) -> bool:
        """Whether a and b stay apart when their bytes are merged as one word (by merges of a lower
        rank than before). A merge across the border would need both its sides alive at its rank.
        On equal ranks the leftmost place merges first: a's edge is then already gone, b's is not."""
        for x, x_ends in self._edge(a, 1):
            for y, y_ends in self._edge(b, 0):
                rank = self.rank_of.get((x, y))
                if rank is not None and rank < before and rank < x_ends and rank <= y_ends:
                    born = max(self.parts[t][2] if t in self.parts else -1 for t in (x, y))
                    if rank > born:
                        return False
        return True

    def compatible(self, key: int, a: int, b: int) -> bool:
        if len(self.pairs) >= CACHE_WORDS:
            self.pairs.clear()
        self.pairs[key] = fits = self._compatible(a, b)
        return fits

    def encode_word(self, word: str) -> tuple[int, ...]:
        data = word.encode("utf-8").decode("latin-1")
        last = [-1] * (len(data) + 1)  # of each prefix: its last token
        back = [0] * (len(data) + 1)
        done, pairs = 0, self.pairs
        for end, (token, length) in self.suffixes.iter(data):
            if end == done - 1:
                continue
            start = end + 1 - length
            if start:
                before = last[start]
                if before < 0:
                    continue
                fits = pairs.get(key := before << 24 | token)
                if fits is None:
                    fits = self.compatible(key, before, token)
                if not fits:
                    continue
            done = end + 1
            last[done], back[done] = token, start
        out, at = [], len(data)
        while at:
            out.append(last[at])
            at = back[at]
        out.reverse()
        return tuple(out)

    def _word(self, word: str) -> tuple[int, ...]:
        ids = self.older.get(word) or self.encode_word(word)
        if len(word) <= CACHE_LENGTH:
            if len(self.known) >= CACHE_WORDS:
                self.known, self.older = {}, self.known
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if self.around_special is not None and any(s in text for s in self.special):
            pieces = self.around_special.split(text)
            return list(chain.from_iterable([self.special[p]] if k % 2 else self.encode_plain(p) for k, p in enumerate(pieces)))
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> list[int]:
        """As encode, but the special tokens' strings are ordinary text."""
        make = self._word
        return list(chain.from_iterable([self.known.get(w) or make(w) for w in self.words.findall(text)]))

    def decode(self, ids: list[int]) -> str:
        """Bytes that are no UTF-8 become replacement characters; special tokens are kept."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def encoder_at(path: str) -> PrefixEncoder:
    return PrefixEncoder.from_file(path)


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_decoded: bool = True) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids (array<int>) and decoded.

    vocabulary: path of the public vocabulary file, present on every machine. A null text is the
    empty text and has no tokens; very long texts are encoded whole; repeated rows are encoded one
    by one; further columns of the input are not read.
    """
    chosen = docs.select(F.col(quoted(id_col)), F.col(quoted(text_col)))
    kind = dict(chosen.dtypes)[id_col]
    schema = f"{quoted(id_col)} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * (with_ids and with_decoded)
    digest = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_at(vocabulary)
        for batch in slices(batches):
            ids = [encoder.encode(t) for t in texts_of(batch.column(1))]
            decoded = [encoder.decode(x) for x in ids]
            columns = [
                batch.column(0),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([digest(",".join(map(encoder.text_of.__getitem__, x))) for x in ids], pa.string()),
                pa.array([digest(t) for t in decoded], pa.string()),
            ]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            if with_ids and with_decoded:
                columns.append(pa.array(decoded, pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return chosen.mapInArrow(encoded, schema)
