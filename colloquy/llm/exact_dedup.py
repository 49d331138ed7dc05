"""Exact duplicates through content-defined chunk recipes.

Each text is cut where its own content says so. Every different chunk moves once and gets a
verified identifier; after that a document is the ordered list of its chunks' identifiers, and
only these short lists are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import cut, mix64, quoted, slices, starts_of

#: Bytes of a chunk: at least, on average beyond that, at most.
MIN_CHUNK, MEAN_CHUNK, MAX_CHUNK = 512, 2048, 16384
#: Bytes that decide whether a chunk may end.
REACH = 32

_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def cut_points(data: np.ndarray) -> np.ndarray:
    """Positions after which a chunk may end: a function of the REACH bytes before them alone."""
    h = _GEAR[data]
    width = 1
    while width < REACH:
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    return np.flatnonzero(h >> np.uint32(32 - MEAN_CHUNK.bit_length() + 1) == 0) + 1


def chunk_ends(points: np.ndarray, length: int) -> list[int]:
    """Ends of the chunks of a text, given the candidate points inside it."""
    ends, start = [], 0
    while length - start > MIN_CHUNK:
        k = np.searchsorted(points, start + MIN_CHUNK)
        end = min(int(points[k]) if k < len(points) else length, start + MAX_CHUNK, length)
        ends.append(end)
        start = end
    if start < length or not ends:
        ends.append(length)
    return ends


def chunks_of(texts: list[bytes]) -> list[list[bytes]]:
    bounds = starts_of(np.array([len(t) for t in texts]))
    points = cut_points(np.frombuffer(b"".join(texts), dtype=np.uint8)) if bounds[-1] else np.zeros(0, np.int64)
    out = []
    for k, text in enumerate(texts):
        low, high = np.searchsorted(points, (bounds[k] + REACH, bounds[k + 1]))
        ends = chunk_ends(points[low:high] - bounds[k], len(text))
        out.append([text[a:b] for a, b in zip([0, *ends], ends, strict=False)])
    return out


def _recipes(docs: DataFrame, text_col: str, bits: int, with_chunks: bool) -> DataFrame:
    """The columns of docs (without the text unless it was asked for twice), text_sha256, recipe
    (array<long> of chunk hashes) and, if wanted, the chunks."""
    names = docs.columns
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", __sha string, __recipe array<bigint>" + ", __chunks array<binary>" * with_chunks
    place = names.index(text_col)
    low = (1 << bits) - 1

    def cooked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [(t or "").encode("utf-8") for t in batch.column(place).to_pylist()]
            cuts = chunks_of(texts)
            hashes = [np.array([xxhash.xxh3_64_intdigest(c) & low for c in cs], dtype=np.uint64).view(np.int64) for cs in cuts]
            columns = [*batch.columns, pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(hashes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(cuts, pa.list_(pa.binary()))] * with_chunks, names=[*names, "__sha", "__recipe", *["__chunks"] * with_chunks])

    return docs.mapInArrow(cooked, schema)


def verified_recipes(docs: DataFrame, text_col: str = "text", bits: int = 64) -> DataFrame:
    """docs with __sha and __recipe, an array of verified chunk identifiers: two texts have equal
    recipes exactly if they are equal.

    The chunks' bytes are grouped once with their hash. Where a hash stands for one content only,
    it is the identifier. Else the contents are numbered and the recipes that hold such a chunk
    name content numbers as well (bits: of the hash; a few bits force this in tests).
    """
    pieces = _recipes(docs.select(text_col), text_col, bits, True).select(F.explode(F.arrays_zip("__recipe", "__chunks")).alias("c")).select(F.col("c.__recipe").alias("h"), F.col("c.__chunks").alias("chunk"))
    distinct = pieces.distinct()
    shared = cut(distinct.groupBy("h").count().where("count > 1").select("h"))
    if shared.isEmpty():
        return _recipes(docs, text_col, bits, False)
    numbers = cut(distinct.join(shared, "h", "left_semi").withColumn("number", F.row_number().over(Window.partitionBy("h").orderBy("chunk"))))
    # the ordered contents of a document, one number for each chunk (0: the hash says it all)
    keyed = _recipes(docs.select(text_col), text_col, bits, True).select("__sha", F.posexplode(F.arrays_zip("__recipe", "__chunks")).alias("at", "c"))
    keyed = keyed.select("__sha", "at", F.col("c.__recipe").alias("h"), F.col("c.__chunks").alias("chunk")).join(numbers, ["h", "chunk"])
    numbered = keyed.groupBy("__sha").agg(F.array_sort(F.collect_set(F.struct("at", "number"))).alias("n"))
    numbered = numbered.select("__sha", F.flatten(F.transform("n", lambda s: F.array(s["at"].cast("long"), s["number"].cast("long")))).alias("__n"))
    joined = _recipes(docs, text_col, bits, False).join(numbered, "__sha", "left")
    whole = F.concat("__recipe", F.coalesce("__n", F.array().cast("array<bigint>")))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], "__sha", whole.alias("__recipe"))


def duplicate_groups(recipes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """recipe, keep_id (largest id), group_size, and same (rows that have the largest id)."""
    by_id = recipes.groupBy("__recipe", id_col).agg(F.count("*").alias("n"))
    return by_id.groupBy("__recipe").agg(F.max(id_col).alias("keep_id"), F.sum("n").alias("group_size"), F.max_by("n", id_col).alias("same"))


def find_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """id, keep_id, group_size, kept and text_sha256 for every row.

    Null counts as the empty text; texts are compared as they are. Of equal texts the largest id
    stays; rows that repeat both id and text are one document and are all marked kept; null ids
    stay only if the whole group has none. Very long texts are lists of more chunks.
    """
    recipes = verified_recipes(docs.select(id_col, text_col), text_col, bits).drop(text_col)
    groups = cut(duplicate_groups(recipes, id_col))  # a join of two exchanges lets Spark split hot recipes
    return recipes.join(groups, "__recipe").select(id_col, "keep_id", F.col("group_size").cast("long"), F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), F.col("__sha").alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts, all columns unchanged.

    Null and empty texts are one group; of equal texts the largest id stays, a null id only if there is
    no other, and of rows that repeat it one; an empty table stays empty; columns may have any names.
    """
    inner = docs.select(*[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(docs.columns)])  # no name clashes with the operator's own
    own_id, own_text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    whole = verified_recipes(inner, own_text, bits)
    groups = cut(duplicate_groups(whole.select(own_id, "__recipe"), own_id))
    kept = groups.select(F.col("keep_id").alias("__keep"), "__recipe")
    out = whole.join(kept, "__recipe").where(F.col(own_id).eqNullSafe(F.col("__keep")))
    if not groups.where("same > 1").isEmpty():
        out = out.dropDuplicates(["__recipe"])
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])
