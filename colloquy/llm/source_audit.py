"""How far the sources of a language differ in the terms they use.

Terms are cut and counted in numpy, some MB of texts at a time, so that Spark gets a row for each
term and group of a piece, not for each occurrence. Each term of a language becomes one row with its
counts laid out by source. From these wide rows higher-order functions emit what the term adds to the
distance of each pair of sources, which is summed on the map side. All shares are whole numbers, so results do not depend on the order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import cut, quoted

#: Terms are runs of ASCII letters and of characters outside ASCII. For each byte of UTF-8 what it is in a term, 0 where it parts terms.
IN_TERM = bytes(b if b >= 128 or chr(b).islower() else b + 32 if chr(b).isupper() else 0 for b in range(256))
#: Texts that are counted at a time inside a task, in bytes (one at least) and in rows, and rows that it gives back at a time.
PIECE_BYTES, PIECE_ROWS, OUT_ROWS = 8 << 20, 1 << 16, 1 << 16
#: A share is told in billionths, over counts that each get this much more.
SCALE, MORE = 1_000_000_000, 5
#: Documents of the language in which a term has to occur, and terms of a group that are listed.
LEAST_DOCUMENTS, TOP = 30, 50


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + MORE) / (total + MORE * terms)), exact beyond 64 bits on the way."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(count + MORE), wide(total + terms * MORE))


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences) and df (documents) for every term of every group; '' for nulls."""
    text = F.make_valid_utf8(F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")))
    single = docs.select(*_group(lang_col, source_col), text.alias("text")).mapInArrow(_counted, "lang string, source string, term string, n long, df long")
    return single.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each term of each group in each piece of the texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(2).cast(pa.large_binary())
        offsets, at = _offsets(texts), 0
        while at < len(texts):
            full = int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, "right")) - 1
            to = min(max(at + 1, full), at + PIECE_ROWS, len(texts))
            found = count_terms(batch.column(0)[at:to], batch.column(1)[at:to], texts[at:to])
            for k in range(0, found.num_rows, OUT_ROWS):
                yield found.slice(k, OUT_ROWS)
            at = to


def count_terms(langs: pa.Array, sources: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """lang, source, term, n and df of some rows, one at least and without nulls; texts: UTF-8 as large_binary."""
    spans, raw = cut_terms(texts)
    lengths = spans[1::2] - spans[::2]
    joined = raw.translate(None, b"\0")
    coded = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(np.append(0, np.cumsum(lengths))), pa.py_buffer(joined)]).dictionary_encode()
    langs, sources = langs.dictionary_encode(), sources.dictionary_encode()
    groups, group = np.unique(langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy(), return_inverse=True)
    offsets, rows, terms = _offsets(texts), len(texts), max(1, len(coded.dictionary))
    row = np.repeat(np.arange(rows), np.diff(np.searchsorted(spans[::2], offsets - offsets[0])))
    # one number for (group, term, row), of 55 bits at most: sorted, a term of a group stands together, and in it each row
    keys = np.sort((group[row] * terms + coded.indices.to_numpy()) * rows + row)
    cells = keys // rows
    first = np.flatnonzero(np.diff(cells, prepend=-1))
    n = np.diff(np.append(first, len(keys)))
    df = np.add.reduceat((np.diff(keys, prepend=-1) != 0).astype(np.int64), first) if len(first) else n
    of = groups[cells[first] // terms]
    said = coded.dictionary.take(pa.array(cells[first] % terms)).cast(pa.large_string()).cast(pa.string())
    named = [x.dictionary.take(pa.array(k)) for x, k in ((langs, of // len(sources.dictionary)), (sources, of % len(sources.dictionary)))]
    return pa.RecordBatch.from_arrays([*named, said, pa.array(n), pa.array(df)], ["lang", "source", "term", "n", "df"])


def cut_terms(texts: pa.Array) -> tuple[np.ndarray, bytes]:
    """Where terms begin and end, in turn, in the texts' bytes, and those bytes as IN_TERM has them."""
    offsets = _offsets(texts)
    data = texts.buffers()[2]
    raw = (b"" if data is None else data[int(offsets[0]) : int(offsets[-1])].to_pybytes()).translate(IN_TERM)
    inside = np.concatenate(([False], np.frombuffer(raw, np.uint8) != 0, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    # where one text ends in a term and the next begins with one, a term ends and another begins
    touch = np.unique(offsets - offsets[0])
    touch = np.repeat(touch[inside[touch] & inside[touch + 1]], 2)
    return np.insert(edges, np.searchsorted(edges, touch), touch), raw


def _offsets(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]


def _group(lang_col: str, source_col: str) -> list[Column]:
    return [F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"))]


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: how each (lang, source) group differs from the language's
    other sources (part pair, all of them) and the terms it uses more than its language (part term, ranks
    to top; ties by the item's bytes).

    Null texts, languages and sources are ''. Each language keeps the terms of at least `least` of its
    documents; a group without any of them has share MORE / (MORE * V) of each, and a language that keeps
    none has distances of 0. Repeated rows count as often as they stand there; long texts are read whole;
    an empty table gives no rows; other columns are not read.
    """
    groups = cut(docs.select(*_group(lang_col, source_col)).distinct())
    counts = cut(term_counts(docs, lang_col, source_col, text_col))
    kept = counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("said")).where(F.col("df") >= least).select("lang", "term", "all", "said")
    kept = cut(kept)  # one wide row for each kept term of a language
    spread = kept.select("lang", F.explode("said").alias("source", "n"))
    totals = groups.join(spread.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    sources = totals.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("sources"), F.sum("total").alias("lang_total"))
    frame = cut(sources.join(kept.groupBy("lang").agg(F.count("*").alias("terms")), "lang"))  # languages that keep terms
    share = lambda count, total: _share(count, total, F.col("terms"))
    shares = F.transform("sources", lambda s: share(F.coalesce(F.col("said")[s["source"]], F.lit(0).cast("long")), s["total"]))
    wide = cut(kept.join(frame, "lang").select("lang", "term", "said", F.col("sources.source").alias("sources"), shares.alias("p"), share(F.col("all"), F.col("lang_total")).alias("q")))
    return _pairs(groups, wide).unionByName(_terms(wide, top))


def _pairs(groups: DataFrame, wide: DataFrame) -> DataFrame:
    """Distances of all pairs of a language's sources. A term's row is first split by one source, so
    that what it emits at a time grows with the sources, not with their pairs."""
    one = wide.select("lang", "p", F.posexplode("p").alias("i", "here"))
    later = F.transform(F.slice("p", F.col("i") + 2, F.size("p")), lambda there, k: F.struct((F.col("i") + 1 + k).alias("j"), F.abs(F.col("here") - there).alias("f")))
    summed = one.where(F.col("i") + 1 < F.size("p")).select("lang", "i", F.inline(later)).groupBy("lang", "i", "j").agg(F.sum("f").alias("value"))
    place = groups.select("lang", "source", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("place"))
    both = place.select("lang", F.col("source"), F.col("place").alias("i")).join(place.select("lang", F.col("source").alias("item"), F.col("place").alias("j")), "lang").where("i <> j")
    ordered = both.withColumns({"lo": F.least("i", "j"), "hi": F.greatest("i", "j")})
    valued = ordered.join(summed.select("lang", F.col("i").alias("lo"), F.col("j").alias("hi"), "value"), ["lang", "lo", "hi"], "left")
    return _ranked(valued.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value")))


def _terms(wide: DataFrame, top: int) -> DataFrame:
    """The terms that a group uses more than its language."""
    here = F.filter(F.transform("sources", lambda s, k: F.struct(s.alias("source"), (F.col("p")[k] - F.col("q")).alias("value"), F.coalesce(F.col("said")[s], F.lit(0)).alias("n"))), lambda x: (x["n"] > 0) & (x["value"] > 0))
    rows = wide.select("lang", F.col("term").alias("item"), F.inline(here))
    return _ranked(rows.select("lang", "source", F.lit("term").alias("part"), "item", F.col("value").cast("long").alias("value"))).where(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))
