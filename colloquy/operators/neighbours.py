"""Nearest neighbours that skip what cannot hold one: the pool lies in shells around pivots, whose angles bound every similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators.vectors import BLOCK, POOL_BLOCK, _packed, _vectors, dot, meetings
from colloquy.sources.kept import Kept

#: Pivots and shells around each, at most; more vectors make more blocks of a shell, not more shells.
PIVOTS, SHELLS = 256, 16
#: Room for rounding: of angles (an arc cosine near 1 has about eight digits) and of similarities.
ANGLE_SLACK, SIM_SLACK = 1e-6, 2e-9
#: The cell of vectors that no angle places: null, (nearly) zero, or not of the pivots' dimension.
UNPLACED = -1


def pivots(pool: DataFrame, by: str | None, per_block: int) -> DataFrame:
    """(__by, pivots): of each value of by one vector for each per_block rows, at most PIVOTS, those with the smallest hashes of
    their ids. Any choice gives right results; it decides only how much is skipped."""
    rows = pool.select(F.col(by) if by else F.lit(0).alias("__by"), "id", "embedding").toDF("__by", "id", "embedding").where("__by IS NOT NULL")
    usable = rows.where(F.sqrt(dot(F.col("embedding"), F.col("embedding"))) > 1e-6)
    place = F.row_number().over(Window.partitionBy("__by").orderBy(F.xxhash64("id"), "id"))
    chosen = usable.withColumn("place", place).where(F.col("place") <= PIVOTS)
    wanted = rows.groupBy("__by").agg(F.ceil(F.count("*") / per_block).alias("wanted"))
    kept = chosen.join(wanted, "__by").where(F.col("place") <= F.col("wanted"))
    listed = kept.groupBy("__by").agg(F.array_sort(F.collect_list(F.struct("place", "embedding"))).alias("p"))
    same = F.filter("p", lambda x: F.size(x["embedding"]) == F.size(F.col("p")[0]["embedding"]))
    return wanted.drop("wanted").join(listed.select("__by", same["embedding"].alias("pivots")), "__by", "left")


def _angles(column: pa.Array, pivots: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Angles of a list of vectors with a list of pivots, and which vectors have any."""
    v, lengths = _vectors(column)
    if not pivots.is_valid()[0].as_py() or not len(pivots[0]):
        return np.zeros((len(v), 0)), np.zeros(len(v), bool)
    p, p_lengths = _vectors(pivots)
    usable = (lengths == p_lengths[0]) & v.any(axis=1)
    cosines = np.zeros((len(v), len(p)))
    if usable.any():
        cosines[usable] = v[usable, : p.shape[1]] @ p.T
    return np.arccos(np.clip(cosines, -1, 1)), usable


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector of a block with its nearest pivot and the angle to it."""
    for batch in batches:
        for at in range(batch.num_rows):
            by, ids, speakers, embeddings, pivots = (c.slice(at, 1) for c in batch.columns)
            angles, usable = _angles(embeddings, pivots)
            cell, angle = np.full(len(usable), UNPLACED), np.zeros(len(usable))
            if usable.any():
                cell[usable] = angles[usable].argmin(axis=1)
                angle[usable] = angles[usable].min(axis=1)
            who = by.take(pa.array(np.zeros(len(usable), int)))
            yield pa.RecordBatch.from_arrays([who, ids.flatten(), speakers.flatten(), embeddings.flatten(), pa.array(cell, pa.int32()), pa.array(angle)], names=["__by", "id", "speaker_id", "embedding", "cell", "angle"])


def _laid_out(pool: DataFrame, points: DataFrame, by: str | None, per_block: int) -> DataFrame:
    """The pool's rows with cell, angle and shell; a cell has about a shell for each per_block rows, of equal width."""
    blocks, _ = _packed(pool, ["id", "speaker_id", "embedding"], by, POOL_BLOCK, "")
    kinds = dict(blocks.dtypes)
    element = {c: kinds[c][6:-1] for c in ("id", "speaker_id", "embedding")}
    schema = f"__by {kinds['__by']}, id {element['id']}, speaker_id {element['speaker_id']}, embedding {element['embedding']}, cell int, angle double"
    placed = blocks.join(points, "__by").select("__by", "id", "speaker_id", "embedding", "pivots").mapInArrow(_cells, schema)
    sizes = placed.groupBy("__by", "cell").agg(F.least(F.ceil(F.count("*") / per_block), F.lit(SHELLS)).alias("n"), F.min("angle").alias("lo"), (F.max("angle") - F.min("angle") + 1e-9).alias("width"))
    return placed.join(sizes, ["__by", "cell"]).withColumn("shell", F.floor((F.col("angle") - F.col("lo")) / F.col("width") * F.col("n")).cast("int")).drop("n", "lo", "width")


def _chosen(k: int, first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each block of queries and each shell the queries that have to meet it: at first the nearest shells with k rows
    together; after that all that may hold a row as similar as the k-th so far (known: null if fewer were found). Vectors
    that no angle places have similarity 0 with those that one does, as if at a right angle."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                by, ids, embeddings, known, pivots, shells = (c.slice(at, 1) for c in batch.columns)
                cell, shell, lo, hi, n = (shells.flatten().field(c).to_numpy(zero_copy_only=False) for c in range(5))
                angles, usable = _angles(embeddings, pivots)
                bound, turn = np.zeros((len(usable), len(cell))), np.zeros((len(usable), len(cell)))
                if usable.any():
                    turn[usable] = np.where(cell == UNPLACED, 2 * np.pi, angles[usable][:, np.maximum(cell, 0)])
                    bound[usable] = np.where(cell == UNPLACED, np.pi / 2, np.clip(np.maximum(turn[usable] - hi, lo - turn[usable]) - ANGLE_SLACK, 0, np.pi))
                if first:
                    order = np.argsort(1000 * bound + turn, axis=1, kind="stable")
                    before = np.cumsum(n[order], axis=1) - n[order]
                    wanted = np.zeros_like(bound, bool)
                    np.put_along_axis(wanted, order, before < k, axis=1)
                else:
                    least = known.flatten().to_numpy(zero_copy_only=False).astype(float)
                    wanted = ~(np.cos(bound) < np.nan_to_num(least, nan=-np.inf)[:, None] - SIM_SLACK)
                rows = [(j, np.flatnonzero(wanted[:, j])) for j in np.flatnonzero(wanted.any(axis=0))]
                flat = pa.array(np.concatenate([r for _, r in rows]) if rows else np.zeros(0, int))
                offsets = pa.array(np.cumsum([0, *[len(r) for _, r in rows]]), pa.int32())
                take = np.array([j for j, _ in rows], int)
                lists = [pa.ListArray.from_arrays(offsets, c.flatten().take(flat)) for c in (ids, embeddings)]
                who = by.take(pa.array(np.zeros(len(rows), int)))
                yield pa.RecordBatch.from_arrays([who, pa.array(cell[take], pa.int32()), pa.array(shell[take], pa.int32()), *lists], names=["__by", "cell", "shell", "q_id", "q_embedding"])

    return choose


def _shells(rows: DataFrame) -> DataFrame:
    """(__by, cell, shell, lo, hi, n): the angles of a shell's vectors and their number."""
    return rows.groupBy("__by", "cell", "shell").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count("*").alias("n"))


def _asked(queries: DataFrame, known: DataFrame | None, points: DataFrame, shells: DataFrame, by: str | None, k: int) -> DataFrame:
    """Blocks of queries for each shell that they have to meet (__by, cell, shell, q_id, q_embedding)."""
    rows = queries.select(*([by] if by else []), "id", "embedding")
    rows = rows.withColumn("known", F.lit(None).cast("double")) if known is None else rows.join(known, "id", "left")
    blocks, _ = _packed(rows, ["id", "embedding", "known"], by, BLOCK, "q_")
    one = shells.groupBy("__by").agg(F.array_sort(F.collect_list(F.struct("cell", "shell", "lo", "hi", "n"))).alias("shells"))
    kinds = dict(blocks.dtypes)
    schema = f"__by {kinds['__by']}, cell int, shell int, q_id {kinds['q_id']}, q_embedding {kinds['q_embedding']}"
    met = blocks.join(points, "__by").join(one, "__by").select("__by", "q_id", "q_embedding", "q_known", "pivots", "shells")
    return met.mapInArrow(_chosen(k, known is None), schema)


def nearest(queries: DataFrame, pool: DataFrame, k: int, others: bool = True, by: str | None = None, per_block: int = POOL_BLOCK, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The same rows as vectors.nearest, from fewer meetings: (query, id, speaker_id, sim, place).

    The pool lies in cells around pivots and in shells of a cell. By the triangle inequality of angles a shell from lo to hi
    around a pivot at angle t from the query holds nothing nearer than max(t - hi, lo - t). Each query meets its nearest
    shells first, which gives a k-th similarity, and then every shell that may hold one as high. Nothing is left
    out: vectors that no angle places (null, zero, of another dimension) have a cell of their own, and such queries meet all. Vectors without any structure are not told apart by angles and meet as in vectors.nearest.

    Ids of queries are to be unique. A shell with many rows (copies of one vector, too) is dealt to blocks of per_block. What
    is used more than once is written by keep, if not given to the shared folder, until the program ends; an empty side gives no rows.
    """
    keep = keep or Kept(pool.sparkSession)
    wanted = k + 1 if others else k
    points = keep(pivots(pool, by, per_block))
    rows = keep(_laid_out(pool, points, by, per_block))
    shells = keep(_shells(rows))
    parts = shells.select("__by", "cell", "shell", F.ceil(F.col("n") / per_block).alias("blocks"))
    dealt = rows.join(parts, ["__by", "cell", "shell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    held = keep(dealt.groupBy("__by", "cell", "shell", "block").agg(F.collect_list(F.struct("id", "speaker_id", "embedding")).alias("p")))
    kinds = dict(pool.dtypes)
    schema = f"query {dict(queries.dtypes)['id']}, id {kinds['id']}, speaker_id {kinds['speaker_id']}, sim double"
    near, last = F.round("sim", 9), Window.partitionBy("query")

    def met(asked: DataFrame) -> DataFrame:
        sent = asked.join(parts, ["__by", "cell", "shell"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        both = sent.join(held, ["__by", "cell", "shell", "block"])
        return both.select("q_id", "q_embedding", F.col("p.id"), F.col("p.speaker_id"), F.col("p.embedding")).toDF("q_id", "q_embedding", "p_id", "p_speaker_id", "p_embedding").mapInArrow(meetings(k, others), schema)

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("place", F.row_number().over(last.orderBy(F.desc(near), "id"))).where(F.col("place") <= k)

    early = best(met(_asked(queries, None, points, shells, by, wanted)))
    known = keep(early.where(F.col("place") == k).select(F.col("query").alias("id"), F.col("sim").alias("known")))
    return best(met(_asked(queries, known, points, shells, by, wanted)))


def comparisons(queries: DataFrame, pool: DataFrame, k: int, others: bool = True, by: str | None = None, per_block: int = POOL_BLOCK) -> DataFrame:
    """One row (compared, pairs): how many pairs nearest compares, and how many there are."""
    keep = Kept(pool.sparkSession)
    wanted = k + 1 if others else k
    points = keep(pivots(pool, by, per_block))
    shells = keep(_shells(_laid_out(pool, points, by, per_block)))
    known = nearest(queries, pool, k, others, by, per_block, keep).where(F.col("place") == k).select(F.col("query").alias("id"), F.col("sim").alias("known"))
    asked = _asked(queries, None, points, shells, by, wanted).unionByName(_asked(queries, known, points, shells, by, wanted))
    compared = asked.join(shells, ["__by", "cell", "shell"]).agg(F.sum(F.size("q_id") * F.col("n")).alias("compared"))
    side = lambda rows, name: rows.select(F.col(by) if by else F.lit(0).alias("b")).toDF("b").groupBy("b").agg(F.count("*").alias(name))
    return compared.join(side(queries, "q").join(side(pool, "p"), "b").agg(F.sum(F.col("q") * F.col("p")).alias("pairs")))
