"""Groups of linked things from buckets in which candidates meet.

Two things are candidates if a point of one and a point of the other share a bucket. Short marks of
points rule out most pairs inside the joins; the others are tested as wholes. Links matter only for
the groups they form, so a bucket's points first meet a few of its points, groups form, and only
points of different groups meet after that, tile by tile, so that no bucket is one task's work.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import collect_garbage, cut
from colloquy.llm.components import connected

#: Points of a bucket that meet as many others in one row group of the last join.
TILE = 256

#: Nodes that a node was tested against, of which its points know in the last join; pairs beyond these meet again there.
KNOWN = 256

#: The least keys of a point that go with it into the last join, where a pair meets in the least one that both have.
SHORT = 16

#: Orders in which a bucket's point to meet is chosen, round by round: the last node's, then two mixed orders.
_FLIPS = (-1, 0x3C6EF372FE94F82B, 0x5BE0CD19137E2179)


class Groups:
    """The groups that the links found so far form. verify: from pairs of nodes (a, b) to tested pairs
    (a, b, linked)."""

    def __init__(self, verify: Callable[[DataFrame], DataFrame]):
        self.verify, self.roots = verify, None

    def add(self, tested: DataFrame) -> bool:
        """Joins the groups that tested links; True if there were any."""
        links = tested.where("linked").select("a", "b")
        links = cut(self.rooted(self.rooted(links, "a"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).where("a <> b"))
        if links.isEmpty():
            return False
        joined = connected(links)
        if self.roots is not None:
            older = self.roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("higher")), "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
            joined = cut(older.union(joined.join(self.roots, "node", "left_anti")))
        self.roots = joined
        return True

    def rooted(self, rows: DataFrame, column: str) -> DataFrame:
        """rows with the root of a column's node beside it."""
        if self.roots is None:
            return rows.withColumn(f"{column}_root", F.col(column))
        known = self.roots.select(F.col("node").alias(column), F.col("root").alias("__root"))
        return rows.join(known, column, "left").withColumn(f"{column}_root", F.coalesce("__root", column)).drop("__root")

    def mixed(self, entries: DataFrame) -> DataFrame:
        """The entries (key, point, node) of keys whose nodes are of several groups, with node_root,
        the key's largest group (main), and its numbers of entries (total) and of those not in main
        (others). Of keys with the same points (by number and 128 bits of hashes) one stays, as
        the same pairs meet in all of them."""
        entries = cut(self.rooted(entries.select("key", "point", "node"), "node"))
        hashes = [F.bit_xor(F.xxhash64("point", F.lit(k))).alias(f"h{k}") for k in range(2)]
        parts = entries.groupBy("key", "node_root").agg(F.count("*").alias("n"), *hashes)
        keys = parts.groupBy("key").agg(F.max_by("node_root", F.struct("n", "node_root")).alias("main"), F.sum("n").alias("total"), (F.sum("n") - F.max("n")).alias("others"), *[F.bit_xor(f"h{k}").alias(f"h{k}") for k in range(2)]).where("others > 0")
        keys = keys.groupBy("total", "others", "main", "h0", "h1").agg(F.min("key").alias("key")).drop("h0", "h1")
        return cut(entries.join(keys, "key"))


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


@dataclass(frozen=True)
class Marks:
    """Short marks of points (rows: point, node and the columns names) and what two points' marks must
    fulfil if their nodes can be linked (near: from the names and the other's names to a condition)."""

    rows: DataFrame
    names: list[str]
    near: Callable[[list[str], list[str]], Column]

    @property
    def there(self) -> list[str]:
        return [f"other_{c}" for c in self.names]

    def candidates(self, pairs: DataFrame) -> DataFrame:
        """Pairs of nodes (a, b) whose points' marks allow a link, from pairs of points (p, q)."""
        left = self.rows.select(F.col("point").alias("p"), F.col("node").alias("a"), *self.names)
        right = self.rows.select(F.col("point").alias("q"), F.col("node").alias("b"), *[F.col(c).alias(t) for c, t in zip(self.names, self.there, strict=True)])
        pairs = pairs.where("p <> q").select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()
        return ordered(pairs.join(left, "p").join(right, "q").where(self.near(self.names, self.there)).select("a", "b"))


def _known(tested: DataFrame, groups: Groups) -> DataFrame:
    """(node, known): the nodes of other groups that a node was tested against, KNOWN at most."""
    apart = groups.rooted(groups.rooted(tested.select("a", "b"), "a"), "b").where("a_root <> b_root")
    both = cut(apart.select(F.col("a").alias("node"), F.col("b").alias("other")).union(apart.select("b", "a")).distinct())
    # one node for each value of a hash: a node that was tested against very many gathers no more than so many
    few = both.groupBy("node", F.pmod(F.xxhash64("other"), F.lit(KNOWN)).alias("place")).agg(F.min("other").alias("other"))
    return few.groupBy("node").agg(F.collect_list("other").alias("known"))


def _short(mixed: DataFrame) -> DataFrame:
    """(point, short): the SHORT least keys of each point."""
    return mixed.groupBy("point").agg(F.slice(F.array_sort(F.collect_set("key")), 1, SHORT).alias("short"))


def _across(mixed: DataFrame, marks: Marks, known: DataFrame) -> DataFrame:
    """Pairs of nodes of different groups that share a key and whose marks allow a link, without pairs of which a node knows
    (known: node, known). Nodes that are nearly linked share many keys, and a pair that was tested would meet in all of them.

    The points outside a key's main group meet all of its points. Both sides are dealt into tiles, and
    each pair of tiles is a join key of its own: a hot key is many tasks. Of the keys that two points
    share they meet in one, the least of those among both points' least keys; points that have none of
    these in common share few keys, and meet in all.
    """
    tiles = lambda n: F.ceil(F.col(n) / TILE)
    tile = lambda n: F.pmod(F.xxhash64("point"), tiles(n))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), tiles(n) - 1))
    marked = cut(mixed.join(marks.rows.drop("node"), "point").join(_short(mixed), "point"))
    asking = marked.where("node_root <> main").join(known, "node", "left")
    left = asking.select("key", "node", "node_root", F.coalesce("known", F.array().cast(dict(known.dtypes)["known"])).alias("known"), "short", *marks.names, tile("others").alias("i"), spread("total").alias("j"))
    right = marked.select("key", F.col("node").alias("other"), F.col("node_root").alias("other_root"), "main", F.col("short").alias("other_short"), *[F.col(c).alias(t) for c, t in zip(marks.names, marks.there, strict=True)], tile("total").alias("j"), spread("others").alias("i"))
    meet = (F.col("node_root") < F.col("other_root")) | ((F.col("node_root") > F.col("other_root")) & (F.col("other_root") == F.col("main")))
    once = F.coalesce(F.array_min(F.array_intersect("short", "other_short")) == F.col("key"), F.lit(True))
    return ordered(left.join(right, ["key", "i", "j"]).where(meet & ~F.array_contains("known", F.col("other")) & marks.near(marks.names, marks.there) & once).select(F.col("node").alias("a"), F.col("other").alias("b")))


def link(entries: DataFrame, marks: Marks, groups: Groups) -> None:
    """Finds the links that matter to the groups among nodes with points that share a key (entries: key
    and point, no entry twice).

    Every pair of nodes that share a key is tested or ruled out by marks, but for pairs of nodes that
    other links have joined by then.
    """
    shared = cut(entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    collect_garbage(entries.sparkSession)
    live = cut(entries.join(shared, "key").join(marks.rows.select("point", "node"), "point"))
    collect_garbage(entries.sparkSession)
    # the first node's point: a group that shares many keys meets the same node in all of them
    first = live.groupBy("key").agg(F.min(F.struct("node", "point"))["point"].alias("q"))
    pairs = live.join(first, "key").select(F.col("point").alias("p"), "q")
    near = cut(marks.candidates(pairs))
    tested = cut(groups.verify(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")))  # one pair for each node first
    groups.add(tested)
    apart = groups.rooted(groups.rooted(near, "a"), "b").where("a_root <> b_root").select("a", "b").join(tested.select("a", "b"), ["a", "b"], "left_anti")
    found = cut(groups.verify(cut(apart)))
    tested = tested.union(found)
    groups.add(found)
    crowded = live.where("size > 2")  # in smaller buckets the first has met the other
    mixed = groups.mixed(crowded)
    for flip in _FLIPS:
        if mixed.isEmpty():
            return
        head = F.min(F.struct(F.col("node").bitwiseXOR(F.lit(flip)).alias("place"), "point", "node_root"))
        chosen = mixed.groupBy("key").agg(head.alias("c")).select("key", F.col("c.point").alias("q"), F.col("c.node_root").alias("q_root"))
        pairs = mixed.join(chosen, "key").where("node_root <> q_root").select(F.col("point").alias("p"), "q")
        found = cut(groups.verify(cut(marks.candidates(pairs).join(tested.select("a", "b"), ["a", "b"], "left_anti"))))
        tested = tested.union(found)
        if not groups.add(found):
            break
        mixed = groups.mixed(mixed)
        collect_garbage(entries.sparkSession)
    if not mixed.isEmpty():
        pairs = cut(_across(mixed, marks, cut(_known(tested, groups))))
        groups.add(cut(groups.verify(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"))))
    collect_garbage(entries.sparkSession)
