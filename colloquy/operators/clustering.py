"""Clusterings that depend on the order of a small group: one clip, or one scope of candidates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.config import DEFAULTS, Settings
from colloquy.operators import store
from colloquy.operators.vectors import summed as sums_of


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return v if n < 1e-8 else v / n


def merge_closest(vectors: np.ndarray, distance: float) -> list[int]:
    """Clusters numbered by first appearance. The two clusters whose unit centroids are closest by
    cosine distance become one, the earlier pair on ties, as long as they are within distance; its
    centroid is the mean by sizes, at unit length again."""
    if len(vectors) == 0:
        return []
    groups: list[list[int]] = [[k] for k in range(len(vectors))]
    centers = np.array([_unit(v) for v in vectors.astype(float)]).reshape(len(vectors), -1)
    apart = 1 - centers @ centers.T
    apart[np.tril_indices(len(groups))] = np.inf
    while apart.size:
        a, b = np.unravel_index(np.argmin(apart), apart.shape)
        if not apart[a, b] <= min(distance, 2.5):  # pairs that are gone stand at infinity
            break
        centers[a] = _unit((centers[a] * len(groups[a]) + centers[b] * len(groups[b])) / (len(groups[a]) + len(groups[b])))
        groups[a] += groups[b]
        groups[b] = []
        apart[b], apart[:, b] = np.inf, np.inf
        alive = np.array([bool(g) for g in groups])
        now = np.where(alive, 1 - centers @ centers[a], np.inf)
        apart[:a, a], apart[a, a + 1 :] = now[:a], now[a + 1 :]
    label = {k: g for g, members in enumerate(sorted(filter(None, groups), key=min)) for k in members}
    return [label[k] for k in range(len(vectors))]


def follow_leaders(vectors: np.ndarray, threshold: float) -> list[int]:
    """Each vector, in order, joins the cluster with the most similar center if that is similar
    enough, else it leads a new one. Centers are running means at unit length; the first is raw."""
    centers: list[np.ndarray] = []
    sizes: list[int] = []
    out = []
    for v in vectors.astype(float):
        sims = [float(_unit(c) @ _unit(v)) if min(np.linalg.norm(c), np.linalg.norm(v)) >= 1e-8 else 0.0 for c in centers]
        best = int(np.argmax(sims)) if sims else -1
        if best >= 0 and sims[best] >= threshold:
            sizes[best] += 1
            centers[best] = _unit(centers[best] + (v - centers[best]) / sizes[best])
        else:
            best = len(centers)
            centers.append(v.copy())
            sizes.append(1)
        out.append(best)
    return out


def _clustered(rows: DataFrame, by: str, order: list[str], ascending: list[bool], label) -> DataFrame:
    kinds = dict(rows.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ascending=ascending)
        return pd.DataFrame({by: pdf[by], "id": pdf["id"], "cluster": label(np.stack(pdf["embedding"].to_list()))})

    return rows.groupBy(by).applyInPandas(one, f"`{by}` {kinds[by]}, id {kinds['id']}, cluster int")


def cluster_clips(rows: DataFrame, by: str = "clip_id", distance: float = DEFAULTS.cluster_distance) -> DataFrame:
    """(by, id, cluster) by merging the closest, within each clip in the order of ids. A clip has a
    few hundred segments at most, so that one task holds it."""
    return _clustered(rows, by, ["id"], [True], lambda v: merge_closest(v, distance))


def cluster_candidates(rows: DataFrame, by: str, threshold: float = 0.5) -> DataFrame:
    """(by, id, cluster) by leaders, the latest segment first."""
    return _clustered(rows, by, ["start_ms", "id"], [False, True], lambda v: follow_leaders(v, threshold))


def candidate_list(rows: DataFrame, by: str, threshold: float = 0.5, min_rows: int = 5, min_ms: int = 60_000, min_sessions: int = 2) -> DataFrame:
    """Candidates for new speakers, one row for each cluster of leaders: by, candidate (named after its representative, the
    longest segment, the latest on ties), member_ids, totals, and whether it is worth asking for.

    rows: by, id, session_id, start_ms, end_ms, embedding; rows without a vector are left out.
    """
    usable = rows.where(F.size("embedding") > 0)
    members = usable.drop("embedding").join(cluster_candidates(usable, by, threshold), [by, "id"])
    length = F.col("end_ms") - F.col("start_ms")
    found = members.groupBy(by, "cluster").agg(
        F.min(F.struct((-length).alias("l"), (-F.col("start_ms")).alias("s"), "id"))["id"].alias("representative"), F.array_sort(F.collect_list("id")).alias("member_ids"),
        F.count("*").alias("n_rows"), F.sum(length).alias("total_ms"), F.count_distinct("session_id").alias("n_sessions"), F.max("end_ms").alias("last_ms"),
    )
    worth = (F.col("n_rows") >= min_rows) & (F.col("total_ms") >= min_ms) & (F.col("n_sessions") >= min_sessions)
    return found.drop("cluster").withColumns({"candidate": F.concat(F.lit("cand_"), F.col("representative").cast("string")), "eligible": worth})


def name_in_order(centers: np.ndarray, sums: np.ndarray, keys: list[str], known: list[tuple[str, bool, np.ndarray]], confirm: float) -> list[str]:
    """The speaker of each cluster, in order: the most similar one, the smallest id on ties, if similar enough, else a new
    provisional one with the cluster's key as its id. known: id, whether provisional, and the sum of its vectors. What
    later clusters are compared with grows with the clusters that a provisional speaker gets."""
    ids, loose, totals = [k[0] for k in known], [k[1] for k in known], [np.asarray(k[2], float) for k in known]
    units = [_unit(t) for t in totals]
    out = []
    for center, total, key in zip(centers, sums, keys, strict=True):
        there = [k for k, u in enumerate(units) if len(u) == len(center)]
        sims = np.round(np.array([units[k] for k in there]).reshape(len(there), -1) @ center, 9) if there else np.zeros(0)
        best = min(zip(-sims, (ids[k] for k in there), there, strict=True), default=None)
        if best is None or -best[0] < confirm:
            ids.append(key)
            loose.append(True)
            totals.append(np.asarray(total, float))
            units.append(_unit(totals[-1]))
            out.append(key)
            continue
        at = best[2]
        if loose[at]:
            totals[at] = totals[at] + total
            units[at] = _unit(totals[at])
        out.append(ids[at])
    return out


def name_clusters(members: DataFrame, speakers: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(tenant_id, clip_id, cluster, speaker_id, provisional) for each cluster with enough segments and time.

    members: tenant_id, clip_id, cluster, id, start_ms, end_ms, embedding; speakers: tenant_id, speaker_id, provisional,
    embedding, a row for each vector. A tenant's clusters are named one after the other, by start and then clip, as later ones
    may belong to a speaker whom an earlier one made; the task gets sums of vectors, one for each cluster and speaker.
    """
    keys = ["tenant_id", "clip_id", "cluster"]
    gate = store.gated_clusters(members, settings.cluster_min_segments, settings.cluster_min_ms).select("clip_id", "cluster")
    kept = members.join(gate, ["clip_id", "cluster"], "left_semi")
    unit = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    scaled = F.transform("embedding", lambda x: x.cast("double") / F.greatest(unit, F.lit(1e-8)))

    def summed(rows: DataFrame, by: list[str], vector: Column, name: str) -> DataFrame:
        return sums_of(rows, by, vector).select(*by, F.col("total").alias(name))

    starts = kept.groupBy(*keys).agg(F.min("start_ms").alias("start_ms"))
    found = starts.join(summed(kept, keys, scaled, "center"), keys).join(summed(kept, keys, F.col("embedding"), "total"), keys)
    held = summed(speakers, ["tenant_id", "speaker_id", "provisional"], F.col("embedding"), "total")
    kinds = dict(members.dtypes)

    def named(clusters: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        clusters = clusters.sort_values(["start_ms", "clip_id", "cluster"])
        fresh = [f"{c}/{k}" for c, k in zip(clusters["clip_id"], clusters["cluster"], strict=True)]
        rows = list(zip(known["speaker_id"], known["provisional"], known["total"], strict=True))
        who = name_in_order([_unit(np.asarray(c, float)) for c in clusters["center"]], list(clusters["total"]), fresh, rows, settings.confirm)
        fixed = {r[0] for r in rows if not r[1]}
        return pd.DataFrame({k: clusters[k].to_numpy() for k in keys} | {"speaker_id": who, "provisional": [w not in fixed for w in who]})

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", speaker_id string, provisional boolean"
    return found.groupBy("tenant_id").cogroup(held.groupBy("tenant_id")).applyInPandas(named, schema)


def assign_clips(members: DataFrame, speakers: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(tenant_id, clip_id, id, speaker_id, local_index) of every segment of clips: clusters, then their speakers. Segments of
    clusters that are too small have neither."""
    labels = cluster_clips(members, distance=settings.cluster_distance)
    with_cluster = members.join(labels, ["clip_id", "id"])
    who = name_clusters(with_cluster, speakers, settings)
    return with_cluster.join(who, ["tenant_id", "clip_id", "cluster"], "left").select(
        "tenant_id", "clip_id", "id", "speaker_id", F.when(F.col("speaker_id").isNotNull(), F.col("cluster")).alias("local_index")
    )
