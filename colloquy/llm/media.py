"""Copies of images, cropped or edited, by local descriptors.

Corners are found at several scales; around each, pairs of points turned by the patch's own
orientation are compared, one bit for each. Corners meet in Hamming tables, keyed by samples of
these bits, where their whole descriptors are compared; images of near descriptors are copies if
enough of their matches agree on one similarity transform.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.bucket_links import Groups, Marks, link
from colloquy.llm.common import cut, mix64, quoted, slices

#: Scales, radius of a patch, distance that corners keep, least corner strength against the strongest.
SCALES, RADIUS, APART, STRENGTH = (1.0, 0.75, 0.5), 18, 6, 0.02
#: Bits of a descriptor; most differing bits of a match, pixels by which a match may miss, matches that must agree.
BITS, MATCH_BITS, MISS, AGREE = 256, 48, 3.0, 8
#: Hamming tables: key bits beyond the logarithm of the number of corners, and the share of the matches with so
#: many differing bits that the tables are to bring together. A pair of copies needs one of its matches.
KEY_MARGIN, FOUND_SHARE, FOUND_BITS = 8, 0.5, 24
#: Most differing bits of two corners that make their images candidates: the tables seldom bring together more, and
#: unrelated corners are mostly beyond it.
CANDIDATE_BITS = 40

_RNG = np.random.default_rng(20)
_PAIRS = np.clip(_RNG.normal(0, RADIUS / 2.2, (BITS, 4)), -RADIUS * 0.7, RADIUS * 0.7)
_DISC = np.stack([RADIUS * np.sqrt((np.arange(120) + 0.5) / 120) * f(np.arange(120) * 2.399963) for f in (np.cos, np.sin)], axis=1)

#: One corner: place in the full image, scale, orientation, packed bits.
CORNER = np.dtype([("x", "f4"), ("y", "f4"), ("scale", "f4"), ("angle", "f4"), ("bits", "u1", (BITS // 8,))])

_HEADER = re.compile(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+255\s", re.ASCII)


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey values of a binary PGM or PPM image of 8 bits; None if it is null or malformed."""
    m = _HEADER.match(data or b"")
    if not m:
        return None
    depth, w, h = 3 if m[1] == b"6" else 1, int(m[2]), int(m[3])
    pixels = np.frombuffer(data, np.uint8, offset=m.end())
    if w * h == 0 or len(pixels) < w * h * depth:
        return None
    return pixels[: w * h * depth].reshape(h, w, depth).mean(axis=2)


def encode(grey: np.ndarray) -> bytes:
    """A PGM image."""
    return b"P5 %d %d 255\n" % (grey.shape[1], grey.shape[0]) + np.clip(np.rint(grey), 0, 255).astype(np.uint8).tobytes()


def _padded(a: np.ndarray, r: int, axis: int) -> np.ndarray:
    pad = [(0, 0), (0, 0)]
    pad[axis] = (r, r)
    return np.pad(a, pad, mode="edge")


def _part(a: np.ndarray, start: int, n: int, axis: int) -> np.ndarray:
    return a[start : start + n] if axis == 0 else a[:, start : start + n]


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of 2 r + 1, edges repeated."""
    for axis in (0, 1):
        wide, n = _padded(a, r, axis), a.shape[axis]
        a = sum((_part(wide, k, n, axis) for k in range(1, 2 * r + 1)), _part(wide, 0, n, axis).copy()) / (2 * r + 1)
    return a


def _peaks(a: np.ndarray, r: int) -> np.ndarray:
    """Maxima over squares of 2 r + 1, edges repeated; widths double on the way."""
    for axis in (0, 1):
        best, width, n = _padded(a, r, axis), 1, a.shape[axis]
        while width < 2 * r + 1:
            step = min(width, 2 * r + 1 - width)
            m = best.shape[axis] - step
            best = np.maximum(_part(best, 0, m, axis), _part(best, step, m, axis))
            width += step
        a = _part(best, 0, n, axis)
    return a


def _scaled(grey: np.ndarray, scale: float) -> np.ndarray:
    h, w = (max(1, round(n * scale)) for n in grey.shape)
    if scale == 1:
        return grey
    ys, xs = (np.clip((np.arange(n) + 0.5) / scale - 0.5, 0, m - 1) for n, m in ((h, grey.shape[0]), (w, grey.shape[1])))
    y0, x0 = ys.astype(int), xs.astype(int)
    y1, x1 = np.minimum(y0 + 1, grey.shape[0] - 1), np.minimum(x0 + 1, grey.shape[1] - 1)
    fy, fx = (ys - y0)[:, None], (xs - x0)[None, :]
    top = grey[y0][:, x0] * (1 - fx) + grey[y0][:, x1] * fx
    return top * (1 - fy) + (grey[y1][:, x0] * (1 - fx) + grey[y1][:, x1] * fx) * fy


def _corner_places(grey: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gy, gx = np.gradient(_box(grey, 1))
    xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
    strength = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    best = _peaks(strength, APART)
    strong = (strength == best) & (strength > max(STRENGTH * strength.max(), 1e-3))
    edge = RADIUS
    strong[:edge], strong[-edge:], strong[:, :edge], strong[:, -edge:] = False, False, False, False
    return np.nonzero(strong)


def corners(grey: np.ndarray | None) -> np.ndarray:
    """All corners of an image whose patch lies inside it."""
    found = []
    for scale in SCALES if grey is not None else ():
        level = _scaled(grey, scale)
        if min(level.shape) <= 2 * RADIUS:
            continue
        ys, xs = _corner_places(level)
        if not len(ys):
            continue
        smooth = _box(level, 2)
        pick = lambda px, py, s=smooth: s[np.clip(np.rint(py).astype(int), 0, s.shape[0] - 1), np.clip(np.rint(px).astype(int), 0, s.shape[1] - 1)]
        ring = pick(xs[:, None] + _DISC[:, 0], ys[:, None] + _DISC[:, 1])
        ring = ring - ring.mean(axis=1, keepdims=True)
        angle = np.arctan2(ring @ _DISC[:, 1], ring @ _DISC[:, 0])
        cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
        turn = lambda p, q, c=cos, s=sin: (c * p - s * q, s * p + c * q)
        (ax, ay), (bx, by) = turn(_PAIRS[:, 0], _PAIRS[:, 1]), turn(_PAIRS[:, 2], _PAIRS[:, 3])
        bits = pick(xs[:, None] + ax, ys[:, None] + ay) < pick(xs[:, None] + bx, ys[:, None] + by)
        rows = np.zeros(len(xs), CORNER)
        rows["x"], rows["y"], rows["scale"], rows["angle"] = xs / scale, ys / scale, 1 / scale, angle
        rows["bits"] = np.packbits(bits, axis=1)
        found.append(rows)
    return np.concatenate(found) if found else np.zeros(0, CORNER)


def _unpacked(rows: np.ndarray) -> np.ndarray:
    return np.unpackbits(rows["bits"], axis=1).astype(np.float32)


def _mutual(a: np.ndarray, b: np.ndarray, rows: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b of mutual nearest descriptors within MATCH_BITS, worked out block by block."""
    right = _unpacked(b)
    ones, to, far = right.sum(axis=1), np.zeros(len(a), np.int64), np.zeros(len(a))
    back, best = np.zeros(len(b), np.int64), np.full(len(b), np.inf)
    for at in range(0, len(a), rows):
        left = _unpacked(a[at : at + rows])
        apart = left.sum(axis=1)[:, None] + ones - 2 * (left @ right.T)  # exact in single precision
        to[at : at + rows] = apart.argmin(axis=1)
        far[at : at + rows] = apart.min(axis=1)
        nearer = apart.min(axis=0) < best
        back[nearer], best[nearer] = apart.argmin(axis=0)[nearer] + at, apart.min(axis=0)[nearer]
    own = np.flatnonzero((far <= MATCH_BITS) & (back[to] == np.arange(len(a))))
    return own, to[own]


def agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """Most matches that one similarity transform explains. Each match proposes the transform that
    its scales and orientations give; matches are mutual nearest descriptors."""
    if not len(a) or not len(b):
        return 0
    own, other = _mutual(a, b)
    if len(own) < AGREE:
        return len(own)
    p, q = a[own], b[other]
    ratio, z, w = q["scale"] / p["scale"], p["x"] + 1j * p["y"], q["x"] + 1j * q["y"]
    factor = ratio * np.exp(1j * (q["angle"] - p["angle"]))
    most = 0
    for k in range(0, len(own), 256):
        s = slice(k, k + 256)
        miss = np.abs(w[None, :] - (w[s, None] + factor[s, None] * (z[None, :] - z[s, None])))
        most = max(most, int((miss <= MISS * np.maximum(1, ratio[s])[:, None] * 2).sum(axis=1).max()))
    return most


def _described(images: DataFrame) -> DataFrame:
    """id, digest of the image, n_corners and corners for rows (id, image)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            data = batch.column(1).to_pylist()
            found = [corners(decode(d)) for d in data]
            columns = [pa.array([hashlib.sha256(d or b"").digest() for d in data], pa.binary()), pa.array([len(f) for f in found], pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "digest", "n_corners", "corners"])

    return images.mapInArrow(rows, f"id {dict(images.dtypes)['id']}, digest binary, n_corners long, corners binary")


_WORDS = [f"b{k}" for k in range(BITS // 64)]


def _points(images: DataFrame) -> DataFrame:
    """point, node and the descriptor as four longs for every corner of images (node, corners)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [np.frombuffer(c, CORNER) for c in batch.column(1).to_pylist()]
            n = np.array([len(f) for f in found])
            node = np.repeat(batch.column(0).to_numpy(), n)
            place = np.concatenate([np.arange(k) for k in n]).astype(np.uint64)
            bits = np.ascontiguousarray(np.concatenate(found)["bits"]).view(np.int64)
            point = mix64(mix64(node.view(np.uint64)) + place).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(point), pa.array(node), *map(pa.array, bits.T.copy())], names=["point", "node", *_WORDS])

    return images.mapInArrow(rows, f"point long, node long, {', '.join(f'{c} long' for c in _WORDS)}")


def tables_for(n_points: int) -> list[list[int]]:
    """Masks (four longs) of the Hamming tables for so many corners.

    Keys have KEY_MARGIN bits more than the number of corners, so buckets do not fill up by chance as a
    corpus grows; there are as many tables as the share of matches to be found asks for at that length.
    """
    k = min(BITS, max(1, n_points).bit_length() + KEY_MARGIN)
    met = (1 - FOUND_BITS / BITS) ** k
    rng, out = np.random.default_rng(31), []
    for _ in range(int(np.ceil(np.log(1 - FOUND_SHARE) / np.log(1 - met)))):
        bits = np.zeros(BITS, np.uint8)
        bits[rng.permutation(BITS)[:k]] = 1
        out.append(np.packbits(bits).view(np.int64).tolist())
    return out


def _near(here: list[str], there: list[str]) -> Column:
    return sum((F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in zip(here, there, strict=True)), F.lit(0)) <= CANDIDATE_BITS


def _verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    left, right = (nodes.select(F.col("node").alias(c), F.col("corners").alias(f"{c}_corners")) for c in "ab")
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "a_corners", "b_corners")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            linked = [agreeing(np.frombuffer(x, CORNER), np.frombuffer(y, CORNER)) >= AGREE for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return joined.mapInArrow(rows, "a long, b long, linked boolean")


def find_copies(images: DataFrame, id_col: str = "image_id", image_col: str = "image") -> DataFrame:
    """id, n_corners, group_id (the smallest id that links lead to) and group_size for every row.

    images has a binary column of PGM or PPM images. Images without corners, null and malformed
    ones among them, are linked with nothing; equal images are described as often as they occur but
    compared once; repeated rows are in one group; images of any size are described whole; further
    columns are not read. Copies are missed if none of their matches meets in a table.
    """
    described = cut(_described(images.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(image_col)).alias("image"))))
    seed = 0
    while True:
        named = described.withColumn("node", F.when(F.col("n_corners") > 0, F.xxhash64("digest", F.lit(seed))))
        nodes = cut(named.where(F.col("n_corners") >= AGREE).groupBy("node").agg(F.first("corners").alias("corners"), F.min("digest").alias("lo"), F.max("digest").alias("hi")))
        if nodes.where("lo <> hi").isEmpty():
            break
        seed += 1  # two images share a number: others are drawn
    points = cut(_points(nodes.select("node", "corners")))
    masks = tables_for(points.count())
    keys = [F.xxhash64(F.lit(t), *[F.col(c).bitwiseAND(F.lit(m)) for c, m in zip(_WORDS, mask, strict=True)]) for t, mask in enumerate(masks)]
    groups = Groups(lambda pairs: _verified(pairs, nodes))
    link(points.select("point", F.explode(F.array(*keys)).alias("key")), Marks(points, _WORDS, _near), groups)
    rooted = cut(groups.rooted(named.select("id", "n_corners", "node"), "node").select("id", "n_corners", "node_root"))
    names = rooted.where("node_root IS NOT NULL").groupBy("node_root").agg(F.min("id").alias("group"), F.count("*").alias("size"))
    return rooted.join(cut(names), "node_root", "left").select(F.col("id").alias(id_col), "n_corners", F.coalesce("group", "id").alias("group_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"))


def drawing(vector: list[float], side: int = 96, cell: int = 4) -> np.ndarray:
    """A picture that a vector stands for: cells whose greys are mixtures of its values, the same mixtures for all."""
    n = side // cell
    greys = 128 + 100 * np.tanh(_mixtures(n * n, len(vector)) @ np.asarray(vector, float))
    return np.kron(greys.reshape(n, n), np.ones((cell, cell)))


@lru_cache(8)
def _mixtures(cells: int, length: int) -> np.ndarray:
    return np.random.default_rng(40).normal(0, 1, (cells, length))


def edited(image: np.ndarray, kind: int) -> np.ndarray:
    """A copy: by kind cropped, brighter and flatter, turned by a right angle, or with grain."""
    if kind == 0:
        return image[6:-4, 4:-6]
    if kind == 1:
        return image * 0.8 + 30
    if kind == 2:
        return np.rot90(image)
    y, x = np.indices(image.shape)
    return np.clip(image + (x * 37 + y * 61) % 13 - 6, 0, 255)


def drawn(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20) -> DataFrame:
    """image_id and image: each vector as a drawing, for tables that have no images of their own; and of each row
    whose id is divisible by every an edited copy with the id -1 - id. A null or empty vector gives a null image."""
    chosen = vectors.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(vector_col)).alias("v"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, images = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole = drawing(v) if v and None not in v else None
                ids.append(i)
                images.append(None if whole is None else encode(whole))
                if i is not None and i % every == 0:
                    ids.append(-1 - i)
                    images.append(None if whole is None else encode(edited(whole, i // every % 4)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(images, pa.binary())], names=["image_id", "image"])

    return chosen.mapInArrow(rows, f"image_id {dict(chosen.dtypes)['id']}, image binary")
