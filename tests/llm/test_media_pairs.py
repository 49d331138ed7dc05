"""Copies of images that share few or no exact descriptors, against brute force over all pairs."""

import numpy as np
import pytest

from colloquy.llm import media


def drawn(seed, side=150):
    rng = np.random.default_rng(seed)
    out = np.full((side, side), 120.0)
    for _ in range(40):
        x, y = rng.integers(0, side - 20, 2)
        w, h = rng.integers(6, 30, 2)
        out[y : y + h, x : x + w] = rng.integers(0, 256)
    return out


def noisy(image, strength, seed):
    return np.clip(image + np.random.default_rng(seed).normal(0, strength, image.shape), 0, 255)


def turned(image, degrees):
    """The image about its middle, grey outside."""
    c, s, n = np.cos(np.radians(degrees)), np.sin(np.radians(degrees)), len(image)
    y, x = np.mgrid[:n, :n] - (n - 1) / 2
    px, py = np.rint(c * x - s * y + (n - 1) / 2).astype(int), np.rint(s * x + c * y + (n - 1) / 2).astype(int)
    inside = (px >= 0) & (px < n) & (py >= 0) & (py < n)
    return np.where(inside, image[np.clip(py, 0, n - 1), np.clip(px, 0, n - 1)], 120.0)


def found_groups(spark, images):
    rows = spark.createDataFrame([(k, bytearray(media.encode(x))) for k, x in enumerate(images)], "image_id long, image binary")
    return {r.image_id: r.group_id for r in media.find_copies(rows).collect()}


def brute_groups(images):
    """Groups by comparing every pair, and the pairs that are copies."""
    described = [media.corners(media.decode(media.encode(x))) for x in images]
    top, links = list(range(len(images))), []
    for a in range(len(images)):
        for b in range(a + 1, len(images)):
            if media.agreeing(described[a], described[b]) >= media.AGREE:
                links.append((a, b))
                x, y = sorted((top[a], top[b]))
                top = [x if t == y else t for t in top]
    return dict(enumerate(top)), links


def test_copies_among_many_with_one_logo(spark, monkeypatch):
    """140 images show a logo whose descriptors have the same 60 bits; 20 of them have a copy in which
    every other descriptor differs in 40 bits. The logo alone links nothing."""
    rng = np.random.default_rng(20)
    rng.normal(size=(media.BITS, 4))
    logo = rng.permutation(media.BITS)[:60]
    rows = []
    for k in range(140):
        bits = rng.integers(0, 2, (12, media.BITS), dtype=np.uint8)
        bits[0, logo] = 1
        made = np.zeros(12, media.CORNER)
        made["x"], made["y"], made["scale"] = rng.uniform(20, 400, 12), rng.uniform(20, 400, 12), 1
        for image in (2 * k, 2 * k + 1)[: 2 if k < 20 else 1]:
            if image % 2:
                for other in bits[1:]:
                    other[rng.permutation(media.BITS)[:40]] ^= 1
                bits[0, np.setdiff1d(np.arange(media.BITS), logo)] = rng.integers(0, 2, media.BITS - 60)
            made["bits"] = np.packbits(bits, axis=1)
            rows.append((image, bytearray(made.tobytes()), 12, bytearray(made.tobytes())))
    described = spark.createDataFrame(rows, "id long, digest binary, n_corners long, corners binary")
    monkeypatch.setattr(media, "_described", lambda _: described)
    images = spark.createDataFrame([(0, bytearray(b""))], "image_id long, image binary")
    found = {r.image_id: r.group_id for r in media.find_copies(images).collect()}
    joined = sum(found[2 * k] == found[2 * k + 1] for k in range(20))
    print("copies", 20, "found", joined)
    assert joined >= 18 and all(g in (i, i - i % 2) for i, g in found.items())


def test_noisy_rescaled_and_turned_copies(spark):
    """Copies whose descriptors differ in many bits: nine of ten links of brute force, or more, join their
    images, for each kind of edit, and nothing else is joined."""
    images = []
    for k in range(8):
        whole = drawn(50 + k)
        images += [whole, noisy(whole, 12, k), noisy(whole, 25, k), media._scaled(whole, 0.75), media._scaled(whole, 0.9), turned(whole, 33), turned(noisy(whole, 8, k), 12), whole[12:140, 8:138]]
    groups, links = brute_groups(images)
    found = found_groups(spark, images)
    for kind in range(8):
        of_kind = [(a, b) for a, b in links if kind in (a % 8, b % 8)]
        print("kind", kind, "links", len(of_kind), "joined", sum(found[a] == found[b] for a, b in of_kind))
        assert sum(found[a] == found[b] for a, b in of_kind) >= 0.9 * len(of_kind)
    assert len(links) > 40 and all(groups[a] == groups[found[a]] for a in found)


@pytest.mark.parametrize("n", [500, 2000])
def test_registered_query_against_brute_force(spark, n):
    """The drawings of the registered query and their edited copies: recall of the links of brute force (each copy
    against its own drawing and, for all of the small table, every pair), and candidates in proportion to the images."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").limit(n)
    rows = {r.image_id: bytes(r.image) for r in media.drawn(vectors).collect()}
    found = {r.image_id: r.group_id for r in media.find_copies(media.drawn(vectors)).collect()}
    assert set(found) == set(rows)
    pairs = [(i, -1 - i) for i in rows if -1 - i in rows and i >= 0]
    linked = [(a, b) for a, b in pairs if media.agreeing(*(media.corners(media.decode(rows[i])) for i in (a, b))) >= media.AGREE]
    joined = sum(found[a] == found[b] for a, b in linked)
    print("images", len(rows), "copies", len(pairs), "linked", len(linked), "joined", joined)
    assert len(linked) >= 0.9 * len(pairs) and joined >= 0.9 * len(linked)
    assert sum(g != i for i, g in found.items()) <= len(pairs)


def test_tables_grow_with_the_corpus():
    sizes = [media.tables_for(n) for n in (0, 100, 10**6, 10**9)]
    bits = [sum(int(x & ((1 << 64) - 1)).bit_count() for x in masks[0]) for masks in sizes]
    assert bits == sorted(bits) and [len(s) for s in sizes] == sorted(len(s) for s in sizes)
    for masks, k in zip(sizes, bits):
        assert 1 - (1 - (1 - media.FOUND_BITS / media.BITS) ** k) ** len(masks) >= media.FOUND_SHARE


def test_large_images_and_ties():
    rng = np.random.default_rng(4)
    image = np.kron(rng.integers(0, 255, (90, 90)), np.ones((9, 9)))
    found = media.corners(image)
    assert len(found) > 1200 and media.agreeing(found, found) == len(np.unique(found["bits"], axis=0))
    flat = media.corners(np.tile(image[:90, :90], (3, 3)))  # equal patches: ties
    assert media.agreeing(flat, flat) >= media.AGREE
