"""The operators against brute force, exact round trips and held-out labels."""

import hashlib
import re
from collections import defaultdict
from html.parser import HTMLParser
from pathlib import Path

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from colloquy.llm import bpe, exact_dedup, html_extract, media, mixing, ngram_join, pii, quality, queries, toxicity
from colloquy.llm.common import crc_mod

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def luhn(digits):
    values = [int(c) for c in digits[::-1]]
    return sum(v if k % 2 == 0 else sum(divmod(2 * v, 10)) for k, v in enumerate(values)) % 10 == 0


def base_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15),
    )
    found = [(m.start(), n, kind, m.end()) for n, (kind, rule, ok) in enumerate(rules) for m in re.finditer(rule, text) if ok(m[0])]
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found)]


TRICKY = ["a@b@c.de x@y.z@q.rs", "1.2.3.4.5.6.7.8.9", "1.2.3 1.2.3.256 001.2.3.4", "+1 (555) 010-0199+49 30 901820", "+1+15550100199", "4111 1111-1111 1111 2", "4111--1111 4111111111111111", "%@a-b.c..d me@-.-", "ünï@é.com é+14155550100", "+1 2", "@a.b", "١٢٣٤ 1.2.3.٤", "", "a" * 5000 + "@x.yz"]


def test_pii_base_spans(texts):
    for text in [*texts.values(), *TRICKY]:
        assert [f"{s.kind}:{s.start}:{s.end}" for s in pii.find_spans(text) if s.kind in pii.BASE] == base_spans(text)


def test_pii_query(spark, texts):
    for r in queries.op1_pii(spark, SMALL).collect():
        spans = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in spans) for k in pii.BASE]
        assert set(spans) <= set(r.spans.split(",")) | set("" for _ in [0] if not spans)


def test_bpe_is_the_librarys(spark, texts):
    library = Tokenizer.from_file(queries.vocabulary_path())
    library.no_truncation()
    library.no_padding()
    own = bpe.encoder_at(queries.vocabulary_path())
    extra = ["", " ", "\n\n  x", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", "naïve 日本語 🙂🙂", "don't  we'll", "x" * 3000, "ab" * 2000, "\u0000\u200d", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa!!!!!!!!!!!!!!!!!1234567890123"]
    for text in [*texts.values(), *extra]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == text
    for r in queries.op7_bpe(spark, SMALL).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def linked_groups(texts, words, percent):
    sets = {}
    for i, text in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in texts if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(sets[i]), top(i)) for i in texts}


def test_ngram_query(spark, texts):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op9_ngram_join(spark, SMALL).collect()}
    assert found == linked_groups(texts, 3, 90)


@pytest.mark.parametrize("words, percent, n", [(5, 80, 60), (3, 90, 90)])
def test_ngram_near_the_limit(spark, words, percent, n):
    """A family of edited copies, some links just at the limit."""
    rng = np.random.default_rng(n)
    base = [f"w{k}" for k in rng.integers(0, 5000, n)]
    made = {}
    for i in range(90):
        text = list(base if i < 60 or i % 2 else made[i - 30].split(" "))
        for at in rng.integers(0, len(text), int(rng.integers(0, 7))):
            text[at] = f"e{rng.integers(0, 40)}"
        made[i] = " ".join(text[: len(text) - int(rng.integers(0, 5))])
    made |= {200: "", 201: "A b", 202: "a  B", 203: "\t", 204: made[5].upper()}
    docs = spark.createDataFrame([(i, t) for i, t in made.items()], "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(docs, words=words, percent=percent).collect()}
    assert found == linked_groups(made, words, percent)
    kept = {r.doc_id for r in ngram_join.keep_one(docs, words=words, percent=percent).collect()}
    assert kept == {c for _, c in found.values()}


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    for size in (1, 5, 80, 3000):
        a = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[: size // 2], rng.integers(0, 1 << 62, size // 3).astype(np.uint64)]))
        apart = sum(int(x ^ y & ((1 << 64) - 1)).bit_count() for x, y in zip((int(v) & ((1 << 64) - 1) for v in ngram_join.sketch(a)), (int(v) & ((1 << 64) - 1) for v in ngram_join.sketch(b))))
        assert apart <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_dedup(spark, texts, bits):
    """With two bits of hash nearly all chunks share a hash and have to be told apart."""
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[t].append(i)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = exact_dedup.find_duplicates(docs, bits=bits).collect()
    assert len(found) == len(texts)
    for r in found:
        same = groups[texts[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(same), len(same), r.doc_id == max(same), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    assert sorted(r.doc_id for r in exact_dedup.keep_one(docs, bits=bits).collect()) == sorted(max(g) for g in groups.values())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    found = queries.QUERIES[name](spark, SMALL)
    wanted = con.sql(queries.ORACLE_SQL[name]).select(*found.columns)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, wanted.fetchall()))


@pytest.mark.parametrize("query, label, divisor, remainder, least", [("op8_toxicity", "toxic", 3, 1, 0.9), ("op5_quality", "quality", 4, 2, 0.85)])
def test_held_out_accuracy(spark, query, label, divisor, remainder, least):
    rows = {r.doc_id: r for r in queries.QUERIES[query](spark, MIDDLE).collect()}
    assert all(r.held_out == (crc_mod(i, divisor) == remainder) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in rows.items())
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect() if r[label] is not None}
    held = [(rows[i].score, y) for i, y in truth.items() if i in rows and rows[i].held_out]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    area = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    print(query, "area under the curve", area, "rows", len(held))
    assert area >= least


def area(scores, labels):
    good, bad = scores[labels == 1], scores[labels == 0]
    return float(np.mean((good[:, None] > bad) + 0.5 * (good[:, None] == bad)))


def test_toxicity_learns_a_pair(spark):
    """Texts are toxic if two words stand together or if neither is there: each word alone tells nothing. The
    machine tells the texts apart, and without its vectors it does not."""
    rng, rows = np.random.default_rng(1), []
    for k in range(4000):
        a, b = rng.random(2) < 0.5
        words = [f"w{chr(97 + x // 26)}{chr(97 + x % 26)}" for x in rng.integers(0, 400, 20)] + ["foo"] * int(a) + ["bar"] * int(b)
        rows.append((k, " ".join(rng.permutation(words)), int(a == b)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.train(docs, docs)
    truth = np.array([y for k, _, y in rows if crc_mod(k, 3) == 1])

    def held_out_area():
        scores = {r.doc_id: r.score for r in toxicity.score(docs, machine).collect()}
        return area(np.array([scores[k] for k, _, _ in rows if crc_mod(k, 3) == 1]), truth)

    assert held_out_area() > 0.95
    machine.factor = np.zeros_like(machine.factor)
    assert held_out_area() < 0.6


def test_toxicity_scores_by_brute_force(spark, texts):
    """Every pair of a text's terms, summed one by one from the machine's weights and vectors."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    machine = toxicity.train(docs, labels)
    place = {int(b): k for k, b in enumerate(machine.active)}
    terms = toxicity._Terms()
    found = {r.doc_id: r.score for r in toxicity.score(docs, machine).collect()}
    for i, text in sorted(texts.items())[:40]:
        on = [place[int(b)] for b in toxicity.term_buckets(text, terms) if int(b) in place]
        logit = machine.bias + sum(machine.weight[k] for k in on)
        v = machine.factor[on]
        pairs = v @ v.T
        logit += np.triu(pairs, 1).sum()
        assert abs(found[i] - 1 / (1 + np.exp(-np.clip(logit, -30, 30)))) < 1e-6


def test_quality_scores_by_brute_force(spark, texts):
    """The registered scores, made again for each text alone by the net's formula."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    net = quality.train(docs, labels)
    for r in quality.score_quality(docs, labels).collect():
        z = np.clip((quality.features([texts[r.doc_id].encode()])[0] - net.mean) / net.scale, -8, 8)
        logit = sum(w * np.tanh(sum(x * y for x, y in zip(z, net.w1[:, k])) + net.b1[k]) for k, w in enumerate(net.w2)) + net.b2
        assert abs(r.score - 1 / (1 + np.exp(-logit))) < 1e-6


def test_mixing_meets_targets(spark):
    rows = queries.op4_mixing(spark, MIDDLE).collect()
    assert all(r.rate >= 0 and r.copies >= 0 for r in rows)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    assert all(r.n_tokens == len(texts[r.doc_id].encode().split()) for r in rows)
    total = sum(r.n_tokens for r in rows)
    for domain, target in queries.TARGETS.items():
        share = sum(r.n_tokens * r.rate * r.domains[domain] for r in rows) / total
        assert abs(share - target) < 0.02


def test_mixing_agrees_with_brute_force(spark):
    """The gradient steps of the plan, made again in numpy from the posteriors."""
    rows = queries.op4_mixing(spark, SMALL).collect()
    names = sorted(queries.TARGETS)
    p, tokens = np.array([[r.domains[d] for d in names] for r in rows]), np.array([r.n_tokens for r in rows], dtype=float)
    target = np.array([queries.TARGETS[d] for d in names]) / sum(queries.TARGETS.values())
    shares = lambda rate: (tokens * rate) @ p / tokens.sum()
    rate = np.ones(len(rows))
    scale = np.maximum(shares(rate), 1e-3)
    for _ in range(mixing.STEPS):
        rate = np.maximum(0, rate * (1 - mixing.PULL) + mixing.PULL - p @ ((shares(rate) - target) / scale))
    assert np.allclose(rate, [r.rate for r in rows], atol=1e-3)


def drawn(seed, side=160):
    rng = np.random.default_rng(seed)
    out = np.full((side, side), 120.0)
    for _ in range(40):
        x, y = rng.integers(0, side - 20, 2)
        w, h = rng.integers(6, 30, 2)
        out[y : y + h, x : x + w] = rng.integers(0, 256)
    return out


def test_media_finds_crops_and_edits(spark):
    images, group = {}, {}
    for k in range(6):
        whole = drawn(k)
        for n, image in enumerate((whole, whole[20:150, 10:140], whole * 0.8 + 20, np.rot90(whole))):
            images[10 * k + n], group[10 * k + n] = media.encode(image), 10 * k
    images |= {98: b"", 99: None}
    rows = spark.createDataFrame([(i, bytearray(x) if x is not None else None) for i, x in images.items()], "image_id long, image binary")
    found = {r.image_id: r for r in media.find_copies(rows).collect()}
    assert {i: found[i].group_id for i in group} == group
    assert found[98].group_id == 98 and found[99].group_id == 99 and found[99].n_corners == 0


class Article(HTMLParser):
    def __init__(self):
        super().__init__()
        self.inside, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"

    def handle_endtag(self, tag):
        self.inside -= tag == "article"

    def handle_data(self, data):
        self.words += data.split() if self.inside else []


def test_html_article_words(spark):
    """On pages with one plain article element nearly all of its words, and little else, come out."""
    pages = [r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect() if r.html and r.html.count("<article") == 1 and "comment" not in r.html and "<aside" not in r.html]
    found = {r.page_id: r for r in html_extract.extract_text(spark.createDataFrame(pages)).collect()}
    hits = wanted = got = 0
    for page in pages:
        reader = Article()
        reader.feed(page.html)
        words, out = set(reader.words), set(found[page.page_id].text.split())
        hits, wanted, got = hits + len(words & out), wanted + len(words), got + len(out)
        assert found[page.page_id].n_chars == len(found[page.page_id].text)
    print("pages", len(pages), "recall", hits / wanted, "precision", hits / got)
    assert pages and hits / wanted > 0.95 and hits / got > 0.95
