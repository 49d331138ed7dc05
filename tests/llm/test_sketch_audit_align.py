"""SetSketch near copies, source audit and token alignment against brute force, and their odd rows."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from test_exact_results import SMALL, linked_groups
from test_odd_rows import LONG, ROWS, SCHEMA, by_id
from tokenizers import Tokenizer

from colloquy.llm import bpe, queries, setsketch, source_audit, token_alignment

VOCABULARIES = queries.vocabulary_path(), queries.vocabulary_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def sets_of(sizes, times, seed=1):
    rng = np.random.default_rng(seed)
    for n, more in sizes:
        for _ in range(times):
            s = rng.integers(0, 2**63, n + more).astype(np.uint64)
            yield s[:n], s


def test_registers_agree_as_sets_do():
    for n, more in ((4, 1), (20, 5), (400, 100), (3000, 3000)):
        alike, bands = [], []
        for few, many in sets_of([(n, more)], 300):
            x, y = setsketch.registers(few), setsketch.registers(many)
            alike.append((x == y).mean())
            bands.append((setsketch.band_keys(x) == setsketch.band_keys(y)).sum())
        share = n / (n + more)
        assert abs(np.mean(alike) - share) < 0.01
        assert abs(np.std(alike) - np.sqrt(share * (1 - share) / setsketch.REGISTERS)) < 0.006  # registers are independent
        assert abs(np.mean(bands) - setsketch.BANDS * share**setsketch.BAND) < 0.7


def test_registers_merge_and_do_not_depend_on_order():
    for few, many in sets_of([(1, 3), (30, 60), (2000, 5000)], 5):
        rest = many[len(few) :]
        assert (setsketch.registers(many[::-1]) == setsketch.registers(many)).all()
        assert (setsketch.merged(setsketch.registers(few), setsketch.registers(rest)) == setsketch.registers(many)).all()
    assert not setsketch.registers(np.zeros(0, dtype=np.uint64)).any()


def test_short_forms_spare_links_and_rule_out_others():
    def unequal(share, n=600):
        out, both = [], round(2 * n * share / (1 + share))
        for _, s in sets_of([(1, 2 * n - both - 1)], 200, seed=8):
            x, y = (setsketch.short_form(setsketch.registers(part)).view(np.uint64) for part in (s[:n], s[n - both :]))
            bits = x ^ y
            out.append(int(np.bitwise_count((bits | bits >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum()))
        return np.array(out)

    for share in (0.8, 0.9):
        found = unequal(share)
        assert (found <= setsketch.MOST_UNEQUAL).all()
        assert abs(found.mean() - setsketch.REGISTERS * 0.75 * (1 - share)) < 1.5
    assert (unequal(0.4) > setsketch.MOST_UNEQUAL).all()


def test_likelihood_estimates_and_spares_links():
    for share in (0.2, 0.5, 0.8, 0.95):
        rng, found, kept = np.random.default_rng(3), [], []
        n = 1000
        both = round(2 * n * share / (1 + share))
        for _ in range(60):
            s = rng.integers(0, 2**63, 2 * n - both).astype(np.uint64)
            x, y = setsketch.registers(s[:n]), setsketch.registers(s[n - both :])
            sides = np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([float(n)]), np.array([float(n)])
            found.append(setsketch.estimate(*sides)[0])
            kept.append(setsketch.likely(*sides, 80)[0])
        assert abs(np.mean(found) - both / (2 * n - both)) < 0.02
        assert all(kept) if share >= 0.8 else not any(kept)


def test_setsketch_query(spark, texts):
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op11_setsketch(spark, SMALL).collect()}
    assert found == {i: (n, c, c == i) for i, (n, c) in linked_groups(texts, 4, 80).items()}


@pytest.mark.parametrize("words, n", [(5, 60), (4, 30), (4, 9)])
def test_setsketch_near_the_limit(spark, words, n):
    rng = np.random.default_rng(n)
    base = [f"w{k}" for k in rng.integers(0, 5000, n)]
    made = {}
    for i in range(90):
        text = list(base if i < 60 or i % 2 else made[i - 30].split(" "))
        for at in rng.integers(0, len(text), int(rng.integers(0, 4))):
            text[at] = f"e{rng.integers(0, 40)}"
        made[i] = " ".join(text[: len(text) - int(rng.integers(0, 5))])
    made |= {200: "", 201: "A b", 202: "a  B", 203: "\t", 204: made[5].upper(), 205: LONG, 206: LONG + " end"}
    docs = spark.createDataFrame([(i, t) for i, t in made.items()], "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in setsketch.near_copies(docs, words=words, percent=80).collect()}
    assert found == linked_groups(made, words, 80)
    kept = {r.doc_id for r in setsketch.keep_one(docs, words=words, percent=80).collect()}
    assert kept == {c for _, c in found.values()}


def test_setsketch_odd_rows(spark, odd):
    found = setsketch.near_copies(odd)
    assert by_id(found, "component_id") == sorted([(1, 1), (1, 1), (6, 1), (2, 2), (3, 3), (7, 7), (4, 4), (5, 4), (None, None), (None, None)], key=str)
    kept = setsketch.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == 8
    assert setsketch.near_copies(odd.limit(0)).count() == 0 and setsketch.keep_one(odd.limit(0)).count() == 0
    assert setsketch.near_copies(odd.withColumnRenamed("text", "t.x"), text_col="t.x").count() == len(ROWS)
    with pytest.raises(ValueError):
        setsketch.near_copies(odd, percent=70)


def audit(rows, least, top):
    """The audit in plain whole numbers."""
    terms_of = lambda t: [x for x in "".join(c.lower() if "A" <= c <= "Z" else c if c.isascii() and c.isalpha() or not c.isascii() else " " for c in t or "").split(" ") if x]
    counts, df, groups = Counter(), Counter(), defaultdict(set)
    for lang, source, text in rows:
        lang, source, terms = lang or "", source or "", terms_of(text)
        groups[lang].add(source)
        counts.update((lang, source, t) for t in terms)
        df.update((lang, t) for t in set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for (g, t), n in df.items() if g == lang and n >= least]
        share = lambda part: {t: 1 + 1_000_000_000 * (sum(counts[lang, s, t] for s in part) + 5) // (sum(counts[lang, s, k] for s in part for k in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share([s]) for s in sources}, share(sources)
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            over = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s, t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", over)):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


def test_audit_by_brute_force(spark):
    rng = np.random.default_rng(2)
    words = ["Abc", "abc", "déjà", "DÉJÀ", "x", "日本", "q1w", "semi;colon", "🙂", "zz"]
    rows = [(str(rng.choice(["de", "en", ""])) or None, f"s{rng.integers(0, 4)}" if k % 9 else None, " ".join(rng.choice(words[: 3 + k % 8], 1 + k % 7))) for k in range(120)]
    rows += [("fr", "only", None), ("fr", "other", ""), ("fr", "third", "1 2"), ("en", "dumb", "!!"), ("one", "s", "abc"), rows[3], rows[3]]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, term string, n int")
    for least, top in ((5, 3), (1, 50), (10_000, 50)):
        assert sorted(map(tuple, source_audit.divergence(docs, least=least, top=top).collect())) == audit(rows, least, top)
    assert source_audit.divergence(docs.limit(0)).count() == 0
    named = docs.select("lang", "source", docs["text"].alias("t.x"))
    assert source_audit.divergence(named, text_col="t.x", least=5).count() == source_audit.divergence(docs, least=5).count()


def test_audit_counts_each_piece_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    bits = ["Abc", "aBC", "ß", "É", "日", "🙂", "@", "[", "`", "{", "\x7f", "\0", " ", "\n", "z", "Z", "9"]
    rows = [(str(rng.choice(["de", "en", ""])), f"s{rng.integers(0, 3)}", "".join(rng.choice(bits, rng.integers(0, 12)))) for _ in range(400)]
    rows += [("en", "s0", ""), ("en", "s0", "tail"), ("en", "s0", "head"), ("en", "s1", "the " * 5000), ("no", "s9", "")]
    terms_of = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t))
    want, held = Counter(), Counter()
    for lang, source, text in rows:
        want.update((lang, source, t) for t in terms_of(text))
        held.update((lang, source, t) for t in set(terms_of(text)))
    want = sorted((*k, n, held[k]) for k, n in want.items())
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(("x", "x", "left out"), *rows)], ["lang", "source", "text"]).slice(1)
    once = [tuple(r.values()) for b in source_audit._counted([batch.slice(0, 0), batch]) for r in b.to_pylist()]
    assert sorted(once) == want  # a row for each term of a group, however often it is said
    for piece_bytes, piece_rows, out_rows in ((1, 9, 3), (40, 1000, 2), (1000, 7, 1000)):
        monkeypatch.setattr(source_audit, "PIECE_BYTES", piece_bytes)
        monkeypatch.setattr(source_audit, "PIECE_ROWS", piece_rows)
        monkeypatch.setattr(source_audit, "OUT_ROWS", out_rows)
        n, df = Counter(), Counter()
        for b in source_audit._counted([batch]):
            assert 0 < b.num_rows <= out_rows
            for *k, x, y in (r.values() for r in b.to_pylist()):
                n[tuple(k)] += x
                df[tuple(k)] += y
        assert sorted((*k, x, df[k]) for k, x in n.items()) == want
    monkeypatch.undo()
    counts = source_audit.term_counts(spark.createDataFrame(rows, "lang string, source string, text string"))
    assert sorted(map(tuple, counts.select("lang", "source", "term", "n", "df").collect())) == want
    assert "Generate" not in counts._jdf.queryExecution().executedPlan().toString()  # no row for each occurrence
    broken = spark.sql("SELECT 'en' AS lang, 's' AS source, CAST(X'61FF4220C3' AS STRING) AS text")
    assert sorted(map(tuple, source_audit.term_counts(broken).collect())) == [("en", "s", "a\ufffdb", 1, 1), ("en", "s", "\ufffd", 1, 1)]


def test_audit_shares_beyond_64_bits(spark):
    row = spark.createDataFrame([(30_000_000_000_000, 70_000_000_000_001, 1000)], "n long, total long, terms long")
    want = 1 + 1_000_000_000 * (30_000_000_000_000 + 5) // (70_000_000_000_001 + 5000)
    assert row.select(source_audit._share(row["n"], row["total"], row["terms"])).first()[0] == want


def test_audit_is_the_sqls(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
    want = con.sql(queries.ORACLE_SQL["op12_source_audit"]).fetchall()
    assert sorted(map(tuple, queries.op12_source_audit(spark, SMALL).collect())) == sorted(want)


def aligned(docs):
    """Rows of the contract from the libraries' own tokens, and the groups as text."""
    library, model = Tokenizer.from_file(VOCABULARIES[0]), sentencepiece.SentencePieceProcessor(model_file=VOCABULARIES[1])
    library.encode_special_tokens = True
    library.no_truncation()
    library.no_padding()
    raw = bpe.encoder_at(VOCABULARIES[0]).bytes_of
    made = {}
    for i, text in docs.items():
        a, b = library.encode(" " + (text or ""), add_special_tokens=False).ids, model.encode(text or "")
        pieces = [bytes.fromhex(p[3:5]) if model.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, model.id_to_piece(k)) for k in b)]
        if not text or b"".join(raw[k] for k in a) != f" {text}".encode() or b"".join(pieces) != f" {text}".encode():
            a = b = pieces = []
        ends = [list(np.cumsum([len(x) for x in side])) for side in ([raw[k] for k in a], pieces)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        inside = lambda ids, at, lo, hi: [k for k, e in zip(ids, at, strict=True) if lo < e <= hi]
        groups = [(inside(a, ends[0], lo, hi), inside(b, ends[1], lo, hi)) for lo, hi in zip([0, *cuts], cuts, strict=False)]
        made[i] = (a, b, groups, [(x[-1], y[-1]) for x, y in groups])
    count = Counter(p for *_, links in made.values() for p in links)
    most_a, most_b = Counter(), Counter()
    for (a, b), n in count.items():
        most_a[a], most_b[b] = max(most_a[a], n), max(most_b[b], n)
    out = {}
    for i, (a, b, groups, links) in made.items():
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out[i] = (len(a), len(b), len(groups), len(links), sum(count[p] == most_b[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else "", sum(count[p] == most_a[p[0]] for p in links), text)
    return out, {(a, b): (n, n == most_a[a], n == most_b[b]) for (a, b), n in count.items()}


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_best_a"]


def test_alignment_query(spark, texts):
    want, _ = aligned({i: t for i, t in texts.items() if len(t) < 4000})
    short = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 4000 OR text IS NULL")
    found = token_alignment.align_documents(short, *VOCABULARIES, with_groups=False)
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in found.collect()} == {i: w[:-1] for i, w in want.items()}
    whole = queries.op13_token_alignment(spark, SMALL).collect()
    assert {r.doc_id for r in whole} == set(texts) and all(r.n_groups == r.n_links for r in whole)


def test_alignment_hard_texts_and_blocks(spark, monkeypatch):
    docs = dict(enumerate(["plain words", "naïve 日本語 🙂🙂", "<|endoftext|> and </s> <0x41>", "a▁b", "  two  spaces ", "tab\tand\nline\r\n", "\u0000‍", "ﬁ ligature", "é combining", "x" * 700, "1234567890 !!!???", None, "", " ", "plain words", "don't we'll"]))
    want, pairs = aligned(docs)
    rows = spark.createDataFrame([(i, t, 1, "s") for i, t in docs.items()], "doc_id long, text string, slot int, pair string")
    found = {r.doc_id: tuple(r[c] for c in [*COLUMNS, "groups"]) for r in token_alignment.align_documents(rows, *VOCABULARIES).collect()}
    assert found == want
    counted = token_alignment.pair_counts(rows, *VOCABULARIES).collect()
    assert {(r.a_id, r.b_id): (r["count"], r.best_of_a, r.best_of_b) for r in counted} == pairs
    # blocks of a few documents each, whose numbers of pairs differ
    laid = token_alignment._Block(7)
    for i, held in enumerate([[5, 5, 9], [], [9, 2]]):
        laid.add((i, 1, 1, 1, len(held), "d", None), np.array(held, dtype=np.int64))
    import pyarrow as pa

    rows = laid.batch(pa.int64(), False).to_pylist()
    assert [r["7"] for r in rows] == [[1, 2], [], [0, 2], None] and [r["8"] for r in rows] == [[2, 1], [], [1, 1], None]
    assert rows[-1]["9"] == [2, 5, 9] and rows[-1]["10"] == [1, 2, 2]


def test_stretches_give_what_whole_texts_give(texts):
    aligner, rng = token_alignment.Aligner(*VOCABULARIES), np.random.default_rng(5)
    signs = np.array(list(" \n\t  　\x1c\x85é▁aA1'.s!\u200d日ﬁ\u0301𝔘 "))
    drawn = ["".join(rng.choice(signs, rng.integers(1, 25))) for _ in range(5000)]
    for text in [*list(texts.values())[:60], *drawn, *drawn[:50], "a " * 300, "x </s> y"]:
        if text:
            *found, pairs = aligner.aligned(text)
            *want, links = next(aligner._laid_out([f" {text}"]))
            assert (found, list(pairs)) == (want, list(links))


def test_alignment_odd_rows(spark, odd):
    found = token_alignment.align_documents(odd, *VOCABULARIES)
    rows = found.collect()
    assert len(rows) == len(ROWS) and found.where("groups_sha256 = ''").count() == 3
    assert all(r.n_best <= r.n_links for r in rows)
    assert token_alignment.align_documents(odd.limit(0), *VOCABULARIES).count() == 0
    assert token_alignment.align_documents(odd.where("text IS NULL"), *VOCABULARIES).count() == 2
    assert token_alignment.align_documents(odd.withColumnRenamed("text", "t.x").withColumnRenamed("doc_id", "d"), *VOCABULARIES, id_col="d", text_col="t.x").columns[0] == "d"
