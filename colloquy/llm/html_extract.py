"""Main text of web pages by a recurrent labeller of blocks.

A page is the sequence of its leaf blocks. Each block is read as a vector of its tag path and a
vector of its hashed words, and a bidirectional LSTM classifies every block with the whole page as
context. The labels to learn from come from the landmarks and class names of the pages themselves,
with varied page frames built from the same pages, so that no single mark decides.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import quoted, slices, starts_of
from colloquy.llm.labelled import smallest_hashes

#: Pages that a fit reads at most, and variants that are built of each.
MAX_FIT_PAGES, VARIANTS = 300, 2
#: Share of the variants whose telling marks are taken away.
HIDDEN_SHARE = 0.3
#: Hash buckets of path marks and words, width of their vectors, and of the LSTM each way.
MARKS, WORDS, WIDTH, HIDDEN, NUMBERS = 2048, 4096, 12, 20, 4
#: Blocks that are padded together.
CELLS = 100_000

#: Fixed values of HTML: elements whose content is no text, elements within a line, empty elements,
#: elements that end an open one of the same kind, and what a head holds (anything else ends it).
UNSEEN = frozenset("script style template head title svg iframe textarea select option".split())
MATH = frozenset("math maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics annotation".split())
INLINE = MATH | frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_ITSELF = frozenset("p li dt dd tr td th".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())

#: Landmarks and name parts of what is not the main text, and of what is.
OUTSIDE_TAGS = frozenset("nav footer header aside form menu dialog".split())
OUTSIDE_NAMES = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer form header login masthead menu nav navbar navigation newsletter notice popup promo related reply respond share sidebar signup social sponsor sponsored subscribe toolbar widget".split())
INSIDE_TAGS = frozenset("article main".split())
INSIDE_NAMES = frozenset("article body content entry main post story text".split())

_NAME = re.compile(r"[A-Za-z]+")


class _Blocks(HTMLParser):
    """Collects (marks of the path, text, characters within links) of every leaf block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.path: dict[str, int] = {}  # marks of the open elements, and how often each is there
        self.unseen = self.links = 0
        self.head = -1
        self.parts: list[str] = []
        self.linked = 0
        self.marks: tuple[str, ...] = ()
        self.blocks: list[tuple[tuple[str, ...], str, int]] = []

    def _end_block(self) -> None:
        if text := " ".join("".join(self.parts).split()):
            self.blocks.append((self.marks, text, self.linked))
        self.parts, self.linked = [], 0

    def _end_head(self, body: bool) -> None:
        """Ends an open head whose end tag is left out; body: with all that is open in it."""
        if self.head >= 0 and (body or all(self.open[k][0] in ("title", "noscript") for k in range(self.head + 1, len(self.open)))):
            self._close(self.head)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in IN_HEAD:
            self._end_head(tag == "body")
        if tag == "br":
            self.parts.append(" ")
        if tag not in INLINE:
            self._end_block()
        if tag in EMPTY:
            return
        if tag in ENDS_ITSELF:
            for k in range(len(self.open) - 1, max(-1, len(self.open) - 8), -1):
                if self.open[k][0] == tag:
                    self._close(k)
                    break
                if self.open[k][0] not in INLINE:
                    break
        names = [n.lower() for key, value in attrs if key in ("class", "id", "role") and value for n in _NAME.findall(value)]
        marks = () if tag in INLINE else (f"<{tag}", *(f".{n}" for n in names))
        self.open.append((tag, marks))
        for m in marks:
            self.path[m] = self.path.get(m, 0) + 1
        if tag == "head" and self.head < 0:
            self.head = len(self.open) - 1
        self.unseen += tag in UNSEEN
        self.links += tag == "a"

    def _close(self, k: int) -> None:
        for tag, marks in self.open[k:]:
            self.unseen -= tag in UNSEEN
            self.links -= tag == "a"
            for m in marks:
                self.path[m] -= 1
                if not self.path[m]:
                    del self.path[m]
        del self.open[k:]
        if self.head >= k:
            self.head = -1

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self._end_block()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._close(k)
                return
            if tag in INLINE and self.open[k][0] not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and data.strip():
            self._end_head(False)
        if self.unseen:
            return
        if not self.parts or not any(p.strip() for p in self.parts):
            self.marks = tuple(self.path)
        self.parts.append(data)
        if self.links:
            self.linked += len(data)

    def close(self) -> None:
        super().close()
        self._end_block()


Block = tuple[tuple[str, ...], str, int]


def blocks_of(html: str | None) -> list[Block]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    return parser.blocks


def teacher(blocks: list[Block]) -> np.ndarray:
    """1 for blocks that landmarks and names place in the main text."""
    within = [any(m[1:] in (INSIDE_TAGS if m[0] == "<" else INSIDE_NAMES) for m in marks) for marks, _, _ in blocks]
    outside = [any(m[1:] in (OUTSIDE_TAGS if m[0] == "<" else OUTSIDE_NAMES) for m in marks) for marks, _, _ in blocks]
    framed = any(w and not o for w, o in zip(within, outside, strict=True))
    return np.array([not o and (w or not framed) for w, o in zip(within, outside, strict=True)], dtype=float)


def varied(blocks: list[Block], labels: np.ndarray, rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """The page in another frame: its main text under other landmarks, with menus, notices, side
    columns, forms and comments of the page's own words around it and in it."""
    main = [b for b, y in zip(blocks, labels, strict=True) if y]
    words = [w for _, t, _ in blocks for w in t.split()] or ["text"]
    some = lambda low, high: " ".join(rng.choice(words, rng.integers(low, high)))
    pick = lambda names: str(rng.choice(sorted(names)))
    frame = [("<html", "<body"), ("<html", "<body", "<div"), ("<html", "<body", "<div", ".wrapper", ".page"), ("<html", "<body", "<section")][rng.integers(4)]
    inner = [("<article",), ("<main",), ("<main", "<article"), ("<div", "." + pick(INSIDE_NAMES)), ("<section", "." + pick(INSIDE_NAMES)), ("<div",)][rng.integers(6)]
    leaf = lambda *tags: tags[rng.integers(len(tags))]

    def aside(place: tuple[str, ...]) -> list[Block]:
        out = [("<" + pick(OUTSIDE_TAGS),), (leaf("<div", "<section", "<ul", "<p"), "." + pick(OUTSIDE_NAMES))][int(rng.random() < 0.6)]
        menu = rng.random() < 0.4
        rows = []
        for _ in range(rng.integers(1, 8 if menu else 4)):
            text = some(1, 4) if menu else some(3, 40)
            rows.append(((*place, *out, *(("<ul", "<li") if menu else leaf(("<p",), ("<div",), ("<h3",), ()))), text, len(text) if menu else 0))
        return rows

    page: list[tuple[Block, int]] = []
    for _ in range(rng.integers(0, 4)):
        page += [(b, 0) for b in aside(frame)]
    body: list[tuple[Block, int]] = []
    for marks, text, linked in main:
        own = tuple(m for m in marks if m in ("<p", "<h1", "<h2", "<h3", "<li", "<ul", "<td", "<blockquote", "<pre"))
        if own == ("<p",) and rng.random() < 0.2:
            own = leaf(("<h2",), ("<ul", "<li"), ("<ul", "<li"), ("<ol", "<li"), ("<blockquote",), ("<pre",), ("<table", "<tr", "<td"), ("<div",))
        if rng.random() < 0.15:
            text, linked = text.split()[0], 0
        body.append((((*frame, *inner, *own), text, linked), 1))
    if rng.random() < 0.5 and body:
        at = int(rng.integers(0, len(body) + 1))
        body[at:at] = [(b, 0) for b in aside((*frame, *inner))]
    page += body
    for _ in range(rng.integers(0, 4)):
        page += [(b, 0) for b in aside(frame)]
    return [b for b, _ in page], np.array([y for _, y in page], dtype=float)


def hidden(blocks: list[Block]) -> list[Block]:
    """The page without its landmarks and telling names: what is left to learn from is the place of a block
    among the others, its words, its length and its links."""
    telling = {"<" + t for t in OUTSIDE_TAGS | INSIDE_TAGS} | {"." + n for n in OUTSIDE_NAMES | INSIDE_NAMES}
    return [(tuple(m for m in marks if m not in telling), text, linked) for marks, text, linked in blocks]


def _bucket(token: str, buckets: int) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % buckets


@dataclass
class Encoded:
    """Blocks of several pages as flat lists of buckets with offsets, and numbers."""

    marks: np.ndarray
    mark_at: np.ndarray
    words: np.ndarray
    word_at: np.ndarray
    numbers: np.ndarray


def encode(blocks: list[Block]) -> Encoded:
    marks = [[_bucket(m, MARKS) for m in b[0]] or [0] for b in blocks]
    words = [[_bucket(w, WORDS) for w in b[1].lower().split()] for b in blocks]
    length = np.array([len(b[1]) for b in blocks], dtype=float)
    numbers = np.stack([np.log1p(length) / 8, np.array([b[2] for b in blocks]) / np.maximum(length, 1), np.log1p([len(w) for w in words]) / 6, np.array([b[1][-1] in ".!?" for b in blocks], dtype=float)], axis=1).astype(np.float32)
    flat = lambda rows: np.array([x for r in rows for x in r], dtype=np.int64)
    return Encoded(flat(marks), starts_of(np.array([len(m) for m in marks])), flat(words), starts_of(np.array([len(w) for w in words])), numbers)


def _means(table: np.ndarray, index: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(table[index], at[:-1], axis=0) / np.diff(at)[:, None].astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """Path and word vectors, an LSTM each way, and a linear layer over both."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        width = 2 * WIDTH + NUMBERS
        self.p: dict[str, np.ndarray] = {"marks": rng.normal(0, 0.3, (MARKS, WIDTH)), "words": rng.normal(0, 0.1, (WORDS, WIDTH)), "out": rng.normal(0, 0.3, 2 * HIDDEN), "bias": np.zeros(1)}
        for way in "fb":
            self.p |= {f"{way}x": rng.normal(0, width**-0.5, (width, 4 * HIDDEN)), f"{way}h": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)), f"{way}c": np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def inputs(self, e: Encoded) -> np.ndarray:
        return np.concatenate([_means(self.p["marks"], e.marks, e.mark_at), _means(self.p["words"], e.words, e.word_at), e.numbers], axis=1)

    def _run(self, x: np.ndarray, mask: np.ndarray, way: str) -> tuple[np.ndarray, list]:
        """Hidden states (steps, pages, HIDDEN); where mask is 0 the state stands still."""
        steps, pages, _ = x.shape
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        pre = x @ self.p[way + "x"] + self.p[way + "c"]
        out, kept = np.zeros((steps, pages, HIDDEN), np.float32), []
        for t in range(steps):
            z = pre[t] + h @ self.p[way + "h"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in (0, 1, 2))
            g = np.tanh(z[:, 3 * HIDDEN :])
            on = mask[t][:, None]
            c2 = f * c + i * g
            u = np.tanh(c2)
            kept.append((h, c, i, f, o, g, u))
            c = on * c2 + (1 - on) * c
            h = on * o * u + (1 - on) * h
            out[t] = h
        return out, kept

    def _pull(self, x: np.ndarray, mask: np.ndarray, kept: list, dout: np.ndarray, way: str, grad: dict) -> np.ndarray:
        """Backward through time; adds to grad and returns the slope of x."""
        dz_all = np.zeros((len(kept), x.shape[1], 4 * HIDDEN), np.float32)
        dh, dc = np.zeros(dout.shape[1:], np.float32), np.zeros(dout.shape[1:], np.float32)
        for t in range(len(kept) - 1, -1, -1):
            h, c, i, f, o, g, u = kept[t]
            on = mask[t][:, None]
            dh = dh + dout[t]
            step_h, step_c = on * dh, on * dc
            dc2 = step_c + step_h * o * (1 - u * u)
            dz = np.concatenate([dc2 * g * i * (1 - i), dc2 * c * f * (1 - f), step_h * u * o * (1 - o), dc2 * i * (1 - g * g)], axis=1)
            dz_all[t] = dz
            grad[way + "h"] += h.T @ dz
            dh = (1 - on) * dh + dz @ self.p[way + "h"].T
            dc = (1 - on) * dc + dc2 * f
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        grad[way + "x"] += x.reshape(-1, x.shape[2]).T @ flat
        grad[way + "c"] += flat.sum(0)
        return dz_all @ self.p[way + "x"].T

    @staticmethod
    def padded(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """(steps, pages, width), the mask, and where each block went."""
        n = np.diff(at)
        page = np.repeat(np.arange(len(n)), n)
        step = np.arange(at[-1]) - at[page]
        out, mask = np.zeros((n.max(initial=0), len(n), x.shape[1]), np.float32), np.zeros((n.max(initial=0), len(n)), np.float32)
        out[step, page], mask[step, page] = x, 1
        return out, mask, (step, page)

    def logits(self, e: Encoded, at: np.ndarray) -> np.ndarray:
        x, mask, place = self.padded(self.inputs(e), at)
        forward, _ = self._run(x, mask, "f")
        back, _ = self._run(x[::-1], mask[::-1], "b")
        return (forward @ self.p["out"][:HIDDEN] + back[::-1] @ self.p["out"][HIDDEN:])[place] + self.p["bias"][0]

    def gradient(self, e: Encoded, at: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Slope of the mean logistic loss over the blocks."""
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        x, mask, place = self.padded(self.inputs(e), at)
        forward, kept_f = self._run(x, mask, "f")
        back, kept_b = self._run(x[::-1], mask[::-1], "b")
        states = np.concatenate([forward, back[::-1]], axis=2)
        error = np.zeros(mask.shape, np.float32)
        error[place] = (_sigmoid(states[place] @ self.p["out"] + self.p["bias"][0]) - labels) / len(labels)
        grad["out"], grad["bias"] = np.einsum("tp,tph->h", error, states), np.array([error.sum()])
        dstates = error[:, :, None] * self.p["out"]
        dx = self._pull(x, mask, kept_f, dstates[:, :, :HIDDEN], "f", grad)
        dx += self._pull(x[::-1], mask[::-1], kept_b, dstates[::-1, :, HIDDEN:], "b", grad)[::-1]
        dx = dx[place]
        for name, index, starts, columns in (("marks", e.marks, e.mark_at, slice(0, WIDTH)), ("words", e.words, e.word_at, slice(WIDTH, 2 * WIDTH))):
            n = np.diff(starts)
            np.add.at(grad[name], index, np.repeat(dx[:, columns] / n[:, None].astype(np.float32), n, axis=0))
        return grad

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """True for the blocks of the main text, page by page. Pages of like length are padded
        together, as many as CELLS allows."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        while order:
            group = order[: max(1, CELLS // len(pages[order[min(len(order), 64) - 1]]))][:64]
            order = order[len(group) :]
            at = starts_of(np.array([len(pages[k]) for k in group]))
            z = self.logits(encode([b for k in group for b in pages[k]]), at) > 0
            for k, a, b in zip(group, at[:-1], at[1:], strict=True):
                out[k] = z[a:b]
        return out


def fit_labeller(pages: list[list[Block]], epochs: int = 8, rate: float = 0.01, seed: int = 11) -> BlockLabeller:
    """Adam on batches of pages (twice) and their variants; single words move slowly, as they tell
    little of a block's place. Without pages the labeller keeps nothing."""
    model, rng = BlockLabeller(seed), np.random.default_rng(seed)
    data = []
    for blocks in pages:
        if blocks:
            labels = teacher(blocks)
            data += [(blocks, labels), (hidden(blocks), labels)]
            data += [(hidden(v[0]) if rng.random() < HIDDEN_SHARE else v[0], v[1]) for v in (varied(blocks, labels, rng) for _ in range(VARIANTS)) if v[0]]
    if not data:
        model.p["out"][:], model.p["bias"][:] = 0, -1
        return model
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for _ in range(epochs):
        near = np.argsort([len(b) * rng.uniform(0.8, 1.25) for b, _ in data])  # pages of like length need little padding
        batches = np.array_split(near, max(1, len(data) // 24))
        for batch in (batches[k] for k in rng.permutation(len(batches))):
            at = starts_of(np.array([len(data[k][0]) for k in batch]))
            grad = model.gradient(encode([b for k in batch for b in data[k][0]]), at, np.concatenate([data[k][1] for k in batch]))
            step += 1
            rate_now = rate * max(0.1, 1 - step / (epochs * len(batches)))
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.p[k] = model.p[k] - np.float32(rate_now * (0.05 if k == "words" else 1)) * (first[k] / np.float32(1 - 0.9**step)) / (np.sqrt(second[k] / np.float32(1 - 0.999**step)) + np.float32(1e-7))
    return model


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_pages: int = MAX_FIT_PAGES) -> BlockLabeller:
    """Fits on at most max_pages pages, those with the smallest hashes of their ids; null ids are left out.

    The ids are chosen first; their pages are read and the labeller is fitted in one task, as the sample
    is bounded, and only its weights come to the driver.
    """
    rows = pages.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(html_col)).alias("html"))
    known = rows.where("id IS NOT NULL").select("id").distinct()
    ids = pages.sparkSession.createDataFrame(smallest_hashes(known, "id", max_pages).collect(), f"id {dict(rows.dtypes)['id']}")
    sample = rows.join(F.broadcast(ids), "id").dropDuplicates(["id"]).repartition(1)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(i, blocks_of(h)) for batch in slices(batches) for i, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        model = fit_labeller([blocks for _, blocks in sorted(found, key=lambda f: f[0])])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model.p)], pa.binary())], names=["weights"])

    weights = sample.mapInArrow(fitted, "weights binary").collect()
    model = fit_labeller([])
    if weights:
        model.p = pickle.loads(bytes(weights[0][0]))
    return model


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",), max_pages: int = MAX_FIT_PAGES) -> DataFrame:
    """id, keep's columns, text and n_chars (code points) for every page.

    Blocks are joined in page order by one line feed; white space within a block is one space. Null
    and empty pages, and pages without main text, have an empty text. Very long pages are labelled
    whole; repeated rows are treated one by one; further columns of the input are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(train(pages, id_col, html_col, max_pages))
    names = [id_col, *keep]
    chosen = pages.select(*[F.col(quoted(c)) for c in names], F.col(quoted(html_col)))
    kinds = dict(chosen.dtypes)
    schema = ", ".join(f"{quoted(c)} {kinds[c]}" for c in names) + ", text string, n_chars long"

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [blocks_of(h) for h in batch.column(len(names)).to_pylist()]
            texts = ["\n".join(b[1] for b, y in zip(blocks, marks, strict=True) if y) for blocks, marks in zip(found, shared.value.label(found), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return chosen.mapInArrow(extracted, schema)
