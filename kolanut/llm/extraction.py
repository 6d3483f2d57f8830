"""Main text of web pages by a recurrent block labeller.

A page is the sequence of its leaf blocks: runs of text between block-level tags, each with the path of the elements around it. A
bidirectional LSTM in numpy reads one vector per block (hashed tag path, hashed words, lengths and link share) and labels
every block with the whole page as context; blocks labelled as main text are joined.

The model is fitted on a bounded sample of pages. What their own semantic elements say (article, main, nav, footer, ...) gives
the labels of the page as it is, and of the same texts dressed anew: put into containers of other names, in other orders, with notices,
forms, sidebars and reader comments around and between them, so that names, words and neighbours all have to be read.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that the model is fitted on, and the largest of them in letters.
SAMPLE, SAMPLE_CHARS = 240, 1 << 16
DRESSED = 3
PATH_BUCKETS, WORD_BUCKETS, SCALARS = 192, 64, 8
WIDTH = PATH_BUCKETS + WORD_BUCKETS + SCALARS
HIDDEN = 16
EPOCHS, STEP_PAGES, RATE = 8, 16, 0.01
#: Blocks that are labelled together; pages are never split.
TOGETHER = 8192
MAX_WORDS = 200_000

# Fixed values of the markup language.
_RAW = frozenset("script style noscript template textarea iframe title xmp noembed noframes select svg math object".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre search section table ul".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table article section div body".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[a-z]+")

# Names that pages give to their parts.
MAIN_NAMES = ("<article>", "<main>", '<div class="content">', '<div id="main">', '<div class="post">', '<section class="entry-content">',
              '<div class="article-body">', '<div class="story">', '<div class="post-text">', '<div role="main">', '<div id="content">', "<div>")
OTHER_NAMES = {
    "menu": ("<nav>", '<div class="menu">', '<ul class="nav">', '<div id="navigation">', '<div class="breadcrumb">', '<div role="navigation">', "<div>"),
    "header": ("<header>", '<div class="header">', '<div id="masthead">', '<div class="top-bar">', '<div class="site-header">'),
    "footer": ("<footer>", '<div class="footer">', '<div id="footer">', '<div class="site-footer">', '<div class="copyright">', "<div>"),
    "sidebar": ("<aside>", '<div class="sidebar">', '<div id="sidebar">', '<div class="widget">', '<div class="related">', '<section class="recommended">'),
    "notice": ('<div class="notice">', '<div class="cookie-banner">', '<div id="consent">', '<div class="alert">', '<div class="popup">',
               '<div class="subscribe">', '<div class="newsletter">'),
    "advert": ('<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="advertisement">', '<div class="sponsored">',
               '<div id="banner-ad">', '<div class="promo">', '<aside class="ad">'),
    "form": ("<form>", '<form class="search">', '<form id="login">', '<form class="contact">'),
    "comments": ('<div class="comments">', '<section id="comments">', '<div class="comment">', '<ol class="comment-list">', '<section class="comments">',
                 '<div id="disqus">', '<div class="replies">', '<section class="responses">', '<aside class="comments">'),
}
MAIN_TAGS = frozenset(("article", "main"))
OTHER_TAGS = frozenset(("nav", "header", "footer", "aside", "form"))
#: Name parts that say what a container holds.
OTHER_PARTS = frozenset(p for kind, names in OTHER_NAMES.items() for name in names for p in _PARTS.findall(" ".join(sum(_NAMED.findall(name), ())))
                        if p not in ("site", "top", "bar", "list", "role", "search", "contact", "login"))


class Block(NamedTuple):
    path: tuple[str, ...]
    text: str
    linked: int


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order: character references decoded, white space turned into single blanks, trimmed."""
    out: list[Block] = []
    stack: list[str] = []
    names: list[str] = []
    held: list[str] = []
    linked, in_link, where = 0, 0, ()

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append(Block(where, text, min(linked, len(text))))
            held.clear()
        linked = 0

    def text_of(raw: str) -> None:
        nonlocal linked, where
        if raw:
            told = html.unescape(raw)
            if not held:
                if told.isspace():
                    return
                where = tuple(names)
            held.append(told)
            if in_link:
                linked += len(told)

    def close(to: int) -> None:
        nonlocal in_link
        in_link -= stack[to:].count("a")
        del stack[to:], names[to:]

    at = 0
    while found := _TAG.search(page, at):
        text_of(page[at:found.start()])
        at = found.end()
        end, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag not in _INLINE:
            flush()
        elif tag == "br" and held:
            held.append(" ")
        if end:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k] == tag:
                    close(k)
                    break
                if tag in _INLINE and stack[k] not in _INLINE:
                    break
            continue
        if tag in _RAW:
            if not attributes.endswith("/"):
                stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else len(page)
            continue
        if tag in _CLOSES_P or tag in _SAME:
            wanted = {"p"} if tag in _CLOSES_P else _SAME[tag]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k] in wanted:
                    close(k)
                    if tag != "tr":
                        break
                elif stack[k] in _SCOPES or stack[k] not in _INLINE and tag in _CLOSES_P:
                    break
        if tag in _VOID:
            continue
        stack.append(tag)
        in_link += tag == "a"
        parts = [p for found_names in _NAMED.findall(attributes) for p in _PARTS.findall("".join(found_names).lower())] if attributes else []
        names.append(" ".join((tag, *parts)))
    text_of(page[at:])
    flush()
    return out


def told_by_names(path: tuple[str, ...]) -> int | None:
    """What the names around a block say: 1 main text, 0 something else, None nothing. The innermost name decides."""
    for name in reversed(path):
        tag, *parts = name.split()
        if tag in OTHER_TAGS or OTHER_PARTS.intersection(parts):
            return 0
        if tag in MAIN_TAGS:
            return 1
    return None


class Features:
    """Vectors of blocks; buckets of paths and words are remembered up to a bound."""

    def __init__(self) -> None:
        self.paths: dict[tuple, np.ndarray] = {}
        self.words: dict[str, int] = {}

    def _path(self, path: tuple[str, ...]) -> np.ndarray:
        known = self.paths.get(path)
        if known is None:
            if len(self.paths) > MAX_WORDS:
                self.paths.clear()
            told = {f"leaf {path[-1].split()[0]}"} if path else set()
            for name in path:
                tag, *parts = name.split()
                told |= {tag, *(f".{p}" for p in parts)}
            known = self.paths[path] = np.array(sorted({zlib.crc32(t.encode()) % PATH_BUCKETS for t in told}), dtype=np.int64)
        return known

    def _word(self, word: str) -> int:
        if len(self.words) > MAX_WORDS:
            self.words.clear()
        bucket = zlib.crc32(word.encode()) % WORD_BUCKETS
        if len(word) <= 64:
            self.words[word] = bucket
        return bucket

    def rows(self, page: list[Block]) -> np.ndarray:
        out = np.zeros((len(page), WIDTH), dtype=np.float32)
        known = self.words
        for k, block in enumerate(page):
            out[k, self._path(block.path)] = 1
            words = block.text.lower().split()
            buckets = [known[w] if w in known else self._word(w) for w in words]
            counts = np.bincount(buckets, minlength=WORD_BUCKETS)
            out[k, PATH_BUCKETS:PATH_BUCKETS + WORD_BUCKETS] = counts / np.sqrt(counts @ counts)
            size = len(block.text)
            stops = sum(map(block.text.count, ".,;:!?"))
            out[k, -SCALARS:] = (np.log1p(size) / 8, min(len(words), 50) / 50, block.linked / size, min(1, 10 * stops / size),
                                 block.text[-1] in ".!?…:", k / len(page), (len(page) - 1 - k) / len(page), k == 0)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Labeller:
    """A bidirectional LSTM and a logistic output over its states."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, seed: int = 7) -> Labeller:
        rng = np.random.default_rng(seed)
        w = {"out": rng.normal(0, 0.2, (2 * HIDDEN, 1)), "bias": np.zeros(1)}
        for side in "fb":
            w[f"x{side}"] = rng.normal(0, 0.1, (WIDTH, 4 * HIDDEN))
            w[f"h{side}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            w[f"b{side}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def _states(self, gates: np.ndarray, sizes: np.ndarray, side: str, kept: list | None = None) -> np.ndarray:
        """States over pages (longest first) from their gate inputs, (time, page, 4 hidden); each step reads the pages it still has."""
        out = np.zeros((*gates.shape[:2], HIDDEN), dtype=gates.dtype)
        h = c = np.zeros((gates.shape[1], HIDDEN), dtype=gates.dtype)
        live = np.searchsorted(-sizes, -np.arange(1, len(gates) + 1), side="right")
        for t, n in enumerate(live):
            z = gates[t, :n] + h[:n] @ self.w[f"h{side}"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN:])
            before_h, before_c = h[:n], c[:n]
            c = f * before_c + i * g
            told = np.tanh(c)
            h = out[t, :n] = o * told
            if kept is not None:
                kept.append((i, f, o, g, told, before_h, before_c))
        return out

    @staticmethod
    def _turned(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Each page's steps from its last to its first; the padding behind stays."""
        out = np.zeros_like(x)
        for k, n in enumerate(sizes):
            out[:n, k] = x[:n, k][::-1]
        return out

    @staticmethod
    def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(p) for p in pages])
        x = np.zeros((sizes.max(), len(pages), pages[0].shape[1]), dtype=pages[0].dtype)
        for k, page in enumerate(pages):
            x[:len(page), k] = page
        return x, sizes

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """The probability of main text of every block of every page."""
        order = sorted((k for k, page in enumerate(pages) if len(page)), key=lambda k: -len(pages[k]))
        out = [np.zeros(0, dtype=np.float32) for _ in pages]
        while order:
            group = order[:max(1, TOGETHER // len(pages[order[0]]))]
            order = order[len(group):]
            own = [pages[k] for k in group]
            total = self.w["bias"][0]
            for side, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
                gates, sizes = self.padded([(p if side == "f" else p[::-1]) @ self.w[f"x{side}"] + self.w[f"b{side}"] for p in own])
                told = self._states(gates, sizes, side) @ self.w["out"][part]
                total = total + (told if side == "f" else self._turned(told, sizes))
            for at, k in enumerate(group):
                out[k] = _sigmoid(total[:len(pages[k]), at, 0])
        return out

    def gradients(self, x: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the blocks with a label (0 or 1; others are -1), and its gradients by backpropagation through time."""
        sides, states = {}, []
        for side in "fb":
            own = x if side == "f" else self._turned(x, sizes)
            kept: list = []
            h = self._states(own @ self.w[f"x{side}"] + self.w[f"b{side}"], sizes, side, kept)
            sides[side] = own, kept
            states.append(h if side == "f" else self._turned(h, sizes))
        h = np.concatenate(states, axis=2)
        p = _sigmoid(h @ self.w["out"] + self.w["bias"])[..., 0]
        mask = (labels >= 0) & (np.arange(len(x))[:, None] < sizes)
        n = max(1, mask.sum())
        loss = -np.log(np.where(labels == 1, p, 1 - p)[mask] + 1e-12).sum() / n
        wrong = (np.where(mask, p - labels, 0) / n)[..., None].astype(x.dtype)
        grads = {"out": np.einsum("tbh,tbo->ho", h, wrong), "bias": wrong.sum(axis=(0, 1))}
        back = wrong @ self.w["out"].T
        for side, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            own, kept = sides[side]
            above = back[..., part] if side == "f" else self._turned(back[..., part], sizes)
            dz = np.zeros((*x.shape[:2], 4 * HIDDEN), dtype=x.dtype)
            dh, dc = np.zeros((x.shape[1], HIDDEN), dtype=x.dtype), np.zeros((x.shape[1], HIDDEN), dtype=x.dtype)
            recurrent = np.zeros_like(self.w[f"h{side}"])
            for t in range(len(kept) - 1, -1, -1):
                i, f, o, g, told, before_h, before_c = kept[t]
                m = len(i)
                now = above[t, :m] + dh[:m]
                cell = dc[:m] + now * o * (1 - told ** 2)
                dz[t, :m] = np.concatenate([cell * g * i * (1 - i), cell * before_c * f * (1 - f), now * told * o * (1 - o), cell * i * (1 - g ** 2)], axis=1)
                recurrent += before_h.T @ dz[t, :m]
                dh[:m], dc[:m] = dz[t, :m] @ self.w[f"h{side}"].T, cell * f
            grads |= {f"h{side}": recurrent, f"x{side}": np.einsum("tbw,tbz->wz", own, dz, optimize=True), f"b{side}": dz.sum(axis=(0, 1))}
        return float(loss), grads

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, seed: int = 7) -> None:
        """Adam over batches of pages of similar length."""
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.w.items()}
        square = {k: np.zeros_like(v) for k, v in self.w.items()}
        order = sorted(range(len(pages)), key=lambda k: -len(pages[k]))
        groups = [order[i:i + STEP_PAGES] for i in range(0, len(order), STEP_PAGES)]
        step = 0
        for epoch in range(epochs):
            for k in rng.permutation(len(groups)):
                step += 1
                x, sizes = self.padded([pages[i] for i in groups[k]])
                y, _ = self.padded([labels[i][:, None] for i in groups[k]])
                _, grads = self.gradients(x, sizes, y[..., 0])
                rate = RATE * (1 - epoch / epochs) * (1 - 0.999 ** step) ** 0.5 / (1 - 0.9 ** step)
                for name, g in grads.items():
                    g = np.clip(g, -1, 1)
                    mean[name] = 0.9 * mean[name] + 0.1 * g
                    square[name] = 0.999 * square[name] + 0.001 * g * g
                    self.w[name] = (self.w[name] - rate * mean[name] / (np.sqrt(square[name]) + 1e-8)).astype(np.float32)


def _closing(opened: str) -> str:
    return f"</{opened[1:].split()[0].rstrip('>')}>"


def dressed(main: list[str], other: list[str], foreign: list[str], rng: random.Random) -> tuple[str, list[int]]:
    """A page that holds ``main`` as its article, and the labels of its blocks. ``other`` are texts of menus and footers,
    ``foreign`` paragraphs of other pages, used as reader comments, notices and teasers."""
    labels: list[int] = []

    def put(texts: list[str], label: int, wrap: str = "p") -> str:
        labels.extend([label] * len(texts))
        return "".join(f"<{wrap}>{html.escape(t)}</{wrap}>" for t in texts)

    def some(texts: list[str], least: int, most: int) -> list[str]:
        return [rng.choice(texts) for _ in range(rng.randint(least, most))] if texts else []

    def part(kind: str) -> str:
        opened = rng.choice(OTHER_NAMES[kind])
        if kind in ("menu", "sidebar") and rng.random() < 0.7:
            items = some(other, 2, 8)
            labels.extend([0] * len(items))
            inner = "<ul>" + "".join(f"<li><a href=/x>{html.escape(t)}</a></li>" for t in items) + "</ul>"
        elif kind == "comments":
            inner = put(some(foreign, 1, 5), 0, rng.choice(("p", "li", "div", "blockquote")))
        elif kind == "form":
            inner = put(some(other, 1, 3), 0, "div")
        else:
            inner = put(some(foreign if rng.random() < 0.4 else other, 1, 2), 0, rng.choice(("p", "div", "h2")))
        return f"{opened}{inner}{_closing(opened)}"

    def parts(kinds: tuple[str, ...], chance: float) -> str:
        return "".join(part(kind) for kind in kinds if rng.random() < chance)

    page = parts(("notice", "header", "menu", "form", "advert", "sidebar"), 0.4)
    opened = rng.choice(MAIN_NAMES)
    page += opened
    for k, text in enumerate(main):
        page += put([text], 1, "h1" if k == 0 and rng.random() < 0.8 else rng.choice(("p", "p", "p", "div", "li", "blockquote", "h2")))
        if rng.random() < 0.5 / len(main):
            page += part(rng.choice(("advert", "notice", "sidebar", "form", "comments", "menu")))
    page += parts(("comments",), 0.3) + _closing(opened) + parts(("sidebar", "comments", "advert", "form", "menu", "notice", "footer"), 0.4)
    return f"<html><body>{page}</body></html>", labels


def examples(pages: list[str], seed: int = 7) -> list[tuple[list[Block], list[int]]]:
    """Blocks and labels (-1: none) of the pages as they are and dressed anew."""
    rng = random.Random(seed)
    parsed = [blocks(page) for page in pages]
    told = [[told_by_names(b.path) for b in page] for page in parsed]
    out = [(page, [-1 if t is None else t for t in labels]) for page, labels in zip(parsed, told) if page]
    main = [[b.text for b, t in zip(page, labels) if t == 1] for page, labels in zip(parsed, told)]
    other = [[b.text for b, t in zip(page, labels) if t == 0 and len(b.text) < 200] for page, labels in zip(parsed, told)]
    foreign = [t for texts in main for t in texts[1:]] or [t for texts in main for t in texts]
    shared = [t for texts in other for t in texts]
    for texts in main:
        for _ in range(DRESSED if texts else 0):
            cut = texts[:1] + texts[1:1 + rng.choice((len(texts), 1, 2, 5))]
            page, labels = dressed(cut, shared, foreign, rng)
            found = blocks(page)
            if len(found) == len(labels):
                out.append((found, labels))
    return out


def train(pages: DataFrame, key: str = "page_id", page: str = "html", sample: int = SAMPLE) -> Labeller | None:
    """The labeller, fitted on up to ``sample`` pages of up to ``SAMPLE_CHARS`` letters, those whose hash is least; None without such pages.

    Pages are counted first, so that only twice the wanted share of hashes is looked at, alike rows once, whatever the number of tasks.
    """
    usable = pages.select(F.col(page).alias("_page"), F.xxhash64(key, page).alias("_draw")).filter(
        F.col("_page").isNotNull() & (F.length("_page") <= SAMPLE_CHARS))
    n = usable.count()
    if n > 4 * sample:
        usable = usable.filter(F.col("_draw") < int(2 * sample / n * 2 ** 64) - 2 ** 63)
    drawn = usable.groupBy("_draw").agg(F.min("_page").alias("_page"))
    taken = [r["_page"] for r in drawn.orderBy("_draw").limit(sample).collect()]
    learned = examples(taken)
    if not learned:
        return None
    features, model = Features(), Labeller.fresh()
    model.fit([features.rows(b) for b, _ in learned], [np.array(y, dtype=np.float32) for _, y in learned])
    return model


def main_texts(pages: list[str], model: Labeller, features: Features) -> list[str]:
    """Blocks labelled as main text, joined by line feeds, page by page."""
    parsed = [blocks(page) for page in pages]
    scores = model.scores([features.rows(page) for page in parsed])
    return ["\n".join([b.text for b, s in zip(page, told) if s >= 0.5]) for page, told in zip(parsed, scores)]


def _extracted(batches: Iterator[pa.RecordBatch], model: Labeller, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in batches:
        texts: list[str] = []
        group: list[str] = []
        held = 0
        for page in batch.column("_page"):
            group.append(page.as_py() or "")
            held += len(group[-1])
            if held > most:
                texts += main_texts(group, model, features)
                group, held = [], 0
        texts += main_texts(group, model, features)
        kept = [c for c in batch.schema.names if c != "_page"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, "_main"])


def extract(pages: DataFrame, model: Labeller | None, keep: tuple[str, ...] = ("page_id", "url"), page: str = "html") -> DataFrame:
    """The ``keep`` columns and ``text``, the main text of every row of ``pages``.

    Null and empty pages, and pages without a block that is labelled as main text, have an empty text; so have all pages if there
    was none to learn from. Repeated rows are read each; other columns are not read, so their names cannot clash. Pages are read
    whole where they are, in groups bounded by letters; a page's memory is in proportion to its own blocks. Nothing is shuffled.
    """
    rows = pages.select(*(F.col(c).alias(f"_kept_{i}") for i, c in enumerate(keep)), F.col(page).alias("_page"))
    if model is None:
        done = rows.withColumn("_main", F.lit("")).drop("_page")
    else:
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_page")
        done = rows.mapInArrow(lambda batches: _extracted(batches, model), f"{schema}{', ' if schema else ''}_main string")
    return done.select(*(F.col(f"_kept_{i}").alias(c) for i, c in enumerate(keep)), F.col("_main").alias("text"))
