"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: stretches of text between tags that are not inline. Each block has features of its
ancestors (tags, class and id words) and of its text (length, link share, marks, place). The chain has two labels; it is
trained on labelled pages by gradient ascent with forward-backward sums, and Viterbi decodes each page's blocks.

Null or empty pages give an empty text; broken markup is read as far as it goes, in time that grows with the page's length only. Repeated rows give repeated results, null ids stay, an
empty table gives no rows, and columns besides page_id, url and html are not looked at, whatever their names. Pages of any length are read whole.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from athenor.llm.common import parts

EXTRACTED = "page_id long, url string, text string, n_chars long, n_blocks int, kept_blocks array<int>"

_OPENS = re.compile(r"<(/?)([a-zA-Z][\w:-]*)")
#: Quotation marks enclose a value right after an equals sign only; elsewhere they are letters like any other.
_ATTRIBUTES = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
_RAW = frozenset("script style noscript template textarea svg iframe".split())
_RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _RAW}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")

#: Fixed values of HTML.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
ENDS_PARAGRAPH = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())


@dataclass
class Block:
    path: tuple[str, ...]  # feature names of the ancestors
    text: str
    linked: int  # characters inside links


def _names(tag: str, attrs: str) -> tuple[str, ...]:
    out = ["t:" + tag]
    for groups in _NAMES.findall(attrs) if "=" in attrs else ():
        for word in _SPLIT.split(max(groups, key=len)):
            if word:
                out.append("c:" + word.lower())
    return tuple(out)


def tokens(html: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text, tag, whether it ends one, attributes): text has no tag; comments, declarations and what stands in scripts and the like go.

    One pass whatever the markup: a tag ends at its first ``>`` outside quoted values; if the quoted values run to the end of the page, quotation
    marks count no more from there on. A tag that nothing ends is left out up to the next ``<``, and raw text that nothing ends up to the end.
    """
    at, size, last, quotes = 0, len(html), html.rfind(">"), True
    while at < size:
        start = html.find("<", at)
        if start != at:
            yield html[at : start if start >= 0 else size], "", False, ""
            if start < 0:
                return
        opens = _OPENS.match(html, start)
        if opens is None:
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                at = end + 3 if end >= 0 else size
            elif html[start + 1 : start + 2] in ("!", "?", "/") and start + 1 < size:
                end = html.find(">", start) if start < last else html.find("<", start + 1)
                at = size if end < 0 else end + (start < last)
            else:
                yield "<", "", False, ""
                at = start + 1
            continue
        inner = opens.end()
        if inner > last:  # nothing can end it
            end = html.find("<", inner)
            at = end if end >= 0 else size
            continue
        closed = _ATTRIBUTES.match(html, inner) if quotes else None
        if closed is None:
            quotes, at = False, html.find(">", inner) + 1
        else:
            at = closed.end()
        tag, attributes = opens[2].lower(), html[inner : at - 1]
        if tag in _RAW and not opens[1]:
            if tag == "svg" and attributes.endswith("/"):
                continue
            end = _RAW_ENDS[tag].search(html, at)
            end = html.find(">", end.end()) if end else -1
            at = end + 1 if end >= 0 else size
            continue
        yield "", tag, bool(opens[1]), attributes


def leaf_blocks(html: str, known: frozenset[str] | None = None) -> list[Block]:
    """Leaf blocks in page order; white space inside a block is one space, character references are decoded.

    Of the ancestors' features only the ``known`` ones are kept, which bounds a path however deep the page is; None keeps all.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = [("", ())]
    standing: Counter = Counter()  # open elements of each tag
    parts: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            text = " ".join((unescape(text) if "&" in text else text).split())
            parts.clear()
            if text:
                out.append(Block(stack[-1][1], text, linked))
        linked = 0

    for piece, tag, ends, attributes in tokens(html):
        if not tag:
            parts.append(piece)
            if in_link:
                linked += len(piece.strip())
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = not ends
            elif tag == "br":
                parts.append(" ")
            continue
        flush()
        if ends:
            in_link = False
            while standing[tag]:
                name = stack.pop()[0]
                standing[name] -= 1
                if name == tag:
                    break
            continue
        gone = CLOSES.get(tag, ("p",) if tag in ENDS_PARAGRAPH else ())
        while len(stack) > 1 and stack[-1][0] in gone:
            standing[stack.pop()[0]] -= 1
        if tag not in VOID:
            path = stack[-1][1]
            own = [f for f in dict.fromkeys((*_names(tag, attributes), "p:" + tag)) if (known is None or f in known) and f not in path]
            stack.append((tag, (*path, *own) if own else path))
            standing[tag] += 1
    flush()
    return out


def text_features(block: Block, place: int, n: int, inside: bool) -> list[str]:
    """Features of the text; ``inside``: an article or main element is among the ancestors of some block of the page."""
    words = block.text.count(" ") + 1
    share = block.linked / len(block.text)
    return [
        "w:" + ("1" if words == 1 else "3" if words <= 3 else "8" if words <= 8 else "20" if words <= 20 else "60" if words <= 60 else "more"),
        "l:" + ("0" if share == 0 else "some" if share < 0.5 else "most"),
        "e:" + (block.text[-1] if block.text[-1] in ".!?:;…\"”" else "other"),
        "m:" + ("1" if ", " in block.text else "0"),
        "s:" + ("1" if "©" in block.text or "|" in block.text else "0"),
        "q:" + str(5 * place // n),
        "i:" + str(int(inside)),
    ]


@dataclass
class BlockCRF:
    weights: dict[str, float]  # log odds of label 1
    change: np.ndarray  # (2, 2) transitions
    begin: np.ndarray
    memo: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.known = frozenset(self.weights) | {"t:article", "t:main"}

    def emissions(self, blocks: list[Block]) -> list[float]:
        get, memo = self.weights.get, self.memo
        inside = any("t:article" in b.path or "t:main" in b.path for b in blocks)
        out = []
        for i, b in enumerate(blocks):
            if (path := memo.get(b.path)) is None:
                if len(memo) > 50_000:
                    memo.clear()
                path = memo[b.path] = sum(get(f, 0.0) for f in b.path)
            out.append(path + sum([get(f, 0.0) for f in text_features(b, i, len(blocks), inside)]))
        return out

    def viterbi(self, blocks: list[Block]) -> list[int]:
        """Most probable labels."""
        if not blocks:
            return []
        (t00, t01), (t10, t11) = self.change.tolist()
        e = self.emissions(blocks)
        s0, s1, back = float(self.begin[0]), float(self.begin[1]) + e[0], []
        for x in e[1:]:
            a, b, c, d = s0 + t00, s1 + t10, s0 + t01, s1 + t11
            back.append((int(b > a), int(d > c)))
            s0, s1 = max(a, b), max(c, d) + x
        labels = [int(s1 > s0)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]

    def extract(self, html: str) -> tuple[str, int, list[int]]:
        """Main text, number of blocks, numbers of the blocks kept."""
        blocks = leaf_blocks(html, self.known)
        kept = [i for i, y in enumerate(self.viterbi(blocks)) if y]
        return "\n".join(blocks[i].text for i in kept), len(blocks), kept


def fit(pages: list[tuple[list[Block], list[int]]], steps: int = 120, rate: float = 0.15, decay: float = 1e-3) -> BlockCRF:
    """Adam on the mean log-likelihood of the label sequences; all pages of a step go through the chain side by side."""
    index: dict[str, int] = {}
    width = max(len(b) for b, _ in pages)
    rows, cols, y = [], [], np.zeros((len(pages), width), int)
    real = np.zeros((len(pages), width), bool)
    for p, (blocks, labels) in enumerate(pages):
        inside = any("t:article" in b.path or "t:main" in b.path for b in blocks)
        for i, b in enumerate(blocks):
            for f in (*b.path, *text_features(b, i, len(blocks), inside)):
                rows.append(p * width + i)
                cols.append(index.setdefault(f, len(index)))
        y[p, : len(blocks)], real[p, : len(blocks)] = labels, True
    rows, cols = np.array(rows), np.array(cols)
    theta = np.zeros(len(index) + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    pairs = real[:, 1:]
    for t in range(1, steps + 1):
        w, change, begin = theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:]
        score = np.zeros((len(pages), width, 2))
        score[:, :, 1] = np.bincount(rows, w[cols], minlength=y.size).reshape(y.shape)
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = begin + score[:, 0]
        for i in range(1, width):
            step = np.logaddexp.reduce(ahead[:, i - 1, :, None] + change, axis=1) + score[:, i]
            ahead[:, i] = np.where(real[:, i, None], step, ahead[:, i - 1])
        for i in range(width - 2, -1, -1):
            step = np.logaddexp.reduce(change + (score[:, i + 1] + behind[:, i + 1])[:, None, :], axis=2)
            behind[:, i] = np.where(real[:, i + 1, None], step, 0)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        p1 = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[:, None])
        both = np.exp(ahead[:, :-1, :, None] + change + (score[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]) * pairs[:, :, None, None]
        g = np.zeros_like(theta)
        g[:-6] = np.bincount(cols, ((y - p1) * real).ravel()[rows], minlength=len(index))
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][pairs], y[:, 1:][pairs]), 1)
        g[-6:-2] = (seen - both.sum((0, 1))).ravel()
        first = np.exp(ahead[:, 0] + behind[:, 0] - total[:, None])
        g[-2:] = [(y[:, 0] == k).sum() - first[:, k].sum() for k in (0, 1)]
        g = g / len(pages) - decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return BlockCRF({f: float(theta[i]) for f, i in index.items()}, theta[-6:-2].reshape(2, 2).copy(), theta[-2:].copy())


def labelled_pages(n: int = 400, seed: int = 5) -> list[tuple[str, list[str]]]:
    """Labelled pages for training: (html, blocks of the article). Layouts vary as sites do; words are drawn at random."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    chance = lambda p: rng.random() < p

    def word() -> str:
        return "".join(pick("an", "the", "re", "ti", "on", "és", "lo", "schu", "ka", "mi", "ver") for _ in range(rng.integers(1, 4)))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(rng.integers(a, b)))

    def sentence() -> str:
        return words(1, 14).capitalize().replace(" ", pick(" ", " ", ", "), 1) + "."

    def paragraph() -> str:
        return " ".join(sentence() for _ in range(pick(1, 1, 2, 3, 5, 8)))

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(k))

    def menu() -> str:
        inner = f"<ul>{links(rng.integers(3, 9))}</ul>"
        return pick(f"<nav>{inner}</nav>", f'<div class="{pick("menu", "nav", "navbar", "navigation top-menu")}">{inner}</div>', f'<header>{pick("", f"<h2>{words(1, 3)}</h2>")}{inner}</header>', f'<div id="header"><p>{words(1, 5)}</p>{inner}</div>')

    def advert() -> str:
        return f'<div class="{pick("ad", "ads", "advert", "advertisement", "sponsored banner", "ad-slot promo")}">{pick(paragraph(), f"<p>{paragraph()}</p>", f"<a href=x>{words(2, 8)}</a>")}</div>'

    def aside() -> str:
        name = pick("sidebar", "widget", "related", "side")
        inner = pick(f"<h3>{words(1, 4)}</h3><ul>{links(rng.integers(2, 6))}</ul>", f"<p>{paragraph()}</p>", f"<h4>{words(1, 3)}</h4><p>{paragraph()}</p>")
        return pick(f"<aside>{inner}</aside>", f'<div class="{name}">{inner}</div>', f'<aside class="{name}">{inner}</aside>')

    def notice() -> str:
        name = pick("cookie", "cookie-notice", "notice", "consent banner", "alert notice", "gdpr", "newsletter", "popup")
        return f'<div class="{name}">{pick(f"<p>{paragraph()}</p>", paragraph())}{pick("", "<button>OK</button>")}</div>'

    def form() -> str:
        return f'<form action="/s"><label>{words(1, 4)}</label><input name="q"><p>{paragraph()}</p><button>{words(1, 2)}</button></form>'

    def comments() -> str:
        one = lambda: pick(f"<li><b>{word()}</b><p>{paragraph()}</p></li>", f'<div class="comment"><span>{word()}</span><p>{paragraph()}</p></div>', f'<article class="comment"><p>{paragraph()}</p></article>')
        inner = "".join(one() for _ in range(rng.integers(1, 5)))
        return pick(f'<section class="comments"><h3>{words(1, 3)}</h3>{inner}</section>', f'<div id="comments">{inner}</div>', f'<ol class="comment-list">{inner}</ol>')

    def footer() -> str:
        inner = pick(f"&copy; {word()}.example &middot; {paragraph()}", f"<p>&copy; {words(1, 4)}</p>", f"<ul>{links(3)}</ul><p>{paragraph()}</p>")
        return pick(f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f'<div class="footer">{inner}</div>', f'<div id="footer">{inner}</div>')

    out = []
    for _ in range(n):
        main: list[str] = []
        body = []

        def add(tag: str, text: str, main=main, body=body) -> None:
            main.append(text)
            body.append(pick(f"<{tag}>{text}</{tag}>", f"<{tag}>{text}</{tag}>", f"<{tag}><b>{text}<br>" if tag == "p" else f"<{tag}>{text}</{tag}>", f"<{tag}>{text}" if tag == "p" else f"<{tag}>{text}</{tag}>"))

        if chance(0.85):
            add("h1", pick(words(2, 12), sentence()))
        for _ in range(rng.integers(1, 14)):
            kind = rng.random()
            if kind < 0.75:
                add("p", paragraph())
            elif kind < 0.85:
                add(pick("h2", "h3"), words(1, 8))
            elif kind < 0.92:
                items = [words(2, 12) for _ in range(rng.integers(1, 5))]
                main += items
                body.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
            else:
                add("blockquote", paragraph())
            if chance(0.06):
                body.append(advert())
            if chance(0.03):
                body.append(aside())
        text = "".join(body)
        if chance(0.12):
            text += comments()
        if chance(0.4):  # nothing but plain elements, or names that say nothing, around the article
            text = pick(f"<div>{text}</div>", f"<div><div>{text}</div></div>", f'<div id="wrap"><div>{text}</div></div>', f'<div class="{word()}">{text}</div>', f'<section id="{word()}">{text}</section>', f"<table><tr><td>{text}</td></tr></table>", text)
        else:
            text = pick(f"<article>{text}</article>", f"<article>{text}</article>", f"<main>{text}</main>", f"<main><article>{text}</article></main>", f'<div class="{pick("content", "post", "entry-content", "article-body", "main")}">{text}</div>', f'<div id="content">{text}</div>')
        before = "".join(f() for f in (menu, advert, notice, form) if chance(0.5))
        after = "".join(f() for f in (aside, comments, advert, notice, form) if chance(0.3)) + (footer() if chance(0.9) else "")
        head = f"<head><title>{words(2, 9)}</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head>" if chance(0.9) else ""
        out.append((f"<!DOCTYPE html><html>{head}<body>{before}{text}{after}</body></html>", main))
    return out


def train(pages: list[tuple[str, list[str]]] | None = None) -> BlockCRF:
    """Fit on labelled pages: a block is labelled 1 if it is the next of the page's article blocks."""
    ready = []
    for html, main in pages if pages is not None else labelled_pages():
        blocks, labels, at = leaf_blocks(html), [], 0
        for b in blocks:
            hit = at < len(main) and b.text == " ".join(main[at].split()) and not any(f in ("t:title", "t:nav", "t:footer") for f in b.path)
            at += hit
            labels.append(int(hit))
        if blocks:
            ready.append((blocks, labels))
    return fit(ready)


def train_in_task(spark: SparkSession) -> BlockCRF:
    """``train()`` in one task: its pages are laid out there, only the model comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train())], pa.binary())], names=["model"])

    return pickle.loads(bytes(spark.range(1, numPartitions=1).mapInArrow(run, "model binary").first()[0]))


def extract(pages: DataFrame, model: BlockCRF | None = None) -> DataFrame:
    """EXTRACTED for every row and whole page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train_in_task(pages.sparkSession))  # features of the training pages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in (p for b in batches for p in parts(b, "html")):
            rows = [crf.extract(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([len(r[0]) for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int32()),
                    pa.array([r[2] for r in rows], pa.list_(pa.int32())),
                ],
                names=[c.split()[0] for c in EXTRACTED.split(", ")],
            )

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return source.mapInArrow(run, EXTRACTED)
