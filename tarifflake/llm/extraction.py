"""HTML extraction: boosted trees over DOM-node features, decoded over the tree.

Every element with text gets a probability that its text is main text. The decoding gives each subtree one of three
choices: all kept, all dropped, or mixed, where the children choose; a kept or dropped subtree pays the disagreement of
all its elements and a mixed one a price for the border, so no descendant contradicts the choice of its ancestor.

The trees are fitted on a bounded set of training pages (``TRAINING_PAGES``) that this module composes: frames of menus,
headers, footers, side columns, notices, adverts, forms, link lists and reader comments around articles, in the marking
styles that are usual for them, with random words, so nothing depends on a language. The model is the same everywhere.

Defined cases: null and empty html give an empty text; text outside all elements belongs to the page; unclosed and
stray tags follow the usual closing rules; rows are independent; columns besides ``page_id``, ``url`` and ``html``
aren't read.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .boosting import Trees, boost
from .dom import Page, features

TRAINING_PAGES = 1200
MARK = "\ue000"  # stands before main text in training pages only
BORDER = 1.0  # price of a mixed subtree, in log likelihood


class Composer:
    """Training pages: main text carries ``MARK``."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.vocabulary = ["".join(self.r.choice("aeiounrtsldmp") for _ in range(self.r.randint(1, 9))) for _ in range(600)]

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.r.choice(self.vocabulary) for _ in range(self.r.randint(lo, hi)))

    def sentences(self, n: int, mark: str = "") -> str:
        style = self.r.random()
        out = " ".join(self.words(3, 16).capitalize() + self.r.choice([".", ".", ".", "?", ","]) for _ in range(n))
        if style < 0.08:
            out = out.upper()
        elif style < 0.16:
            out = " ".join(w + self.r.choice(["***", "%%", "$$$", "&amp;"]) for w in out.split())
        return mark + out

    def pick(self, *options: str) -> str:
        return self.r.choice(options)

    def named(self, words: str) -> str:
        """An attribute from usual names, now and then one that says nothing."""
        if self.r.random() < 0.2:
            return self.pick("", f' class="c{self.r.randint(1, 99)}"', f' id="x{self.r.randint(1, 99)}"')
        w = self.r.choice(words.split())
        w = self.pick(w, w, f"{w}-{self.pick('box', 'wrap', 'inner', 'block')}", f"site-{w}", f"{w} {self.pick('clearfix', 'row', 'col-3')}")
        return f' {self.pick("class", "class", "id")}="{w}"'

    def box(self, tags: str, names: str, inner: str) -> str:
        tag = self.r.choice(tags.split())
        attr = self.named(names) if tag in ("div", "ul", "section", "p", "span") or self.r.random() < 0.5 else ""
        return f"<{tag}{attr}>{inner}</{tag}>"

    def links(self, lo: int, hi: int) -> str:
        items = [f'<a href="/{self.words(1, 1)}">{self.words(1, 4)}</a>' for _ in range(self.r.randint(lo, hi))]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.pick(" | ", " ", "<br>").join(items)

    def menu(self) -> str:
        return self.box("nav nav div ul", "menu nav navbar navigation breadcrumb tabs", self.links(2, 12))

    def top(self) -> str:
        inner = self.pick("h1", "div", "p", "span")
        body = f"<{inner}>{self.words(1, 6)}</{inner}>" + (f"<p>{self.words(3, 12)}</p>" if self.r.random() < 0.5 else "") + (self.menu() if self.r.random() < 0.4 else "")
        return self.box("header header div", "header masthead branding top logo", body)

    def foot(self) -> str:
        body = self.pick("&copy; ", "", "") + self.pick(self.sentences(1), self.sentences(2), f"<p>{self.sentences(2)}</p>", self.links(2, 6) + f"<p>{self.words(3, 12)}</p>")
        return self.box("footer footer footer div", "footer bottom copyright colophon", body)

    def side(self) -> str:
        body = "".join(f"<{(h := self.pick('h3', 'h4', 'h2'))}>{self.words(1, 4)}</{h}>" + self.pick(self.links(2, 8), f"<p>{self.sentences(self.r.randint(1, 4))}</p>") for _ in range(self.r.randint(1, 3)))
        return self.box("aside aside div", "sidebar side widget rail secondary", body)

    def notice(self) -> str:
        text = self.sentences(self.r.randint(1, 4))
        return self.box("div div section aside", "cookie notice consent alert gdpr newsletter popup banner warning", self.pick(text, f"<p>{text}</p>") + self.pick("", "<button>ok</button>", f'<a href="#">{self.words(1, 2)}</a>'))

    def advert(self) -> str:
        text = self.sentences(self.r.randint(1, 4))
        return self.box("div div div aside", "ad ads advert sponsored promo advertisement", self.pick(text, f"<p>{text}</p>", f'<a href="#">{text}</a>'))

    def form(self) -> str:
        body = "".join(f"<{(t := self.pick('label', 'label', 'p', 'legend'))}>{self.words(1, 5)}</{t}><input name='a'>" for _ in range(self.r.randint(1, 4)))
        return f"<form{self.named('search login signup contact')}>{body}{self.pick('', f'<p>{self.sentences(1)}</p>')}</form>"

    def comments(self) -> str:
        def one() -> str:
            text = self.sentences(self.r.randint(1, 5))
            who = self.pick("", f"<b>{self.words(1, 2)}</b>", f"<span class='author'>{self.words(1, 2)}</span>")
            return self.box("div li article p", "comment reply comment-body", who + self.pick(text, f"<p>{text}</p>"))

        title = self.pick("", f"<h3>{self.words(1, 3)}</h3>", f"<h2>{self.words(1, 2)}</h2>")
        return self.box("section div ol", "comments comments commentlist discussion replies", title + "".join(one() for _ in range(self.r.randint(1, 6))))

    def others(self) -> str:
        kind = self.pick("share", "related")
        return self.box("div section aside", "share social" if kind == "share" else "related recommended popular", f"<h4>{self.words(1, 3)}</h4>" * self.r.randint(0, 1) + self.links(2, 8))

    def paragraph(self) -> str:
        text = self.sentences(self.r.choice([1, 1, 2, 3, 4, 6, 9]), MARK)
        x = self.r.random()
        if x < 0.15:
            return f'<p>{text} <a href="/x">{MARK}{self.words(1, 5)}</a> {self.sentences(1, MARK)}</p>'
        if x < 0.25:
            return f"<p><{(t := self.pick('b', 'i', 'em', 'strong'))}>{text}</{t}></p>"
        if x < 0.32:
            return f"<p><b>{text}<br>"
        return f"<p>{text}</p>"

    def part(self) -> str:
        x = self.r.random()
        if x < 0.72:
            return self.paragraph()
        if x < 0.8:
            return f"<{(h := self.pick('h2', 'h3'))}>{MARK}{self.words(1, 7)}</{h}>"
        if x < 0.88:
            return f"<{(u := self.pick('ul', 'ol'))}>" + "".join(f"<li>{MARK}{self.pick(self.words(1, 8), self.sentences(1))}</li>" for _ in range(self.r.randint(2, 6))) + f"</{u}>"
        if x < 0.93:
            return f"<{(q := self.pick('blockquote', 'pre', 'div'))}>{self.sentences(self.r.randint(1, 3), MARK)}</{q}>"
        if x < 0.97:
            rows = "".join("<tr>" + "".join(f"<td>{MARK}{self.words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(self.r.randint(2, 5)))
            return f"<table>{rows}</table>"
        return f"<figure><img src='a.png'><figcaption>{MARK}{self.words(2, 10)}</figcaption></figure>"

    def article(self) -> str:
        n = self.r.choice([1, 1, 1, 2, 3, 4, 6, 9, 14])
        parts = [self.part() if n > 1 else self.paragraph() for _ in range(n)]
        if self.r.random() < 0.75:
            parts.insert(0, f"<h1>{MARK}{self.words(1, 9)}</h1>")
        for make in (self.advert, self.others, self.notice, self.comments, self.form):
            if self.r.random() < 0.12:
                parts.insert(self.r.randint(0, len(parts)), make())
        body = "".join(parts)
        x = self.r.random()
        if x < 0.45:
            body = f"<article{self.pick('', '', self.named('post entry article'))}>{body}</article>"
        elif x < 0.85:
            body = self.box("div div section td", "content post entry article story body text page", body)
        else:
            body = f"<div>{body}</div>"
        return f"<main>{body}</main>" if self.r.random() < 0.25 else body

    def page(self) -> str:
        some = lambda share, *makers: [m() for m in makers if self.r.random() < share]
        before = some(0.5, self.top, self.menu, self.notice, self.advert, self.side)
        after = some(0.4, self.others, self.comments, self.side, self.form, self.advert, self.notice)
        if self.r.random() < 0.5:
            self.r.shuffle(before)
            self.r.shuffle(after)
        middle = self.article()
        if self.r.random() < 0.4:
            middle = f"<div{self.named('wrapper container page main layout')}>{middle}{''.join(after)}</div>"
            after = []
        return f"<html><head><title>{self.words(1, 8)}</title></head><body>{''.join(before)}{middle}{''.join(after)}{''.join(some(0.7, self.foot))}</body></html>"


def training_rows(sources: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, main or not and weight of each element with text."""
    pages, main_chars = [], []
    for source in sources:
        page = Page(source)
        main = [len(s.strip()) - s.count(MARK) if MARK in s else 0 for s in page.texts]
        page.texts = [s.replace(MARK, "") for s in page.texts]
        inside = np.concatenate([[0], np.cumsum(np.bincount(page.owners, main, len(page.tags)))])
        main_chars.append(inside[np.array(page.ends)] - inside[:-1])
        pages.append(page)
    x, chars, own = features(pages)
    share = np.concatenate(main_chars) / np.maximum(chars, 1)
    some = chars > 0
    weight = (0.3 + np.log1p(own)) * np.abs(2 * share - 1).clip(0.05, 1)
    return x[some], (share[some] > 0.5).astype(float), (weight / weight[some].mean())[some]


@lru_cache(maxsize=4)
def trained(seed: int = 1, n_pages: int = TRAINING_PAGES) -> Trees:
    composer = Composer(seed)
    return boost(*training_rows([composer.page() for _ in range(n_pages)]), trees=50)


def decode(page: Page, p: np.ndarray, chars: np.ndarray, own: np.ndarray) -> list[bool]:
    """Which text segments to keep: the choice of all kept, all dropped or mixed with the least cost for each subtree.
    An element weighs by the logarithm of its own text, so wrappers without text of their own count little."""
    n = len(page.tags)
    weight = np.where(chars > 0, 0.3 + np.log1p(own), 0)
    p = p.clip(1e-4, 1 - 1e-4)
    keep_cost, drop_cost = (-np.log(p) * weight).tolist(), (-np.log(1 - p) * weight).tolist()
    keep, drop, mixed = keep_cost[:], drop_cost[:], [BORDER] * n
    own_cost = np.where(own > 0, np.minimum(-np.log(p), -np.log(1 - p)) * weight, 0).tolist()
    best = [0.0] * n
    for i in range(n - 1, -1, -1):
        mixed[i] += own_cost[i]
        if page.tags[i] in ("html", "body"):
            drop[i] = float("inf")  # a page is never dropped as a whole: its parts are
        best[i] = min(keep[i], drop[i], mixed[i])
        up = page.parents[i]
        if up >= 0:
            keep[up] += keep[i]
            drop[up] += drop[i]
            mixed[up] += best[i]
    choice: list[bool | None] = [None] * n
    own_kept = (p >= 0.5).tolist()
    for i in range(n):
        up = page.parents[i]
        if up >= 0 and choice[up] is not None:
            choice[i] = choice[up]
        elif mixed[i] >= min(keep[i], drop[i]):
            choice[i] = keep[i] < drop[i]
    return [own_kept[o] if choice[o] is None else bool(choice[o]) for o in page.owners]


def main_texts(sources: list[str], model: Trees) -> list[str]:
    if not sources:
        return []
    pages = [Page(s) for s in sources]
    x, chars, own = features(pages)
    probabilities, out, at = model.probability(x), [], 0
    for page in pages:
        to = at + len(page.tags)
        out.append(page.kept(decode(page, probabilities[at:to], chars[at:to], own[at:to])))
        at = to
    return out


def extracted(pages: DataFrame, model: Trees | None = None) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every page."""
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                texts = main_texts([s or "" for s in part.column("html").to_pylist()], model)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
