"""Pages as arrays of element nodes, and the features of a node."""

from __future__ import annotations

import html
import re

import numpy as np

#: Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select button".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = frozenset("html body article aside div section main td th table ul ol dl form header footer nav blockquote figure".split())
#: Words of class, id and role attributes by what they announce.
ATTRIBUTE_WORDS = {
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs crumbs toc pagination pager tabs topbar",
    "header": "header masthead head branding logo hero top",
    "footer": "footer foot bottom copyright legal colophon",
    "side": "sidebar side aside widget widgets rail secondary complementary",
    "advert": "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted dfp outbrain taboola",
    "notice": "notice cookie cookies consent gdpr alert warning popup modal overlay privacy subscribe newsletter paywall dialog",
    "form": "form search login signup register input field contact",
    "comment": "comment comments commentlist disqus reply replies respond discussion reader feedback",
    "share": "share sharing social follow like likes buttons tools toolbar",
    "related": "related more recommended recommendations popular trending similar tags tag recent links",
    "hidden": "hidden hide invisible offscreen sr",
    "content": "content article post entry story body text main page copy prose hentry",
}
TAG_GROUPS = ("nav menu", "header", "footer", "aside", "form fieldset label legend", "article", "main", "p", "h1 h2 h3 h4 h5 h6", "li", "ul ol dl", "a", "div", "section", "table tbody tr td th", "blockquote pre figure figcaption dd dt", "body html")
SEMANTIC = 7  # the first groups also count for all elements inside

_WORD_BIT = {w: 1 << i for i, words in enumerate(ATTRIBUTE_WORDS.values()) for w in words.split()}
_TAG_BIT = {t: 1 << i for i, tags in enumerate(TAG_GROUPS) for t in tags.split()}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|</?([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*>)|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_ATTRIBUTE_WORD = re.compile(r"[A-Z]?[a-z]+")
_OUT_OF_SIGHT = re.compile(r"""display\s*:\s*none|visibility\s*:\s*hidden|\shidden(?=[\s>=/])|aria-hidden\s*=\s*["']?true""", re.I)
_CLOSERS: dict[str, re.Pattern] = {}


def attribute_bits(tag: str) -> int:
    bits = 0
    if "=" in tag:
        for m in _ATTRIBUTE.finditer(tag):
            for w in _ATTRIBUTE_WORD.findall(m[1] or m[2] or m[3] or ""):
                bits |= _WORD_BIT.get(w.lower(), 0)
    if _OUT_OF_SIGHT.search(tag):
        bits |= _WORD_BIT["hidden"]
    return bits


class Page:
    """Elements in page order: tags, parents, attribute bits, where each subtree ends; and text segments with their
    element and block number. Scripts, styles, form controls and the like are left out while reading."""

    def __init__(self, source: str):
        self.tags, self.parents, self.bits, self.ends = ["html"], [-1], [0], []
        self.texts: list[str] = []
        self.owners: list[int] = []
        self.blocks: list[int] = []
        self.block = 0
        stack = [0]
        at, n = 0, len(source)
        while at < n:
            m = _TOKEN.search(source, at)
            if m is None:
                self.text(source[at:], stack[-1])
                break
            if m.start() > at:
                self.text(source[at : m.start()], stack[-1])
            at = m.end()
            if m[1] is None:
                continue
            tag = m[1].lower()
            if source[m.start() + 1] == "/":
                self.end(tag, stack)
            elif tag in RAW:
                if not m[2].endswith("/>") or tag not in ("svg", "math"):
                    closer = _CLOSERS.get(tag) or _CLOSERS.setdefault(tag, re.compile(rf"</{tag}\s*>", re.I))
                    c = closer.search(source, at)
                    at = c.end() if c else n
            else:
                self.start(tag, m[2], stack)
        self.close(len(self.tags))

    def text(self, s: str, owner: int) -> None:
        if "&" in s:
            s = html.unescape(s)
        if s:
            self.texts.append(s)
            self.owners.append(owner)
            self.blocks.append(self.block)

    def start(self, tag: str, rest: str, stack: list[int]) -> None:
        tags = self.tags
        if tag in ENDS_PARAGRAPH:
            self.pop("p", stack)
        if tag in SIBLINGS:
            for k in range(len(stack) - 1, 0, -1):
                t = tags[stack[k]]
                if t in SIBLINGS[tag]:
                    del stack[k:]
                    if tag != "tr" or t == "tr":
                        break
                elif t in FENCES and t not in ("td", "th"):
                    break
        if tag not in INLINE:
            self.block += 1
        if tag in ("html", "body") and tag in (tags[i] for i in stack):
            return
        if tag in VOID:
            if tag == "br":
                self.text(" ", stack[-1])
            return
        tags.append(tag)
        self.parents.append(stack[-1])
        self.bits.append(attribute_bits(rest))
        if not rest.endswith("/>"):
            stack.append(len(tags) - 1)

    def pop(self, tag: str, stack: list[int]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            t = self.tags[stack[k]]
            if t == tag:
                del stack[k:]
                return
            if t in FENCES:
                return

    def end(self, tag: str, stack: list[int]) -> None:
        if tag not in INLINE:
            self.block += 1
        for k in range(len(stack) - 1, 0, -1):
            if self.tags[stack[k]] == tag:
                del stack[k:]
                return
            if tag in INLINE and self.tags[stack[k]] in FENCES:
                return

    def close(self, n: int) -> None:
        """Elements stand in page order, so a subtree is a range: it ends where the last descendant's does."""
        self.ends = list(range(1, n + 1))
        for i in range(n - 1, 0, -1):
            p = self.parents[i]
            if self.ends[i] > self.ends[p]:
                self.ends[p] = self.ends[i]

    def kept(self, keep: list[bool]) -> str:
        """The kept segments: white space as one space inside a block, blocks on lines of their own."""
        lines, parts, block = [], [], -1
        for s, b, k in zip(self.texts, self.blocks, keep):
            if not k:
                continue
            if b != block:
                lines.append(" ".join("".join(parts).split()))
                parts, block = [], b
            parts.append(s)
        lines.append(" ".join("".join(parts).split()))
        return "\n".join(x for x in lines if x)


N_WORDS, N_TAGS = len(ATTRIBUTE_WORDS), len(TAG_GROUPS)
N_FEATURES = 2 * N_WORDS + N_TAGS + SEMANTIC + 17


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all elements of the pages, one page after the other; the characters of text in each subtree and in
    the element itself."""
    sizes = [len(p.tags) for p in pages]
    n, base = sum(sizes), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    tags = [t for p in pages for t in p.tags]
    tag_bits = [_TAG_BIT.get(t, 0) for t in tags]
    above_words, above_tags, depth, in_link, index, children = ([0] * n for _ in range(6))
    parent, word_bits = [0] * n, [0] * n
    for page, b in zip(pages, base.tolist()):
        parent[b] = b
        for i in range(1, len(page.tags)):
            at, up = b + i, b + page.parents[i]
            parent[at] = up
            word_bits[at] = page.bits[i]
            above_words[at] = above_words[up] | word_bits[up]
            above_tags[at] = above_tags[up] | tag_bits[up]
            depth[at] = depth[up] + 1
            in_link[at] = in_link[up] or tags[at] == "a"
            index[at] = children[up]
            children[up] += 1
    start, up = np.arange(n), np.array(parent)
    end = np.concatenate([np.array(p.ends, dtype=np.int64) + b for p, b in zip(pages, base.tolist())])
    last = np.repeat(base[1:], sizes)
    first = np.repeat(base[:-1], sizes)
    owner = np.array([o + b for p, b in zip(pages, base.tolist()) for o in p.owners], dtype=np.int64)
    stripped = [s.strip() for p in pages for s in p.texts]
    chars = np.array([len(s) for s in stripped], float)
    own = np.zeros((n, 5))  # characters, in links, words, stops, segments
    if len(owner):
        linked = np.array(in_link)[owner] * chars
        words = np.array([s.count(" ") + bool(s) for s in stripped], float)
        stops = np.array([s.count(".") + s.count(",") for s in stripped], float)
        for k, v in enumerate((chars, linked, words, stops, (chars > 0).astype(float))):
            own[:, k] = np.bincount(owner, v, n)
    total = np.vstack([np.zeros(5), np.cumsum(own, 0)])
    chars, linked, words, stops, segments = (total[end] - total[start]).T
    size = (end - start).astype(float)
    whole = np.maximum(total[last, 0] - total[first, 0], 1)
    paragraphs = np.concatenate([[0], np.cumsum([t == "p" for t in tags])])
    long_own = np.concatenate([[0], np.cumsum(own[:, 0] > 80)])
    density = linked / np.maximum(chars, 1)
    siblings = np.array(children)[up]
    after = np.minimum(end, last - 1)  # the element after the subtree: the next sibling, or one further up
    numbers = np.stack(
        [
            np.log1p(chars), density, np.log1p(words), stops / np.maximum(words, 1), np.log1p(chars / size), np.log1p(chars / np.maximum(segments, 1)),
            chars / whole, (total[start, 0] - total[first, 0]) / whole, np.array(depth, float), np.array(index) / np.maximum(siblings, 1), np.log1p(siblings), np.log1p(paragraphs[end] - paragraphs[start]),
            np.log1p(long_own[end] - long_own[start]), np.log1p(own[:, 0]), np.log1p(chars[up]), density[up], np.log1p(chars[after]),
        ],
        1,
    )
    bits = lambda values, k: (np.array(values, dtype=np.int64)[:, None] >> np.arange(k)) & 1
    x = np.hstack([bits(word_bits, N_WORDS), bits(above_words, N_WORDS), bits(tag_bits, N_TAGS), bits(above_tags, SEMANTIC), numbers])
    return x, chars, own[:, 0]
