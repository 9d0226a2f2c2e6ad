"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks (the text between borders of block elements). Each block has
binary features: its tag and its ancestors' tags, words in the ancestors' class, id and role,
and its text (length, links, punctuation, telling words). The chain labels every block as
main text or not and is decoded by Viterbi; main blocks are joined in page order by one line
feed.

The field is trained on labelled pages: ``labelled_pages`` builds pages of many layouts whose
elements carry their label, from component templates and a fixed seed. Training sees the
labels, features never do.

Parsing is one pass of a tag pattern that never crosses another ``<``, so a page takes time
in its length; ancestors' features are inherited from parent to child, so depth costs nothing.

Cases: null and empty pages give an empty text; missing end tags and cut pages are read as
far as they go; text without any element is one block; script, style and other raw elements,
comments and head are no text; head ends at the first tag or text of a body; svg, object, select
and the like are left out up to their own end tag, and one without an end tag leaves out
nothing (select: the text up to the next border of a block); repeated rows are treated alike; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens.llm import chain

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']++|\"[^\"<]*\"|'[^'<]*')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^<>]*)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"(class|id|role|data-main)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Fixed values of HTML: elements whose content is raw text and no text of the page, those parsed and left out, with own syntax, without end, and those that part blocks.
RAW = frozenset("script style noscript iframe title textarea".split())
LEFT_OUT = frozenset("template object svg math canvas audio video select".split())
FOREIGN = frozenset("svg math".split())
#: What may stand in head; any other tag ends it.
HEAD = frozenset("html head base link meta template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html head body article section main nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "form fieldset legend blockquote pre figure figcaption address details summary dialog hr center menu search hgroup".split()
)
#: Elements that end when one of the second set begins.
ENDS = {
    "p": BLOCK - {"html", "head", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr", "tbody"},
    "th": {"td", "th", "tr", "tbody"}, "tr": {"tr", "tbody"},
}
#: Words in class, id and role by what they tell.
CLASS_WORDS = {
    "content": "article content post entry main story text body copy prose",
    "ad": "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner adsense",
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager toc tabs skip",
    "side": "sidebar side aside rail widget related recommended recommendations popular trending more complementary",
    "comment": "comment comments reply replies respond discussion disqus thread feedback responses",
    "notice": "cookie cookies consent notice gdpr popup modal alert overlay newsletter subscribe signup paywall message disclaimer",
    "share": "share sharing social follow tools actions buttons",
    "foot": "footer foot copyright legal colophon contentinfo bottom",
    "head": "header head masthead logo topbar brand top",
    "form": "form login search register contact",
}
_GROUP = {w: g for g, words in CLASS_WORDS.items() for w in words.split()}
ANCESTORS = "article main section nav header footer aside form ul ol dl table blockquote figure figcaption details dialog head address pre".split()
OWN = "p h1 h2 h3 h4 li td th dt dd div figcaption blockquote pre summary legend body".split()
_TELLING = re.compile(
    r"©|\ball rights reserved|copyright|cookies?\b|\bsubscribe|newsletter|\bsign (?:in|up)|\blog ?in\b|\bshare\b|\bcomments?\b|\breply\b|advertis|sponsored|\bterms\b|privacy", re.I
)
SHAPES = ("one_word", "few_words", "some_words", "many_words", "all_link", "half_link", "stop", "comma", "telling", "no_letter")
NAMES = ("always", *(f"in {t}" for t in ANCESTORS), *(f"is {t}" for t in OWN), *(f"class {g}" for g in CLASS_WORDS), *(f"own {g}" for g in CLASS_WORDS), *SHAPES)
_NUMBER = {n: i for i, n in enumerate(NAMES)}
_IN = {t: 1 << _NUMBER[f"in {t}"] for t in ANCESTORS}
_IS = {t: 1 << _NUMBER[f"is {t}"] for t in OWN}
_CLASS = {g: (1 << _NUMBER[f"class {g}"], 1 << _NUMBER[f"own {g}"]) for g in CLASS_WORDS}
_SHAPE = {n: 1 << _NUMBER[n] for n in SHAPES}


@dataclass
class Block:
    text: str
    bits: int
    label: int


@dataclass(slots=True)
class _Open:
    tag: str
    inside: int  # features that what is inside inherits
    own: int
    label: int


def _opened(tag: str, attrs: str, parent: _Open) -> _Open:
    inside, own, label = parent.inside | _IN.get(tag, 0), _IS.get(tag, 0), parent.label
    if "=" in attrs:
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "data-main":
                label = int(value == "1")
                continue
            for word in _PART.findall(value):
                if group := _GROUP.get(word.lower()):
                    inside |= _CLASS[group][0]
                    own |= _CLASS[group][1]
    return _Open(tag, inside, own, label)


@dataclass(slots=True)
class _Tag:
    start: int
    end: int
    name: str  # empty: comments and raw elements
    closing: bool
    attrs: str


def _tags(html: str) -> list[_Tag]:
    out: list[_Tag] = []
    at, foreign = 0, 0
    while m := _TAG.search(html, at):
        at = m.end()
        name, closing, attrs = (m[2] or m[5] or "").lower(), (m[1] or m[4]) == "/", m[3] or m[6] or ""
        empty = attrs.endswith("/")
        if name in RAW and not closing:
            if not (foreign and empty):
                over = _raw_end(name).search(html, at)
                at = over.end() if over else len(html)
            name = ""
        elif name in FOREIGN:
            if empty and not closing:
                name = ""
            else:
                foreign = max(0, foreign - 1) if closing else foreign + 1
        out.append(_Tag(m.start(), at, name, closing, attrs))
    return out


def _left_out(tags: list[_Tag]) -> dict[int, int]:
    """Start tags of left-out elements that have an end tag, and its number."""
    found: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    depth: dict[str, int] = {}

    def pop() -> int:
        name, at = stack.pop()
        depth[name] -= 1
        return at

    for i, t in enumerate(tags):
        if t.name not in LEFT_OUT and t.name not in BLOCK and t.name != "foreignobject":
            continue
        if t.closing:
            if depth.get(t.name):
                while stack[-1][0] != t.name:
                    pop()
                start = pop()
                if t.name in LEFT_OUT:
                    found[start] = i
        elif t.name not in VOID:
            if t.name in BLOCK:
                # blocks break out of what can't hold them
                while stack and (stack[-1][0] in FOREIGN or stack[-1][0] == "select" or t.name in ENDS.get(stack[-1][0], ())):
                    pop()
            stack.append((t.name, i))
            depth[t.name] = depth.get(t.name, 0) + 1
    return found


def blocks(html: str | None) -> list[Block]:
    """Leaf blocks in page order."""
    html = html or ""
    out: list[Block] = []
    stack = [_Open("", 0, 0, 0)]
    depth: dict[str, int] = {}  # open elements by tag
    parts: list[str] = []
    linked = 0  # characters in links of this block
    in_link = False

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            if stack[-1].tag == "head" and not raw.isspace():
                end_head()
            parts.append(raw)
            if in_link:
                linked += len(raw.strip())

    def close_block() -> None:
        nonlocal linked, in_link
        if parts:
            line = " ".join(unescape("".join(parts)).split())
            if line:
                top = stack[-1]
                out.append(Block(line, 1 | top.inside | top.own | _shape(line, linked), top.label))
            parts.clear()
        linked, in_link = 0, False

    def pop() -> None:
        depth[stack.pop().tag] -= 1

    def end_head() -> None:
        close_block()
        pop()

    tags = _tags(html)
    left_out = _left_out(tags) if any(t.name in LEFT_OUT for t in tags) else {}
    at, i = 0, 0
    while i < len(tags):
        t = tags[i]
        text(html[at : t.start])
        at = t.end
        i += 1
        tag, closing = t.name, t.closing
        if not tag:
            continue
        if stack[-1].tag == "head" and not closing and tag not in HEAD:
            end_head()
        if tag == "br" or (not closing and tag == "wbr"):
            parts.append(" ")
        elif tag == "a":
            in_link = not closing
        elif tag in LEFT_OUT and not closing:
            over = left_out.get(i - 1)
            if over is not None:
                at, i = tags[over].end, over + 1
            elif tag == "select":
                while i < len(tags) and tags[i].name not in BLOCK:
                    i += 1
                at = tags[i].start if i < len(tags) else len(html)
        elif tag in BLOCK:
            close_block()
            if closing:
                if depth.get(tag):
                    while stack[-1].tag != tag:
                        pop()
                    pop()
            elif tag not in VOID:
                while (ends := ENDS.get(stack[-1].tag)) and tag in ends:
                    pop()
                stack.append(_opened(tag, t.attrs, stack[-1]))
                depth[tag] = depth.get(tag, 0) + 1
    text(html[at:])
    close_block()
    return [b for b in out if not b.bits & _IN["head"]]


@lru_cache(maxsize=None)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*>", re.I)


def _shape(line: str, linked: int) -> int:
    words = line.count(" ") + 1
    s = _SHAPE
    bits = s["one_word"] if words == 1 else s["few_words"] if words < 6 else s["some_words"] if words < 25 else s["many_words"]
    if linked >= 0.8 * len(line):
        bits |= s["all_link"]
    elif linked >= 0.3 * len(line):
        bits |= s["half_link"]
    if line[-1] in ".!?\"')":
        bits |= s["stop"]
    if "," in line:
        bits |= s["comma"]
    if words < 60 and _TELLING.search(line):
        bits |= s["telling"]
    if not any(map(str.isalpha, line)):
        bits |= s["no_letter"]
    return bits


#: Layouts of the labelled pages. ``{s}`` is a short text, ``{l}`` a long one, ``{w}`` a word.
FRAMES = (
    "<header><a href='/'>{w}</a></header><nav><ul>{menu}</ul></nav>{ad}<article data-main='1'>{article}</article>{more}<footer>{foot}</footer>",
    "<nav><ul>{menu}</ul></nav>{ad}<article data-main='1'>{article}</article><footer>{foot}</footer>",
    "<div id='header'><p>{w} {w}</p><div class='menu'>{menu}</div></div><div id='content' data-main='1'>{article}</div><div id='sidebar'>{more}{links}</div><div class='footer'><p>{foot}</p></div>",
    "<div class='topbar'>{s}</div><div class='navbar'>{links}</div><main><div class='post-body' data-main='1'>{article}</div>{more}</main><div class='site-footer'>{foot}</div>",
    "{notice}<header><h2>{w}</h2><nav>{links}</nav></header><main data-main='1'>{article}</main>{more}<aside>{links}<p>{l}</p></aside><footer><p>{foot}</p></footer>",
    "<div class='wrapper'><div class='breadcrumbs'><a href='/'>{w}</a> / <a href='/'>{w}</a></div><section class='story' data-main='1'>{article}</section>{more}</div><div class='legal'>{foot}</div>",
    "<article data-main='1'><header><h1>{s}</h1></header>{article}</article>{more}{foot2}",
    "<main><article data-main='1'>{article}<section data-main='0' class='comments'><h3>{w}</h3><p>{l}</p><p>{l}</p></section></article></main><footer>{foot}</footer>",
)
ARTICLE = (
    "<h1>{s}</h1>", "<p>{l}</p>", "<p>{l}</p>", "<p>{l}</p>", "<p>{s}</p>", "<p>{w}.</p>", "<p><b>{l}<br>", "<h2>{s}</h2>", "<ul><li>{s}</li><li>{l}</li></ul>",
    "<blockquote><p>{l}</p></blockquote>", "<div>{l}</div>", "<p>{s} <a href='/x'>{w}</a> {l}</p>", "<table><tr><td>{s}</td><td>{w}</td></tr></table>", "<pre>{s}</pre>", "<section><p>{l}</p></section>",
)
INSIDE = (
    "<div data-main='0' class='ad'>{s}</div>", "<aside data-main='0'><p>{l}</p>{links}</aside>", "<div data-main='0' class='share-buttons'>{links}</div>", "<form data-main='0'><p>{s}</p><p>{w}</p></form>",
    "<div data-main='0' class='newsletter-signup'><p>{s}</p></div>", "<div data-main='0' class='related'><h3>{s}</h3><ul>{menu}</ul></div>", "<div data-main='0' class='comments'><p>{l}</p><p>{s}</p></div>",
    "<section data-main='0' id='comments'><h2>{s}</h2><div class='comment'><p>{l}</p></div><div class='comment'><p>{l}</p></div></section>", "<nav data-main='0'>{links}</nav>",
    "<div data-main='0' class='advertisement'><p>{l}</p></div>", "<div data-main='0' class='cookie-notice'><p>{l}</p></div>", "<footer data-main='0'><p>{s}</p></footer>", "<ul data-main='0' class='comment-list'><li>{l}</li></ul>",
)
MORE = (
    "", "<section class='comments'><h3>{w}</h3><p>{l}</p><p>{l}</p></section>", "<div id='comments'><div class='comment'><p>{l}</p></div></div>", "<aside><h3>{s}</h3><p>{l}</p></aside>",
    "<div class='sidebar'><p>{l}</p>{links}</div>", "<form action='/s'><p>{s}</p></form>", "<div class='related-posts'>{links}</div>", "<div class='ad'>{l}</div>", "<div class='promo'><p>{l}</p></div>",
)
NOTICES = ("", "<div class='cookie-banner'><p>{l}</p></div>", "<div id='consent'>{s}</div>", "<div role='alert' class='notice'><p>{s}</p></div>", "<dialog><p>{s}</p></dialog>")
ADS = ("", "<div class='ad'>{s}</div>", "<div class='ads'><p>{l}</p></div>", "<div id='banner-ad'>{s}</div>")


def labelled_pages(count: int = 400, seed: int = 7) -> list[str]:
    """Pages of invented words whose elements carry ``data-main``."""
    r = random.Random(seed)
    syllables = "an ba che de er fi go ha in ka lo mi nu ou pa re si ta un ve éa ö".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    some = lambda a, b: " ".join(word() + ("," if r.random() < 0.08 else "") for _ in range(r.randint(a, b)))

    def fill(template: str) -> str:
        def put(m: re.Match) -> str:
            kind = m[1]
            if kind == "w":
                return word()
            if kind == "s":
                return some(2, 9).capitalize() + r.choice(["", ".", ".", "!"])
            if kind == "l":
                return " ".join(some(4, 14).capitalize() + "." for _ in range(r.randint(1, 5)))
            if kind == "menu":
                return "".join(f"<li><a href='/{word()}'>{word()}</a></li>" for _ in range(r.randint(2, 7)))
            if kind == "links":
                return "".join(f"<a href='/{word()}'>{some(1, 4)}</a> " for _ in range(r.randint(2, 6)))
            if kind == "article":
                body = [r.choice(ARTICLE) for _ in range(r.randint(1, 14))]
                if r.random() < 0.7:
                    body[0] = ARTICLE[0]
                if r.random() < 0.45:
                    body.insert(r.randint(0, len(body)), r.choice(INSIDE))
                return fill("".join(body))
            if kind == "more":
                return fill("".join(r.choice(MORE) for _ in range(r.randint(0, 2))))
            if kind == "notice":
                return fill(r.choice(NOTICES))
            if kind == "ad":
                return fill(r.choice(ADS))
            if kind == "foot2":
                return fill("<footer><p>&copy; {s}</p></footer>")
            return fill(r.choice(["&copy; {w}.example &middot; {l}", "{s} <a href='/t'>{w}</a>", "&copy; {s}", "{l}"]))

        return re.sub(r"{(w|s|l|menu|links|article|more|notice|ad|foot2|foot)}", put, template)

    return [f"<html><head><title>{word()}</title></head><body>{fill(r.choice(FRAMES))}</body></html>" for _ in range(count)]


def _row(bits: int) -> np.ndarray:
    return np.array([bits >> i & 1 for i in range(len(NAMES))], dtype=np.float32)


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    steps: tuple[tuple[float, ...], ...]


def train(pages: list[str]) -> Model:
    """The field that fits labelled pages."""
    chains = [c for p in pages if (c := blocks(p))]
    w, s = chain.train([np.stack([_row(b.bits) for b in c]) for c in chains], [np.array([b.label for b in c]) for c in chains], np.array([len(c) for c in chains], float), turns=500, rate=0.1, ridge=1e-4)
    return Model(tuple(w.tolist()), tuple(map(tuple, s.tolist())))


@lru_cache(maxsize=1)
def default_model() -> Model:
    return train(labelled_pages())


def main_text(html: str | None, model: Model, memory: dict[int, float] | None = None) -> str:
    found = blocks(html)
    memory = {} if memory is None else memory
    for b in found:
        if b.bits not in memory:
            memory[b.bits] = sum(w for i, w in enumerate(model.weights) if b.bits >> i & 1)
    labels = chain.viterbi([memory[b.bits] for b in found], [list(row) for row in model.steps])
    return "\n".join(b.text for b, keep in zip(found, labels) if keep)


def extract(html: Column | str, model: Model | None = None) -> Column:
    """Main text of a page."""
    model = model or default_model()

    @F.arrow_udf("string")
    def run(v: pa.Array) -> pa.Array:
        memory: dict[int, float] = {}
        return pa.array([main_text(h.as_py(), model, memory) for h in v], pa.string())

    return run(html)
