"""Main text of web pages by a maximum-scoring subsequence (operator 7).

A page is a sequence of tokens, words and tags. Words score positive and tags negative; a linear scan finds the
contiguous stretch with the greatest sum, which is the content region. Both scores are weights learned from labelled
pages (a few built-in ones, or the caller's). A word's weight is the log-odds of being main text, by logistic regression
on where it stands: inside a link or not, in what kind of block, under what kind of named container, if any. A tag costs
the more, the more often labelled pages have it outside of main text, so lists of links, bare lines and other short
blocks between many tags lose, whatever their containers are called.

Inside the region a block whose words weigh negative, such as an advert or a list of links, is left out of the text.
Words under containers that are no main text anywhere cost the scan little, and nothing inside an article, so that it can
bridge them.
"""

from __future__ import annotations

import functools
import html as _entities
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pathloom.llm.bpe import _arrow
from pathloom.llm.common import batch

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_NAMES = re.compile(r"[a-z]+")

# Element names of HTML.
_SKIPPED = frozenset("script style noscript template head title iframe object svg math canvas audio video select option textarea button".split())
_RAW = frozenset("script style textarea title noscript iframe".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSED_BY_BLOCK = _BLOCKS - {"br"}
#: Containers by element, and by a word of their class, id or role.
_BY_TAG = {"nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "sidebar", "form": "form", "fieldset": "form", "dialog": "notice", "article": "article", "main": "article"}
_BY_NAME = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs tablist",
    "header": "header masthead banner topbar",
    "footer": "footer copyright contentinfo colophon",
    "sidebar": "sidebar aside related recommended widget complementary",
    "notice": "cookie cookies consent notice alert popup modal newsletter subscribe overlay gdpr",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion",
    "form": "form login signup search",
    "comment": "comment comments disqus replies reply respond",
    "share": "share sharing social",
    "article": "article content entry post story main",
}
_KIND_OF = {w: kind for kind, names in _BY_NAME.items() for w in names.split()}

#: What a block is to the weights; other blocks are plain containers.
_UNIT = {**dict.fromkeys("p blockquote pre figcaption".split(), "p"), **dict.fromkeys("h1 h2 h3 h4 h5 h6".split(), "h"), **dict.fromkeys("li dt dd option".split(), "li"), **dict.fromkeys("td th caption".split(), "td")}

#: Labelled pages to learn from: M(...) marks main text. They show common layouts, not one site's; {w} and {s} are fillers.
_WORDS = "the quick survey of river towns shows that older mills were built where water fell and roads met"
_SHORT = "see the old mill"
_LINKS = "".join(f"<li><a>{x}</a></li>" for x in ("home", "news", "about us", "more towns", "contact"))
_LABELLED = [
    "<body><header><h2>site name here</h2><nav><ul>{l}</ul></nav></header><article><h1>M({s})</h1><p>M({w} {w})</p><p>M({w} <b>bold</b> {w})</p><ul><li>M({s})</li><li><a>M({s})</a></li></ul><p>M({s})</p></article><aside class=related><ul><li><a>more like this</a></li></ul></aside><p>{s}</p><footer>all rights reserved <a>terms</a></footer></body>",
    "<body><div id=nav><a>home</a><a>products</a></div><div class=ad>buy this lamp now cheap</div><div class=content><h1>M({s})</h1><p>M({w})</p><ul><li>M({w})</li><li>M({s})</li></ul><div class=promo>subscribe today</div><div>M({w} {s})</div><p>M({w} {w})</p></div><div class=comments><p>nice post thanks</p><p>i agree with {s}</p></div><div>{s}</div><div id=footer>copyright</div></body>",
    "<body><nav><ul>{l}</ul></nav><div class=cookie-notice>we use cookies <a>ok</a></div><main><p>M({w} {w})</p><blockquote>M({w})</blockquote><form>email <input> send</form><p>M({w} <a>{s}</a> {w})</p><table><tr><td>M({s})</td><td>M({w})</td></tr></table></main><section class=comments><p>first {w}</p></section><footer><p>imprint {s}</p></footer></body>",
    "<body><div class=topbar>login signup</div><p>M({w} {w})</p><p>M({w} <i>so</i> {w})</p><p>M({w})</p><div class=sidebar><h3>archive</h3><a>may</a></div><div class=share><a>tweet</a></div><div class=footer>contact us</div></body>",
    "<body><div><div>{s}</div><ul>{l}{l}</ul></div><div><h1>M({s})</h1><p>M({w} {w} {w})</p><p>M({w} <a>M({s})</a> {w})</p><h2>M({s})</h2><p>M({w} {w})</p></div><div><div>archive</div><ul>{l}{l}</ul></div><div><span>{s}</span><span>{s}</span></div></body>",
    "<body><table><tr><td><a>home</a></td><td><a>news</a></td></tr></table><div>M({w} {w})<br>M({w} {w} {w})<br><br>M({w} {w})</div><div><a>older</a><a>newer</a></div><div>{s}</div></body>",
    "<body><div><a>{s}</a></div><div><div><h1>M({s})</h1><h2>M({s})</h2><p>M({w})</p><ul><li>M({w})</li><li>M({w} <a>M({s})</a>)</li></ul><p>M({w} {w})</p></div></div><div><h3>{s}</h3><ul>{l}{l}</ul></div><div><div>{s}</div></div></body>",
]


class Token:
    """A stretch of text or a tag: the kind of the innermost special container around it, its block and whether it is linked.

    nested: the container lies inside an article.
    """

    __slots__ = ("kind", "link", "marked", "nested", "tag", "text", "unit", "words")

    def __init__(self, tag: str, text: str, kind: str, words: int, unit: str = "div", link: bool = False, nested: bool = False, marked: bool = False):
        self.tag, self.text, self.kind, self.words, self.unit, self.link, self.nested, self.marked = tag, text, kind, words, unit, link, nested, marked


def _container(tag: str, attributes: str) -> str:
    if tag in _BY_TAG:
        return _BY_TAG[tag]
    if attributes and tag not in ("body", "html", "p", "h1", "a"):
        for _, value in _ATTRIBUTE.findall(attributes):
            for name in _NAMES.findall(value.lower()):
                if name in _KIND_OF:
                    return _KIND_OF[name]
    return ""


def tokens(page: str) -> list[Token]:
    """Tokens of a page. Comments, declarations and the contents of scripts, styles and form controls give none.

    Tags may be unclosed or crossed: an end tag closes the nearest open element of its name, if there is one.
    """
    out: list[Token] = []
    stack: list[tuple] = []  # tag, and what held outside of it: kind, unit, links open, nested
    kind, unit, links, nested, hidden, at, lower = "", "div", 0, False, 0, 0, None
    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text and not hidden:
            out.append(Token("", text, kind, len(text.split()), unit, links > 0, nested))
        if not m:
            return out
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA[") and not hidden:
                body = m[0][9:].removesuffix("]]>")
                out.append(Token("", _entities.escape(body), kind, len(body.split()), unit, links > 0, nested))
            continue
        tag = tag.lower()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    hidden -= sum(x[0] in _SKIPPED for x in stack[k:])
                    _, kind, unit, links, nested = stack[k]
                    del stack[k:]
                    break
            if not hidden:
                out.append(Token("/" + tag, "", kind, 0, unit, links > 0, nested))
            continue
        if tag in _RAW:
            if lower is None:
                lower = page.lower()
            end = lower.find("</" + tag, at) if len(lower) == len(page) else _find_end(page, tag, at)
            at = len(page) if end < 0 else (page.find(">", end) + 1 or len(page))
            continue
        if not hidden:
            out.append(Token(tag, "", kind, 0, unit, links > 0, nested))
        if tag in _VOID or m[3].rstrip().endswith("/"):
            continue
        if tag == "body":  # a body that opens after an unclosed head starts anew
            stack, hidden, kind, unit, links, nested = [], 0, "", "div", 0, False
        stack.append((tag, kind, unit, links, nested))
        hidden += tag in _SKIPPED
        links = links + 1 if tag == "a" else 0 if tag in _BLOCKS and tag not in ("li", "p") and not _UNIT.get(tag) else links
        unit = _UNIT.get(tag, "div") if tag in _BLOCKS else unit
        own = _container(tag, m[3])
        if own and not (own == "article" and kind not in ("", "article")) and not (own == "header" and kind == "article" and tag == "header"):
            # a header inside an article is the article's own
            nested = nested or (kind == "article" and own != "article")
            kind = own


def _find_end(page: str, tag: str, at: int) -> int:
    m = re.compile("</" + tag, re.I).search(page, at)
    return m.start() if m else -1


#: Kinds of containers that are no main text on any labelled page.
_NEVER = {*_BY_TAG.values(), *_BY_NAME} - {"article"}


def _features(t: Token, own: bool) -> tuple[str, ...]:
    """What the weight of a word depends on; own: the page has article containers."""
    kind = "outside" if own and t.kind == "" else t.kind
    return ("", "kind " + kind, "unit " + t.unit, *(("link", f"link {kind}", f"link {t.unit}") if t.link else ()))


def _has_article(page: list[Token]) -> bool:
    return any(t.kind == "article" and t.words for t in page)


class Weights:
    """Log-odds of main text for words by where they stand, and costs of tags by name, inside and outside of articles.

    limit: the greatest weight of a word; tag_cost: the cost of a tag that is as common inside as outside; ridge: how far
    the regression is held back.
    """

    def __init__(self, labelled: list[list[Token]], limit: float = 2.0, tag_cost: float = 1.5, ridge: float = 0.3, smooth: float = 0.5):
        rows: list[tuple[tuple[str, ...], int, bool]] = []
        tag_in, tag_out = Counter(), Counter()
        for page in labelled:
            own = _has_article(page)
            marked = [i for i, t in enumerate(page) if t.marked]
            for i, t in enumerate(page):
                if t.tag:
                    inside = bool(marked) and marked[0] - 2 <= i <= marked[-1] + 2 and t.kind in ("", "article")
                    for name in (t.tag.lstrip("/"), ""):
                        (tag_in if inside else tag_out)[name, t.kind == "article"] += 1
                elif t.words:
                    rows.append((_features(t, own), t.words, t.marked))
        names = sorted({f for r in rows for f in r[0]} | {"kind " + k for k in _NEVER})
        place = {f: k for k, f in enumerate(names)}
        x = np.zeros((len(rows), len(names)))
        for k, r in enumerate(rows):
            x[k, [place[f] for f in r[0]]] = 1
        y, w = np.array([float(r[2]) for r in rows]), np.sqrt(np.array([float(r[1]) for r in rows]))
        beta = np.zeros(len(names))
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(names)), x.T @ (w * (p - y)) + ridge * beta)
            beta -= step
            if np.abs(step).max(initial=0.0) < 1e-9:
                break
        self.beta, self.limit = dict(zip(names, beta.tolist(), strict=True)), limit
        self.known: dict[tuple, float] = {}
        # a tag never scores above zero: the odds only tell how much it costs
        odds = {t: math.log((tag_in[t] + smooth) / (tag_out[t] + smooth)) for t in {*tag_in, *tag_out}}
        self.tag = {t: -2 * tag_cost / (1 + math.exp(max(-30.0, min(30.0, o)))) - 0.1 for t, o in odds.items()}

    def word(self, t: Token, own: bool) -> float:
        """Weight of one word of a stretch of text; below zero under containers that are never main text."""
        key = (t.kind, t.unit, t.link, own)
        got = self.known.get(key)
        if got is None:
            got = sum(self.beta.get(f, 0.0) for f in _features(t, own))
            got = max(-self.limit, min(self.limit, got))
            self.known[key] = got = min(got, -0.25) if t.kind in _NEVER else got
        return got

    def of(self, t: Token, own: bool) -> float:
        """Score of a token for the scan: stretches that the text leaves out anyway cost little, inside an article nothing."""
        if t.nested:
            return 0.0
        if t.tag:
            article = t.kind == "article"
            return self.tag.get((t.tag.lstrip("/"), article)) or self.tag.get(("", article), -1.0)
        return t.words * (max(self.word(t, own), -0.25) if t.kind in _NEVER else self.word(t, own))


def region(page: list[Token], weights: Weights) -> tuple[int, int]:
    """Bounds of the contiguous stretch with the greatest sum (one linear scan); (0, 0) if no stretch is above zero."""
    own = _has_article(page)
    best, bounds, total, start = 0.0, (0, 0), 0.0, 0
    for i, t in enumerate(page):
        if total <= 0:
            total, start = 0.0, i
        total += weights.of(t, own)
        if total > best:
            best, bounds = total, (start, i + 1)
    return bounds


_WHITE = re.compile(r"\s+")


def extract(page: str | None, weights: Weights, scan: bool = True) -> str:
    """Main text: blocks in page order joined by one newline; empty for null and for pages without content.

    Without ``scan`` the whole page is the region (to tell what the scan does).
    """
    if not page:
        return ""
    seq = tokens(page)
    own = _has_article(seq)
    a, b = region(seq, weights) if scan else (0, len(seq))
    blocks: list[str] = []
    held: list[str] = []
    score = 0.0

    def close() -> None:
        nonlocal score
        text = _WHITE.sub(" ", _entities.unescape("".join(held))).strip()
        if text and score > 0:
            blocks.append(text)
        held.clear()
        score = 0.0

    for t in seq[a:b]:
        if t.tag:
            if t.tag.lstrip("/") in _BLOCKS:
                close()
        elif t.kind not in _NEVER:
            held.append(t.text)
            score += t.words * weights.word(t, own)
    close()
    return "\n".join(blocks)


def marked(page: str) -> list[Token]:
    """Tokens of a labelled page, in which ``M(`` and ``)`` mark main text."""
    out, inside = [], False
    for t in tokens(page):
        if t.tag:
            t.marked = False
            out.append(t)
            continue
        for piece in re.split(r"(M\(|\))", t.text):
            if piece == "M(":
                inside = True
            elif piece == ")":
                inside = False
            elif piece.strip():
                out.append(Token("", piece, t.kind, len(piece.split()), t.unit, t.link, t.nested, inside))
    return out


@functools.lru_cache(4)
def learned(pages: tuple[str, ...] = ()) -> Weights:
    """Weights from labelled pages; the built-in ones if none are given."""
    return Weights([marked(p) for p in (pages or tuple(p.replace("{l}", _LINKS).replace("{w}", _WORDS).replace("{s}", _SHORT) for p in _LABELLED))])


def extract_table(pages: DataFrame, labelled: tuple[str, ...] = (), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows ``(id, url, text, n_chars)`` for every page, no shuffle; whole pages, nothing dropped or capped."""
    kind = pages.schema[id_col].dataType
    out = pa.schema([(id_col, _arrow(kind)), (url_col, pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        weights = learned(labelled)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                s = b.slice(k, 512)
                texts = [extract(h.as_py(), weights) for h in s.column(2)]
                yield batch({id_col: s.column(0), url_col: s.column(1), "text": texts, "n_chars": [len(t) for t in texts]}, out)

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"{id_col} {kind.simpleString()}, {url_col} string, text string, n_chars long")
