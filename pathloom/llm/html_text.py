"""Main text of HTML pages by composite text density."""

from __future__ import annotations

import html
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn del em font i img ins kbd label mark q rp rt ruby "
                   "s samp small span strike strong sub sup time tt u var wbr".split())
BLOCK_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
                           "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSED_BY_SAME = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table",
                  "option": "select", "thead": "table", "tbody": "table", "tfoot": "table"}
SIBLINGS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th",
            "option": "option", "thead": "thead tbody tfoot tr td th", "tbody": "thead tbody tfoot tr td th",
            "tfoot": "thead tbody tfoot tr td th"}

# never part of an article
LEFT_OUT = frozenset("head nav aside footer button select input object embed canvas dialog menu".split()) | RAW
# left out by name: whole tokens, alone or put together of such words only ('cookie-banner', 'related-posts')
_WORD = (r"(?:nav|navbar|navigation|menu|menubar|breadcrumbs?|sidebar|side|aside|complementary|footer|contentinfo|"
         r"masthead|banner|ads?|advert|adverts|advertisement|adsense|adbox|sponsor|sponsored|promo|promotion|cookies?|consent|"
         r"gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|social|related|"
         r"recommended|comments?|commentlist|disqus|replies|reply|respond|widget|toolbar|pagination|pager|skip|hidden)")
LEFT_OUT_TOKEN = re.compile(
    rf"{_WORD}(?:[_-]{_WORD})*(?:[_-](?:posts|links?|buttons?|list|box|bar|area|form))?[_-]?\d*"
    r"|(?:(?:site|page|global|top)[_-]?)?header", re.I)
NOT_THE_ARTICLE = re.compile(r"(?:comments?|replies|reply|related|promo|sponsored|ads?|advert|teaser)"
                             r"(?:[_-](?:body|item|content|card|post))?[_-]?\d*", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BODY_SIZED = 2 / 3  # of the page's characters: what holds as many is no boilerplate by its name
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
ARTICLE_ROLES = re.compile(r"(?:^|\s)(?:main|article|article-?body)(?:$|\s)", re.I)


class Page:
    """DOM of a page: parallel lists by node in document order (a parent before its children)."""

    def __init__(self, source: str):
        self.tag, self.parent, self.holder = ["#root"], [-1], [False]
        self.named = [False]  # boilerplate by its names, if nothing speaks against it
        self.texts: list[tuple[int, str]] = []  # (node, text); text None parts blocks
        stack = [0]
        at, end = 0, len(source)
        while at < end:
            m = TOKEN.search(source, at)
            self._text(stack[-1], source[at:m.start() if m else end])
            if not m:
                break
            at = m.end()
            name = m["name"]
            if name is None:
                continue
            name = name.lower()
            if m["close"]:
                self._close(stack, name)
                continue
            self._implied(stack, name)
            rest = m["rest"]
            if name == "br" or name not in INLINE:
                self.texts.append((stack[-1], None))
            if name in RAW:
                done = re.compile(rf"</{re.escape(name)}\s*[^>]*>", re.I).search(source, at)
                if not rest.rstrip().endswith("/") or name not in ("svg", "math"):
                    at = done.end() if done else end
                continue
            node = self._open(name, rest, stack[-1])
            if name not in VOID and not (rest.rstrip().endswith("/") and name in INLINE):
                stack.append(node)
        self.out = self._left_out(True)

    def _text(self, node: int, raw: str) -> None:
        if raw:
            self.texts.append((node, html.unescape(raw)))

    def _open(self, name: str, rest: str, parent: int) -> int:
        marks = {k.lower(): CAMEL.sub("-", v.strip("\"'")) for k, v in ATTRIBUTE.findall(rest)} if rest else {}
        holder = name in ("article", "main") or any(
            ARTICLE_ROLES.search(marks.get(k, "")) for k in ("role", "itemprop"))
        if holder:
            named = any(map(NOT_THE_ARTICLE.fullmatch, marks.get("class", "").split()))
        else:
            named = name not in HEADINGS and any(LEFT_OUT_TOKEN.fullmatch(t) for v in marks.values() for t in v.split())
        self.tag.append(name)
        self.parent.append(parent)
        self.holder.append(holder)
        self.named.append(named)
        return len(self.tag) - 1

    def _left_out(self, names: bool) -> list[bool]:
        """Nodes outside the article by tag and, with ``names``, by class, id, role or itemprop.

        Names, <form> and <header> don't count for what holds an article or most of the page."""
        n = len(self.tag)
        never, within, chars, big = [False] * n, [False] * n, [0] * n, [False] * n
        for v in range(1, n):
            p = self.parent[v]
            never[v] = never[p] or self.tag[v] in LEFT_OUT
            within[v] = within[p] or self.holder[p]
        for v, text in self.texts:
            if text is not None and not never[v]:
                chars[v] += len("".join(text.split()))
        for v in range(n - 1, 0, -1):
            p = self.parent[v]
            chars[p] += chars[v]
            big[p] |= big[v] or (self.holder[v] and not self.named[v] and not never[v])
        out = [False] * n
        for v in range(1, n):
            weak = (names and self.named[v] and self.tag[v] not in ("html", "body")) or self.tag[v] == "form" or (
                self.tag[v] == "header" and not self.holder[v] and not within[v])
            out[v] = out[self.parent[v]] or never[v] or (
                weak and not big[v] and not 0 < BODY_SIZED * chars[0] <= chars[v])
        return out

    def _line(self, node: int):
        while node > 0:
            yield node
            node = self.parent[node]

    def _close(self, stack: list[int], name: str) -> None:
        if name == "br":
            return
        for depth in range(len(stack) - 1, 0, -1):
            if self.tag[stack[depth]] == name:
                if name not in INLINE:
                    self.texts.append((stack[depth], None))
                del stack[depth:]
                return
            if name in INLINE and self.tag[stack[depth]] not in INLINE:
                return

    def _implied(self, stack: list[int], name: str) -> None:
        """End tags that a start tag stands for."""
        if name in SIBLINGS:
            ends, stops = SIBLINGS[name].split(), CLOSED_BY_SAME[name].split()
        elif name in BLOCK_CLOSES_P:
            ends, stops = ["p"], ["td", "th", "li", "div", "article", "section", "body", "blockquote", "button", "object"]
        else:
            return
        cut = None
        for depth in range(len(stack) - 1, 0, -1):
            if self.tag[stack[depth]] in ends:
                cut = depth
            elif self.tag[stack[depth]] in stops:
                break
        if cut is not None:
            self.texts.append((stack[cut], None))
            del stack[cut:]

    def densities(self) -> tuple[list[int], list[float], list[float]]:
        """Characters of each subtree, its composite density, and the sum of its children's."""
        n = len(self.tag)
        chars, link_chars, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for v in range(1, n):
            in_link[v] = self.tag[v] == "a" or in_link[self.parent[v]]
        for v, text in self.texts:
            if text is not None and not self.out[v]:
                c = len("".join(text.split()))
                chars[v] += c
                if in_link[v]:
                    link_chars[v] += c
        for v in range(n - 1, 0, -1):
            if self.out[v]:
                continue
            p = self.parent[v]
            chars[p] += chars[v]
            link_chars[p] += link_chars[v]
            tags[p] += tags[v] + 1
            link_tags[p] += link_tags[v] + (self.tag[v] == "a")
        body_links = link_chars[0] / max(1, chars[0])
        density, total = [0.0] * n, [0.0] * n
        for v in range(n - 1, -1, -1):
            if not self.out[v] and chars[v]:
                c, lc, t, lt = chars[v], max(1, link_chars[v]), max(1, tags[v]), max(1, link_tags[v])
                base = math.log(c / max(1, c - link_chars[v]) * link_chars[v] + body_links * c + math.e)
                density[v] = c / t * math.log(max(1.0, c / lc * t / lt)) / math.log(max(base, 1.0001)) + c / t * 1e-3
                if v:
                    total[self.parent[v]] += density[v]
        return chars, density, total

    def content(self) -> list[int]:
        """Roots of the subtrees that make up the article.

        The subtree with the largest density sum, widened to the outermost article element
        around it.  Without one: from the body down, every subtree at least as dense as the
        thinnest node on the way from the body to that one gives its own largest."""
        chars, density, total = self.densities()
        score = [total[v] + density[v] * 1e-6 for v in range(len(self.tag))]
        if not chars[0]:
            return []
        size = self._sizes()

        def largest(v: int) -> int:
            return max(range(v, v + size[v]), key=lambda u: (score[u] if chars[u] and not self.out[u] else -1.0, -u))

        best = largest(0)
        holders = [v for v in self._line(best) if self.holder[v]]
        if holders:
            return ([v for v in holders if self.tag[v] == "article"] or holders)[-1:]
        top = next((v for v in range(len(self.tag)) if self.tag[v] == "body"), 0)
        line = list(self._line(best)) + [0]
        threshold = min(density[v] for v in line if v >= top) if best >= top else density[0]
        roots, todo = [], [top if best in range(top, top + size[top]) else 0]
        children: dict[int, list[int]] = {}
        for v in range(1, len(self.tag)):
            children.setdefault(self.parent[v], []).append(v)
        while todo:
            v = todo.pop()
            if self.out[v] or not chars[v] or density[v] < threshold:
                continue
            d = largest(v)
            roots.append(d)
            while d != v:
                p = self.parent[d]
                todo += [c for c in children.get(p, []) if c != d]
                d = p
        return roots

    def _sizes(self) -> list[int]:
        size = [1] * len(self.tag)
        for v in range(len(self.tag) - 1, 0, -1):
            size[self.parent[v]] += size[v]
        return size

    def text(self) -> str:
        """Text of the article: white space as one space, blocks in page order.  When names
        leave no text, they don't count."""
        found = self._article()
        if not found and any(self.named):
            self.out = self._left_out(False)
            found = self._article()
        return found

    def _article(self) -> str:
        size = self._sizes()
        spans = [(r, r + size[r]) for r in self.content()]
        inside = [False] * len(self.tag)
        for a, b in spans:
            inside[a:b] = [True] * (b - a)
        parts = [" " if t is None else t for v, t in self.texts if t is None or (inside[v] and not self.out[v])]
        return " ".join("".join(parts).split())


def main_text(source: str | None) -> str:
    return Page(source).text() if source else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    The text is the article of the whole page without menus, headers, footers, sidebars,
    notices, adverts, forms, scripts, styles and reader comments.  Missing, empty and
    textless pages give an empty text.  Broken markup is read as browsers do in the main:
    missing end tags are implied, what never ends runs to the end of the page.  Repeated rows
    are read each; page_id and url may be missing; an empty table gives no rows; other
    columns go.
    """
    def run(batches):
        for pdf in batches:
            text = [main_text(h) for h in pdf.pop("html")]
            yield pdf.assign(text=text, n_chars=[len(t) for t in text])
    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op2_html_text": op2_html_text}
