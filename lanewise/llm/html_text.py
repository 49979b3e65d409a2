"""Main text of web pages by composite text density (Sun, Song and Liao, 2011).

A page becomes arrays of elements in page order. What names itself as no part of an article is left out. For every other element the
characters per tag, adjusted for links, are its density; the element whose children's densities have the largest sum is the text's subtree.
The least density on its way to the body is the threshold from which parts beside it belong to the text too.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)"
    r"((?:[\s/]++|=*+[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]*+))?+|=++)*+)>|<[!?/][^>]*+>|<[a-zA-Z!?/].*",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"(?:^|[\s/\"'])(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*))|(?=[\s/]|$))", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

# Fixed values of HTML: elements without content, with raw text, that make blocks, and that a start tag closes.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_CELL = frozenset("td th caption table button object template body html".split())
_CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "tbody": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead")}
_KEEPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: As in browsers, elements below this depth are siblings.
_DEPTH = 512

#: Elements, roles and parts of class names and ids that say: no part of an article.
_NO_TEXT = frozenset("head script style title textarea xmp iframe noembed noframes noscript template nav aside footer button select datalist menu dialog svg math object applet canvas audio video map search".split())
_NO_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status".split())
_NO_NAME = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adbox adslot adunit sponsor sponsored sponsors promo promos promotion banner sidebar sidebars aside "
    "widget widgets menu menus nav navbar navigation subnav breadcrumb breadcrumbs footer footers masthead topbar toolbar cookie cookies consent gdpr notice notices notification notifications "
    "alert alerts popup popups modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations recirculation "
    "comment comments commentlist disqus respond reply replies discussion pagination pager skip searchform outbrain taboola paywall".split()
)
#: An article element is left out only if it calls itself one of these.
_COMMENT = frozenset("comment comments reply replies".split())
#: Words beside "header" in a name that make it a header of the text, and words that make a name say something about the page around.
_OF_TEXT, _NO_NOUN = frozenset("article entry post story content main body title section".split()), frozenset("has with no open".split())


def _names_itself(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element says that it is no text, that it is a header, and that it is the text."""
    drop, header, main = tag in _NO_TEXT or tag == "form", tag == "header", tag in ("article", "main")
    for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), next(filter(None, values), "")
        if name in ("class", "id"):
            for word in value.split():
                parts = {p.lower() for p in _PART.findall(word)} | {word.lower()}
                if not parts & _NO_NOUN:
                    drop |= not parts.isdisjoint(_COMMENT if tag in ("article", "main") else _NO_NAME)
                    header |= "header" in parts and parts.isdisjoint(_OF_TEXT)
        elif name == "role":
            drop |= value.strip().lower() in _NO_ROLE
            main |= value.strip().lower() in ("main", "article")
        elif name == "itemprop":
            main |= value.strip().lower() == "articlebody"
        elif name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true"):
            drop = True
        elif name == "style":
            drop |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE))
    return drop, header and tag not in ("article", "main"), main and not drop


class Page:
    """Elements in page order (the parent before its children) and the texts between tags, with the number of the block each is in."""

    def __init__(self, html: str) -> None:
        self.tags, self.parents, self.says, self.texts = ["body"], [-1], [(False, False, False)], []
        self.blocks, self._stack, self._open = 0, [0], Counter(body=1)
        at = 0
        while match := _TOKEN.search(html, at):
            self._text(html[at : match.start()])
            at = match.end()
            if match[0].startswith("<![CDATA["):
                self._text(match[0][9:].removesuffix("]]>"))
            elif match[2]:
                tag = match[2].lower()
                if match[1]:
                    self._end(tag)
                elif self._start(tag, match[3]) and tag in _RAW:
                    at = end.start() if (end := re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(html, at)) else len(html)
        self._text(html[at:])

    def _text(self, text: str) -> None:
        if text:
            self.texts.append((self._stack[-1], self.blocks, unescape(text) if "&" in text else text))

    def _pop_to(self, depth: int) -> None:
        for node in self._stack[depth:]:
            self._open[self.tags[node]] -= 1
        del self._stack[depth:]

    def _close(self, names: tuple[str, ...], stops: frozenset | tuple) -> None:
        """Close the innermost open element of those names, unless an element of ``stops`` is between."""
        if any(self._open[n] for n in names):
            for depth in range(len(self._stack) - 1, 0, -1):
                tag = self.tags[self._stack[depth]]
                if tag in names:
                    return self._pop_to(depth)
                if tag in stops:
                    return None
        return None

    def _start(self, tag: str, attributes: str) -> bool:
        if tag in ("html", "body"):
            self._close(("head",), ())
            return False
        if tag in _BLOCK:
            self.blocks += 1
            if tag not in ("tr", "td", "th", "tbody", "thead", "tfoot", "caption"):
                self._close(("p",), _CELL)
            if tag in _HEADINGS and self.tags[self._stack[-1]] in _HEADINGS:
                self._pop_to(len(self._stack) - 1)
            if tag != "head":
                self._close(("head",), ())
        if tag in ("tr", "tbody", "tfoot", "thead"):
            self._close(("td", "th"), ("table",))
        if tag in ("tbody", "tfoot", "thead"):
            self._close(("tr",), ("table",))
        if tag in _CLOSED_BY:
            self._close(_CLOSED_BY[tag], _KEEPS.get(tag, ("table",)) + ("table",))
        if tag == "br":
            self.texts.append((self._stack[-1], self.blocks, " "))
        self.tags.append(tag)
        self.parents.append(self._stack[-1])
        self.says.append(_names_itself(tag, attributes))
        if tag in _VOID:
            return False
        if len(self._stack) < _DEPTH:
            self._stack.append(len(self.tags) - 1)
            self._open[tag] += 1
        return True

    def _end(self, tag: str) -> None:
        if tag in _BLOCK:
            self.blocks += 1
        if tag == "br":
            self._start("br", "")
        if tag in ("html", "body") or not self._open[tag]:
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            own = self.tags[self._stack[depth]]
            if own == tag:
                return self._pop_to(depth)
            # A style that ends inside another block does not end that block; nothing ends its table cell from inside.
            if (own in _BLOCK and tag not in _BLOCK) or (own in ("td", "th", "caption") and tag not in ("table", "tr", "tbody", "thead", "tfoot")):
                return None
        return None


def densities(tags: list[str], parents: list[int], own: list[int], live: list[bool]) -> tuple[list[float], list[float], list[int]]:
    """Density and sum of the children's densities of every element, and its characters.

    ``own``: characters directly in an element. With C characters and T tags below it, LC of them in links and LT link tags,
    and those of the body, the density is ``C/T * ln(C/LC * T/LT) / max(1, ln ln(C/(C-LC) * LC + LC_body/C_body * C + e))``, numbers of 0 counting as 1.
    """
    size = len(tags)
    linked = [False] * size
    for k in range(1, size):
        linked[k] = linked[parents[k]] or tags[k] == "a"
    chars, below = list(own), [0] * size
    in_links, links = [c if a else 0 for c, a in zip(own, linked, strict=True)], [0] * size
    for k in range(size - 1, 0, -1):
        if live[k]:
            up = parents[k]
            chars[up] += chars[k]
            in_links[up] += in_links[k]
            below[up] += below[k] + 1
            links[up] += links[k] + (tags[k] == "a")
    share = in_links[0] / (chars[0] or 1)
    density, sums = [0.0] * size, [0.0] * size
    for k in range(size):
        c, t, lc, lt = chars[k], below[k] or 1, in_links[k], links[k]
        if live[k] and c:
            base = math.log(math.log(c / (c - lc or 1) * lc + share * c + math.e))
            density[k] = c / t * math.log(c / (lc or 1) * t / (lt or 1)) / max(1.0, base)
            if k:
                sums[parents[k]] += density[k]
    return density, sums, chars


def chosen(page: Page, live: list[bool], own: list[int], ends: list[int]) -> list[int]:
    """Elements whose subtrees are the text."""
    density, sums, chars = densities(page.tags, page.parents, own, live)
    best = max(range(len(sums)), key=lambda k: (live[k], sums[k], chars[k], k))
    path = [best]
    while path[-1]:
        path.append(page.parents[path[-1]])
    for kind in ("article", None):
        is_main = [live[k] and says[2] and (kind is None or page.tags[k] == kind) for k, says in enumerate(page.says)]
        around = [k for k in path if is_main[k]]
        if around:
            return around[:1]
        inside = [k for k in range(best, ends[best]) if is_main[k]]
        if inside and 2 * chars[top := max(inside, key=lambda k: (chars[k], -k))] >= chars[best]:
            return [top]
    threshold, found, on_path = min(density[k] for k in path), [best], set(path)
    for k in range(1, len(sums)):
        if live[k] and k not in on_path and page.parents[k] in path[1:] and ((density[k] >= threshold and chars[k]) or (page.tags[k] == "h1" and k < best)):
            found.append(k)
    return sorted(found)


def main_text(html: str) -> str:
    """The article's blocks, white space in them as one space, joined by empty lines; "" if there is no text."""
    page = Page(html)
    size = len(page.tags)
    ends, mains = list(range(1, size + 1)), [says[2] for says in page.says]
    for k in range(size - 1, 0, -1):
        ends[page.parents[k]] = max(ends[page.parents[k]], ends[k])
        mains[page.parents[k]] |= mains[k]
    own = [0] * size
    for node, _, text in page.texts:
        own[node] += sum(map(len, text.split()))
    total, within = sum(own), list(own)
    for k in range(size - 1, 0, -1):
        within[page.parents[k]] += within[k]
    for by_name in (True, False):
        live, in_main = [True] * size, [False] * size
        for k in range(1, size):
            tag, up, (drop, header, main) = page.tags[k], page.parents[k], page.says[k]
            in_main[k] = in_main[up] or main
            if tag == "form":
                drop = 2 * within[k] < total and by_name
            live[k] = live[up] and not ((tag in _NO_TEXT) or (by_name and (drop or (header and not in_main[k])) and not mains[k]))
        kept = [c if alive else 0 for c, alive in zip(own, live, strict=True)]
        if any(kept):
            break
    else:
        return ""
    inside = [False] * size
    for top in chosen(page, live, kept, ends):
        inside[top : ends[top]] = [True] * (ends[top] - top)
    blocks: dict[int, list[str]] = {}
    for node, block, text in page.texts:
        if inside[node] and live[node]:
            blocks.setdefault(block, []).append(text)
    return "\n\n".join(filter(None, (" ".join("".join(parts).split()) for parts in blocks.values())))


def main_texts(pages: DataFrame, html: str = "html") -> DataFrame:
    """For every row: ``given`` (a struct of its other columns), ``text`` and ``n_chars`` (code points).

    Left out are menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments, known by element, role or
    name, and what the densities leave out. Character references are decoded, white space in a block is one space, blocks are joined
    by an empty line; a line break is white space, table cells and list items are blocks. Html without elements is one block.
    Null html is empty; pages without text have the empty text. Repeated rows: each its own. Empty: no rows.
    """
    others = [c for c in pages.columns if c.lower() != html.lower()]
    kinds = StructType([f for f in pages.schema.fields if f.name in others])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("given"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["given", "text", "n_chars"])

    given = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(None).alias("none"))
    kinds = kinds if others else StructType([StructField("none", StringType())])
    schema = StructType([StructField("given", kinds), StructField("text", StringType()), StructField("n_chars", LongType())])
    return pages.select(given.alias("given"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("body")).mapInArrow(run, schema)


def page_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page, as :func:`main_texts` has them."""
    return main_texts(pages.select("page_id", "url", "html")).select("given.page_id", "given.url", "text", "n_chars")
