"""Main text of HTML pages by composite text density.

Each DOM node's density is its characters per tag, lowered by the share of them in links; a node's sum is that of its
children's densities, its own text counting as one. The node of the greatest sum is the heart of the page, and the
least density on the path from the body to it is the threshold: what stands beside that path and reaches it is content
too, and so are headings and short blocks that belong to what reaches it. Names of boilerplate - tags, roles, whole
class and id tokens - are weights on the densities below them; no tag makes anything content. Within the content, what
is weighted or a block of links has to reach the threshold as well.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import sliced, table, texts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup; of these, only what is text for a reader would matter, and none of it is.
RAW = "script|style|noscript|template|textarea|title|svg|math|iframe|object|select|xmp"
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul br".split()
)
#: What an element's start closes, as HTML leaves end tags out.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
#: Where that stops.
SCOPE = frozenset("body table ul ol dl div article section main aside nav header footer form".split())
#: Elements that a search for one to close has to look at.
_STOPS = SCOPE | {"p"} | frozenset().union(*CLOSES.values())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks of text, in contrast to those that group others.
PROSE = HEADINGS | frozenset("p ul ol dl pre blockquote table figure hgroup br hr".split())

#: Tags of boilerplate; a header is one where it is the page's, that is beside a page's other parts.
OUT_TAGS = frozenset("nav footer aside menu button head".split())
PARTS = frozenset("nav main article footer aside".split())
#: Names of boilerplate in a class or id. A token of them counts as a whole only: each of its parts is a name, a word that
#: says where one is (before it) or what of it this is (after it). So `has-sidebar` and `modal-page` are none.
_NAME = (
    r"(?:ads?|advert[a-z0-9]*|adsense|sponsor[a-z0-9]*|promo[a-z0-9]*|banner|sidebar|side-?bar|rail|nav[a-z0-9]*|menu|breadcrumbs?|pagination|pager|footer|masthead|site-?header|page-?header|cookies?[a-z0-9]*|consent|gdpr|notice|"
    r"notification|newsletter|subscribe|subscription|signup|login|social|share|sharing|comments?|commentlist|disqus|respond|replies|toolbar|skip-?link|(?:related|recommend[a-z0-9]*|trending|popular)[_-]?(?:posts?|articles?|stories|links?|items?|news))"
)
#: Names that may stand for a part of an article as well: they count against a block beside the content, not in it.
_MAYBE = r"(?:alert|related|recommend[a-z0-9]*|trending|popular|widget|copyright|legal|disclaimer|tags?-?list)"
#: What may hold a whole page: a form around everything, a page shown as an overlay.
_WRAPPER = r"(?:popup|modal|overlay|form|dialog)"
_WHERE = r"(?:site|page|main|global|primary|secondary|top|bottom|left|right|header|post|article|entry|blog|mobile|desktop|sticky|fixed|floating)"
_WHAT = r"(?:lists?|items?|box|bars?|links?|posts?|articles?|stories|sections?|area|block|container|wrapper|wrap|inner|buttons?|btn|icons?|form|left|right|top|bottom|primary|secondary|\d+)"


def _names(name: str) -> re.Pattern:
    return re.compile(rf"(?:^|\s)(?:{_WHERE}[_-]+)*{name}(?:[_-]+(?:{_NAME}|{name}|{_WHAT}))*(?=$|\s)", re.IGNORECASE)


OUT_NAMES, MAYBE_NAMES, WRAPPER_NAMES = _names(_NAME), _names(_MAYBE), _names(_WRAPPER)
OUT_ROLES = frozenset("navigation banner contentinfo complementary search alert menu menubar".split())
WRAPPER_ROLES = frozenset("form dialog alertdialog".split())

_TOKEN = re.compile(
    rf"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[(?:.*?\]\]>|.*\Z)|<({RAW})(?=[\s/>])[^<>]*>(?:.*?</\1\s*>|.*\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^\"'<>]++|\"[^\"<]*+\"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>|<[!?/][^<>]*>",
    re.IGNORECASE | re.DOTALL,
)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)

#: What a name of boilerplate and one that may be one weigh; nobody sees what weighs nothing.
NAMED, MAYBE, UNSEEN = 1e-4, 0.3, 0.0
#: The share of characters in links, and the number of links, from which on a block in the content has to reach the threshold.
LINK_SHARE, LINKS = 0.8, 2


def _weight(tag: str, attrs: str) -> tuple[float, bool]:
    """The element's own weight, and whether what weighs it down may hold a whole page."""
    weight, wrapper = (NAMED, False) if tag in OUT_TAGS else (NAMED, True) if tag in ("form", "dialog") else (1.0, False)
    if tag in ("html", "body") or not attrs:
        return weight, wrapper
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return UNSEEN, False
        if name in ("class", "id") and OUT_NAMES.search(value) or name == "role" and value.lower() in OUT_ROLES:
            weight, wrapper = NAMED, False
        elif weight > NAMED and (name in ("class", "id") and WRAPPER_NAMES.search(value) or name == "role" and value.lower() in WRAPPER_ROLES):
            weight, wrapper = NAMED, True
        elif weight > MAYBE and name in ("class", "id") and MAYBE_NAMES.search(value):
            weight = MAYBE
    return weight, wrapper


class Dom:
    """Nodes in document order: parent, tag, the end of the subtree, own weight, and the pieces of text with their nodes."""

    def __init__(self, page: str):
        self.parent, self.tag, self.end, self.weight, wrapper = [-1], ["#root"], [0], [1.0], [False]
        self.pieces: list[tuple[int, str]] = []
        stack, open_ = [0], Counter()
        stops: list[int] = []  # places in the stack of elements of _STOPS
        at = 0

        def close(k: int) -> None:
            for n in stack[k:]:
                self.end[n] = len(self.tag)
                open_[self.tag[n]] -= 1
            del stack[k:]
            while stops and stops[-1] >= k:
                stops.pop()

        for m in _TOKEN.finditer(page):
            if m.start() > at:
                self.pieces.append((stack[-1], page[at : m.start()]))
            at = m.end()
            tag = m[3] or m[6]
            if not tag:
                continue
            tag, attrs = tag.lower(), m[4] or m[7] or ""
            if tag in BLOCK:
                self.pieces.append((stack[-1], " "))
            if m[2] or m[5]:
                if open_[tag] > 0:
                    k = len(stack) - 1
                    while self.tag[stack[k]] != tag:
                        k -= 1
                    close(k)
                continue
            shut = CLOSES.get(tag, ()) or ({"p"} if tag in BLOCK and tag not in ("br", "hr") else ())
            if any(open_[x] > 0 for x in shut):
                for k in reversed(stops):
                    if self.tag[stack[k]] in shut:
                        close(k)
                        break
                    if self.tag[stack[k]] in SCOPE:
                        break
            n = len(self.tag)
            self.parent.append(stack[-1])
            self.tag.append(tag)
            self.end.append(n + 1)
            weight, wraps = _weight(tag, attrs)
            self.weight.append(weight)
            wrapper.append(wraps)
            if tag not in VOID and not attrs.endswith("/"):
                if tag in _STOPS:
                    stops.append(len(stack))
                stack.append(n)
                open_[tag] += 1
        if at < len(page):
            self.pieces.append((stack[-1], page[at:]))
        close(0)
        self._headers()
        if any(wrapper):
            self._unwrap(wrapper)

    def _headers(self) -> None:
        """A header beside the parts of a page is the page's; any other is that of what it stands in."""
        parts = {self.parent[i] for i, t in enumerate(self.tag) if t in PARTS}
        for i, t in enumerate(self.tag):
            p = self.parent[i]
            if t == "header" and (self.tag[p] in ("#root", "html", "body") or p in parts and self.tag[p] not in ("article", "main")):
                self.weight[i] = min(self.weight[i], NAMED)

    def _unwrap(self, wrapper: list[bool]) -> None:
        """A wrapper that holds more than twice the text that stands outside of names and links weighs nothing down."""
        n, parent, weight = len(self.tag), self.parent, self.weight
        no, named = [False] * n, [False] * n
        for i in range(1, n):
            # names in a wrapper are boilerplate of the page in it
            no[i] = no[parent[i]] or self.tag[i] == "a" or weight[i] == UNSEEN or weight[i] < 1 and not wrapper[i]
            named[i] = named[parent[i]] or wrapper[i]
        chars, outside = [0] * n, 0
        for i, s in self.pieces:
            if not no[i]:
                c = len("".join(s.split()))
                chars[i] += c
                outside += 0 if named[i] else c
        for i in range(n - 1, 0, -1):
            chars[parent[i]] += chars[i]
        for i in range(1, n):
            if wrapper[i] and chars[i] > 2 * outside:
                weight[i] = 1.0


def _densities(dom: Dom) -> tuple[list[float], list[float], list[int], list[int], list[int], list[float]]:
    """Weighted densities and sums of all nodes, their characters, those in links and the links, and the own text's density."""
    n, parent, tag, own_weight = len(dom.tag), dom.parent, dom.tag, dom.weight
    weight, link = [1.0] * n, [False] * n
    for i in range(1, n):
        weight[i] = weight[parent[i]] * own_weight[i]
        link[i] = tag[i] == "a" or link[parent[i]]
    own, chars, link_chars, links = ([0] * n for _ in range(4))
    # the same counts with what is weighted down counted at its weight, which a node's ancestors go by
    w_chars, w_link_chars, w_tags, w_links = ([0.0] * n for _ in range(4))
    for i, s in dom.pieces:
        if weight[i]:
            c = len("".join(s.split()))
            own[i] += c
            chars[i] += c
            w_chars[i] += c
            if link[i]:
                link_chars[i] += c
                w_link_chars[i] += c
    for i in range(n - 1, 0, -1):
        p, w = parent[i], own_weight[i]
        if not w:
            continue
        is_link = tag[i] == "a"
        chars[p] += chars[i]
        link_chars[p] += link_chars[i]
        links[p] += links[i] + is_link
        w_chars[p] += w * w_chars[i]
        w_link_chars[p] += w * w_link_chars[i]
        w_tags[p] += w * (w_tags[i] + 1)
        w_links[p] += w * (w_links[i] + is_link)
    body = next((i for i in range(n) if tag[i] == "body"), 0)
    in_body = link_chars[body] / chars[body] if chars[body] else 0.0
    density, sums, own_density = [0.0] * n, [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if not weight[i] or not chars[i]:
            continue
        c, t = w_chars[i], max(1.0, w_tags[i])
        lc, lt = max(1.0, w_link_chars[i]), max(1.0, w_links[i])
        base = math.log(c * w_link_chars[i] / max(1.0, c - w_link_chars[i]) + in_body * c + math.e)
        density[i] = weight[i] * max(0.0, c / t * math.log(max(1.0, c * t / (lc * lt)) + 1.0) / base)
        own_density[i] = weight[i] * own[i] * math.log(own[i] + 1.0) / math.log(in_body * own[i] + math.e) if not link[i] else 0.0
        sums[i] += own_density[i]
        if i:
            sums[parent[i]] += density[i]
    return density, sums, chars, link_chars, links, own_density


def main_text(page: str) -> str:
    """The page's main text, its blocks joined by a space; empty where there is none."""
    dom = Dom(page)
    n = len(dom.tag)
    parent, tag, weight = dom.parent, dom.tag, dom.weight
    density, sums, chars, link_chars, links, own_density = _densities(dom)
    if not chars[0]:
        return ""
    body = next((i for i in range(n) if tag[i] == "body"), 0)
    if not chars[body]:
        body = 0
    heart = max(range(body, dom.end[body]), key=lambda i: (sums[i], -i))
    path = [heart]
    while path[-1] != body and parent[path[-1]] >= body:
        path.append(parent[path[-1]])
    threshold = min(density[i] for i in path)

    heading = [0] * n
    for i, s in dom.pieces:
        heading[i] += len("".join(s.split())) if tag[i] in HEADINGS else 0
    for i in range(n - 1, 0, -1):
        if tag[i] in HEADINGS:
            heading[i] = chars[i]
        heading[parent[i]] += heading[i]

    def of_links(i: int) -> bool:
        return tag[i] not in ("p", "a", "#root", "html", "body") and tag[i] in BLOCK and links[i] >= LINKS and link_chars[i] > LINK_SHARE * chars[i]

    def plain(i: int) -> bool:
        return weight[i] == 1 and not of_links(i)

    children: dict[int, list[int]] = {p: [] for p in path[1:]}
    for i in range(body + 1, dom.end[body]):
        if parent[i] in children and (chars[i] or tag[i] not in BLOCK):
            children[parent[i]].append(i)
    chosen, own_too = {heart}, set()
    for q, p in zip(path, path[1:]):
        row = children[p]
        good = [k for k, i in enumerate(row) if i == q or density[i] >= threshold > 0 and not of_links(i)]
        a, z = good[0], good[-1]
        while a and plain(row[a - 1]) and heading[row[a - 1]] and heading[row[a - 1]] == chars[row[a - 1]]:
            a -= 1  # headings of what follows them
        within = p != body and all(plain(i) for i in row)  # nothing but content stands here: its short blocks are content too
        chosen |= {row[k] for k in good} | {i for k, i in enumerate(row) if (a <= k <= z or within and tag[i] in PROSE) and plain(i)}
        if own_density[p] >= threshold > 0 or within:
            own_too.add(p)
    inside = [False] * n
    for i in range(n):
        inside[i] = i in chosen or i > 0 and inside[parent[i]] and (weight[i] > NAMED and not of_links(i) or weight[i] > UNSEEN and tag[i] not in OUT_TAGS and density[i] >= threshold)
    return " ".join(html.unescape("".join(s if inside[i] or i in own_too else " " if s == " " else "" for i, s in dom.pieces)).split())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (the main text of html) and n_chars (code points). Null and empty html give an empty text.

    Repeated rows stay, null ids and urls too; an empty table gives none; other columns are not read. Long and deep pages
    are read whole, in time linear in their length; of nodes with equal sums the first in the page is the heart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "html"):
            texts = [main_text(h) if h else "" for h in b["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = texts(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
