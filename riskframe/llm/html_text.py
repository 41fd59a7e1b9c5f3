"""Main text of a web page by tag-path ratios.

A page is read into text nodes, each with the path of tags (and their classes) from the root. Per path the text
length and the punctuation are aggregated over its nodes; both ratios are fused, smoothed along the page, and paths
at or over a threshold are content, wherever they stand. With them go their whole blocks, the short blocks beside them
in the same container and the headings. What is boilerplate by its tag, role or hidden state is left out before; a class
or id that names boilerplate only lowers the ratio of the paths in it, unless the element holds most of the text.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from riskframe.llm.common import strings

# Tag names of the HTML standard, and the words by which pages name their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math object canvas noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html head td th tr tbody thead tfoot caption option legend".split())
SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"},
}
SCOPES = frozenset("table ul ol dl select article section div body html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOT_TEXT = frozenset("nav footer aside form button select menu dialog head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored sponsors promo promos promotion menu "
    "menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars aside widget widgets related recommended recommendations "
    "share sharing social cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe "
    "subscription signup comment comments commentlist disqus respond reply replies footer foot masthead topbar toolbar pagination "
    "pager copyright login search skip alert alerts toc tags outbrain taboola paywall announcement announcements".split()
)
HEADER = frozenset("header head".split())
ARTICLE = frozenset("article main".split())
SECTIONS = frozenset("article main section div body html".split())
STATES = frozenset("no not non has with without".split())
MAIN_NAMES = frozenset("article content main post entry story body text".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>",
    re.S,
)
UNENDED = re.compile(r"<!--|<!\[CDATA\[|<[!?]")  # runs to the end of the page where no tag can end any more
ATTRIBUTE = re.compile(r"([A-Za-z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？]")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

DEEPEST = 512
SMOOTH = (0.25, 0.5, 0.25)
PENALTY = 0.1  # what a path in an element named as boilerplate keeps of its smoothed ratio
THRESHOLD = 0.5  # of the deviation of the fused ratios over the nodes


def parts(names: str) -> set[str]:
    """The words of classes and ids: mainMenu, main-menu and main_menu are main and menu. What follows no, not, non, has,
    with or without in one name says what the page's part has or lacks, not what it is, and is left out."""
    out = set()
    for name in names.split():
        for word in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()):
            if word in STATES:
                break
            out.add(word)
    return out


class Page:
    """Elements as parallel lists, text nodes with their element and block."""

    def __init__(self, source: str):
        self.tag, self.parent, self.path, self.drop = ["#"], [-1], [0], [0]
        self.in_article, self.named, self.main_named = [False], [False], [False]
        self.nodes: list[tuple[int, int, str]] = []  # element, block, text
        self.paths: dict[tuple[int, str], int] = {}
        self.stack, self.block = [0], 0
        at, size = 0, len(source)
        last = source.rfind(">") + 1  # no tag ends after this, so none is looked for
        while at < size:
            found = TAG.search(source, at, last)
            if not found:
                rest = UNENDED.search(source, at)
                self._text(source[at:rest.start() if rest else size])
                break
            self._text(source[at:found.start()])
            at = found.end()
            if at == last and (found[0].startswith("<!--") and not found[0][4:].endswith("-->") or found[0].startswith("<![CDATA[") and not found[0].endswith("]]>")):
                break
            name = (found[2] or found[5] or "").lower()
            if not name:
                continue
            attributes = found[3] or found[6] or ""
            if found[1] or found[4]:
                self._close(name)
            elif name in RAW:
                if not attributes.endswith("/"):
                    end = re.compile(f"</{re.escape(name)}[^>]*(?:>|\\Z)", re.I).search(source, at)
                    at = end.end() if end else size
                if name in BLOCK:
                    self.block += 1
            elif name == "br":
                self._text(" ")
            elif name in VOID:
                self.block += name in BLOCK
            else:
                self._open(name, attributes)

    def _text(self, raw: str) -> None:
        if raw:
            self.nodes.append((self.stack[-1], self.block, html.unescape(raw) if "&" in raw else raw))

    def _pop(self, depth: int) -> None:
        if any(self.tag[e] in BLOCK for e in self.stack[depth:]):
            self.block += 1
        del self.stack[depth:]

    def _close(self, name: str) -> None:
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.tag[self.stack[depth]]
            if tag == name:
                return self._pop(depth)
            if name not in BLOCK and tag in BLOCK:
                return None
        return None

    def _open(self, name: str, attributes: str) -> None:
        ends = SIBLINGS.get(name, ())
        for depth in range(len(self.stack) - 1, 0, -1) if ends or name in CLOSES_P else ():
            tag = self.tag[self.stack[depth]]
            if tag in ends or tag == "p" and name in CLOSES_P:
                self._pop(depth)
                ends = ends if tag != "p" else SIBLINGS.get(name, ())
                if not ends:
                    break
            elif tag in SCOPES:
                break
        parent = self.stack[-1]
        label, names, drop = name, set(), 0
        if attributes.strip(" /"):
            values = {}
            for key, a, b, c in ATTRIBUTE.findall(attributes):
                values.setdefault(key.lower(), a or b or c)
            label = ".".join([name, *sorted(values.get("class", "").split())])
            names = parts(f"{values.get('class', '')} {values.get('id', '')}")
            if values.get("role", "").lower() in ROLES or "hidden" in values or values.get("aria-hidden") == "true" or HIDDEN.search(values.get("style", "")):
                drop = 1
        inside = self.in_article[parent] or name in ARTICLE
        if self.drop[parent] == 1 or name in NOT_TEXT:
            drop = 1
        elif not drop and name == "header":
            drop = 2 if inside else 1  # an article's own header keeps its headings
        elif not drop and self.drop[parent] == 2:
            drop = 0 if name in HEADINGS else 2
        if name in BLOCK:
            self.block += 1
        if len(self.stack) < DEEPEST:  # as browsers do: what is nested deeper belongs to the last element
            self.stack.append(len(self.tag))
        self.tag.append(name)
        self.parent.append(parent)
        self.drop.append(drop)
        self.in_article.append(inside)
        own = name not in ("html", "body") and name not in ARTICLE
        self.named.append(own and bool(names & NAMES or name not in HEADINGS and names & HEADER and not names & MAIN_NAMES))
        self.main_named.append(own and bool(names & MAIN_NAMES))
        key = (self.path[parent], label)
        self.path.append(self.paths.setdefault(key, len(self.paths) + 1))


def penalised(page: Page, kept: list[tuple[int, int, str]]) -> list[bool]:
    """Per element: whether it lies in one whose class or id names boilerplate. A name does not count on an element that
    holds most of the text: of the article and main elements, else of the parts named as content, else of the page."""
    n = len(page.tag)
    own = [0] * n
    for element, _, text in kept:
        own[element] += len(text.strip())

    def flags(marked: list[bool]) -> tuple[int, list[bool]]:
        held = [own[e] if marked[e] else 0 for e in range(n)]
        for e in range(n - 1, 0, -1):
            held[page.parent[e]] += held[e]
        out = [False] * n
        for e in range(1, n):
            out[e] = out[page.parent[e]] or page.named[e] and 2 * held[e] <= held[0]
        return held[0], out

    below = [False] * n
    for e in range(1, n):
        below[e] = below[page.parent[e]] or page.main_named[e] and not page.named[e]
    for marked in (page.in_article, below, [True] * n):
        total, out = flags(marked)
        if total:
            return out
    return [False] * n


def content_nodes(page: Page, kept: list[tuple[int, int, str]], low: list[bool]) -> list[bool]:
    """Which of the kept nodes lie on a path whose fused, smoothed ratio reaches the threshold. Paths in named
    boilerplate (``low``) are paths of their own and count with a share of their ratio."""
    path = {e: (page.path[e], low[e]) for e, _, _ in kept}
    length: dict[tuple[int, bool], int] = {}
    marks: dict[tuple[int, bool], int] = {}
    count: dict[tuple[int, bool], int] = {}
    for element, _, text in kept:
        p = path[element]
        length[p] = length.get(p, 0) + len(text.strip())
        marks[p] = marks.get(p, 0) + len(PUNCTUATION.findall(text))
        count[p] = count.get(p, 0) + 1
    fused = {p: length[p] / count[p] * (1 + marks[p] / count[p]) for p in count}
    raw = [math.log1p(fused[path[e]]) for e, _, _ in kept]
    n = len(raw)
    smooth = [SMOOTH[0] * raw[max(0, i - 1)] + SMOOTH[1] * raw[i] + SMOOTH[2] * raw[min(n - 1, i + 1)] for i in range(n)]
    smooth = [s * PENALTY if low[e] else s for (e, _, _), s in zip(kept, smooth)]
    total: dict[tuple[int, bool], float] = {}
    for (element, _, _), s in zip(kept, smooth):
        total[path[element]] = total.get(path[element], 0.0) + s
    score = {p: total[p] / count[p] for p in total}
    mean = sum(smooth) / n
    deviation = math.sqrt(sum((s - mean) ** 2 for s in smooth) / n)
    # the best path reaches the mean, but for the rounding of sums over equal scores
    limit = mean - THRESHOLD * deviation - 1e-9 * (1 + abs(mean))
    return [score[path[e]] >= limit for e, _, _ in kept]


def containers(page: Page, kept: list[tuple[int, int, str]], content: list[bool]) -> tuple[list[int], list[bool], list[bool]]:
    """Per element: the deepest element around it with content, whether content blocks stand side by side in it, and
    whether it lies in the lowest common ancestor of all content nodes or in the article around that."""
    n = len(page.tag)
    holds, direct = [0] * n, [False] * n
    for (element, _, _), good in zip(kept, content):
        if not good:
            continue
        holds[element] += 1
        b = element
        while b > 0 and page.tag[b] not in BLOCK:
            b = page.parent[b]
        e = b
        while not direct[e]:
            direct[e] = True
            if e == 0 or page.tag[e] in SECTIONS or e != b and page.tag[e] in ("td", "th"):
                break
            e = page.parent[e]
    for e in range(n - 1, 0, -1):  # children stand after their parents
        holds[page.parent[e]] += holds[e]
    lowest = max(e for e in range(n) if holds[e] == holds[0])
    root = lowest
    while root > 0 and page.tag[root] not in ARTICLE:
        root = page.parent[root]
    root = root or lowest
    near, inside = [0] * n, [False] * n
    for e in range(n):
        near[e] = e if holds[e] or e == 0 else near[page.parent[e]]
        inside[e] = e == root or e > 0 and inside[page.parent[e]]
    return near, direct, inside


def chosen(page: Page, kept: list[tuple[int, int, str]], content: list[bool], low: list[bool]) -> list[bool]:
    """Which of the kept nodes are the text: content nodes, the rest of their blocks, blocks beside theirs in the same
    container unless they are link lists outside an article, what an article has between content nodes, headings of the
    article or directly before content, and the last h1 before it. What lies below the threshold elsewhere, or in named
    boilerplate (``low``), is left out."""
    near, direct, inside = containers(page, kept, content)
    listed = _link_lists(page, kept, near)
    with_content = {block for (_, block, _), good in zip(kept, content) if good}
    heads = [0] * len(page.tag)  # the heading around an element
    for e in range(1, len(page.tag)):
        heads[e] = e if page.tag[e] in HEADINGS else heads[page.parent[e]]
    first, last = content.index(True), len(content) - 1 - content[::-1].index(True)
    title = max((heads[e] for e, _, _ in kept[:first] if page.tag[heads[e]] == "h1" and not low[e]), default=0)
    if any(page.tag[heads[e]] == "h1" for e, _, _ in kept[first:]) or any(inside[e] and page.tag[heads[e]] == "h1" for e, _, _ in kept):
        title = 0
    out, leads = [False] * len(kept), False
    for i in range(len(kept) - 1, -1, -1):
        (element, block, _), good = kept[i], content[i]
        head = heads[element]
        if not head:
            leads = good
        out[i] = good or not low[element] and (
            block in with_content or first < i < last and page.in_article[element] or head > 0 and (inside[element] or leads or head == title)
            or direct[near[element]] and (page.in_article[element] or not listed[element])
        )
    return out


def main_text(source: str) -> str:
    """Blocks of the article in page order, one line each, white space as one blank; empty if there is none."""
    page = Page(source)
    kept = [n for n in page.nodes if not page.drop[n[0]] and not n[2].isspace()]
    if not kept:
        return ""
    low = penalised(page, kept)
    taken = iter(chosen(page, kept, content_nodes(page, kept, low), low))
    blocks: dict[int, list[str]] = {}
    for element, block, text in page.nodes:
        if not page.drop[element] and (text.isspace() or next(taken)):
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(x).split()) for x in blocks.values())
    return "\n".join(x for x in lines if x)


def _link_lists(page: Page, kept: list[tuple[int, int, str]], near: list[int]) -> list[bool]:
    """Elements below a child without content of a container with content, where that child is mostly link text."""
    top = [0] * len(page.tag)
    for e in range(1, len(page.tag)):
        top[e] = 0 if near[e] == e else e if near[e] == page.parent[e] else top[page.parent[e]]
    linked: dict[int, int] = {}
    chars: dict[int, int] = {}
    for element, _, text in kept:
        c = top[element]
        n, e = len(text.strip()), element
        while e > 0 and page.tag[e] != "a" and page.tag[e] not in BLOCK:
            e = page.parent[e]
        chars[c] = chars.get(c, 0) + n
        linked[c] = linked.get(c, 0) + (n if page.tag[e] == "a" else 0)
    dropped = {c for c in chars if c and 2 * linked[c] > chars[c] and page.tag[c] not in HEADINGS | {"p"}}
    return [t in dropped for t in top]


SCHEMA = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


@F.arrow_udf(SCHEMA)
def _extract(pages: pa.Array) -> pa.Array:
    texts = [main_text(x) for x in strings(pages)]
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=SCHEMA.names)


def extracted(source: str | Column) -> Column:
    """A struct (text, n_chars) per page; null, empty and text-free pages have the empty text."""
    return _extract.asNondeterministic()(F.col(source) if isinstance(source, str) else source)


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page, read whole and alone: repeated rows give equal results, ids may be
    null, other columns play no part, no pages give no rows."""
    return pages.select(F.col(page_id), F.col(url), extracted(source).alias("x")).select(page_id, url, "x.*")
