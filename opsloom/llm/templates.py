"""Main text of web pages: site templates found by counting element subtrees per host.

Every element's subtree is hashed by its tags and text. A subtree that recurs
on many pages of a host whose main text differs is part of the site's template
and is deleted with all it holds. What single pages show by their tags alone
(scripts, forms, navigation and the like) goes as well.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.llm.store import kept, numbered, quoted, small_side

#: Different main texts of a host beside which a template's subtree stands, whatever the host's size;
#: a box inside an article (a quotation may stand in several) needs more.
RECURS, RECURS_INSIDE = 3, 10
#: A page with so many times the text of its articles is more than these (teasers beside the main text).
ARTICLE_SHARE = 5

#: Elements of the page's frame, or never shown as text.
FRAME = frozenset("""
    script style noscript template head nav header footer aside form button select option textarea
    input label fieldset datalist iframe object embed svg canvas math audio video dialog menu
""".split())
#: Elements without content.
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
OPAQUE = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
#: Elements inside a line of text.
INLINE = frozenset("""
    a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark nobr q rp rt ruby s
    samp small span strike strong sub sup time tt u var wbr
""".split())
#: Words of classes, ids and roles that name parts of the page's frame.
MARKS = re.compile(
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notification|alert|popup"
    r"|modal|overlay|newsletter|subscribe|signup|login|search|nav|navbar|navigation|menus?|menubar|breadcrumbs?|sidebar\w*|side|widgets?"
    r"|related|recommend\w*|teasers?|share|sharing|social|comments?|commentlist|disqus|replies|reply|respond|footer|header"
    r"|masthead|copyright|legal|pagination|pager|toolbar|skip|hidden|complementary|contentinfo|dialog|form)", re.I)
#: Words beside a mark that do not change what it names (site-header, comment-body).
NEUTRAL = frozenset("""
    site page main top bottom left right box wrapper wrap container block list area section body inner post posts item
    items bar panel content text link links buttons button
""".split())
#: Words that name readers' comments.
COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
#: Tags that end an open element of the same sort.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"},
}
#: Tags that end an open paragraph.
ENDS_P = frozenset("""
    address article aside blockquote details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hr main menu nav ol p pre section table ul
""".split())
ARTICLE = frozenset(("article", "main"))
#: Elements that may be template even inside an article; its text
#: blocks (paragraphs, headings, lists, tables) belong to it however often they recur.
BOXES = frozenset(("div", "section", "details", "center"))
#: Elements that a name such as advert or share sets aside even inside an article.
SET_ASIDE = BOXES | {"ul", "ol", "dl", "figure", "table", "article"}

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)",
    re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_BLANK = re.compile(r"\s+")


@dataclass
class Node:
    """An element; children are nodes and texts in page order."""

    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)
    key: int = 0
    chars: int = 0
    length: int = 0          # of the whole page's text as it stands, at the root
    holds: bool = False      # an article that is no reader's comment
    marked: str = ""         # what its class, id and role name: "frame", "comments" or nothing


class _Open:
    """The open elements, and where the innermost of each tag stands."""

    def __init__(self, root: Node):
        self.nodes, self.at = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self.at[node.tag].append(len(self.nodes))
        self.nodes.append(node)

    def close(self, depth: int) -> None:
        for node in self.nodes[depth:]:
            self.at[node.tag].pop()
        del self.nodes[depth:]

    def innermost(self, tags) -> int:
        at = self.at
        return max((at[t][-1] for t in tags if at.get(t)), default=0)

    def end(self, tags, walls) -> None:
        """Close the innermost open element of ``tags``, if none of ``walls`` stands within it."""
        depth = self.innermost(tags)
        if depth and depth >= self.innermost(walls):
            self.close(depth)


_P, _P_WALLS = ("p",), frozenset(ENDS_P - {"p"} | {"td", "th", "li", "body"})
_LIST_WALLS = frozenset(("ul", "ol", "table", "dl", "select", "menu"))


def parse(page: str) -> Node:
    """The element tree of a page, however badly it is closed; linear in its length."""
    root = Node("#page")
    stack = _Open(root)
    at, lower = 0, None
    for m in iter(lambda: _TOKEN.search(page, at), None):
        if m.start() > at:
            stack.nodes[-1].children.append(html.unescape(page[at:m.start()]))
            root.length += m.start() - at
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            depth = stack.innermost((tag,))
            if depth:
                stack.close(depth)
            continue
        if tag in ENDS_P:
            stack.end(_P, _P_WALLS)
        if tag in CLOSES:
            stack.end(CLOSES[tag], _LIST_WALLS)
        node = Node(tag, {a[1].lower(): html.unescape(a[2] or a[3] or a[4] or "") for a in _ATTRIBUTE.finditer(m[3] or "")})
        if node.attributes:
            node.marked = named(node.attributes)
        if tag in ARTICLE and node.marked != "comments":
            for holder in reversed(stack.nodes):
                if holder.holds:
                    break
                holder.holds = True
        stack.nodes[-1].children.append(node)
        if tag in OPAQUE:
            lower = page.lower() if lower is None else lower
            close = lower.find("</" + tag, at)
            inside = page[at:close] if close >= 0 else page[at:]
            if tag in ("textarea", "title"):
                inside = html.unescape(inside)
            node.children.append(inside)
            at = len(page)
            if close >= 0:
                end = page.find(">", close)
                at = end + 1 if end >= 0 else len(page)
        elif tag not in EMPTY and not (m[3] or "").endswith("/"):
            stack.push(node)
    if at < len(page):
        stack.nodes[-1].children.append(html.unescape(page[at:]))
        root.length += len(page) - at
    return root


@lru_cache(100_000)
def _names(word: str) -> str:
    """What one class word, id or role names: all its parts are marks or neutral, and one is a mark."""
    parts = [x for x in re.split(r"[-_:]+", word) if x]
    if any(x in COMMENTS for x in parts) and all(x in COMMENTS or x in NEUTRAL for x in parts):
        return "comments"
    marks = [MARKS.fullmatch(x) is not None for x in parts]
    return "frame" if any(marks) and all(m or x in NEUTRAL for m, x in zip(marks, parts)) else ""


def named(a: dict[str, str]) -> str:
    """"comments", "frame" or "" by class, id and role."""
    found = {_names(w) for w in (*a.get("class", "").lower().split(), a.get("id", "").strip().lower(), *a.get("role", "").lower().split())}
    return "comments" if "comments" in found else "frame" if "frame" in found else ""


def is_frame(node: Node, inside: bool = False, words: bool = True) -> bool:
    """Whether tag and attributes alone show that an element is not main text.

    What class, id and role name counts (with ``words``) for elements that hold
    no article; inside one (``inside``) not for single paragraphs, headings and
    the like, but for comments.
    """
    if node.tag in FRAME:
        return True
    a = node.attributes
    if a and ("hidden" in a or a.get("aria-hidden") == "true" or re.search(
            r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I)):
        return True
    if not words or not node.marked or node.holds or node.tag in ("html", "body", "#page", "main"):
        return False
    return node.marked == "comments" or node.tag in ARTICLE or not inside or node.tag in SET_ASIDE


def _walk(root: Node) -> Iterator[tuple[Node, bool]]:
    """(node, entered) in page order, without recursion; each node is met on entry and on exit."""
    stack: list[tuple[Node, bool]] = [(root, True)]
    while stack:
        node, entered = stack.pop()
        yield node, entered
        if entered:
            stack.append((node, False))
            stack.extend((c, True) for c in reversed(node.children) if isinstance(c, Node))


def hash_subtrees(root: Node) -> None:
    """Set ``key`` and ``chars`` of every element from its tag and all it holds."""
    for node, entered in _walk(root):
        if entered:
            continue
        h, chars = xxhash.xxh64(node.tag), 0
        for c in node.children:
            if isinstance(c, Node):
                h.update(f"<{c.key}>")
                chars += c.chars
            else:
                text = _BLANK.sub(" ", c).strip()
                h.update(text)
                chars += len(text)
        node.key, node.chars = h.intdigest() - (1 << 63), chars


def template_candidates(root: Node) -> set[int]:
    """Subtrees of a page that may belong to its site's template: of any length, but none that holds an article.

    Articles that stand in no other may, as well.
    """
    found: set[int] = set()
    inside = 0
    for node, entered in _walk(root):
        if node.tag in ARTICLE:
            inside += 1 if entered else -1
        if entered or not node.chars:
            continue
        if node.tag in ARTICLE:
            if not inside:
                found.add(node.key)
        elif (not node.holds and node.tag not in INLINE
              and node.tag not in ("#page", "html", "head", "body", "title") and (not inside or node.tag in BOXES)):
            found.add(node.key)
    return found


def articles(root: Node) -> list[Node]:
    """Articles that stand in no other one and are no frame, in page order."""
    found: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if node.tag in ARTICLE:
            found.append(node)
        else:
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not is_frame(c))
    return found


def _shown(root: Node, drops) -> int:
    """Characters of an element without what ``drops(node, inside an article)`` takes out."""
    chars, stack = 0, [(root, root.tag in ARTICLE)]
    while stack:
        node, inside = stack.pop()
        for c in node.children:
            if isinstance(c, str):
                chars += len(_BLANK.sub(" ", c).strip())
            elif not drops(c, inside):
                stack.append((c, inside or c.tag in ARTICLE))
    return chars


def largest(found: list[Node]) -> Node:
    """The article with most main text."""
    return max(found, key=lambda n: _shown(n, is_frame)) if len(found) > 1 else found[0]


def main_text(root: Node, template: set[int] | frozenset[int] = frozenset(), strong: set[int] | frozenset[int] | None = None) -> str:
    """Blocks of the page's main part, without frame and template subtrees, joined by one space.

    The main part is its articles, if they hold at least one part in
    ``ARTICLE_SHARE`` of the text that is left of the page, else the whole page. Inside articles only subtrees in
    ``strong`` are template. If what class words name leaves nothing, they do
    not count.
    """
    strong = template if strong is None else strong
    for words in (True, False):
        def drops(node: Node, inside: bool) -> bool:
            if is_frame(node, inside, words):
                return True
            return node.key in strong and node.tag in BOXES if inside else node.key in template

        found = articles(root)
        starts = [root]
        if found:
            main = largest(found)
            kept_ = [n for n in found if n is main or n.key not in template]
            held = ARTICLE_SHARE * sum(_shown(n, drops) for n in kept_)
            if held >= root.length or held >= _shown(root, lambda n, inside: n is not main and drops(n, inside)):
                starts = kept_
        text = _blocks(starts, drops)
        if text:
            return text
    return ""


def _blocks(starts: list[Node], drops) -> str:
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = _BLANK.sub(" ", "".join(line)).strip()
        if text:
            blocks.append(text)
        line.clear()

    stack: list = [(n, None) for n in reversed(starts)]       # None: to be taken whatever it is
    while stack:
        item, inside = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            line.append(item)
        elif inside is not None and drops(item, inside):
            flush()
        else:
            block = item.tag not in INLINE
            if block:
                flush()
                stack.append((None, None))
            within = bool(inside) or item.tag in ARTICLE
            stack.extend((c, within) for c in reversed(item.children))
    flush()
    return " ".join(blocks)


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user, port and leading www; '' if there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page: the hash of its main text (its largest article) and the distinct subtrees that may be template."""
    for batch in batches:
        texts, found = [], []
        for page in batch.column(2).to_pylist():
            root = parse(page or "")
            hash_subtrees(root)
            parts = articles(root)
            texts.append(largest(parts).key if parts else xxhash.xxh64(main_text(root)).intdigest() - (1 << 63))
            found.append(sorted(template_candidates(root)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
            ["uid", "host", "main", "subtrees"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, template, strong in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
            root = parse(page or "")
            if template:
                hash_subtrees(root)
            texts.append(main_text(root, set(template or ()), set(strong or ())))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"])


def template_subtrees(found: DataFrame, recurs: int = RECURS) -> DataFrame:
    """(host, subtree, n) of site templates; ``found`` has host, main and subtrees of each page.

    Counted are a host's different main texts, not its pages, so that copies of
    one page do not make its article a template. The count that decides is the
    same for hosts of every size. Counts combine before they are shuffled, and a
    host of any size is spread by its subtrees.
    """
    each = found.select("host", "main", F.explode("subtrees").alias("subtree")).distinct()
    counted = each.groupBy("host", "subtree").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= recurs).select("host", "subtree", "n")


def main_texts(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
               recurs: int = RECURS) -> DataFrame:
    """Per page: page_id, url, text (whole main text, empty if none) and n_chars.

    Null and empty pages have empty text; pages without host form one site of
    their own; repeated rows give repeated results; other columns are not read.
    The table is scanned twice: for the subtrees and for the texts.
    """
    plain = numbered(pages.select(quoted(id_column).alias("page_id"), quoted(url_column).alias("url"),
                                  quoted(html_column).alias("html")))
    found = kept(plain.select("uid", host_of(F.col("url")).alias("host"), "html").mapInArrow(
        _subtrees, "uid long, host string, main long, subtrees array<long>"), "subtrees")
    template = kept(template_subtrees(found, recurs), "templates")
    hits = found.select("uid", "host", F.explode("subtrees").alias("subtree")).join(
        small_side(template), ["host", "subtree"])
    strong = F.when(F.col("n") >= max(recurs, RECURS_INSIDE), F.col("subtree"))
    by_page = kept(hits.groupBy("uid").agg(F.collect_list("subtree").alias("template"), F.collect_list(strong).alias("strong")), "hits")
    size = by_page.agg(F.sum(F.size("template") + F.size("strong") + 2)).first()[0] or 0
    rows = plain.join(small_side(by_page, size), "uid", "left").select("page_id", "url", "html", "template", "strong")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
