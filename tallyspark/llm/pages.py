"""Main text of web pages, with site templates removed.

Every page becomes a tree of elements. Its block subtrees are hashed by tags, classes and
text, and counted per host in Spark over pages of different text; subtrees that stand on many such pages of one host are the site's
template and are deleted, as are elements whose tag, role or class says menu, header, footer, sidebar,
notice, advert, form, script or reader comment. What is left of the article (the largest one, else
main, else the body) is the text. Inside an article or main only boxes (BOXES) are counted, and need
more pages: a heading, paragraph, quotation or list of an article is never deleted for being common.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.store import saved, small_batches

#: A subtree is template if it stands on so many pages of the host, and on this share of them.
LEAST_PAGES, LEAST_SHARE = 5, 0.02
#: The same inside an article or main, where only these elements can be template.
LEAST_INSIDE, BOXES = 10, frozenset("div section".split())
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>|<[/!?a-zA-Z][^>]*(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed".split())
#: Elements that never hold article text.
DROP = RAW | frozenset("head nav footer aside form template svg math canvas object audio video button select dialog menu".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody thead tfoot tr caption ul".split())
#: Start tags that end an open paragraph.
ENDS_P = BLOCK - frozenset("html body tbody thead tfoot tr caption dd dt li".split())
#: Start tags that end an open element of the same list, up to the element that holds the list.
SIBLINGS = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table tbody thead tfoot"),
            "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("tbody thead tfoot tr td th", "table")}
SIBLINGS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in SIBLINGS.items()}
_BOILER = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|masthead|footer|sidebar|aside|ad|ads|advert|adverts|advertisement|advertising|promo"
    r"|promotion|sponsor|sponsored|banner|cookie|cookies|consent|gdpr|notice|notices|popup|modal|overlay|comment|comments|commentlist"
    r"|disqus|replies|reply|respond|share|sharing|social|breadcrumb|breadcrumbs|related|recommended|newsletter|subscribe|subscription"
    r"|signup|login|search|pagination|pager|toolbar|widget|copyright|disclaimer)(?:$|[\s_-])")
_TOP = re.compile(r"(?:^|[\s_-])(?:header|topbar|top-bar|head)(?:$|[\s_-])")
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
_KEEP = frozenset("html body main article".split())


class Node:
    """An element: tag, its class and id, its role, children (nodes and decoded texts)."""

    __slots__ = ("tag", "name", "role", "inner")

    def __init__(self, tag: str, name: str = "", role: str = ""):
        self.tag, self.name, self.role, self.inner = tag, name, role, []


def parse(html: str) -> Node:
    """A tree of any text; unclosed elements end with their parent, stray ends are passed over."""
    root = Node("html")
    open_: list[Node] = [root]
    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            open_[-1].inner.append(unescape(html[at:]))
            break
        if m.start() > at:
            open_[-1].inner.append(unescape(html[at:m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == tag:
                    del open_[k:]
                    break
            continue
        if tag in ("html", "body") and len(open_) == 1:
            continue
        if tag in ENDS_P:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == "p":
                    del open_[k:]
                    break
                if open_[k].tag in BLOCK or open_[k].tag in ("td", "th"):
                    break
        elif tag in SIBLINGS:
            same, stop = SIBLINGS[tag]
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag in stop:
                    break
                if open_[k].tag in same:
                    del open_[k:]
        name = role = ""
        if m[3]:
            for key, value in _ATTRIBUTE.findall(m[3]):
                value = value.strip("\"'").lower()
                if key.lower() == "role":
                    role = value
                else:
                    name += " " + value
        node = Node(tag, name, role)
        open_[-1].inner.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE).search(html, at)
            at = end.end() if end else n
        elif tag not in VOID and not m[3].endswith("/") or tag in BLOCK:
            open_.append(node)
    return root


def boilerplate(node: Node, inside: bool) -> bool:
    """Whether an element's tag, role or class says that it is no article text; inside: within an article."""
    if node.tag in DROP:
        return True
    if node.tag in ("html", "body", "main"):
        return False
    if node.tag == "header" or node.role == "banner" or (node.name and _TOP.search(node.name)):
        if not inside and node.tag not in _KEEP:
            return True
    if node.tag == "article":
        return bool(node.name and re.search(r"(?:^|[\s_-])comments?(?:$|[\s_-])", node.name))
    return (node.role in _ROLES and node.role != "banner") or bool(node.name and _BOILER.search(node.name))


def subtree_hashes(root: Node) -> dict[int, tuple[int, bool]]:
    """Hash of every block subtree that may be template, and whether it stands in an article or main, by id() of its node."""
    found: dict[int, tuple[int, bool]] = {}
    sums: dict[int, bytes] = {}
    holds: set[int] = set()  # nodes that are or hold an article or main: never template
    stack: list[tuple[Node, bool, bool]] = [(root, False, False)]
    while stack:
        node, inside, done = stack.pop()
        if not done:
            stack.append((node, inside, True))
            deeper = inside or node.tag in ("article", "main")
            stack += [(x, deeper, False) for x in node.inner if isinstance(x, Node)]
            continue
        h = hashlib.blake2b(f"{node.tag}|{node.name}|".encode(), digest_size=8)
        if node.tag in ("article", "main") or any(id(x) in holds for x in node.inner):
            holds.add(id(node))
        for x in node.inner:
            h.update(sums[id(x)] if isinstance(x, Node) else " ".join(x.split()).encode("utf-8", "replace"))
        sums[id(node)] = h.digest()
        if node.tag in (BOXES if inside else BLOCK - _KEEP) and id(node) not in holds:
            found[id(node)] = int.from_bytes(h.digest(), "little", signed=True), inside
    return found


def _blocks(node: Node, dropped: set[int], inside: bool) -> list[str]:
    """Texts of the blocks below a node, white space collapsed, empty ones left out."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            out.append(text)

    stack: list = [(node, 0, inside)]
    while stack:
        now, k, within = stack.pop()
        if k == len(now.inner):
            if now.tag in BLOCK:
                flush()
            continue
        stack.append((now, k + 1, within))
        x = now.inner[k]
        if isinstance(x, str):
            line.append(x)
        elif id(x) in dropped or boilerplate(x, within):
            if x.tag in BLOCK:
                flush()
        elif x.tag in VOID:
            if x.tag == "hr":
                flush()
            elif x.tag in ("br", "wbr"):
                line.append(" " if x.tag == "br" else "")
        else:
            if x.tag in BLOCK:
                flush()
            elif x.tag in ("td", "th"):
                line.append(" ")
            stack.append((x, 0, within or x.tag == "article"))
    flush()
    return out


def _all(root: Node, tag: str, dropped: set[int]) -> list[Node]:
    """Outermost elements of a tag that are neither boilerplate nor template."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node is not root and node.tag == tag:
            if not boilerplate(node, False):
                out.append(node)
            continue
        for x in reversed(node.inner):
            if isinstance(x, Node) and id(x) not in dropped and (x.tag == tag or not boilerplate(x, False)):
                stack.append(x)
    return out


def main_text(root: Node, hashes: dict[int, tuple[int, bool]], template: set[tuple[int, bool]]) -> str:
    """The text of a parsed page, given its subtree hashes and the host's template."""
    dropped = {i for i, h in hashes.items() if h in template}
    for tag in ("article", "main"):
        texts = [_blocks(node, dropped, tag == "article") for node in _all(root, tag, dropped)]
        best = max(texts, key=lambda t: sum(map(len, t)), default=[])
        if best:
            return "\n\n".join(best)
    return "\n\n".join(_blocks(root, dropped, False))


def _host() -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, part, inside, page) of every page, page being a hash of its text; part 0 counts the page itself."""
    for batch in batches:
        hosts, parts, insides, texts = [], [], [], []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            root = parse(html or "")
            hashes = subtree_hashes(root)
            text = main_text(root, hashes, set()).encode("utf-8", "replace")
            own = {(0, False), *hashes.values()}
            hosts += [host] * len(own)
            parts += [h for h, _ in own]
            insides += [x for _, x in own]
            texts += [int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)] * len(own)
        yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(parts, pa.int64()), pa.array(insides, pa.bool_()), pa.array(texts, pa.int64())],
                              names=["host", "part", "inside", "page"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for html, template in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist()):
            root = parse(html or "")
            texts.append(main_text(root, subtree_hashes(root) if template else {}, {(t["part"], t["inside"]) for t in template or ()}))
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def site_templates(pages: DataFrame) -> DataFrame:
    """Template subtrees of each host: host, template (array of hashes and places, at most some hundred a page's worth).

    Pages of equal text count as one, so a page that is given or copied many times is no template of itself.
    """
    rows = pages.select(_host().alias("host"), "html").mapInArrow(_count, "host string, part long, inside boolean, page long")
    counts = rows.distinct().groupBy("host", "part", "inside").count()
    # kept, for both its uses: pages are parsed once
    counts = saved(counts.where(F.col("count") >= F.when(F.col("inside"), LEAST_INSIDE).otherwise(LEAST_PAGES)))
    totals = counts.where("part = 0 AND NOT inside").select("host", F.col("count").alias("pages"))
    return (
        counts.where("part <> 0").join(totals, "host").where(F.col("count") >= LEAST_SHARE * F.col("pages"))
        .groupBy("host").agg(F.collect_list(F.struct("part", "inside")).alias("template"))
    )


def extract_pages(pages: DataFrame) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars.

    pages: page_id, url, html and others, which are left out. A null or empty html, and a page
    without article text, has an empty text; a page without host shares templates with others
    without host; repeated rows and null ids stay and count as one page; an empty table gives an empty table.
    """
    small_batches(pages.sparkSession)
    pages = pages.select("page_id", "url", "html")
    templates = saved(site_templates(pages))
    joined = pages.withColumn("host", _host()).join(templates, "host", "left").select("page_id", "url", "html", "template")
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string"
    return joined.mapInArrow(_extract, schema).withColumn("n_chars", F.length("text").cast("long"))
