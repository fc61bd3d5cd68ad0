"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree. A node is an element's place: the names of its ancestors and
itself, each with its class. Its content on a page is the hash of the text inside it. If all pages of a host
show the same there, the entropy of its contents is low and so is its importance; if each page shows something
else, the importance is near 1. Its presentation counts as well: the ways its children follow each other.
A node's importance mixes both, and branches below ``least`` are cut out of every page of the host.

What varies from page to page but is no article either (menus, adverts, forms, ...) is told by what the markup
says it is, which is the prior of a node: elements for navigation, forms and code, and class, id or role names
for notices, adverts or comments have importance 0. A page that has an article (or main part) keeps nothing else.
Inside it markup raises the importance of a branch by ``ARTICLE_PRIOR`` and the tree decides as elsewhere, so a
notice that a host repeats in its articles goes whatever its class is called. Branches are blocks there: inline
elements are words of a sentence.

Each distinct page of a host counts once, and inside articles each distinct article, so copies do not make an
article look like a menu. Counts are summed per (host, node, content) before they meet, so a host may hold any
share of the pages.

Defined results: null html is empty, its text too. A null url has the empty host. A page on which all would be
cut keeps its text outside the branches that have importance 0 by their prior, and so does an article of which
less than ``LEAST_LEFT`` would be left. Repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpuspipe.llm.common import keep_columns, store
from corpuspipe.llm.grams import groups
from corpuspipe.llm.url_filter import host_of

# Nodes of less importance are removed; pages of a host from which on its tree says something.
LEAST_IMPORTANCE = 0.3
LEAST_PAGES = 4
# Share of a node's own content against its presentation.
CONTENT_SHARE = 0.9
# What markup adds inside an article, and the share of an article's text that the tree leaves at least.
ARTICLE_PRIOR = 0.2
LEAST_LEFT = 0.25

# Fixed values of HTML: elements without an end tag, elements of raw text, and elements that break a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary"
    " table tbody td tfoot th thead title tr ul".split()
)
# An element of the first kind ends when one of the second begins.
ENDED_BY = {
    "p": frozenset(BLOCK - {"br", "option", "body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "title"}),
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "option": frozenset({"option"}),
    "tr": frozenset({"tr", "tbody", "thead", "tfoot"}),
    "td": frozenset({"td", "th", "tr"}),
    "th": frozenset({"td", "th", "tr"}),
    "head": frozenset({"body"}),
}
# End tags do not reach out of these.
SCOPES = frozenset("article section div nav aside footer header main table td th form body html".split())

BOILERPLATE_TAGS = frozenset(
    "head nav footer aside form script style noscript iframe button select option textarea template svg canvas object"
    " dialog menu title xmp noembed noframes input label".split()
)
BOILERPLATE_NAMES = re.compile(
    r"(^|[-_ ])(ad|ads|adv|advert|advertisement|adsense|banner|sponsor|sponsored|promo|promoted|nav|navbar|navigation"
    r"|menu|breadcrumb|breadcrumbs|sidebar|side|footer|header|masthead|topbar|cookie|cookies|consent|notice|gdpr|popup"
    r"|modal|overlay|comment|comments|reply|replies|disqus|share|sharing|social|related|recommended|newsletter"
    r"|subscribe|subscription|signup|login|search|pagination|pager|toolbar|widget|skip|alert|toc|tags)([-_ ]|s?$)",
    re.IGNORECASE,
)
# Names of the layout rather than of a branch: an element that holds an article is no menu for them.
SET_APART = re.compile(r"comment|repl|disqus|related|recommend|sponsor|promo|advert|popup|modal", re.IGNORECASE)
HEADINGS = re.compile(r"(^|[-_ ])(header|masthead)([-_ ]|s?$)", re.IGNORECASE)
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
ARTICLE_TAGS = frozenset(["article", "main"])

TAG = re.compile(r"<(?:!--.*?(?:-->|$)|![^>]*(?:>|$)|\?[^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$))", re.DOTALL)
ATTRIBUTE = re.compile(r"(class|id|role|hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.IGNORECASE)
BLANKS = re.compile(r"\s+")


class Element:
    __slots__ = ("name", "path", "names", "children", "prior")

    def __init__(self, name: str, path: str, names: str, prior: int | None):
        self.name, self.path, self.names, self.prior = name, path, names, prior
        self.children: list = []  # elements and strings


def _prior(name: str, names: str, role: str, in_article: bool) -> int | None:
    """0 for what is no article by its markup, 1 for an article, None where the tree decides."""
    if name in BOILERPLATE_TAGS or role in BOILERPLATE_ROLES or (name == "header" and not in_article):
        return 0
    if name in ("html", "body"):
        return None
    if in_article:  # its own heading stays
        names = HEADINGS.sub(" ", names)
    boilerplate = names and BOILERPLATE_NAMES.search(names)
    if name in ARTICLE_TAGS and not boilerplate:
        return 1
    return 0 if boilerplate else None


def parsed(text: str) -> Element:
    """The tree of a page. Unclosed elements end with their parents; stray end tags are skipped."""
    root = Element("", "", "", None)
    open_elements, at = [root], 0
    articles = 0
    while at < len(text):
        match = TAG.search(text, at)
        if match is None:
            open_elements[-1].children.append(text[at:])
            break
        if match.start() > at:
            open_elements[-1].children.append(text[at : match.start()])
        at = match.end()
        name = (match[2] or "").lower()
        if not name:
            continue
        if match[1]:
            for depth in range(len(open_elements) - 1, 0, -1):
                if open_elements[depth].name == name:
                    articles -= sum(e.name in ARTICLE_TAGS for e in open_elements[depth:])
                    del open_elements[depth:]
                    break
                if open_elements[depth].name in SCOPES and name not in SCOPES:
                    break
            continue
        while len(open_elements) > 1 and name in ENDED_BY.get(open_elements[-1].name, ()):
            open_elements.pop()
        if name in BLOCK:  # inline elements left open do not keep a paragraph from ending
            for depth in range(len(open_elements) - 1, 0, -1):
                if open_elements[depth].name in SCOPES:
                    break
                if name in ENDED_BY.get(open_elements[depth].name, ()):
                    del open_elements[depth:]
                    break
        names, role = [], ""
        if match[3] and not match[3].isspace():
            for key, value in ATTRIBUTE.findall(match[3]):
                value = value.strip("\"'")
                if key.lower() == "role":
                    role = value.lower()
                elif key.lower() in ("class", "id"):
                    names.append(value)
        parent = open_elements[-1]
        spelled = " ".join(names)
        element = Element(name, f"{parent.path}/{name}" + (f".{spelled}" if spelled else ""), spelled, _prior(name, spelled, role, articles > 0))
        parent.children.append(element)
        if element.prior == 1:
            for holder in open_elements:
                if holder.prior == 0 and holder.name not in BOILERPLATE_TAGS and not SET_APART.search(holder.names):
                    holder.prior = None
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(text, at)
            at = end.end() if end else len(text)
        elif name not in VOID and not match[0].endswith("/>"):
            open_elements.append(element)
            articles += name in ARTICLE_TAGS
    return root


def text_of(root: Element, removed=frozenset()) -> str:
    """Text of the blocks below an element, without branches of prior 0 and removed paths."""
    pieces: list[str] = []
    stack: list = [iter(root.children)]
    ends: list[bool] = [False]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
            if ends.pop():
                pieces.append("\n")
        elif isinstance(child, str):
            pieces.append(entities.unescape(child))
        elif child.prior == 0 or child.path in removed:
            pieces.append("\n" if child.name in BLOCK else "")
        else:
            block = child.name in BLOCK
            if block:
                pieces.append("\n")
            stack.append(iter(child.children))
            ends.append(block)
    return BLANKS.sub(" ", "".join(pieces)).strip()


def articles_of(root: Element) -> list[Element]:
    """Outermost articles outside branches of prior 0, in page order."""
    found, stack = [], [root]
    while stack:
        element = stack.pop()
        if element.prior == 1:
            found.append(element)
            continue
        stack += [c for c in reversed(element.children) if not isinstance(c, str) and c.prior != 0]
    return found


def undecided(root: Element) -> Iterator[tuple[Element, int | None]]:
    """Elements that are decided by the tree, and the hash of the article they lie in; inside articles only blocks."""
    stack: list[tuple[Element, int | None]] = [(root, None)]
    while stack:
        element, article = stack.pop()
        for child in element.children:
            if isinstance(child, str) or child.prior == 0 or child.name in VOID:
                continue
            if child.prior == 1:
                stack.append((child, _hash(text_of(child)) if article is None else article))
                continue
            if article is None or child.name in BLOCK:
                yield child, article
            stack.append((child, article))


def main_text(text: str, removed=frozenset()) -> str:
    root = parsed(text)
    articles = articles_of(root)
    if articles:
        return " ".join(filter(None, (_article_text(article, removed) for article in articles)))
    return text_of(root, removed) or text_of(root)


def _article_text(article: Element, removed) -> str:
    whole = text_of(article)
    left = text_of(article, removed) if removed else whole
    return left if len(left) >= LEAST_LEFT * len(whole) else whole


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(errors="replace"), digest_size=8).digest(), "little")


def style_tree(pages: DataFrame) -> DataFrame:
    """``host, node, pages, importance`` of every node that its markup does not decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in groups(batch, 1):
                seen: set = set()
                for host, value in zip(group.column(0).to_pylist(), group.column(1)):
                    text = value.as_py() or ""
                    page = _hash(text)
                    places: dict = {}
                    for node, article in undecided(parsed(text)):
                        shape = " ".join(c.name for c in node.children if not isinstance(c, str))
                        place = places.setdefault((node.path, article), ([], []))
                        place[0].append(text_of(node))
                        place[1].append(shape)
                    for (path, article), (contents, shapes) in places.items():
                        unit = page if article is None else article
                        seen.add((host, path, _hash("\n".join(contents)), _hash("\n".join(shapes)), unit, article is not None))
                columns = list(zip(*seen)) if seen else [()] * 6
                kinds = [pa.string(), pa.string(), pa.uint64(), pa.uint64(), pa.uint64(), pa.bool_()]
                arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds)]
                arrays[2:5] = [array.view(pa.int64()) for array in arrays[2:5]]
                yield pa.RecordBatch.from_arrays(arrays, names=["host", "node", "content", "shape", "unit", "in_article"])

    found = pages.select("host", "html").mapInArrow(
        run, "host string, node string, content long, shape long, unit long, in_article boolean"
    )
    counts = store(
        found.distinct().groupBy("host", "node", "in_article", "content", "shape").agg(F.count("*").alias("n")), "style-counts"
    )

    def evenness(feature: str) -> DataFrame:
        """Entropy of a feature over the pages or articles with the node, between 0 (always the same) and 1 (never)."""
        each = counts.groupBy("host", "node", "in_article", feature).agg(F.sum("n").alias("n"))
        total = F.sum("n")
        entropy = F.log(total) - F.sum(F.col("n") * F.log("n")) / total
        return each.groupBy("host", "node", "in_article").agg(
            total.alias("pages"), F.when(total > 1, entropy / F.log(total)).otherwise(F.lit(1.0)).alias(f"{feature}_evenness")
        )

    own = F.lit(CONTENT_SHARE) * F.col("content_evenness") + F.lit(1 - CONTENT_SHARE) * F.col("shape_evenness")
    prior = F.when(F.col("in_article"), ARTICLE_PRIOR).otherwise(0.0)
    return (
        evenness("content")
        .join(evenness("shape").drop("pages"), ["host", "node", "in_article"])
        .select("host", "node", "pages", (prior + (1 - prior) * own).alias("importance"))
    )


def extract(pages: DataFrame, least: float = LEAST_IMPORTANCE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``page_id, url, text`` of every row of ``pages``."""
    read = keep_columns(pages, page_id="long", url="string", html="string").withColumn("host", host_of(F.col("url")))
    tree = style_tree(read)
    cut = store(
        tree.where((F.col("importance") < least) & (F.col("pages") >= least_pages))
        .groupBy("host")
        .agg(F.collect_set("node").alias("removed")),
        "style-removed",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in groups(batch, 2):
                texts = [
                    main_text(value.as_py() or "", frozenset(gone or ()))
                    for value, gone in zip(group.column(2), group.column(3).to_pylist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [group.column(0), group.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
                )

    return (
        read.join(cut, "host", "left")
        .select("page_id", "url", "html", "removed")
        .mapInArrow(run, "page_id long, url string, text string")
    )
