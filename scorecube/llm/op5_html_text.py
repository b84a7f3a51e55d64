"""HTML extraction by site template removal.

1. Tasks parse each page into a tree and hash every element's subtree (tag, class and id, texts, children). Pages of a host
   whose main text is the same before any deletion are one page, however many rows or URLs it has: the one with the least
   list of hashes stands for all. Spark counts the pages that have a subtree. Subtrees on at least MIN_PAGES pages and SHARE
   of their host's pages are the host's templates, containers (div, section, ...) from CONTAINER_SHARE on; a host has its
   elements per page / SHARE and its containers per page / CONTAINER_SHARE of them at most.
2. Pages meet their host's templates in a join on the host (an adaptive skew join splits a host with many pages). A page is
   parsed again, its template subtrees are deleted, and so are elements that are never main text: by tag (nav, footer,
   form, script, ...), role, the first word of a class (ad, sidebar, comments, ...) or a whole id that is known (ids of
   headings and sections are often made of their titles). Inside the article a name deletes only containers and lists, and
   an id never deletes a heading or paragraph. What is left of the article
   (else of the main element, else of the body) gives the blocks.

Inside the article only containers (div, section, ...) can be templates: a paragraph that many pages share is still
text. Of several articles, that with the most text is the page's.

Trees are walked by loops over a stack of their own, so markup of any depth keeps its text.

Defined results: null and empty html give an empty text; unclosed, stray and truncated markup is repaired as browsers do
in the simple cases; a page without a host has no templates; every row gives a row, also for repeated or null page_ids; an
empty table gives an empty result; other columns are not read."""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .common import cut_lineage, ready

MIN_PAGES = 3
SHARE = 0.2
#: A link or a word in bold that many pages share is text more often than a whole container is.
CONTAINER_SHARE = 0.02

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary
    table tbody td tfoot th thead tr ul""".split())
#: what an opening tag ends, and the elements that the search for it doesn't leave
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
          "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"),
          "tbody": ("tbody thead tfoot tr td th", "table"), "thead": ("tbody thead tfoot tr td th", "table"),
          "tfoot": ("tbody thead tfoot tr td th", "table")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
P_SCOPE = frozenset("article aside body button caption div footer form header li main nav section table td th".split())
NEVER_TAGS = frozenset("""nav footer aside form button select input textarea script style noscript template iframe svg canvas
    object embed audio video head menu dialog title""".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
NEVER_NAMES = re.compile(
    r"(ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|"
    r"topbar|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|share|sharing|"
    r"social|related|recommended|recommendations|comments?|disqus|discussion|replies|widget|toolbar|pagination|pager|"
    r"skip)([-_].*)?$", re.I)
CONTAINERS = frozenset("div section aside form nav header footer menu dialog".split())
NEVER_IDS = re.compile(
    r"(ads?|advert(s|isements?|ising)?|adsense|sponsors|sponsored(-(links|posts|content))?|banner|(left|right|site|page|main)-(sidebar|"
    r"nav|navigation|menu|footer)|side-?bar(-(left|right))?|nav|nav-?bar|navigation|nav-menu|menu|breadcrumbs?|footer|masthead|topbar|"
    r"cookies?-(bar|banner|notice|consent|popup|law-info-bar)|consent-(banner|popup)|gdpr-(banner|consent|notice)|popup|modal|"
    r"overlay|newsletter-(signup|form|box)|subscribe-(form|box)|(share|sharing|social)-(bar|buttons?|links?|icons?|widget)|"
    r"(related|recommended)-(posts|articles|stories|links|content|news)|comments?|comments?-(list|section|area|form|wrapper|box)|respond|"
    r"disqus(-thread)?|widgets?|widget-area|toolbar|pagination|pager|skip-(link|nav|to-content))(-?[0-9]+)?", re.I)
NAMED = CONTAINERS | frozenset("ul ol".split())
ID_KEPT = frozenset("h1 h2 h3 h4 h5 h6 p".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>"""
                    r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[a-zA-Z!/?][^>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)


class Element:
    __slots__ = ("tag", "classes", "id", "role", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.classes, self.id, self.role, self.children = tag, "", "", "", []
        if attributes and "=" in attributes:
            for k, v in _ATTRIBUTE.findall(attributes):
                v = html.unescape(v.strip("\"'"))
                if k.lower() == "role":
                    self.role = v.lower()
                elif k.lower() == "id":
                    self.id = v.strip()
                else:
                    self.classes = f"{self.classes} {v}".strip()


def parse(page: str) -> Element:
    """The page's tree; children are elements and decoded texts."""
    root = Element("#root")
    stack, at = [root], 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            stack[-1].children.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(html.unescape(page[at:m.start()]))
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if tag not in BLOCK and stack[depth].tag in BLOCK:
                    break  # a stray closing tag of an inline element ends no block
            continue
        _close(stack, tag)
        element = Element(tag, m[3] if m[2] else m[6])
        stack[-1].children.append(element)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            element.children.append(page[at:end.start() if end else len(page)])
            at = end.end() if end else len(page)
        elif tag not in VOID:
            stack.append(element)
    return root


def _close(stack: list[Element], tag: str) -> None:
    """End the elements that the opening tag ends by itself."""
    if tag in CLOSES:
        ended, scope = CLOSES[tag]
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in ended:
                del stack[depth:]
                if tag in ("li", "option"):
                    break
            elif stack[depth].tag in scope:
                break
    elif tag in BLOCK:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag == "p":
                del stack[depth:]
                break
            if stack[depth].tag in P_SCOPE:
                break


def never_text(e: Element, in_article: bool) -> bool:
    if e.tag in NEVER_TAGS or e.role in NEVER_ROLES:
        return True
    if e.tag == "header" and not in_article:
        return True
    if not (e.classes or e.id) or e.tag in ("html", "body", "article", "main") or in_article and e.tag not in NAMED:
        return False
    if e.id and e.tag not in ID_KEPT and NEVER_IDS.fullmatch(e.id.replace("_", "-")):
        return True
    return any(map(NEVER_NAMES.match, e.classes.split()))


def _state(e: Element):
    return xxhash.xxh3_64(f"{e.tag}\x00{e.classes}\x00{e.id}\x00".encode())


def subtrees(root: Element):
    """(element, hash, inside an article or main element) for each element, children first."""
    stack = [(root, _state(root), False, iter(root.children))]
    while stack:
        e, state, inside, rest = stack[-1]
        for c in rest:
            if isinstance(c, Element):
                stack.append((c, _state(c), inside or e.tag in ("article", "main"), iter(c.children)))
                break
            if text := " ".join(c.split()):
                state.update(text.encode("utf-8", "replace"))
                state.update(b"\x01")
        else:
            stack.pop()
            if stack:
                value = state.intdigest()
                stack[-1][1].update(value.to_bytes(8, "big"))
                yield e, value, inside


def can_be_template(e: Element, inside: bool) -> bool:
    return e.tag in CONTAINERS if inside else e.tag not in ("html", "head", "body", "main", "article")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def template_key(e: Element, h: int) -> int:
    """The hash as a long; its last bit tells containers from other elements."""
    return _signed(h & ~1 | (e.tag in CONTAINERS))


def template_hashes(page: str | Element) -> set[int]:
    root = page if isinstance(page, Element) else parse(page)
    return {template_key(e, h) for e, h, inside in subtrees(root) if can_be_template(e, inside)}


def _blocks(e: Element, in_article: bool, out: list[list[str]]) -> None:
    stack = [(e, in_article, iter(e.children))]
    while stack:
        e, inside, rest = stack[-1]
        for c in rest:
            if isinstance(c, str):
                out[-1].append(c)
            elif c.tag == "br":
                out[-1].append(" ")
            elif not never_text(c, inside):
                if c.tag in BLOCK:
                    out.append([])
                stack.append((c, inside or c.tag == "article", iter(c.children)))
                break
        else:
            stack.pop()
            if stack and e.tag in BLOCK:
                out.append([])


def _text(e: Element, in_article: bool) -> str:
    out: list[list[str]] = [[]]
    _blocks(e, in_article, out)
    return "\n".join(t for t in (" ".join("".join(b).split()) for b in out) if t)


def _articles(e: Element, tags: tuple[str, ...]) -> list[Element]:
    found, ahead = [], e.children[::-1]
    while ahead:
        c = ahead.pop()
        if isinstance(c, Element) and not never_text(c, False):
            if c.tag in tags or c.role in tags:
                found.append(c)
            else:
                ahead.extend(c.children[::-1])
    return found


def main_text(page: str | Element, templates: frozenset[int]) -> str:
    root = page if isinstance(page, Element) else parse(page)
    if templates:
        gone = {id(e) for e, h, inside in subtrees(root) if can_be_template(e, inside) and template_key(e, h) in templates}
        ahead = [root] if gone else []
        while ahead:
            e = ahead.pop()
            e.children = [c for c in e.children if id(c) not in gone]
            ahead.extend(c for c in e.children if isinstance(c, Element))
    for tags in (("article",), ("main",)):
        texts = [_text(e, True) for e in _articles(root, tags)]
        if texts:
            return max(texts, key=len)
    return _text(root, False)


def page_hashes(batches):
    """Of (host, html): (host, page, hashes); page is a hash of the main text, hashes are sorted."""
    for batch in batches:
        page, hashes = [], []
        for markup in batch["html"].to_pylist():
            root = parse(markup)
            hashes.append(sorted(template_hashes(root)))
            text = main_text(root, frozenset())
            page.append(_signed(xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"))))
        yield pa.RecordBatch.from_pydict({"host": batch["host"], "page": pa.array(page, pa.int64()),
                                          "hashes": pa.array(hashes, pa.list_(pa.int64()))})


def extract(batches):
    """Of (..., html, templates): both replaced by text."""
    for batch in batches:
        texts = [main_text(page, frozenset(t or ())) if page else "" for page, t in
                 zip(batch["html"].to_pylist(), batch["templates"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pydict({c: batch[c] for c in batch.schema.names if c not in ("html", "templates")}
                                         | {"text": pa.array(texts, pa.string())})


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def site_templates(pages: DataFrame) -> DataFrame:
    """(host, templates) from (url, html)."""
    ready(pages.sparkSession)
    seen = (pages.select(host_of(F.col("url")).alias("host"), "html").where("host <> '' AND html IS NOT NULL")
            .mapInArrow(page_hashes, "host string, page bigint, hashes array<bigint>")
            .groupBy("host", "page").agg(F.min("hashes").alias("hashes")))
    # the null hash counts the host's pages
    counted = cut_lineage(seen.select("host", F.explode(F.concat("hashes", F.array(F.lit(None).cast("bigint")))).alias("hash"))
                          .groupBy("host", "hash").agg(F.count("*").alias("pages"))
                          .where(f"hash IS NULL OR pages >= {MIN_PAGES}"))
    of_host = counted.where("hash IS NULL").select("host", F.col("pages").alias("every"))
    often = counted.where("hash IS NOT NULL").join(of_host, "host")
    share = F.when(F.col("hash").bitwiseAND(1) == 1, CONTAINER_SHARE).otherwise(SHARE)
    return often.where(F.col("pages") >= share * F.col("every")).groupBy("host").agg(F.collect_list("hash").alias("templates"))


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) from (page_id, url, html)."""
    key = pages.schema["page_id"].dataType.simpleString()
    with_host = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    # a page without a host has no partner in the join; its key is spread
    spread = F.when(F.col("host") == "", F.concat(F.lit("\x00"), F.xxhash64("page_id", "html"))).otherwise(F.col("host"))
    joined = with_host.withColumn("host", spread).join(site_templates(with_host), "host", "left")
    texts = joined.select("page_id", "url", "html", "templates").mapInArrow(extract, f"page_id {key}, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op5_site_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))
