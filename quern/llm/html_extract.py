"""Main-text extraction by equivalence classes of template tokens.

Tokens of a page are its elements (as paths of tags) and its text blocks at their paths. Two tokens are in one
equivalence class if they occur equally often on the same pages of a host. Occurrence vectors over all pages
are never built: a host's token has a page count and the exclusive-or of a hash of (page, count), so equal
vectors have equal fingerprints and everything aggregates map-side. Classes with enough pages and tokens are
valid; nested by path they are the host's template.

The template's elements are its slots, and how their fill varies over the host's pages decides them. From the page
inwards, the slot that holds most of the text outside links, once a page, is entered as long as there is one: the last
is the article. What is named as boilerplate weighs nothing there, so that more comments than article don't win; slots
that hold most of the text on other pages are entered too, as the articles of other layouts. Slots in it are dropped where they hold links or the same fill on most pages; text blocks that are
template tokens themselves are dropped, but headings right before the article's own text; paragraphs and headings right beside it, on the way in, belong to it, and
headings of the first rank anywhere if they vary. All else is outside. Element and class names decide nothing there but
forms, scripts and what HTML itself calls navigation, an aside or a footer, and, within the article, lesser parts that
are named as comments, adverts and the like: those vary from page to page as articles do, so no template tells them.

Pages of a host with the same text count once, so an article's copies don't make it a template. Tokens kept of a host
appear on a fifth of its different pages at least, so a template's size is bounded by what five pages hold, whatever the
number of pages.

Defined results: null or empty html gives the empty text; pages cut off anywhere keep their text up to there; a
page whose host has few pages, or none, or which lacks the host's article slot, is read by its elements and their names
alone; a null url has the host ''; repeated rows are pages of their own; equal weights of slots go by token; other
columns are never looked at; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, durable, read

#: A valid class: pages, share of the host's pages, tokens.
MIN_PAGES, MIN_SHARE, MIN_TOKENS = 3, 0.2, 2
#: Share of a slot's text that a slot in it has to hold to be entered; share of links from which a slot is a list of these.
ENTERED, LINKS = 0.7, 0.8
#: Share of a slot's pages that slots of different layouts in it may have together; share of a text that readers' words may be.
LAYOUTS, READ = 1.05, 0.9
#: Template tokens (about 80 bytes each) that are broadcast; beyond it pages meet their template by salted host.
BROADCAST_TOKENS, SALT = 200_000, 64

# What HTML defines as void, raw and block elements, and what marks boilerplate.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe textarea select svg math canvas object audio video xmp title".split())
BLOCK = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()) - {"br"}
CLOSES_P = BLOCK - {"option", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
TEXT_BLOCKS = HEADINGS | set("p li blockquote pre td th dd dt figcaption".split())
GONE_TAGS = set("nav footer aside form button menu dialog head label fieldset".split())
BOILERPLATE_NAMES = set(
    "ad ads advert adverts advertisement advertisements advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus discussion footer form hidden login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe teaser toolbar topbar widget widgets".split()
)
#: Readers' words: never the article, however much of a page they are.
READERS = set("comment comments discussion disqus replies reply respond".split())
#: What may stand beside a telling word in a name, as in comment-list or footer-inner, and tells nothing itself.
NEUTRAL = set("area article articles aside bar block body bottom box button buttons col column container content count feed foot form group head header heading holder icon icons inner item items label left link links list main media menu nav news outer page panel post posts primary region right row secondary section site slot slots text thread title top unit user users widget wrap wrapper zone".split())
BOILERPLATE_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=/\"']+)")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)



class Node:
    __slots__ = ("chars", "gone", "header", "hint", "key", "links", "parent", "path", "region", "tag")

    def __init__(self, tag: str, path: str, parent: Node | None, gone: bool = False, hint: int = 0, header: bool = False, region: str = "") -> None:
        self.tag, self.path, self.parent, self.gone, self.hint, self.header, self.region = tag, path, parent, gone, hint, header, region
        self.chars = self.links = 0
        self.key = 0

    def above(self) -> Iterator[Node]:
        """This element and those around it."""
        node: Node | None = self
        while node is not None:
            yield node
            node = node.parent


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text) if text.strip(" /") else ():
        name = (m[1] or m[5]).lower()
        out.setdefault(name, unescape(m[2] or m[3] or m[4] or ""))
    return out


def _opened(tag: str, attributes: dict[str, str], parent: Node) -> Node:
    named = [{x.lower() for x in _NAMES.findall(name)} for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split()] if attributes else []
    names = set().union(*named)
    role = attributes.get("role", "").lower()
    region = parent.region
    if tag == "article" or role == "article":
        region = "article"
    elif region != "article" and (tag == "main" or role == "main"):
        region = "main"
    gone = parent.gone or tag in GONE_TAGS or role in BOILERPLATE_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(_HIDDEN.search(attributes.get("style", "")))
    # a name tells where all of its words do, or nothing else: social-share, not social-history
    hint = 0 if tag in ("html", "body") else max([1 + bool(x & READERS) for x in named if x & BOILERPLATE_NAMES and all(w in BOILERPLATE_NAMES or w in NEUTRAL or w.isdigit() for w in x)], default=0)
    first = attributes.get("class", "").split()[:1]
    return Node(tag, f"{parent.path}/{tag}{'.' + first[0] if first else ''}", parent, gone, hint, tag == "header" or "header" in names and tag not in ("html", "body"), region)


def parse(html: str) -> tuple[list[Node], list[tuple[str, Node]]]:
    """The page's block elements, and its text blocks with the innermost element of each, in order; what is hidden or no text by its tag is left out."""
    root = Node("", "", None)
    nodes: list[Node] = [root]
    blocks: list[tuple[str, Node]] = []
    stack, text, linked, at, n = [root], [], [], 0, len(html)
    skip: list[str] = []  # open tags from a dropped inline element on
    link = 0  # depth of the stack where a link is open

    def ended() -> None:
        joined = " ".join(unescape("".join(text)).split())
        if joined and not stack[-1].gone:
            blocks.append((joined, stack[-1]))
            inside = len(" ".join(unescape("".join(linked)).split()))
            for node in stack:
                node.chars += len(joined)
                node.links += inside
        text.clear()
        linked.clear()

    def said(raw: str) -> None:
        if not skip:
            text.append(raw)
            if link:
                linked.append(raw)

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            said(html[at:])
            break
        said(html[at:lt])
        m = _TOKEN.match(html, lt)
        if not m:
            said("<")
            at = lt + 1
            continue
        at = m.end()
        tag, closes = (m[2] or "").lower(), bool(m[1])
        if not tag:
            continue
        if tag == "br":
            said(" ")
        if not closes and tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            if not m[3].rstrip().endswith("/") or tag not in ("svg", "math"):
                at = close.end() if close else n
            continue
        if skip:
            if not closes:
                if tag in CLOSES_P and stack[-1].tag == "p":  # ends the paragraph and with it what is dropped there
                    skip.clear()
                else:
                    skip += [] if tag in VOID else [tag]
                    continue
            elif tag in skip:
                del skip[len(skip) - 1 - skip[::-1].index(tag) :]
                continue
            elif any(e.tag == tag for e in stack):
                skip.clear()
            else:
                continue
        if tag not in BLOCK:
            # an inline element that hides or marks boilerplate is dropped with its content; others are transparent
            if tag in VOID:
                continue
            if closes:
                link = 0 if tag == "a" else link
                continue
            attributes = _attributes(m[3])
            if attributes or tag in GONE_TAGS:
                inline = _opened(tag, attributes, stack[-1])
                if inline.hint or inline.gone and not stack[-1].gone:
                    skip.append(tag)
                    continue
            link = len(stack) if tag == "a" else link
            continue
        ended()
        if closes:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            link = link if link <= len(stack) else 0
            continue
        if tag in CLOSES_P and stack[-1].tag == "p":
            stack.pop()
        if stack[-1].tag == tag and tag in ("li", "td", "th", "tr", "dd", "dt", "option"):
            stack.pop()
        if tag in VOID:
            continue
        stack.append(_opened(tag, _attributes(m[3]), stack[-1]))
        nodes.append(stack[-1])
    ended()
    return nodes, blocks


def _key(path: str, text: str = "") -> int:
    return int.from_bytes(blake2b(f"{path}\n{text}".encode(), digest_size=8).digest(), "little", signed=True)


ROOT = _key("")
#: Kinds of tokens: a text block, an element, a heading of the first rank, another element of running text, an element named as boilerplate.
TEXT, ELEMENT, TITLE, RUNNING, NAMED = range(5)


def page_tokens(html: str) -> dict[int, list[int]]:
    """Of each token of a page: kind, how often it occurs, the token of the element around it, characters, characters in links, and a hash of its fill."""
    nodes, blocks = parse(html)
    out: dict[int, list[int]] = {}
    keys: dict[str, int] = {}
    for node in nodes[1:]:
        if not node.gone:
            node.key = keys.get(node.path) or keys.setdefault(node.path, _key(node.path))
            kind = TITLE if node.tag == "h1" else RUNNING if node.tag in TEXT_BLOCKS else NAMED if node.hint else ELEMENT
            x = out.setdefault(node.key, [kind, 0, node.parent.key or ROOT, 0, 0, 0])
            x[1] += 1
            x[3] += node.chars
            x[4] += node.links
    for text, innermost in blocks:
        key = _key(innermost.path, text)
        out.setdefault(key, [TEXT, 0, innermost.key or ROOT, 0, 0, 0])[1] += 1
        for node in innermost.above():
            if node.key:
                x = out[node.key]
                x[5] = (x[5] * 0x100000001B3 + key) & 0x7FFFFFFFFFFFFFFF
    return out


class Template:
    """What of a host's pages is its article, from the valid tokens (token, around, kind, pages, n, chars, links, fills)."""

    def __init__(self, tokens: list[dict]) -> None:
        self.texts = {t["token"] for t in tokens if t["kind"] == TEXT}
        elements = {t["token"]: t for t in tokens if t["kind"] != TEXT}
        within: dict[int, list[dict]] = {}
        for t in elements.values():
            within.setdefault(t["around"], []).append(t)
        most = max((t["pages"] for t in elements.values()), default=0)
        weights = {k: t["chars"] - t["links"] for k, t in elements.items()}
        for t in elements.values():  # what is named as boilerplate weighs nothing, in itself and in what lies around it
            if t["kind"] == NAMED and weights[t["token"]] > 0:
                said, at, seen = weights[t["token"]], t["token"], set()
                while at in weights and at not in seen:
                    seen.add(at)
                    weights[at] -= said
                    at = elements[at]["around"]

        def entered(way: list[int]) -> Iterator[list[int]]:
            """The ways on from a slot: into the slot in it with most text, and into others on other pages, as those of another layout."""
            whole, used = elements.get(way[-1]), 0
            kids = sorted((t for t in within.get(way[-1], ()) if t["kind"] == ELEMENT), key=lambda t: (-weights[t["token"]], -t["token"]))
            held, pages = (weights[way[-1]], whole["pages"]) if whole else (sum(weights[t["token"]] for t in kids), most)
            for t in kids:
                here = weights[t["token"]]
                if here <= 0 or t["n"] > t["pages"] or t["token"] in way or used + t["pages"] > LAYOUTS * pages or here < ENTERED * held * min(1.0, t["pages"] / max(1, pages)) or not used and 2 * t["pages"] < pages:
                    continue
                used += t["pages"]
                yield [*way, t["token"]]

        self.ways: dict[int, list[int]] = {}
        open_ways = [[ROOT]]
        while open_ways:
            way = open_ways.pop()
            further = list(entered(way))
            open_ways += further
            if not further and len(way) > 1:
                self.ways.setdefault(way[-1], way)
        self.main = max(self.ways, key=lambda k: (weights[k], k), default=None)
        self.way = self.ways.get(self.main, [ROOT])
        on_the_way = {k for way in self.ways.values() for k in way}
        #: slots with the same fill on most pages, and lists of links
        self.same = {k for k, t in elements.items() if t["chars"] and 2 * t["fills"] <= t["pages"]}
        self.dropped = {k for k, t in elements.items() if t["kind"] in (ELEMENT, NAMED) and t["chars"] and k not in on_the_way and (k in self.same or t["links"] > LINKS * t["chars"])}
        self.titles = {k for k, t in elements.items() if t["kind"] == TITLE and k not in self.same and t["n"] == t["pages"]}


def _lesser(node: Node, chars: int) -> bool:
    """Whether the element names itself boilerplate and is a lesser part, or readers' words beside some text of the author's."""
    return bool(node.hint) and (2 * node.chars <= chars or node.hint > 1 and node.chars <= READ * chars)


def _told_by_template(nodes: list[Node], blocks: list[tuple[str, Node]], template: Template) -> list[tuple[str, Node]] | None:
    keys: dict[str, int] = {}
    for node in nodes:
        node.key = keys.get(node.path) or keys.setdefault(node.path, _key(node.path))
    article = next((node for node in nodes if node.key in template.ways), None)
    if article is None:
        return None
    beside = set(template.ways[article.key][3:-1])  # what lies around the article but html and body
    found = []
    for x in blocks:
        innermost = x[1]
        inside, dropped, byline = False, False, False
        for node in innermost.above():
            if node.key == article.key:
                inside = True
                break
            dropped = dropped or node.key in template.dropped or _lesser(node, article.chars)
            byline = byline or node.header
        if not inside:
            way_in = innermost.tag in TEXT_BLOCKS and innermost.key not in template.same and not innermost.hint
            if innermost.key in template.titles or way_in and innermost.parent.key in beside and 2 * innermost.links <= innermost.chars:
                found.append(x)
        elif not dropped and (not byline or innermost.tag in HEADINGS):
            found.append(x)
    own = [x for x in found if _key(x[1].path, x[0]) not in template.texts]
    # a heading that recurs belongs to the article if its own text comes next
    kept, inside = {id(x) for x in own}, {id(x) for x in found}
    kept |= {id(x) for x, after in zip(blocks, blocks[1:], strict=False) if x[1].tag in HEADINGS and id(x) in inside and after[1].tag not in HEADINGS and id(after) in kept}
    own = [x for x in found if id(x) in kept]
    # where most of the text recurs on the host's pages, it is a copy of an article: its paragraphs and the like are slots
    if 2 * sum(len(text) for text, _ in own) < sum(len(text) for text, _ in found):
        own = [x for x in found if x[1].tag in TEXT_BLOCKS or _key(x[1].path, x[0]) not in template.texts]
    return own


def _told_by_elements(blocks: list[tuple[str, Node]], template: Template | None) -> list[tuple[str, Node]]:
    found = blocks if template is None else [x for x in blocks if _key(x[1].path, x[0]) not in template.texts]
    whole = sum(len(text) for text, _ in found)
    found = [x for x in found if not any(_lesser(node, whole) or node.header and not node.region and 2 * node.chars <= whole for node in x[1].above())]
    held = {r: sum(len(text) for text, node in found if node.region == r) for r in ("article", "main")}
    if held["article"] and held["article"] >= ENTERED * sum(held.values()):
        found = [x for x in found if x[1].region == "article" or x[1].region == "main" and x[1].tag == "h1"]
    elif any(held.values()):
        found = [x for x in found if x[1].region]
    return [x for x in found if x[1].tag in HEADINGS or not any(node.header for node in x[1].above())]


def main_text(html: str, template: Template | None = None) -> str:
    """The article's blocks, joined by line ends."""
    nodes, blocks = parse(html)
    found = _told_by_template(nodes, blocks, template) if template and template.main else None
    return "\n".join(text for text, _ in (_told_by_elements(blocks, template) if found is None else found))


_TOKEN_COLUMNS = (("host", pa.string()), ("token", pa.int64()), ("page", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("around", pa.int64()), ("chars", pa.int64()), ("links", pa.int64()), ("fill", pa.int64()))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: tuple[list, ...] = tuple([] for _ in _TOKEN_COLUMNS)
        for page, host, html in zip(batch.column("page").to_pylist(), batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            for k, x in page_tokens(html or "").items():
                for c, v in zip(columns, (host, k, page, *x), strict=True):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _TOKEN_COLUMNS, strict=True)], names=[name for name, _ in _TOKEN_COLUMNS])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [_key("", "\n".join(text for text, node in parse(html or "")[1])) for html in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page"), batch.column("host"), pa.array(keys, pa.int64())], names=["page", "host", "content"])


def host_of(url):
    """The url's host and port, lower-cased; '' if it has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("")))


def deduce_templates(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, pages, share, vector, tokens) of every valid class that is nested in the host's template, computed once.

    A token is nested if the element around it is the page itself or a template token too.
    """
    rows = pages.select(F.xxhash64(F.monotonically_increasing_id(), col(id_col)).alias("page"), host_of(col(url_col)).alias("host"), col(html_col).cast("string").alias("html"))
    # a page of each content; the others are its copies
    contents = durable(rows.mapInArrow(_contents, "page bigint, host string, content bigint"))
    kept = durable(contents.groupBy("host", "content").agg(F.min("page").alias("page"), F.count("*").alias("n")))
    copies = contents.join(kept.where("n > 1").select("host", "content", F.col("page").alias("kept")), ["host", "content"]).where("page != kept").select("page")
    copies = durable(copies)
    side = F.broadcast(copies) if copies.limit(BROADCAST_TOKENS + 1).count() <= BROADCAST_TOKENS else copies
    tokens = rows.join(side, "page", "left_anti").mapInArrow(_tokens, "host string, token bigint, page bigint, kind int, n bigint, around bigint, chars bigint, links bigint, fill bigint")
    sums = [F.min("around").alias("around"), F.min("kind").alias("kind"), *[F.sum(c).alias(c) for c in ("n", "chars", "links")]]
    filled = tokens.groupBy("host", "token", "fill").agg(F.count("*").alias("pages"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"), *sums)
    vectors = filled.groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.bit_xor("vector").alias("vector"), F.count("*").alias("fills"), *sums).where(F.col("pages") >= MIN_PAGES)
    sizes = kept.groupBy("host").agg(F.count("*").alias("all"))
    often = durable(vectors.join(sizes, "host").where(F.col("pages") >= F.col("all") * MIN_SHARE))
    whole = often.select("host", F.lit(ROOT).alias("around")).distinct()
    nested = often.join(often.select("host", F.col("token").alias("around")).unionByName(whole), ["host", "around"], "left_semi")
    token = F.struct("token", "around", "kind", "pages", "n", "chars", "links", "fills")
    classes = nested.groupBy("host", "all", "pages", "vector").agg(F.sort_array(F.collect_list(token)).alias("tokens")).where(F.size("tokens") >= MIN_TOKENS)
    return durable(classes.select("host", "pages", (F.col("pages") / F.col("all")).alias("share"), "vector", "tokens"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    told: dict[str, Template] = {}  # the last hosts'
    for batch in batches:
        texts, templates = [], batch.column("template")
        for i, (host, html) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True)):
            if host not in told and templates[i].is_valid:
                if len(told) >= 256:
                    told.clear()
                told[host] = Template(templates[i].as_py())
            texts.append(main_text(html, told.get(host)) if html else "")
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    classes = deduce_templates(pages, id_col, url_col, html_col)
    n = classes.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    templates = classes.groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("template"))
    rows = pages.select(col(id_col).alias("page_id"), col(url_col).alias("url"), host_of(col(url_col)).alias("host"), col(html_col).cast("string").alias("html"))
    if n <= BROADCAST_TOKENS:
        met = rows.join(F.broadcast(templates), "host", "left")
    else:
        salted = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        met = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int")).join(salted, ["host", "salt"], "left")
    ids = rows.schema["page_id"].dataType.simpleString()
    out = met.select("page_id", "url", "host", "html", "template").mapInArrow(_extract, f"page_id {ids}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("bigint"))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
