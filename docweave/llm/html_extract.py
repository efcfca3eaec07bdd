"""Main text of web pages by a site style tree.

The whole DOMs of a host are merged: a style node is a path of block elements with their classes and roles, seen from the
root. Over the host's pages a node has

* a presentation entropy: in bits, of what follows what below it (child elements, and texts by their order of length);
* a content importance: 1 less the entropy of its texts as a share of the greatest possible, where every text is a
  unit of its own, so a menu that differs in one entry still repeats all others.

What a page is about varies in both: its presentation from page to page, as articles have other numbers of paragraphs, and its
words. A template's slots keep their shape even if their words change, and menus and notices repeat their words. A node
takes the presentation of the liveliest region around it, as a share of the host's liveliest. Tags, roles and class
names only weigh: an importance is shrunk towards a neutral one by PRIOR pages and multiplied by the weight of an article, of a
branch that looks like a menu, advert or form, or of anything else, so a host with few pages rests on the marks and one
with many on its statistics. Branches of low importance leave the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, session

#: Pages that the neutral importance of 0.5 counts for beside a node's own statistics.
PRIOR, NEUTRAL = 4, 0.5
#: Bits that are added to presentation entropies before they are compared: hosts whose pages all look alike tell nothing.
LEAST_BITS = 0.25
#: Importance of texts that every page repeats, to that of texts of which each page has its own.
REPEATED = 0.25
#: A block stays if its node has this importance, and this share of the page's greatest.
IMPORTANCE, SHARE = 0.1, 0.5
#: Weights of branches marked as menus, adverts, forms and the like, of anything else, and of articles.
MARKED, PLAIN, ARTICLE = 0.15, 0.45, 1.0
#: Elements nested deeper belong to the node at this depth; their text stays in it.
DEPTH = 32

# Fixed values of HTML: elements without content, elements with raw text, elements that are never shown as text, and
# elements that break a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp plaintext".split())
UNSEEN = frozenset("head template noscript object svg canvas audio video map datalist select".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: Elements that seldom hold main text.
NOISE_TAGS = frozenset("nav footer header aside form button label fieldset dialog menu search".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar note status".split())
#: Parts of class names and ids of such elements; whole parts between hyphens, underscores and changes of case.
NOISE_PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners nav navbar "
    "navigation menu menus breadcrumb breadcrumbs footer header masthead topbar sidebar sidebars aside widget widgets comment comments "
    "commentlist disqus replies reply respond cookie cookies consent gdpr notice notices popup modal overlay subscribe subscription feedback responses "
    "newsletter signup login share sharing social related recommended pagination pager toolbar skip hidden copyright legal disclaimer "
    "alert toast search paywall".split()
)
#: Elements that hold the article.
_ARTICLE = ("article", "main")
#: An open <p> or list item ends where one of these begins.
_ENDS_P = BLOCK - {"br"}
_ITEMS = ("li", "dt", "dd", "tr", "td", "th", "option")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?[A-Za-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.S)
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_ATTRS = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_WHITE = re.compile(r"\s+")


def attributes(tag: str, name: str) -> dict[str, str]:
    inner = tag[1 + len(name) : -1]
    if not inner.strip(" /\n\t"):
        return {}
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRS.finditer(inner)}


def is_marked(name: str, attrs: dict[str, str]) -> bool:
    """Whether an element's tag, role, class or id says that its branch is no main text."""
    if name in NOISE_TAGS:
        return True
    if not attrs or name in ("html", "body"):
        return False
    if name in _ARTICLE:
        return not NOISE_PARTS.isdisjoint(attrs.get("class", "").lower().split())
    if attrs.get("role", "").lower() in NOISE_ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return True
    for mark in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        # "has-sidebar" speaks of another element
        parts = [x.lower() for x in _PARTS.findall(mark)]
        if parts and parts[0] not in ("has", "with", "no", "without") and not NOISE_PARTS.isdisjoint(parts):
            return True
    return False


def style(name: str, attrs: dict[str, str]) -> str:
    """An element as the style tree sees it: class and role; ids and long numbers tell pages apart and don't count."""
    if not attrs:
        return name
    marks = [re.sub(r"\w*\d{3}\w*", "0", attrs[k].strip()) for k in ("class", "role") if attrs.get(k)]
    return name + "".join(f"[{' '.join(sorted(x.split()))}]" for x in marks)


def _name(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x.encode()) - 2**63


@lru_cache(1 << 16)
def _child(parent: int, own: str) -> int:
    """Signed 64-bit name of a style node."""
    return _name(f"{parent}>{own}")


class Page:
    """blocks: (node, text) in page order. nodes: per style node its ancestors (root first), weight and children so far.

    ``weigh``: tags, roles, classes and ids weigh; else all nodes weigh the same. Tolerates what browsers do: unclosed
    paragraphs, list items and inline elements, end tags without a start, a broken-off page. An end tag closes up to its start
    tag; one without a start is passed over.
    """

    ROOT = _name("")

    def __init__(self, page: str, weigh: bool = True):
        self.blocks: list[tuple[int, str]] = []
        self.nodes: dict[int, tuple[tuple[int, ...], float, list]] = {self.ROOT: ((), PLAIN if weigh else ARTICLE, [])}
        self._read(page, weigh)

    def shape(self, node: int) -> int:
        """What follows what below a node, all of its places on the page in order."""
        return _name(" ".join(map(str, self.nodes[node][2])))

    def _read(self, page: str, weigh: bool) -> None:
        path: list[tuple[str, int, bool, bool, bool]] = []  # name, node, unseen, marked, in an article: here or above
        text: list[str] = []

        def flush() -> None:
            if text:
                joined = _WHITE.sub(" ", html.unescape("".join(text))).strip()
                text.clear()
                if joined:
                    node = path[-1][1] if path else self.ROOT
                    self.blocks.append((node, joined))
                    self.nodes[node][2].append((joined.count(" ") + 1).bit_length())

        def close(k: int) -> None:
            """Close the elements from place k on."""
            above = path[k - 1][1] if k else self.ROOT
            if path[-1][1] != above or any(n in BLOCK for n, *_ in path[k:]):
                flush()
            del path[k:]

        def enter(name: str, attrs: dict[str, str]) -> None:
            _, node, unseen, noisy, article = path[-1] if path else ("", self.ROOT, False, False, False)
            noise = weigh and is_marked(name, attrs) and not (name == "header" and article)
            if name in BLOCK or noise and not noisy:
                flush()
                ups, _, children = self.nodes[node]
                noisy, article = noisy or noise, article or name in _ARTICLE
                if len(ups) < DEPTH:
                    own = style(name, attrs) + "!" * noise
                    children.append(own)
                    child = _child(node, own)
                    if child in self.nodes:
                        self.nodes[child][2].append("/")  # another element of the same node
                    else:
                        self.nodes[child] = ((*ups, node), (MARKED if noisy else ARTICLE if article else PLAIN) if weigh else ARTICLE, [])
                    node = child
            path.append((name, node, unseen or name in UNSEEN, noisy, article))

        at, raw = 0, ""
        while True:
            if raw:
                m = re.compile(rf"</{raw}\s*/?>", re.I).search(page, at)
                at, raw = (m.end(), "") if m else (len(page), "")
            m = _TOKEN.search(page, at)
            end = m.start() if m else len(page)
            if end > at and not (path and path[-1][2]):
                text.append(page[at:end])
            if not m:
                break
            at, tag = m.end(), m[0]
            if tag[1] in "!?":
                continue
            name = _NAME.match(tag)[1].lower()
            if tag[1] == "/":
                k = next((k for k in range(len(path) - 1, -1, -1) if path[k][0] == name), -1)
                if k >= 0:
                    close(k)
                elif name in ("p", "br"):
                    flush()
                continue
            if name in _ENDS_P:
                k = next((k for k in range(len(path) - 1, -1, -1) if path[k][0] in BLOCK), -1)
                if k >= 0 and path[k][0] == "p":
                    close(k)
                    k = next((k for k in range(len(path) - 1, -1, -1) if path[k][0] in BLOCK), -1)
                if k >= 0 and path[k][0] == name and name in _ITEMS:
                    close(k)
            if name in RAW:
                raw = name
            elif name in VOID:
                if name in BLOCK:
                    flush()
            elif not (tag.endswith("/>") and name in ("path", "rect", "circle", "use")):
                enter(name, attributes(tag, name))
        flush()


def main_text(page: str, importance: dict[int, float] | None = None, weigh: bool = True) -> str:
    """The page's blocks whose nodes are important, joined by newlines.

    importance: that of the host's nodes; a node that no other page of the host has is its weight times NEUTRAL.
    """
    read, known = Page(page, weigh), importance or {}
    worth = [known.get(node, read.nodes[node][1] * NEUTRAL) for node, _ in read.blocks]
    least = max(IMPORTANCE, SHARE * max(worth, default=0.0))
    return "\n".join(text for (_, text), w in zip(read.blocks, worth, strict=True) if w >= least)


def host_of() -> Column:
    """Host in lower case without user, port and scheme; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


_SEEN = pa.schema([("host", pa.string()), ("node", pa.int64()), ("text", pa.bool_()), ("value", pa.int64()), ("ups", pa.list_(pa.int64())), ("weight", pa.float64()), ("n", pa.int64())])


def _nodes(weigh: bool):
    """Pages that show a shape (with the node's ancestors and weight) or a text at a node, added up over a batch."""

    def run(batches):
        for batch in batches:
            seen: Counter = Counter()
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                read = Page(page, weigh)
                for node, (ups, weight, _) in read.nodes.items():
                    seen[host, node, False, read.shape(node), ups, weight] += 1
                for node, text in set(read.blocks):
                    seen[host, node, True, _name(text), None, None] += 1
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*((*k, n) for k, n in seen.items()), strict=True), _SEEN, strict=True)] if seen else [pa.array([], f.type) for f in _SEEN], schema=_SEEN)

    return run


def style_tree(pages: DataFrame, weigh: bool = True) -> DataFrame:
    """Per host and style node that two pages or more have: pages, ups (its ancestors), weight, bits (entropy of its presentation),
    content (importance of its texts; null if it holds none itself), importance (null as content).

    All counts are combined before they are shuffled, and every shape and text of a node is a key of its own, so a hot
    host's parts are spread. pages: host, html.
    """
    seen = pages.mapInArrow(_nodes(weigh), "host string, node long, text boolean, value long, ups array<long>, weight double, n long")
    counts = seen.groupBy("host", "node", "text", "value", "ups", "weight").agg(F.sum("n").alias("n"))
    of = lambda c, text: F.sum(F.when(F.col("text") == text, c))
    logs = F.col("n") * F.log2("n")
    sums = counts.groupBy("host", "node").agg(
        of(F.col("n"), False).alias("pages"), of(logs, False).alias("a"), of(F.col("n"), True).alias("units"), of(logs, True).alias("b"), F.max("ups").alias("ups"), F.max("weight").alias("weight")
    )
    each = sums.filter("pages > 1").select(
        "host", "node", "pages", "ups", "weight", F.greatest(F.lit(0.0), F.log2("pages") - F.col("a") / F.col("pages")).alias("bits"),
        F.when(F.col("units") > 0, F.greatest(F.lit(0.0), 1 - F.col("b") / F.col("units") / F.log2("pages"))).alias("content"),
    )
    each = scratch(each, "nodes")
    top = each.groupBy("host").agg(F.max("bits").alias("top"))
    # what surrounds a node, itself included; a key is a host's node
    around = each.filter("content is not null").select("host", F.col("node").alias("leaf"), F.explode(F.concat("ups", F.array("node"))).alias("node"))
    region = around.join(each.select("host", "node", "bits"), ["host", "node"]).groupBy("host", F.col("leaf").alias("node")).agg(F.max("bits").alias("region"))
    both = each.join(region, ["host", "node"], "left").join(top, "host")
    lively = (F.col("region") + LEAST_BITS) / (F.col("top") + LEAST_BITS)
    more = F.col("pages") - 1
    worth = F.col("weight") * (more * (REPEATED + (1 - REPEATED) * F.col("content")) * lively + PRIOR * NEUTRAL) / (more + PRIOR)
    return both.select("host", "node", "pages", "ups", "weight", "bits", "content", F.round(worth, 9).alias("importance"))


def _extract(weigh: bool):
    def run(batches):
        held: dict = {}
        for batch in batches:
            found = []
            hosts, nodes, worth = (batch.column(c) for c in ("host", "nodes", "worth"))
            for k, (host, page) in enumerate(zip(hosts.to_pylist(), batch.column("html").to_pylist(), strict=True)):
                if host not in held:
                    if len(held) > 256:
                        held.clear()
                    held[host] = dict(zip(nodes[k].as_py() or (), worth[k].as_py() or (), strict=True))
                found.append(main_text(page, held[host], weigh))
            yield pa.record_batch(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return run


def extract_pages(pages: DataFrame, weigh: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of every page row, from its whole html.

    A null html is empty and gives an empty text, as does a page without main text; a text of any length is read whole. Pages
    without a host share one tree under an empty host name. Repeated rows give rows each and count as pages each; a null
    page_id stays null; other columns are ignored; an empty table gives an empty result. ``weigh``: as for Page.

    A host's nodes that hold text on two pages or more are kept in one row, joined by broadcast while all hosts' nodes
    fit the session's broadcast limit, else shuffled with AQE splitting skewed hosts.
    """
    session(pages)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"), host_of().alias("host"))
    tree = style_tree(rows.select("host", "html"), weigh).filter("importance is not null")
    known = tree.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("node", "importance"))).alias("x"))
    known = scratch(known.select("host", F.col("x.node").alias("nodes"), F.col("x.importance").alias("worth")), "importance")
    return rows.join(known, "host", "left").mapInArrow(_extract(weigh), "page_id long, url string, text string, n_chars long")


def op4_html_extract(pages: DataFrame) -> DataFrame:
    """The contract's columns: page_id, url, text, n_chars."""
    return extract_pages(pages)
