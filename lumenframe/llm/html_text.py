"""Main text of web pages, without what a site repeats.

1. A page is parsed into a tree (void and implied-end elements as browsers read them), and every
   block element's subtree is hashed: tag, texts, digests of children.
2. Spark counts for each host on how many *different* contents a subtree occurs; a content is the
   page's main text, so copies of an article count once and a much-copied article isn't taken for a
   template. Outside article and main a subtree is a template from `least` contents and `share` of
   the host's; inside them, where repeated passages are the author's own, from `least_inside` and
   `share_inside`.
3. Templates of the host are deleted from the whole tree: menus, notices, adverts and footers
   go here, whatever they are called.
4. What counts can't decide - parts that differ from page to page, hosts of fewer than `least`
   different contents - is pruned by kind: scripts, menus, footers, forms and so on, or a class, id
   or role that names one and nothing else (share-buttons, but not share-price-table).
5. The main text is that of the articles if they hold at least a quarter of what is left, else of
   main, else of the body. Elements that contain an article or main are never deleted.

Scale: the counts combine on the map side by (host, subtree) and are written once, so a page is
parsed twice: for the counts and for the text. At most (mean subtrees a page) / share templates of a
host can pass, so a host's list is bounded however many pages it has. The list goes
through a table whose size Spark knows: it is broadcast while that is below its threshold and
joined by sorting otherwise, where a host with most pages can be split.

Defined cases: null or empty html gives empty text; a null or odd url has host ''. Pages without
any element are text as they stand. Very long pages are held in one worker as one tree, nothing is
cut. Repeated rows give repeated rows, an empty table none; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import materialize, ship_package

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A block that begins inside an open p ends it; these bound the search for it, and for open items.
SCOPES = frozenset("article aside body button caption div footer header html main nav object section table td th".split())
ENDS = {"li": ("li", frozenset({"ul", "ol", "menu"})), "dt": ("dt dd", frozenset({"dl"})), "dd": ("dt dd", frozenset({"dl"})), "tr": ("tr td th", frozenset({"table"})), "td": ("td th", frozenset({"tr", "table"})), "th": ("td th", frozenset({"tr", "table"})), "option": ("option", frozenset({"select"}))}
DROPPED = frozenset("script style nav footer aside form noscript template iframe svg canvas button select textarea head title menu dialog audio video".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright discussion disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices popup promo promoted promotion related reply replies responses share sharing sidebar signup social sponsor sponsored subscribe subscription teaser toolbar widget".split()
)
#: Words that may stand beside one of NAMES in a class or id without making it another thing.
BESIDE = frozenset(
    "a aa and area article articles bar block blog bottom box btn button buttons card cards center col column container content desktop end entry extra feed fixed for form global group header holder icon icons inner item items js layout left link links list main media mobile module my new nested outer overlay page panel part post posts primary reader row right secondary section single site sm slot small stack start sticky stories story tag tags the thread title top unit user users wide wrap wrapper".split()
)
#: Names that make even an article element boilerplate.
CARDS = frozenset("ad ads advert advertisement comment comments promo promoted related reply replies responses sponsored teaser widget".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
KEPT_ROOTS = frozenset({"html", "body", "article", "main"})
_WORDS = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("attrs", "children", "digest", "tag")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children, self.digest = tag, attrs, [], 0


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def _close(self, names: tuple[str, ...] | frozenset, bounds: frozenset) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in names:
                del self.open[i:]
                return
            if tag in bounds:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ENDS:
            names, bounds = ENDS[tag]
            self._close(frozenset(names.split()), bounds)
        if tag in BLOCKS:
            self._close(("p",), SCOPES)
        node = Node(tag, {k: v or "" for k, v in attrs} if attrs else {})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("path", "circle", "rect", "g", "use"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def unknown_decl(self, data):
        pass


def parse(html: str) -> Node:
    tree = _Tree()
    try:
        tree.feed(html)
        tree.close()
    except AssertionError:  # a malformed <![ section
        tree = _Tree()
        tree.feed(html.replace("<![", "<!-- ["))
        tree.close()
    return tree.root


def named(attrs: dict, names: frozenset) -> bool:
    """Whether a class or the id is made of one of the names and words that may stand beside it."""
    for token in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = [w for w in _WORDS.findall(_CAMEL.sub("-", token).lower()) if not w.isdigit()]
        if any(w in names for w in words) and all(w in NAMES or w in BESIDE for w in words):
            return True
    return False


def boilerplate(node: Node, in_article: bool) -> bool:
    if node.tag in DROPPED:
        return True
    a = node.attrs
    if node.tag == "article":
        return bool(a) and named(a, CARDS)
    if node.tag == "header":
        return not in_article
    if not a or node.tag in KEPT_ROOTS:
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
        return True
    if a.get("role", "").lower() in ROLES:
        return True
    return named(a, NAMES - {"header"} if in_article else NAMES)


def prune(root: Node) -> None:
    """Take boilerplate elements out of the tree."""
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag in ("article", "main")
        node.children = [c for c in node.children if isinstance(c, str) or not boilerplate(c, inside)]
        stack.extend((c, inside) for c in node.children if not isinstance(c, str))


def _is_main(node: Node) -> bool:
    return node.tag == "main" or node.attrs.get("role") == "main"


def _outermost(root: Node, wanted) -> list[Node]:
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if wanted(node):
            found.append(node)
        else:
            stack.extend(c for c in reversed(node.children) if not isinstance(c, str))
    return found


def _weight(roots: list[Node]) -> int:
    """Characters of text that isn't white space."""
    n, stack = 0, list(roots)
    while stack:
        node = stack.pop()
        for c in node.children:
            if isinstance(c, str):
                n += sum(map(len, c.split()))
            else:
                stack.append(c)
    return n


def content(root: Node) -> list[Node]:
    """Main, else the body, or the outermost articles in it where they hold a quarter of its text."""
    whole = _outermost(root, _is_main)
    if not _weight(whole):
        whole = _outermost(root, lambda n: n.tag == "body") or [root]
    articles = [a for w in whole for a in _outermost(w, lambda n: n.tag == "article")]
    return articles if articles and 4 * _weight(articles) >= _weight(whole) else whole


def hash_subtrees(root: Node) -> list[tuple[Node, bool]]:
    """Set every element's digest (tag, texts with white space squeezed, digests of children). Block elements with children that hold no article or main, and whether they stand inside one."""
    order, stack = [], [(root, False)]
    while stack:
        node, inside = stack.pop()
        order.append((node, inside))
        below = inside or node.tag == "article" or _is_main(node)
        stack.extend((c, below) for c in node.children if not isinstance(c, str))
    holders = set()  # elements that are or hold an article or main
    for node, _ in reversed(order):
        parts, holds = [node.tag], node.tag in KEPT_ROOTS or _is_main(node)
        for c in node.children:
            if isinstance(c, str):
                parts.append(" ".join(c.split()))
            else:
                parts.append(f"\0{c.digest:016x}")
                holds = holds or id(c) in holders
        if holds:
            holders.add(id(node))
        node.digest = xxhash.xxh64_intdigest("\1".join(p for p in parts if p).encode("utf-8", "surrogatepass"))
    return [(n, inside) for n, inside in order[1:] if n.children and n.tag in BLOCKS and id(n) not in holders]


def delete(root: Node, outside: frozenset[int], inside: frozenset[int]) -> int:
    """Delete the host's templates from the whole tree; how many elements went."""
    gone = {id(n) for n, within in hash_subtrees(root) if n.digest in (inside if within else outside)}
    stack = [root] if gone else []
    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if isinstance(c, str) or id(c) not in gone]
        stack.extend(c for c in node.children if not isinstance(c, str))
    return len(gone)


def blocks(roots: list[Node]) -> list[str]:
    out, held = [], []
    flush = object()
    stack: list = list(reversed(roots))
    while stack:
        x = stack.pop()
        if x is not flush and isinstance(x, str):
            held.append(x)
            continue
        if x is flush or x.tag in BLOCKS:
            if line := " ".join("".join(held).split()):
                out.append(line)
            held.clear()
            if x is flush:
                continue
        if x.tag in VOID:
            held.append(" ")
            continue
        if x.tag in BLOCKS:
            stack.append(flush)
        stack.extend(reversed(x.children))
    if line := " ".join("".join(held).split()):
        out.append(line)
    return out


def cleaned(root: Node) -> list[Node]:
    prune(root)
    return content(root)


def text_of(html: str | None, outside: frozenset[int] = frozenset(), inside: frozenset[int] = frozenset()) -> str:
    """The main text of one page, given its host's templates."""
    root = parse(html or "")
    if outside or inside:
        delete(root, outside, inside)
    return "\n".join(blocks(cleaned(root)))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def site_templates(pages: DataFrame, share: float = 0.01, least: int = 4, share_inside: float = 0.5, least_inside: int = 8, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, outside and inside (arrays of subtree hashes) of hosts that have templates; a written table."""
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, contents, trees, within = [], [], [], []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                root = parse(html.as_py() or "")
                below = {(_signed(n.digest), inside) for n, inside in hash_subtrees(root)}
                whole = _signed(xxhash.xxh64_intdigest("\n".join(blocks(cleaned(root))).encode("utf-8", "surrogatepass")))
                hosts.extend([host] * (len(below) + 1))
                contents.extend([whole] * (len(below) + 1))
                trees.extend([None, *(d for d, _ in below)])
                within.extend([False, *(i for _, i in below)])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(contents, pa.int64()), pa.array(trees, pa.int64()), pa.array(within, pa.bool_())], ["host", "content", "tree", "inside"])

    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "host string, content bigint, tree bigint, inside boolean")
    once = rows.distinct()  # combined on the map side: copies of a page shrink to one
    counts = materialize(once.groupBy("host", "tree", "inside").agg(F.count(F.lit(1)).alias("n")).where(f"tree is null or n >= {min(least, least_inside)}"), "counts")
    contents = counts.where("tree is null").select("host", F.col("n").alias("contents"))
    enough = F.when(F.col("inside"), (F.col("n") >= least_inside) & (F.col("n") >= F.col("contents") * share_inside)).otherwise((F.col("n") >= least) & (F.col("n") >= F.col("contents") * share))
    found = counts.where("tree is not null").join(contents, "host").where(enough)
    of = lambda inside: F.collect_set(F.when(F.col("inside") == inside, F.col("tree")))
    return materialize(found.groupBy("host").agg(of(False).alias("outside"), of(True).alias("inside")), "templates")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **how) -> DataFrame:
    """page_id, url and text of every row of pages. how: the limits of site_templates()."""
    templates = site_templates(pages, url_col=url_col, html_col=html_col, **how)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), host_of(F.col(url_col)).alias("host"))
    joined = rows.join(templates, "host", "left").select("page_id", "url", "html", "outside", "inside")
    kind = joined.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, seen = [], {}
            for html, *lists in zip(*(batch.column(i) for i in (2, 3, 4)), strict=True):
                sets = []
                for known in lists:
                    packed = known.values.to_numpy().view("u8") if known.is_valid else None
                    key = b"" if packed is None else packed.tobytes()
                    if key not in seen:
                        seen[key] = frozenset(packed.tolist()) if key else frozenset()
                    sets.append(seen[key])
                texts.append(text_of(html.as_py(), *sets))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(run, f"page_id {kind}, url string, text string")
