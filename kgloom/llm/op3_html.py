"""Main text of HTML pages by site style trees.

Pages of one host are merged: nodes that agree in their path of element styles (tag and first class or id) are one
node of the site's tree. A node's importance is the greater of two entropies over the pages that have it: of its
presentation (the styles of its children) and of its content. They are Hartley entropies, the logarithm of how many
different ones there are, on the scale of counts: different ones a page, 1 if no two pages agree. A large group of
copies weighs no more than one page in it, so a site's copies don't make its articles unimportant.

Sites of ``MANY`` pages and more are judged by importance, relative to the site's most important node: menus,
headers, footers, sidebars and notices that vary little, whatever they are called, go. What a branch is called only shifts its
threshold: furniture (by tag, role or words of class or id) and what stands outside the page's articles and main parts goes under ``HIGH``,
other branches under ``LOW``; articles and what is around them stay, and inside them blocks of text under ``LOW`` go, but no headings. A host of fewer pages is judged by the tree of its domain
(last two labels), which has more. Where there are too few pages for both, or all are alike, importance tells little: there branches go that are called
furniture, or that have hardly any importance on ``PAGES`` pages or more, and the articles and main parts are the text, if there are any. Scripts, forms, hidden parts, adverts and readers'
comments always go, as they differ from page to page.

Inside articles and main parts, words of compound names (``share-price``, ``comment-on-law``) remove nothing: there only what is
called by a name of ``ALWAYS`` goes. Words of class or id alone never remove html, body, main or article, nor what holds most of the page's text with its title or article, nor a
page's whole text. A removal by importance that would leave nothing isn't made.

Null html gives an empty text; null or odd URLs belong to one host without a name, which is never judged; repeated rows
each give their text; ties of importance stay together, as thresholds decide; an empty table gives an empty result; further columns are left alone.
Statistics are counted for all pages by grouped sums (no site is ever gathered); the table of unimportant branches is broadcast up to counted rows and bytes, else joined.
"""

from __future__ import annotations

import hashlib
import html as html_
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, few
from .op5_url_filters import host

#: Relative importance under which furniture and other branches of a judged site go, and its pages at least.
HIGH, LOW, MANY = 0.85, 0.25, 200
#: A site whose most important node has less importance than this is copies of one page.
VARIED = 0.1
#: Importance under which branches of smaller hosts go, and their pages at least.
LEAST, PAGES = 0.2, 8
MAX_BROADCAST_ROWS = 100_000
#: Elements nested deeper are put beside each other, as browsers do; longer paths are named by a hash.
MAX_DEPTH, MAX_PATH = 512, 300

# HTML's void elements, elements whose text isn't markup, and those that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe noembed noframes xmp title".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul video".split())
#: Elements that are nodes of the style tree.
COUNTED = BLOCK - {"html", "body", "head", "br", "hr"}
#: What closes an open p; what closes an open element of its own kind.
CLOSES_P = BLOCK - {"br", "body", "html", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "title", "head", "video", "select"}
CLOSES_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tr": {"table"}}
#: Elements, words of class or id, and roles that say that a branch is no content; of these what is a page's furniture, which importance judges.
NOISE_TAGS = frozenset("nav footer aside form button select option textarea dialog menu script style noscript template iframe svg canvas object audio video head title noembed noframes xmp".split())
FURNITURE_TAGS = frozenset("nav footer aside header menu".split())
NOISE_WORDS = frozenset("ad ads adv advert adverts advertisement adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert newsletter subscribe subscription popup modal overlay sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus share sharing social related recommended widget widgets pagination pager masthead toolbar login signup search skip".split())
FURNITURE_WORDS = frozenset("cookie cookies consent gdpr notice notices alert sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead toolbar banner pagination pager widget widgets related recommended share sharing social skip".split())
#: Names of parts that differ from page to page and stand in articles without being of them.
ALWAYS = frozenset("ad ads advert adverts advertisement adbox sponsored comments comment-list disqus".split())
#: Blocks inside an article or main part that importance may remove: what holds text of its own, but no headings and no parts of lists and tables.
BODY = frozenset("address aside blockquote center details div dl fieldset figure footer header ol p pre section table ul".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary menu menubar".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|</?[A-Za-z][^>]*\Z|[^<]+|<", re.S)
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def hash64(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Node:
    __slots__ = ("tag", "style", "parent", "noise", "soft", "furniture", "main", "path", "parts", "depth")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.parent = tag, parent
        named = (attrs.get("class") or attrs.get("id") or "").split()
        self.style = tag + ("." + re.sub(r"\d+", "", named[0]) if named else "")
        self.path = f"{parent.path}/{self.style}" if parent else self.style
        if len(self.path) > MAX_PATH:
            self.path = f"#{hash64(self.path):x}"
        self.depth = parent.depth + 1 if parent else 0
        inside = bool(parent and parent.main)
        # of compound names outside of articles each word counts; inside, a name has to be one of a few words as a whole
        named_as = " ".join(attrs.get(k, "") for k in ("class", "id")) if attrs else ""
        said = ALWAYS & set(named_as.lower().split()) if inside else {w.lower() for w in WORD.findall(named_as)} if named_as else ()
        role = attrs.get("role", "").lower()
        part = tag in ("article", "main") or role in ("main", "article") or attrs.get("itemprop") == "articleBody"
        self.noise = bool(tag in NOISE_TAGS or tag == "header" and not inside or attrs and (role in NOISE_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I)))
        self.soft = bool(said and not self.noise and not part and tag not in ("html", "body") and (NOISE_WORDS & said or "header" in said and not inside))
        self.furniture = self.noise and (tag in FURNITURE_TAGS or role in FURNITURE_ROLES) or self.soft and not (NOISE_WORDS & said) - FURNITURE_WORDS
        self.noise |= self.soft
        self.main = inside or part
        self.parts: list[str | Node] = []


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html_.unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(ATTR.finditer(raw)))} if raw.strip(" /") else {}


def parse(page: str) -> Node:
    """The page's tree. Elements left open end where HTML says or with what holds them; stray end tags are dropped."""
    root = top = Node("", {}, None)
    at = 0
    while m := TOKEN.match(page, at):
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if page[m.start()] != "<" or at == m.start() + 1:
                top.parts.append(html_.unescape(m[0]) if "&" in m[0] else m[0])
            continue
        tag = name.lower()
        if m[1] or m[4]:
            node = top
            while node.parent and node.tag != tag:
                node = node.parent
            if node.parent:
                top = node.parent
            elif tag in ("p", "br"):
                top.parts.append(Node(tag, {}, top))
            continue
        if tag in CLOSES_P or tag in CLOSES_OWN:
            node, own = top, CLOSES_OWN.get(tag, ())
            stop = SCOPE.get(tag, ())
            while node.parent and node.tag not in stop:
                if node.tag in own or node.tag == "p" and tag in CLOSES_P:
                    top = node.parent
                elif node.tag in BLOCK and not own:
                    break
                node = node.parent
        node = Node(tag, attributes(m[3] or m[6] or ""), top)
        top.parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not (m[3] or m[6] or "").endswith("/") and node.depth < MAX_DEPTH:
            top = node
    return root


def text_of(node: Node, gone: Callable[[Node], bool]) -> str:
    """The text of a branch without what is gone: blocks apart by one blank, white space one blank."""
    out: list[str] = []
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        if gone(x):
            out.append("\n")
            continue
        gap = ["\n"] if x.tag in BLOCK else []
        stack += [*gap, *reversed(x.parts), *gap]
    return " ".join("".join(out).split())


def roots(node: Node, soft: bool = False) -> list[Node]:
    """The topmost articles and main parts that aren't noise, else the page; with ``soft`` also those in branches that are noise by words only."""
    found: list[Node] = []
    stack = [node]
    while stack:
        x = stack.pop()
        if x.noise and not (soft and x.soft):
            continue
        if x.main:
            found.append(x)
            continue
        stack += [c for c in reversed(x.parts) if isinstance(c, Node)]
    return found or [node]


def unmark(page: Node, any_part: bool = False) -> bool:
    """Takes back what words say of branches with over half of the page's text that hold its title, an article or a main part (or anything)."""
    order: list[Node] = []
    stack = [page]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [c for c in x.parts if isinstance(c, Node) and (c.soft or not c.noise)]
    if not any(x.noise for x in order):
        return False
    size, holds = {}, {}
    for x in reversed(order):
        below = [c for c in x.parts if isinstance(c, Node) and c in size]
        size[x] = sum(len(p.strip()) for p in x.parts if isinstance(p, str)) + sum(size[c] for c in below)
        holds[x] = x.tag == "h1" or x.main or any(holds[c] for c in below)
    wrong = [x for x in order if x.noise and 2 * size[x] > size[page] and (holds[x] or any_part)]
    for x in wrong:
        x.noise = False
    return bool(wrong)


def judged(tree: Node, importance: dict[str, float]) -> str:
    """The page without branches of too little importance (those under HIGH are given by path)."""
    parts = [x for x in roots(tree) if x.main]
    around, tops = {tree}, set(parts)
    for x in parts:
        while x.parent:
            x = x.parent
            around.add(x)

    def gone(x: Node) -> bool:
        if x.noise and not (x.furniture and x.tag in COUNTED):
            return True
        if not x.noise and x in around:
            return False
        if not x.noise and x.main:
            return x not in tops and x.tag in BODY and importance.get(x.path, 1.0) < LOW
        return importance.get(x.path, 1.0) < (HIGH if x.noise or parts else LOW)

    return text_of(tree, gone)


def extract(page: str, low: dict[str, float] | None = None, by_importance: bool = False) -> str:
    """low: importance of unimportant branches by path; by_importance: whether the page's site is judged by it."""
    low = low or {}
    tree = parse(page)
    unmark(tree)
    if by_importance and (text := judged(tree, low)):
        return text

    def chosen(low: dict[str, float]) -> str:
        return " ".join(t for t in (text_of(x, lambda n: n.noise or n.path in low and (not n.main or n.tag in BODY and n is not x)) for x in found) if t)  # noqa: B023

    found = roots(tree)
    whole = chosen({})
    if found == [tree]:
        found = roots(tree, soft=True)
        if found != [tree] and len(inner := chosen({})) > len(whole):
            whole = inner
        else:
            found = [tree]
    if not whole and unmark(tree, any_part=True):
        found = roots(tree)
        whole = chosen({})
    return whole if by_importance else chosen(low) or whole


def node_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each page and block node of its tree: host, path, hash of child styles, hash of content."""
    for batch in batches:
        hosts, paths, shapes, contents = [], [], [], []
        for h, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if not page or not h:
                continue
            merged: dict[str, tuple[list[str], list[str], str, int]] = {}
            stack: list[tuple[Node, list[str]]] = [(parse(page), [])]
            while stack:
                x, own = stack.pop()
                if x.tag in COUNTED:
                    shape, own, *_ = merged.setdefault(x.path, ([], [], x.parent.path, x.depth))
                    shape.append(",".join(dict.fromkeys(c.style for c in x.parts if isinstance(c, Node))))
                own += (p for p in x.parts if isinstance(p, str))  # text of inline elements is that of their block
                stack += [(c, own) for c in reversed(x.parts) if isinstance(c, Node) and c.tag not in RAW]
            # a branch's content is its own text and the contents below it, by their hashes
            for path in sorted(merged, key=lambda p: (-merged[p][3], p)):
                shape, content, up, _ = merged[path]
                hosts.append(h)
                paths.append(path)
                shapes.append(hash64(";".join(shape)))
                contents.append(hash64(" ".join(content)))
                if up in merged:
                    merged[up][1].append(f"{contents[-1]:x}")
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(shapes, pa.int64()), pa.array(contents, pa.int64())], names=["host", "path", "shape", "content"])


def domain(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def sites(host: Column) -> Column:
    """The sites that a page belongs to: its host and its domain."""
    return F.array_distinct(F.array(host, domain(host)))


def importance(pages: DataFrame) -> DataFrame:
    """pages (host, html) -> (site, path, pages, importance): the style trees of hosts and domains."""
    nodes = pages.select("host", "html").mapInArrow(node_rows, "host string, path string, shape long, content long")
    both = nodes.select("host", "path", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("shape").alias("x")), F.struct(F.lit(1).alias("kind"), F.col("content").alias("x")))).alias("f"))
    count = both.groupBy("host", "path", "f").agg(F.count("*").alias("c"))
    count = count.select(F.explode(sites(F.col("host"))).alias("site"), "path", "f", "c").groupBy("site", "path", "f").agg(F.sum("c").alias("c"))
    kinds = count.groupBy("site", "path", "f.kind").agg(F.sum("c").alias("pages"), (F.count("*") / F.sum("c")).alias("h"))
    return kinds.groupBy("site", "path").agg(F.max("pages").alias("pages"), F.max("h").alias("importance"))


def unimportant(of: DataFrame, high: float, low: float, many: int, least: float, least_pages: int) -> DataFrame:
    """of (host, html) -> host, judged, paths, importances: the branches that may go from each host's pages, and whether importance judges them."""
    node = cut(importance(of))
    size = of.where("host != ''").groupBy("host").agg(F.count("*").alias("n"))
    site = size.select(F.explode(sites(F.col("host"))).alias("site"), "n").groupBy("site").agg(F.sum("n").alias("n"))
    most = node.join(site, "site").where(F.col("pages") * 2 >= F.col("n")).groupBy("site").agg(F.max("importance").alias("most"), F.first("n").alias("n"))
    most = cut(most.withColumn("judged", (F.col("n") >= many) & (F.col("most") >= VARIED)))
    # the first of host and domain that is judged, else the host
    choice = size.select("host", F.posexplode(sites(F.col("host"))).alias("k", "site")).join(most, "site")
    choice = choice.groupBy("host").agg(F.min(F.struct((~F.col("judged")).alias("_not"), "k", "site", "most", "judged")).alias("s")).select("host", "s.site", "s.most", "s.judged")
    relative = F.when(F.col("judged"), F.col("importance") / F.col("most")).otherwise(F.col("importance"))
    bound = F.when(F.col("judged"), max(high, low)).otherwise(least)
    some = choice.join(node, "site").withColumn("importance", relative).where((F.col("importance") < bound) & (F.col("judged") | (F.col("pages") >= least_pages)))
    lists = some.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("path", "importance"))).alias("x")).select(F.col("host").alias("_host"), F.col("x.path").alias("paths"), F.col("x.importance").alias("importances"))
    return choice.join(lists, F.col("host") == F.col("_host"), "left").select("host", "judged", "paths", "importances")


def text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("html", "paths", "importances", "judged")), strict=True)
        out = [extract(page or "", dict(zip(paths or (), values or (), strict=True)), bool(j)) for page, paths, values, j in rows]
        yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(out, pa.string()), pa.array(np.array([len(t) for t in out], np.int64))], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, high: float = HIGH, low: float = LOW, many: int = MANY, least: float = LEAST, least_pages: int = PAGES) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars. high, low and least at 0 switch the style trees off."""
    of = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    gone = few(cut(unimportant(of, high, low, many, least, least_pages).withColumnRenamed("host", "_host")), MAX_BROADCAST_ROWS)
    return of.join(gone, F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "judged", "paths", "importances").mapInArrow(text_rows, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
