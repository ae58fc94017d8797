"""HTML extraction with site style trees.

All pages of a host are merged into one tree of style nodes: a node is a path of tags with their classes and ids. Over
the pages that have a node, the entropy of its content (the text of its branch) and of its presentation (the sequence of
its child tags) gives its importance between 0 and 1: a branch that says and shows the same on page after page is near 0.
Branches of low importance are removed from each page, as are branches that HTML itself or their names mark as menus,
headers, footers, sidebars, notices, adverts, forms, comments, scripts or styles. Where a page has an article or main
element, the text is that element's; plain text elements inside it are never judged by repetition, since articles may be
copied or quote common lines.

Counts of all hosts are aggregated by Spark, hot hosts with partial aggregates; nothing per host meets in one task. Low
nodes are broadcast while they are at most `BROADCAST_NODES`; beyond that they are joined to the pages by host.

Defined cases: null and empty pages give empty texts; null urls form a host of their own; unclosed and cut markup ends
where the page ends; repeated rows are treated alike and count as often as they stand there; further columns pass
through, except those the operator writes itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistagrid.llm.common import appended, sized_slices, table, with_columns
from vistagrid.llm.registry import query

MIN_PAGES = 8
LOW_IMPORTANCE = 0.2
BROADCAST_NODES = 500_000

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}\s*[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg")}
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
NOISE_TAGS = frozenset("head script style noscript template nav footer aside form iframe svg button select textarea title dialog menu object canvas audio video".split())
NOISE_NAME = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|footer|masthead|cookies?|consent|notices?|gdpr|popup|modal|overlay|"
    r"newsletter|subscribe|subscription|comments?|commentlist|repl(?:y|ies)|disqus|respond|share|sharing|social|related|recommend\w*|widgets?|login|signup|search|toolbar|pagination|pager|skip|copyright)(?:[-_\s]|$)", re.I)
NOISE_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
HEADER_NAME = re.compile(r"(?:^|[-_\s])(?:site-?header|page-?header|top-?bar|header)(?:[-_\s]|$)", re.I)
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol blockquote pre table tbody thead tr td th dl dt dd figure figcaption section".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


class Node:
    __slots__ = ("tag", "key", "noise", "main", "children", "parts", "plain")

    def __init__(self, tag: str, key: int, noise: bool, main: bool, plain: bool):
        self.tag, self.key, self.noise, self.main, self.plain = tag, key, noise, main, plain
        self.children: list[str] = []
        self.parts: list = []


def _element(tag: str, attributes: str, parent: Node) -> Node:
    name = role = ""
    hidden = False
    if attributes and not attributes.isspace():
        for m in ATTRIBUTE.finditer(attributes):
            a, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
            if a in ("class", "id"):
                name += " " + value
            elif a == "role":
                role = value.lower()
            elif a == "hidden" or (a == "style" and "display:none" in value.replace(" ", "").lower()) or (a == "aria-hidden" and value == "true"):
                hidden = True
    main = parent.main or tag in ("article", "main") or role == "main"
    noise = parent.noise or hidden or tag in NOISE_TAGS or role in NOISE_ROLE or bool(name and tag not in ("body", "html", "article", "main") and NOISE_NAME.search(name))
    if not noise and not main:
        noise = tag == "header" or bool(name and HEADER_NAME.search(name))
    plain = main and parent.plain and not name and (tag in PLAIN or tag in ("article", "main"))
    return Node(tag, xxhash.xxh64_intdigest(f"{parent.key}>{tag}.{name.strip()}") & (2**63 - 1), noise, main, plain if parent.main else main)


def parse(html: str) -> Node:
    """Tree of block elements; inline elements leave their text in the block around them."""
    root = Node("", 0, False, False, True)
    stack, at, n = [root], 0, len(html)
    while at < n:
        cut = html.find("<", at)
        if cut < 0:
            stack[-1].parts.append(html[at:])
            break
        if cut > at:
            stack[-1].parts.append(html[at:cut])
        m = TOKEN.match(html, cut)
        if m is None:
            stack[-1].parts.append("<")
            at = cut + 1
            continue
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            if tag == "br":
                stack[-1].parts.append(" ")
            elif tag not in INLINE:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        del stack[depth:]
                        break
            continue
        if tag in RAW:
            end = RAW[tag].search(html, at)
            at = end.end() if end else n
            stack[-1].children.append(tag)
            continue
        if tag in VOID:
            stack[-1].parts.append(" " if tag in ("br", "hr", "img") else "")
            if tag == "hr":
                stack[-1].parts.append(None)
            continue
        if tag in INLINE:
            names = m.group(3)
            if names and ("class" in names or "id" in names or "hidden" in names or "style" in names):
                own = _element(tag, names, stack[-1])
                if own.noise and not stack[-1].noise:
                    # A marked inline element is a branch of its own, up to its end tag.
                    end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                    at = end.end() if end else n
            continue
        if stack[-1].tag == "p":
            stack.pop()
        closes = CLOSED_BY.get(tag)
        if closes:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in closes:
                    del stack[depth:]
                    break
                if stack[depth].tag in ("ul", "ol", "dl", "table"):
                    break
        parent = stack[-1]
        own = _element(tag, m.group(3), parent)
        parent.children.append(tag)
        parent.parts.append(own)
        stack.append(own)
    return root


def blocks(node: Node, low: frozenset | set, only_main: bool) -> Iterator[str]:
    """Cleaned blocks of the branch in page order, without noise and without nodes of low importance."""
    pending: list[tuple[Node, int, list[str]]] = [(node, 0, [])]
    while pending:
        own, k, text = pending.pop()
        keep = own.main or not only_main
        while k < len(own.parts):
            part = own.parts[k]
            k += 1
            if isinstance(part, str):
                text.append(part)
                continue
            if keep and text:
                yield " ".join(unescape("".join(text)).split())
            text = []
            if part is not None and not part.noise and not (part.key in low and not part.plain):
                pending.append((own, k, []))
                own, k, keep = part, 0, part.main or not only_main
        if keep and text:
            yield " ".join(unescape("".join(text)).split())


def has_main(node: Node) -> bool:
    open_ = [node]
    while open_:
        own = open_.pop()
        if own.main and not own.noise:
            return True
        open_ += [p for p in own.parts if isinstance(p, Node)]
    return False


def extract(html: str, low: frozenset | set = frozenset()) -> str:
    """Main text of a page; where removal by importance would leave nothing, only the marked branches are removed."""
    root = parse(html)
    only_main = has_main(root)
    text = "\n".join(b for b in blocks(root, low, only_main) if b)
    if not text and low:
        text = "\n".join(b for b in blocks(root, frozenset(), only_main) if b)
    return text


def style_nodes(html: str) -> dict[int, tuple[int, int]]:
    """Style nodes of a page that may be judged: key -> (hash of the branches' text, hash of their child tags)."""
    found: dict[int, list] = {}

    def walk(top: Node) -> None:
        # Children before parents, without recursion.
        order, open_ = [], [top]
        while open_:
            own = open_.pop()
            order.append(own)
            open_ += [p for p in own.parts if isinstance(p, Node)]
        content: dict[int, int] = {}
        for own in reversed(order):
            hashed = xxhash.xxh64()
            for p in own.parts:
                if isinstance(p, Node):
                    hashed.update(content[id(p)].to_bytes(8, "little"))
                elif p and not p.isspace():
                    hashed.update(" ".join(p.split()))
            content[id(own)] = hashed.intdigest()
            if own.key and not own.plain and own.tag not in ("html", "body", "head"):
                entry = found.setdefault(own.key, [xxhash.xxh64(), xxhash.xxh64()])
                entry[0].update(content[id(own)].to_bytes(8, "little"))
                entry[1].update(",".join(own.children) + ";")

    walk(parse(html))
    return {k: (a.intdigest() & (2**63 - 1), b.intdigest() & (2**63 - 1)) for k, (a, b) in found.items()}


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _noded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in sized_slices(batch, "html"):
            hosts, nodes, contents, shapes = [], [], [], []
            for h, html in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                for key, (content, shape) in style_nodes(html or "").items():
                    hosts.append(h)
                    nodes.append(key)
                    contents.append(content)
                    shapes.append(shape)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), pa.array(nodes, pa.int64()), pa.array(contents, pa.int64()), pa.array(shapes, pa.int64())],
                                             names=["host", "node", "content", "shape"])


def importance(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(host, node, pages, importance) of every style node: the larger of its content's and its presentation's entropy, over log(pages)."""
    source = pages.select(F.xxhash64(host(F.col(url))).alias("host"), F.col(html).cast("string").alias("html"))
    nodes = source.mapInArrow(_noded, "host bigint, node bigint, content bigint, shape bigint")
    faces = nodes.select("host", "node", F.explode(F.array(F.struct(F.lit(0).alias("face"), F.col("content").alias("value")),
                                                           F.struct(F.lit(1).alias("face"), F.col("shape").alias("value")))).alias("v")).select("host", "node", "v.*")
    counts = faces.groupBy("host", "node", "face", "value").agg(F.count("*").alias("n"))
    per = counts.groupBy("host", "node", "face").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("s"))
    entropy = F.when(F.col("pages") > 1, (F.log("pages") - F.col("s") / F.col("pages")) / F.log("pages")).otherwise(1.0)
    return per.groupBy("host", "node").agg(F.max("pages").alias("pages"), F.max(entropy).alias("importance"))


def main_text(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Input rows with the main `text` of each page and its length `n_chars`."""
    low = importance(pages, html, url).where((F.col("pages") >= MIN_PAGES) & (F.col("importance") < LOW_IMPORTANCE)).select("host", "node")
    few = low.limit(BROADCAST_NODES + 1).toPandas()
    keyed, schema = appended(pages, "text string, n_chars bigint", drop=["__host", "__low"])
    keyed = keyed.withColumn("__host", F.xxhash64(host(F.col(url))))
    shared = None
    if len(few) <= BROADCAST_NODES:
        shared = pages.sparkSession.sparkContext.broadcast({h: frozenset(g) for h, g in few.groupby("host")["node"]})
    else:
        keyed = keyed.join(low.groupBy(F.col("host").alias("__host")).agg(F.collect_list("node").alias("__low")), "__host", "left")

    def extracted(batches):
        for batch in batches:
            for part in sized_slices(batch, html):
                if shared is not None:
                    lows = [shared.value.get(h, frozenset()) for h in part.column("__host").to_pylist()]
                else:
                    lows = [frozenset(x or ()) for x in part.column("__low").to_pylist()]
                texts = [extract(h or "", x) for h, x in zip(part.column(html).to_pylist(), lows)]
                yield with_columns(part, {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}, schema)

    return keyed.mapInArrow(extracted, schema)


@query("op7_style_tree")
def op7_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
