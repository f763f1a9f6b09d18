"""HTML extraction: site template removal by hashed element subtrees.

Every page is parsed into a light tree. Each container element gets a hash of its tag, its attributes' names and classes, its
text and its children. Spark counts on how many pages of a host each hash stands; subtrees that recur on at least
`min_pages` pages are template and are deleted, however many pages the host has, unless they hold most of the page's content, as the article of a page that stands under
several addresses does. Elements that are furniture by tag, role or class go in any case: a name counts if it is listed, or if one of its parts between
hyphens or underscores is; words that articles are about too count in a compound only beside words of page layout. A container of such a compound name that holds the article, the main
element or the page's heading is a wrapper and stays. The text is what the page's article holds, or its main element, or else its body.

Defined cases: a null or empty html gives an empty text; a null or odd url has no host and only the fixed rules apply; a page
that repeats counts once for its template; repeated page ids are extracted one by one; pages of any length and depth are read whole; broken markup never fails: tags that are open end with
the page; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import BROADCAST_ROWS, each_batch, stash, table

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("aside blockquote details dialog div dl fieldset figure footer form header main nav ol section table ul".split())
NAMED = CONTAINERS - {"main"}  # elements that go by their class or id, which must be one of CLASSES as a whole
FURNITURE = frozenset("aside audio button canvas dialog footer form head iframe input label menu nav noscript object script select style svg template textarea title video".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog navigation search".split())
CLASSES = frozenset(
    "ad ads adsense advert advertisement alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice popup promo promoted related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Of these, words that a compound name needs company for, and the company: words of page layout.
VAGUE = frozenset("alert comments consent media menu notice related replies reply respond share sharing social".split()) - {"comments"}
LAYOUT = frozenset(
    "area bar block bottom box button buttons container content entry form global group header icon icons inner item items left link links list main outer page panel post posts right row section site slot top unit user wrap wrapper".split()
)
HEADINGS = frozenset(("article", "main", "h1"))
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"},
}
FENCES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}

# Every alternative that begins also ends, at the end of the page if need be, so a page is read once whatever it holds. A tag without its
# end mark ends where the next tag begins.
_PART = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|template|iframe)\b(?:[^<>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+(?:>.*?(?:</\1\s*>|\Z)|\Z|(?=<))"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z|(?=<))|([^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


class Node:
    __slots__ = ("tag", "furniture", "compound", "items", "size", "hash", "label")

    def __init__(self, tag: str, label: str = "", furniture: bool = False, compound: bool = False):
        self.tag, self.label, self.furniture, self.compound = tag, label, furniture, compound
        self.items: list = []  # texts and nodes
        self.size = self.hash = 0


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(text)}


def is_furniture(tag: str, attrs: dict[str, str]) -> bool:
    if tag in FURNITURE or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if attrs.get("role", "").lower() in ROLES or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()
    return tag in NAMED and not CLASSES.isdisjoint(names.split())


def is_compound(name: str) -> bool:
    """Whether a part of a name between hyphens or underscores names furniture."""
    parts = re.split(r"[-_]+", name)
    if len(parts) < 2:
        return False
    clear = any(p in CLASSES and p not in VAGUE for p in parts)
    return clear or (any(p in VAGUE for p in parts) and all(p in CLASSES or p in LAYOUT for p in parts))


def parse(text: str) -> Node:
    """The page's elements. Where each open tag and block begins is kept, so what a tag closes is found without a walk."""
    root = Node("#root")
    stack, places, blocks = [root], defaultdict(list), []

    def end(k: int) -> None:
        """Closes the elements from the k-th on."""
        for n in stack[k:]:
            places[n.tag].pop()
        while blocks and blocks[-1] >= k:
            blocks.pop()
        del stack[k:]

    def last(tags) -> int:
        """The innermost open element of these tags."""
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    for m in _PART.finditer(text):
        if m[5] is not None:
            stack[-1].items.append(entities.unescape(m[5]))
        elif m[3] is not None:
            tag = m[3].lower()
            if m[2]:
                if places.get(tag):
                    end(places[tag][-1])
                continue
            if tag in BLOCK and tag != "br" and blocks and stack[blocks[-1]].tag == "p":  # an open paragraph ends where a block begins
                end(blocks[-1])
            if tag in CLOSES:
                k = last(CLOSES[tag])
                if k > last(FENCES.get(tag, ("table",))):
                    end(k)
            attrs = attributes(m[4]) if m[4].strip("/ ") else {}
            names = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split()
            node = Node(tag, f"{tag} {' '.join(sorted(attrs))} {attrs.get('class', '')}", is_furniture(tag, attrs), tag in NAMED and any(map(is_compound, names)))
            stack[-1].items.append(node)
            if tag not in VOID and not m[4].endswith("/"):
                places[tag].append(len(stack))
                if tag in BLOCK:
                    blocks.append(len(stack))
                stack.append(node)
    settle(root)
    return root


def in_order(root: Node) -> list[Node]:
    """All elements, each before those inside it."""
    todo, order = [root], []
    while todo:
        n = todo.pop()
        order.append(n)
        todo.extend(x for x in n.items if isinstance(x, Node))
    return order


def settle(root: Node) -> None:
    """Elements of compound names become furniture unless they hold the article, the main element or the heading of the page."""
    order = in_order(root)
    if not any(n.compound for n in order):
        return
    holds: set[int] = set()
    for n in reversed(order):
        inside = any(id(x) in holds for x in n.items if isinstance(x, Node))
        if n.compound and not inside and n.tag not in HEADINGS:
            n.furniture = True
        if (inside or n.tag in HEADINGS) and not n.furniture and not (n.tag in HEADINGS and named(n)):
            holds.add(id(n))


def named(n: Node) -> bool:
    """Whether an article is called a comment, an advert or the like."""
    names = n.label.lower().split()[1:]
    return not CLASSES.isdisjoint(names) or any(map(is_compound, names))


def hash_subtrees(node: Node) -> None:
    """Sets size (characters of text) and hash of every node, children first."""
    for n in reversed(in_order(node)):
        parts, size = [n.label], 0
        for x in n.items:
            if isinstance(x, Node):
                parts.append(str(x.hash))
                size += x.size
            else:
                x = " ".join(x.split())
                parts.append(x)
                size += len(x)
        n.size, n.hash = size, int.from_bytes(blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def contents(root: Node) -> list[Node]:
    """The article elements, else the main elements, else the whole page; none lies in another one."""
    for tag in ("article", "main"):
        found, todo = [], [root]
        while todo:
            n = todo.pop()
            if n.tag == tag and not n.furniture:
                if named(n):
                    continue
                found.append(n)
                continue
            if not n.furniture:
                todo.extend(x for x in reversed(n.items) if isinstance(x, Node))
        if found:
            return found
    return [root]


def template_nodes(roots: list[Node]) -> list[Node]:
    """The containers inside the content that could be template."""
    out, todo = [], [x for r in roots for x in r.items if isinstance(x, Node)]
    while todo:
        n = todo.pop()
        if n.furniture:
            continue
        if n.tag in CONTAINERS and n.size:
            out.append(n)
        todo.extend(x for x in n.items if isinstance(x, Node))
    return out


def text_of(roots: list[Node], template: set[int]) -> str:
    blocks: list[str] = []
    for root in roots:
        half, current = root.size / 2, []

        def flush() -> None:
            line = " ".join("".join(current).split())
            current.clear()
            if line:
                blocks.append(line)

        todo = [(root, iter(root.items))]
        while todo:
            n, items = todo[-1]
            x = next(items, None)
            if x is None:
                todo.pop()
                if n.tag in BLOCK:
                    flush()
            elif isinstance(x, str):
                current.append(x)
            else:
                if x.tag in BLOCK:
                    flush()
                if not (x.furniture or (x.tag == "header" and n.tag != "article") or (x.hash in template and x.tag in CONTAINERS and x.size <= half)):
                    todo.append((x, iter(x.items)))
        flush()
    return "\n".join(blocks)


def host(url: str | None) -> str | None:
    m = _HOST.match(url or "")
    return m[1].lower() if m else None


def host_key(name: str | None, mark: int) -> int:
    """One number for a subtree's hash on a host."""
    return int.from_bytes(blake2b(f"{name} {mark}".encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def extract_pages(pages: DataFrame, *, min_pages: int = 5) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html)."""
    pages = pages.select("page_id", "url", "html")
    arrow = pa.schema([("page", pa.int64()), ("subtree", pa.int64())])

    def met(cols: dict) -> dict:
        keys, subtrees = [], []
        for url, text in zip(cols["url"].to_pylist(), cols["html"].to_pylist()):
            name = host(url)
            if name is None or not text:
                continue
            root = parse(text)
            hash_subtrees(root)
            found = {host_key(name, n.hash) for n in template_nodes(contents(root))}
            page = host_key(name, root.hash)
            keys += [page] * len(found)
            subtrees += sorted(found)  # the number of a subtree tells its host too
        return {"page": keys, "subtree": subtrees}

    rows = stash(pages.mapInArrow(each_batch(met, arrow), "page long, subtree long"))
    counts = rows.distinct().groupBy("subtree").agg(F.count("*").alias("n"))
    template = stash(counts.filter(F.col("n") >= min_pages).select("subtree"))
    few = template.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if few:
        known = pages.sparkSession.sparkContext.broadcast({r["subtree"] for r in template.collect()})
        asked = pages
    else:  # each page's own template subtrees come by a join on the page's hash
        kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("page", pa.int64())])

        def keyed(cols: dict) -> dict:
            keys = []
            for url, text in zip(cols["url"].to_pylist(), cols["html"].to_pylist()):
                root = parse(text or "")
                hash_subtrees(root)
                keys.append(host_key(host(url), root.hash))
            return {"page_id": cols["page_id"], "url": cols["url"], "html": cols["html"], "page": keys}

        own = rows.join(template, "subtree", "left_semi").groupBy("page").agg(F.collect_set("subtree").alias("own"))
        asked = pages.withColumn("page_id", F.col("page_id").cast("long")).mapInArrow(each_batch(keyed, kind), "page_id long, url string, html string, page long").join(own, "page", "left").select("page_id", "url", "html", "own")
        known = None
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def extract(cols: dict) -> dict:
        texts = []
        own = cols["own"].to_pylist() if known is None else None
        for k, (url, text) in enumerate(zip(cols["url"].to_pylist(), cols["html"].to_pylist())):
            root = parse(text or "")
            hash_subtrees(root)
            roots, name = contents(root), host(url)
            recurring = known.value if own is None else set(own[k] or ())
            marks = {n.hash for n in template_nodes(roots) if host_key(name, n.hash) in recurring} if name is not None else set()
            texts.append(text_of(roots, marks))
        return {"page_id": pc.cast(cols["page_id"], pa.int64()), "url": cols["url"], "text": texts, "n_chars": np.array([len(t) for t in texts], np.int64)}

    return asked.mapInArrow(each_batch(extract, out), "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
