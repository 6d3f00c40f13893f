"""Main text of web pages by site-template removal.

A page becomes a tree; every element subtree gets two digests, one of its tags and text and one of its
shape, that is its tags and class names without text. Spark counts, for each host and each of its
sections, the pages that hold a subtree; those that recur on many of them are template and are deleted:
by text anywhere, by shape outside the articles, where menus and notices say something new on each page.
Only where a host has too few pages to tell do rules about class names and articles decide. Elements
without text of their own, like scripts, forms and navigation, go by their tag; reader comments, whose
text never recurs and whose place is within the article, by their class.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisflow.llm.shared import lean, written

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html caption td th tr tbody thead tfoot li dd dt legend option optgroup".split())
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u span".split())
#: Elements that hold no main text, whatever their content.
DROPPED = frozenset("nav header footer aside form script style noscript template iframe button select textarea input menu dialog svg canvas object head title noframes noembed".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
#: Elements within an article that recurrence decides about, unless they hold as much prose as LONG characters.
BOXES = frozenset("div section article figure table ul ol dl".split())
CONTAINERS = frozenset("html body div section table tbody tr td center".split())
LONG = 500
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adbox|adsense|banner|sponsor\w*|promo\w*|sidebar\w*|side|menu\w*|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|share|sharing|social|related|recommend\w*|comments?|commentlist|replies|disqus|respond|widget|toolbar|pagination|pager|skip|copyright|disclaimer)(?:$|[\s_-])",
    re.I,
)
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"(?:^|[\s/\"'])(class|id|role|aria-hidden|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=[\s/]|$)", re.I)


class Node:
    """`boiler`: no main text by tag or role; `hint`: none by its class or id, which `name` holds."""

    __slots__ = ("tag", "name", "kids", "boiler", "hint", "digest", "shape", "prose", "linked")

    def __init__(self, tag: str, name: str = "", boiler: bool = False, hint: bool = False):
        self.tag, self.name, self.boiler, self.hint = tag, name, boiler, hint
        self.kids: list = []
        self.digest = self.shape = self.prose = self.linked = 0


DIGITS = re.compile(r"[0-9]+")


def element(tag: str, attributes: str) -> Node:
    node = Node(tag, boiler=tag in DROPPED)
    if not attributes or node.boiler:
        return node
    names = []
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            node.boiler = True
        elif name in ("class", "id"):
            names.append(value)
            node.hint = node.hint or bool(HINT.search(value)) and (tag not in ("body", "html", "article", "main") or "comment" in value.lower())
    node.name = DIGITS.sub("", " ".join(sorted(" ".join(names).split())))
    return node


def parse(html: str) -> Node:
    """The element tree, built with the usual repairs: implied ends, unknown end tags ignored, open ends closed."""
    root = Node("#root")
    stack = [root]
    at = 0

    def text(a: int, b: int) -> None:
        if a < b:
            stack[-1].kids.append(html[a:b])

    def close(names, stops=()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                del stack[i:]
                return
            if stack[i].tag in stops:
                return

    while m := TOKEN.search(html, at):
        text(at, m.start())
        at = m.end()
        if not (tag := m[2]):
            if m[0].startswith("<![CDATA["):
                text(m.start() + 9, at - 3 * m[0].endswith("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                stack[-1].kids.append(" ")
            elif tag in BLOCK:
                close({tag})
            else:
                close({tag}, BLOCK)
            continue
        if tag in CLOSES_P:
            close({"p"}, {"table", "td", "th", "button", "article", "section", "div", "li"})
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        node = element(tag, m[3])
        if tag in ("br", "wbr"):
            stack[-1].kids.append(" " if tag == "br" else "")
            continue
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|$)", re.I).search(html, at)
            node.boiler = True
            stop = end.start() if end else len(html)
            node.kids.append(html[at:stop])
            at = (html.find(">", end.end()) + 1 or len(html)) if end else stop
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    text(at, len(html))
    return root


def measured(root: Node) -> None:
    """Digests of text and shape of all elements, and their amounts of plain and of linked text."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [k for k in node.kids if k.__class__ is Node]
    for node in reversed(order):
        h, last = xxhash.xxh3_64(node.tag), 0
        shape = xxhash.xxh3_64(f"{node.tag} {node.name}", seed=1)
        for k in node.kids:
            if k.__class__ is Node:
                h.update(k.digest.to_bytes(8, "little"))
                node.prose += k.prose
                node.linked += k.linked
                if k.shape != last:  # lists of any length have one shape
                    shape.update(k.shape.to_bytes(8, "little"))
                last = k.shape
            elif s := k.strip():
                h.update(s)
                node.prose += len(s)
        if node.tag == "a":
            node.linked = node.prose
        node.digest, node.shape = h.intdigest(), shape.intdigest()


def articles_of(root: Node, hints: bool) -> list[Node]:
    """The article and main elements that are in no other and not within boilerplate, in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.boiler or hints and node.hint:
            continue
        if node.tag in ("article", "main"):
            out.append(node)
        else:
            todo += [k for k in reversed(node.kids) if k.__class__ is Node]
    return out


def middle_of(root: Node) -> Node:
    """Without articles: the innermost container that holds most of the text outside boilerplate."""
    node = root
    while True:
        fine = [k for k in node.kids if k.__class__ is Node and not k.boiler and not k.hint]
        total = sum(k.prose for k in fine) + sum(len(k.strip()) for k in node.kids if k.__class__ is str)
        most = max((k for k in fine if k.tag in CONTAINERS), key=lambda k: k.prose, default=None)
        if most is None or 2 * most.prose <= total:
            return node
        node = most


def holders(root: Node, wanted: set[int]) -> set[int]:
    """The elements that one of these is in."""
    out, path, todo = set(), [], [(root, 0)]
    while todo:
        node, depth = todo.pop()
        del path[depth:]
        if id(node) in wanted:
            out.update(path)
            continue
        path.append(id(node))
        todo += [(k, depth + 1) for k in node.kids if k.__class__ is Node]
    return out


def removable(root: Node, tops: list[Node], middle: Node | None) -> Iterator[tuple[Node, bool]]:
    """Subtrees that count as template if they recur, and whether their shape may tell.

    By text: all outside the articles, all articles but the largest; within them, boxes and those of links
    and forms. By shape: outside the articles, or outside the middle of a page without any, what has a
    class or is a list of links, but for long prose. What holds an article is no candidate.
    """
    largest, own = max(tops, key=lambda x: x.prose, default=None), {id(x) for x in tops}
    around = holders(root, own | ({id(middle)} if middle else set()))
    walk = [(root, False, middle is root)]
    while walk:
        node, inside, central = walk.pop()
        for k in node.kids:
            if k.__class__ is not Node:
                continue
            top = id(k) in own
            if k is not largest and id(k) not in around:
                links = 2 * k.linked >= k.prose
                if top or not inside or links or k.boiler or k.hint or k.tag in BOXES and k.prose < LONG:
                    shaped = not (inside or top or central or k is middle) and k.prose > 0 and (links or bool(k.name) and k.prose < LONG)
                    yield k, shaped
            walk.append((k, inside or top, central or k is middle))


def blocks(node: Node, deleted: set[int], hints: bool) -> list[str]:
    """Texts of the blocks in page order, without boilerplate and deleted subtrees; `hints`: nor what classes give away."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        if run and (s := " ".join(unescape("".join(run)).split())):
            out.append(s)
        run.clear()

    todo: list = [(node, hints)]
    while todo:
        k = todo.pop()
        if k is None:
            end()
        elif k.__class__ is str:
            run.append(k)
        else:
            k, hints = k
            if k.boiler or hints and k.hint or id(k) in deleted:
                continue
            hints = hints or k.tag in ("article", "main")
            if k.tag in BLOCK:
                end()
                todo.append(None)
            todo.extend((x, hints) if x.__class__ is Node else x for x in reversed(k.kids))
    end()
    return out


def numbers(node: Node) -> tuple[int, int]:
    """Text and shape digest, as they are counted."""
    return node.digest & (2**63 - 1), node.shape & (2**63 - 1)


def parts_of(html: str) -> tuple[Node, list[Node], Node | None]:
    root = parse(html)
    measured(root)
    tops = articles_of(root, True)
    return root, tops, None if tops else middle_of(root)


def main_text(html: str, template: list[int] | None = None, rules: bool = True) -> str:
    """The blocks that are no template. `template` has the digests that recur on the page's host, null if it has too few pages;
    then, if `rules`, articles and class names decide."""
    root, tops, middle = parts_of(html)
    if template is None:
        return "\n".join(x for top in (tops if rules and tops else [root]) for x in blocks(top, set(), rules))
    known, deleted = frozenset(template), set()
    for k, shaped in removable(root, tops, middle):
        text, shape = numbers(k)
        if text in known or shaped and shape in known:
            deleted.add(id(k))
    return "\n".join(blocks(root, deleted, not tops))


def subtree_digests(html: str) -> list[int]:
    found = set()
    for k, shaped in removable(*parts_of(html)):
        text, shape = numbers(k)
        found.add(text)
        if shaped:
            found.add(shape)
    return sorted(found)


def host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def section(url):
    """The first of several parts of a path."""
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/+([^/?#]+)/+[^/?#]", 1), F.lit(""))


def extract_main_text(pages: DataFrame, min_pages: int = 10, min_share: float = 0.3, method: bool = True) -> DataFrame:
    """page_id, url, text and n_chars of every row of `pages` (page_id, url, html; others are ignored).

    A subtree is template if at least `min_pages` pages and `min_share` of all pages of its host have it,
    or as many of the pages of a section of the host, on that section's pages. Hosts of fewer pages go by
    the rules about articles and class names, as all do without `method`. Null and empty html give an
    empty text; a null url belongs to the host ''; repeated rows are extracted each and count each; pages
    of any length are parsed whole.
    """
    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [subtree_digests(x.as_py() or "") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["host", "section", "digests"])

    rows = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", host(F.col("url"))).withColumn("section", section(F.col("url")))
    none = F.array().cast("array<long>")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py() or "", t.as_py()) for h, t in zip(batch.column("html"), batch.column("template"))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    schema = rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    if not method:
        return rows.select("page_id", "url", "html", F.lit(None).cast("array<long>").alias("template")).mapInArrow(lean(extract), schema)
    seen = rows.select("host", "section", "html").mapInArrow(lean(subtrees), "host string, section string, digests array<long>").select("host", "section", F.explode("digests").alias("digest"))
    counted = written(seen.groupBy("host", "section", "digest").agg(F.count(F.lit(1)).alias("n")), "subtrees")  # read twice
    parts = written(rows.groupBy("host", "section").agg(F.count(F.lit(1)).alias("pages")), "sections")
    sizes = parts.groupBy("host").agg(F.sum("pages").alias("pages")).filter(F.col("pages") >= min_pages)
    # one narrow row a host: its template, the few subtrees that a good share of its pages repeat, and what its sections add
    whole = counted.groupBy("host", "digest").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_pages)
    template = whole.join(sizes, "host").filter(F.col("n") >= min_share * F.col("pages")).select("host", "digest", F.lit(None).cast("string").alias("section"))
    added = counted.filter(F.col("n") >= min_pages).join(parts, ["host", "section"]).filter(F.col("n") >= min_share * F.col("pages")).select("host", "digest", "section")
    lists = template.unionByName(added).groupBy("host", "section").agg(F.sort_array(F.collect_list("digest")).alias("digests"))
    known = lists.groupBy("host").agg(F.first(F.when(F.col("section").isNull(), F.col("digests")), True).alias("of_host"), F.map_from_entries(F.collect_list(F.when(F.col("section").isNotNull(), F.struct("section", "digests")))).alias("of_sections"))
    known = written(sizes.select("host", F.lit(True).alias("told")).join(known, "host", "left"), "templates")
    # the table's size is known, so Spark broadcasts it if it is small; else pages and templates are dealt by host, and a hot host is split
    template = F.when(F.col("told"), F.concat(F.coalesce("of_host", none), F.coalesce(F.try_element_at("of_sections", F.col("section")), none))).alias("template")
    return rows.join(known, "host", "left").select("page_id", "url", "html", template).mapInArrow(lean(extract), schema)
