"""Main-text extraction with a site style tree.

The pages of a host are merged into one tree. Its nodes are boxes (div, section, ul, table and the
like) and other block elements with a class or id; elements that agree in tag, class and id (long
numbers aside; without either, in tag and place) along the whole path are one node. For each node the tree
holds on how many pages it stands and, in a base that makes 1 the most,

* content: the entropy of its texts over these pages, 0 if they all have one text;
* presentation: the entropy of its presentations over its distinct texts. A presentation is the
  sequence of the blocks below, each with its tag and the power of two of its words. A box that
  holds one line on each page has few, an article hardly the same one twice.

On a page a node's content counts relative to the node around it, so that pages in many copies lose
nothing by that, and the blocks of a text box (an article, or a box whose own paragraphs and
headings are most of its text) share its presentation. Importance is

    content * (GAMMA + (1 - GAMMA) * presentation),

drawn towards USUAL as by PRIOR more pages, so small hosts are judged in the same way with less
weight. Names and roles (navigation, footers, sidebars, notices, adverts, forms, comments) lower it
to the share NAMED, standing beside the page's article to BESIDE. Branches below THRESHOLD are
removed. What holds the article or the page's first heading is never removed for its name or
shape, nor is what holds most of the page's text while neither stands outside.

Defined cases: null or empty html gives an empty text; null urls share one host; a null key is
returned as it is; repeated rows are each returned; unclosed and crossing tags are closed as their
parents close; long and deeply nested pages take time in proportion to their length; a page that
would lose all its text keeps the blocks without a cutting name; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import bound_batches, materialise

GAMMA, THRESHOLD = 0.2, 0.55
USUAL, PRIOR = 0.75, 4
NAMED, BESIDE = 0.4, 0.7
#: Nodes of trees that are broadcast at most, of NODE_BYTES each; beyond, pages meet their tree by shuffle, hosts dealt over SALTS.
MOST_BROADCAST, NODE_BYTES, SALTS = 400_000, 32, 32
#: Unnamed boxes of one tag are told apart by their place up to this.
PLACES = 4

# Fixed values of the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = "script style noscript template textarea title iframe object svg select canvas audio video noembed noframes xmp".split()
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tr", "td", "th"), "option": ("option",),
}
_SCOPE = frozenset("ul ol dl table article main section div body html aside nav header footer td th form blockquote".split())
_BOXES = frozenset("address article aside center details dialog dir div dl fieldset figure footer form header hgroup main menu nav ol section table ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# Roles.
_NEVER_TAGS = frozenset("nav footer aside dialog menu button head".split())
_CUT_TAGS = _NEVER_TAGS | {"form", "fieldset"}
_CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_CUT_WORDS = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside rail ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored "
    "promo promotion banner cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login form "
    "comment comments reply replies disqus share sharing social related recommended breadcrumb breadcrumbs pagination pager widget toolbar skip copyright legal "
    "disclaimer hidden tags byline".split()
)
_CUT_PARTS = re.compile("sidebar|advert|adsby|adsense|cookie|comment|newsletter|breadcrumb|navbar|footer|sponsor|disqus|pagination")
_MAIN = frozenset(["article", "main"])

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<raw>" + "|".join(_RAW) + r")(?=[\s/>])(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>?",
    re.S | re.I,
)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile("[a-z]+")
_DIGITS = re.compile("[0-9]{3,}")


class Node:
    """An element. key: hash of the path of names to it, 0 if the tree doesn't judge it; named: it has
    a class or id; cue: its name or role speaks against it."""

    __slots__ = ("above", "cue", "items", "key", "named", "path", "places", "tag")

    def __init__(self, tag: str, above: int, path: int = 0, key: int = 0, cue: bool = False, named: bool = False):
        self.tag, self.above, self.path, self.key, self.cue, self.named = tag, above, path, key, cue, named
        self.items: list[int] = []  # children (number) and own blocks (-1 - number), in order
        self.places: dict[str, int] | None = None


def _cue(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    if tag in _CUT_TAGS or (tag == "header" and not inside):
        return True
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role") in _CUT_ROLES:
        return True
    named = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()
    if not named.strip() or tag in ("html", "body"):
        return False
    return bool(_CUT_PARTS.search(named)) or not _CUT_WORDS.isdisjoint(_WORD.findall(named))


class Page:
    """A parsed page: its elements, parents first, and its blocks of text as lists of (text, element)."""

    def __init__(self, source: str | None):
        self.nodes = [Node("", -1)]
        self.blocks: list[list[tuple[str, int]]] = []
        #: The block element that holds each block.
        self.holders: list[int] = []
        self._parse(source or "")

    def _parse(self, source: str) -> None:
        nodes, stack = self.nodes, [0]
        where: dict[str, list[int]] = defaultdict(list)  # depths of the open elements of each tag
        block_depths, scope_depths = [0], [0]
        inside = 0
        text: list[tuple[str, int]] = []

        def flush() -> None:
            if text:
                if any(not t.isspace() for t, _ in text):
                    holder = stack[block_depths[-1]]
                    nodes[holder].items.append(-1 - len(self.blocks))
                    self.blocks.append(text.copy())
                    self.holders.append(holder)
                text.clear()

        def close(depth: int) -> None:
            nonlocal inside
            for d in range(len(stack) - 1, depth - 1, -1):
                tag = nodes[stack[d]].tag
                where[tag].pop()
                if block_depths[-1] == d:
                    block_depths.pop()
                if scope_depths[-1] == d:
                    scope_depths.pop()
                inside -= tag in _MAIN
            del stack[depth:]

        at = 0
        for m in _TOKEN.finditer(source):
            if m.start() > at:
                text.append((source[at : m.start()], stack[-1]))
            at = m.end()
            tag = (m["tag"] or "").lower()
            if not tag:
                if m[0].startswith("<![CDATA["):
                    text.append((html.escape(m[0][9:].removesuffix("]]>")), stack[-1]))
                continue
            if tag == "br":
                text.append((" ", stack[-1]))
                continue
            block = tag in _BLOCK
            if block:
                flush()
            if m["end"]:
                # An inline element isn't closed across a block that began inside it.
                if where[tag] and (block or where[tag][-1] > block_depths[-1]):
                    close(where[tag][-1])
                continue
            if block:
                # A paragraph ends where another block begins; items end at the next item. Inline elements left open end too.
                close(block_depths[-1] + (nodes[stack[block_depths[-1]]].tag != "p"))
                open_items = [where[t][-1] for t in _CLOSES.get(tag, ()) if where[t] and where[t][-1] >= scope_depths[-1] and where[t][-1] > 0]
                if open_items:
                    close(min(open_items))
            above = stack[-1]
            if tag in _VOID or m["attrs"].endswith("/") and not block:
                continue
            attrs = {k.lower(): (v or "").strip("\"'") for k, v in _ATTR.findall(m["attrs"])} if "=" in m["attrs"] or "hidden" in m["attrs"] else {}
            named = bool(attrs.get("class") or attrs.get("id"))
            path = key = 0
            if block:
                name = tag
                if named:
                    name = _DIGITS.sub("0", f"{tag}.{' '.join(sorted(attrs.get('class', '').split()))}#{attrs.get('id', '')}")
                elif tag in _BOXES:
                    places = nodes[above].places = nodes[above].places or {}
                    places[tag] = places.get(tag, -1) + 1
                    name = f"{tag}[{min(places[tag], PLACES)}]"
                path = xxhash.xxh64_intdigest(f"{nodes[stack[block_depths[-1]]].path}/{name}") >> 1
                if (named or tag in _BOXES) and tag not in ("html", "body"):
                    key = path
            nodes[above].items.append(len(nodes))
            where[tag].append(len(stack))
            if block:
                block_depths.append(len(stack))
            if tag in _SCOPE:
                scope_depths.append(len(stack))
            stack.append(len(nodes))
            nodes.append(Node(tag, above, path, key, _cue(tag, attrs, inside > 0), named))
            inside += tag in _MAIN
        if at < len(source):
            text.append((source[at:], stack[-1]))
        flush()

    def sums(self, own: list[int]) -> list[int]:
        """Of a number for each element, the sums over the elements and all below."""
        out = own.copy()
        for i in range(len(out) - 1, 0, -1):
            out[self.nodes[i].above] += out[i]
        return out

    def observed(self) -> dict[int, tuple[int, int]]:
        """The presentation and the content of each node of the tree."""
        nodes = self.nodes
        shape, content = [0] * len(nodes), [0] * len(nodes)
        words = [" ".join("".join(t for t, _ in b).split()) for b in self.blocks]
        for i in range(len(nodes) - 1, -1, -1):
            x = nodes[i]
            below = [(shape[k], content[k]) if k >= 0 else (1 + (words[-1 - k].count(" ") + 1).bit_length(), xxhash.xxh64_intdigest(words[-1 - k]) >> 3) for k in x.items]
            below = [b for b in below if b[1]]  # elements without text don't count
            if below:
                tag = xxhash.xxh32_intdigest(x.tag)
                shape[i] = hash((tag, *(b[0] for b in below)))
                content[i] = hash(tuple(b[1] for b in below)) or 1
        seen: dict[int, list[int]] = defaultdict(list)
        for i, x in enumerate(nodes):
            if x.key and content[i]:
                seen[x.key].append(i)
        return {k: (hash(tuple(shape[i] for i in at)), hash(tuple(content[i] for i in at))) for k, at in seen.items()}

    def text(self, tree: dict[int, tuple[int, float, float]], roles: bool = True) -> str:
        """What the branches of enough importance hold. tree: pages, presentation and content by key."""
        nodes = self.nodes
        n = len(nodes)
        own = [0] * n
        direct = [0] * n  # text that stands in paragraphs and headings right below
        for b, holder in zip(self.blocks, self.holders, strict=True):
            size = 0
            for t, i in b:
                size += len(t)
                own[i] += len(t)
            box = holder
            while nodes[box].tag in _BLOCK and not nodes[box].key and nodes[box].above >= 0 and nodes[box].tag not in ("li", "td", "th", "dd", "dt", "body"):
                box = nodes[box].above
            direct[box] += size
        mass = self.sums(own)
        heads = self.sums([int(x.tag == "h1") for x in nodes])
        articles = [0] * n
        under = [0] * n
        largest = max((mass[i] for i in range(n) if nodes[i].tag in _MAIN), default=0)
        for i in range(1, n):
            x = nodes[i]
            under[i] = under[x.above]
            if roles and x.tag in _MAIN and not under[i] and mass[i] and (not x.cue or heads[i] or mass[i] == largest):
                articles[i] = under[i] = 1
        holds = self.sums(articles)
        first = next((i for i in range(n) if nodes[i].tag == "h1" and mass[i] and (not holds[0] or under[i])), 0)
        has_first = [0] * n
        if first:
            i = first
            while i >= 0:
                has_first[i] = 1
                i = nodes[i].above
        keep, softly = [True] * n, [True] * n
        presentation, content = [0.0] * n, [1.0] * n
        for i in range(1, n):
            x = nodes[i]
            above = x.above
            keep[i], softly[i] = keep[above], softly[above]
            presentation[i], content[i] = presentation[above], content[above]
            if not keep[i] and not softly[i] or not x.key and not x.cue:
                continue
            # A branch that holds the article or the first heading stays for its name and shape; so does one that holds most of the text.
            central = bool(holds[i]) or bool(has_first[i]) or (2 * mass[i] > mass[0] and not holds[0] and not first and not (roles and x.tag in _NEVER_TAGS))
            named = roles and x.cue and not central
            if named:
                softly[i] = False
            pages, shape, kept = tree.get(x.key, (0, 0.0, 1.0)) if x.key else (0, 0.0, 1.0)
            text_box = roles and x.tag in _MAIN or 2 * direct[i] > mass[i] and x.tag in _BOXES
            inherited = presentation[above] if nodes[above].tag != "body" or x.tag not in _BOXES else 0.0
            shape = 1.0 if central else max(shape, inherited)
            presentation[i] = max(shape, inherited) if text_box and (shape > 0.5 or central) else inherited
            relative = 1.0 if articles[i] or holds[i] else min(1.0, kept / max(content[above], 1e-3))
            content[i] = kept
            if under[i] and not x.named and not articles[i]:
                relative = 1.0  # paragraphs, lists and tables of an article without a name of their own
            value = (pages * relative * (GAMMA + (1 - GAMMA) * shape) + PRIOR * USUAL) / (pages + PRIOR)
            if named:
                value *= NAMED
            elif holds[0] and not under[i] and not central:
                value *= BESIDE
            if value < THRESHOLD and not (central and (holds[i] or 2 * mass[i] > mass[0])):
                keep[i] = False
        for flags in (keep, softly):
            out = []
            for b in self.blocks:
                joined = " ".join(html.unescape("".join(t for t, i in b if flags[i])).split())
                if joined:
                    out.append(joined)
            if out:
                return "\n\n".join(out)
        return ""


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, node, shape, content) of each node of each page."""
    for batch in batches:
        rows: list[tuple] = []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            rows += [(host, key, shape, content) for key, (shape, content) in Page(page).observed().items()]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["host", "node", "shape", "content"])


def entropies(rows: DataFrame) -> DataFrame:
    """(host, node, pages, presentation, content) of rows(host, node, shape, content), one for each page and node."""
    texts = rows.groupBy("host", "node", "shape", "content").agg(F.count("*").alias("n"))
    shapes = texts.groupBy("host", "node", "shape").agg(F.sum("n").alias("pages"), F.count("*").alias("kinds"), F.sum(F.col("n") * F.log("n")).alias("texts"))
    sums = shapes.groupBy("host", "node").agg(
        F.sum("pages").alias("pages"), F.sum("kinds").alias("kinds"), F.sum("texts").alias("texts"), F.sum(F.col("kinds") * F.log("kinds")).alias("shapes"),
    )
    return sums.where("pages > 1").select(
        "host", "node", "pages",
        F.when(F.col("kinds") > 1, 1 - F.col("shapes") / (F.col("kinds") * F.log("kinds"))).otherwise(0.0).alias("presentation"),
        (1 - F.col("texts") / (F.col("pages") * F.log("pages"))).alias("content"),
    )


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, node, pages, presentation, content): the merged trees of pages(host, html)."""
    return entropies(pages.select("host", "html").mapInArrow(_observe, "host string, node long, shape long, content long"))


def main_text(page: str | None, tree: dict[int, tuple[int, float, float]] | None = None, roles: bool = True) -> str:
    return Page(page).text(tree or {}, roles)


def _extract(roles: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple = (None, {})  # the tree of the last host
        for batch in batches:
            texts = []
            hosts, trees = batch.column("host").to_pylist(), batch.column("tree")
            for i, page in enumerate(batch.column("html").to_pylist()):
                if known[0] != hosts[i]:
                    known = (hosts[i], {x["node"]: (x["pages"], x["presentation"], x["content"]) for x in trees[i].as_py() or ()})
                texts.append(main_text(page, known[1], roles))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def extract(pages: DataFrame, roles: bool = True, tree: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of pages(page_id, url, html). Without roles the names of tags and
    classes count nothing but headings, without tree entropy counts nothing."""
    bound_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("host", host_of(F.col("url")))
    nodes = materialise(style_tree(rows if tree else rows.limit(0)), "nodes")
    trees = nodes.groupBy("host").agg(F.collect_list(F.struct("node", F.col("pages").cast("int").alias("pages"), F.col("presentation").cast("float").alias("presentation"), F.col("content").cast("float").alias("content"))).alias("tree"))
    if nodes.count() <= MOST_BROADCAST:
        held = rows.join(F.broadcast(trees), "host", "left")
    else:
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).alias("salt")
        held = rows.select("*", salt).join(trees.select("*", F.explode(F.array(*(F.lit(i).cast("long") for i in range(SALTS)))).alias("salt")), ["host", "salt"], "left")
    return held.select("page_id", "url", "html", "host", "tree").mapInArrow(_extract(roles), "page_id long, url string, text string, n_chars long")
