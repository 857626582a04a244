"""HTML extraction by wrapper induction.

Pages of a host that have the same kinds of structural tags (a layout) are aligned with one seed page of the layout by
simple tree matching, the dynamic programme that finds the largest order-preserving match of two trees with equal
roots.  Every block of text thereby gets the number of the seed's node it stands in (its slot; -1 if there is none)
and of the closest matched node around it (its anchor).  Over the layout's different pages two things are induced:

* template slots: those whose text is the same in most pages;
* the region of the content: from the root on, the child is entered under which most of the varying text stands
  (characters of distinct texts), as long as it holds at least `majority` of it and has children itself; a marked
  article is not entered further.

Blocks in the region whose slot is no template are content, and so is a varying h1 outside it.  What stands in menus,
page headers and footers, sidebars, forms, scripts, and (a whole class, id or attribute name says so) notices, adverts
and comments goes in any case, and where a page marks its article (article, main) nothing outside it is content.
`marks=False` leaves names and article marks out of account, and only the induced template decides.  Layouts with
fewer than `min_pages` different pages have no template: marks alone decide there.

The pages of a host never meet in one task: slots are counted by Spark per (host, layout, slot, text), and only each
layout's region and template slots (at most the seed's nodes) come back to its pages.

Defined cases: null and empty pages have the empty text; copies of a page count once; unclosed and stray tags are
mended as browsers do, roughly; a repeated page_id is extracted row by row.  The whole page is read, to any depth; nothing
is capped.  Of pages with the same smallest hash any may be the seed: the hash is of key, url and length, so they are copies or
rare.  An empty table gives an empty result; columns other than key, url and html are not read.
"""

from __future__ import annotations

import html as _html
import pickle
import re
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, table
from .urls import host_and_path

MIN_PAGES = 5
#: A slot is template if its commonest text has this share of the layout's different pages.
CONSTANT = 0.8
#: Share of the varying text that a child must hold for the content to lie within it.
MAJORITY = 0.75
#: Bytes up to which a table of layouts is broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 8_000_000
#: Tags whose presence tells layouts apart.
STRUCTURE = "html body article main section div nav footer aside header table ul ol dl form h1 h2"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object textarea title select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
NEVER = frozenset("nav footer aside form button head dialog menu".split())
MAIN = frozenset(("article", "main"))
KEPT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption".split())
NOISE = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo cookie cookies consent notice notices alert popup modal menu nav navbar navigation breadcrumb breadcrumbs sidebar footer header masthead comment comments disqus replies share social newsletter subscribe related login signup".split()
)
#: An open element of the key is closed by the start of one of its values.
CLOSES = {
    "p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt td th tr".split()),
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "tbody", "tfoot")),
    "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "option": frozenset(("option",)),
}
#: Elements across which an open one is not looked for.
WALLS = frozenset("body html article main section div nav footer aside header table ul ol dl form blockquote".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Node:
    __slots__ = ("symbol", "tag", "children", "number", "never", "noise", "hard", "main", "parent")

    def __init__(self, symbol, tag, number, never, noise, hard, main, parent):
        self.symbol, self.tag, self.children, self.number, self.never, self.noise, self.hard = symbol, tag, [], number, never, noise, hard
        self.main, self.parent = main, parent


def parse(page: str) -> tuple[Node, list[tuple[Node, str]], int]:
    """(root, blocks, nodes): each block is the element it stands in and its text, in page order."""
    root = Node("", "", 0, False, False, False, False, None)
    stack, blocks, text, count, at = [root], [], [], 1, 0

    def flush():
        if text:
            joined = " ".join(_html.unescape("".join(text)).split())
            text.clear()
            if joined:
                blocks.append((stack[-1], joined))

    def close(tag, walls):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                flush()
                del stack[k:]
                return
            if stack[k].tag in walls:
                return

    end = len(page)
    while at < end:
        m = TAG.search(page, at)
        if not m:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            if tag not in INLINE:
                close(tag, frozenset(("body", "html")) if tag in WALLS else WALLS)
            continue
        if tag in RAW:
            if not m.group(3).endswith("/"):
                # raw text ends with its own end tag only
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if tag in INLINE:
            if tag in ("br", "wbr"):
                text.append(" " if tag == "br" else "")
            continue
        flush()
        if tag in VOID:
            continue
        for open_tag, by in CLOSES.items():
            if tag in by:
                close(open_tag, WALLS - {open_tag})
        up, words, marks = stack[-1], "", m.group(3)
        never, named = tag in NEVER or (tag == "header" and not up.main), False
        if marks:
            found = {}
            for k, *value in ATTRIBUTE.findall(marks):
                found.setdefault(k.lower(), "".join(value).lower())
            tokens = (found.get("class", "") + " " + found.get("id", "")).split()
            words = " ".join(sorted(tokens))
            named = tag not in ("body", "html", "article", "main") and (not NOISE.isdisjoint(tokens) or found.get("role") in ("navigation", "contentinfo"))
            never = never or "hidden" in found or found.get("aria-hidden") == "true"
        # hard: also noise if the names of what is around the article do not count
        noise, hard = up.noise or never or named, up.hard or never or (named and up.main)
        node = Node(f"{tag}.{words}" if words else tag, tag, count, up.never or never, noise, hard, up.main or tag in MAIN, up)
        count += 1
        up.children.append(node)
        stack.append(node)
    flush()
    return root, blocks, count


# Trees are walked with lists of what is to be done, not by calls: pages nest as deep as they like.
def outline(root: Node) -> tuple:
    """(symbol, number, children) of a tree; numbers count its nodes in page order."""
    order, todo, made = [], [root], {}
    while todo:
        order.append(todo.pop())
        todo += order[-1].children
    for node in reversed(order):
        made[node.number] = (node.symbol, node.number, tuple(made[c.number] for c in node.children))
    return made[root.number]


def in_order(seed: tuple) -> list[tuple]:
    """The nodes of an outline in page order."""
    out, todo = [], [seed]
    while todo:
        out.append(todo.pop())
        todo += reversed(out[-1][2])
    return out


def packed(seed: tuple) -> bytes:
    """An outline as bytes: each node's symbol and the place of its parent, in page order."""
    nodes = in_order(seed)
    parent = {c[1]: k for k, node in enumerate(nodes) for c in node[2]}
    return pickle.dumps([(node[0], parent.get(node[1], -1)) for node in nodes])


def unpacked(data: bytes) -> tuple:
    flat = pickle.loads(data)
    children: list[list] = [[] for _ in flat]
    for k in range(len(flat) - 1, -1, -1):
        symbol, parent = flat[k]
        node = (symbol, k, tuple(reversed(children[k])))
        children[k] = []
        if parent < 0:
            return node
        children[parent].append(node)
    raise ValueError("an outline without a root")


def match(a: Node, b: tuple, found: dict[int, int], memo: dict) -> None:
    """Simple tree matching of page node a with seed node b (equal symbols): found[page node] = seed node."""
    weigh(a, b, memo)
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        found[x.number] = y[1]
        if (x.number, y[1]) in memo:
            todo += memo[x.number, y[1]][1]


def weigh(a: Node, b: tuple, memo: dict) -> int:
    """Size of the largest match of two nodes with equal symbols; keeps their matched children in memo."""
    todo = [(a, b, False)]
    while todo:
        x, y, ready = todo.pop()
        if (x.number, y[1]) in memo:
            continue
        if ready or not x.children or not y[2]:
            memo[x.number, y[1]] = _aligned(x, y, memo)
            continue
        todo.append((x, y, True))
        todo += [(c, d, False) for c in x.children if c.children for d in y[2] if d[2] and c.symbol == d[0] and (c.number, d[1]) not in memo]
    return memo[a.number, b[1]][0]


def _aligned(a: Node, b: tuple, memo: dict) -> tuple[int, tuple]:
    """(size of the largest match, matched children) of two nodes whose children are weighed already."""
    xs, ys = a.children, b[2]
    if not xs or not ys:
        return 1, ()
    m, n = len(xs), len(ys)
    best = [[0] * (n + 1)]
    weights = []
    for x in xs:
        above, row, own = best[-1], [0], []
        leaf, symbol, left = not x.children, x.symbol, 0
        for j, y in enumerate(ys):
            w = 0 if symbol != y[0] else 1 if leaf or not y[2] else memo[x.number, y[1]][0]
            own.append(w)
            top = above[j + 1]
            both = above[j] + w
            left = both if w and both >= top and both >= left else top if top >= left else left
            row.append(left)
        best.append(row)
        weights.append(own)
    pairs, i, j = [], m, n
    while i and j:
        w = weights[i - 1][j - 1]
        if w and best[i][j] == best[i - 1][j - 1] + w:
            pairs.append((xs[i - 1], ys[j - 1]))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return 1 + best[m][n], tuple(reversed(pairs))


#: Kinds of blocks: ruled out by the page's own elements, by names, outside the marked article; sure to be looked at.
ELEMENT, NAMED, OUTSIDE, OPEN = range(4)


def page_blocks(page: str | None, seed: bytes | None) -> list[tuple[int, int, int, bool, str]]:
    """(slot, anchor, kind, is h1, text) of each block of a page."""
    if not page:
        return []
    root, blocks, _ = parse(page)
    inside = any(node.main and not node.noise for node, _ in blocks)
    # the only article may stand in an element that is named like noise
    spared = not inside and any(node.main and not node.hard for node, _ in blocks)
    slots: dict[int, int] = {}
    if seed and blocks:
        match(root, unpacked(seed), slots, {})
    out, anchors = [], {}
    for node, text in blocks:
        if node.never:
            kind = ELEMENT
        elif node.hard or (node.noise and not (spared and node.main)):
            kind = NAMED
        else:
            kind = OUTSIDE if (inside or spared) and not node.main else OPEN
        up, path = node, []
        while up is not None and up.number not in slots and up.number not in anchors:
            path.append(up.number)
            up = up.parent
        anchor = -1 if up is None else slots[up.number] if up.number in slots else anchors[up.number]
        anchors.update(dict.fromkeys(path, anchor))
        out.append((slots.get(node.number, -1), anchor, kind, node.tag == "h1", text))
    return out


def region_of(seed: tuple, mass: dict[int, int], majority: float = MAJORITY, marks: bool = True) -> tuple[int, int]:
    """First and last node number of the part of a seed under which the varying text stands; marks: a marked article is not split."""
    total: dict[int, int] = {}
    last: dict[int, int] = {}
    for node in reversed(in_order(seed)):  # children before their parents
        total[node[1]] = mass.get(node[1], 0) + sum(total[c[1]] for c in node[2])
        last[node[1]] = last[node[2][-1][1]] if node[2] else node[1]
    node = seed
    while node[2]:
        best = max(node[2], key=lambda c: total[c[1]])
        if total[best[1]] < majority * max(total[seed[1]], 1) or not best[2] or best[0].split(".")[0] in KEPT:
            break
        node = best
        if marks and node[0].split(".")[0] in MAIN:
            break
    return node[1], last[node[1]]


def layout_of(html: Column) -> Column:
    """Hash of the set of structural tags that open in a page; null for none."""
    tags = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(html), F.lit(f"<({STRUCTURE.replace(' ', '|')})[ \t\n\r/>]"), F.lit(1))))
    return F.when(F.size(tags) > 0, F.xxhash64(tags))


def by_layout(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on _host and _layout; the right side is broadcast if its bytes are few."""
    size = right.select(F.sum(F.length(F.to_json(F.struct(*right.columns)))).alias("n")).first().n or 0
    right = right.withColumnsRenamed({"_host": "_h", "_layout": "_l"})
    right = F.broadcast(right) if size <= BROADCAST_BYTES else right
    return left.join(right, (F.col("_host") == F.col("_h")) & (F.col("_layout") == F.col("_l")), "left").drop("_h", "_l")


def seeds_of(pages: DataFrame) -> DataFrame:
    """(_host, _layout, _seed): the outline of one page of each layout, that with the smallest hash."""
    least = staged(pages.where("_layout is not null").groupBy("_host", "_layout").agg(F.min("_hash").alias("_least")), "least")
    chosen = by_layout(pages.where("_layout is not null"), least).where(F.col("_hash") == F.col("_least"))

    def outlines(batches):
        import pyarrow as pa

        for batch in batches:
            made = [packed(outline(parse(x or "")[0])) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["_host", "_layout", "_seed"])

    return chosen.select("_host", "_layout", "_html").mapInArrow(outlines, "_host string, _layout long, _seed binary").dropDuplicates(["_host", "_layout"])


def templates(blocks: DataFrame, seeds: DataFrame, min_pages: int, constant: float, majority: float, marks: bool) -> DataFrame:
    """(_host, _layout, _first, _last, _template) of the layouts with enough different pages."""
    keys = ["_host", "_layout"]
    each = blocks.where("_layout is not null").select(*keys, "_sig", F.explode("_blocks").alias("b"))
    # copies of a page count once
    each = each.where(f"b.anchor >= 0 and b.kind >= {NAMED}").select(*keys, "_sig", "b.slot", "b.anchor", F.xxhash64("b.text").alias("value"), F.length("b.text").alias("n")).distinct()
    values = staged(each.groupBy(*keys, "slot", "anchor", "value").agg(F.count_distinct("_sig").alias("pages"), F.first("n").alias("n")), "values")
    different = blocks.select(*keys, "_sig").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("different")).where(F.col("different") >= min_pages)
    fixed = values.where("slot >= 0").groupBy(*keys, "slot").agg(F.max("pages").alias("top")).join(different, keys)
    fixed = fixed.where(F.col("top") >= constant * F.col("different")).groupBy(*keys).agg(F.collect_set("slot").alias("_template"))  # at most the seed's nodes
    mass = values.groupBy(*keys, "anchor", "value").agg(F.first("n").alias("n")).groupBy(*keys, "anchor").agg(F.sum("n").alias("n"))
    mass = mass.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("anchor", "n"))).alias("_mass"))

    def find(batches):
        import pyarrow as pa

        for batch in batches:
            at = [region_of(unpacked(s), dict(m), majority, marks) for s, m in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            ends = [pa.array([x[k] for x in at], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *ends], names=["_host", "_layout", "_first", "_last"])

    found = seeds.join(different, keys, "left_semi").join(mass, keys).select(*keys, "_seed", "_mass").mapInArrow(find, "_host string, _layout long, _first int, _last int")
    return found.join(fixed, keys, "left").select(*keys, "_first", "_last", F.coalesce("_template", F.array().cast("array<int>")).alias("_template"))


def extract_text(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, constant: float = CONSTANT, majority: float = MAJORITY, marks: bool = True
) -> DataFrame:
    """key, url, text and n_chars of every page."""
    own = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(html).alias("_html"))
    own = own.withColumns({"_host": host_and_path(F.col("_url"))[0], "_layout": layout_of(F.col("_html")), "_hash": F.xxhash64("_key", "_url", F.length("_html"))})
    seeds = staged(seeds_of(own), "seeds")
    kind = dict(own.dtypes)["_key"]

    def align(batches):
        import pyarrow as pa

        block = pa.list_(pa.struct([("slot", pa.int32()), ("anchor", pa.int32()), ("kind", pa.int32()), ("h1", pa.bool_()), ("text", pa.string())]))
        for batch in batches:
            made = [page_blocks(p, s) for p, s in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())]
            sig = [zlib.crc32("\n".join(x[-1] for x in b).encode()) for b in made]
            rows = [[dict(zip(("slot", "anchor", "kind", "h1", "text"), x)) for x in b] for b in made]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(rows, block), pa.array(sig, pa.int64())], names=["_key", "_url", "_host", "_layout", "_blocks", "_sig"])

    joined = by_layout(own, seeds).select("_key", "_url", "_host", "_layout", "_html", "_seed")
    kinds = "array<struct<slot:int,anchor:int,kind:int,h1:boolean,text:string>>"
    blocks = staged(joined.mapInArrow(align, f"_key {kind}, _url string, _host string, _layout long, _blocks {kinds}, _sig long"), "blocks")
    out = by_layout(blocks, staged(templates(blocks, seeds, min_pages, constant, majority, marks), "templates"))
    induced = F.col("_first").isNotNull()
    allowed = lambda b: b["kind"] >= (OPEN if marks else NAMED)
    wanted = lambda b: ((b["anchor"].between(F.col("_first"), F.col("_last"))) | b["h1"]) & ~F.array_contains("_template", b["slot"])
    kept = F.when(induced, F.filter("_blocks", lambda b: allowed(b) & wanted(b))).otherwise(F.filter("_blocks", lambda b: b["kind"] == OPEN))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return out.select(F.col("_key").alias(key), F.col("_url").alias(url), text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def query(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))
