"""Main text of web pages by wrapper induction over pages of one host.

Each page becomes a small tree: elements that hold blocks, with runs of alike siblings folded into one node. Simple
tree matching aligns every distinct tree of a host with the host's most frequent tree; nodes that match none are slots
of their own. Slots decide, over the distinct pages of the host that have them: a slot is content only if its texts vary
enough, and `NEED` says how many of them must be new ones (undeclared ones: not on several pages of any hosts), by what HTML itself declares
of the slot. Declared content (below an
article or main element) needs little, undeclared blocks half, and what pages declare to be something else (navigation,
forms, adverts, comments, ..., and what lies beside an article) never is content. An undeclared slot whose text is nearly all
link text is a menu, however it varies; and as undeclared blocks of several kinds may share a slot, a text that half of the pages repeat
in it is template too. Below an article a headline or paragraph that pages share stays as long as its slot varies, unless nearly all
articles of the host have it, as they have a notice. As an article may be copied, slots below it are judged over distinct articles, and an article of which
little would remain is a copy and kept as a whole. Hosts of few pages keep what they do not declare to be something else, but for menus.

The first pass over the pages sends trees and text hashes, combined by host; no group of pages meets in one task.
"""

import html
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evipack.llm.scratch import written
from evipack.llm.skew import join_groups

#: A text is template where this share of the distinct pages with its slot has it, and so many pages at least, and a slot is judged from so many
#: distinct pages on: below an article or main element (1) and elsewhere (0).
CONSTANT_SHARE, CONSTANT_PAGES, MIN_PAGES = {1: 0.9, 0: 0.5}, 3, {1: 8, 0: 4}
#: An undeclared text on so many distinct pages, of whatever hosts, is no new one: adverts and footers are shared by hosts, copies of pages are few.
COMMON_PAGES = 4
#: A slot is a menu if so much of its text over the host is link text.
MENU_SHARE = 0.8
#: Share of a slot's texts that must be new ones: below an article or main element, and of slots that pages say nothing of.
NEED = {1: 0.1, 0: 0.5}
#: An article, or what a page without one does not repeat, is kept as a whole if less than this share of its characters varies.
COPY_REST = 0.2
SALTS = 16
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg iframe object canvas head title select option textarea button".split())
BARRED = frozenset("nav header footer aside form dialog menu".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Words of class and id values, between signs that are no letters, that name what is no content.
ROLES = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|notice|notification|popup|modal|newsletter|subscribe|subscription|sidebar|side-?bar|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|comments?|disqus|replies|respond|related|recommended|share|sharing|social|pagination|pager|widget|login|signup|search)(?:$|[^a-z])"
)
ARIA = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Elements that the start of another one ends, and what bounds the search for them.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table html body article main section div nav aside footer header blockquote form td th".split())
MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
RAW = {t: re.compile(rf"</{t}\s*(?:>|/|\s|\Z)", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe")}
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("barred", "children", "tag")

    def __init__(self, tag: str, barred: bool = False):
        self.tag, self.barred, self.children = tag, barred, []  # children: Node or str


def _barred(tag: str, attributes: str) -> bool:
    if tag in HIDDEN or tag in BARRED:
        return True
    if not attributes.strip():
        return False
    found = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role") in ARIA:
        return True
    if tag in ("body", "html", "article", "main"):
        return False
    return any(ROLES.search(found.get(k, "")) for k in ("class", "id"))


def parse(page: str) -> Node:
    """The element tree of a page; references decoded, text of hidden elements left out, missing end tags supplied."""
    root = Node("#root")
    stack, at, n, still = [root], 0, len(page), Counter()  # still: open elements by tag
    while at < n:
        found = MARK.search(page, at)
        end = found.start() if found else n
        if end > at:
            stack[-1].children.append(html.unescape(page[at:end]))
        if not found:
            break
        at = max(found.end(), found.start() + 1)
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            for k in range(len(stack) - 1, 0, -1) if still[tag] else ():
                if stack[k].tag == tag:
                    if tag in BLOCK or not any(x.tag in BLOCK for x in stack[k + 1 :]):
                        _cut(stack, k, still)
                    break
            continue
        if tag in BLOCK:  # a block ends open paragraphs
            _close(stack, CLOSES.get(tag, ("p",)), still)
        node = Node(tag, _barred(tag, found[3] or ""))
        stack[-1].children.append(node)
        if tag in VOID or (found[3] or "").rstrip().endswith("/"):
            continue
        if tag in RAW:
            close = RAW[tag].search(page, at)
            at = close.start() if close else n
        stack.append(node)
        still[tag] += 1
    return root


def _cut(stack: list[Node], k: int, still: Counter) -> None:
    still.subtract(x.tag for x in stack[k:])
    del stack[k:]


def _close(stack: list[Node], tags, still: Counter) -> None:
    if not any(still[t] > 0 for t in tags):
        return
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            _cut(stack, k, still)
            return
        if stack[k].tag in SCOPES:
            return


def step(path: int, tag: str) -> int:
    """Number of the path that leads on by a tag."""
    return int.from_bytes(xxhash.xxh64_digest(f"{path}/{tag}", 42), "big", signed=True)


def blocks(root: Node):
    """(tree, [(node, region, text, linked)]) with the blocks in page order; linked counts the characters that are link text. tree: the page's folded tree as (parent, tag, path) nodes,
    where path is a number for the tags above; region: -1 declared to be no content, 1 in an article or main element, else 0.
    Where a page declares an article with text, what lies beside it is declared to be none of it."""
    tree, below, out, held, linked = [(-1, "", 0)], {}, [], [], []

    def flush(node, region):
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append((node, region, text, len("".join("".join(linked).split())) if linked else 0))
            held.clear()
            linked.clear()

    todo = [(root, iter(root.children), 0, 0, False)]
    while todo:
        element, rest, node, region, link = todo[-1]
        for child in rest:
            if isinstance(child, str):
                held.append(child)
                if link:
                    linked.append(child)
            elif child.tag == "br":
                held.append(" ")
            elif child.tag in BLOCK or child.barred:
                flush(node, region)
                inner = -1 if region < 0 or child.barred else 1 if child.tag in ("article", "main") else region
                if child.tag not in HIDDEN:
                    at = below.get((node, child.tag))
                    if at is None:
                        at = below[(node, child.tag)] = len(tree)
                        tree.append((node, child.tag, step(tree[node][2], child.tag)))
                    todo.append((child, iter(child.children), at, inner, link))
                break
            elif child.tag not in HIDDEN:
                todo.append((child, iter(child.children), node, region, link or child.tag == "a"))
                break
        else:
            if element.tag in BLOCK or element.barred or element is root:
                flush(node, region)
            todo.pop()
    if any(x[1] == 1 for x in out):
        out = [(node, region or -1, *rest) for node, region, *rest in out]
    return tree, out


def written_tree(tree) -> str:
    return "/".join(f"{parent}:{tag}" for parent, tag, _ in tree)


def read_tree(text: str):
    """(tags, paths, children) of a written tree."""
    tags, paths, children = [], [], []
    for k, node in enumerate(text.split("/")):
        parent, tag = node.split(":", 1)
        above = int(parent)
        tags.append(tag)
        children.append([])
        paths.append(step(paths[above], tag) if above >= 0 else 0)
        if above >= 0:
            children[above].append(k)
    return tags, paths, children


def simple_tree_matching(a, b) -> tuple[int, list[tuple[int, int]]]:
    """Size of the largest order-keeping match of two trees from `read_tree`, and the matched nodes. Not recursive, as pages may
    be nested very deeply."""
    (tags, _, below), (others, _, beneath) = a, b
    if tags[0] != others[0]:
        return 0, []
    pairs = [(0, 0)]
    for x, y in pairs:  # grows while it is read: a pair comes before those below it
        pairs.extend((i, j) for i in below[x] for j in beneath[y] if tags[i] == others[j])
    size, best = {}, {}
    for x, y in reversed(pairs):
        table = [[0] * (len(beneath[y]) + 1) for _ in range(len(below[x]) + 1)]
        for i, u in enumerate(below[x]):
            for j, v in enumerate(beneath[y]):
                table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + size.get((u, v), 0))
        best[x, y], size[x, y] = table, table[-1][-1] + 1
    matched, todo = [], [(0, 0)]
    while todo:
        x, y = todo.pop()
        matched.append((x, y))
        table, i, j = best[x, y], len(below[x]), len(beneath[y])
        while i and j:
            pair = (below[x][i - 1], beneath[y][j - 1])
            if pair in size and table[i][j] == table[i - 1][j - 1] + size[pair]:
                todo.append(pair)
                i, j = i - 1, j - 1
            elif table[i][j] == table[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return size[0, 0], matched


def text_hash(text: str) -> int:
    return int.from_bytes(xxhash.xxh64_digest(text.encode("utf-8", "surrogatepass"), 42), "big", signed=True)


#: part: 1 below an article or main element, where body stands for the articles alone, else 0.
FIRST = "salt int, host string, tree string, part int, body long, path long, texts array<bigint>, chars long, linked long"


def _folded(batches):
    for batch in batches:
        out = {k: [] for k in ("salt", "host", "tree", "part", "body", "path", "texts", "chars", "linked")}
        for salt, host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            tree, found = blocks(parse(page.as_py() or ""))
            bodies = [text_hash("\n".join(x[2] for x in found if x[1] >= part)) for part in (0, 1)]
            own = {(0, 0): [set(), 0, 0]}  # a page counts even without blocks
            for node, region, text, linked in found:
                if region >= 0:
                    held = own.setdefault((region, tree[node][2]), [set(), 0, 0])
                    held[0].add(text_hash(text))
                    held[1] += len(text) - text.count(" ")
                    held[2] += linked
            tree = written_tree(tree)
            for (part, path), (texts, chars, linked) in own.items():
                for k, v in zip(out, (salt, host, tree, part, bodies[part], path, sorted(texts), chars, linked), strict=True):
                    out[k].append(v)
        yield pa.RecordBatch.from_arrays([
            pa.array(out["salt"], pa.int32()), pa.array(out["host"], pa.string()), pa.array(out["tree"], pa.string()),
            pa.array(out["part"], pa.int32()), pa.array(out["body"], pa.int64()), pa.array(out["path"], pa.int64()), pa.array(out["texts"], pa.list_(pa.int64())),
            pa.array(out["chars"], pa.int64()), pa.array(out["linked"], pa.int64()),
        ], list(out))


def _aligned(batches):
    for batch in batches:
        hosts, trees, ours, slots = [], [], [], []
        for host, tree, pivot in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            a, b = read_tree(tree), read_tree(pivot)
            slot = {a[1][x]: b[1][y] for x, y in simple_tree_matching(a, b)[1]}
            for path in a[1]:
                hosts.append(host), trees.append(tree), ours.append(path), slots.append(slot.get(path, path))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(trees, pa.string()), pa.array(ours, pa.int64()), pa.array(slots, pa.int64())], ["host", "tree", "path", "slot"])


def content(found, tree, known) -> list[str]:
    """The content among a page's blocks, by its host's `known` wrapper (fields template0, template1, closed0, closed1)."""
    told = [x for x in found if x[1] >= 0]
    closed = [set(known.get(f"closed{k}") or ()) for k in (0, 1)]
    constant = [set(known.get(f"template{k}") or ()) for k in (0, 1)]
    chosen = [x for x in told if tree[x[0]][2] not in closed[x[1]] and text_hash(x[2]) not in constant[x[1]]]
    whole = [x for x in told if x[1] == 1] or [x for x in told if text_hash(x[2]) not in constant[0]]
    if sum(len(x[2]) for x in chosen) < COPY_REST * sum(len(x[2]) for x in whole):
        chosen = whole
    return [x[2] for x in chosen]


def _extracted(batches):
    for batch in batches:
        texts = []
        for page, known in zip(batch.column(2), batch.column(3), strict=True):
            tree, found = blocks(parse(page.as_py() or ""))
            texts.append("\n\n".join(content(found, tree, known.as_py() or {})))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, template0, template1, closed0, closed1), each an array: of undeclared blocks and of those below an article, the hashes of the
    texts that a slot repeats over the host's distinct pages that have it, and the paths to slots that are no content: menus,
    and those whose texts vary too little. A page has few of either, and a text or path of the wrapper is on a fair share of the host's pages."""
    first = written(pages.select(F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int").alias("salt"), host_of(F.col("url")).alias("host"), "html").mapInArrow(_folded, FIRST), "html-trees")
    distinct = written(first.groupBy("host", "tree", "part", "body", "path").agg(*[F.first(c).alias(c) for c in ("texts", "chars", "linked")]), "html-distinct")
    trees = distinct.where("part = 0").select("host", "tree", "body").distinct().groupBy("host", "tree").agg(F.count(F.lit(1)).alias("n"))
    trees = written(trees, "html-shapes")
    pivots = written(trees.groupBy("host").agg(F.max(F.struct("n", "tree")).getField("tree").alias("pivot"), F.count(F.lit(1)).alias("size")), "html-pivots")
    aligned = join_groups(trees.select("host", "tree"), pivots, "host", "size").select("host", "tree", "pivot").mapInArrow(_aligned, "host string, tree string, path long, slot long")
    place = F.struct("host", "tree", "path").alias("place")
    sizes = distinct.groupBy(place).agg(F.count(F.lit(1)).alias("size"))
    slots = written(aligned.select(place, "slot").join(sizes, "place"), "html-slots")
    each = join_groups(distinct.select(place, "part", "body", "texts", "chars", "linked"), slots, "place", "size").select("place.*", "part", "slot", "body", "texts", "chars", "linked")
    each = written(each, "html-places")
    by = ["host", "part", "slot"]
    least = F.when(F.col("part") == 1, MIN_PAGES[1]).otherwise(MIN_PAGES[0])
    pages_with = each.select(*by, "body").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= least)
    pages_with = written(pages_with, "html-sizes")
    texts = each.select(*by, "body", F.explode("texts").alias("text")).distinct()
    texts = written(texts, "html-texts")
    anywhere = texts.where("part = 0").select("text", "body").distinct().groupBy("text").agg(F.count(F.lit(1)).alias("pages of all hosts")).where(F.col("pages of all hosts") >= COMMON_PAGES)
    counted = written(texts.groupBy(*by, "text").agg(F.count(F.lit(1)).alias("n")).join(pages_with, by), "html-counted")
    shared = written(counted.groupBy("text").agg(F.count(F.lit(1)).alias("size")).join(anywhere, "text"), "html-shared")
    counted = join_groups(counted, shared, "text", "size", "left")
    repeated = (F.col("n") >= CONSTANT_PAGES) & (F.col("n") >= F.when(F.col("part") == 1, CONSTANT_SHARE[1]).otherwise(CONSTANT_SHARE[0]) * F.col("pages"))
    new = F.when(F.col("part") == 1, ~repeated).otherwise(~repeated & F.col("pages of all hosts").isNull())
    counted = written(counted.withColumns({"constant": repeated, "new": new}), "html-counts")
    need = F.when(F.col("part") == 1, NEED[1]).otherwise(NEED[0])
    news = F.count_if("new") / F.greatest(F.lit(1), F.sum(F.when((F.col("part") == 1) | ~F.col("constant"), F.col("n"))))
    closed = counted.groupBy(*by).agg(news.alias("news")).where(F.col("news") < need).select(*by)
    menus = each.where("part = 0").groupBy(*by).agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked")).where((F.col("chars") > 0) & (F.col("linked") >= MENU_SHARE * F.col("chars"))).select(*by)
    paths = each.select(*by, "path").distinct().join(closed.unionByName(menus).distinct(), by).select("host", "part", "path").distinct()

    def lists(rows: DataFrame, column: str, name: str) -> DataFrame:
        return rows.groupBy("host").agg(*[F.collect_set(F.when(F.col("part") == k, F.col(column))).alias(f"{name}{k}") for k in (0, 1)])

    return lists(counted.where("constant"), "text", "template").join(lists(paths, "path", "closed"), "host", "full")


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of `pages` (page_id, url, html; other columns are ignored): page_id, url, text.

    text joins the content blocks in page order by two \\n; white space inside a block is one space. A block is content if its
    host's wrapper finds its slot varied enough for what pages declare of it, and no menu; hosts of fewer than MIN_PAGES distinct
    pages have only the declarations and menus. Of trees that are equally frequent on a host the one written last in order is the
    one to align with. A null html is empty and has the
    empty text; pages without a host (a null url is one) share a nameless one. Long and deeply nested pages are taken whole.
    Repeated rows count once for a wrapper and each have their text. An empty table gives an empty result.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    known = written(wrappers(rows), "html-wrappers")
    known = known.select(F.col("host").alias("of"), F.struct(*[c for c in known.columns if c != "host"]).alias("known"))
    sides = rows.withColumns({"host": host_of(F.col("url")), "salt": F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))})
    spread = known.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("lane", F.col("lane").cast("long"))
    joined = sides.join(spread, (F.col("host") == F.col("of")) & (F.col("salt") == F.col("lane")), "left")
    return joined.select("page_id", "url", "html", "known").mapInArrow(_extracted, "page_id long, url string, text string")
