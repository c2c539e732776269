"""Main text of pages by wrapper induction.

Pages of one host are parsed to trees of block elements (inline markup folds into its block's text), less the elements that
by tag, role, class or id are navigation, headers, footers, asides, forms, notices, adverts, comments and the like. Within
groups of at most about GROUP different pages of a host, which a hash of the page deals evenly, trees are aligned with a growing
wrapper by simple tree matching: of two nodes with equal label, the heaviest order-preserving matching of their children, where
a pair weighs 1, 1 more for equal text, and what its own children match. Wrapper nodes whose text is the same on all of at least
LEAST_PAGES pages are template; the others are slots, and a page's text is its slots. Pages of the same blocks, and marked
articles that share half of their blocks with one before, add nothing to that count, so that copied articles are no template.

Where a page marks its article (article, main, role=main, itemprop=articleBody), its text is the slots in that marking; there a
block is template only if it is on LEAST_ARTICLES and on half of the group's pages too, and an article all of which is template stays.

Blocks have character references decoded, white space turned into one space and the ends trimmed; they are joined by one
space in page order. Null and empty html give an empty text. A page alone on its host has no template; its slots are all its
blocks. Null urls form one host of their own. Repeated rows are pages of their own, and copies count once in deciding what is
constant; of pages with more than COPIES copies on a host one is read and its text joined to the others. Very long pages are
parsed in one pass, and matched exactly at any width in memory linear in the page. Empty tables give an empty result. No page is
cut or dropped; columns other than the keys, url and html are not read.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import materialize, small_batches, table

#: Hosts of more different pages than GROUP are dealt evenly into groups of about EVEN; pages of more copies than COPIES are read once.
GROUP, EVEN, COPIES = 64, 48, 64
#: So many pages have a template's block at least; in a marked article so many, and half of the group's.
LEAST_PAGES, LEAST_ARTICLES = 3, 8
#: So many weights of pairs are kept for the levels below; others are worked out again.
KNOWN = 1_000_000
#: Cells of a level's table that are kept whole.
SMALL = 4096

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
RAW = frozenset("script style textarea title noscript template iframe svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NOT_TEXT = frozenset("head nav header footer aside form button select option datalist dialog menu map object audio video canvas figure-controls".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
MARKS = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads advert adverts advertisement advertisements sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay"
    " comment comments disqus respond reply replies breadcrumb breadcrumbs share sharing social related recommended newsletter subscribe signup login search pagination pager toolbar widget copyright legal hidden".split()
)
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}


class Node:
    __slots__ = ("tag", "label", "kids", "drop", "root", "text")

    def __init__(self, tag: str, label: str, drop: bool, root: bool):
        self.tag, self.label, self.drop, self.root = tag, label, drop, root
        self.kids: list = []
        self.text = ""


def node_of(tag: str, attributes: str) -> Node:
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return Node(tag, tag, tag in NOT_TEXT, tag in ("article", "main"))
    got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    names = f"{got.get('class', '')} {got.get('id', '')}".lower()
    role = got.get("role", "").lower()
    words = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{got.get('class', '')} {got.get('id', '')}").lower()))
    root = tag in ("article", "main") or role == "main" or "articlebody" in got.get("itemprop", "").lower()
    hidden = bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes)) or "display:none" in got.get("style", "").replace(" ", "") or got.get("aria-hidden") == "true"
    drop = tag in NOT_TEXT or role in ROLES or hidden or (tag not in ("html", "body") and not root and bool(words & MARKS))
    return Node(tag, f"{tag}.{names.strip()}" if names.strip() else tag, drop, root)


class Open:
    """The elements open at a place: the stack, and by tag, and for all that aren't inline, their places in it."""

    def __init__(self, top: Node):
        self.stack, self.at, self.solid = [top], {}, []

    def push(self, node: Node) -> None:
        self.stack[-1].kids.append(node)
        self.at.setdefault(node.tag, []).append(len(self.stack))
        if node.tag not in INLINE:
            self.solid.append(len(self.stack))
        self.stack.append(node)

    def last(self, tags) -> int:
        """The place of the innermost of the tags, 0 if none is open."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close(self, place: int) -> None:
        """Close all from a place on; 0: nothing."""
        while place and len(self.stack) > place:
            tag = self.stack.pop().tag
            self.at[tag].pop()
            if tag not in INLINE:
                self.solid.pop()


def raw_end(low: str, tag: str, at: int) -> tuple[int, int]:
    """Where the closing tag of an element without markup begins and ends."""
    while (at := low.find(f"</{tag}", at)) >= 0:
        if not low[at + len(tag) + 2 : at + len(tag) + 3].isalnum():
            end = low.find(">", at)
            return at, end + 1 if end >= 0 else len(low)
        at += 2
    return len(low), len(low)


def parse(html: str | None) -> Node:
    """The tree of block elements without those to drop; kids are nodes and strings of raw text, in order.

    One pass: each tag ends at its first > outside quotes. Where a quotation stays open to the page's end, that tag and
    those after it end at their first >.
    """
    top = Node("", "", False, False)
    if not html:
        return top
    low = html.lower()
    low = low if len(low) == len(html) else html.translate(_LOW)
    open_, at, loose = Open(top), 0, False
    text = lambda a, b: open_.stack[-1].kids.append(html[a:b]) if b > a else None
    while (start := html.find("<", at)) >= 0:
        m = NAME.match(html, start)
        if not m and html[start + 1 : start + 2] not in ("!", "?"):
            text(at, start + 1)
            at = start + 1
            continue
        text(at, start)
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(html)
            continue
        end = html.find(">", start)
        if end < 0:  # no tag ends from here on
            at = start
            break
        if not m:
            at = end + 1
            continue
        quoted = None if loose else REST.match(html, m.end())
        loose = loose or not quoted
        end = quoted.end() - 1 if quoted else end
        at = end + 1
        tag, closing, attributes = m[2].lower(), m[1], html[m.end() : end]
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                at = raw_end(low, tag, at)[1]
        elif tag in ("br", "hr"):
            open_.stack[-1].kids.append(" ")
        elif tag in VOID:
            continue
        elif tag in INLINE:
            if closing:
                open_.close(len(open_.stack) - 1 if open_.stack[-1].tag == tag else 0)
            elif attributes and (n := node_of(tag, attributes)).drop:
                open_.push(n)
        elif closing:
            open_.close(open_.last([tag]))
        else:
            if open_.solid and open_.stack[open_.solid[-1]].tag == "p":
                open_.close(open_.solid[-1])
            if tag in CLOSES:
                ends, walls = CLOSES[tag]
                place = open_.last(ends.split())
                open_.close(place if place > open_.last(walls) else 0)
            open_.push(node_of(tag, attributes))
    text(at, len(html))
    settle(top)
    return top


_LOW = {c: c + 32 for c in range(65, 91)}


def settle(top: Node) -> None:
    """Runs of raw text become leaf nodes with clean text; runs without text go, and so do nodes to drop. No recursion: depth is the page's."""
    todo = [top]
    while todo:
        node = todo.pop()
        kids, run = [], []
        for kid in [*node.kids, None]:
            if isinstance(kid, str):
                run.append(kid)
                continue
            if run:
                text = " ".join(unescape("".join(run)).split())
                run = []
                if text:
                    leaf = Node("#", "#", False, False)
                    leaf.text = text
                    kids.append(leaf)
            if kid is not None and not kid.drop:
                kids.append(kid)
                todo.append(kid)
        node.kids = kids


class Slot:
    """A node of the wrapper: the text of its leaf, whether it varies, and on how many pages it is."""

    __slots__ = ("label", "kids", "text", "varies", "pages")

    def __init__(self, label: str, text: str):
        self.label, self.text, self.varies, self.pages = label, text, False, 0
        self.kids: list[Slot] = []


def pair(a, b):
    """(weight of matching two nodes of equal label: 1, 1 more for equal text, and the best sum of their children's; the children's pairs). Asks for weights by yielding pairs."""
    total, pairs = yield from best_of(a.kids, b.kids)
    return 1 + (a.text == b.text) + total, pairs


class Level:
    """Children as numbers: labels, texts, whether they have children, and the text of an only child that is a leaf (-1: none such)."""

    def __init__(self, nodes: list, codes: dict):
        code = lambda x: codes.setdefault(x, len(codes))
        self.label = np.array([code(n.label) for n in nodes])
        self.text = np.array([code(n.text) for n in nodes])
        self.kids = np.array([bool(n.kids) for n in nodes])
        self.leaf = np.array([code(n.kids[0].text) if len(n.kids) == 1 and n.kids[0].label == "#" else -1 for n in nodes])


def best_of(a: list, b: list):
    """(weight, pairs) of the heaviest order-preserving matching of equal labels; asks for weights by yielding pairs.

    Exact at any width in memory of the width times the root of the height: of the table's rows one in so many is kept, and
    those between are worked out again on the way back.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return 0, []
    if n * m <= SMALL:
        return (yield from best_of_few(a, b))
    codes: dict = {}
    x, y = Level(a, codes), Level(b, codes)

    def row(i: int):
        same = x.label[i] == y.label
        w = np.where(same, 1 + (x.text[i] == y.text), 0)
        if x.leaf[i] >= 0:
            w += (same & (y.leaf >= 0)) * (1 + (x.leaf[i] == y.leaf))
        if x.kids[i]:
            for j in np.flatnonzero(same & y.kids & ((y.leaf < 0) | (x.leaf[i] < 0))).tolist():
                w[j] = yield a[i], b[j]
        return w

    def above(below: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.append(np.maximum.accumulate(np.maximum(below[:m], below[1:] + w)[::-1])[::-1], 0)

    step = int(n**0.5) + 1
    kept = {n: np.zeros(m + 1, np.int64)}
    best = kept[n]
    for i in range(n - 1, -1, -1):
        best = above(best, (yield from row(i)))
        if i % step == 0:
            kept[i] = best
    pairs, j, total = [], 0, int(best[0])
    for block in range(0, n, step):
        end = min(block + step, n)
        rows, weights = {end: kept[end]}, {}
        for i in range(end - 1, block - 1, -1):
            weights[i] = yield from row(i)
            rows[i] = above(rows[i + 1], weights[i])
        i = block
        while i < end and j < m:
            if weights[i][j] and rows[i][j] == rows[i + 1][j + 1] + weights[i][j]:
                pairs.append((i, j))
                i, j = i + 1, j + 1
            elif rows[i + 1][j] >= rows[i][j + 1]:
                i += 1
            else:
                j += 1
    return total, pairs


def best_of_few(a: list, b: list):
    """The same with the whole table, for levels whose table is small."""
    n, m = len(a), len(b)
    weights, rows = [[0] * m for _ in a], [[0] * (m + 1)] * (n + 1)
    for i in range(n - 1, -1, -1):
        x, w, below, row = a[i], weights[i], rows[i + 1], [0] * (m + 1)
        leaf = x.kids[0].text if len(x.kids) == 1 and x.kids[0].label == "#" else None
        for j in range(m - 1, -1, -1):
            y = b[j]
            best = row[j + 1] if row[j + 1] >= below[j] else below[j]
            if x.label == y.label:
                if not x.kids or not y.kids:
                    w[j] = 1 + (x.text == y.text)
                elif leaf is not None and len(y.kids) == 1 and y.kids[0].label == "#":
                    w[j] = 2 + (x.text == y.text) + (leaf == y.kids[0].text)
                else:
                    w[j] = yield x, y
                if below[j + 1] + w[j] > best:
                    best = below[j + 1] + w[j]
            row[j] = best
        rows[i] = row
    pairs, i, j = [], 0, 0
    while i < n and j < m:
        if weights[i][j] and rows[i][j] == rows[i + 1][j + 1] + weights[i][j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif rows[i + 1][j] >= rows[i][j + 1]:
            i += 1
        else:
            j += 1
    return rows[0][0], pairs


def matching(a, b, known: dict) -> list[tuple[int, int]]:
    """The heaviest matching of the children of two nodes, each pair weighed by its own subtrees'. No recursion; known: weights and pairs found so far, by the nodes."""
    if (id(a), id(b)) in known:
        return known[id(a), id(b)][1]
    stack, give = [((id(a), id(b)), pair(a, b))], None
    while True:
        key, work = stack[-1]
        try:
            x, y = work.send(give)
        except StopIteration as done:
            stack.pop()
            if not stack:
                return done.value[1]
            give = int(done.value[0])
            if len(known) < KNOWN:
                known[key] = done.value
            continue
        found = known.get((id(x), id(y)))
        give = found and int(found[0])
        if give is None:
            stack.append(((id(x), id(y)), pair(x, y)))


def align(wrapper: Slot, page: Node, places: dict[int, Slot], counts: bool) -> None:
    """Match the page's tree to the wrapper, which takes in what it lacks. counts: the page is not a near copy of one before."""
    todo, known = [(wrapper, page)], {}
    while todo:
        slot, node = todo.pop()
        places[id(node)] = slot
        slot.pages += counts
        if slot.text != node.text:
            slot.varies = True
        found = {j: i for i, j in matching(slot, node, known)}
        grown, used = [], 0
        for j, kid in enumerate(node.kids):
            if j in found:
                grown += slot.kids[used : found[j] + 1]
                used = found[j] + 1
                todo.append((slot.kids[found[j]], kid))
            else:
                fresh = Slot(kid.label, kid.text)
                grown.append(fresh)
                todo.append((fresh, kid))
        slot.kids = grown + slot.kids[used:]


def leaves(top: Node) -> list[tuple[Node, bool]]:
    """(leaf, whether in a marked article) of all leaves, in order."""
    todo, out = [(top, False)], []
    while todo:
        node, inside = todo.pop()
        inside = inside or node.root
        if node.tag == "#":
            out.append((node, inside))
        todo += [(kid, inside) for kid in reversed(node.kids)]
    return out


def originals(pages: list[tuple[list[str], bool]]) -> list[bool]:
    """Of pages, as texts of blocks and whether an article is marked: which count. Articles that share less than half of their different blocks with each one before that counts; other pages with blocks of their own."""
    holders: dict[str, list[int]] = {}
    seen: set[tuple] = set()
    out = []
    for n, (texts, marked) in enumerate(pages):
        own, shared = set(texts), {}
        for t in own if marked else ():
            for k in holders.get(t, ()):
                shared[k] = shared.get(k, 0) + 1
        out.append(tuple(texts) not in seen and 2 * max(shared.values(), default=0) < max(1, len(own)))
        seen.add(tuple(texts))
        if out[-1] and marked:
            for t in own:
                holders.setdefault(t, []).append(n)
    return out


def texts_of(pages: list[str | None]) -> list[str]:
    """The main texts of different pages of one host."""
    trees = [parse(p) for p in pages]
    found = [leaves(t) for t in trees]
    found = [[x for x in got if x[1]] or got for got in found]
    counts = originals([([n.text for n, _ in got], any(inside for _, inside in got)) for got in found])
    wrapper, places = Slot("", ""), [{} for _ in trees]
    for tree, place, new in zip(trees, places, counts, strict=True):
        align(wrapper, tree, place, new)
    out = []
    for got, place in zip(found, places, strict=True):

        def fixed(leaf: Node, inside: bool) -> bool:
            slot = place[id(leaf)]  # noqa: B023
            return not slot.varies and slot.pages >= LEAST_PAGES and (not inside or slot.pages >= max(LEAST_ARTICLES, sum(counts) / 2))

        slots = [n.text for n, inside in got if not fixed(n, inside)]
        out.append(" ".join(slots or [n.text for n, inside in got if inside]))
    return out


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def extract(pages: DataFrame, keys: list[str], url: str = "url", html: str = "html") -> DataFrame:
    """keys of pages, with text and n_chars."""
    small_batches(pages.sparkSession)
    names = [f"k_{i}" for i in range(len(keys))]
    page = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], host_of(F.col(url)).alias("host"), F.md5(page).alias("m"), page.alias("html"))
    rows = rows.withColumn("order", F.xxhash64(*names))
    # Counted without the html: each different page of a host, and of a page of many copies the row that stands for all.
    each = materialize(rows.groupBy("host", "m").agg(F.count("*").alias("copies"), F.min("order").alias("first")))
    # Both are written, so that Spark knows their sizes before it plans the joins, and moves the html once where they are small.
    many = materialize(each.where(F.col("copies") > COPIES).select("host", "m", "first"))
    parts = materialize(each.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("host", F.ceil(F.col("n") / EVEN).alias("parts")))
    dealt = rows.join(many, ["host", "m"], "left").where(F.col("first").isNull() | (F.col("first") == F.col("order")))
    dealt = dealt.join(parts, "host", "left").withColumn("part", F.pmod(F.xxhash64("m"), F.coalesce("parts", F.lit(1))))
    dealt = dealt.select("host", "part", "m", "first", *names, "html").repartition("host", "part").sortWithinPartitions("host", "part", "m", *names)
    kept = ["host", "m", "first", *names]

    def induce(batches):
        held: list[tuple] = []
        of = None

        def flush():
            different = dict.fromkeys(h[-1] for h in held)
            texts = dict(zip(different, texts_of(list(different)), strict=True))
            arrays = [pa.array([h[i] for h in held], kinds[i]) for i in range(len(kept))]
            got = [texts[h[-1]] for h in held]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], [*kept, "text", "n_chars"])

        for batch in batches:
            kinds = [batch.schema.field(n).type for n in kept]
            columns = [batch.column(n).to_pylist() for n in (*kept, "html")]
            for key, row in zip(zip(columns[0], batch.column("part").to_pylist(), strict=True), zip(*columns, strict=True), strict=True):
                if held and key != of:
                    yield flush()
                    held = []
                of = key
                held.append(row)
        if held:
            yield flush()

    kinds = dict(dealt.dtypes)
    form = ", ".join(f"{n} {kinds[n]}" for n in kept) + ", text string, n_chars long"
    texts = dealt.mapInArrow(induce, form)
    if many.isEmpty():
        return texts.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], "text", "n_chars")
    texts = materialize(texts)
    alone = texts.where(F.col("first").isNotNull()).select("host", "m", "text", "n_chars").dropDuplicates(["host", "m"])
    copies = rows.drop("html").join(many, ["host", "m"]).where(F.col("first") != F.col("order")).join(alone, ["host", "m"])
    out = texts.select(*names, "text", "n_chars").union(copies.select(*names, "text", "n_chars"))
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], "text", "n_chars")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
