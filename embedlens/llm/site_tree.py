"""Main text of web pages by site style trees.

1. Every page is read into element nodes under ``body``; a node's name is its path of tags and first class names. The pages
   of one host are merged into its style tree: for each node, on how many pages it is (m), on how many each
   presentation style (sequence of child tags) and each content (text of a block) occurs.
2. Importance. The presentation of a node matters as the entropy of its styles, to base m: a node that always looks the same
   carries little. Content matters as 1 minus the mean of log_m k over its different texts, k being the pages with
   that text: what repeats across a site is not what a page is about. A node's composite importance is
   (1 - g^l) presentation + g^l (mean of its own content's and its children's composite importance), l styles, g = 0.9.
3. Verdict on each page's branches. Where the markup itself says something it decides: what is inside an article stays; menus, footers, forms,
   adverts, comments and the like go. Where it says nothing, score = (1 - w) prior + w importance, the importance being the highest
   of the branch and all below it (a branch is noise only if all of it is), and w = m / (m + ``HALF_PAGES``) passing every bound
   below 1 as the pages that bear witness grow; branches below ``KEEP`` are removed, and blocks of what is left are the text.

Statistics are sums by (host, node, value), added up inside tasks first, so a host with a third of all pages is many small
keys; a host's nodes, not its pages, meet in one task. The trees are joined back to the pages by host: sent to all tasks if they are small
together, else by a shuffle.

Null html or url counts as empty; pages without a host share one tree. A page without any element is text. Repeated pages
are extracted each and count each. Text outside elements, unclosed and stray tags, unclosed comments and character
references are read as browsers do, as far as text goes. A page is read in one forward pass whatever its quotes and tags; a node whose path of names
passes ``LONG_PATH`` characters goes by a hash of it and stands under the root, so deep nesting takes memory in proportion. Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedlens.session import cut

GAMMA, HALF_PAGES, KEEP = 0.9, 8, 0.5
TREE_BYTES = 16_000_000
LONG_PATH = 1000

# fixed values: tag names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math title object select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_P = frozenset({"p"})
#: end tags that close whatever is open inside them
_WIDE = frozenset("html body article main div section form nav footer header aside".split())
SCOPES = frozenset("article aside body div footer form header main nav ol section table ul dl".split())

# fixed values: what tags, roles and class names say about a branch
NOISE_TAGS = frozenset("nav footer aside form button dialog menu head".split())
NOISE_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored sponsors promo promotion nav navbar navigation
    menu breadcrumb breadcrumbs masthead footer sidebar widget cookie cookies consent gdpr notice notices notification alert popup modal
    overlay newsletter subscribe subscription signup login search share sharing social comment comments commentlist reply replies
    respond disqus related recommended recommendations pagination pager toolbar skip copyright legal disclaimer complementary contentinfo""".split()
)
TOP_NAMES = frozenset("header top topbar".split())
MAIN_NAMES = frozenset("article main post entry story".split())
#: noise that may wrap a whole page, so that an article inside it still counts
WRAPPERS = frozenset("form header sidebar banner notice modal menu widget".split())

_COMMENT = re.compile(r"<!--.*?(?:--!?>|\Z)", re.S)
_OTHER = re.compile(r"<[!?][^>]*>?")
_OPEN = re.compile(r"<(/?)[a-zA-Z]")
_STOP = re.compile(r"[\s/>]")
_MARK = re.compile(r"[>\"']")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)>")
_SAYS = re.compile(r"class|id|role|hidden|style", re.I)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
_NAME = re.compile(r"[a-z]+")


@dataclass
class Node:
    tag: str
    path: str
    prior: float | None  # None: nothing said
    in_main: bool
    noise: str = ""
    kids: list[str] = field(default_factory=list)


@dataclass
class Page:
    styles: list[tuple[str, str]]  # node, child tags
    blocks: list[tuple[str, float | None, str]]  # node, prior, text
    has_main: bool


class Tags:
    """The tags of a page in one forward pass: what is known about places further on is kept, so broken quotes don't cause a place to be read again and again."""

    def __init__(self, text: str):
        self.text = text
        self.seen = {_MARK: (0, -1), _STOP: (0, -1)}  # the next mark after any place from the first to the second is at the second
        self.dead: set[int] = set()  # places outside quotes from which no tag ends
        self.closed: dict[int, int] = {}  # place after the quote that closes one at a place, 0 if there is none
        self.last = {q: text.rfind(q) for q in "\"'"}
        self.missing: set[str] = set()  # elements without an end tag further on

    def _next(self, kind: re.Pattern, at: int) -> int:
        low, high = self.seen[kind]
        if not low <= at <= high:
            found = kind.search(self.text, at)
            high = found.start() if found else len(self.text)
            self.seen[kind] = (at, high)
        return high

    def end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag whose attributes begin at ``at``, quoted ones passed over; -1 if there is none."""
        text, been = self.text, []
        while at not in self.dead:
            been.append(at)
            mark = self._next(_MARK, at)
            if mark < len(text) and text[mark] == ">":
                return mark
            if mark not in self.closed:  # the end of the text has no quote to close
                self.closed[mark] = text.find(text[mark], mark + 1) + 1 if mark < len(text) and mark < self.last[text[mark]] else 0
            at = self.closed[mark]
            if not at:
                break
        self.dead.update(been)
        return -1

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(place, place after it, ``/`` of an end tag, name, attributes) of the next tag, or comment, which has no name."""
        text = self.text
        begin = text.find("<", at)
        while begin >= 0:
            found = _PLAIN.match(text, begin)
            if found is not None:
                return begin, found.end(), found[1], found[2], ""
            other = _COMMENT.match(text, begin) or _OTHER.match(text, begin)
            if other is not None:
                return begin, other.end(), "", "", ""
            found = _OPEN.match(text, begin)
            if found is not None:
                stop = self._next(_STOP, found.end())
                end = self.end(stop)
                if end >= 0:
                    return begin, end + 1, found[1], text[found.end() - 1 : stop], text[stop:end]
            begin = text.find("<", begin + 1)
        return None

    def raw_end(self, name: str, at: int) -> int:
        """Place after the end tag of an element that holds no markup; -1 if there is none."""
        if "</" + name in self.missing:
            return -1
        tail = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(self.text, at)
        if tail is None:
            self.missing.add("</" + name)
        return tail.end() if tail else -1


def _names(attrs: str) -> tuple[str, frozenset[str], bool]:
    """First class name, all names of class, id and role, and whether the element is hidden."""
    if not attrs or not _SAYS.search(attrs):
        return "", frozenset(), False
    first, names, hidden = "", set(), False
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id", "role"):
            found = _NAME.findall(entities.unescape(value))
            names.update(found)
            if key == "class" and found:
                first = found[0]
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    return first, frozenset(names), hidden


def _opened(above: Node, tag: str, attrs: str) -> Node:
    first, names, hidden = _names(attrs)
    path = f"{above.path}/{tag}.{first}" if first else f"{above.path}/{tag}"
    if len(path) > LONG_PATH:  # the branch stands under the root from here on
        path = "/#" + xxhash.xxh3_128_hexdigest(path)
    root = tag in ("html", "body")
    noise = ""
    if not root:
        hit = sorted(names & NOISE_NAMES)
        if hidden:
            noise = "hidden"
        elif tag in NOISE_TAGS:
            noise = tag
        elif hit and not (tag in ("article", "main") and not names & {"comment", "comments", "ad", "ads", "advert", "sponsored", "related"}):
            noise = next((h for h in hit if h not in WRAPPERS), hit[0])
        elif (tag == "header" or names & TOP_NAMES) and not above.in_main and not names & MAIN_NAMES:
            noise = "header"
    main = not noise and (tag in ("article", "main") or "main" in names or bool(names & MAIN_NAMES and tag in ("div", "section")))
    if above.noise and not (main and above.noise in WRAPPERS):
        return Node(tag, path, 0.0, above.in_main, above.noise)
    if noise:
        return Node(tag, path, 0.0, above.in_main, noise)
    inside = main or above.in_main
    return Node(tag, path, 1.0 if inside else None, inside)


def read_page(text: str | None) -> Page:
    """Nodes, their styles, and the text blocks of a page, in page order."""
    text = text or ""
    root = Node("html", "", None, False)
    stack, styles, blocks, parts = [root], [], [], []
    has_main = False
    opened: Counter = Counter({root.tag: 1})

    def flush() -> None:
        if parts:
            block = "".join(parts)
            parts.clear()
            block = " ".join((entities.unescape(block) if "&" in block else block).split())
            if block:
                blocks.append((stack[-1].path, stack[-1].prior, block))

    def close(depth: int) -> None:
        flush()
        while len(stack) > depth:
            node = stack.pop()
            opened[node.tag] -= 1
            styles.append((node.path, ",".join(node.kids)))

    def inside(tags, stop=SCOPES) -> int:
        """Depth of the nearest open element of ``tags``, not beyond one of ``stop``; 0 if there is none."""
        if not any(opened[tag] for tag in tags):
            return 0
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in tags:
                return depth
            if stack[depth].tag in stop:
                return 0
        return 0

    at, n, tags = 0, len(text), Tags(text)
    known: dict[tuple, tuple] = {}
    while at < n:
        found = tags.next(at)
        if found is None:
            parts.append(text[at:])
            break
        begin, after, ends, name, attrs = found
        if begin > at:
            parts.append(text[at:begin])
        at = after
        if not name:
            continue
        name = name.lower()
        if ends:
            if name == "br":
                parts.append(" ")
            elif name == "p" and not inside(_P):
                flush()
            elif name in INLINE and stack[-1].tag not in INLINE:
                pass
            else:
                stop = () if name in _WIDE else SCOPES
                depth = inside((name,), stop)
                if depth:
                    close(depth)
                elif name not in INLINE:
                    flush()
            continue
        if name in RAW:
            tail = tags.raw_end(name, at)
            at = tail if tail >= 0 else (n if name in ("script", "style", "textarea", "title") else at)
            parts.append(" ") if name in ("svg", "math", "object") else flush()
            continue
        if name in VOID:
            if name == "hr":
                flush()
            else:
                parts.append(" ") if name in ("br", "img") else None
            continue
        if name == "html":
            continue
        if name in ("body", "head"):
            close(1)
        if name in CLOSES_P:
            depth = inside(_P)
            if depth:
                close(depth)
        elif name in SAME_CLOSES:
            depth = inside(SAME_CLOSES[name], SCOPES)
            while depth:
                close(depth)
                depth = inside(SAME_CLOSES[name], SCOPES)
        above = stack[-1]
        if name in INLINE and (not attrs or not _SAYS.search(attrs)):
            continue
        key = (above.path, above.noise, above.in_main, name, attrs)
        if key in known:
            node = Node(*known[key])
        else:
            node = _opened(above, name, attrs)
            known[key] = (node.tag, node.path, node.prior, node.in_main, node.noise)
        if name in INLINE and node.noise == above.noise:
            continue
        flush()
        if not above.kids or above.kids[-1] != name:
            above.kids.append(name)
        has_main |= node.prior == 1.0
        if not attrs.rstrip().endswith("/"):
            stack.append(node)
            opened[name] += 1
    close(0 if not stack else 1)
    styles.append((root.path, ",".join(root.kids)))
    return Page(styles, blocks, has_main)


def verdict(said: float | None, has_main: bool, importance: float | None, pages: int) -> bool:
    """Keep a branch? What says nothing is likely content on a page without an article, and likely not beside one."""
    if said is not None:
        return said >= KEEP
    w = 0.0 if importance is None else pages / (pages + HALF_PAGES)
    return (1 - w) * (0.2 if has_main else 0.7) + w * (importance or 0.0) >= KEEP


def extract(text: str | None, tree: dict[str, tuple[float, int]]) -> str:
    """The main text of a page, given (highest importance of the branch, pages) of its host's nodes."""
    page = read_page(text)
    out = []
    for path, said, block in page.blocks:
        branch, keep = path, True
        while keep and branch:
            keep = verdict(said, page.has_main, *tree.get(branch, (None, 0)))
            branch = branch.rpartition("/")[0] if said is None else ""
        if keep:
            out.append(block)
    return "\n".join(out)


def host_of(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit("")))


def node_counts(pages: DataFrame) -> DataFrame:
    """``host, node, kind, value, pages``: on how many pages a node has a style, a text, or is."""

    def work(batches):
        for batch in batches:
            seen: Counter = Counter()
            for host, text in zip(batch.column(0), batch.column(1)):
                page, host = read_page(text.as_py()), host.as_py()
                own = {(host, path, 0, 0) for path, _ in page.styles}
                own |= {(host, path, 1, xxhash.xxh3_64_intdigest(kids) >> 1) for path, kids in page.styles}
                own |= {(host, path, 2, xxhash.xxh3_64_intdigest(block) >> 1) for path, _, block in page.blocks}
                seen.update(own)
            rows = list(zip(*seen)) or [(), (), (), ()]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(rows, kinds)), pa.array(list(seen.values()), pa.int64())], ["host", "node", "kind", "value", "pages"])

    counted = pages.select(host_of().alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(work, "host string, node string, kind int, value long, pages long")
    return counted.groupBy("host", "node", "kind", "value").agg(F.sum("pages").alias("pages"))


def composite(nodes: dict[str, tuple[int, float | None, int, float | None]]) -> dict[str, tuple[float, int]]:
    """(importance, pages) by node, from (pages, presentation, styles, content) by node; leaves first."""
    kids = defaultdict(list)
    for path in nodes:
        if path:
            kids[path.rpartition("/")[0]].append(path)
    out: dict[str, tuple[float, int]] = {}
    for path in sorted(nodes, key=lambda p: -p.count("/")):
        m, presentation, styles, content = nodes[path]
        below = [out[k] for k in kids[path]] + ([(content, m)] if content is not None else [])
        inner = sum(i * p for i, p in below) / sum(p for _, p in below) if below else 0.0
        g = GAMMA ** max(styles, 1)
        out[path] = ((1 - g) * (presentation or 0.0) + g * inner, m)
    return out


def strongest(tree: dict[str, tuple[float, int]]) -> dict[str, tuple[float, int]]:
    """The highest importance of each node and all below it, with the node's pages."""
    out = dict(tree)
    for path in sorted(tree, key=lambda p: -p.count("/")):
        if path:
            above = path.rpartition("/")[0]
            out[above] = (max(out[above][0], out[path][0]), out[above][1])
    return out


def style_trees(pages: DataFrame) -> DataFrame:
    """``host, nodes``: a line of the branch's highest importance, pages and node for each node on more than one page."""
    k, ln = F.col("pages").cast("double"), F.log(F.col("pages").cast("double"))
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value))
    sums = node_counts(pages).groupBy("host", "node").agg(
        of(0, k).alias("m"), of(1, k).alias("s"), of(1, k * ln).alias("sl"), of(1, F.lit(1.0)).alias("styles"), of(2, ln).alias("cl"), of(2, F.lit(1.0)).alias("texts")
    )

    def work(table: pa.Table) -> pa.Table:
        c = {name: table.column(name).to_pylist() for name in table.column_names}
        nodes = {}
        for i, node in enumerate(c["node"]):
            m = int(c["m"][i] or 0)
            if m < 2:
                continue
            base, s, texts = math.log(m), c["s"][i], c["texts"][i]
            presentation = min(1.0, max(0.0, (math.log(s) - c["sl"][i] / s) / base)) if s else None
            content = min(1.0, max(0.0, 1 - c["cl"][i] / texts / base)) if texts else None
            nodes[node] = (m, presentation, int(c["styles"][i] or 0), content)
        nodes = {p: v for p, v in nodes.items() if not p or p.rpartition("/")[0] in nodes}
        tree = "\n".join(f"{i:.9g} {m} {p}" for p, (i, m) in sorted(strongest(composite(nodes)).items()))
        return pa.table({"host": pa.array(c["host"][:1], pa.string()), "nodes": pa.array([tree], pa.string())})

    return sums.groupBy("host").applyInArrow(work, "host string, nodes string")


def tree_of(lines: str | None) -> dict[str, tuple[float, int]]:
    """(importance, pages) by node."""
    parts = [line.split(" ", 2) for line in (lines or "").split("\n") if line]
    return {node: (float(importance), int(pages)) for importance, pages, node in parts}


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars``: a row per row of ``pages``."""
    rows = pages.select("page_id", "url", host_of().alias("host"), F.col("html").cast("string").alias("html"))
    trees = cut(style_trees(pages))
    size = trees.agg(F.sum(F.octet_length("host") + F.octet_length("nodes"))).first()[0] or 0
    trees = F.broadcast(trees) if size <= TREE_BYTES else trees  # beyond that, pages meet their host's tree by a shuffle
    joined = rows.join(trees, "host", "left").select("page_id", "url", "html", "nodes")

    def work(batches):
        for batch in batches:
            out, trees = [], {}
            for text, nodes in zip(batch.column(2), batch.column(3)):
                lines = nodes.as_py()
                if lines not in trees:
                    trees[lines] = tree_of(lines)
                out.append(extract(text.as_py(), trees[lines]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(np.array([len(t) for t in out], np.int64))], ["page_id", "url", "text", "n_chars"]
            )

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return joined.mapInArrow(work, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
