"""Main-text extraction by wrapper induction over the pages of a host.

A page becomes a tree of block elements (siblings of equal tag and class are one repeated node) and
runs of text, each in a node. Pages of a host are aligned by simple tree matching: the largest
order-preserving match of children, recursively. The aligned tree is the host's wrapper; it counts
the pages that have a node, the texts found in it, their characters and those of them in links.

Constant texts are template: those that most of a host's pages have in the same node. Varying slots
are content, unless their size says otherwise: from the root down, a child that holds under a tenth
of its parent's varying text outside links (menus, adverts, footers) goes, but for headings; what is
left is followed down while one child, found once a page, holds nearly all of it and has its text in
blocks of its own. Below that nothing goes but template. So neither the tag of an article nor a class
name is needed; `hints=False` leaves all such names out.

With hints, navigation, footers, sidebars, forms and hidden elements go by tag, and outside an article
elements that a class, id or role names as boilerplate. Hosts with fewer than `least_pages` pages have
no templates; there the article, where a page has one, is the content, without elements in it whose
class is exactly such a name. Elsewhere a name drops nothing in an article: the wrapper decides.

All pages take part. Each task merges its pages into wrappers, of which it holds at most HELD nodes
at once, and those meet in two steps, so a host that has a third of all pages is merged from a few
small rows. A wrapper's size is bounded by the host's layouts: repeated siblings are one node, what is
nested deeper than DEPTH blocks counts as its ancestor there, and a node counts its texts by
Misra-Gries: 64 of them, or as many more as it takes to miss no count by over a quarter of the node's
pages. These counts only nominate texts (by count plus error); a second pass aligns all pages with the
wrappers and counts the nominated texts exactly. While all wrappers together are below
`broadcast_bytes` they go to the tasks at once; beyond that they are joined to the pages by host, where
adaptive execution splits a hot host.

Defined results: null or empty html gives an empty text; broken markup is closed as browsers do for
paragraphs, items and cells; blocks may be nested to any depth; repeated rows each get a result; a
null url is a host of its own. Extra columns pass through, and one of the name asked for as output is
replaced.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.url_filter import host_of
from lathe.session import ensure_checkpoint_dir

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|title|svg|iframe|select)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
_BOILERPLATE_TAGS = frozenset("nav footer aside form head button dialog menu fieldset object applet canvas audio video label".split())
_BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?<!with[_-])(?<!has[_-])(?<!no[_-])(?:ads?|adverts?|advert[a-z]*|adsense|sponsor(?:ed|s)?|promos?|promotion|banner|menus?|nav|navbar|navigation|breadcrumbs?|sidebar|side|widgets?|footer|foot|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|search|share|sharing|social|related|recommend(?:ed|ations)?|comments?|commentlist|replies|reply|respond|disqus|discussion|form|skip|pagination|pager|copyright|legal|disclaimer|toolbar|contentinfo|complementary)(?:$|[\s_-])",
    re.I,
)
#: Classes, ids and roles that, as they stand, name boilerplate within an article of a host too small to align.
_INSIDE = frozenset("ad ads advert advertisement sponsored promo banner share sharing social newsletter subscribe comments comment-list related breadcrumb breadcrumbs pagination nav nav-links navigation menu sidebar footer cookie-notice popup modal legal".split())
#: Boilerplate outside an article; inside, it's the article's own head.
_HEAD = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar)(?:$|[\s_-])", re.I)
#: Elements whose ids, inside an article, are those of its subjects.
_SUBJECTS = frozenset("section h1 h2 h3 h4 h5 h6".split())
#: Start tags that close an open element of these names first.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table article section div body td th form aside nav header footer main blockquote".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTS = 64
#: Nested blocks that are told apart.
DEPTH = 64
#: Nodes that a task holds before it passes its wrappers on.
HELD = 200_000
#: A slot with less than this share of what its parent's slots hold is no content.
LEAST_SLOT = 0.1
#: Sixteenths of a node's pages that counts may miss after each step: pages, task, tasks, host.
ERRORS = (1, 2, 3, 4)


class Page:
    """A page's nodes [(parent, key)], flags and sizes of each, and runs [(node, text)] in page order.

    `dropped` nodes are boilerplate; `named` ones, inside an article, are so by name only. `sizes` are
    [characters, those in links, elements] of a node's own texts. Without `hints` no name of a tag or
    class counts but that of the head.
    """

    __slots__ = ("nodes", "dropped", "named", "inside", "runs", "sizes")

    def __init__(self, source: str | None, hints: bool = True):
        self.nodes: list[tuple[int, str]] = [(-1, "#root")]
        self.dropped, self.named, self.inside, self.runs, self.sizes = [False], [False], [False], [], [[0, 0, 1]]
        if source:
            self._read(source, hints)

    def _read(self, source: str, hints: bool) -> None:
        children: dict[tuple[int, str], int] = {}
        nodes, dropped, named, inside, runs, sizes = self.nodes, self.dropped, self.named, self.inside, self.runs, self.sizes
        article, depth = [False], [0]
        stack: list[tuple[str, int]] = [("#root", 0)]
        open_: dict[str, int] = {}
        buffer: list[str] = []
        linked = links = 0

        def flush():
            nonlocal linked
            if buffer:
                if text := " ".join(entities.unescape("".join(buffer)).split()):
                    node = stack[-1][1]
                    runs.append((node, text))
                    sizes[node][0] += len(text)
                    sizes[node][1] += min(linked, len(text))
                buffer.clear()
            linked = 0

        def leave(i):
            for name, _ in stack[i:]:
                open_[name] -= 1
            del stack[i:]

        def close(names, scope):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in names:
                    flush()
                    leave(i)
                    return
                if stack[i][0] in scope:
                    return

        def say(text):
            nonlocal linked
            buffer.append(text)
            if links:
                linked += len(text)

        at = 0
        for m in _TOKEN.finditer(source):
            if m.start() > at:
                say(source[at : m.start()])
            at = m.end()
            name = m[3] or m[6]
            if name is None:
                continue
            name, attributes = name.lower(), m[4] if m[3] else m[7]
            if name == "a":
                links = int(not (m[2] or m[5]))
            if m[2] or m[5]:
                if name in _BLOCKS or open_.get(name):
                    flush()
                    if open_.get(name):
                        leave(max(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name) if stack[-1][0] != name else len(stack) - 1)
                continue
            if name in _VOID:
                if name == "hr":
                    flush()
                else:
                    buffer.append(" " if name == "br" else "")
                continue
            parent = stack[-1][1]
            token, hide, prior = "", False, False
            if attributes and not attributes.isspace():
                for key, value in _ATTRIBUTE.findall(attributes):
                    key, value = key.lower(), value.strip("\"'")
                    if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                        hide = True
                    elif key == "style":
                        hide = hide or "display:none" in value.replace(" ", "").lower()
                    elif words := value.split():
                        token = token or words[0]
                        if not hints:
                            continue
                        if not article[parent]:
                            hide = hide or bool(_BOILERPLATE.search(value)) or not inside[parent] and bool(_HEAD.search(value))
                        elif not (key == "id" and name in _SUBJECTS):
                            prior = prior or not _INSIDE.isdisjoint(value.lower().split())
            hide = hide or name == "head" or hints and (name in _BOILERPLATE_TAGS or name == "header" and not inside[parent])
            if name not in _BLOCKS and not hide and not prior:
                continue
            flush()
            if name in _BLOCKS and name not in ("li", "dt", "dd", "tr", "td", "th", "option"):
                close(("p",), _SCOPE)
            if name in _CLOSES:
                close(_CLOSES[name], ("ul", "ol", "dl", "table", "select"))
            parent = stack[-1][1]
            key = name + "." + re.sub(r"\d+", "0", token) if token else name
            gone = dropped[parent] or (hide and name not in ("body", "html", "article", "main")) or (hide and name in ("article", "main") and inside[parent])
            if depth[parent] >= DEPTH:
                key = "#deep" if gone and not dropped[parent] else None
            own = parent if key is None else children.get((parent, key))
            if own is None:
                own = children[parent, key] = len(nodes)
                nodes.append((parent, key))
                dropped.append(gone)
                depth.append(depth[parent] + 1)
                sizes.append([0, 0, 0])
                named.append(named[parent] or prior)
                article.append(article[parent] or (hints and name == "article" and not gone))
                inside.append(inside[parent] or (hints and name in ("article", "main") and not gone))
            if key is not None:
                sizes[own][2] += 1
            stack.append((name, own))
            open_[name] = open_.get(name, 0) + 1
        if at < len(source):
            say(source[at:])
        flush()


def text_hash(text: str) -> int:
    """48 bits of hash and the text's length (at most 65535)."""
    return xxhash.xxh3_64_intdigest(text.encode(errors="surrogatepass")) >> 16 << 16 | min(len(text), 0xFFFF)


class Wrapper:
    """Aligned pages of a host: a tree of nodes [key, pages, {text hash: pages}, children, most that a
    count misses, characters, those in links, elements]."""

    def __init__(self, root=None):
        self.root = root or ["#root", 0, {}, [], 0, 0, 0, 0]

    @staticmethod
    def tree(nodes: tuple, pages: int, texts: list[dict[int, int]], errors: list[int] | None = None, sizes: list | None = None) -> list:
        made = [[key, pages, texts[i], [], errors[i] if errors else 0, *(sizes[i] if sizes else (0, 0, 0))] for i, (_, key) in enumerate(nodes)]
        for i, (parent, _) in enumerate(nodes):
            if parent >= 0:
                made[parent][3].append(made[i])
        return made[0]

    @staticmethod
    def match(a: list, b: list, memo: dict) -> tuple[int, list[tuple[int, int]]]:
        """Simple tree matching: (size of the largest match of two trees of equal key, matched children)."""
        if (found := memo.get((id(a), id(b)))) is not None:
            return found
        x, y = a[3], b[3]
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                with_both = best[i - 1][j - 1] + Wrapper.match(x[i - 1], y[j - 1], memo)[0] if x[i - 1][0] == y[j - 1][0] else -1
                best[i][j] = max(best[i - 1][j], best[i][j - 1], with_both)
        i, j, pairs = len(x), len(y), []
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((i, j))
        memo[id(a), id(b)] = result = (1 + best[-1][-1], pairs[::-1])
        return result

    def merge(self, other: list, error: int = ERRORS[1]) -> None:
        memo: dict = {}

        def into(a, b):
            a[1] += b[1]
            a[2], cut = lessened(a[2], b[2], a[1] * error // 16 - a[4] - b[4])
            a[4] += b[4] + cut
            for k in (5, 6, 7):
                a[k] += b[k]
            pairs = self.match(a, b, memo)[1] if a[3] else []
            partner = {j: i for i, j in pairs}
            merged, done = [], 0
            for j, child in enumerate(b[3]):
                if j in partner:
                    merged += a[3][done : partner[j]]
                    done = partner[j] + 1
                    into(a[3][partner[j]], child)
                    merged.append(a[3][partner[j]])
                else:
                    merged.append(child)
            a[3] = merged + a[3][done:]

        into(self.root, other)

    def aligned(self, nodes: tuple) -> list[tuple[list, int]]:
        """(node of the wrapper, number of the page's node) of each pair that matches."""
        page = self.tree(nodes, 0, [{} for _ in nodes])
        order = [[] for _ in nodes]
        for i, (parent, _) in enumerate(nodes):
            if parent >= 0:
                order[parent].append(i)
        out, memo = [], {}

        def walk(a, b, i):
            out.append((a, i))
            for x, y in self.match(a, b, memo)[1]:
                walk(a[3][x], b[3][y], order[i][y])

        walk(self.root, page, 0)
        return out

    def slots(self, share: float, least_pages: int) -> set[int]:
        """Ids of the nodes that hold no content, by the size of their varying text."""
        weight: dict[int, int] = {}
        for node in reversed(list(self.all_nodes())):
            fixed = sum(v * (k & 0xFFFF) for k, v in node[2].items() if v >= share * node[1]) if node[1] >= least_pages else 0
            weight[id(node)] = max(0, node[5] - node[6] - fixed) + sum(weight[id(c)] for c in node[3])
        out: set[int] = set()
        node = self.root
        while node[3] and weight[id(node)]:
            best = max(node[3], key=lambda c: weight[id(c)])
            whole, alone = weight[id(node)], best[7] <= 1.5 * max(1, best[1])
            inner = sum(weight[id(c)] for c in best[3])
            follow = weight[id(best)] >= (1 - LEAST_SLOT) * whole and alone and 2 * inner >= weight[id(best)]
            if not follow and node[0].partition(".")[0] not in ("#root", "html", "body"):
                break
            out.update(id(c) for c in node[3] if c is not best and weight[id(c)] < LEAST_SLOT * whole and (follow or self._linked(c)) and c[0].partition(".")[0] not in _HEADINGS)
            if not follow:
                break
            node = best
        return out

    @staticmethod
    def _linked(node: list) -> bool:
        left, chars, links = [node], 0, 0
        while left:
            n = left.pop()
            chars, links = chars + n[5], links + n[6]
            left += n[3]
        return 2 * links > chars

    def decide(self, nodes: tuple, share: float, least_pages: int, slots: set[int] | None) -> list[frozenset[int] | bool | None]:
        """For each node of a page's tree: the texts that are template there, null where too few pages
        tell, or False where nothing is content."""
        out: list[frozenset[int] | bool | None] = [None] * len(nodes)
        gone = [False] * len(nodes)
        for a, i in self.aligned(nodes):
            gone[i] = slots is not None and id(a) in slots
            if a[1] >= least_pages:
                out[i] = frozenset(k for k, v in a[2].items() if v >= share * a[1])
        for i, (parent, _) in enumerate(nodes):  # parents come first
            gone[i] = gone[i] or parent >= 0 and gone[parent]
        return [False if g else x for g, x in zip(gone, out, strict=True)]

    def all_nodes(self) -> Iterator[list]:
        """The nodes, parents first; a node's place is its number."""
        left = [self.root]
        while left:
            yield (node := left.pop())
            left += reversed(node[3])

    def nominate(self, share: float, least_pages: int) -> None:
        """Keeps the texts that may be template."""
        for node in self.all_nodes():
            node[2] = {k: v for k, v in node[2].items() if v + node[4] >= share * node[1]} if node[1] >= least_pages else {}

    def settle(self, counts: dict[tuple[int, int | None], int]) -> None:
        """Puts exact counts, {(node, text): pages} and {(node, None): pages}, for the nominated."""
        for number, node in enumerate(self.all_nodes()):
            if node[2]:
                node[1] = counts.get((number, None), 0)
                node[2] = {k: counts[number, k] for k in node[2] if (number, k) in counts}
            node[4] = 0

    def dump(self) -> bytes:
        return zlib.compress(json.dumps(self.root, separators=(",", ":")).encode(), 1)

    @classmethod
    def load(cls, raw: bytes) -> Wrapper:
        def fix(node):
            return [node[0], node[1], {int(k): v for k, v in node[2].items()}, [fix(c) for c in node[3]], *node[4:]]

        return cls(fix(json.loads(zlib.decompress(raw))))


def lessened(a: dict[int, int], b: dict[int, int], room: int) -> tuple[dict[int, int], int]:
    """Two counts as one, by Misra-Gries, and what each lost: TEXTS texts, or as many more as a loss of at most `room` leaves."""
    out = dict(a)
    for k, v in b.items():
        out[k] = out.get(k, 0) + v
    if len(out) <= TEXTS or room <= 0:
        return out, 0
    cut = min(room, sorted(out.values(), reverse=True)[TEXTS])
    return {k: v - cut for k, v in out.items() if v > cut}, cut


class Gathering:
    """Pages grouped by host and tree before they are aligned."""

    def __init__(self):
        self.found: dict[object, dict[tuple, list]] = {}
        self.held = 0

    def add(self, host, page: Page) -> None:
        by_tree = self.found.setdefault(host, {})
        nodes = tuple(page.nodes)
        entry = by_tree.get(nodes)
        if entry is None:
            entry = by_tree[nodes] = [0, [{} for _ in nodes], [0] * len(nodes), [[0, 0, 0] for _ in nodes]]
            self.held += len(nodes)
        entry[0] += 1
        for node, mine in enumerate(page.sizes):
            if not page.dropped[node]:
                entry[3][node] = [x + y for x, y in zip(entry[3][node], mine, strict=True)]
        for node, h in {(node, text_hash(text)) for node, text in page.runs if not page.dropped[node]}:
            counts = entry[1][node]
            counts[h] = counts.get(h, 0) + 1
            if len(counts) > 4 * TEXTS and (room := entry[0] * ERRORS[0] // 16 - entry[2][node]) > 0:
                entry[1][node], cut = lessened(counts, {}, room)
                entry[2][node] += cut

    def wrappers(self) -> Iterator[tuple[object, Wrapper]]:
        for host, by_tree in self.found.items():
            w = Wrapper()
            for nodes in sorted(by_tree, key=lambda n: (-by_tree[n][0], n)):
                w.merge(Wrapper.tree(nodes, *by_tree[nodes]))
            yield host, w


def main_text(page: Page, decided: list[frozenset[int] | bool | None] | None, sure: bool = False) -> str:
    """The page's text. `sure`: the host's pages tell where content is; else an article does, if there is one."""
    article = not sure and any(page.inside)
    out = []
    for node, text in page.runs:
        known = decided[node] if decided else None
        if page.dropped[node] or known is False or article and not page.inside[node] or not sure and page.named[node]:
            continue
        if not known or text_hash(text) not in known:
            out.append(text)
    return "\n".join(out)


def induce(pages: DataFrame, host_col: str = "_host", html_col: str = "html", share: float = 0.75, least_pages: int = 8, hints: bool = True) -> DataFrame:
    """(host, wrapper) for every host, from all its pages; a wrapper's texts are nominated, not yet counted."""
    schema = "host string, part int, wrapper binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, part = Gathering(), TaskContext.get().partitionId() >> 6

        def rows() -> Iterator[pa.RecordBatch]:
            made = [(h, part, w.dump()) for h, w in gathered.wrappers()]
            if made:
                hosts, parts, wrappers = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(parts, pa.int32()), pa.array(wrappers, pa.binary())], ["host", "part", "wrapper"])

        for batch in batches:
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                gathered.add(host, Page(source, hints))
                if gathered.held > HELD:
                    yield from rows()
                    gathered = Gathering()
        yield from rows()

    def added(error: int, last: bool):
        def add(group: pa.Table) -> pa.Table:
            total = Wrapper()
            for raw in sorted(group["wrapper"].to_pylist()):
                total.merge(Wrapper.load(raw).root, error)
            if last:
                total.nominate(share, least_pages)
            return pa.Table.from_arrays([group["host"].slice(0, 1), pa.array([group["part"][0].as_py() >> 6], pa.int32()), pa.array([total.dump()], pa.binary())], ["host", "part", "wrapper"])

        return add

    step = pages.select(F.col(host_col), F.col(html_col)).mapInArrow(run, schema)
    return step.groupBy("host", "part").applyInArrow(added(ERRORS[2], False), schema).groupBy("host").applyInArrow(added(ERRORS[3], True), schema).select("host", "wrapper")


def few(wrappers: DataFrame, broadcast_bytes: int) -> dict[str, bytes] | None:
    """The wrappers by host, if they are below `broadcast_bytes`."""
    size = wrappers.agg(F.coalesce(F.sum(F.length("wrapper") + F.length("host") + 64), F.lit(0)).alias("n")).first()["n"]
    return {r["host"]: bytes(r["wrapper"]) for r in wrappers.collect()} if size <= broadcast_bytes else None


def with_wrappers(hosted: DataFrame, wrappers: DataFrame) -> DataFrame:
    return hosted.join(wrappers.withColumnRenamed("host", "_host").withColumnRenamed("wrapper", "_wrapper"), "_host", "left")


def recounted(hosted: DataFrame, wrappers: DataFrame, html_col: str = "html", broadcast_bytes: int = 16 << 20, hints: bool = True) -> DataFrame:
    """`wrappers` with the nominated texts counted over all pages of `hosted`."""
    small = few(wrappers, broadcast_bytes)
    names = ["host", "node", "text", "n"]

    def rows_of(counts: dict) -> pa.RecordBatch:
        hosts, nodes, texts = zip(*counts, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(nodes, pa.int32()), pa.array(["" if t is None else str(t) for t in texts]), pa.array(list(counts.values()), pa.int64())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int, int | None], int] = {}
        loaded: dict[bytes, tuple[Wrapper, dict[int, int]]] = {}
        places: dict[tuple, dict[int, tuple[int, dict]]] = {}
        for batch in batches:
            raws = batch.column(2).to_pylist() if small is None else map(small.get, batch.column(0).to_pylist())
            for host, source, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raws, strict=True):
                if raw is None:
                    continue
                if raw not in loaded:
                    if len(loaded) > 2000:
                        loaded.clear(), places.clear()
                    w = Wrapper.load(raw)
                    loaded[raw] = w, {id(node): number for number, node in enumerate(w.all_nodes()) if node[2]}
                w, nominated = loaded[raw]
                if not nominated:
                    continue
                page = Page(source, hints)
                nodes = tuple(page.nodes)
                if (at := places.get((raw, nodes))) is None:
                    if len(places) > 20_000:
                        places.clear()
                    at = places[raw, nodes] = {i: (nominated[id(a)], a[2]) for a, i in w.aligned(nodes) if id(a) in nominated}
                found = {(number, None) for number, _ in at.values()}
                for node, text in page.runs:
                    if node in at and not page.dropped[node] and (h := text_hash(text)) in at[node][1]:
                        found.add((at[node][0], h))
                for number, h in found:
                    counts[host, number, h] = counts.get((host, number, h), 0) + 1
            if len(counts) > 100_000:
                yield rows_of(counts)
                counts.clear()
        if counts:
            yield rows_of(counts)

    @F.arrow_udf("binary")
    def settled(raws: pa.Array, counts: pa.Array) -> pa.Array:
        out = []
        for raw, rows in zip(raws.to_pylist(), counts.to_pylist(), strict=True):
            w = Wrapper.load(raw)
            w.settle({(r["node"], int(r["text"]) if r["text"] else None): r["n"] for r in rows or ()})
            out.append(w.dump())
        return pa.array(out, pa.binary())

    paged = hosted.select("_host", html_col) if small is not None else with_wrappers(hosted.select("_host", html_col), wrappers).select("_host", html_col, "_wrapper")
    exact = paged.mapInArrow(run, "host string, node int, text string, n long").groupBy("host", "node", "text").agg(F.sum("n").alias("n"))
    by_host = exact.groupBy("host").agg(F.collect_list(F.struct("node", "text", "n")).alias("counts"))
    return wrappers.join(by_host, "host", "left").select("host", settled("wrapper", "counts").alias("wrapper"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", out_col: str = "text", share: float = 0.75, least_pages: int = 8, broadcast_bytes: int = 16 << 20, hints: bool = True) -> DataFrame:
    """`pages` with the main text of each in `out_col`; without `hints`, hosts of any size go by their slots."""
    ensure_checkpoint_dir(pages.sparkSession)
    columns = [F.col("_row").getField(c).alias(c) for c in pages.columns if c != out_col]
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns])  # apart from the columns made here
    hosted = pages.select(row.alias("_row"), F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("_host"), F.col(html_col).alias("_html"))
    wrappers = induce(hosted, "_host", "_html", share, least_pages, hints).checkpoint()
    wrappers = recounted(hosted, wrappers, "_html", broadcast_bytes, hints).checkpoint()
    small = few(wrappers, broadcast_bytes)
    loaded: dict[bytes, tuple[Wrapper, set[int] | None]] = {}
    decided: dict[tuple, list] = {}

    def text_of(source, raw) -> str:
        page = Page(source, hints)
        if raw is None:
            return main_text(page, None)
        if raw not in loaded:
            if len(loaded) > 2000:
                loaded.clear(), decided.clear()
            w = Wrapper.load(raw)
            loaded[raw] = w, w.slots(share, least_pages) if w.root[1] >= least_pages or not hints else None
        w, slots = loaded[raw]
        nodes = tuple(page.nodes)
        if (decision := decided.get((raw, nodes))) is None:
            if len(decided) > 20_000:
                decided.clear()
            decided[raw, nodes] = decision = w.decide(nodes, share, least_pages, slots)
        return main_text(page, decision, slots is not None)

    if small is not None:

        @F.arrow_udf("string")
        def by_host(hosts: pa.Array, sources: pa.Array) -> pa.Array:
            return pa.array([text_of(s, small.get(h)) for h, s in zip(hosts.to_pylist(), sources.to_pylist(), strict=True)], pa.string())

        return hosted.select(*columns, by_host(F.col("_host"), F.col("_html")).alias(out_col))

    @F.arrow_udf("string")
    def by_wrapper(raws: pa.Array, sources: pa.Array) -> pa.Array:
        return pa.array([text_of(s, w) for w, s in zip(raws.to_pylist(), sources.to_pylist(), strict=True)], pa.string())

    return with_wrappers(hosted, wrappers).select(*columns, by_wrapper(F.col("_wrapper"), F.col("_html")).alias(out_col))
