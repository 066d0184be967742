"""Main text of web pages by minimum-cut labelling.

A page is read into blocks: runs of text between the tags that break lines. A linear
classifier gives each block its cost of being content or boilerplate, from where it stands in
the DOM, its links, length and punctuation; the costs are the capacities from the source and to
the sink. An element whose tag or one of whose names tells of a page's furniture speaks against
what it holds, whatever else its names tell of, unless it holds the page's first heading, or its main
part, with half of the text, as wrappers do. Blocks that follow each other are joined by edges that weaken with their distance in
the DOM, and so are a block and the last one under the same parent, wherever it stands. The
minimum cut is the labelling of least total cost, and the blocks on the source's side are the
main text. A block whose own cost outweighs all its edges has its label in every minimum cut; such
blocks are labelled first and their edges become costs of their neighbours, which leaves few
for the maximum flow, and the same cut.

Each page is a row's work, nothing is shuffled. No labelled pages exist to train on, so the
classifier's weights are parameters.

Nulls, ties and the like: a null page is empty, as is one without content. Tags may be open,
wrong or cut off; a comment or script that never ends takes the rest. What is hidden by an
attribute is no text. White space is what Unicode calls so, no-break spaces and line breaks in
a block included. If both labels cost the same, a block is boilerplate. Rows that repeat get a
row each; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import html
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import table

#: HTML's elements by what they do to a text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
HIDDEN = frozenset("head script style title template noscript iframe object svg math canvas audio video datalist select option button textarea".split())
BREAKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Opening one of these ends an open paragraph or an open item of the same kind.
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
CONTENT = frozenset(["article", "main"])
BOILER = frozenset("nav footer aside form menu dialog fieldset".split())
#: Parts of a class, id or role that name a page's furniture.
FURNITURE = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies copyright disqus feedback footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination popular popup promo promoted reaction reactions recommended related replies reply respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar trending widget".split())
#: Parts that make a name one of a state (``no-sidebar``, ``comments-open``), and names that a quotation can have for what it is offered for.
STATES = frozenset("closed disabled enabled has is no none off on open with without".split())
QUOTED = frozenset("promo promoted share sharing social sponsor sponsored".split())
#: Share of a page's text from which an element with its heading or main part is a wrapper.
WRAPS = 0.5

_TAG = re.compile(r"<!--(?:>|->)|<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_UNSEEN = re.compile(r"""(?:^|[\s"'/])(?:hidden(?=[\s=/]|$)(?!\s*=\s*["']?until-found)|aria-hidden\s*=\s*["']?true|style\s*=\s*(?:"[^"]*?|'[^']*?|)(?:display\s*:\s*none|visibility\s*:\s*hidden))""", re.I)


@dataclass(frozen=True)
class Weights:
    """The classifier's weights and the edges' strength; positive speaks for content."""

    bias: float = 0.6
    content: float = 5.0
    furniture: float = -9.0
    links: float = -4.0
    word: float = 0.06
    most_words: float = 2.0
    sentence: float = 0.5
    heading: float = 0.5
    item: float = -0.5
    rights: float = -3.0
    near: float = 1.0
    sibling: float = 0.5
    across: float = 0.1


@dataclass
class Part:
    """A block: its pieces of text and what is known of its place."""

    node: int
    content: bool
    heading: int
    item: bool
    furniture: bool = False
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


@dataclass
class Mark:
    """An element that tells of furniture, and the blocks in it."""

    name: str
    first: int
    last: int = -1


def _furniture(name: str, attributes: str) -> bool:
    """Whether one of an element's names tells of furniture, whatever else it tells of."""
    barred = FURNITURE - QUOTED if name in ("blockquote", "q", "pre") else FURNITURE
    for match in _NAMES.finditer(attributes):
        for each in next(x for x in match.groups() if x is not None).split():
            parts = {p.lower() for p in _PARTS.findall(each)}
            if not barred.isdisjoint(parts) and STATES.isdisjoint(parts):
                return True
    return False


class Tree:
    """Parents and depths of the elements that break lines."""

    def __init__(self) -> None:
        self.up, self.depth = [-1], [0]

    def add(self, parent: int) -> int:
        self.up.append(parent)
        self.depth.append(self.depth[parent] + 1)
        return len(self.up) - 1

    def apart(self, a: int, b: int) -> int:
        """Steps from one element to the other."""
        steps = 0
        while a != b:
            if self.depth[a] >= self.depth[b]:
                a = self.up[a]
            else:
                b = self.up[b]
            steps += 1
        return steps


def _wraps(mark: Mark, texts: list[int], heads: list[int], mains: list[int], articles: list[int]) -> bool:
    """Whether an element holds the page's main part with all around it."""
    share = texts[mark.last] - texts[mark.first]
    has = lambda firsts: any(mark.first <= i < mark.last for i in firsts)
    holds = heads[mark.last] > heads[mark.first] or has(mains) or mark.name in CONTENT or mark.name == "form" and has(articles)
    return holds and share >= WRAPS * texts[-1]


def blocks(page: str) -> tuple[list[Part], Tree]:
    """The blocks of text that a reader would see, in page order, and the tree they stand in."""
    # name, node, is it hidden, in content, its mark, level of heading, an item, a link
    stack: list[tuple] = [("", 0, False, False, None, 0, False, False)]
    is_open: Counter[str] = Counter()
    made: list[Part] = []
    marks: list[Mark] = []
    mains: list[int] = []
    articles: list[int] = []
    tree = Tree()
    now: Part | None = None
    at, size = 0, len(page)

    def text(piece: str) -> None:
        nonlocal now
        top = stack[-1]
        if top[2] or not piece:
            return
        if now is None:
            if piece.isspace():
                return
            now = Part(top[1], top[3], top[5], top[6])
            made.append(now)
        now.pieces.append(piece)
        if top[7]:
            now.linked += len(piece)

    def cut(i: int) -> None:
        for x in stack[i:]:
            is_open[x[0]] -= 1
            if x[4]:
                x[4].last = len(made)
        del stack[i:]

    def close(names: tuple[str, ...]) -> None:
        if not any(is_open[x] > 0 for x in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                return cut(i)
            if stack[i][0] in ("table", "ul", "ol", "dl", "article", "body") and names[0] not in ("article", "body", "html"):
                return None

    while at < size:
        opened = page.find("<", at)
        if opened < 0:
            text(html.unescape(page[at:]))
            break
        tag = _TAG.match(page, opened)
        if tag is None:
            text(html.unescape(page[at : opened + 1]))
            at = opened + 1
            continue
        if opened > at:
            text(html.unescape(page[at:opened]))
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        ends, attributes = tag[1] or tag[4], tag[3] or tag[6] or ""
        if name == "br":
            if now is not None:
                now.pieces.append(" ")
            continue
        if name in BREAKS:
            now = None
        if name in VOID:
            continue
        if ends:
            close((name,))
            continue
        if name in BREAKS and is_open["p"] > 0 and (last := next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in BREAKS), 0)) and stack[last][0] == "p":
            cut(last)
        if name in ITEMS:
            close(ITEMS[name])
        top = stack[-1]
        inside = top[3] or name in CONTENT
        mark = None
        if name in BOILER or name == "header" and not inside or bool(attributes) and name not in ("html", "body") and _furniture(name, attributes):
            mark = Mark(name, len(made))
            marks.append(mark)
        elif name in CONTENT:
            (mains if name == "main" else articles).append(len(made))
        is_open[name] += 1
        node = tree.add(top[1]) if name in BREAKS else top[1]
        unseen = top[2] or name in HIDDEN or bool(attributes) and _UNSEEN.search(attributes) is not None
        level = int(name[1]) if len(name) == 2 and name[0] == "h" and name[1].isdigit() else top[5]
        stack.append((name, node, unseen, inside, mark, level, name == "li" or top[6], name == "a" or top[7]))
        if name in RAW:
            end = re.compile(f"</{name}(?=[\\s/>]|\\Z)", re.I).search(page, at)
            at = end.start() if end else size
    cut(1)
    for part in made:
        part.text = " ".join("".join(part.pieces).split())
    texts = [0, *itertools.accumulate(len(p.text) for p in made)]
    heads = [0, *itertools.accumulate(p.heading == 1 for p in made)]
    under = [0] * (len(made) + 1)
    for mark in marks:
        if mark.first < mark.last and not _wraps(mark, texts, heads, mains, articles):
            under[mark.first] += 1
            under[mark.last] -= 1
    for part, depth in zip(made, itertools.accumulate(under), strict=False):
        part.furniture = depth > 0
    return [part for part in made if part.text], tree


def leaning(part: Part, w: Weights) -> float:
    """How much more it costs to call a block boilerplate than content."""
    text = part.text
    words = text.count(" ") + 1
    score = w.bias + w.content * part.content + w.furniture * part.furniture + w.heading * (part.heading > 0) + w.item * part.item
    score += w.links * min(1.0, part.linked / max(1, len(text))) + min(w.most_words, w.word * words)
    score += w.sentence * (text[-1] in ".!?…:") + w.rights * text.startswith(("©", "Copyright", "(c)"))
    return score


def edges(parts: list[Part], tree: Tree, w: Weights) -> dict[tuple[int, int], float]:
    """Strength of the edges between blocks, ``(i, j)`` with i < j."""
    found: dict[tuple[int, int], float] = {}
    under: dict[int, int] = {}
    for j, part in enumerate(parts):
        scale = lambda i, part=part: w.across if parts[i].furniture != part.furniture else 1.0
        if j:
            found[j - 1, j] = scale(j - 1) * w.near / (1 + tree.apart(parts[j - 1].node, part.node))
        parent = tree.up[part.node]
        if (i := under.get(parent)) is not None:
            found[i, j] = found.get((i, j), 0.0) + scale(i) * w.sibling
        under[parent] = j
    return found


def minimum_cut(lean: list[float], joined: dict[tuple[int, int], float]) -> list[bool]:
    """Whether each block is on the source's (content's) side of the minimum cut."""
    near: list[dict[int, float]] = [{} for _ in lean]
    for (i, j), c in joined.items():
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    cost, label = list(lean), [None] * len(lean)
    todo = list(range(len(lean)))
    while todo:
        i = todo.pop()
        if label[i] is None and abs(cost[i]) > sum(near[i].values()):
            label[i] = cost[i] > 0
            for j, c in near[i].items():
                del near[j][i]
                cost[j] += c if label[i] else -c
                todo.append(j)
            near[i] = {}
    rest = [i for i, x in enumerate(label) if x is None]
    if rest:
        for i, side in zip(rest, _max_flow(rest, cost, near), strict=True):
            label[i] = side
    return label


def _max_flow(nodes: list[int], cost: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Source's side by shortest augmenting paths in levels; -1 is the source and -2 the sink."""
    left: dict[int, dict[int, float]] = {i: dict(near[i]) for i in nodes}
    left[-1] = {i: cost[i] for i in nodes if cost[i] > 0}
    left[-2] = {}
    for i in nodes:
        left[i][-1] = 0.0
        left[i][-2] = max(0.0, -cost[i])
        left[-2][i] = 0.0
    tiny = 1e-12
    while True:
        level = {-1: 0}
        queue = [-1]
        for u in queue:
            for v, c in left[u].items():
                if c > tiny and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if -2 not in level:
            return [i in level for i in nodes]
        arcs = {u: iter(list(left[u])) for u in level}
        path = [-1]
        while path:
            u = path[-1]
            if u == -2:
                flow = min(left[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    left[a][b] -= flow
                    left[b][a] = left[b].get(a, 0.0) + flow
                path = [-1]
                arcs[-1] = iter(list(left[-1]))
                continue
            step = next((v for v in arcs[u] if left[u][v] > tiny and level.get(v) == level[u] + 1), None)
            if step is None:
                level[u] = -1
                path.pop()
            else:
                path.append(step)


def main_text(page: str | None, weights: Weights = Weights()) -> str:
    """The main text of a page, a line for each block."""
    if not page:
        return ""
    parts, tree = blocks(page)
    kept = minimum_cut([leaning(p, weights) for p in parts], edges(parts, tree, weights))
    return "\n".join(p.text for p, k in zip(parts, kept, strict=True) if k)


def extract(pages: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """``(page_id, url, text, n_chars)``, a row for each row of ``pages``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), weights) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(work, "page_id long, url string, text string, n_chars long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
