"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks. A classifier gives each block the log-odds of being content,
which are the capacities of its arcs to the two terminals; blocks that are neighbours on the page or
children of one element are tied by arcs whose capacity falls with their distance in the tree. The
minimum cut is the labelling of least total cost, found by maximum flow.

The classifier adds what the elements around a block say (fixed weights) to naive Bayes terms of its
length, links, punctuation and tag. Those are counted on a bounded random sample of pages, where
blocks below article or main count as content and blocks below nav, footer, aside, form or header as
boilerplate. Pages are independent rows: nothing is shuffled but the counts of the sample.

Edge cases: a NULL or empty page has empty text; a page without a content block too; unclosed and
stray tags are read like a browser does as far as block structure goes; columns that bear the name
of an output column are replaced; an empty table gives an empty result.
"""

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

SAMPLE_PAGES = 2_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<code>script|style)(?=[\s/>])[^>]*(?<!/)>.*?(?:</(?P=code)(?=[\s/>])[^>]*>|\Z)"
    r"|<(?P<raw>noscript|iframe|title|textarea)(?=[\s/>])[^>]*(?<!/)>.*?</(?P=raw)(?=[\s/>])[^>]*>"
    r"|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
#: Elements without prose, left out up to their end tag, if they have one.
LEFT_OUT = {t: re.compile(rf"<(/?){t}(?=[\s/>])[^>]*>", re.I) for t in ("svg", "button", "select", "template", "canvas")}
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
#: Elements that begin and end a block.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
#: Tags that a new one of the same kind closes.
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())
#: What the elements around a block say about it.
TAG_WEIGHT = {
    "article": 6.0, "main": 4.0, "nav": -12.0, "footer": -12.0, "aside": -12.0, "form": -12.0, "menu": -12.0, "dialog": -12.0,
    "header": -7.0, "head": -20.0,
}
NAME_WEIGHT = {
    -12.0: "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus footer gdpr login menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted "
    "related reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget "
    "complementary contentinfo alert copyright legal disclaimer",
    -7.0: "header masthead topbar",
    4.0: "article content entry post story main maincontent articlebody",
}
NAMES = {name: weight for weight, names in NAME_WEIGHT.items() for name in names.split()}
#: Fixed value: a name alone weighs no more than text evidence can outweigh.
NAME_LEAST = -6.0
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SMOOTH = 2.0


@dataclass
class Block:
    tag: str
    path: tuple[int, ...]
    weight: float
    marked: int
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    text: str = ""


def name_weight(attributes: str) -> float:
    """The strongest weight among the words of class, id and role."""
    found = 0.0
    for match in ATTRIBUTE.finditer(attributes):
        value = match.group(1) or match.group(2) or match.group(3) or ""
        words = re.split(r"[\s_\-]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower())
        content = any(NAMES.get(word, 0.0) > 0 for word in words)
        for word in words:
            # The header of an article or entry holds its title.
            weight = 0.0 if content and word == "header" else NAMES.get(word, 0.0)
            found = weight if abs(weight) > abs(found) else found
    return found


def end_of(page: str, tag: str, start: int) -> int:
    """Where the element that opened before ``start`` ends; 0 for one that is not closed.

    A button or a list of options cannot hold blocks: one that seems to was not closed.
    """
    depth = 1
    for match in LEFT_OUT[tag].finditer(page, start):
        depth += -1 if match.group(1) else not match.group().endswith("/>")
        if not depth:
            inner = page[start : match.start()] if tag in ("button", "select") else ""
            held = (m.group("tag") for m in TOKEN.finditer(inner))
            return 0 if any(t and t.lower() in BLOCK_TAGS and t.lower() != "option" for t in held) else match.end()
    return 0


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    found: list[Block] = []
    # (tag, number, weight so far, +1 below article or main / -1 below boilerplate elements, below a boilerplate tag)
    stack: list[tuple[str, int, float, int, bool]] = [("", 0, 0.0, 0, False)]
    count, links, current, skipped = 0, 0, None, 0
    for match in TOKEN.finditer(page):
        if match.start() < skipped:
            continue
        text = match.group("text")
        if text is not None:
            if current is None:
                if text.isspace():
                    continue
                tag, _, weight, marked, _ = stack[-1]
                current = Block(tag, tuple(s[1] for s in stack), weight, marked)
                found.append(current)
            text = entities.unescape(text) if "&" in text else text
            current.parts.append(text)
            if links:
                current.link_chars += len(text)
            continue
        tag = match.group("tag")
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(match.group("end"))
        if tag in LEFT_OUT:
            if not closing and not match.group().endswith("/>"):
                skipped = end_of(page, tag, match.end())
            continue
        if tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            if current is not None:
                current.parts.append(" ")
        elif tag in BLOCK_TAGS:
            current = None
            if closing:
                depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
                if depth:
                    del stack[depth:]
                continue
            if tag in SELF_CLOSING or (stack[-1][0] == "p"):
                if stack[-1][0] == "p" or stack[-1][0] == tag:
                    stack.pop()
            if tag == "hr":
                continue
            count += 1
            _, _, weight, marked, firm = stack[-1]
            own = TAG_WEIGHT.get(tag, 0.0)
            # A header within the article holds its title, not the site's banner.
            own = 0.0 if tag == "header" and marked > 0 else own
            attributes = match.group("attributes")
            named = name_weight(attributes) if "=" in attributes else 0.0
            if tag in ("html", "body"):
                named = 0.0
            mark = 1 if own >= 4 else -1 if own <= -7 else marked
            if own < 0:
                # Nothing below a boilerplate tag is content.
                firm, weight = True, min(weight, own, named)
            elif firm:
                weight = min(weight, named)
            else:
                # A bad name is evidence; article, main, a good name or the text below it may outweigh it.
                named = max(named, NAME_LEAST)
                if named < 0:
                    weight = min(weight, 0.0, own + named if own else named)
                elif weight < 0:
                    weight += max(own, named)
                else:
                    weight = max(weight, own, named)
            stack.append((tag, count, weight, mark, firm))
    for block in found:
        block.text = " ".join("".join(block.parts).split())
    return [b for b in found if b.text]


def features(block: Block) -> list[str]:
    """Binned properties of a block's text for the naive Bayes terms."""
    words = block.text.count(" ") + 1
    links = min(2, int(3 * block.link_chars / len(block.text)))
    end = block.text[-1] in ".!?:;\"')»”…"
    return [f"words{min(6, words.bit_length())}", f"links{links}", f"end{int(end)}", f"heading{int(block.tag in HEADINGS)}"]


def odds(block: Block, terms: dict[str, float]) -> float:
    return block.weight + sum(terms.get(f, 0.0) for f in features(block))


def ties(page: list[Block]) -> list[tuple[int, int, float]]:
    """(i, j, capacity) of neighbours and of children of one element."""
    found, last = [], {}
    for i, block in enumerate(page):
        parent = block.path[:-1] if block.tag != "" and len(block.path) > 1 else block.path
        if i:
            before = page[i - 1].path
            common = next((k for k, (x, y) in enumerate(zip(before, block.path)) if x != y), min(len(before), len(block.path)))
            found.append((i - 1, i, SMOOTH / (len(before) + len(block.path) - 2 * common + 1)))
        sibling = last.get(parent)
        if sibling is not None and sibling != i - 1:
            found.append((sibling, i, SMOOTH / 4))
        last[parent] = i
    return found


def minimum_cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source side of the minimum cut.

    A node whose terminal arc outweighs all its ties is on that terminal's side in some minimum cut;
    such nodes are settled first, and maximum flow labels what remains.
    """
    n = len(unary)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    unary, label = list(unary), [None] * n
    slack = [sum(x.values()) for x in near]
    waiting = deque(range(n))
    while waiting:
        i = waiting.popleft()
        if label[i] is None and abs(unary[i]) >= slack[i]:
            label[i] = unary[i] > 0
            for j, w in near[i].items():
                if label[j] is None:
                    unary[j] += w if label[i] else -w
                    slack[j] -= w
                    waiting.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        source = reachable(rest, unary, near)
        for i in rest:
            label[i] = i in source
    return [bool(x) for x in label]


def reachable(nodes: list[int], unary: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes that the source reaches after maximum flow by shortest augmenting paths."""
    inside = set(nodes)
    cap: dict[int, dict[int, float]] = {i: {j: w for j, w in near[i].items() if j in inside} for i in nodes}
    cap[-1], cap[-2] = {}, {}
    for i in nodes:
        if unary[i] > 0:
            cap[-1][i], cap[i][-1] = unary[i], 0.0
        else:
            cap[i][-2], cap[-2][i] = -unary[i], 0.0
    while True:
        came, queue = {-1: None}, deque([-1])
        while queue and -2 not in came:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > 1e-9 and v not in came:
                    came[v] = u
                    queue.append(v)
        if -2 not in came:
            return set(came) - {-1}
        path, v = [], -2
        while came[v] is not None:
            path.append((came[v], v))
            v = came[v]
        flow = min(cap[u][v] for u, v in path)
        for u, v in path:
            cap[u][v] -= flow
            cap[v][u] = cap[v].get(u, 0.0) + flow


def main_text(page: str | None, terms: dict[str, float]) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    chosen = minimum_cut([odds(b, terms) for b in found], ties(found))
    return "\n\n".join(b.text for b, keep in zip(found, chosen) if keep)


def fit(pages: DataFrame, html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> dict[str, float]:
    """Naive Bayes terms from about ``sample_pages`` random pages; at most a few dozen numbers are collected."""
    rows = pages.count()
    share = min(1.0, sample_pages / rows) if rows else 1.0
    sample = pages.select(F.col(html_col).cast("string").alias("html")).sample(False, share, seed=10)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, bool], int] = {}
            for value in batch.column(0):
                for block in blocks(value.as_py() or ""):
                    if block.marked:
                        for name in [*features(block), "all"]:
                            seen[name, block.marked > 0] = seen.get((name, block.marked > 0), 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.bool_()), pa.array(list(seen.values()), pa.int64())],
                names=["name", "content", "n"],
            )

    counted = sample.mapInArrow(count, "name string, content boolean, n bigint").groupBy("name", "content").agg(F.sum("n"))
    n = {(name, content): k for name, content, k in counted.collect()}
    totals = [n.get(("all", side), 0) for side in (False, True)]

    def term(name: str) -> float:
        odds = [math.log((n.get((name, side), 0) + 1) / (totals[side] + 2)) for side in (False, True)]
        return max(-2.0, min(2.0, odds[1] - odds[0]))

    return {name: term(name) for name, _ in n if name != "all"}


OUTPUT = StructType().add("text", StringType()).add("n_chars", LongType())


def extract(pages: DataFrame, html_col: str = "html", terms: dict[str, float] | None = None) -> DataFrame:
    """``pages`` with the main ``text`` and its ``n_chars`` code points."""
    terms = fit(pages, html_col) if terms is None else terms
    kept = [f for f in pages.schema.fields if f.name not in OUTPUT.names]
    keep_at = [pages.columns.index(f.name) for f in kept]
    html_at = pages.columns.index(html_col)
    names = [f.name for f in kept] + OUTPUT.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(value.as_py(), terms) for value in batch.column(html_at)]
            added = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep_at] + added, names=names)

    return pages.mapInArrow(run, StructType(kept + OUTPUT.fields))
