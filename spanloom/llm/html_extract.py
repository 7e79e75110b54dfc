"""Main text of HTML pages by minimum-cut labelling.

A page is cut into blocks of text. A logistic classifier of structural features (length, links, punctuation, depth,
siblings, words shared with the rest of the page) gives each block bounded log-odds of being content; elements and names
add evidence: an article element for it, a name of other parts against it, one that is a plain word too just as much
as the article is for it, so that structure decides, and sections that by their kind hold no article most. They become capacities to the two terminals. Blocks that follow
each other, or follow each other among one parent's children, are joined by edges that weigh more the closer they are in
the document tree. The minimum cut, by maximum flow, labels all blocks of a page at once.

A name is a whole class, id or role, or a compound all of whose words name such parts or are neutral (``cookie-notice``,
``related-posts``; not ``has-sidebar``, ``overflow-hidden``). An article element is never left out by its own name alone. What
is in an inline element only stands apart if it is named as an advert; a paragraph around it stays one.

The classifier is fitted in numpy, by Newton steps that are held near PRIOR, on the blocks of at most FIT_PAGES pages
(those that come first by a hash of their html, each once, of at most FIT_BYTES bytes): in pages with an article element, what is
inside it is content. Without such pages it is PRIOR itself. All pages are then labelled, whatever their size.

Null or empty html, and pages without content, give an empty text. Character references are decoded, white space in a
block becomes one space, blocks are joined by two line feeds; nothing else is dropped or cut. Tags need not be closed
and may end with the page. Very long pages and blocks are read whole. Equal pages get equal texts; order, ties and
repeated rows play no part in a page's labels; a tie in the cut is boilerplate; an empty table gives an empty result.
Other columns are kept, but text, n_chars and blocks are the operator's.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mrow msub msup msubsup mfrac msqrt mroot mover munder munderover mfenced mspace semantics".split()
)
#: Elements whose content is not markup, and those that hold no article text at all.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
NEVER = RAW | frozenset("head button select option datalist form fieldset svg canvas audio video object map dialog".split())
BOILERPLATE = frozenset("nav footer aside menu".split())
CONTENT = frozenset("article main".split())
#: What a start tag of these ends, if it is open nearer than the tags that bound it.
ENDS = {
    **dict.fromkeys(("li",), ({"li"}, {"ul", "ol", "menu"})),
    **dict.fromkeys(("dt", "dd"), ({"dt", "dd"}, {"dl"})),
    **dict.fromkeys(("td", "th"), ({"td", "th"}, {"tr", "table"})),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Words in class, id or role that name parts of a page other than its article. Fixed values.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted cookie cookies consent gdpr popup modal "
    "overlay newsletter subscribe subscription signup login paywall sidebar widget widgets related share sharing social recommended recommendations trending comment comments "
    "commentlist disqus respond reply replies menu nav navbar navigation navigations breadcrumb breadcrumbs pagination pager footer masthead topbar "
    "toolbar outbrain taboola searchbox complementary contentinfo".split()
)
#: Those of them that are plain words as well, and tell less. Fixed values.
WORDS = frozenset("banner notice notices notification alert popular follow discussion copyright legal disclaimer search skip".split())
#: Words that say nothing beside a name. Fixed values.
NEUTRAL = frozenset(
    "area article articles bar block bottom box button buttons col column container desktop div entry form global group heading icons inner item items left "
    "link links list main message mobile module news outer page panel post posts primary right row secondary section site slot stories text thread title top "
    "unit view wrap wrapper zone".split()
)
#: Names of inline elements that stand apart from the text around them. Fixed values.
ADVERTS = frozenset("ad ads advert adverts advertisement adsense sponsored promo".split())
#: Parts that hold article elements of their own, one for each comment or teaser.
LISTS = frozenset("comment comments commentlist disqus respond reply replies discussion related recommended recommendations trending popular".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Bound of the structural log-odds, and what elements and names add: in an article element; elsewhere in a page that has
#: one; in a part with a name, or with one that is a plain word too; in an article with such a name of its own; in a
#: section that by its kind holds no article. Plain words inside an article leave it to the structure, within its bound.
BOUND, INSIDE, OUTSIDE, NAMED, WORDED, OWN, SECTION = 4.0, 4.5, -5.0, -9.0, -4.5, -3.0, -14.0


@dataclass
class Node:
    tag: str
    parent: Node | None
    depth: int
    content: bool = False  # in an article element
    evidence: float = 0.0  # of names, 0 or less
    section: bool = False  # in a part that by its kind holds no article
    never: bool = False  # never text
    listed: bool = False
    open: int = 0  # of an inline element: elements of its tag that are open in it


@dataclass
class Block:
    node: Node
    paragraph: int
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _attributes(attrs: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attrs)}


def _names(attributes: dict[str, str]) -> set[str]:
    """The words that name a part: of whole names, or of compounds with neutral words only."""
    out: set[str] = set()
    for name in (*attributes.get("class", "").split(), *attributes.get("role", "").split(), attributes.get("id", ""), attributes.get("aria-label", "")):
        words = {w.lower() for w in _WORD.findall(name)}
        known = words & (NAMES | WORDS)
        if known and words <= known | NEUTRAL:
            out |= known
    return out


def _child(tag: str, attrs: str, parent: Node) -> Node:
    attributes = _attributes(attrs) if attrs else {}
    hidden = attributes.get("hidden", "false").lower() != "false" or attributes.get("aria-hidden", "").lower() == "true" or bool(_UNSEEN.search(attributes.get("style", "")))
    never = parent.never and tag not in ("body", "article", "main") or tag in NEVER or hidden
    names = _names(attributes) if attributes and tag not in ("html", "body") else set()
    child = Node(tag, parent, parent.depth + 1, parent.content, parent.evidence, parent.section, never, parent.listed)
    own = NAMED if names & NAMES else WORDED if names else 0.0
    if tag in CONTENT and not parent.listed:
        # Its own name never outweighs that it is an article; one of a comment or a teaser takes away that it is.
        child.content, child.section, child.evidence = not names & LISTS, False, max(OWN, own)
        return child
    child.listed = parent.listed or bool(names & LISTS)
    child.evidence = min(parent.evidence, own)
    if tag in BOILERPLATE or tag == "header" and not parent.content:
        # A page's header; that of an article holds its headline.
        child.section = True
    return child


def blocks_of(page: str) -> list[Block]:
    """The page's blocks with text, in order; pieces of one paragraph have its number."""
    node = Node("", None, 0)
    out, current, link, at, n, paragraph, gap = [], None, 0, 0, len(page), 0, ""

    def text(s: str) -> None:
        nonlocal current, gap
        if node.never or not s:
            return
        if current is None:
            if s.isspace():
                gap = " "
                return
            current = Block(node, paragraph, [gap] if out and out[-1].paragraph == paragraph else [])
            gap = ""
            out.append(current)
        s = html.unescape(s) if "&" in s else s
        current.parts.append(s)
        if link:
            current.linked += len(s.strip())

    match = _TOKEN.search(page)
    while match:
        text(page[at : match.start()])
        at = match.end()
        tag = (match["tag"] or match["tag2"] or "").lower()
        if tag:
            closing, attrs = bool(match["end"] or match["end2"]), match["attrs"] or match["attrs2"] or ""
            if tag in INLINE:
                if tag == "a":
                    link = 0 if closing else 1
                elif tag == "br" and current is not None:
                    current.parts.append(" ")
                if node.tag == tag and not closing:
                    node.open += 1
                elif node.tag == tag and node.open:
                    node.open -= 1
                elif node.tag == tag:
                    node, current = node.parent, None
                elif not closing and tag in ("span", "a") and attrs and (_names(_attributes(attrs)) & ADVERTS or _child(tag, attrs, node).never and not node.never):
                    # An advert or a hidden piece inside a paragraph: apart from it, up to its end tag.
                    node, current = _child(tag, attrs, node), None
            else:
                current, gap, paragraph = None, "", paragraph + 1
                if closing:
                    up = node
                    while up.parent is not None and up.tag != tag:
                        up = up.parent
                    if up.parent is not None:
                        node, link = up.parent, 0
                else:
                    ended, bound = ENDS.get(tag, ({"p"}, {"table", "li", "dd", "article", "section", "div", "blockquote"}) if tag != "option" else (set(), set()))
                    up = node
                    while up.parent is not None and up.tag not in ended and up.tag not in bound:
                        up = up.parent
                    if up.parent is not None and up.tag in ended:
                        node = up.parent
                    if tag not in VOID:
                        child = _child(tag, attrs, node)
                        if tag in RAW and not attrs.endswith("/"):
                            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                            at = end.end() if end else n
                        elif tag == "body":
                            node = Node(tag, Node("", None, 0), 1)
                        else:
                            node = child
                            link = 0
        match = _TOKEN.search(page, at)
    text(page[at:])
    for b in out:
        b.text = " ".join("".join(b.parts).split())
    return [b for b in out if b.text]


#: Structural features of a block, and weights that a fit starts from and is held to.
FEATURES = ("one", "log_words", "few_words", "linked", "ends_sentence", "punctuation", "heading", "paragraph", "item", "depth", "log_siblings", "log_sibling_text", "shared_words", "at_end")
PRIOR = np.array([-3.0, 0.5, -0.5, -3.2, 0.3, 0.7, 2.2, 2.0, -0.7, -0.3, 0.3, 0.6, 1.0, -0.5])
FIT_PAGES, FIT_BYTES, HOLD = 400, 65_536, 0.5
#: Most that an edge weighs; one between neighbouring children of one parent weighs 2, and a fifth with each step farther apart.
NEAREST = 3.0
_SENTENCE_END = frozenset(".!?…:;\"”»)")
_PUNCTUATION = frozenset(".,;:!?")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PARAGRAPHS = frozenset("p blockquote pre figcaption".split())
_ITEMS = frozenset("li dt dd td th".split())


def features(blocks: list[Block]) -> np.ndarray:
    """(blocks, FEATURES) of one page's blocks, from their text and place in the tree; no names of classes or sections."""
    words = [b.text.split() for b in blocks]
    kinds = [set(ws) for ws in words]
    seen: Counter = Counter()
    for k in kinds:
        seen.update(k)
    shared = {w for w, n in seen.items() if n > 1}
    group = Counter((id(b.node.parent), b.node.tag) for b in blocks)
    size: Counter = Counter()
    for b in blocks:
        size[id(b.node.parent)] += len(b.text)
    middle, last, rows = float(np.median([b.node.depth for b in blocks])), len(blocks) - 1, []
    for i, (b, ws, k) in enumerate(zip(blocks, words, kinds, strict=True)):
        text, n, tag = b.text, len(ws), b.node.tag
        marks = sum(map(text.count, _PUNCTUATION))
        rows.append((
            1.0, math.log1p(min(n, 200)), n < 4, min(1.0, b.linked / len(text)), text[-1] in _SENTENCE_END, min(1.0, 4 * marks / n), tag in _HEADINGS, tag in _PARAGRAPHS, tag in _ITEMS,
            min(4.0, abs(b.node.depth - middle)), math.log(min(50, group[id(b.node.parent), tag])), math.log1p(min(20_000, size[id(b.node.parent)])) - 5, len(k & shared) / len(k), i in (0, last),
        ))
    return np.array(rows, float)


def named(blocks: list[Block]) -> np.ndarray:
    """What elements and names say, as log-odds."""
    has = any(b.node.content for b in blocks)
    return np.array([SECTION if b.node.section else (INSIDE if b.node.content else OUTSIDE if has else 0.0) + b.node.evidence for b in blocks])


def taught(blocks: list[Block]) -> np.ndarray:
    """Labels by elements and names alone: 1 in an article element, 0 elsewhere or in a part with a name, NaN where the name is a plain word too."""
    return np.array([0.0 if b.node.section or not b.node.content or b.node.evidence <= NAMED else 1.0 if b.node.evidence == 0 else np.nan for b in blocks])


def fit(pages: list[str], prior: np.ndarray = PRIOR, hold: float = HOLD) -> np.ndarray:
    """Weights of the structural features by weak labels; pages without an article element teach nothing."""
    x, y = [np.zeros((0, len(prior)))], [np.zeros(0)]
    for page in pages:
        blocks = blocks_of(page)
        label = taught(blocks) if blocks else np.zeros(0)
        if (label == 1).any():
            known = ~np.isnan(label)
            x.append(features(blocks)[known])
            y.append(label[known])
    x, y = np.concatenate(x), np.concatenate(y)
    if len(set(y.tolist())) < 2:
        return prior
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = prior.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = x.T @ (weight * (y - p)) - hold * (w - prior)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + hold * np.eye(len(w)), pull)
        w = w + step * min(1.0, 4.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return w


def scores(blocks: list[Block], weights: np.ndarray = PRIOR) -> np.ndarray:
    """How much more each block looks like content than like boilerplate, as log-odds."""
    return np.clip(features(blocks) @ weights, -BOUND, BOUND) + named(blocks)


def _distance(a: Node, b: Node) -> int:
    """Steps between two nodes of the tree; into or out of a part that is no article's by its kind or name, two more."""
    apart = [x.section or x.evidence <= NAMED for x in (a, b)]
    steps = 2 if apart[0] != apart[1] else 0
    while a is not b and steps < 12:
        if a.depth >= b.depth:
            a = a.parent or b
        else:
            b = b.parent or a
        steps += 1
    return steps


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """(i, j, weight): neighbours in order, nearer in the tree weighing more, and next blocks under one parent."""
    out, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            out.append((i - 1, i, min(NEAREST, 2.0 * 5.0 ** (2 - _distance(blocks[i - 1].node, b.node)))))
        key = id(b.node.parent)
        if (j := last.get(key)) is not None and j < i - 1:
            out.append((j, i, 0.5))
        last[key] = i
    return out


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the content side of a minimum cut: shortest augmenting paths, level by level.

    A positive score is a capacity from the content terminal, a negative one to the boilerplate terminal; an edge
    carries its weight either way. Ties go to boilerplate's side: only what the source still reaches is content.
    """
    n = len(scores)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to, room = [], []

    def add(a: int, b: int, there: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(there)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, s in enumerate(scores):
        if s > 0:
            add(source, i, s, 0.0)
        elif s < 0:
            add(i, sink, -s, 0.0)
    for a, b, w in edges:
        add(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source], queue = 0, [source]
        for a in queue:
            for e in head[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        tried, path, a = [0] * (n + 2), [], source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                cut = next(k for k, e in enumerate(path) if room[e] <= flow)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while tried[a] < len(head[a]):
                e = head[a][tried[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                tried[a] += 1
            else:
                if a == source:
                    break
                e = path.pop()
                a = to[e ^ 1]
                tried[a] += 1
                continue
            path.append(e)
            a = to[e]


def main_blocks(page: str | None, weights: np.ndarray = PRIOR) -> list[str]:
    blocks = blocks_of(page) if page else []
    if not blocks:
        return []
    keep = minimum_cut(scores(blocks, weights).tolist(), edges_of(blocks))
    # What is kept of a paragraph is one block again.
    paragraphs: dict[int, list[str]] = {}
    for b, k in zip(blocks, keep, strict=True):
        if k:
            paragraphs.setdefault(b.paragraph, []).extend(b.parts)
    return [" ".join("".join(parts).split()) for parts in paragraphs.values()]


def fitted(pages: DataFrame, column: str = "html", most: int = FIT_PAGES) -> np.ndarray:
    """Weights from at most ``most`` of the pages that have an article element."""
    h = F.col(f"`{column}`")
    marked = pages.select(h.alias("h")).where(h.rlike(r"(?i)<(article|main)[\s>]") & (F.octet_length(h) <= FIT_BYTES)).withColumn("k", F.xxhash64("h"))
    # The hashes of the first pages, and then these pages: no task holds more than it sends.
    first = [r.k for r in marked.select("k").distinct().orderBy("k").limit(most).collect()]
    if not first:
        return PRIOR
    rows = marked.where(F.col("k") <= first[-1]).groupBy("k").agg(F.min("h").alias("h")).collect()
    return fit([r.h for r in sorted(rows, key=lambda r: r.k)])


def extracted(pages: DataFrame, column: str = "html", weights: np.ndarray | None = None) -> DataFrame:
    """``pages`` without html, with text, n_chars (code points) and blocks (the text's blocks). ``weights``: of a classifier fitted elsewhere."""
    own = [c for c in pages.columns if c not in (column, "text", "n_chars", "blocks")]
    df = pages.select(*[f"`{c}`" for c in own], pages[column].alias("__html"))
    w = fitted(pages, column) if weights is None else weights

    def kernel(t: pa.Table):
        blocks = [main_blocks(p, w) for p in t.column("__html").to_pylist()]
        text = ["\n\n".join(b) for b in blocks]
        t = t.drop_columns(["__html"]).append_column("text", pa.array(text, pa.string()))
        t = t.append_column("n_chars", pa.array(np.fromiter(map(len, text), np.int64, len(text))))
        yield t.append_column("blocks", pa.array(blocks, pa.list_(pa.string())))

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in own), "text string, n_chars bigint, blocks array<string>"])
    return arrow_map(df, kernel, schema, "__html")
