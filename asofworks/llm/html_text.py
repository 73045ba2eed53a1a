"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element is a node with three states: structure (it holds other
parts of the page), content, and boilerplate. A node's potential comes from its tag with its link density, the hints in its
class, id and role, and the length of its text; an edge's potential from the
states of parent and child. Messages pass from the leaves up and from the root
down (sum-product), which gives each node's exact marginal; the text of nodes
whose marginal of content is at least one half is kept.

The potentials are counts from labelled pages: those that mark their article
(article or main element, or a role of that kind). Inside it is content,
except elements that the markup itself names as something else. Marks of the
article are hidden from half of the pages' counts, so that pages without them
are told by the rest. Fixed odds stand in for markup that the labelled pages do
not show, and fade as they show it.

Defined results: a null or empty page has an empty text; a page without any
tag is its own text. Unclosed and misnested elements are closed as HTML's
rules for paragraphs, list items and table parts say; a tag cut off at the end
of a page is dropped. br is white space. Repeated rows get equal texts. A node
whose marginal is exactly one half is kept. A page of any length is read whole,
in time linear in its length, however its markup is broken. An empty table gives
an empty result. Kept columns named like a result are replaced.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField

from .common import Texts, annotate, hash_sample

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg math textarea select option button iframe object audio video canvas head title datalist".split())
RAW = frozenset("script style textarea title noscript iframe".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: A start tag closes an open element of these, up to one of those.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
# Words of class, id and role names.
NOT_CONTENT = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer contentinfo sidebar aside complementary rail widget comment comments commentlist respond reply replies disqus discussion cookie cookies consent gdpr notice notices alert warning popup modal overlay dialog newsletter subscribe subscription signup login register form search share sharing social related recommended recommendations more pagination pager toolbar skip copyright legal disclaimer tags metadata byline hidden".split())
CONTENT = frozenset("article articlebody content main post entry story body text maincontent prose".split())
NAMES_ARTICLE = frozenset(("article", "main"))
NAMES_OTHER = frozenset("nav header footer aside form menu search dialog".split())

#: What begins a comment, a declaration or a tag; the rest of a tag, with quoted values and without regard to quotes.
BEGINS = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
REST = re.compile(r"([^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+)>")
PLAIN_REST = re.compile(r"([^>]*+)>")
#: What ends a comment that has just begun, any comment, and a declaration.
EMPTY_COMMENT = re.compile("-?>")
COMMENT_END = re.compile("--!?>")
DECLARATION_END = re.compile(">")
NAMED = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Node:
    tag: str
    parent: int
    hint: int  # -1: names of boilerplate, 1: of content, 0: none
    role: bool  # marks an article
    chars: int = 0  # of text, with all below it
    linked: int = 0
    children: list[int] = field(default_factory=list)


def hints(attributes: str) -> tuple[int, bool]:
    good = bad = role = False
    for name, value in NAMED.findall(attributes):
        if name.lower() == "hidden":
            bad = True
        parts = [x.lower() for x in PART.findall(value)] + [value.strip("\"'").lower()]
        bad |= any(x in NOT_CONTENT for x in parts)
        good |= any(x in CONTENT for x in parts)
        role |= name.lower() == "role" and ("main" in parts or "article" in parts)
    return (-1 if bad else 1 if good else 0), role and not bad


def parse(page: str) -> tuple[list[Node], list[tuple[int, str] | None]]:
    """Nodes in the page's order (the first is the root), and runs of (node, text) with None where a block begins or ends.

    Linear in the page's length, whatever it holds: no search begins again where
    an earlier one ended without success, and open elements are found by tag.
    """
    nodes, runs = [Node("body", -1, 0, False)], []
    stack: list[tuple[str, int]] = []  # open elements and the node that their text belongs to
    places: dict[str, list[int]] = {}  # where elements of each tag stand in the stack
    blocks: list[int] = []  # where block elements do
    here, hidden, at, end = 0, 0, 0, len(page)
    links = 0
    rest = REST  # until a tag's quotes are not closed

    def text(raw: str) -> None:
        if raw and not hidden:
            runs.append((here, raw))
            n = len(raw) - raw.count(" ")
            nodes[here].chars += n
            if links:
                nodes[here].linked += n

    def close(k: int) -> None:
        """Closes the open elements from place k on."""
        nonlocal here, hidden, links
        if blocks and blocks[-1] >= k:
            runs.append(None)
        while len(stack) > k:
            tag, _ = stack.pop()
            places[tag].pop()
            hidden -= tag in HIDDEN
            links -= tag == "a"
        while blocks and blocks[-1] >= k:
            blocks.pop()
        here = stack[-1][1] if stack else 0

    def last(tags) -> int:
        """The place of the innermost open element of tags; -1: there is none."""
        return max((own[-1] for t in tags if (own := places.get(t))), default=-1)

    while at < end:
        m = BEGINS.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            stop = (EMPTY_COMMENT.match(page, at) or COMMENT_END.search(page, at)) if m[0] == "<!--" else DECLARATION_END.search(page, at)
            if stop is None:  # cut off
                break
            at = stop.end()
            continue
        tag = m[2].lower()
        r = rest.match(page, at)
        if r is None:
            rest = PLAIN_REST
            r = rest.match(page, at)
            if r is None:  # cut off
                break
        at, attributes = r.end(), r[1]
        if m[1]:
            if (k := last((tag,))) >= 0:
                close(k)
            continue
        if tag in ENDS_P and not hidden and blocks and stack[blocks[-1]][0] == "p":
            close(blocks[-1])
        if tag in CLOSES:
            own, stop = CLOSES[tag]
            if (k := last(own)) > last(stop):
                close(k)
        if tag in VOID:
            if tag == "br":
                text(" ")
            elif tag == "hr":
                runs.append(None)
            continue
        if tag in RAW:  # up to its end tag, whatever stands there
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            close_at = page.find(">", stop.end()) if stop else -1
            at = close_at + 1 if close_at >= 0 else end
            continue
        if tag in ("html", "body"):
            continue
        if tag in BLOCK:
            runs.append(None)
            blocks.append(len(stack))
        hint, role = hints(attributes) if attributes else (0, False)
        if (tag in BLOCK or hint < 0) and not hidden:
            nodes.append(Node(tag, here, hint, role))
            nodes[here].children.append(len(nodes) - 1)
            here = len(nodes) - 1
        hidden += tag in HIDDEN
        links += tag == "a"
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, here))
    for i in range(len(nodes) - 1, 0, -1):
        nodes[nodes[i].parent].chars += nodes[i].chars
        nodes[nodes[i].parent].linked += nodes[i].linked
    return nodes, runs


def evidence(n: Node, blind: bool = False) -> list[tuple[str, str]]:
    """A node's features; blind: without what marks an article."""
    tag, hint = n.tag, n.hint
    if blind and (tag in ("article", "main") or n.role):
        tag, hint = "div", 0
    density = n.linked / n.chars if n.chars else 0
    size = "0" if not n.chars else "s" if n.chars <= 25 else "m" if n.chars <= 100 else "l"
    return [("tag", f"{tag} {'links' if density > 0.5 else 'plain'}"), ("hint", str(hint)), ("size", size)]


STRUCTURE, TEXT, OTHER = range(3)


def labels(nodes: list[Node]) -> list[int] | None:
    """Each node's state on a page that marks its article; None on other pages."""
    marked = [n.tag in ("article", "main") or n.role for n in nodes]
    if not any(marked):
        return None
    above = [False] * len(nodes)  # holds an article
    for i in range(len(nodes) - 1, 0, -1):
        above[nodes[i].parent] |= marked[i] or above[i]
    out = []
    for i, n in enumerate(nodes):
        inside = marked[i] or (n.parent >= 0 and out[n.parent] == TEXT)
        out.append(TEXT if inside and n.tag not in NAMES_OTHER and n.hint >= 0 else STRUCTURE if above[i] else OTHER)
    return out


# Fixed odds (structure, content, boilerplate), for what labelled pages may not show.
PRIOR = {
    **{("tag", f"{t} {k}"): (0.1, 0.1, 40.0) for t in NAMES_OTHER for k in ("plain", "links")},
    **{("tag", f"{t} {k}"): (1.0, 60.0, 0.5) for t in NAMES_ARTICLE for k in ("plain", "links")},
    **{("tag", f"{t} plain"): (0.5, 12.0, 2.0) for t in "p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption".split()},
    **{("tag", f"{t} plain"): (1.0, 4.0, 4.0) for t in "ul ol li dl dd dt table tbody tr td th hgroup details summary".split()},
    **{("tag", f"{t} plain"): (8.0, 4.0, 4.0) for t in ("div", "section", "center", "body")},
    **{("tag", f"{t} links"): (1.0, 1.0, 20.0) for t in "div section li ul ol dl dd dt table tbody tr td th p".split()},
    ("hint", "-1"): (0.02, 0.02, 60.0),
    ("hint", "1"): (4.0, 20.0, 1.0),
}
#: Nodes with a feature value after which what labelled pages show counts as much as fixed odds.
TRUST = 50
EDGE_PRIOR = ((15.0, 5.0, 10.0), (0.01, 60.0, 15.0), (0.005, 0.005, 60.0))
#: Labelled pages weigh no more than this against an edge's pseudo-counts: pages of one make must not rule out others.
MOST_EDGES = 100
ROOT = (0.9, 0.095, 0.005)
#: How far a feature may tell states apart, in logarithms, so that none decides alone: names of other parts may more.
MOST_ODDS = {"tag": 3.0, "size": 0.5, "hint": 8.5}
MOST_BY_NAME = 6.0
#: Less for article itself: a reader's comment may be one.
MOST_BY_ARTICLE = 4.5


@dataclass
class TreeModel:
    """weight[feature]: a factor for each state; edge[parent state][child state]: probability."""

    weight: dict[tuple[str, str], tuple[float, ...]]
    edge: list[list[float]]

    @classmethod
    def of(cls, counts: Counter) -> TreeModel:
        """From counts of ("f", name, value, state) and ("e", parent state, child state)."""
        seen: dict[tuple[str, str], list[float]] = {}
        total = Counter()
        for key, n in counts.items():
            if key[0] == "f":
                seen.setdefault((key[1], key[2]), [0.0] * 3)[int(key[3])] += n
                total[key[1], int(key[3])] += n
        weight = {}
        for name, value in seen.keys() | PRIOR.keys():
            own, prior = seen.get((name, value), [0.0] * 3), PRIOR.get((name, value), (1.0, 1.0, 1.0))
            share = [own[s] / max(1, total[name, s]) for s in range(3)]
            trust = sum(own) / (sum(own) + TRUST)
            mixed = [trust * share[s] / (max(share) or 1) + (1 - trust) * prior[s] / max(prior) for s in range(3)]
            tag = value.split()[0] if name == "tag" else ""
            most = MOST_BY_NAME if tag in NAMES_OTHER else MOST_BY_ARTICLE if tag in NAMES_ARTICLE else MOST_ODDS[name]
            weight[name, value] = tuple(max(math.exp(-most), v / max(mixed)) for v in mixed)
        edge = []
        for s in range(3):
            seen_edges = [counts.get(("e", str(s), str(t)), 0) for t in range(3)]
            scale = min(1.0, MOST_EDGES / max(1, sum(seen_edges)))
            own = [EDGE_PRIOR[s][t] + scale * seen_edges[t] for t in range(3)]
            edge.append([x / sum(own) for x in own])
        return cls(weight, edge)

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of each node, by one pass up and one down."""
        e, n, get = self.edge, len(nodes), self.weight.get
        even = (1.0, 1.0, 1.0)
        belief = []  # local evidence and, later, all from below
        for x in nodes:
            a, b, c = 1.0, 1.0, 1.0
            for k in evidence(x):
                w = get(k, even)
                a, b, c = a * w[0], b * w[1], c * w[2]
            s = a + b + c
            belief.append([a / s, b / s, c / s])
        up: list = [even] * n  # message to the parent, a value for each of its states
        for i in range(n - 1, 0, -1):
            b = belief[i]
            up[i] = [r[0] * b[0] + r[1] * b[1] + r[2] * b[2] for r in e]
            own = belief[nodes[i].parent]
            own[:] = [x * y for x, y in zip(own, up[i], strict=True)]
            s = sum(own)
            own[:] = [x / s for x in own]
        belief[0] = [x * y for x, y in zip(belief[0], ROOT, strict=True)]
        out = [0.0] * n
        for i in range(n):
            if i:
                # all that the parent knows, less what came from here
                d = [x / y for x, y in zip(belief[nodes[i].parent], up[i], strict=True)]
                belief[i] = [b * (d[0] * e[0][t] + d[1] * e[1][t] + d[2] * e[2][t]) for t, b in enumerate(belief[i])]
            s = sum(belief[i])
            belief[i] = [x / s for x in belief[i]]
            out[i] = belief[i][TEXT]
        return out


def main_text(page: str, model: TreeModel) -> str:
    if "<" not in page:
        return " ".join(html.unescape(page).split())
    nodes, runs = parse(page)
    keep = [p >= 0.5 for p in model.marginals(nodes)]
    blocks, own = [], []
    for run in [*runs, None]:
        if run is None:
            if own and (line := " ".join(html.unescape("".join(own)).split())):
                blocks.append(line)
            own = []
        elif keep[run[0]]:
            own.append(run[1])
    return "\n".join(blocks)


def page_counts(page: str) -> list[tuple[str, ...]]:
    nodes, _ = parse(page)
    states = labels(nodes)
    if states is None:
        return []
    blind = crc32(page.encode("utf-8", "replace")) % 2 == 1
    out = []
    for x, s in zip(nodes, states, strict=True):
        out += [("f", name, value, str(s)) for name, value in evidence(x, blind)]
        if x.parent >= 0:
            out.append(("e", str(states[x.parent]), str(s)))
    return out


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_pages: int = 2_000) -> TreeModel:
    """Potentials from the labelled ones of about max_pages pages; their counts are summed by Spark."""
    sample = hash_sample(pages.where(F.col(html_col).isNotNull()).select(id_col, html_col), [id_col, html_col], max_pages)
    kind = ArrayType(ArrayType(StringType()))
    found = annotate(sample, [StructField("found", kind)], lambda: lambda b: [pa.array([page_counts(p) for p in Texts(b.column(html_col)).strings()], pa.list_(pa.list_(pa.string())))], [html_col], [], html_col)
    rows = found.select(F.explode("found").alias("key")).groupBy("key").count().collect()  # a row for each feature value
    return TreeModel.of(Counter({tuple(r["key"]): r["count"] for r in rows}))


def extract(pages: DataFrame, model: TreeModel, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """keep (default: all columns of pages), text and n_chars."""

    def f(batch: pa.RecordBatch) -> list:
        texts = [main_text(p, model) if p else "" for p in Texts(batch.column(html_col)).strings()]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return annotate(pages, [StructField("text", StringType()), StructField("n_chars", LongType())], lambda: f, [html_col], pages.columns if keep is None else keep, html_col)
