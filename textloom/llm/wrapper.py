"""Main text of web pages by wrapper induction.

A page is parsed to a tree. For alignment the tree is reduced to a skeleton: block elements only, runs of like siblings and of flow
content (paragraphs, lists, tables, ..) as one node. Pages of a host that share a skeleton are counted together, so induction works on the
few skeletons of a host, however many pages it has, and every page counts:

1. each page gives its skeleton and a hash of each block of text with its slot (skeleton node); grouped counts follow;
2. a host's ``TEMPLATE_TREES`` most frequent skeletons grow its template by simple tree matching. Then every skeleton of the host is aligned to
   the template by itself, so a host of very many layouts is spread over tasks; a node that the template lacks is known by its way from the
   node above it. A block that stands in one aligned slot on
   ``MIN_PAGES`` pages of different text at least, and on half of the host's, is template, inside an article as elsewhere, and its varying
   neighbours may be content (copies of a page count once, and a page of template blocks alone keeps them: copies must not empty it);
3. of the varying slots those of the page's article or main element are content or, where there is none or it holds less than 1 - ``MASS`` of the varying text, those of the smallest element that
   holds ``MASS`` of the varying text, looked for below elements without text of their own. Navigation, headers, footers, sidebars, forms, scripts, styles and what is hidden or has such a role
   are never content, but for a form around the page's only main elements, or around all of a page with text paragraphs: it loses its controls. An element that only a class or id, a heading of its own ("Reader comments") or its place (an article in an article) names as a notice, advert, comments and the like is not content either, unless the page's only main elements are in it, it is a
   varying paragraph of ``LARGE`` characters or more, or it holds ``NEARLY_ALL`` of the varying text.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import bounded_batches, materialize, text_of

MIN_PAGES = 3
MASS = 0.6
#: What an element named as noise must hold to be content all the same: characters a page, and the share of the varying text.
LARGE = 80
NEARLY_ALL = 0.9
#: Blocks nested deeper than this belong to the skeleton node above them.
DEEPEST = 64
#: The skeletons that make a host's template; all others are aligned to it.
TEMPLATE_TREES = 256

# Element names of HTML and the words by which pages name what is not content.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea noscript xmp iframe noembed noframes template".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
FLOW = set("p ul ol dl li dt dd blockquote pre figure figcaption table h2 h3 h4 h5 h6 hr address details summary".split())
CLOSES_P = FLOW | set("div section article main aside nav header footer form h1 fieldset center".split())
DROPPED = set("head title nav aside footer form script style noscript template textarea button select svg canvas iframe object embed menu dialog map audio video".split())
NOISE = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice alert popup modal overlay "
    "newsletter subscribe subscription signup share sharing social related recommended recommendations trending comment comments reply replies respond disqus discussion widget toolbar pagination pager login search skip".split()
)
#: Words that may stand beside a word of NOISE in one class name (``sidebar-left``); any other word there changes its meaning (``has-sidebar``).
NEUTRAL = set("area bar block box bottom container inner item items left link links list outer page post posts primary right secondary section site text top wrap wrapper".split())
NAMED = "!prose", "!noise"
PROSE = set("p blockquote pre dd h2 h3 h4 h5 h6".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: What a page-wide form loses when it is opened, and the heading by which a section says that it holds comments.
CONTROLS = set("label legend fieldset option optgroup output datalist".split())
COMMENTS = re.compile(r"(?i)\W*(?:\d+\s+)?(?:(?:reader|user|visitor|guest|recent|latest|all|leave an?|post an?|add an?|write an?|your)\s+)?(?:comments?|replies|reply)\W*(?:\d+\W*)?")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Node:
    tag: str
    attrs: dict
    up: Node | None = None
    items: list = field(default_factory=list)  # nodes and strings in page order
    named: bool = False  # a class or id calls it noise
    lost: bool = False  # inside noise of any kind
    holds: bool = False  # a main element is below it


class Root(Node):
    free = False  # some main element is not inside noise


def parse(page: str) -> Node:
    """A forgiving parser: void and raw-text elements, implied ends of p, li, dt, dd, option and table parts, stray ends ignored."""
    root = at = Root("#root", {})
    pos, size = 0, len(page)
    while pos < size:
        m = _TOKEN.search(page, pos)
        if not m:
            at.items.append(page[pos:])
            break
        if m.start() > pos:
            at.items.append(page[pos : m.start()])
        pos = m.end()
        end, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if end:
            up = at
            while up.up and up.tag != tag:
                up = up.up
            if up.up:
                at = up.up
            continue
        if tag in CLOSES_P:
            at = _ended(at, {"p"}, {"button", "td", "th", "li", "object"})
        if tag == "li":
            at = _ended(at, {"li"}, {"ul", "ol", "menu"})
        elif tag in ("dt", "dd"):
            at = _ended(at, {"dt", "dd"}, {"dl"})
        elif tag in ("td", "th"):
            at = _ended(at, {"td", "th"}, {"tr", "table"})
        elif tag in ("tr", "tbody", "thead", "tfoot"):
            at = _ended(at, {"tr"} if tag == "tr" else {"tbody", "thead", "tfoot"}, {"table"})
        elif tag == "option":
            at = _ended(at, {"option"}, {"select"})
        node = Node(tag, {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTR.findall(attrs)} if attrs.strip(" /") else {}, at)
        at.items.append(node)
        node.named = bool(node.attrs) and tag not in ("html", "body", "main") and (_names_noise(node.attrs.get("class")) or _names_noise(node.attrs.get("id")))
        node.lost = at.lost or at.named and at.tag != "article" or _is_dropped(at, False)
        if _is_main(node):
            root.free |= not node.lost and (tag == "article" or not node.named)
            up = at
            while up and not up.holds:
                up.holds, up = True, up.up
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, pos)
            pos = stop.end() if stop else size
        elif tag not in VOID and not attrs.endswith("/"):
            at = node
    return root


def _ended(at: Node, tags: set, within: set) -> Node:
    """Where to go on when a start tag ends an open element of ``tags``, looked for no higher than ``within`` or a section."""
    up = at
    while up.up and up.tag not in within and up.tag not in ("article", "main", "section", "div", "body", "aside", "nav", "header", "footer", "form") or up.tag in tags:
        if up.tag in tags:
            return up.up
        up = up.up
    return at


def _names_noise(v: str | None) -> bool:
    """Whether a class name, as a whole, is a word of NOISE, or such words with neutral ones or numbers."""
    for token in (v or "").split():
        words = {x.lower() for x in _PARTS.findall(token)}
        if token.lower() in NOISE or words & NOISE and all(w in NOISE or w in NEUTRAL or w.isdigit() for w in words):
            return True
    return False


def _is_dropped(n: Node, inside: bool) -> bool:
    """Never content, by its element, role or a hidden state."""
    if n.tag in DROPPED or n.tag == "header" and not inside:
        return True
    if not n.attrs or n.tag in ("html", "body", "main"):
        return False
    return "hidden" in n.attrs or n.attrs.get("aria-hidden") == "true" or (n.attrs.get("role") or "").lower() in NOISE_ROLES


def _mostly_links(n: Node) -> bool:
    chars, linked, todo = 0, 0, [(n, False)]
    while todo:
        at, link = todo.pop()
        for x in at.items:
            if isinstance(x, str):
                k = len("".join(x.split()))
                chars, linked = chars + k, linked + k * link
            else:
                todo.append((x, link or x.tag == "a"))
    return 2 * linked > chars


def _is_comments(n: Node) -> bool:
    """An article within an article, which is what HTML calls a comment on it, or a section under a heading that says so."""
    if n.tag not in ("article", "section", "div"):
        return False
    up = n.up if n.tag == "article" else None
    while up:
        if up.tag == "article":
            return True
        up = up.up
    at = n
    while at.tag in ("article", "section", "div", "header"):
        at = next((x for x in at.items if not isinstance(x, str) or x.strip()), None)
        if at is None or isinstance(at, str):
            return False
    return at.tag in HEADINGS and COMMENTS.fullmatch(_said(at)) is not None


def _said(n: Node) -> str:
    out, todo = [], [n]
    while todo:
        at = todo.pop()
        if isinstance(at, str):
            out.append(at)
        else:
            todo += reversed(at.items)
    return entities.unescape("".join(out)).strip()


def _has_prose(n: Node) -> bool:
    """Whether some text paragraph with words is below."""
    todo = [n]
    while todo:
        at = todo.pop()
        if at.tag in PROSE and _said(at):
            return True
        todo += [x for x in at.items if not isinstance(x, str)]
    return False


def _is_main(n: Node) -> bool:
    return n.tag in ("article", "main") or n.attrs.get("role") == "main" or n.attrs.get("itemprop") == "articleBody"


class Page:
    """``tree``: the skeleton as nested (label, children); ``blocks``: (slot, text) in page order; ``mains``: slots inside a main element.

    An element that is named as noise is one skeleton node with all that is below it: ``!prose`` if it is a text paragraph, else ``!noise``.
    """

    def __init__(self, page: str):
        self.labels: list[str] = []
        self.children: list[list[int]] = []
        self.depth: list[int] = []
        self.mains: set[int] = set()
        self.blocks: list[tuple[int, str]] = []
        self._text: list[str] = []
        self._slot = self._new("#root")
        root = parse(page)
        self._spare, self._open = not root.free, False
        self._walk(root, self._slot, False)
        self._flush()
        if not self.blocks and "<form" in page.lower():  # all of the page is in a form
            self._open = True
            self._walk(root, self._slot, False)
            self._flush()

    def _new(self, label: str) -> int:
        self.labels.append(label)
        self.children.append([])
        self.depth.append(0)
        return len(self.labels) - 1

    def _flush(self) -> None:
        text = " ".join(entities.unescape("".join(self._text)).split())
        self._text = []
        if text:
            self.blocks.append((self._slot, text))

    def _walk(self, n: Node, slot: int, inside: bool) -> None:
        # iterative, as pages may be nested deeply; the last entries of a frame say whether its element is a block and inside noise by name
        stack = [(iter(n.items), slot, inside, True, False)]
        while stack:
            items, slot, inside, block, noisy = stack[-1]
            for x in items:
                if isinstance(x, str):
                    self._text.append(x)
                elif x.tag in ("br", "hr"):
                    self._text.append(" ")
                elif _is_dropped(x, inside) and not self._is_page_wide(x) or self._open and x.tag in CONTROLS or (named := self._is_noise(x, inside)) and (x.tag in INLINE or not noisy and self.depth[slot] >= DEEPEST):
                    if x.tag not in INLINE:
                        self._flush()
                elif x.tag in INLINE:
                    stack.append((iter(x.items), slot, inside, False, noisy))
                    break
                else:
                    self._flush()
                    main = inside or _is_main(x)
                    if noisy:
                        self._slot = slot
                    elif named:
                        self._slot = self._child(slot, "!prose" if x.tag in PROSE and not _mostly_links(x) else "!noise")
                    else:
                        self._slot = self._place(x, slot)
                    if main:
                        self.mains.add(self._slot)
                    stack.append((iter(x.items), self._slot, main, True, noisy or named))
                    break
            else:
                stack.pop()
                if block:
                    self._flush()
                    self._slot = stack[-1][1] if stack else 0

    def _is_page_wide(self, x: Node) -> bool:
        """A form around the page's main elements, all of which are in noise, or around all that a page has."""
        form = x.tag == "form" or x.tag not in DROPPED and (x.attrs.get("role") or "").lower() == "form"
        return form and (x.holds and self._spare or self._open and _has_prose(x))

    def _is_noise(self, x: Node, inside: bool) -> bool:
        """Named or headed as noise; an outermost article is not, nor is what holds the page's main elements if all of them are in such elements."""
        return (x.named or _is_comments(x)) and not (not inside and (x.tag == "article" or x.holds and self._spare))

    def _place(self, x: Node, slot: int) -> int:
        """The skeleton node of a block element under ``slot``: flow content joins flow, a like sibling its neighbour."""
        if x.tag in FLOW and self.labels[slot] == "flow":
            return slot
        return self._child(slot, "flow" if x.tag in FLOW else ".".join([x.tag, *sorted((x.attrs.get("class") or x.attrs.get("id") or "").split())]))

    def _child(self, slot: int, name: str) -> int:
        last = self.children[slot][-1] if self.children[slot] else -1
        if last >= 0 and self.labels[last] == name:
            return last
        if self.depth[slot] >= DEEPEST:
            return slot
        self.children[slot].append(to := self._new(name))
        self.depth[to] = self.depth[slot] + 1
        return to

    def key(self) -> int:
        """Hash of all text that is not named as noise, or of that if there is no other: equal for copies of a page."""
        own = [t for s, t in self.blocks if self.labels[s] not in NAMED] or [t for _, t in self.blocks]
        return key_of("\n".join(own))

    def skeleton(self) -> str:
        out = []
        for i, label in enumerate(self.labels):
            out.append(f"{label.replace(chr(9), ' ')}{chr(9)}{','.join(map(str, self.children[i]))}{chr(9)}{int(i in self.mains)}")
        return "\n".join(out)


def key_of(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def host_of(url: str | None) -> str:
    m = re.match(r"(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(url, html) to rows (host, skel, slot, h, n, page, tree): each different block of a slot with its characters and its page's text's hash.

    One row a page has slot -2; each skeleton's own string comes once a task (slot -1).
    """
    sent: set = set()
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            rows = []
            for url, page in zip(*(c.slice(lo, 512).to_pylist() for c in batch.columns[:2]), strict=True):
                host, p = host_of(url), Page(page or "")
                tree = p.skeleton()
                skel, text = key_of(tree), p.key()
                if (host, skel) not in sent:
                    if len(sent) > 100_000:
                        sent.clear()
                    sent.add((host, skel))
                    rows.append((host, skel, -1, 0, 0, 0, tree))
                rows.append((host, skel, -2, 0, 0, text, None))
                sizes: dict[tuple, int] = {}
                for slot, t in p.blocks:
                    at = slot, key_of(t)
                    sizes[at] = sizes.get(at, 0) + len(t)
                rows += [(host, skel, slot, h, n, text, None) for (slot, h), n in sizes.items()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["host", "skel", "slot", "h", "n", "page", "tree"])


def _tree(lines: str) -> tuple[list[str], list[list[int]], list[bool]]:
    """(labels, children, inside a main element) of a skeleton string."""
    rows = [x.split("\t") for x in lines.split("\n")]
    return [x[0] for x in rows], [[int(c) for c in x[1].split(",") if c] for x in rows], [x[2] == "1" for x in rows]


def _prints(tree: tuple) -> list[int]:
    """Hash of each node's subtree; children come after their parents."""
    out = [0] * len(tree[0])
    for i in range(len(out) - 1, -1, -1):
        out[i] = hash((tree[0][i], *(out[c] for c in tree[1][i])))
    return out


def match(a: tuple, b: tuple, i: int, j: int, memo: dict, prints: tuple) -> tuple[int, list]:
    """Simple tree matching of node i of a and node j of b: (size, pairs) of the largest order-keeping matching of like labels.

    Equal subtrees at either end of the children pair off first, which costs no size: wide pages that differ in few places stay cheap.
    """
    if a[0][i] != b[0][j]:
        return 0, []
    if (i, j) in memo:
        return memo[i, j]
    x, y, same, pairs = list(a[1][i]), list(b[1][j]), [], []
    while x and y and prints[0][x[0]] == prints[1][y[0]]:
        same.append((x.pop(0), y.pop(0)))
    while x and y and prints[0][x[-1]] == prints[1][y[-1]]:
        same.append((x.pop(), y.pop()))
    while same:
        p, q = same.pop()
        pairs.append((p, q))
        same += zip(a[1][p], b[1][q], strict=True)
    best = np.zeros((len(x) + 1, len(y) + 1), int)
    for p in range(len(x)):
        for q in range(len(y)):
            best[p + 1, q + 1] = max(best[p, q + 1], best[p + 1, q], best[p, q] + match(a, b, x[p], y[q], memo, prints)[0])
    size, p, q = 1 + len(pairs) + int(best[-1, -1]), len(x), len(y)
    while p and q:
        w = match(a, b, x[p - 1], y[q - 1], memo, prints)
        if w[0] and best[p, q] == best[p - 1, q - 1] + w[0]:
            pairs += w[1]
            p, q = p - 1, q - 1
        elif best[p, q] == best[p - 1, q]:
            p -= 1
        else:
            q -= 1
    memo[i, j] = (size, [(i, j), *pairs])
    return memo[i, j]


def _matched(template: tuple, own: tuple, prints: list | None = None) -> dict[int, int]:
    """Template nodes by own nodes."""
    return {j: i for i, j in match(template, own, 0, 0, {}, (prints or _prints(template), _prints(own)))[1]}


def grown(trees: list[str]) -> tuple[list[str], list[list[int]]]:
    """A template (labels, children) that holds every one of the skeletons, in order of weight; it grows by what is new."""
    labels, children = ["#root"], [[]]
    for lines in trees:
        own = _tree(lines)
        to = _matched((labels, children), own)
        for j in range(len(own[0])):  # parents come before their children
            at = 0
            for c in own[1][j]:
                if c in to:
                    at = children[to[j]].index(to[c]) + 1 if to[c] in children[to[j]] else at
                else:
                    labels.append(own[0][c])
                    children.append([])
                    to[c] = len(labels) - 1
                    children[to[j]].insert(at, to[c])
                    at += 1
    return labels, children


def aligned(template: tuple, own: tuple, prints: list | None = None) -> list[int]:
    """The node of each slot of a skeleton: the template's, or for what it lacks a hash of the node above, the label and its turn there."""
    to, out = _matched(template, own, prints), [0] * len(own[0])
    for j in range(len(own[0])):
        turns: dict[str, int] = {}
        for c in own[1][j]:
            label = own[0][c]
            if c in to:
                out[c] = to[c]
            else:
                turns[label] = turns.get(label, 0) + 1
                out[c] = key_of(f"{out[j]} {turns[label]} {label}")
    return out


def _templates(pdf):
    """applyInPandas over one host's heaviest skeletons (host, place, tree): its template."""
    import pandas as pd

    labels, children = grown(pdf.sort_values("place")["tree"].tolist())
    lines = [f"{label}\t{','.join(map(str, c))}\t0" for label, c in zip(labels, children, strict=True)]
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "template": ["\n".join(lines)]})


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (host, skel, tree, template) to (host, skel, slot, node)."""
    last, template, prints = None, ([], []), []
    for batch in batches:
        rows = []
        for host, skel, tree, lines in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if lines != last:
                last, template = lines, _tree(lines)[:2]
                prints = _prints(template)
            rows += [(host, skel, slot, node) for slot, node in enumerate(aligned(template, _tree(tree), prints))]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["host", "skel", "slot", "node"])


def decide(tree: tuple, pages: int, texts: int, mass: dict[int, int]) -> list[int]:
    """The slots of a skeleton that are content.

    ``pages`` have it, ``texts`` is how many different page texts the host has, ``mass`` gives the characters of each slot's varying blocks.
    """
    labels, kids, inside = tree
    named = {j for j, x in enumerate(labels) if x in NAMED}
    own = [j for j, x in enumerate(inside) if x and j not in named]
    plain = [j for j in range(len(labels)) if j not in named]
    if texts >= MIN_PAGES and sum(mass.get(j, 0) for j in own) < (1 - MASS) * sum(mass.get(j, 0) for j in plain):
        own = []  # what varies is elsewhere
    under: set[int] = set()
    if own:
        keep = list(own)
    else:
        vary = {j for j in plain if mass.get(j, 0)} or set(plain)
        heavy = [mass.get(j, 0) * (j in vary) for j in range(len(labels))]
        for j in range(len(labels) - 1, -1, -1):
            heavy[j] += sum(heavy[c] for c in kids[j])
        at = 0
        while True:
            top = max(kids[at], key=lambda c: heavy[c], default=None)
            own_text = mass.get(at, 0) * (at in vary)
            if top is None or own_text or heavy[top] < MASS * max(1, heavy[0]) or labels[top] == "flow":
                break
            at = top
        todo = [at]
        while todo:
            under.add(j := todo.pop())
            todo += kids[j]
        keep = sorted(under & vary)
    # named as noise, but text that varies
    text = sum(mass.get(j, 0) for j in keep)
    within = {j for j in named if inside[j]} if own else named & under
    for j in sorted(named):
        n = mass.get(j, 0)
        if n >= LARGE * pages and (j in within and labels[j] == "!prose" or (j in within or not own) and n >= NEARLY_ALL * (n + text)):
            keep.append(j)
    return keep


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (host, skel, tree, pages, texts, mass, drop) to (host, skel, keep, drop)."""
    for batch in batches:
        host, skel, tree, pages, texts, mass, drop = (c.to_pylist() for c in batch.columns)
        keep = []
        for t, n, m, slots, gone in zip(tree, pages, texts, mass, drop, strict=True):
            left = {x["slot"]: x["n"] for x in slots or ()}
            for x in gone or ():
                left[x["slot"]] -= x["n"]
            keep.append(decide(_tree(t), n, m, left))
        out = [[{"slot": x["slot"], "h": x["h"]} for x in gone or ()] for gone in drop]
        kinds = pa.list_(pa.int32()), pa.list_(pa.struct([("slot", pa.int32()), ("h", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep, kinds[0]), pa.array(out, kinds[1])], ["host", "skel", "keep", "drop"])


def _wrappers(seen: DataFrame) -> DataFrame:
    """(host, skel, keep, drop): the slots of each skeleton that are content, and the template blocks in them, from rows of ``_observed``."""
    trees = seen.filter("slot = -1").groupBy("host", "skel").agg(F.min("tree").alias("tree"))
    blocks = materialize(seen.filter("slot >= 0").groupBy("host", "skel", "slot", "h").agg(F.countDistinct("page").alias("d"), F.min("page").alias("lo"), F.max("page").alias("hi"), F.sum("n").alias("n")), "blocks")
    sizes = seen.filter("slot = -2").groupBy("host", "skel").agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("page").alias("d"))
    hosts = sizes.groupBy("host").agg(F.sum("d").alias("texts"))
    heaviest = Window.partitionBy("host").orderBy(F.desc("pages"), "skel")
    heavy = sizes.select("host", "skel", F.row_number().over(heaviest).alias("place")).filter(F.col("place") <= TEMPLATE_TREES)
    templates = trees.join(heavy, ["host", "skel"]).select("host", "place", "tree").groupBy("host").applyInPandas(_templates, "host string, template string")
    nodes = trees.join(templates, "host").select("host", "skel", "tree", "template").mapInArrow(_placed, "host string, skel long, slot int, node long")
    often = blocks.groupBy("host", "h").agg(F.sum("d").alias("times")).filter(F.col("times") >= MIN_PAGES).join(hosts, "host").filter("2 * times >= texts")
    frequent = materialize(blocks.join(often, ["host", "h"]).join(nodes, ["host", "skel", "slot"]), "frequent")
    fixed = frequent.groupBy("host", "node", "h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("d").alias("d"), F.max("texts").alias("texts")).filter((F.col("lo") != F.col("hi")) & (F.col("d") >= MIN_PAGES) & (2 * F.col("d") >= F.col("texts")))
    gone = frequent.join(fixed.select("host", "node", "h"), ["host", "node", "h"], "left_semi").groupBy("host", "skel").agg(F.collect_list(F.struct("slot", "h", "n")).alias("drop"))
    mass = blocks.groupBy("host", "skel", "slot").agg(F.sum("n").alias("n")).groupBy("host", "skel").agg(F.collect_list(F.struct("slot", "n")).alias("mass"))
    known = trees.join(sizes.select("host", "skel", "pages"), ["host", "skel"]).join(mass, ["host", "skel"], "left").join(gone, ["host", "skel"], "left").join(hosts, "host")
    found = known.select("host", "skel", "tree", "pages", "texts", "mass", "drop").mapInArrow(_decided, "host string, skel long, keep array<int>, drop array<struct<slot:int,h:long>>")
    return materialize(found, "wrappers")


def _parsed(at: int, url: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                hosts, skels, blocks = [], [], []
                for u, page in zip(part.column(url).to_pylist(), part.column(at).to_pylist(), strict=True):
                    p = Page(page or "")
                    hosts.append(host_of(u))
                    skels.append(key_of(p.skeleton()))
                    blocks.append([{"slot": s, "h": key_of(t), "text": t} for s, t in p.blocks])
                kind = pa.list_(pa.struct([("slot", pa.int32()), ("h", pa.int64()), ("text", pa.string())]))
                rest = [i for i in range(part.num_columns) if i != at]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in rest), pa.array(hosts, pa.string()), pa.array(skels, pa.int64()), pa.array(blocks, kind)], [*(part.schema.names[i] for i in rest), "__host", "__skel", "__blocks"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, blocks array<string>.

    Character references are decoded, white space inside a block is one space, blocks are joined by one space in page order. A null html is
    empty and gives an empty text; pages without a host (null or odd urls) are aligned with one another. Repeated rows stay, each with its text; of
    skeletons met equally often the smaller hash comes first. Extra columns are not read, whatever they are called; an empty table gives no rows.
    """
    bounded_batches(pages.sparkSession)
    seen = materialize(pages.select("url", text_of("html").alias("html")).mapInArrow(_observed, "host string, skel long, slot int, h long, n long, page long, tree string"), "slots")
    kept = _wrappers(seen)
    whole = pages.select("page_id", "url", text_of("html").alias("html"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole.schema.fields if f.name != "html")
    read = whole.mapInArrow(_parsed(2, 1), f"{fields}, __host string, __skel long, __blocks array<struct<slot:int,h:long,text:string>>")
    found = read.join(kept, (read["__host"] == kept["host"]) & (read["__skel"] == kept["skel"]), "left")
    held = F.filter("__blocks", lambda b: F.array_contains("keep", b["slot"]))
    own = F.filter(held, lambda b: ~F.exists("drop", lambda d: (d["slot"] == b["slot"]) & (d["h"] == b["h"])))
    # a page of nothing but template blocks keeps them
    texts = F.transform(F.when(F.size(own) > 0, own).otherwise(held), lambda b: b["text"])
    return found.select("page_id", "url", F.coalesce(texts, F.array().cast("array<string>")).alias("blocks")).select("page_id", "url", F.array_join("blocks", " ").alias("text"), "blocks")
