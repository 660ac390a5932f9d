"""Parsing of a page into nested blocks, and the wrappers that are inferred from pages.

A page becomes a tree of nodes [label, texts, kids]. Labels are the tag with its role
and class words; words with digits are left out, and so are ids, which differ by page. Inline tags are transparent;
scripts, styles and comments leave nothing. End tags
that HTML lets authors leave out are supplied.

A wrapper is a union-free regular expression over such trees: a node is
[label, repeated, optional, text, mass, linked, pages, kids], where text is None (no text),
a string (the same text in every page so far) or True (a slot), mass counts
the characters met, and linked those of them in links. `merge` aligns two wrappers: equal labels are matched in
order, neighbouring equals become one repeated group, what only one side has
becomes optional, and differing texts become a slot. A wrapper is bounded: a node has at most
KIDS kids with class words of their own (those beyond it, with the fewest characters, lose their class words and so fall
together), long sequences are grouped by label, and levels below DEPTH are summed up.

What is main text is decided by HTML's own elements and roles, and by the host's wrapper:

* The region is the article elements, else the main element or role, else the block that is reached
  from the root by following the child that holds most of the host's varying, unlinked text.
* In a block region, a repeated group of which nearly all text is links is a menu, if it is the smaller part of the
  region. Articles and main elements keep their lists of links.
* A block goes if its class or id names a kind that is no main text: it consists of such a name (KINDS) and
  words that say no more than that it is a block (AROUND), as in `comment-list` or `page-footer`. The
  wrapper has to say the same: it is the smaller part of the host's region, or a repeated group of records. A notice is one only
  if its text is the same on different pages. Words inside other names say nothing.
* Headings, paragraphs and all other text in the region stay, whether pages share them or not.
* A page of which nothing would be left keeps all of its region.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<[a-zA-Z/][^>]*>|<[!?][^>]*>|<[a-zA-Z/!?].*\Z|[^<]+|<", re.S
)
_ATTR = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_DIGITS = re.compile(r"\d+")

_WORDS = str.split
VOID = frozenset(_WORDS("area base br col embed hr img input link meta param source track wbr"))
RAW = frozenset(_WORDS("script style textarea title noscript template iframe svg object canvas audio video select annotation annotation-xml"))
INLINE = frozenset(
    _WORDS("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var label")
    + _WORDS("math semantics mrow mi mo mn ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mfenced mstyle mpadded mphantom menclose")
)
HEAD = frozenset(_WORDS("base link meta title style script noscript template"))
#: tag -> open tags that its start closes, up to a barrier
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: elements and roles that HTML itself defines as something else than main text
OUT_TAGS = frozenset(_WORDS("nav footer aside form button menu dialog head fieldset"))
OUT_ROLES = frozenset(_WORDS("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar"))
HEADINGS = frozenset(_WORDS("h1 h2 h3 h4 h5 h6"))
#: names of kinds of blocks that are no main text
KINDS = frozenset(_WORDS("menu header footer sidebar notice notices ad ads advert adverts advertisement sponsored promo comment comments nav navbar"))
#: words beside which such a name still stands for the whole block
AROUND = frozenset(_WORDS("list item items slot box block bar area section wrapper wrap container page site main top bottom left right inner outer widget unit thread form"))


def tag_of(label: str) -> str:
    return label.partition("|")[0]


def out_of_text(label: str) -> bool:
    """Whether a label is an element or role that HTML defines as something else than main text."""
    tag, _, rest = label.partition("|")
    role, _, names = rest.partition("|")
    return tag in OUT_TAGS or role in OUT_ROLES or names.startswith("!")


def kind_of(name: str) -> str:
    """The kind that a class word or id names, '' if it names none."""
    if name in KINDS:
        return name
    parts = [x for x in re.split(r"[-_]+", name) if x]
    if "".join(parts) in KINDS:
        return "".join(parts)
    kinds = [x for x in parts if x in KINDS]
    return kinds[0] if kinds and all(x in KINDS or x in AROUND for x in parts) else ""


def kinds_of(label: str) -> set[str]:
    return {kind_of(x) for x in label.partition("|")[2].partition("|")[2].split()} - {""}


def _label(tag: str, attributes: str) -> str:
    if "=" not in attributes and "hidden" not in attributes:
        return tag
    role, names, hidden = "", set(), False
    for name, a, b, c in _ATTR.findall(attributes):
        value, name = (a or b or c).lower(), name.lower()
        if name == "role":
            role = value
        elif name == "hidden" or (name == "aria-hidden" and value == "true" and tag != "a"):
            hidden = True
        elif name == "class":
            names.update(x for x in value.split() if not _DIGITS.search(x) and "|" not in x)
        elif name == "id" and kind_of(value):
            names.add(value)
    if hidden:
        return f"{tag}|{role}|!hidden"
    return f"{tag}|{role}|{' '.join(sorted(names))}" if role or names else tag


def parse(page: str) -> list:
    """The tree of a page: [label, texts, kids], texts being (position among the kids, text, its characters in links).

    What is open is kept as a stack with, for each entry, the node that texts and kids of its inside go to, and the place of the
    open paragraph that a block would end; and open tags are counted. So a step takes as long in a deep page as in a flat one.
    """
    root = ["#", [], []]
    stack = [("#", root, 0)]  # tag, node, place of the open paragraph or 0
    open_: Counter[str] = Counter()
    at, end = 0, len(page)
    match = _TOKEN.match
    pending: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        if pending:
            text = " ".join(html.unescape("".join(pending)).split())
            in_links, linked = min(linked, len(text)), 0
            pending.clear()
            if text:
                node = stack[-1][1]
                node[1].append((len(node[2]), text, in_links))

    def push(tag: str, label: str | None):
        """A node of its own, or none (label None) for an inline tag."""
        _, node, paragraph = stack[-1]
        if label is not None:
            kid = [label, [], []]
            node[2].append(kid)
            node = kid
        if tag not in INLINE:
            paragraph = len(stack) if tag == "p" else 0
        stack.append((tag, node, paragraph))
        open_[tag] += 1

    def pop_to(k: int):
        flush()
        for tag, _, _ in stack[k:]:
            open_[tag] -= 1
        del stack[k:]

    while at < end:
        m = match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            token = m[0]
            if token[0] != "<" or token == "<":
                pending.append(token)
                if open_["a"]:
                    linked += len(token.strip())
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                pending.append(" ")
            elif not open_[tag]:
                if tag not in INLINE:
                    flush()
            elif tag in INLINE:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        if stack[k][1] is stack[k - 1][1]:  # transparent: what is open within stays open
                            del stack[k]
                            open_[tag] -= 1
                        else:
                            pop_to(k)
                        break
                    if stack[k][0] not in INLINE:
                        break
            else:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                pop_to(k)
            continue
        if tag in VOID:
            if tag == "br":
                pending.append(" ")
            elif tag == "hr":
                flush()
            continue
        label = _label(tag, m[3])
        if tag in RAW:
            if not m[3].endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if tag in INLINE:
            if not out_of_text(label):
                push(tag, None)  # transparent: not hung into the tree
            else:
                flush()
                push(tag, label)
            continue
        flush()
        if tag in CLOSES and any(open_[x] for x in CLOSES[tag][0]):
            closed, barrier = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in barrier:
                    break
                if stack[k][0] in closed:
                    low = k
                    while low > 1 and stack[low - 1][0] in closed:
                        low -= 1
                    pop_to(low)
                    break
        if stack[-1][2]:  # a block ends an open paragraph and what stands in it
            pop_to(stack[-1][2])
        if open_["head"] and tag not in HEAD and tag != "html":
            pop_to(next(k for k, x in enumerate(stack) if x[0] == "head"))
        push(tag, label)
    flush()
    return root


# ---- wrappers -----------------------------------------------------------------


TEMPLATE_PAGES = 2  # different pages that show that a text is the host's and not a page's
KIDS = 64
DEPTH = 60
CELLS = 250_000  # label comparisons of one alignment; longer sequences are grouped by label
LABEL, REPEATED, OPTIONAL, TEXT, MASS, LINKED, PAGES, WITHIN = range(8)


def walk(node: list):
    """All nodes of a page, in page order."""
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack += reversed(x[2])


def print_of(node: list) -> int:
    """A number by which pages are told apart: the least hash of the five longest texts, so that near copies mostly have the same."""
    texts = sorted({t for x in walk(node) for _, t, _ in x[1]}, key=lambda t: (-len(t), t))[:5]
    return min((int.from_bytes(hashlib.blake2b(t.encode(errors="replace"), digest_size=6).digest(), "little") for t in texts), default=0)


def wrapper_of(node: list, page: int = 0, depth: int = 0) -> list:
    """The wrapper that matches this tree alone, with repeats folded; `page` is the page's number."""
    if depth == DEPTH:
        texts = [t for x in walk(node) if not out_of_text(x[0]) for t in x[1]]
        kids = []
    else:
        texts, kids = node[1], fold([wrapper_of(k, page, depth + 1) for k in node[2]])
    text = None if not texts else texts[0][1] if len(texts) == 1 and len(texts[0][1]) <= 200 and depth < DEPTH else True
    return [node[0], False, False, text, sum(len(t) for _, t, _ in texts), sum(n for _, _, n in texts), [page], bounded(kids)]


def fold(kids: list[list]) -> list[list]:
    """Neighbouring nodes of one label become one repeated node; so do repeated pairs and triples."""
    out: list[list] = []
    for k in kids:
        if out and out[-1][0] == k[0]:
            out[-1] = merge(out[-1], k)
            out[-1][REPEATED] = True
        else:
            out.append(k)
    for width in (2, 3):
        i = 0
        while i + 2 * width <= len(out):
            if all(out[i + j][0] == out[i + width + j][0] for j in range(width)):
                for j in range(width):
                    out[i + j] = merge(out[i + j], out[i + width + j])
                    out[i + j][REPEATED] = True
                del out[i + width : i + 2 * width]
            else:
                i += 1
    return out


def grouped(kids: list[list]) -> list[list]:
    """One repeated, optional node for each label, in order of first occurrence."""
    out: dict[str, list] = {}
    for k in kids:
        old = out.get(k[0])
        if old is None:
            out[k[0]] = k
        else:
            out[k[0]] = merge(old, k)
            out[k[0]][REPEATED] = out[k[0]][OPTIONAL] = True
    return list(out.values())


def bounded(kids: list[list]) -> list[list]:
    """At most KIDS kids keep class words of their own."""
    if len(kids) <= KIDS:
        return kids
    kids = grouped(kids)
    named = sorted((k for k in kids if "|" in k[0]), key=lambda k: (-mass(k), k[0]))
    for k in named[KIDS:]:
        k[0] = tag_of(k[0])
    return grouped(kids) if len(named) > KIDS else kids


def merge(a: list, b: list) -> list:
    """The least wrapper that covers both."""
    if a[TEXT] is None or b[TEXT] is None:
        text = a[TEXT] if b[TEXT] is None else b[TEXT]
    else:
        text = a[TEXT] if a[TEXT] == b[TEXT] else True
    pages = a[PAGES] if a[PAGES] == b[PAGES] else sorted({*a[PAGES], *b[PAGES]})[:TEMPLATE_PAGES]
    return [a[0], a[1] or b[1], a[2] or b[2], text, a[MASS] + b[MASS], a[LINKED] + b[LINKED], pages, align(a[WITHIN], b[WITHIN])]


def align(xs: list[list], ys: list[list]) -> list[list]:
    """Align two sequences by their labels; what stands on one side only becomes optional."""
    if [x[0] for x in xs] == [y[0] for y in ys]:
        return [merge(x, y) for x, y in zip(xs, ys, strict=True)]
    n, m = len(xs), len(ys)
    if n * m > CELLS:
        return bounded(grouped([*xs, *ys]))
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if xs[i][0] == ys[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and xs[i][0] == ys[j][0]:
            out.append(merge(xs[i], ys[j]))
            i, j = i + 1, j + 1
        else:
            if j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
                node, i = xs[i], i + 1
            else:
                node, j = ys[j], j + 1
            node[OPTIONAL] = True
            out.append(node)
    return bounded(fold(out))


def as_expression(w: list) -> str:
    """The wrapper as a regular expression over tags, for people to read."""
    tag = tag_of(w[0])
    text = "" if w[TEXT] is None else "#TEXT" if w[TEXT] is True else w[TEXT]
    body = f"<{tag}>{text}{''.join(map(as_expression, w[WITHIN]))}</{tag}>"
    if w[REPEATED] or w[OPTIONAL]:
        body = f"({body}){'*' if w[REPEATED] and w[OPTIONAL] else '+' if w[REPEATED] else '?'}"
    return body


# ---- what is main text --------------------------------------------------------


def _sum(w: list, of) -> int:
    return 0 if out_of_text(w[0]) else of(w) + sum(_sum(k, of) for k in w[WITHIN])


def _fixed(w: list) -> bool:
    return isinstance(w[TEXT], str) and len(w[PAGES]) >= TEMPLATE_PAGES


def mass(w: list) -> int:
    return _sum(w, lambda x: x[MASS])


def is_region(label: str, tag: str) -> bool:
    return tag_of(label) == tag or label.split("|")[1:2] == [tag]


def _regions(w: list, tag: str) -> list[list]:
    if out_of_text(w[0]):
        return []
    return [w] if is_region(w[0], tag) else [x for k in w[WITHIN] for x in _regions(k, tag)]


def _block(w: list) -> list[list]:
    """The nodes from the root to the block that holds most of the varying, unlinked text."""

    def varying(x: list) -> int:
        return 0 if tag_of(x[0]) == "header" else _sum(x, lambda y: 0 if _fixed(y) else y[MASS] - y[LINKED])

    path = [w]
    while True:
        total = varying(path[-1])
        kids = [k for k in path[-1][WITHIN] if not k[REPEATED] and varying(k) > 0.5 * total]
        if not kids or tag_of(kids[0][0]) not in ("html", "body", "div", "section", "table", "tbody", "tr", "td", "center"):
            return path
        path.append(kids[0])


def _same_everywhere(w: list) -> bool:
    return not _sum(w, lambda x: 0 if _fixed(x) else x[MASS])


def judge(w: list) -> dict:
    """The host's verdicts: for each kind of region the wrapper nodes that go, by id()."""
    path = _block(w)
    found = {}
    for kind, roots in (("article", _regions(w, "article")), ("main", _regions(w, "main")), ("block", [path[-1]])):
        drop = set()
        total = sum(map(mass, roots))
        stack = list(roots)
        while stack:
            x = stack.pop()
            if out_of_text(x[0]):
                continue
            own = mass(x)
            records = any(k[REPEATED] for k in x[WITHIN])
            small = own < 0.5 * total
            kinds = kinds_of(x[0])
            if kinds <= {"notice", "notices"} and not _same_everywhere(x):
                kinds = set()
            named = bool(kinds) and (small or ((records or x[REPEATED]) and own < total))
            menu = kind == "block" and records and small and _sum(x, lambda y: y[LINKED]) >= 0.8 * own > 0
            if x not in roots and (named or menu):
                drop.add(id(x))
                continue
            stack += x[WITHIN]
        found[kind] = drop
    return {"wrapper": w, "path": {id(x) for x in path}, "end": id(path[-1]), "kinds": found}


def extract(page: list, verdicts: dict) -> list[str]:
    """The main text blocks of a page in page order, by its host's wrapper and verdicts; see the module's text."""
    for careful in (True, False):
        for kind in ("article", "main"):
            out = _collect(page, verdicts, kind, careful)
            if out:
                return out
        out = _collect(page, verdicts, "block", careful)
        if out:
            return out
    alone = judge(wrapper_of(page))  # the page has nothing where its host's pages have their text
    return _collect(page, alone, "block", False)


def _collect(page: list, verdicts: dict, kind: str, careful: bool) -> list[str]:
    drop = verdicts["kinds"][kind]
    out: list[str] = []
    # (node, its place in the wrapper, inside the region) or a text to give out
    stack: list = [(page, verdicts["wrapper"], False)]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            out.append(top)
            continue
        node, w, inside = top
        if out_of_text(node[0]):
            continue
        if tag_of(node[0]) == "header" and not (inside and any(tag_of(x[0]) in HEADINGS for x in walk(node))):
            continue
        if kind == "block":
            if not inside and (w is None or id(w) not in verdicts["path"]):
                continue
            inside = inside or id(w) == verdicts["end"]
        else:
            inside = inside or is_region(node[0], kind)
        if careful and inside and (bool(kinds_of(node[0])) if w is None else id(w) in drop):  # below the wrapper the name decides
            continue
        own = inside
        within = w[WITHIN] if w is not None else []
        todo, t, at = [], 0, 0
        texts = node[1]
        for k, kid in enumerate(node[2]):
            while t < len(texts) and texts[t][0] <= k:
                if own:
                    todo.append(texts[t][1])
                t += 1
            place, at = _place(kid[0], within, at)
            todo.append((kid, place, inside))
        if own:
            todo += [x for _, x, _ in texts[t:]]
        stack += reversed(todo)
    return out


def _place(label: str, within: list[list], at: int) -> tuple[list | None, int]:
    """The kid of the wrapper that stands for a page's kid, searched from the last one on; failing that, one of the same tag without class words."""
    for wanted in dict.fromkeys((label, tag_of(label))):
        for step in range(len(within)):
            j = (at + step) % len(within)
            if within[j][0] == wanted:
                return within[j], j
    return None, at
