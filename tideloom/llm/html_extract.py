"""HTML extraction by a tree-structured graphical model over the page's nodes.

A page is parsed into a tree of block elements (and of inline elements whose names say something) with runs of text as leaves. Every node
has a state: content, boilerplate, or mixed (both below it). The model is a product of parent-child potentials, P(child's state |
parent's state), and node potentials, the likelihood of a node's evidence (tag, words of class, id and role, length, share of linked
text, punctuation) in each state. Messages go from the leaves to the root and back (sum-product), which is exact on a tree; a run of
text is kept if content is its most likely state. All potentials are smoothed counts over labelled pages; ``labelled_pages``
builds such pages from parts of known kinds, and ``train`` takes any others of the same form.

Scripts, styles, comments and other text that a browser doesn't show are never leaves. A head ends where a browser ends it, with or without an
end tag. In svg and math "/>" closes an element; formulas are shown but for their annotations, of drawings only what is in text or
foreignObject. Kept runs of one block are put together, character
references are decoded, white space becomes one space, and blocks are joined in page order by one space.

Defined results: null or empty html: empty text. Broken markup is closed where it has to be; text without any tag is one block. Nesting of any
depth is handled without recursion. Repeated rows all come back; extra columns stay, equal names are replaced.
"""

from __future__ import annotations

import html as html_lib
import math
import random
import re
from collections import Counter
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

C, B, M = 0, 1, 2  # content, boilerplate, mixed
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HIDDEN = {"script", "style", "noscript", "template", "title", "textarea", "iframe", "object", "canvas", "audio", "video", "head", "datalist"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
INLINE = {"a", "b", "i", "em", "strong", "span", "small", "sub", "sup", "u", "s", "code", "tt", "mark", "q", "abbr", "cite", "dfn", "kbd", "samp", "var", "time", "font", "big", "ins", "del", "bdi", "bdo", "wbr", "img", "br", "strike", "acronym", "ruby", "rt", "rp", "data"}
#: What a start tag closes if it is open in the same container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: Start tags that leave a head open; any other one and text close it.
HEAD = {"base", "basefont", "bgsound", "link", "meta", "title", "noscript", "noframes", "style", "script", "template"}
#: What isn't shown in svg and math, elements of formulas with text, elements with HTML inside, and start tags that end svg and math.
UNSEEN = {"annotation", "annotation-xml", "mphantom", "desc", "metadata", "defs", "symbol", "clippath", "mask", "pattern", "marker"}
MATH_TEXT = {"mi", "mn", "mo", "ms", "mtext"}
POINTS = {"foreignobject", "desc", "title", *MATH_TEXT}
BREAKOUT = {"b", "big", "blockquote", "body", "br", "center", "code", "dd", "div", "dl", "dt", "em", "embed", "h1", "h2", "h3", "h4", "h5", "h6", "head", "hr", "i", "img", "li", "listing", "menu", "meta", "nobr", "ol", "p", "pre", "ruby", "s", "small", "span", "strong", "strike", "sub", "sup", "table", "tt", "u", "ul", "var"}
MOVED = re.compile(r"(?:^|\s)(?:x|y|dy)\s*=", re.I)
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(?=[a-zA-Z!?/])[^>]*>""", re.S)
ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "names", "parent", "text", "block", "linked")

    def __init__(self, tag, names, parent, block=0):
        self.tag, self.names, self.parent, self.block = tag, names, parent, block
        self.text: list[str] | None = None  # of leaves
        self.linked = 0


def names_of(attrs: str) -> tuple[str, ...]:
    return tuple(w.lower() for m in ATTR.finditer(attrs) for w in NAME.findall(m[2] or m[3] or m[4] or "")) if attrs else ()


def self_closed(attrs: str) -> bool:
    """Whether a tag ends in "/>"; a slash at the end of a value without quotes belongs to the value."""
    if not attrs.endswith("/"):
        return False
    last = attrs.rsplit(None, 1)[-1]
    return "=" not in last[max(last.rfind('"'), last.rfind("'")) + 1 :]


def parse(page: str) -> list[Node]:
    """Nodes in page order, parents first; leaves (tag #text) hold raw text. The first node is the root."""
    nodes = [Node("#root", (), -1)]
    stack: list[tuple[str, int, bool, int, str]] = [("#root", 0, False, 0, "")]  # tag, node (its nearest), block, hidden and space around it
    block, links, leaf, at, size = 0, 0, None, 0, len(page)
    hidden, space, glued = 0, "", False  # 1: a drawing outside its text, 2: never shown; svg, math or HTML; after a formula's text
    opened: Counter = Counter()

    def pop_to(i: int) -> None:
        nonlocal block, links, hidden, leaf, space, glued
        while len(stack) > i:
            tag, node, is_block, hidden, space = stack.pop()
            opened[tag] -= 1
            if is_block:
                block += 1
                leaf = None
            elif node != stack[-1][1]:
                leaf = None
            links -= tag == "a"
            glued = glued or tag in MATH_TEXT

    def put(s: str) -> None:
        nonlocal leaf, glued
        if s and stack[-1][0] == "head" and not s.isspace():
            pop_to(len(stack) - 1)
        if hidden or not s:
            return
        glued = False
        if leaf is None:
            if s.isspace() and (not nodes or nodes[-1].tag != "#text" or nodes[-1].block != block):
                return
            leaf = Node("#text", (), stack[-1][1], block)
            leaf.text = []
            nodes.append(leaf)
        leaf.text.append(s)
        if links:
            leaf.linked += len(s)

    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            put(page[at:])
            break
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            if (space or stack[-1][0] in MATH_TEXT) and page.startswith("<![CDATA[", m.start()):
                end = page.find("]]>", m.start())
                at = size if end < 0 else end + 3
                put(html_lib.escape(page[m.start() + 9 : size if end < 0 else end]))
            continue
        tag = tag.lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[i][0] == tag:
                    pop_to(i)
                    break
            continue
        if space and (tag in BREAKOUT or tag == "font" and re.search(r"(?:^|\s)(?:color|face|size)\s*=", m[3], re.I)):
            while space:
                pop_to(len(stack) - 1)
        if tag == "head" and stack[-1][0] not in ("#root", "html"):
            continue
        if stack[-1][0] == "head" and tag not in HEAD:
            pop_to(len(stack) - 1)
        if space or tag in ("svg", "math"):
            inner = tag if tag in ("svg", "math") else space
            inline = inner == "math" or tag in ("tspan", "textpath", "a")
            if glued and tag in MATH_TEXT or tag == "tspan" and MOVED.search(m[3]):
                put(" ")
            if not inline:
                block += 1
                leaf = None
            if self_closed(m[3]):
                continue
            level = 2 if tag in HIDDEN or tag in UNSEEN else max(hidden, 1) if tag == "svg" else 0 if hidden == 1 and tag in ("text", "foreignobject") else hidden
            names, node = names_of(m[3]), stack[-1][1]
            if not level and (names or not inline):
                nodes.append(Node(tag, names, node, block))
                node, leaf = len(nodes) - 1, None
            stack.append((tag, node, not inline, hidden, space))
            opened[tag] += 1
            links += tag == "a"
            html_inside = tag in POINTS or tag == "annotation-xml" and re.search(r"encoding\s*=\s*[\"']?(?:text/html|application/xhtml\+xml)", m[3], re.I)
            hidden, space = level, "" if html_inside else inner
            continue
        if tag == "br":
            put(" ")
            continue
        if tag in INLINE:
            if tag in VOID:
                continue
            names = names_of(m[3])
            node = stack[-1][1]
            if names and not hidden:
                nodes.append(Node(tag, names, node, block))
                node, leaf = len(nodes) - 1, None
            stack.append((tag, node, False, hidden, space))
            opened[tag] += 1
            links += tag == "a"
            continue
        if tag in ENDS_P or tag in CLOSES:
            shut, stop = ({"p"}, set()) if tag in ENDS_P else (CLOSES[tag], HOLDS[tag])
            low = None
            for i in range(len(stack) - 1, 0, -1) if any(opened[t] for t in shut) else ():
                if stack[i][0] in stop or stack[i][0] in POINTS or (tag in ENDS_P and stack[i][0] in ("button", "td", "th", "table", "object")):
                    break
                if stack[i][0] in shut:
                    low = i
            if low is not None:
                pop_to(low)
        block += 1
        leaf = None
        if tag in VOID:
            if tag == "input" and not hidden:
                nodes.append(Node(tag, (), stack[-1][1], block))
            continue
        names = names_of(m[3])
        if tag == "div" and not names:  # says nothing about what is in it: no node, so a page may be wrapped in any number of them
            stack.append((tag, stack[-1][1], True, hidden, space))
        elif not hidden and tag not in HIDDEN:
            nodes.append(Node(tag, names, stack[-1][1], block))
            stack.append((tag, len(nodes) - 1, True, hidden, space))
        else:
            stack.append((tag, stack[-1][1], True, hidden, space))
            hidden = 2 if tag in HIDDEN else hidden
        opened[tag] += 1
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.start() if end else size
    return nodes


def evidence(nodes: list[Node]) -> list[list[str]]:
    """What is seen of each node, as names of discrete facts."""
    out = []
    for n in nodes:
        if n.text is None:
            out.append([f"tag={n.tag}", *[f"name={w}" for w in dict.fromkeys(n.names)]])
            continue
        s = "".join(n.text)
        long = min(6, int(math.log2(1 + len(s) / 12)))
        share = n.linked / max(1, len(s))
        marks = sum(s.count(x) for x in ".,;:!?") * 30 > len(s)
        link = 0 if share < 0.1 else 1 if share < 0.6 else 2
        out.append([f"long={long}", f"link={link}", f"marks={marks and long > 1}", f"in={nodes[n.parent].tag},{link}", *(["copy"] if "©" in s or "&copy;" in s else [])])
    return out


class Model:
    """Log potentials: start (root's states), edge (parent's state by child's) and facts by state."""

    def __init__(self, edge, facts, start):
        self.edge, self.facts, self.start = edge, facts, start

    def marginals(self, nodes: list[Node]) -> list[tuple[float, float, float]]:
        """P(state) of each node by sum-product: up from the leaves, then down from the root."""
        n = len(nodes)
        facts, edge = self.facts, self.edge
        own = []
        for node, seen in zip(nodes, evidence(nodes)):
            c = b = m = 0.0
            for f in seen:
                w = facts.get(f)
                if w:
                    c, b, m = c + w[0], b + w[1], m + w[2]
            if node.text is not None:
                m = -60.0  # a run of text is of one kind
            top = max(c, b, m)
            own.append([math.exp(c - top), math.exp(b - top), math.exp(m - top)])
        belief = own  # node potential times the messages from below
        up: list = [None] * n
        for i in range(n - 1, 0, -1):
            x, y, z = belief[i]
            msg = [e[0] * x + e[1] * y + e[2] * z for e in edge]
            t = msg[0] + msg[1] + msg[2]
            msg = [msg[0] / t, msg[1] / t, msg[2] / t]
            up[i] = msg
            p = belief[nodes[i].parent]
            p[0], p[1], p[2] = p[0] * msg[0], p[1] * msg[1], p[2] * msg[2]
            t = p[0] + p[1] + p[2]
            if t < 1e-200:
                s = max(p) or 1.0
                p[0], p[1], p[2] = (max(v / s, 1e-300) for v in p)
        root = belief[0]
        full: list = [[root[k] * self.start[k] for k in range(3)]] + [None] * (n - 1)
        for i in range(1, n):
            p, u, b = full[nodes[i].parent], up[i], belief[i]
            down = [p[k] / u[k] for k in range(3)]
            t = sum(down)
            down = [d / t for d in down]
            f = [b[j] * (down[0] * edge[0][j] + down[1] * edge[1][j] + down[2] * edge[2][j]) for j in range(3)]
            t = sum(f) or 1e-300
            full[i] = [v / t for v in f]
        t = sum(full[0]) or 1e-300
        full[0] = [v / t for v in full[0]]
        return [tuple(f) for f in full]

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        nodes = parse(page)
        blocks: dict[int, list[str]] = {}
        for node, p in zip(nodes, self.marginals(nodes)):
            if node.text is not None and p[C] >= p[B]:
                blocks.setdefault(node.block, []).extend(node.text)
        texts = ("".join(x) for x in blocks.values())
        return " ".join(t for t in (" ".join((html_lib.unescape(x) if "&" in x else x).split()) for x in texts) if t)


def train(pages: list[tuple[str, str]], smooth: float = 0.5) -> Model:
    """Potentials from labelled pages: (html, text marker of boilerplate). A run of text is boilerplate if it holds the marker.

    The elements' states follow from the runs below them; elements without text take their parent's.
    """
    edge, facts, totals, start = [[smooth] * 3 for _ in range(3)], {}, [0.0] * 3, [smooth] * 3
    edge[C][B] = edge[C][M] = edge[B][C] = edge[B][M] = 0.02
    for page, marker in pages:
        nodes = parse(page)
        below: list[set[int]] = [set() for _ in nodes]
        for i in range(len(nodes) - 1, 0, -1):
            if nodes[i].text is not None:
                below[i].add(B if any(marker in s for s in nodes[i].text) else C)
            below[nodes[i].parent] |= below[i]
        state = [M] * len(nodes)
        for i, found in enumerate(below):
            state[i] = M if len(found) == 2 else next(iter(found)) if found else state[nodes[i].parent] if i else M
        for n in nodes:
            if n.text is not None:
                n.text = [s.replace(marker, "") for s in n.text]
        for i, seen in enumerate(evidence(nodes)):
            if i:
                edge[state[nodes[i].parent]][state[i]] += 1
            else:
                start[state[0]] += 1
            totals[state[i]] += 1
            for f in seen:
                facts.setdefault(f, Counter())[state[i]] += 1
    edge = [[v / sum(row) for v in row] for row in edge]
    spread = max(totals)
    eps = lambda f: smooth / 10 if f.startswith("name=") else smooth  # names say most where they are never seen
    logs = {f: tuple(math.log((c[k] + eps(f)) / (totals[k] + eps(f) * spread / 100)) for k in range(3)) for f, c in facts.items()}
    # only differences between states matter; a fact's mean is taken out to keep numbers small
    logs = {f: tuple(v - sum(w) / 3 for v in w) for f, w in logs.items()}
    return Model(edge, logs, [v / sum(start) for v in start])


#: Fixed word lists: names that pages give to their parts.
NAMES = {
    "article": "article content post entry story body text main page blog news hentry prose copy",
    "menu": "nav menu navigation navbar breadcrumb breadcrumbs toc tabs toolbar topbar skip links pagination pager",
    "header": "header masthead logo branding banner top site title tagline hero brand",
    "footer": "footer foot copyright colophon legal bottom credits imprint license",
    "sidebar": "sidebar side aside widget widgets related recommended trending popular recent tags rail secondary archive author bio categories",
    "notice": "notice cookie cookies consent gdpr alert message popup modal overlay warning privacy newsletter subscribe paywall disclaimer toast",
    "advert": "ad ads advert advertisement adverts sponsor sponsored promo promotion promoted adsense outbrain taboola affiliate marketing",
    "form": "form search login signup contact input field button subscribe register poll survey",
    "comments": "comments comment respond reply replies disqus discussion thread feedback review reviews commentlist responses reader",
    "share": "share social sharing twitter facebook follow like buttons meta byline",
}
MARK = "⁣"


def labelled_pages(count: int = 600, seed: int = 11) -> list[tuple[str, str]]:
    """Pages put together from parts of known kinds; runs of boilerplate begin with ``MARK``."""
    rng = random.Random(seed)
    letters = ["ba", "re", "ti", "on", "le", "sch", "en", "qu", "os", "mi", "th", "er", "ing", "ado", "ve", "st", "un", "k", "zo", "ly"]

    def word():
        return "".join(rng.choice(letters) for _ in range(rng.randint(1, 4)))

    def text(lo, hi, stops=True):
        w = [word() for _ in range(rng.randint(lo, hi))]
        if stops:
            for i in range(rng.randint(4, 12), len(w), rng.randint(6, 14)):
                w[i] += rng.choice(",.;.:")
        return " ".join(w).capitalize() + ("." if stops else "")

    def attrs(kind, often=0.75):
        if rng.random() > often:
            return ""
        w = rng.sample(NAMES[kind].split(), rng.choice([1, 1, 2]))
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(["-", " ", "_"]).join(w)}{rng.choice(["", "", "-1", " wrap", "-box"])}"'

    def box(kind, inner, tags):
        tag = rng.choice(tags)
        a = attrs(kind, 0.95 if tag in ("div", "section", "p", "ul") else 0.4)
        wrap = rng.random() < 0.3
        return f"<{tag}{a}>{'<div>' * wrap}{inner}{'</div>' * wrap}</{tag}>"

    def links(n, kind):
        items = [f'<a href="/{word()}">{MARK}{text(1, 4, False)}</a>' for _ in range(n)]
        return f"<ul{attrs(kind, 0.3)}>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rng.random() < 0.7 else " | ".join(items)

    def boiler(kind):
        if kind == "menu":
            return box(kind, links(rng.randint(3, 9), kind), ["nav", "nav", "div", "ul"])
        if kind == "header":
            return box(kind, f"<{rng.choice(['h1', 'h2', 'p', 'div'])}>{MARK}{text(1, 5, False)}</>" + (links(4, "menu") if rng.random() < 0.5 else ""), ["header", "header", "div"])
        if kind == "footer":
            return box(kind, f"{rng.choice(['', '<p>'])}{MARK}{rng.choice(['&copy; ', '', '© '])}{text(3, 14)}" + (links(4, "menu") if rng.random() < 0.4 else ""), ["footer", "footer", "div"])
        if kind == "sidebar":
            return box(kind, f"<h3>{MARK}{text(1, 3, False)}</h3>" + (links(5, kind) if rng.random() < 0.6 else f"<p>{MARK}{text(8, 40)}</p>"), ["aside", "aside", "div", "section"])
        if kind == "notice":
            return box(kind, f"{rng.choice(['', '<p>', '<span>'])}{MARK}{text(5, 30)}" + (f"<button>{MARK}{text(1, 2, False)}</button>" if rng.random() < 0.5 else ""), ["div", "div", "section", "p"])
        if kind == "advert":
            return box(kind, f"{rng.choice(['', '<p>', '<a href=x>'])}{MARK}{text(3, 30)}", ["div", "div", "aside", "p", "section"])
        if kind == "form":
            return box(kind, f"<label>{MARK}{text(1, 4, False)}</label><input name=q><select><option>{MARK}{word()}<option>{MARK}{word()}</select><button>{MARK}{word()}</button>", ["form", "form", "div"])
        if kind == "comments":
            one = lambda: f"<{rng.choice(['div', 'li', 'article'])}{attrs(kind, 0.8)}><b>{MARK}{word()}</b><p>{MARK}{text(5, 60)}</p></>"
            return box(kind, f"<h3>{MARK}{text(1, 3, False)}</h3>" + "".join(one() for _ in range(rng.randint(1, 5))), ["div", "section", "ol", "div"])
        return box("share", links(3, "share"), ["div", "ul", "p"])

    def short():
        """Parts of an article that are short, listed, code or links."""
        t = text(1, 5, False)
        linked = f'<p><a href="/{word()}">{t}</a></p>'
        return rng.choice([
            linked, linked,
            f"<li>{t}</li>", f"<p><code>{word()}</code></p>", f"<pre><code>{text(1, 12)}</code></pre>", f"<span>{t}</span>", f"<code>{t}</code>", linked,
            f"<p>{t}</p>", f"<h3>{t}</h3>", f"<div>{text(1, 12)}</div>", f"<dl><dt>{word()}</dt><dd>{t}</dd></dl>", f"<ol><li>{t}</li><li>{text(1, 3, False)}</li></ol>",
            f'<ul><li><a href="/{word()}">{t}</a> {text(2, 8)}</li></ul>', t,
        ])

    def para():
        r = rng.random()
        if rng.random() < 0.2:
            return short()
        inner = text(2, 120)
        if rng.random() < 0.2:
            inner += f' <a href="/{word()}">{text(1, 4, False)}</a> {text(3, 30)}'
        if rng.random() < 0.2:
            inner = f"<b>{inner}</b>" if rng.random() < 0.5 else f"<b>{inner}<br>"
        if r < 0.72:
            return f"<p>{inner}</p>" if rng.random() < 0.9 else f"<p>{inner}"
        if r < 0.82:
            return f"<h2>{text(1, 9, False)}</h2>"
        if r < 0.88:
            return "<ul>" + "".join(f"<li>{text(2, 20)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if r < 0.92:
            return f"<blockquote><p>{text(8, 50)}</p></blockquote>"
        if r < 0.95:
            return "<table>" + "".join(f"<tr><td>{text(1, 5)}</td><td>{text(1, 8)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>"
        if r < 0.97:
            return f"<pre>{text(4, 40)}</pre>"
        return f"<figure><img src=x><figcaption>{text(4, 16)}</figcaption></figure>"

    def article():
        parts = [f"<h1>{text(2, 10, False)}</h1>"] if rng.random() < 0.85 else []
        parts += [para() for _ in range(rng.randint(1, 9))] if rng.random() < 0.9 else [short() for _ in range(rng.randint(1, 3))]
        if rng.random() < 0.3:
            parts.insert(rng.randint(0, len(parts)), boiler(rng.choice(["advert", "share", "notice", "form", "sidebar"])))
        if rng.random() < 0.15:
            return "".join(parts)  # straight in the body
        tag = rng.choice(["article", "article", "article", "main", "div", "div", "section"])
        inner = "".join(parts) if rng.random() < 0.6 else f"<div{attrs('article')}>{''.join(parts)}</div>"
        return f"<{tag}{attrs('article', 0.9 if tag in ('div', 'section') else 0.3)}>{inner}</{tag}>"

    pages = []
    for i in range(count):
        if i % 20 == 0:
            pages.append((text(1, 200) if i % 40 else para() + para(), MARK))  # no page around it
            continue
        before = [boiler(k) for k in ("header", "menu", "notice", "advert") if rng.random() < 0.6]
        after = [boiler(k) for k in ("sidebar", "advert", "comments", "form", "share", "menu", "footer") if rng.random() < 0.5]
        rng.shuffle(before)
        if i % 5 == 1:  # nothing but the article
            before, after = [], []
        body = "".join(before) + article() + "".join(after)
        if rng.random() < 0.4:
            body = f"<div{rng.choice(['', ' class=wrapper', ' id=page', ' class=container'])}>{body}</div>"
        fixed = re.sub(r"<(\w+)([^>]*)>((?:(?!<\w).)*?)</>", r"<\1\2>\3</\1>", body, flags=re.S).replace("</>", "</div>")
        pages.append((f"<!DOCTYPE html><html><head><title>{text(2, 6, False)}</title></head><body>{fixed}</body></html>", MARK))
    return pages


@cache
def default_model() -> Model:
    return train(labelled_pages())


def extract_text(pages: DataFrame, html: str = "html", model: Model | None = None) -> DataFrame:
    """``pages`` without the html column, with text and n_chars (code points). Work is by Arrow batch; nothing is shuffled."""
    model = model or default_model()
    new = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    carry = [c for c in pages.columns if c != html and c not in ("text", "n_chars")]

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                texts = [model.extract(h) for h in part[html].to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part[c] for c in carry], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*carry, "text", "n_chars"])

    return pages.select(*[F.col(f"`{c}`") for c in [*carry, html]]).mapInArrow(run, T.StructType([pages.schema[c] for c in carry] + new))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
