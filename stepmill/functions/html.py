"""HTML to rows: one Arrow-batched parse that yields the nodes of a page.

Markup is read by the standard library's parser.  Rules of its own: comments,
scripts and styles give no text, void elements hold nothing, an end tag closes
the nearest open element of its name, and ``p``, ``li``, ``option``, ``tr``
and ``td`` close one of their own kind.  Broken pages give what was readable;
null and empty pages give no nodes.
"""

from __future__ import annotations

import codecs
import functools
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from stepmill.functions.schema import ATTRS_TYPE
from stepmill.functions.text import class_words

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SAME_CLOSES = frozenset("p li option tr td th dt dd".split())
# Attributes that stand in for text, and those looked for on ancestors.
LABELS = ("aria-label", "placeholder", "value", "title", "alt")
ANCESTOR_LABELS = ("aria-label", "title")
# The elements a user can act on.
INTERACTIVE = "a, button, input, select, option, textarea, [role]"

_S = T.StringType()
_PLACE = [T.StructField("pos", T.IntegerType()), T.StructField("parent", T.IntegerType()), T.StructField("backend_node_id", _S), T.StructField("tag", _S), T.StructField("role", _S), T.StructField("text", _S), T.StructField("attrs", ATTRS_TYPE)]
NODE = T.StructType([*_PLACE, T.StructField("matches", T.ArrayType(T.IntegerType()))])
#: As it leaves the parser: with the class attribute of nodes that have no other text.
_PARSED = T.StructType([*NODE.fields, T.StructField("classes", _S)])
_FOUND = T.StructType([T.StructField("tag", _S), T.StructField("role", _S), T.StructField("text", _S), T.StructField("attrs", ATTRS_TYPE), T.StructField("classes", _S)])
#: Pages whose found nodes are held in Python at once.
PAGES = 200


class _Tree(HTMLParser):
    """Elements in document order (tag, attributes, parent), with their places among siblings and their text pieces."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[tuple[str, dict, int]] = []
        self.pieces: list[tuple[int, str]] = []
        self.open: list[int] = []
        #: Of every node: its place among all siblings, among those of its tag, and the sibling before it.
        self.places: list[tuple[int, int, int]] = []
        self._seen: dict[int, tuple[int, int]] = {}
        self._kinds: dict[tuple[int, str], int] = {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SAME_CLOSES and self.open and self.nodes[self.open[-1]][0] == tag:
            self._close()
        at = len(self.nodes)
        given: dict[str, str] = {}
        for k, v in attrs:
            given.setdefault(k, v or "")
        parent = self.open[-1] if self.open else -1
        self.nodes.append((tag, given, parent))
        n, before = self._seen.get(parent, (0, -1))
        kind = self._kinds.get((parent, tag), 0) + 1
        self.places.append((n + 1, kind, before))
        self._seen[parent], self._kinds[parent, tag] = (n + 1, at), kind
        if tag not in VOID:
            self.open.append(at)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close()

    def _close(self) -> None:
        self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[k]][0] == tag:
                while len(self.open) > k:
                    self._close()
                return

    def handle_data(self, data: str) -> None:
        if self.open and self.nodes[self.open[-1]][0] not in ("script", "style"):
            self.pieces.append((self.open[-1], data))

    def done(self) -> None:
        self.close()
        while self.open:
            self._close()


def _host(href: str) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", href)
    return m.group(1) if m else ""


def compact(attrs: dict) -> dict:
    """The five kept attributes, stripped and cut at 80, and the host of ``href``."""
    out: dict[str, str | None] = {k: (attrs[k].strip()[:80] if attrs.get(k) else None) for k in ATTRS_TYPE.names[:5]}
    out["href"] = _host(attrs.get("href") or "") or None
    return out


def _texts(tree: _Tree) -> list[list[str]]:
    out: list[list[str]] = [[] for _ in tree.nodes]
    for owner, piece in tree.pieces:
        at = owner
        while at >= 0:
            out[at].append(piece)
            at = tree.nodes[at][2]
    return out


def _label(tree: _Tree, at: int, limit: int, pieces: list[str]) -> tuple[str, str | None]:
    """(text, classes): the visible text of a node or what stands in for it; if nothing does, the class attribute for ``page_nodes`` to read."""
    text = " ".join(" ".join(pieces).split())
    attrs, parent = tree.nodes[at][1], tree.nodes[at][2]
    if not text:
        text = next((attrs[k].strip() for k in LABELS if (attrs.get(k) or "").strip()), "")
    steps = 0
    while not text and parent >= 0 and steps < 2:
        above = tree.nodes[parent][1]
        text = next((above[k].strip() for k in ANCESTOR_LABELS if (above.get(k) or "").strip()), "")
        parent, steps = tree.nodes[parent][2], steps + 1
    return text[:limit], (attrs.get("class") or None) if not text else None


_SIMPLE = re.compile(
    r"""(?P<tag>[a-zA-Z][\w-]*|\*)|\#(?P<id>(?:[\w-]|\\.)+)|\.(?P<cls>(?:[\w-]|\\.)+)"""
    r"""|\[\s*(?P<key>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<d>[^"]*)"|'(?P<s>[^']*)'|(?P<w>[^\s"'\]]+))\s*)?\]"""
    r"""|:(?P<nth>nth-child|nth-of-type)\(\s*(?P<n>\d+|odd|even)\s*\)|:(?P<first>first-child|first-of-type)"""
)
_LINK = re.compile(r"\s*([>+~])\s*|\s+")
_ESCAPED = re.compile(r"\\(.)")

#: A test takes (tree, position); a chain holds for each step how it hangs on the one before it, and its tests.
_TestOf = Callable[[_Tree, int], bool]


def _attribute(key: str, op: str | None, want: str) -> _TestOf:
    ways = {
        None: lambda have: True,
        "=": lambda have: have == want,
        "~=": lambda have: want in have.split(),
        "|=": lambda have: have == want or have.startswith(f"{want}-"),
        "^=": lambda have: bool(want) and have.startswith(want),
        "$=": lambda have: bool(want) and have.endswith(want),
        "*=": lambda have: bool(want) and want in have,
    }
    way = ways[op]
    return lambda tree, at: (have := tree.nodes[at][1].get(key)) is not None and way(have)


def _place(which: int, n: str) -> _TestOf:
    if n in ("odd", "even"):
        return lambda tree, at: tree.places[at][which] % 2 == (n == "odd")
    return lambda tree, at: tree.places[at][which] == int(n)


def _compound(text: str, at: int) -> tuple[list[_TestOf], int]:
    """The tests of one element from ``at`` on, and where they end."""
    tests: list[_TestOf] = []
    begin = at
    while at < len(text):
        if text.startswith(":not(", at):
            inner, at = _compound(text, at + 5)
            if not inner or not text.startswith(")", at):
                break
            tests.append(lambda tree, k, inner=inner: not all(f(tree, k) for f in inner))
            at += 1
            continue
        m = _SIMPLE.match(text, at)
        if not m or (m["tag"] and at > begin):
            break
        if m["tag"] and m["tag"] != "*":
            tests.append(lambda tree, k, tag=m["tag"].lower(): tree.nodes[k][0] == tag)
        elif m["tag"]:
            tests.append(lambda tree, k: True)
        elif m["id"]:
            tests.append(_attribute("id", "=", _ESCAPED.sub(r"\1", m["id"])))
        elif m["cls"]:
            tests.append(_attribute("class", "~=", _ESCAPED.sub(r"\1", m["cls"])))
        elif m["key"]:
            tests.append(_attribute(m["key"].lower(), m["op"], next((v for v in (m["d"], m["s"], m["w"]) if v is not None), "")))
        else:
            kind = m["nth"] or m["first"]
            tests.append(_place(1 if kind.endswith("of-type") else 0, m["n"] or "1"))
        at = m.end()
    return tests, at


@functools.lru_cache(1000)
def chains(selector: str) -> tuple[tuple[tuple[str, tuple[_TestOf, ...]], ...], ...]:
    """A selector list read into chains of steps; one that is not understood is a ``ValueError``."""
    out, chain, link, at = [], [], " ", 0
    text = selector.strip()
    while True:
        tests, end = _compound(text, at)
        if not tests:
            raise ValueError(f"selector not understood: {selector}")
        chain.append((link, tuple(tests)))
        comma = re.compile(r"\s*,\s*").match(text, end)
        if end == len(text) or comma:
            out.append(tuple(chain))
            chain, link = [], " "
            if end == len(text):
                return tuple(out)
            at = comma.end()
            continue
        m = _LINK.match(text, end)
        if not m:
            raise ValueError(f"selector not understood: {selector}")
        link, at = m[1] or " ", m.end()


def _fits(tree: _Tree, at: int, chain: tuple, k: int) -> bool:
    """Whether the node and what it hangs on match the first ``k`` + 1 steps of the chain."""
    link, tests = chain[k]
    if not all(f(tree, at) for f in tests):
        return False
    if k == 0:
        return True
    step = (lambda i: tree.nodes[i][2]) if link in " >" else (lambda i: tree.places[i][2])
    at = step(at)
    while at >= 0:
        if _fits(tree, at, chain, k - 1):
            return True
        if link in ">+":
            return False
        at = step(at)
    return False


def select(tree: _Tree, selector: str) -> list[int]:
    """Positions of the elements that a CSS selector matches.

    Types, ids, classes, attributes, ``:nth-child`` and ``:nth-of-type`` of a
    number, odd or even, ``:first-child``, ``:first-of-type``, ``:not``; the
    four ways to combine them, and lists.
    """
    read = chains(selector)
    return [at for at in range(len(tree.nodes)) if any(_fits(tree, at, chain, len(chain) - 1) for chain in read)]


def readable(selector: str | None) -> bool:
    """Whether a selector is understood; null and empty ones are, and match nothing."""
    try:
        return not selector or bool(chains(selector))
    except ValueError:
        return False


_CHARSET = re.compile(rb"<meta[^>]{0,200}?charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)


def decoded(page: bytes) -> str:
    """The text of a page: by its byte order mark, else the character set it declares near its beginning, else UTF-8; what cannot be read is replaced."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if page.startswith(mark):
            return page.decode(name, "replace")
    m = _CHARSET.search(page[:2048])
    try:
        return page.decode(m[1].decode("ascii") if m else "utf-8", "replace")
    except (LookupError, UnicodeDecodeError):
        return page.decode("utf-8", "replace")


def _read(page: str | bytes) -> _Tree:
    tree = _Tree()
    tree.feed(decoded(page) if isinstance(page, bytes) else page)
    tree.done()
    return tree


def parse(page: str | bytes | None, selectors: tuple[str, ...] = (), limit: int = 120) -> list[tuple]:
    """The nodes of a page in document order; ``matches`` holds the positions of the selectors each node fits (unreadable ones fit none)."""
    if not page:
        return []
    tree = _read(page)
    texts = _texts(tree)
    hits: dict[int, list[int]] = {}
    for k, s in enumerate(selectors):
        for at in select(tree, s) if s and readable(s) else []:
            hits.setdefault(at, []).append(k)
    out = []
    for at, (tag, attrs, parent) in enumerate(tree.nodes):
        text, classes = _label(tree, at, limit, texts[at])
        out.append((at, parent, attrs.get("backend_node_id"), tag, attrs.get("role") or None, text, tuple(compact(attrs).values()), hits.get(at, []), classes))
    return out


def find(page: str | bytes | None, ids: list[str | None], limit: int = 120) -> list[tuple | None]:
    """For each of ``ids`` (tag, role, text, attrs, classes) of the first node with that ``backend_node_id``, None where there is none."""
    if not page:
        return [None] * len(ids)
    tree = _read(page)
    texts = _texts(tree)
    first: dict[str | None, int] = {}
    for at, (_, attrs, _) in enumerate(tree.nodes):
        first.setdefault(attrs.get("backend_node_id"), at)
    out: list[tuple | None] = []
    for node in ids:
        at = first.get(node) if node is not None else None
        if at is None:
            out.append(None)
            continue
        tag, attrs, _ = tree.nodes[at]
        text, classes = _label(tree, at, limit, texts[at])
        out.append((tag, attrs.get("role") or None, text, compact(attrs), classes))
    return out


def _named(limit: int) -> Callable[[Column], Column]:
    """A node as it leaves the parser, named by the words of its class if it has no other text."""
    named = lambda n: F.when(n.getField("classes").isNotNull(), F.substring(class_words(n.getField("classes")), 1, limit)).otherwise(n.getField("text"))
    return lambda n: n.withField("text", named(n)).dropFields("classes")


def page_nodes(html: Column, selector: Column | None = None, limit: int = 120) -> Column:
    """Array of the nodes of a page (text or bytes); with a selector, matches holds 0 for its hits and 1 for interactive elements.

    Nodes without any text but with a class are named by its words, which is
    worked out in the JVM.
    """

    @F.arrow_udf(T.ArrayType(_PARSED))
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = to_arrow_type(T.ArrayType(_PARSED))
        names = _PARSED.names
        for pages, chosen in batches:
            rows = []
            for page, wanted in zip(pages.to_pylist(), chosen.to_pylist(), strict=True):
                found = parse(page, (wanted, INTERACTIVE) if wanted else (), limit)
                rows.append([dict(zip(names, (*n[:6], dict(zip(ATTRS_TYPE.names, n[6], strict=True)), *n[7:]), strict=True)) for n in found])
            yield pa.array(rows, type=kind)

    parsed = run(html, selector if selector is not None else F.lit(None).cast("string"))
    return F.transform(parsed, _named(limit))


def nodes_by_id(html: Column, ids: Column, limit: int = 120) -> Column:
    """Array with the node (tag, role, text, attrs) of a page (text or bytes) for each of ``ids``: the first one of that ``backend_node_id``, null where there is none.

    Only these nodes leave Python, ``PAGES`` pages at a time, so a batch needs
    little more memory than its pages.
    """

    @F.arrow_udf(T.ArrayType(_FOUND))
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = to_arrow_type(T.ArrayType(_FOUND))
        names = _FOUND.names
        for pages, wanted in batches:
            for at in range(0, len(pages), PAGES):
                rows = []
                for page, asked in zip(pages.slice(at, PAGES).to_pylist(), wanted.slice(at, PAGES).to_pylist(), strict=True):
                    rows.append([n and dict(zip(names, n, strict=True)) for n in find(page, asked or [], limit)])
                yield pa.array(rows, type=kind)

    return F.transform(run(html, ids), _named(limit))


@F.arrow_udf(T.BooleanType())
def is_readable(selectors: pa.Array) -> pa.Array:
    """``readable`` of a column of selectors."""
    return pa.array([readable(s) for s in selectors.to_pylist()], type=pa.bool_())
