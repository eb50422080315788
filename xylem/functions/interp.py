"""XPath over one document's tree: for expressions that come from a column, for streams, and as the yardstick of the relational plans.

A node is (pre, order, name, value): order 0 for nodes of the tree, 1.. for namespaces, 1000.. for attributes of the
element ``pre``. Tuples sort in document order.
"""

from __future__ import annotations

import math
from functools import lru_cache

from xylem.plans import grammar as g
from xylem.sources.markup import ATTRIBUTE, COMMENT, ELEMENT, NAMESPACE, PI, ROOT, TEXT, Tree, decode, partition, start_tag, tokens_of

from . import values as v

FIRST_ATTRIBUTE = 1000
XML = "http://www.w3.org/XML/1998/namespace"


@lru_cache(maxsize=4096)
def compiled(xpath: str):
    return g.simplify(g.parse(xpath))


class Evaluator:
    def __init__(self, tree: Tree):
        self.t = tree
        self._values: list[str] | None = None
        self._children: list[list[int]] | None = None

    # values of nodes

    def kind(self, n) -> str:
        return self.t.kind[n[0]] if n[1] == 0 else ATTRIBUTE if n[1] >= FIRST_ATTRIBUTE else NAMESPACE

    def value(self, n) -> str:
        if n[1]:
            return n[3]
        if self._values is None:
            self._values = self.t.values()
        return self._values[n[0]] or ""

    def name(self, n) -> str:
        return (n[2] if n[1] else self.t.name[n[0]]) or ""

    def uri(self, n) -> str:
        if n[1] >= FIRST_ATTRIBUTE:
            return self.t.attrs[n[0]][n[1] - FIRST_ATTRIBUTE][2] or ""
        return "" if n[1] else self.t.uri[n[0]] or ""

    # axes: in the axis' own order

    def node(self, k: int):
        return (k, 0, None, None)

    def children(self, k: int) -> list[int]:
        if self._children is None:
            self._children = [[] for _ in self.t.end]
            for c, p in enumerate(self.t.parent):
                if p is not None:
                    self._children[p].append(c)
        return self._children[k]

    def up(self, n) -> int | None:
        return n[0] if n[1] else self.t.parent[n[0]]

    def axis(self, name: str, n):
        t, k, plain = self.t, n[0], n[1] == 0
        if name == "self":
            return [n]
        if name == "child":
            return map(self.node, self.children(k)) if plain else ()
        if name == "descendant":
            return map(self.node, range(k + 1, t.end[k] + 1)) if plain else ()
        if name == "descendant-or-self":
            return [n, *map(self.node, range(k + 1, t.end[k] + 1))] if plain else [n]
        if name == "parent":
            p = self.up(n)
            return () if p is None else [self.node(p)]
        if name in ("ancestor", "ancestor-or-self"):
            out = [n] if name == "ancestor-or-self" else []
            p = self.up(n)
            while p is not None:
                out.append(self.node(p))
                p = t.parent[p]
            return out
        if name == "attribute":
            found = t.attrs[k] if plain and t.attrs[k] else ()
            return [(k, FIRST_ATTRIBUTE + i, a, x) for i, (a, x, _) in enumerate(found) if a != "xmlns" and not a.startswith("xmlns:")]
        if name == "namespace":
            if not plain or t.kind[k] != ELEMENT:
                return ()
            own = sorted((p, u) for p, u in (t.scope[k] or {}).items() if p and p != "xml")
            return [(k, 1 + i, p, u) for i, (p, u) in enumerate([*own, ("xml", XML)])]  # the prefix xml is always bound
        if name == "following":
            return map(self.node, range((t.end[k] if plain else k) + 1, len(t.end)))
        if name == "preceding":
            return (self.node(p) for p in range(k - 1, 0, -1) if t.end[p] < k)
        if not plain or t.parent[k] is None:
            return ()
        family = self.children(t.parent[k])
        if name == "following-sibling":
            return [self.node(c) for c in family if c > k]
        return [self.node(c) for c in reversed(family) if c < k]

    def matches(self, axis: str, test: g.Test, n) -> bool:
        if test.kind == "node":
            return True
        kind = self.kind(n)
        principal = kind == {"attribute": ATTRIBUTE, "namespace": NAMESPACE}.get(axis, ELEMENT)
        if test.kind == "any":
            return principal
        if test.kind == "name":
            return principal and self.name(n) == test.value
        if test.kind == "prefix":
            return principal and self.name(n).startswith(test.value + ":")
        if test.kind == "pi":
            return kind == PI and test.value in (None, self.name(n))
        return kind == {"text": TEXT, "comment": COMMENT}[test.kind]

    # expressions

    def keep(self, nodes: list, predicates: tuple) -> list:
        for p in predicates:
            size, by_number = len(nodes), g.kind(p) == g.NUMBER
            kept = []
            for i, n in enumerate(nodes, 1):
                got = self.evaluate(p, n, i, size)
                if got == i if by_number else self.truth(got):
                    kept.append(n)
            nodes = kept
        return nodes

    def path(self, e: g.Path, n, pos: int, size: int) -> list:
        current = self.evaluate(e.start, n, pos, size) if e.start is not None else [self.node(0)] if e.absolute else [n]
        for step in e.steps:
            found = {}
            for c in current:
                hits = [x for x in self.axis(step.axis, c) if self.matches(step.axis, step.test, x)]
                for x in self.keep(hits, step.predicates) if step.predicates else hits:
                    found[x] = None
            current = sorted(found)
        return current

    def truth(self, x) -> bool:
        return bool(x) and x == x if isinstance(x, float) else bool(x)

    def string(self, x) -> str:
        if isinstance(x, list):
            return self.value(x[0]) if x else ""
        if isinstance(x, bool):
            return "true" if x else "false"
        return v.format_number(x) if isinstance(x, float) else x

    def number(self, x) -> float:
        if isinstance(x, bool):
            return float(x)
        return x if isinstance(x, float) else v.to_number(self.string(x))

    def evaluate(self, e, n, pos: int = 1, size: int = 1):
        if isinstance(e, g.Literal | g.Number):
            return e.value
        if isinstance(e, g.Path):
            return self.path(e, n, pos, size)
        if isinstance(e, g.Filter):
            return self.keep(self.evaluate(e.base, n, pos, size), e.predicates)
        if isinstance(e, g.Union):
            return sorted({*self.evaluate(e.left, n, pos, size), *self.evaluate(e.right, n, pos, size)})
        if isinstance(e, g.Negate):
            return -self.number(self.evaluate(e.value, n, pos, size))
        if isinstance(e, g.Call):
            return self.call(e, n, pos, size)
        if e.op in ("or", "and"):
            left = self.truth(self.evaluate(e.left, n, pos, size))
            return left if left == (e.op == "or") else self.truth(self.evaluate(e.right, n, pos, size))
        a, b = self.evaluate(e.left, n, pos, size), self.evaluate(e.right, n, pos, size)
        if e.op in ("=", "!=", "<", "<=", ">", ">="):
            return self.compare(e.op, a, b)
        a, b = self.number(a), self.number(b)
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "div": lambda: v.divide(a, b), "mod": lambda: v.modulo(a, b)}[e.op]()

    def compare(self, op: str, a, b) -> bool:
        if isinstance(a, list) and isinstance(b, bool):
            return self.compare(op, bool(a), b)
        if isinstance(b, list) and isinstance(a, bool):
            return self.compare(op, a, bool(b))
        if isinstance(a, list):
            return any(self.compare(op, self.value(x), b) for x in a)
        if isinstance(b, list):
            return any(self.compare(op, a, self.value(x)) for x in b)
        if op in ("=", "!="):
            if isinstance(a, bool) or isinstance(b, bool):
                equal = self.truth(a) == self.truth(b)
            elif isinstance(a, float) or isinstance(b, float):
                equal = self.number(a) == self.number(b)
            else:
                equal = a == b
            return equal == (op == "=")
        a, b = self.number(a), self.number(b)
        return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]

    def call(self, e: g.Call, n, pos: int, size: int):
        name = e.name
        if name == "position":
            return float(pos)
        if name == "last":
            return float(size)
        if name in ("true", "false"):
            return name == "true"
        args = [self.evaluate(a, n, pos, size) for a in e.args]
        if name == "count":
            return float(len(args[0]))
        if name == "sum":
            return math.fsum(xs) if all(map(math.isfinite, xs := [self.number(self.value(x)) for x in args[0]])) else sum(xs)
        if name in ("boolean", "not"):
            return self.truth(args[0]) == (name == "boolean")
        if name == "id":
            wanted = {w for s in ([self.value(x) for x in args[0]] if isinstance(args[0], list) else [self.string(args[0])]) for w in s.split()}
            found: dict[str, int] = {}
            for k, attrs in enumerate(self.t.attrs):
                for a, x, _ in attrs or ():
                    if a == "id" and x in wanted:
                        found.setdefault(x, k)
            return sorted({self.node(k) for k in found.values()})
        if name == "lang":
            have = (self.t.lang[n[0]] or "").lower()
            want = self.string(args[0]).lower()
            return bool(have) and (have == want or have.startswith(want + "-"))
        if name in ("name", "local-name", "namespace-uri"):
            if args and not args[0]:
                return ""
            first = args[0][0] if args else n
            if name == "namespace-uri":
                return self.uri(first)
            return self.name(first) if name == "name" else self.name(first).rpartition(":")[2]
        if name in ("floor", "ceiling", "round"):
            x = self.number(args[0])
            if math.isnan(x) or math.isinf(x):
                return x
            if name == "round":
                return v.round_half_up(x)
            whole = float((math.floor if name == "floor" else math.ceil)(x))
            return whole or math.copysign(0.0, x)
        if name == "number":
            return self.number(args[0] if args else self.value(n))
        s = [self.string(x) for x in args] or [self.value(n)] * (name != "concat")
        if name == "string":
            return s[0]
        if name == "concat":
            return "".join(s)
        if name == "string-length":
            return float(len(s[0]))
        if name == "normalize-space":
            return _spaces(s[0])
        if name == "starts-with":
            return s[0].startswith(s[1])
        if name == "contains":
            return s[1] in s[0]
        if name == "substring-before":
            return s[0].partition(s[1])[0] if s[1] and s[1] in s[0] else ""
        if name == "substring-after":
            return s[0].partition(s[1])[2] if s[1] and s[1] in s[0] else "" if s[1] else s[0]
        if name == "translate":
            return v.translate(*s)
        return v.substring(s[0], self.number(args[1]), self.number(args[2]) if len(args) > 2 else None)


def _spaces(s: str) -> str:
    for c in "\t\r\n":
        s = s.replace(c, " ")
    return " ".join(w for w in s.split(" ") if w)


def document_element(tree: Tree) -> int:
    """The first element of the document, or the root where there is none."""
    return next((k for k, kind in enumerate(tree.kind) if kind == ELEMENT), 0)


def evaluate(xml: str, xpath: str, context: str = "element"):
    """(evaluator, result) of an expression over one text; relative paths start at the document element or the root."""
    tree = Tree(xml)
    e = Evaluator(tree)
    return e, e.evaluate(compiled(xpath), e.node(document_element(tree) if context == "element" else 0))


def texts(xml: str | None, xpath: str, context: str = "root") -> list[str]:
    """Raw text runs of the result: each direct run of an element, text nodes themselves, values of attributes; scalars as strings."""
    if xml is None:
        return []
    e, got = evaluate(xml, xpath, context)
    if not isinstance(got, list):
        return [e.string(got)]
    out = []
    for n in got:
        kind = e.kind(n)
        if kind in (ATTRIBUTE, NAMESPACE):
            out.append(e.value(n))
        elif kind == TEXT:
            out.append(e.t.text[n[0]])
        elif kind in (ELEMENT, ROOT):
            out += [e.t.text[c] for c in e.children(n[0]) if e.t.kind[c] == TEXT]
        else:
            out.append(e.t.text[n[0]])
    return [x for x in out if x]


def strings(xml: str | None, xpath: str, context: str = "element") -> list[str]:
    """String-values of the result's nodes; a scalar's string."""
    if xml is None:
        return []
    e, got = evaluate(xml, xpath, context)
    return [e.value(n) for n in got] if isinstance(got, list) else [e.string(got)]


def raws(xml: str | None, xpath: str, context: str = "element") -> list[str]:
    """The pieces of the text that the result's nodes are; an attribute's is its value."""
    if xml is None:
        return []
    e, got = evaluate(xml, xpath, context)
    return [e.value(n) if n[1] else xml[e.t.start[n[0]] : e.t.stop[n[0]]] for n in got] if isinstance(got, list) else [e.string(got)]


_ESCAPES = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", "\r": "&#xD;"})
_ATTRIBUTE_ESCAPES = str.maketrans({"&": "&amp;", "<": "&lt;", '"': "&quot;", "\t": "&#x9;", "\n": "&#xA;", "\r": "&#xD;"})


def canonical(xml: str | None, xpath: str = "/*") -> list[str]:
    """Each node of the result with sorted attributes, empty elements written out and everything escaped anew."""
    if xml is None:
        return []
    path = compiled(xpath)
    if isinstance(path, g.Path) and path.start is None and path.absolute and len(path.steps) == 1:
        step = path.steps[0]
        if step.axis == "child" and step.test.kind in ("name", "any") and not step.predicates:
            return _top_elements(xml, step.test.value if step.test.kind == "name" else None)
    e, got = evaluate(xml, xpath, "root")
    t, out = e.t, []
    for n in got if isinstance(got, list) else ():
        pieces, todo = [], [n[0] if not n[1] else e.value(n).translate(_ATTRIBUTE_ESCAPES)]
        while todo:
            k = todo.pop()
            if isinstance(k, str):
                pieces.append(k)
            elif t.kind[k] == TEXT:
                pieces.append(t.decoded[k].translate(_ESCAPES))
            elif t.kind[k] == COMMENT:
                pieces.append(f"<!--{t.text[k]}-->")
            elif t.kind[k] == PI:
                pieces.append(f"<?{t.name[k]}{' ' if t.text[k] else ''}{t.text[k]}?>")
            else:
                if t.kind[k] == ELEMENT:
                    pieces.append(_start(t.name[k], t.attrs[k]))
                    todo.append(f"</{t.name[k]}>")
                todo += reversed(e.children(k))
        out.append("".join(pieces))
    return out


def _start(name: str, attrs) -> str:
    attrs = sorted(attrs or (), key=lambda a: (a[0] != "xmlns" and not a[0].startswith("xmlns:"), a[0]))
    return f"<{name}" + "".join(f' {a}="{x.translate(_ATTRIBUTE_ESCAPES)}"' for a, x, *_ in attrs) + ">"


class _Starts(dict):
    """(name, whether it has no content, canonical form) of start tags; remembered as tags are in ``markup``."""

    chars = 0

    def __missing__(self, token: str):
        if len(self) > 20_000 or self.chars > 4_000_000:
            self.clear()
            self.chars = 0
        name, closed, attrs, _ = start_tag(token)
        self[token] = value = name, closed, _start(name, attrs)
        self.chars += len(token)
        return value


_STARTS = _Starts()


def _top_elements(xml: str, name: str | None) -> list[str]:
    """The canonical form of the elements outside of all others, of one name or all: straight from the tokens, without a tree."""
    tokens = tokens_of(xml)
    if tokens is None:
        return []
    out, open_, pieces = [], [], []
    last = len(tokens) - 1
    for k, token in enumerate(tokens):
        if token[0] != "<":
            if open_ and k < last:
                if "&" in token:
                    token = decode(token)
                    plain = False
                else:
                    plain = ">" not in token and "\r" not in token
                pieces.append(token if plain else token.translate(_ESCAPES))
            continue
        sign = token[1]
        if sign == "/":
            if open_:
                pieces.append(f"</{open_.pop()}>")
        elif sign == "!" or sign == "?":
            if open_:
                if token.startswith("<!--"):
                    pieces.append(f"<!--{token[4:-3] if len(token) > 6 and token.endswith('-->') else token[4:]}-->")
                elif token.startswith("<![CDATA["):
                    pieces.append((token[9:-3] if token.endswith("]]>") else token[9:]).translate(_ESCAPES))
                elif sign == "?":
                    target, _, text = partition(token[2:-2] if len(token) > 3 and token.endswith("?>") else token[2:])
                    pieces.append(f"<?{target}{' ' if text else ''}{text}?>")
            continue
        else:
            own, closed, text = _STARTS[token]
            if not open_:
                top, pieces = own, []
            pieces.append(text)
            if closed:
                pieces.append(f"</{own}>")
            else:
                open_.append(own)
        if not open_ and pieces:
            if name is None or top == name:
                out.append("".join(pieces))
            pieces = []
    if open_:
        pieces += [f"</{x}>" for x in reversed(open_)]
        if name is None or top == name:
            out.append("".join(pieces))
    return out
