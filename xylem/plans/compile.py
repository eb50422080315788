"""XPath 1.0 to DataFrame plans over a node table (see ``xylem.sources.markup``): joins, windows and aggregates only.

A node-set in context is a DataFrame of KEY (the document and the context node that it belongs to) and NODE columns.
Axes are joins within a document, on the parent's number or on intervals of numbers. Predicates become columns; what they need from other
nodes is computed once for all contexts and joined back (no loop over nodes). Leading steps that only go down and have no
predicate before the last are one filter on the node's label path: no join at all.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from xylem.functions import values as v

from . import grammar as g

KEY = ["doc_id", "cp", "ca"]
NODE = ["pre", "aord", "end", "parent", "depth", "kind", "name", "path", "text", "value", "attrs", "uri", "lang", "scope", "start_off", "end_off"]
STEP = ["sp", "sa"]
FIRST_ATTRIBUTE = 1000
SCOPE, XML = "array<struct<prefix:string,uri:string>>", "http://www.w3.org/XML/1998/namespace"


def _c(name: str) -> Column:
    return F.col(name)


def test_column(axis: str, test: g.Test) -> Column:
    """Whether a node passes a node test."""
    principal = _c("kind") == {"attribute": "attribute", "namespace": "namespace"}.get(axis, "element")
    if test.kind == "node":
        return F.lit(True)
    if test.kind == "any":
        return principal
    if test.kind == "name":
        return principal & (_c("name") == test.value)
    if test.kind == "prefix":
        return principal & _c("name").startswith(test.value + ":")
    if test.kind == "pi":
        return (_c("kind") == "pi") & ((_c("name") == test.value) if test.value is not None else F.lit(True))
    return _c("kind") == test.kind


def _plain_attribute(e) -> g.Test | None:
    """The name test of ``@name``, seen from the context node; None for anything else."""
    if isinstance(e, g.Path) and e.start is None and not e.absolute and len(e.steps) == 1:
        s = e.steps[0]
        if s.axis == "attribute" and s.test.kind in ("name", "any") and not s.predicates:
            return s.test
    return None


def _self(e) -> bool:
    return isinstance(e, g.Path) and e.start is None and not e.absolute and e.steps == (g.Step("self", g.Test("node")),)


def _document_wide(e) -> bool:
    """Whether a node-set is the same for every context node of a document."""
    if isinstance(e, g.Union):
        return _document_wide(e.left) and _document_wide(e.right)
    if isinstance(e, g.Filter):
        return _document_wide(e.base)
    return isinstance(e, g.Path) and (e.absolute if e.start is None else _document_wide(e.start))


def _disjoint(a, b) -> bool:
    """Whether two node-sets surely have no node in common: elements of different names."""
    last = [x.steps[-1] for x in (a, b) if isinstance(x, g.Path) and x.steps]
    return len(last) == 2 and all(x.test.kind == "name" and x.axis not in ("attribute", "namespace") for x in last) and last[0].test.value != last[1].test.value


def _climb(e) -> tuple[int, g.Path | None]:
    """(n, rest) of a path that first goes up to parents n times and then to children, whatever its context; (0, None) for anything else."""
    if not isinstance(e, g.Path) or e.start is not None or e.absolute:
        return 0, None
    n = 0
    while n < len(e.steps) and e.steps[n] == g.Step("parent", g.Test("node")):
        n += 1
    if not n or n == len(e.steps) or e.steps[n].axis != "child" or any(map(g.positional, e.steps[n].predicates)):
        return 0, None
    return n, g.Path(e.steps[n:])


def _child_name(e) -> str | None:
    """The name in ``name`` as a path to children; None for anything else."""
    if isinstance(e, g.Path) and e.start is None and not e.absolute and len(e.steps) == 1 and e.steps[0].axis == "child" and e.steps[0].test.kind == "name" and not e.steps[0].predicates:
        return e.steps[0].test.value
    return None


def merged(right: DataFrame) -> DataFrame:
    """The right side of a join, which is to be sorted and merged: what a stored table's size lets Spark expect is far less than its rows take in memory, so that it would be broadcast."""
    return right.hint("merge")


def _own_attributes(test: g.Test) -> Column:
    def good(a: Column) -> Column:
        if test.kind == "name":
            return a["name"] == test.value
        return ~(a["name"].startswith("xmlns:") | (a["name"] == "xmlns"))

    return F.filter(_c("attrs"), good)


class Plan:
    """Plans over one node table. ``context``: where relative paths start, ``root`` or ``element`` (the first one of the document)."""

    def __init__(self, nodes: DataFrame, context: str = "root"):
        have = set(nodes.columns)
        missing = {c: F.lit(None).cast("string") for c in NODE if c not in have} | {"aord": F.lit(0)}
        self._n = nodes.select("doc_id", *[missing[c].alias(c) if c not in have else _c(c) for c in NODE])
        self.context, self.reads = context, 0

    @property
    def n(self) -> DataFrame:
        """The nodes; ``reads`` counts how often a plan looks at them."""
        self.reads += 1
        return self._n

    # node-sets

    def start(self) -> DataFrame:
        """The context nodes of whole documents, each its own context."""
        roots = self.n.where("pre = 0")
        if self.context == "element":
            first = self.n.where("kind = 'element' and parent = 0").groupBy("doc_id").agg(F.min("pre").alias("p"))
            roots = self.n.join(merged(first), "doc_id").where("pre = p").drop("p")
        return roots.select("doc_id", F.lit(0).alias("cp"), F.lit(0).alias("ca"), *NODE)

    def top(self, e) -> DataFrame:
        """The node-set of an expression over every document: doc_id and NODE columns, without repetitions."""
        return self.nodeset(e, None).select("doc_id", *NODE)

    def nodeset(self, e, ctx: DataFrame | None) -> DataFrame:
        """KEY and NODE columns, distinct; ``ctx`` has them too, each row the context node itself. None: whole documents."""
        if isinstance(e, g.Union):
            both = self.nodeset(e.left, ctx).unionByName(self.nodeset(e.right, ctx))
            return both if _disjoint(e.left, e.right) else both.dropDuplicates([*KEY, "pre", "aord"])
        if isinstance(e, g.Filter):
            base = self.nodeset(e.base, ctx)
            return self.filtered(base.withColumns({"sp": _c("cp"), "sa": _c("ca")}), e.predicates, False).drop(*STEP)
        if isinstance(e, g.Call):
            return self.by_id(e.args[0], ctx)
        if e.start is not None:
            return self.walk(self.nodeset(e.start, ctx), e.steps, single=False, whole=ctx is None)
        if e.absolute:
            return self.absolute(e.steps, ctx)
        if ctx is None:
            return self.walk(self.start(), e.steps, single=True, whole=True)
        return self.walk(ctx, e.steps, single=True)

    def from_nodes(self, e, starts: DataFrame) -> DataFrame:
        """The node-set for each of the nodes (doc_id, pre) as its context. Children know their parent: for a first step to them the contexts aren't looked up."""
        if isinstance(e, g.Union):
            both = self.from_nodes(e.left, starts).unionByName(self.from_nodes(e.right, starts))
            return both if _disjoint(e.left, e.right) else both.dropDuplicates([*KEY, "pre", "aord"])
        chosen = merged(starts.select(_c("doc_id").alias("c_doc"), _c("pre").alias("c_pre")))
        if isinstance(e, g.Path) and e.start is None and not e.absolute and e.steps and e.steps[0].axis == "child":
            kids = self.n.where(test_column("child", e.steps[0].test)).join(chosen, (_c("doc_id") == _c("c_doc")) & (_c("parent") == _c("c_pre")), "left_semi")
            kids = kids.select("doc_id", _c("parent").alias("cp"), F.lit(0).alias("ca"), _c("parent").alias("sp"), F.lit(0).alias("sa"), *NODE)
            return self.walk(self.filtered(kids, e.steps[0].predicates, False).drop(*STEP), e.steps[1:], single=False)
        own = self.n.join(chosen, (_c("doc_id") == _c("c_doc")) & (_c("pre") == _c("c_pre")), "left_semi")
        return self.nodeset(e, own.select("doc_id", _c("pre").alias("cp"), F.lit(0).alias("ca"), *NODE))

    def absolute(self, steps: tuple, ctx: DataFrame | None) -> DataFrame:
        found = self.from_root(steps)
        if ctx is None:
            return found
        return ctx.select(*KEY).join(merged(found.drop("cp", "ca")), "doc_id")

    def from_root(self, steps: tuple) -> DataFrame:
        """An absolute path's nodes, with the root as their context: the longest possible start as one filter."""
        if len(steps) > 1 and steps[0] == g.ANY_DEPTH and steps[1].axis == "child":
            # //T[position]: every T, counted among its parent's children
            hits = self.n.where(test_column("child", steps[1].test) & _c("parent").isNotNull())
            hits = hits.select("doc_id", F.lit(0).alias("cp"), F.lit(0).alias("ca"), _c("parent").alias("sp"), F.lit(0).alias("sa"), *NODE)
            return self.walk(self.filtered(hits, steps[1].predicates, False).drop(*STEP), steps[2:], single=False, whole=True)
        pattern, used, counted = "", 0, False
        for step in steps:
            name = {"name": lambda s: re.escape(s.test.value), "any": lambda s: "[^/]+"}.get(step.test.kind)
            counted = any(map(g.positional, step.predicates))
            # children are counted below their parent, whose number they have
            if step.axis not in ("child", "descendant", "descendant-or-self") or not name or counted and step.axis != "child" or step.axis == "descendant-or-self" and not used:
                break
            if step.axis == "descendant-or-self":
                pattern += "(?:/[^/]+)*" + (f"(?<=/{name(step)})" if step.test.kind == "name" else "")
            else:
                pattern += ("/" if step.axis == "child" else "(?:/[^/]+)*/") + name(step)
            used += 1
            if step.predicates:
                break
        if not used:
            root = self.n.where("pre = 0").select("doc_id", F.lit(0).alias("cp"), F.lit(0).alias("ca"), *NODE)
            return self.walk(root, steps, single=True, whole=True)
        last = steps[used - 1]
        # the test on the name reaches the Parquet scan, a lone descendant step needs no pattern
        hits = self.n.where(test_column(last.axis, last.test))
        if not (used == 1 and last.axis == "descendant"):
            hits = hits.where(_c("path").rlike(f"^{pattern}$"))
        hits = hits.select("doc_id", F.lit(0).alias("cp"), F.lit(0).alias("ca"), *NODE)
        if last.predicates:
            counted = any(map(g.positional, last.predicates))
            hits = self.filtered(hits.withColumns({"sp": _c("parent") if counted else F.lit(0), "sa": F.lit(0)}), last.predicates, False).drop(*STEP)
        return self.walk(hits, steps[used:], single=False, whole=True)

    def walk(self, current: DataFrame, steps: tuple, single: bool, whole: bool = False) -> DataFrame:
        """``single``: current has one node for each context, so that axes can't meet the same node twice. ``whole``: all of a document's nodes have the same context."""
        for step in steps:
            if whole and step.axis not in ("self", "attribute", "namespace") and not any(map(g.positional, step.predicates)):
                found = self.axis(current, step, met=True)
                current, single = self.filtered(found, step.predicates, False).drop(*STEP), False
                continue
            found = self.axis(current, step)
            found = self.filtered(found, step.predicates, step.axis in g.REVERSE)
            apart = single or step.axis in ("child", "self", "attribute", "namespace")
            current = found.drop(*STEP) if apart else found.dropDuplicates([*KEY, "pre", "aord"]).drop(*STEP)
            single = single and step.axis in ("self", "parent")
        return current

    def axis(self, current: DataFrame, step: g.Step, met: bool = False) -> DataFrame:
        """The nodes that a step reaches: KEY, STEP (the node it went out from) and NODE columns. ``met``: each node once, whichever node it went out from, and that all are of whole documents."""
        axis, good = step.axis, test_column(step.axis, step.test)
        if axis == "self":
            return current.where(good).withColumns({"sp": _c("pre"), "sa": _c("aord")})
        if axis in ("attribute", "namespace"):
            return self.leaves(current, axis).where(good)
        old = {c: f"o_{c}" for c in ("pre", "aord", "end", "parent")}
        c = current.select(*KEY, *[_c(a).alias(b) for a, b in old.items()]).withColumnRenamed("doc_id", "o_doc")
        n = self.n.where(good & _c("kind").isin("element", "root") if axis in ("parent", "ancestor") else good)
        tree, up = _c("o_aord") == 0, F.when(_c("o_aord") == 0, _c("o_parent")).otherwise(_c("o_pre"))
        on = {
            "child": tree & (_c("parent") == _c("o_pre")),
            "descendant": tree & (_c("pre") > _c("o_pre")) & (_c("pre") <= _c("o_end")),
            "descendant-or-self": tree & (_c("pre") >= _c("o_pre")) & (_c("pre") <= _c("o_end")),
            "parent": _c("pre") == up,
            "ancestor": (_c("pre") <= up) & (_c("end") >= up),
            "ancestor-or-self": ((_c("pre") <= up) & (_c("end") >= up)) | (tree & (_c("pre") == _c("o_pre"))),
            "following-sibling": tree & (_c("parent") == _c("o_parent")) & (_c("pre") > _c("o_pre")),
            "preceding-sibling": tree & (_c("parent") == _c("o_parent")) & (_c("pre") < _c("o_pre")),
            "following": _c("pre") > F.when(tree, _c("o_end")).otherwise(_c("o_pre")),
            "preceding": (_c("end") < _c("o_pre")) & (_c("pre") > 0),
        }[axis]
        if met:
            zero = [F.lit(0).alias(x) for x in ("cp", "ca", *STEP)]
            out = n.join(merged(c), (_c("doc_id") == _c("o_doc")) & on, "left_semi").select("doc_id", *zero, *NODE)
        else:
            found = c.join(merged(n), (_c("doc_id") == _c("o_doc")) & on)
            out = found.select("doc_id", "cp", "ca", _c("o_pre").alias("sp"), _c("o_aord").alias("sa"), *NODE)
        if axis.endswith("-or-self"):
            own = current.where((_c("aord") > 0) & good).withColumns({x: F.lit(0) for x in STEP} if met else {"sp": _c("pre"), "sa": _c("aord")})
            out = out.unionByName(own.select(out.columns))
        return out

    @staticmethod
    def leaves(current: DataFrame, axis: str) -> DataFrame:
        keep = [c for c in NODE if c not in ("aord", "kind", "name", "value", "text", "uri", "attrs", "parent")]
        base = current.where("aord = 0 and kind = 'element'")
        bound = F.struct(F.lit("xml").alias("prefix"), F.lit(XML).alias("uri"))  # on every element
        own = _c("attrs") if axis == "attribute" else F.concat(F.coalesce(_c("scope"), F.array().cast(SCOPE)), F.array(bound).cast(SCOPE))
        many = base.select(*KEY, *keep, F.posexplode(own).alias("i", "x"))
        if axis == "attribute":
            many = many.where(~(_c("x.name").startswith("xmlns:") | (_c("x.name") == "xmlns")))
        name, value = ("x.name", "x.value") if axis == "attribute" else ("x.prefix", "x.uri")
        made = {
            "aord": _c("i") + (FIRST_ATTRIBUTE if axis == "attribute" else 1),
            "kind": F.lit(axis),
            "name": _c(name),
            "value": _c(value),
            "text": _c(value),
            "uri": _c("x.uri") if axis == "attribute" else F.lit(None).cast("string"),
            "attrs": F.lit(None).cast("array<struct<name:string,value:string,uri:string>>"),
            "parent": _c("pre"),
        }
        return many.select(*KEY, _c("pre").alias("sp"), F.lit(0).alias("sa"), *[made[c].alias(c) if c in made else _c(c) for c in NODE])

    def by_id(self, arg, ctx: DataFrame | None) -> DataFrame:
        """Elements whose attribute ``id`` is one of the argument's words; of several with the same one the first."""
        ids = self.n.where(F.exists("attrs", lambda a: a["name"] == "id"))
        ids = ids.withColumn("i", F.explode(F.filter("attrs", lambda a: a["name"] == "id"))).withColumn("i", _c("i.value"))
        first = ids.groupBy("doc_id", "i").agg(F.min_by(F.struct(*NODE), "pre").alias("x"))
        words = lambda s: F.explode(F.split(v.normalized(s), " "))
        if isinstance(arg, g.Literal):
            wanted = (ctx.select(*KEY) if ctx is not None else self.start().select(*KEY)).withColumn("w", words(F.lit(arg.value)))
        elif g.kind(arg) == g.NODESET:
            wanted = self.nodeset(arg, ctx).select(*KEY, words(_c("value")).alias("w"))
        else:
            base = (ctx if ctx is not None else self.start()).withColumns({"sp": _c("cp"), "sa": _c("ca")})
            base, s = self.scalar(base, arg, g.STRING)
            wanted = base.select(*KEY, words(s).alias("w"))
        wanted = wanted.distinct().withColumnRenamed("doc_id", "o_doc")
        found = wanted.join(merged(first), (_c("o_doc") == _c("doc_id")) & (_c("w") == _c("i")))
        return found.select("doc_id", "cp", "ca", *[_c(f"x.{c}").alias(c) for c in NODE]).dropDuplicates([*KEY, "pre", "aord"])

    # predicates

    def filtered(self, s: DataFrame, predicates: tuple, reverse: bool) -> DataFrame:
        """Rows of ``s`` that pass the predicates one after the other; positions count within KEY and STEP."""
        columns = s.columns
        for p in predicates:
            if g.positional(p):
                whole = Window.partitionBy(*KEY, *STEP)
                order = [_c("pre").desc(), _c("aord").desc()] if reverse else [_c("pre"), _c("aord")]
                s = s.withColumns({"position": F.row_number().over(whole.orderBy(*order)).cast("double")})
                if _uses(p, "last"):
                    s = s.withColumns({"last": F.count(F.lit(1)).over(whole).cast("double")})
            if g.kind(p) == g.NUMBER:
                s, x = self.scalar(s, p, g.NUMBER)
                s = s.where(v.same(_c("position"), x))
            else:
                s = self.holding(s, p)
            s = s.select(*columns)
        return s

    def holding(self, s: DataFrame, p) -> DataFrame:
        """Rows for which a predicate is true: paths as semi- and anti-joins, the rest as a column."""
        if isinstance(p, g.Binary) and p.op == "and":
            return self.holding(self.holding(s, p.left), p.right)
        negated = isinstance(p, g.Call) and p.name == "not"
        inner = p.args[0] if negated else p
        if g.kind(inner) == g.NODESET and not _plain_attribute(inner) and not _self(inner):
            columns, on = self.link(inner)
            keys = self.per_context(inner, s).select(*[_c(k).alias(f"j_{k}") for k in columns])
            return s.join(merged(keys), on, "left_anti" if negated else "left_semi")
        s, flag = self.scalar(s, p, g.BOOLEAN)
        return s.where(flag)

    def per_context(self, e, s: DataFrame) -> DataFrame:
        """A node-set for each node of ``s`` as its context. A first step to children needs no look at ``s``: the children know their parent."""
        if isinstance(e, g.Path) and e.start is None and not e.absolute and e.steps[0].axis == "child" and not any(map(g.positional, e.steps[0].predicates)):
            first = e.steps[0]
            kids = self.n.where(test_column("child", first.test)).select("doc_id", _c("parent").alias("cp"), F.lit(0).alias("ca"), *NODE)
            if first.predicates:
                kids = self.filtered(kids.withColumns({"sp": _c("cp"), "sa": _c("ca")}), first.predicates, False).drop(*STEP)
            return self.walk(kids, e.steps[1:], single=False)
        if _document_wide(e):
            return self.nodeset(e, None)
        ctx = s.select("doc_id", _c("pre").alias("cp"), _c("aord").alias("ca"), *NODE).dropDuplicates(KEY)
        return self.nodeset(e, ctx)

    @staticmethod
    def link(e) -> tuple[list[str], Column]:
        """The columns of ``per_context``'s key, and the condition that joins them, named j_..., to their context nodes."""
        same_doc = _c("doc_id") == _c("j_doc_id")
        if _document_wide(e):
            return ["doc_id"], same_doc
        return KEY, same_doc & (_c("pre") == _c("j_cp")) & (_c("aord") == _c("j_ca"))

    def attach(self, s: DataFrame, e, facts: DataFrame, column: Column, default) -> tuple[DataFrame, Column]:
        """``s`` with one more column, from an aggregate of ``facts`` (rows of ``per_context`` of e) by context."""
        name, (columns, on) = f"x{next(_NUMBERS)}", self.link(e)
        per = facts.groupBy(*[_c(k).alias(f"j_{k}") for k in columns]).agg(column.alias(name))
        joined = s.join(merged(per), on, "left").drop(*[f"j_{k}" for k in columns])
        return joined, F.coalesce(_c(name), F.lit(default))

    def gathered(self, s: DataFrame, e, column: Column, default) -> tuple[DataFrame, Column]:
        """``s`` with an aggregate of a node-set for each of its nodes. What begins above a node is gathered once for all nodes below."""
        n, rest = _climb(e)
        if not n:
            return self.attach(s, e, self.per_context(e, s), column, default)
        per = self.per_context(rest, s).groupBy(_c("doc_id").alias("j_doc_id"), _c("cp").alias("j_cp")).agg(column.alias(name := f"x{next(_NUMBERS)}"))
        s = s.withColumns({"up": F.when(_c("aord") == 0, _c("parent")).otherwise(_c("pre"))})
        for _ in range(n - 1):
            above = self.n.where(_c("kind").isin("element", "root")).select(_c("doc_id").alias("u_doc"), _c("pre").alias("u_pre"), _c("parent").alias("u_parent"))
            s = s.join(merged(above), (_c("doc_id") == _c("u_doc")) & (_c("up") == _c("u_pre")), "left").withColumns({"up": _c("u_parent")}).drop("u_doc", "u_pre", "u_parent")
        joined = s.join(merged(per), (_c("doc_id") == _c("j_doc_id")) & (_c("up") == _c("j_cp")), "left").drop("j_doc_id", "j_cp", "up")
        return joined, F.coalesce(_c(name), default if isinstance(default, Column) else F.lit(default))

    def strings(self, s: DataFrame, es: list) -> tuple[DataFrame, list[tuple[Column, Column]]]:
        """``s`` with the columns that several node-sets need, and (whether there is a node, its string or "") of each: one pass over all that are children of a name."""
        out: dict[int, tuple[Column, Column]] = {}
        names = {k: name for k, e in enumerate(es) if (name := _child_name(e)) is not None}
        if names:
            kids = self.n.where((_c("kind") == "element") & _c("name").isin(*sorted(set(names.values()))))
            made = {name: f"x{next(_NUMBERS)}" for name in names.values()}
            first = [F.min(F.when(_c("name") == name, F.struct("pre", F.coalesce("value", F.lit("")).alias("value")))).alias(x) for name, x in made.items()]
            per = kids.groupBy(_c("doc_id").alias("j_doc_id"), _c("parent").alias("j_cp")).agg(*first)
            s = s.join(merged(per), (_c("doc_id") == _c("j_doc_id")) & (_c("pre") == _c("j_cp")) & (_c("aord") == 0), "left").drop("j_doc_id", "j_cp")
            out = {k: (_c(made[name]).isNotNull(), v.text(_c(made[name])["value"])) for k, name in names.items()}
        for k, e in enumerate(es):
            if k in out:
                continue
            if _self(e) or _plain_attribute(e):
                s, there = self.scalar(s, e, g.BOOLEAN)
                s, value = self.scalar(s, e, g.STRING)
            else:
                first = F.min(F.struct("pre", "aord", F.coalesce("value", F.lit("")).alias("value")))
                s, found = self.gathered(s, e, first, F.lit(None).cast("struct<pre:int,aord:int,value:string>"))
                there, value = found.isNotNull(), v.text(found["value"])
            out[k] = there, value
        return s, [out[k] for k in range(len(es))]

    # scalars: s gets the columns that the expression needs

    def scalar(self, s: DataFrame, e, want: str) -> tuple[DataFrame, Column]:
        """``s`` with what the expression needs, and its value as a column of the wanted type."""
        kind = g.kind(e)
        if kind == g.NODESET:
            return self.of_nodeset(s, e, want)
        s, c = self.typed(s, e)
        if kind == want:
            return s, c
        if want == g.BOOLEAN:
            return s, (c != "" if kind == g.STRING else (c != 0) & ~F.isnan(c))
        if want == g.NUMBER:
            return s, (v.number(c) if kind == g.STRING else v.flag_number(c))
        return s, (v.number_text(c) if kind == g.NUMBER else v.flag_text(c))

    def of_nodeset(self, s: DataFrame, e, want: str) -> tuple[DataFrame, Column]:
        test = _plain_attribute(e)
        if _self(e):
            c = F.lit(True) if want == g.BOOLEAN else v.text(_c("value"))
        elif test:
            own = _own_attributes(test)
            c = F.coalesce(F.size(own) > 0, F.lit(False)) if want == g.BOOLEAN else v.text(F.get(own, F.lit(0))["value"])
        elif want == g.BOOLEAN:
            return self.gathered(s, e, F.max(F.lit(True)), False)
        else:
            s, c = self.gathered(s, e, F.min_by("value", F.struct("pre", "aord")), "")
        return s, (v.number(c) if want == g.NUMBER else c)

    def typed(self, s: DataFrame, e) -> tuple[DataFrame, Column]:
        if isinstance(e, g.Literal | g.Number):
            return s, F.lit(e.value)
        if isinstance(e, g.Negate):
            s, c = self.scalar(s, e.value, g.NUMBER)
            return s, -c
        if isinstance(e, g.Call):
            return self.call(s, e)
        if e.op in ("or", "and"):
            s, a = self.scalar(s, e.left, g.BOOLEAN)
            s, b = self.scalar(s, e.right, g.BOOLEAN)
            return s, (a | b if e.op == "or" else a & b)
        if e.op in ("=", "!=", "<", "<=", ">", ">="):
            return self.compare(s, e)
        s, a = self.scalar(s, e.left, g.NUMBER)
        s, b = self.scalar(s, e.right, g.NUMBER)
        return s, {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "div": lambda: v.divided(a, b), "mod": lambda: v.remainder(a, b)}[e.op]()

    def compare(self, s: DataFrame, e: g.Binary) -> tuple[DataFrame, Column]:
        left, right, op = e.left, e.right, e.op
        kinds = [g.kind(left), g.kind(right)]
        if g.NODESET in kinds and g.BOOLEAN not in kinds:
            if kinds[0] != g.NODESET:  # the node-set goes to the left
                left, right, kinds = right, left, kinds[::-1]
                op = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op)
            return self.any_of(s, left, op, right, kinds[1])
        want = g.NUMBER if op in ("<", "<=", ">", ">=") else g.BOOLEAN if g.BOOLEAN in kinds else g.NUMBER if g.NUMBER in kinds else g.STRING
        if op in ("<", "<=", ">", ">=") and g.NODESET in kinds:  # with a boolean: the set's emptiness counts
            s, a = self.scalar(s, left, g.BOOLEAN if kinds[0] == g.NODESET else g.NUMBER)
            s, b = self.scalar(s, right, g.BOOLEAN if kinds[1] == g.NODESET else g.NUMBER)
            a, b = (v.flag_number(c) if k == g.NODESET else c for c, k in zip((a, b), kinds))
            return s, v.less(a, op, b)
        s, a = self.scalar(s, left, want)
        s, b = self.scalar(s, right, want)
        return s, self.pair(a, op, b, want)

    @staticmethod
    def pair(a: Column, op: str, b: Column, want: str) -> Column:
        if op in ("<", "<=", ">", ">="):
            return v.less(a, op, b)
        equal = v.same(a, b) if want == g.NUMBER else a == b
        return equal if op == "=" else ~equal

    def any_of(self, s: DataFrame, left, op: str, right, kind: str) -> tuple[DataFrame, Column]:
        """Whether some node of the left set compares so with the right side."""
        if kind == g.NODESET:
            return self.any_pair(s, left, op, right)
        want = g.NUMBER if kind == g.NUMBER or op not in ("=", "!=") else g.STRING
        s, b = self.scalar(s, right, want)
        as_wanted = lambda c: v.number(c) if want == g.NUMBER else v.text(c)
        if _self(left):
            return s, self.pair(as_wanted(_c("value")), op, b, want)
        if test := _plain_attribute(left):
            return s, F.coalesce(F.exists(_own_attributes(test), lambda a: self.pair(as_wanted(a["value"]), op, b, want)), F.lit(False))
        facts = self.per_context(left, s)
        if g.uses_position(right):  # one value for each row, not for each node
            row = [*KEY, *STEP, "pre", "aord"]
            own = s.select(*[_c(c).alias(f"b_{c}") for c in row], b.alias("b"))
            on = _c("doc_id") == _c("b_doc_id")
            if not _document_wide(left):
                on = on & (_c("cp") == _c("b_pre")) & (_c("ca") == _c("b_aord"))
            name = f"x{next(_NUMBERS)}"
            per = facts.join(merged(own), on).groupBy(*[f"b_{c}" for c in row]).agg(F.max(self.pair(as_wanted(_c("value")), op, _c("b"), want)).alias(name))
            same = functools.reduce(lambda x, y: x & y, [_c(c) == _c(f"b_{c}") for c in row])
            return s.join(merged(per), same, "left").drop(*[f"b_{c}" for c in row]), F.coalesce(_c(name), F.lit(False))
        if not isinstance(right, g.Literal | g.Number):
            own = s.select(_c("doc_id").alias("b_doc"), _c("pre").alias("b_pre"), _c("aord").alias("b_aord"), b.alias("b")).distinct()
            if _document_wide(left):  # the right side may differ from node to node
                facts = facts.drop("cp", "ca").join(merged(own), _c("doc_id") == _c("b_doc")).withColumns({"cp": _c("b_pre"), "ca": _c("b_aord")})
                left = g.Path((g.Step("self", g.Test("node")),))
            else:
                facts = facts.join(merged(own), (_c("doc_id") == _c("b_doc")) & (_c("cp") == _c("b_pre")) & (_c("ca") == _c("b_aord")))
            b = _c("b")
        return self.attach(s, left, facts, F.max(self.pair(as_wanted(_c("value")), op, b, want)), False)

    def any_pair(self, s: DataFrame, left, op: str, right) -> tuple[DataFrame, Column]:
        if op == "=" and _document_wide(left) != _document_wide(right):
            # one side by document, the other by context node
            wide, own = (left, right) if _document_wide(left) else (right, left)
            a, b = self.per_context(wide, s), self.per_context(own, s)
            a = a.select(_c("doc_id").alias("a_doc"), v.text(_c("value")).alias("a_w")).distinct()
            met = b.select(*KEY, v.text(_c("value")).alias("w")).join(merged(a), (_c("doc_id") == _c("a_doc")) & (_c("w") == _c("a_w")), "left_semi")
            return self.attach(s, own, met, F.max(F.lit(True)), False)
        a, b = (self.per_context(x, s) for x in (left, right))
        if op == "=":
            a, b = (x.select(*KEY, v.text(_c("value")).alias("w")).distinct() for x in (a, b))
            return self.attach(s, left, a.join(merged(b), [*KEY, "w"]), F.max(F.lit(True)), False)
        n = v.number(_c("value"))
        w = v.text(_c("value")) if op == "!=" else F.when(~F.isnan(n), n)
        s, _ = self.attach(s, left, a, F.struct(F.min(w).alias("lo"), F.max(w).alias("hi")), None)
        x = _c(s.columns[-1])
        s, _ = self.attach(s, right, b, F.struct(F.min(w).alias("lo"), F.max(w).alias("hi")), None)
        y = _c(s.columns[-1])
        if op == "!=":  # all the same only if both sets hold one and the same value
            c = (x["lo"] != y["hi"]) | (x["hi"] != y["lo"])
        else:
            c = {"<": x["lo"] < y["hi"], "<=": x["lo"] <= y["hi"], ">": x["hi"] > y["lo"], ">=": x["hi"] >= y["lo"]}[op]
        return s, F.coalesce(c, F.lit(False))

    def call(self, s: DataFrame, e: g.Call) -> tuple[DataFrame, Column]:
        name, args = e.name, e.args
        if name in ("position", "last"):
            if name not in s.columns:
                s = s.withColumns({name: F.lit(1.0)})
            return s, _c(name)
        if name in ("true", "false"):
            return s, F.lit(name == "true")
        if name in ("count", "sum"):
            test = _plain_attribute(args[0])
            if test and name == "count":
                return s, F.coalesce(F.size(_own_attributes(test)).cast("double"), F.lit(0.0))
            column = F.count(F.lit(1)).cast("double") if name == "count" else F.sum(v.number(_c("value")))
            return self.gathered(s, args[0], column, 0.0)
        if name in ("boolean", "not"):
            s, c = self.scalar(s, args[0], g.BOOLEAN)
            return s, (c if name == "boolean" else ~c)
        if name == "lang":
            s, c = self.scalar(s, args[0], g.STRING)
            have, want = F.lower(v.text(_c("lang"))), F.lower(c)
            return s, (have != "") & ((have == want) | have.startswith(F.concat(want, F.lit("-"))))
        if name in ("name", "local-name", "namespace-uri"):
            column = "uri" if name == "namespace-uri" else "name"
            if args and not _self(args[0]):
                s, c = self.attach(s, args[0], self.per_context(args[0], s), F.min_by(v.text(_c(column)), F.struct("pre", "aord")), "")
            else:
                c = v.text(_c(column))
            return s, (v.local_name(c) if name == "local-name" else c)
        if name in ("floor", "ceiling", "round"):
            s, c = self.scalar(s, args[0], g.NUMBER)
            return s, {"floor": v.floored, "ceiling": v.ceiled, "round": v.rounded}[name](c)
        if name == "number":
            if not args:
                return s, v.number(_c("value"))
            return self.scalar(s, args[0], g.NUMBER)
        if name == "substring":
            s, c = self.scalar(s, args[0], g.STRING)
            numbers = []
            for a in args[1:]:
                s, x = self.scalar(s, a, g.NUMBER)
                numbers.append(x)
            return s, v.substring_of(c, *numbers)
        c = []
        for a in args:
            s, x = self.scalar(s, a, g.STRING)
            c.append(x)
        if not args and name != "concat":
            c = [v.text(_c("value"))]
        return s, {
            "string": lambda: c[0],
            "concat": lambda: F.concat(*c) if c else F.lit(""),
            "string-length": lambda: F.length(c[0]).cast("double"),
            "normalize-space": lambda: v.normalized(c[0]),
            "starts-with": lambda: c[0].startswith(c[1]),
            "contains": lambda: c[0].contains(c[1]),
            "substring-before": lambda: v.before(*c),
            "substring-after": lambda: v.after(*c),
            "translate": lambda: v.translated(*c),
        }[name]()

    def value(self, e) -> DataFrame:
        """(doc_id, value) of an expression that is no node-set: one row for each document."""
        start = self.start()
        s, c = self.scalar(start.withColumns({"sp": _c("cp"), "sa": _c("ca")}), e, g.kind(e))
        return s.select("doc_id", c.alias("value"))


def _uses(e, name: str) -> bool:
    """Whether the function occurs anywhere in the expression."""
    if isinstance(e, g.Call):
        return e.name == name or any(_uses(a, name) for a in e.args)
    if isinstance(e, g.Binary | g.Union):
        return _uses(e.left, name) or _uses(e.right, name)
    if isinstance(e, g.Negate):
        return _uses(e.value, name)
    if isinstance(e, g.Filter):
        return _uses(e.base, name)
    return isinstance(e, g.Path) and e.start is not None and _uses(e.start, name)


class _Numbers:
    """Names for added columns, unique in this process."""

    def __init__(self):
        self.n = 0

    def __next__(self) -> int:
        self.n += 1
        return self.n


_NUMBERS = _Numbers()


@functools.lru_cache(maxsize=1024)
def compiled(xpath: str):
    return g.simplify(g.parse(xpath))
