"""XmlFrame: XPath over a table of documents, or over a stored node table.

All methods are lazy and give one row for each result, with the document's id. They take any documents: null texts have no
nodes, empty ones the root alone, repeated rows of one doc_id are one document only if their texts are equal
(``XmlFrame`` refuses nothing, but nodes of different texts under one doc_id would be mixed; use ``distinct_docs`` first).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from xylem.functions import interp
from xylem.plans import grammar as g
from xylem.plans.compile import NODE, Plan, compiled, merged
from xylem.sources import markup, workspace

_VALUE_FREE = frozenset(("count", "position", "last", "true", "false", "boolean", "not", "name", "local-name", "namespace-uri", "lang"))


def distinct_docs(docs: DataFrame) -> DataFrame:
    """(doc_id, xml), one row for each doc_id: of several texts the first in order.

    Only ids are looked at first; texts are shuffled only where some id is there twice.
    """
    plain = markup.docs_of(docs)
    if plain.groupBy("doc_id").count().where("count > 1").isEmpty():
        return plain
    return plain.groupBy("doc_id").agg(F.min("xml").alias("xml"))


def _parts(e):
    """The expression and all that it contains."""
    yield e
    below = {
        g.Path: lambda: [e.start, *[p for s in e.steps for p in s.predicates]],
        g.Filter: lambda: [e.base, *e.predicates],
        g.Union: lambda: [e.left, e.right],
        g.Binary: lambda: [e.left, e.right],
        g.Call: lambda: list(e.args),
        g.Negate: lambda: [e.value],
    }.get(type(e), list)()
    for x in below:
        if x is not None:
            yield from _parts(x)


def needed_columns(e, output: tuple[str, ...]) -> list[str]:
    """The node columns that a plan for the expression can read."""
    parts = list(_parts(e))
    steps = [s for x in parts if isinstance(x, g.Path) for s in x.steps]
    value = any(isinstance(x, g.Binary) and x.op not in ("and", "or") or isinstance(x, g.Negate) or isinstance(x, g.Call) and x.name not in _VALUE_FREE for x in parts)
    skip = set()
    if not value and "value" not in output:
        skip.add("value")
    if not any(s.axis == "namespace" for s in steps):
        skip.add("scope")
    if "text" not in output:
        skip.add("text")
    return [c for c in markup.COLUMNS if c not in skip]


def needed_names(e) -> frozenset[str] | None:
    """The only element names that the expression can tell apart; None where it may look at any."""
    names = set()
    for x in _parts(e):
        if isinstance(x, g.Call) and x.name == "id":
            return None
        if isinstance(x, g.Path):
            for s in x.steps:
                if s.axis in ("attribute", "namespace") or s.axis == "self" and s.test.kind == "node" or s.test.kind in ("text", "comment", "pi"):
                    continue
                if s.test.kind != "name":
                    return None
                names.add(s.test.value)
    return frozenset(names)


def may_match(xml: Column, e, tags: Column | None = None) -> Column:
    """False only for texts that can't have a node in the result: they lack a tag that it needs, by their summary ``tags`` or by how tags begin."""
    options = g.required_names(e)
    if not options:
        return F.lit(True)
    one = None
    for names in options:
        all_of = None
        for name in sorted(names):
            hit = xml.contains(f"<{name}") if tags is None else F.array_contains(tags, name)
            all_of = hit if all_of is None else all_of & hit
        if all_of is None:
            return F.lit(True)
        one = all_of if one is None else one | all_of
    return one


class XmlFrame:
    """``docs``: (doc_id, xml), with ``tags`` also their summaries. ``nodes``: their node table, where it is stored; otherwise each query parses what it needs."""

    def __init__(self, docs: DataFrame | None = None, nodes: DataFrame | None = None, prune: bool = True, tags: bool = False):
        if docs is None and nodes is None:
            raise ValueError("documents or a node table are needed")
        self.docs = None if docs is None else markup.docs_of(docs)
        self._summarized = docs.select("doc_id", "xml", "tags") if tags else None
        self._nodes, self.prune = nodes, prune

    def nodes(self, e=None, output: tuple[str, ...] = (), context: str = "root") -> DataFrame:
        """The node table, or as much of it as an expression needs."""
        if self._nodes is not None:
            return self._nodes
        if e is None or not self.prune:
            return markup.parse(self.docs)
        return markup.parse(*self._needed(e, output, context))

    def _needed(self, e, output: tuple[str, ...], context: str) -> tuple[DataFrame, list[str], frozenset[str] | None]:
        """The documents, the columns and the names that an expression needs."""
        docs = self.docs
        if g.kind(e) == g.NODESET and self._summarized is not None:
            docs = self._summarized.where(may_match(F.col("xml"), e, F.col("tags"))).select("doc_id", "xml")
        elif g.kind(e) == g.NODESET:
            docs = docs.where(may_match(F.col("xml"), e))
        return docs, needed_columns(e, output), needed_names(e) if context == "root" else None

    def plan(self, e, output: tuple[str, ...] = (), context: str = "root") -> Plan:
        return Plan(self.nodes(e, output, context), context)

    def _made(self, e, output: tuple[str, ...], context: str, make) -> DataFrame:
        """What ``make`` makes of the plan. Nodes that aren't stored and that it looks at more than once are parsed once, into the shared folder."""
        plan = self.plan(e, output, context)
        made = make(plan)
        if self._nodes is None and self.prune and plan.reads > 1 and not self.docs.isStreaming:
            docs, columns, names = self._needed(e, output, context)
            path = workspace.new_path(docs.sparkSession, "parsed")
            markup.write(docs, path, columns=columns, names=names)
            made = make(Plan(markup.read(docs.sparkSession, path, columns), context))
        return made

    def _result(self, xpath: str, output: tuple[str, ...], context: str) -> DataFrame:
        e = compiled(xpath)
        if g.kind(e) != g.NODESET:
            raise g.XPathError(f"{xpath!r} gives no nodes")
        return self._made(e, output, context, lambda plan: plan.top(e))

    def xpath(self, xpath: str, context: str = "element") -> DataFrame:
        """(doc_id, pre, aord, kind, name) of the result's nodes; (pre, aord) is document order."""
        return self._result(xpath, (), context).select("doc_id", "pre", "aord", "kind", "name")

    def xpath_string(self, xpath: str, context: str = "element") -> DataFrame:
        """(doc_id, pre, aord, name, value): the string-value of each node."""
        return self._result(xpath, ("value",), context).select("doc_id", "pre", "aord", "name", F.coalesce("value", F.lit("")).alias("value"))

    def xpath_text(self, xpath: str, context: str = "element") -> DataFrame:
        """(doc_id, pre, text): one row for each direct text run of each element, undecoded; text nodes as they are, attributes' values. No empty ones."""
        e = compiled(xpath)
        if g.kind(e) != g.NODESET:
            raise g.XPathError(f"{xpath!r} gives no nodes")
        return self._made(e, ("text", "value"), context, lambda plan: self._runs(plan, e))

    @staticmethod
    def _runs(plan: Plan, e) -> DataFrame:
        found = plan.top(e)
        runs = plan.n.where("kind = 'text'").select(F.col("doc_id").alias("t_doc"), F.col("parent").alias("t_parent"), F.col("pre").alias("t_pre"), F.col("text").alias("t_text"))
        inner = found.where(F.col("kind").isin("element", "root")).select("doc_id", F.col("pre").alias("e_pre"))
        inner = inner.join(merged(runs), (F.col("doc_id") == F.col("t_doc")) & (F.col("e_pre") == F.col("t_parent"))).select("doc_id", F.col("t_pre").alias("pre"), F.lit(0).alias("aord"), F.col("t_text").alias("text"))
        own = found.where(~F.col("kind").isin("element", "root")).select("doc_id", "pre", "aord", "text")
        return inner.unionByName(own).where(F.length("text") > 0)

    def xpath_raw(self, xpath: str, context: str = "element") -> DataFrame:
        """(doc_id, pre, aord, raw): the piece of the document that each node is; an attribute's is its value."""
        if self.docs is None:
            raise ValueError("raw fragments need the documents")
        # a document's text meets the places of all its nodes once
        place = F.struct("pre", "aord", F.when(F.col("aord") > 0, F.col("value")).alias("value"), "start_off", "end_off")
        found = self._result(xpath, ("value",), context).groupBy("doc_id").agg(F.collect_list(place).alias("places"))
        joined = found.join(merged(self.docs.select(F.col("doc_id").alias("d"), "xml")), F.col("doc_id") == F.col("d"))
        piece = lambda x: F.when(x["aord"] > 0, x["value"]).otherwise(F.substring("xml", x["start_off"] + 1, x["end_off"] - x["start_off"]))
        pieces = F.transform("places", lambda x: F.struct(x["pre"].alias("pre"), x["aord"].alias("aord"), piece(x).alias("raw")))
        return joined.select("doc_id", F.explode(pieces).alias("x")).select("doc_id", "x.*")

    def eval(self, xpath: str, context: str = "element") -> DataFrame:
        """A node-set as ``xpath_string`` gives it; otherwise (doc_id, value) with a string, double or boolean for each document."""
        e = compiled(xpath)
        if g.kind(e) == g.NODESET:
            return self.xpath_string(xpath, context)
        return self._made(e, ("value",), context, lambda plan: plan.value(e))

    def xpath_from(self, contexts: DataFrame, xpath: str) -> DataFrame:
        """(doc_id, context, pre, aord, kind, name, value): the result for each node in ``contexts`` (doc_id, pre), which paths start from."""
        e = compiled(xpath)
        if g.kind(e) != g.NODESET:
            raise g.XPathError(f"{xpath!r} gives no nodes")
        plan = Plan(self.nodes())
        return plan.from_nodes(e, contexts).select("doc_id", F.col("cp").alias("context"), "pre", "aord", "kind", "name", F.coalesce("value", F.lit("")).alias("value"))

    def shred(self, rows: str, columns: dict[str, tuple[str, str]], context: str = "root") -> DataFrame:
        """One row for each node of ``rows``: doc_id, pre, and a column for each name: (XPath from that node, type).

        Values are cast from the result's string, or its number for numeric types; what can't be cast is null, a missing node is null too.
        """
        plan = Plan(self.nodes(), context)
        s = plan.nodeset(compiled(rows), None).withColumns({"sp": F.col("cp"), "sa": F.col("ca")})
        es = {name: compiled(xpath) for name, (xpath, _) in columns.items()}
        sets, values = [name for name, e in es.items() if g.kind(e) == g.NODESET], {}
        s, found = plan.strings(s, [es[name] for name in sets])
        for name, (there, value) in zip(sets, found):
            values[name] = F.when(there, value)
        for name, e in es.items():
            if name not in values:
                s, values[name] = plan.scalar(s, e, g.STRING)
        return s.select("doc_id", "pre", *[values[name].try_cast(kind).alias(name) for name, (_, kind) in columns.items()])

    def display(self, xpath: str, context: str = "element") -> DataFrame:
        """(doc_id, value): node string-values joined by line ends, or the scalar as a string."""
        e = compiled(xpath)
        if g.kind(e) != g.NODESET:
            wrapped = e if g.kind(e) == g.STRING else g.Call("string", (e,))
            return self.plan(wrapped, ("value",), context).value(wrapped)
        rows = self.xpath_string(xpath, context)
        return self._per_document(rows, F.array_join(_ordered("value"), "\n"), "value", "")

    # many documents

    def _ids(self) -> DataFrame:
        if self.docs is not None:
            return self.docs.select("doc_id").distinct()
        return self._nodes.where("pre = 0").select("doc_id")

    def _per_document(self, rows: DataFrame, column: Column, name: str, default) -> DataFrame:
        """Documents without rows are there too."""
        per = rows.groupBy(F.col("doc_id").alias("r_doc")).agg(column.alias(name))
        ids = self._ids()
        return ids.join(merged(per), F.col("doc_id").eqNullSafe(F.col("r_doc")), "left").select("doc_id", F.coalesce(name, default if isinstance(default, Column) else F.lit(default)).alias(name))

    def batch_text(self, xpath: str, context: str = "root") -> DataFrame:
        """(doc_id, texts): the text runs in order; documents without any have an empty list."""
        return self._per_document(self.xpath_text(xpath, context), _ordered("text"), "texts", F.array().cast("array<string>"))

    def count_batch(self, xpath: str, context: str = "root") -> DataFrame:
        """(doc_id, n): nodes found in each document; 0 where there are none."""
        return self._per_document(self.xpath(xpath, context), F.count(F.lit(1)), "n", F.lit(0).cast("long"))

    def matching(self, xpath: str, context: str = "root") -> DataFrame:
        """doc_id of the documents with a node in the result."""
        return self.xpath(xpath, context).select("doc_id").distinct()

    def json(self, xpath: str, context: str = "element") -> DataFrame:
        """(doc_id, json): {"matches": [string-values]} for documents with matches."""
        rows = self.xpath_string(xpath, context)
        return rows.groupBy("doc_id").agg(F.to_json(F.struct(_ordered("value").alias("matches"))).alias("json"))

    # statistics

    def totals(self) -> DataFrame:
        """(documents, chars, tags, texts, max_depth, unique_tags) of all documents, in one row; ``chars`` is null without the documents."""
        each = self.summary().agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n_tags"), F.lit(0)).alias("tags"), F.coalesce(F.sum("n_text"), F.lit(0)).alias("texts"), F.coalesce(F.max("max_depth"), F.lit(0)).alias("max_depth"))
        names = self.nodes().where("kind = 'element'").agg(F.count_distinct("name").alias("unique_tags"))
        chars = self.docs.agg(F.coalesce(F.sum(F.length("xml")), F.lit(0)).alias("chars")) if self.docs is not None else self._nodes.limit(1).agg(F.max(F.lit(None).cast("long")).alias("chars"))
        return each.crossJoin(chars).crossJoin(names).select("documents", "chars", "tags", "texts", "max_depth", "unique_tags")  # one row each

    def info(self, top: int = 10) -> DataFrame:
        """(name, n): the ``top`` most frequent element names; ties by name."""
        found = self.nodes().where("kind = 'element'").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
        return found.orderBy(F.desc("n"), "name").limit(top)

    def summary(self) -> DataFrame:
        """(doc_id, n_tags, n_text, max_depth, tag_names): tags are elements, comments and instructions; a document element has depth 0."""
        tag = F.col("kind").isin("element", "comment", "pi")
        return self.nodes().groupBy("doc_id").agg(
            F.count_if(tag).alias("n_tags"),
            F.count_if(F.col("kind") == "text").alias("n_text"),
            F.greatest(F.max(F.when(tag, F.col("depth"))) - 1, F.lit(0)).alias("max_depth"),
            F.array_sort(F.collect_set(F.when(F.col("kind") == "element", F.col("name")))).alias("tag_names"),
        )

    # navigation: from every element of the result of a path

    def children(self, xpath: str, context: str = "root") -> DataFrame:
        """(doc_id, pre, child, name, ordinal): element children, counted from 0."""
        e = compiled(xpath)
        plan = Plan(self.nodes(), context)
        found = plan.top(e).where("kind = 'element'").select(F.col("doc_id").alias("f_doc"), F.col("pre").alias("f_pre"))
        kids = found.join(merged(plan.n.where("kind = 'element'")), (F.col("doc_id") == F.col("f_doc")) & (F.col("parent") == F.col("f_pre")))
        w = Window.partitionBy("doc_id", "f_pre").orderBy("pre")
        return kids.select("doc_id", F.col("f_pre").alias("pre"), F.col("pre").alias("child"), "name", (F.row_number().over(w) - 1).alias("ordinal"))

    def child_counts(self, xpath: str, context: str = "root") -> DataFrame:
        """(doc_id, pre, n): how many element children each element of the result has; 0 for none."""
        e = compiled(xpath)
        plan = Plan(self.nodes(), context)
        found = plan.top(e).where("kind = 'element'").select("doc_id", "pre")
        per = plan.n.where("kind = 'element'").groupBy(F.col("doc_id").alias("c_doc"), F.col("parent").alias("c_parent")).agg(F.count(F.lit(1)).alias("n"))
        joined = found.join(merged(per), (F.col("doc_id") == F.col("c_doc")) & (F.col("pre") == F.col("c_parent")), "left")
        return joined.select("doc_id", "pre", F.coalesce("n", F.lit(0)).alias("n"))

    def child_at(self, xpath: str, ordinal: int, context: str = "root") -> DataFrame:
        """(doc_id, pre, child, name): the element child with this number, counted from 0, of each element that has it."""
        return self.children(xpath, context).where(F.col("ordinal") == ordinal).drop("ordinal")

    def extents(self, xpath: str, context: str = "root") -> DataFrame:
        """(doc_id, pre, end, start_off, end_off): the last node below each node, and where it begins and ends in the text."""
        return self._result(xpath, (), context).where("aord = 0").select("doc_id", "pre", "end", "start_off", "end_off")

    def itertext(self, xpath: str, context: str = "root") -> DataFrame:
        """(doc_id, pre, ord, text): every text run inside each element of the result, decoded, in document order from 0."""
        e = compiled(xpath)
        plan = Plan(self.nodes(), context)
        found = plan.top(e).where("kind = 'element'").select(F.col("doc_id").alias("f_doc"), F.col("pre").alias("f_pre"), F.col("end").alias("f_end"))
        runs = plan.n.where("kind = 'text'").select("doc_id", F.col("pre").alias("t_pre"), F.coalesce("value", F.lit("")).alias("text"))
        inside = found.join(merged(runs), (F.col("f_doc") == F.col("doc_id")) & (F.col("t_pre") > F.col("f_pre")) & (F.col("t_pre") <= F.col("f_end")))
        order = F.row_number().over(Window.partitionBy("doc_id", "f_pre").orderBy("t_pre")) - 1
        return inside.select("doc_id", F.col("f_pre").alias("pre"), order.alias("ord"), "text")

    def texts_of(self, xpath: str, context: str = "root") -> DataFrame:
        """(doc_id, pre, name, parent, text, tail, all_text): first text child, the text right after the element, all text inside; decoded."""
        e = compiled(xpath)
        plan = Plan(self.nodes(), context)
        found = plan.top(e).where("kind = 'element'").select("doc_id", "pre", "end", "name", "parent", F.coalesce("value", F.lit("")).alias("all_text"))
        runs = plan.n.where("kind = 'text'").select(F.col("doc_id").alias("t_doc"), F.col("parent").alias("t_parent"), F.col("pre").alias("t_pre"), F.col("value").alias("t_value"))
        first = runs.groupBy("t_doc", "t_parent").agg(F.min_by("t_value", "t_pre").alias("text"))
        with_first = found.join(merged(first), (F.col("doc_id") == F.col("t_doc")) & (F.col("pre") == F.col("t_parent")), "left").drop("t_doc", "t_parent")
        after = (F.col("doc_id") == F.col("t_doc")) & (F.col("t_pre") == F.col("end") + 1) & (F.col("parent") == F.col("t_parent"))
        return with_first.join(merged(runs), after, "left").select("doc_id", "pre", "name", "parent", "text", F.col("t_value").alias("tail"), "all_text")

    def attributes(self, xpath: str, context: str = "root", xmlns: bool = True) -> DataFrame:
        """(doc_id, pre, ord, name, value) of every attribute; ``xmlns``: namespace declarations too."""
        found = self._result(xpath, (), context).where("kind = 'element'").select("doc_id", "pre", F.posexplode("attrs").alias("ord", "a"))
        found = found.select("doc_id", "pre", "ord", "a.name", "a.value")
        return found if xmlns else found.where("not (name = 'xmlns' or startswith(name, 'xmlns:'))")

    def canonical(self, xpath: str = "/*") -> DataFrame:
        """(doc_id, ord, xml): each node of the result written canonically. A fold over a subtree, so whole documents are evaluated."""
        if self.docs is None:
            raise ValueError("canonical output needs the documents")
        return _lists_of(self.docs, lambda x: interp.canonical(x, xpath), "xml")


def standalone(spark: SparkSession, *xpaths: str) -> DataFrame:
    """(expr, type, value): expressions that need no document, with their static type and the value as a string. All in one plan."""
    plan = XmlFrame(spark.createDataFrame([(0, "<r/>")], "doc_id long, xml string")).plan(g.Literal(""), ("value",))
    s, rows = plan.start().withColumns({"sp": F.col("cp"), "sa": F.col("ca")}), []
    for x in xpaths:
        e = compiled(x)
        s, value = plan.scalar(s, e, g.STRING)
        rows.append(F.struct(F.lit(x).alias("expr"), F.lit(g.kind(e)).alias("type"), value.alias("value")))
    return s.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def _ordered(column: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("pre", "aord", column))), lambda x: x[column])


def _lists_of(docs: DataFrame, f, name: str) -> DataFrame:
    import pyarrow as pa

    def of(batches):
        ids, ords, found, size = [], [], [], 0

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ords, pa.int32()), pa.array(found, pa.string())], names=["doc_id", "ord", name])

        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                for k, s in enumerate(f(x.as_py())):
                    ids.append(i), ords.append(k), found.append(s)
                    size += 40 + len(s)
                    if size > 4_000_000:  # results are handed on by their size, however many documents a batch has
                        yield rows()
                        ids, ords, found, size = [], [], [], 0
        if ids:
            yield rows()

    workspace.small_batches(docs.sparkSession)
    return docs.mapInArrow(of, f"doc_id long, ord int, {name} string")


def strings_per_document(docs: DataFrame, xpath: str, context: str = "element") -> DataFrame:
    """(doc_id, ord, value): string-values found by evaluating whole documents one by one, without any shuffle."""
    return _lists_of(markup.docs_of(docs), lambda x: interp.strings(x, xpath, context), "value")


__all__ = ["NODE", "XmlFrame", "distinct_docs", "may_match", "needed_columns", "needed_names", "standalone", "strings_per_document"]
