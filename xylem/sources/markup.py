"""Documents to nodes: one pass with a stack over each text, as a narrow map without any shuffle.

Nodes are numbered in document order from 0, the document itself. ``end`` is the last number in a node's subtree, so that
d is below a exactly if ``a.pre < d.pre <= a.end``.

Rules.  A close tag ends the innermost open element whatever its name, so HTML that isn't well-formed has nodes too.
An element that is never closed reaches to the end of the text. Text outside of all elements and text after the last tag
is dropped. CDATA is a text node of its own. ``<!...>`` other than comments and CDATA is skipped up to the first ``>``. A
comment, CDATA section or instruction that isn't closed goes to the end; an XML declaration at the very beginning is no node. A tag that isn't closed is an error: the document
has only its root, and ``parse_errors`` says where. Attributes are ``name="value"`` after white space; others are ignored.
A null text, or one with a null doc_id, is a document without nodes, not even a root; an empty text has the root alone.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import plain, workspace

ROOT, ELEMENT, TEXT, COMMENT, PI, ATTRIBUTE, NAMESPACE = "root", "element", "text", "comment", "pi", "attribute", "namespace"

#: The columns of the node table after doc_id.
SCHEMA = {
    "pre": "int",
    "end": "int",
    "parent": "int",
    "depth": "int",
    "kind": "string",
    "name": "string",
    "path": "string",
    "text": "string",
    "value": "string",
    "attrs": "array<struct<name:string,value:string,uri:string>>",
    "uri": "string",
    "lang": "string",
    "scope": "array<struct<prefix:string,uri:string>>",
    "start_off": "int",
    "end_off": "int",
}
COLUMNS = list(SCHEMA)

_OPEN = r"""<([^\s/>]*+)([^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+)>"""
#: A text's tokens one after the other; what can't be one swallows the rest.
_TOKENS = re.compile(
    r"[^<]++|<!--[\s\S]*?(?:-->|\Z)|<!\[CDATA\[[\s\S]*?(?:\]\]>|\Z)|<\?[\s\S]*?(?:\?>|\Z)|<![^>]*+(?:>|\Z)|</[^>]*+>|" + _OPEN.replace("([^", "(?:[^") + r"|<[\s\S]*+"
).findall
_DECLARATION = re.compile(r"<\?xml(?:\s|\?|\Z)").match
_CLOSED = re.compile(f"</[^>]*+>|{_OPEN}").fullmatch
_START = re.compile(_OPEN).fullmatch
_ATTRIBUTE = re.compile(r"""\s([^\s=/>"']+)=(?:"([^"]*)"|'([^']*)')""")
_ENTITY = re.compile(r"&(?:#x([0-9a-fA-F]+)|#(\d+)|(lt|gt|amp|quot|apos));")
_NAMED = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}


def _entity(m: re.Match) -> str:
    if m[3]:
        return _NAMED[m[3]]
    digits = m[1] or m[2]
    code = int(digits, 16 if m[1] else 10) if len(digits) < 9 else 0x110000
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else ""


def decode(text: str) -> str:
    """Entities replaced: the five named ones and numbers. Other names stay; numbers that are no character vanish."""
    return _ENTITY.sub(_entity, text) if "&" in text else text


def start_tag(token: str):
    name, rest = _START(token).groups()
    found = [(a, decode(v or w)) for a, v, w in _ATTRIBUTE.findall(rest)] if "=" in rest else []
    special = ":" in name or any(":" in a or a == "xmlns" for a, _ in found)
    return name, rest.endswith("/"), found if special else [(a, v, None) for a, v in found] or None, special


class _Tags(dict):
    """What each tag says: (name, whether it has no content, attributes, whether it has to do with namespaces or languages); None for an end tag.

    Tags repeat, so they are remembered, up to a number and a size that bound memory.
    """

    chars = 0

    def __missing__(self, token: str):
        if len(self) > 20_000 or self.chars > 4_000_000:
            self.clear()
            self.chars = 0
        self[token] = value = None if token[1] == "/" else start_tag(token)
        self.chars += len(token)
        return value


_TAGS = _Tags()


def plain_tag(token: str) -> tuple[int, str | None, list | None, str | None]:
    """(what it is, name, attributes, text) of a piece from ``<`` to the next ``>``, for ``plain.nodes``."""
    if token[1] == "!":
        if token.startswith("<!--"):
            return (plain.COMMENT, None, None, token[4:-3]) if len(token) > 6 and token.endswith("-->") else (plain.OTHER, None, None, None)
        if token.startswith("<![CDATA["):
            if len(token) < 12 or not token.endswith("]]>"):
                return plain.OTHER, None, None, None
            return plain.CDATA if len(token) > 12 else plain.NOTHING, None, None, token[9:-3]
        return plain.NOTHING, None, None, None
    if token[1] == "?":
        if len(token) < 4 or not token.endswith("?>"):
            return plain.OTHER, None, None, None
        name, _, text = partition(token[2:-2])
        return plain.DECLARATION if _DECLARATION(token) else plain.PI, name, None, text
    if not _START(token):
        return plain.OTHER, None, None, None
    name, closed, attrs, special = start_tag(token)
    if special:
        return plain.OTHER, None, None, None
    return plain.EMPTY if closed else plain.OPEN, name, attrs, None


def _cut_off(tokens: list[str]) -> bool:
    """Whether the last token is a tag that isn't closed."""
    last = tokens[-1] if tokens else ""
    return last[:1] == "<" and last[1:2] not in ("!", "?") and not _CLOSED(last)


def tokens_of(xml: str) -> list[str] | None:
    """A text's tokens, which make up all of it; None if a tag isn't closed."""
    tokens = _TOKENS(xml)
    return None if _cut_off(tokens) else tokens


class Tree:
    """The nodes of one text, as parallel lists."""

    __slots__ = ("end", "parent", "depth", "kind", "name", "path", "text", "attrs", "uri", "lang", "scope", "start", "stop", "decoded", "error", "xml")

    def __init__(self, xml: str):
        self.xml, self.error = xml, None
        tokens = _TOKENS(xml)
        if _cut_off(tokens):
            self.error = f"tag not closed at {len(xml) - len(tokens[-1])}"
            tokens = []
        rows = self._read(tokens, len(xml))
        self.parent, self.depth, self.kind, self.name, self.path, self.text, self.attrs, self.uri, self.lang, self.scope, self.start, self.decoded = map(list, zip(*rows))

    def _read(self, tokens: list[str], n: int) -> list[tuple]:
        end, stop = self.end, self.stop = [0], [n]
        rows: list[tuple] = [(None, 0, ROOT, None, "", None, None, None, None, None, 0, None)]
        add = rows.append
        # the open elements, and what holds in each of them: (number, path, language, namespaces)
        outer, top, path, lang, scope = [], 0, "", None, None
        k = at = 0
        depth = 1
        for token in tokens:
            start = at
            at += len(token)
            if token[0] != "<":
                if top and at < n:
                    k += 1
                    end.append(k), stop.append(at)
                    add((top, depth, TEXT, None, None, token, None, None, lang, scope, start, decode(token) if "&" in token else token))
                continue
            sign = token[1]
            if sign == "!" or sign == "?":
                if token.startswith("<!--"):
                    kind, name, text = COMMENT, None, token[4:-3] if len(token) > 6 and token.endswith("-->") else token[4:]
                elif token.startswith("<![CDATA["):
                    kind, name, text = TEXT, None, token[9:-3] if token.endswith("]]>") else token[9:]
                    if not top or not text:
                        continue
                elif sign == "?":
                    if not start and _DECLARATION(token):
                        continue
                    kind = PI
                    name, _, text = partition(token[2:-2] if len(token) > 3 and token.endswith("?>") else token[2:])
                else:
                    continue
                k += 1
                end.append(k), stop.append(at)
                add((top, depth, kind, name, None, text, None, None, lang, scope, start, text))
                continue
            tag = _TAGS[token]
            if tag is None:
                if top:
                    end[top], stop[top] = k, at
                    top, path, lang, scope = outer.pop()
                    depth -= 1
                continue
            name, closed, attrs, special = tag
            k += 1
            end.append(k), stop.append(at)
            below, uri, own_lang, own_scope = f"{path}/{name}", None, lang, scope
            if special:
                for a, v in attrs:
                    if a == "xmlns" or a.startswith("xmlns:"):
                        own_scope = {**(own_scope or {}), a[6:]: v}
                    elif a == "xml:lang":
                        own_lang = v
                attrs = [(a, v, (own_scope or {}).get(a.partition(":")[0]) if ":" in a else None) for a, v in attrs] or None
            if own_scope:
                uri = own_scope.get(name.partition(":")[0] if ":" in name else "")
            add((top, depth, ELEMENT, name, below, None, attrs, uri, own_lang, own_scope, start, None))
            if not closed:
                outer.append((top, path, lang, scope))
                top, path, lang, scope = k, below, own_lang, own_scope
                depth += 1
        while top:
            end[top], stop[top] = k, n
            top = outer.pop()[0]
        end[0] = k
        return rows

    def values(self) -> list[str | None]:
        """The string-value of every node: slices of the document's text, entities decoded."""
        pieces, where, length = [], [], 0
        for kind, text in zip(self.kind, self.decoded):
            where.append(length)
            if kind == TEXT:
                pieces.append(text)
                length += len(text)
        where.append(length)
        whole = "".join(pieces)
        return [whole[where[k] : where[self.end[k] + 1]] if kind in (ELEMENT, ROOT) else self.decoded[k] for k, kind in enumerate(self.kind)]


def partition(text: str) -> tuple[str, str, str]:
    m = re.match(r"(\S*)(\s*)([\s\S]*)", text)
    return m[1], m[2], m[3]


_ATTRS = pa.struct([("name", pa.string()), ("value", pa.string()), ("uri", pa.string())])
_SCOPE = pa.struct([("prefix", pa.string()), ("uri", pa.string())])


def _column_of_lists(items: list, column: str) -> pa.Array:
    return _lists(items, _ATTRS if column == "attrs" else _SCOPE)


def _lists(items: list, kind: pa.StructType) -> pa.Array:
    rows = [row for x in items if x for row in x]
    offsets = list(accumulate((len(x) if x else 0 for x in items), initial=0))
    columns = list(zip(*rows)) or [()] * len(kind)
    inner = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner)


#: Nodes, or characters of them, after which a batch is handed on; and the bytes of documents that are read at once.
_BATCH_NODES, _BATCH_CHARS, _CHUNK = 50_000, 4_000_000, 1 << 20


class _Rows:
    def __init__(self, columns: list[str], names: frozenset[str] | None):
        self.columns, self.names, self.n, self.chars = columns, names, 0, 0
        self.data = {c: [] for c in ["doc_id", *columns]}

    def add(self, doc_id: int | None, t: Tree) -> None:
        size = len(t.end)
        keep = None
        if self.names is not None:
            # what is no element stays: its names are not the query's
            keep = [k for k in range(size) if t.kind[k] != ELEMENT or t.name[k] in self.names]
        take = (lambda x: x) if keep is None else (lambda x: [x[k] for k in keep])
        for c in self.columns:
            if c == "pre":
                got = list(range(size))
            elif c == "value":
                got = t.values()
            elif c == "scope":
                got = [s and sorted((p, u) for p, u in s.items() if p and p != "xml") for s in t.scope] if any(t.scope) else t.scope
            else:
                got = getattr(t, {"start_off": "start", "end_off": "stop"}.get(c, c))
            got = take(got)
            if c in ("value", "text"):
                self.chars += sum(len(x) for x in got if x)
            self.data[c] += got
        n = size if keep is None else len(keep)
        self.data["doc_id"] += [doc_id] * n
        self.n += n

    def batch(self) -> pa.RecordBatch:
        kinds = {c: pa.int32() for c in ("pre", "end", "parent", "depth", "start_off", "end_off")}
        arrays = [pa.array(self.data["doc_id"], pa.int64())]
        for c in self.columns:
            if c in ("attrs", "scope"):
                arrays.append(_column_of_lists(self.data[c], c))
            else:
                arrays.append(pa.array(self.data[c], kinds.get(c, pa.string())))
        out = pa.RecordBatch.from_arrays(arrays, names=["doc_id", *self.columns])
        self.data, self.n, self.chars = {c: [] for c in self.data}, 0, 0
        return out

    def full(self) -> bool:
        return self.n >= _BATCH_NODES or self.chars >= _BATCH_CHARS


def docs_of(docs: DataFrame, doc_id: str = "doc_id", xml: str = "xml") -> DataFrame:
    """(doc_id long, xml string) of a table that may have any further columns, also ones whose names differ in case only."""
    at = [docs.columns.index(doc_id), docs.columns.index(xml)]
    plain = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    return plain.select(F.col(f"_{at[0]}").cast("long").alias("doc_id"), F.col(f"_{at[1]}").cast("string").alias("xml"))


#: All characters that are white space to the tokens above, for the JVM's patterns.
_BLANK = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Of ASCII, a name's characters and those that it may begin with, one by one: the JVM looks such a class up in a table.
_NAMED_ASCII = "".join(f"\\x{c:02x}" for c in range(128) if not chr(c).isspace() and chr(c) not in "/>")
_FIRST_ASCII = "".join(f"\\x{c:02x}" for c in range(128) if not chr(c).isspace() and chr(c) not in "/>!?")


def tag_names(xml: str) -> Column:
    """The names that the column's texts may have tags of: every element's, and perhaps others."""
    found = lambda pattern: F.regexp_extract_all(xml, F.lit(pattern), F.lit(1))
    ascii_only = F.octet_length(xml) == F.length(xml)
    return F.array_distinct(F.when(ascii_only, found(f"<([{_FIRST_ASCII}][{_NAMED_ASCII}]*+)")).otherwise(found(f"<([^{_BLANK}/>!?][^{_BLANK}/>]*+)")))


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, pa.StringArray]]:
    """(ids, texts) of a batch's documents that have a text, about a megabyte at a time."""
    if batch.column(1).null_count:
        batch = batch.filter(batch.column(1).is_valid())
    ids, xml = batch.column(0).to_numpy(), batch.column(1)
    if not len(xml):
        return
    offsets = np.frombuffer(xml.buffers()[1], np.int32)[xml.offset : xml.offset + len(xml) + 1]
    a = 0
    while a < len(xml):
        b = max(a + 1, int(np.searchsorted(offsets, int(offsets[a]) + _CHUNK)) - 1)
        yield ids[a:b], xml[a:b]
        a = b


def _nodes(batches: Iterator[pa.RecordBatch], columns: list[str], names: frozenset[str] | None) -> Iterator[pa.RecordBatch]:
    """Node rows of batches of documents: of plain ones together, of the others one by one."""
    rows = _Rows(columns, names)
    for batch in batches:
        for ids, xml in _chunks(batch):
            made, others = plain.nodes(ids, xml, columns, names, plain_tag, _column_of_lists)
            if made.num_rows:
                yield made
            for k in others.tolist():
                rows.add(int(ids[k]), Tree(xml[k].as_py()))
                if rows.full():
                    yield rows.batch()
    if rows.n:
        yield rows.batch()


#: Nodes and bytes in a row group of a file that a task writes itself.
_GROUP_NODES, _GROUP_BYTES = 250_000, 32_000_000


def parse_into(docs: DataFrame, folder: str, columns: list[str] = COLUMNS, names: frozenset[str] | None = None) -> DataFrame:
    """(file) of the documents' node table, written by the tasks themselves as Parquet into a folder that all of them share: one file, with a name of its own, for each task that has nodes.

    Nodes go straight from the parser's arrays into the file. Handing them to the JVM, row by row, takes several times as long as parsing.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, writer, held = f"{folder}/_{uuid.uuid4().hex}.parquet", None, []

        def put():
            nonlocal writer
            if writer is None:
                os.makedirs(folder, exist_ok=True)
                writer = pq.ParquetWriter(path, held[0].schema, compression="zstd")
            table = pa.Table.from_batches(held)
            writer.write_table(table, row_group_size=max(table.num_rows, 1))
            held.clear()

        for made in _nodes(batches, columns, names):
            held.append(made)
            if sum(x.num_rows for x in held) >= _GROUP_NODES or sum(x.nbytes for x in held) >= _GROUP_BYTES:
                put()
        if held:
            put()
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([path], pa.string())], names=["file"])

    workspace.small_batches(docs.sparkSession)
    workspace.small_batches(docs.sparkSession)
    return docs_of(docs).where("doc_id IS NOT NULL").mapInArrow(of, "file string")


def write(docs: DataFrame, path: str, mode: str = "errorifexists", columns: list[str] | None = None, names: frozenset[str] | None = None) -> None:
    """Parse into a folder. A document's nodes come out of the parser together and in order: no sort, no shuffle. Where the folder is a plain one for every task, they write their files themselves."""
    spark = docs.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getScheme() != "file":
        parse(docs, columns, names).write.mode(mode).option("compression", "zstd").parquet(path)
        return
    if fs.exists(at(path)):
        if mode != "overwrite":
            raise FileExistsError(path)
        fs.delete(at(path), True)
    fs.mkdirs(at(path))
    columns = [c for c in COLUMNS if columns is None or c in columns]
    # what a task that failed or was repeated has left keeps its hidden name, which no reader looks at, until it goes
    whole = [r["file"] for r in parse_into(docs, fs.makeQualified(at(path)).toUri().getPath(), columns, names).collect()]
    for k, file in enumerate(whole):
        if not fs.rename(at("file", None, file), at(f"{path}/part-{k:05}.parquet")):
            raise OSError(f"{file} can't be given its name")
    for left in fs.listStatus(at(path)):
        if left.getPath().getName().startswith("_"):
            fs.delete(left.getPath(), False)


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The node table in a folder; columns that it lacks are null."""
    return spark.read.schema(", ".join(["doc_id long", *[f"{c} {kind}" for c, kind in SCHEMA.items() if columns is None or c in columns]])).parquet(path)


def parse(docs: DataFrame, columns: list[str] | None = None, names: frozenset[str] | None = None) -> DataFrame:
    """The node table of (doc_id, xml) documents.

    ``columns``: those wanted, all by default. ``names``: only elements with one of these names are handed on, numbered
    as in the whole document, so that pruning never changes a result.
    """
    columns = [c for c in COLUMNS if columns is None or c in columns]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _nodes(batches, columns, names)

    workspace.small_batches(docs.sparkSession)
    return docs_of(docs).where("doc_id IS NOT NULL").mapInArrow(of, ", ".join(["doc_id long", *[f"{c} {SCHEMA[c]}" for c in columns]]))


def parse_errors(docs: DataFrame) -> DataFrame:
    """(doc_id, error) of the documents with a tag that isn't closed."""

    def of(batches):
        for batch in batches:
            found = [(i, Tree(x).error) for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if x is not None]
            found = [(i, e) for i, e in found if e]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([e for _, e in found], pa.string())], names=["doc_id", "error"])

    return docs_of(docs).mapInArrow(of, "doc_id long, error string")
