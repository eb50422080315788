"""Operator 9: token counts that follow edits.

A document keeps a segment tree over its pre-token chunks (see ``tokens``; long ones are cut further, where letters, digits, signs and white
space meet): leaves hold numbers of characters and of tokens, inner nodes sums. The tree is a column: ``count_trees`` builds it, a table keeps it,
``edited`` applies edits to it, again and again, and gives the table with the new texts and trees.

An edit finds its chunks by descending the tree over characters. Only they are encoded again, with as many chunks on either side as it
takes until the region's edges are cuts that no token can reach over; the new chunks go into the region's leaves, and only the ancestors of these
are added up again. If there are more chunks than leaves, leaves are put in and the sums renewed; nothing else is encoded.

A run of letters without a single sign, space or digit is one leaf however long: no cut inside it is safe.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, pick
from .tokens import TOKENIZER, Chunks, chunks

EDITS = "array<struct<start:int,stop:int,text:string>>"
#: Chunks of more characters than this are cut further.
LONG = 32
#: Places that no pre-token reaches over, whatever stands around: white space begins, or the kind of character changes (but for an apostrophe and a letter).
_CUT = regex.compile(r"(?<=[^\s\x1c-\x1f])(?=[^\S\x1c-\x1f])|(?<=\p{L})(?=[^\s\p{L}\x1c-\x1f])|(?<=\p{N})(?=[^\s\p{N}\x1c-\x1f])|(?<=[^\s\p{L}\p{N}\x1c-\x1f'])(?=\p{L})|(?<=[^\s\p{L}\p{N}\x1c-\x1f])(?=\p{N})")


def leaves(text: str, tokenizer: Chunks) -> tuple[np.ndarray, np.ndarray]:
    """The characters and tokens of each of a text's chunks."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    numbers, pieces = tokenizer.numbers(text)
    tokens = tokenizer.count[numbers]
    if pieces is None:
        pieces = text.split(" ")
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        sizes[1:] += 1
    else:
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    long = np.flatnonzero(sizes > LONG)
    if not len(long):
        return sizes, tokens
    out_s, out_t, done = [], [], 0
    begins = np.cumsum(sizes) - sizes
    for k in long.tolist():
        piece = text[begins[k] : begins[k] + sizes[k]]
        places = [m.start() for m in _CUT.finditer(piece)]
        if not places:
            continue
        edges = [0, *places, len(piece)]
        out_s += [sizes[done:k], np.diff(edges)]
        out_t += [tokens[done:k], np.array([tokenizer.length(piece[i:j]) for i, j in zip(edges, edges[1:])])]
        done = k + 1
    return np.concatenate([*out_s, sizes[done:]]), np.concatenate([*out_t, tokens[done:]])


def _sums(values: np.ndarray) -> np.ndarray:
    """Leaves at size..., node i over 2i and 2i+1, the total at 1; size is a power of two."""
    size = 1 << max(0, int(len(values) - 1).bit_length())
    tree = np.zeros(2 * size, np.int64)
    tree[size : size + len(values)] = values
    while size > 1:
        tree[size // 2 : size] = tree[size : 2 * size : 2] + tree[size + 1 : 2 * size : 2]
        size //= 2
    return tree


def _pack(tree: np.ndarray, n: int) -> bytes:
    """The nodes above the n leaves that are in use, level by level in as few bytes as each level needs."""
    out, size, used = [], len(tree) // 2, n
    while size:
        level = tree[size : size + used]
        kind = next(k for k, t in enumerate("BHIQ") if not used or level.max() < 1 << 8 * struct.calcsize("=" + t))
        out += [bytes([kind]), level.astype((np.uint8, np.uint16, np.uint32, np.uint64)[kind]).tobytes()]
        size, used = size // 2, (used + 1) // 2
    return b"".join(out)


def _unpack(raw: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    size = 1 << max(0, int(n - 1).bit_length())
    tree = np.zeros(2 * size, np.int64)
    while size:
        kind = (np.uint8, np.uint16, np.uint32, np.uint64)[raw[at]]
        level = np.frombuffer(raw, kind, n, at + 1)
        tree[size : size + n] = level
        at += 1 + level.nbytes
        size, n = size // 2, (n + 1) // 2
    return tree, at


class CountTree:
    """Characters and token counts of one text's chunks as sums over binary trees, kept under edits."""

    def __init__(self, text: str, tokenizer: Chunks, kept: bytes | None = None):
        """Built from the text; with ``kept``, the bytes of the text's tree, read from there, and nothing is encoded."""
        self.text, self.tokenizer, self.reencoded = text, tokenizer, 0
        if kept is None:
            self._take(*leaves(text, tokenizer))
        else:
            (self.n,) = struct.unpack_from("<q", kept)
            self.chars, at = _unpack(kept, 8, self.n)
            self.tokens, _ = _unpack(kept, at, self.n)

    def _take(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.n = len(chars)
        self.chars, self.tokens = _sums(chars), _sums(tokens)

    def to_bytes(self) -> bytes:
        return struct.pack("<q", self.n) + _pack(self.chars, self.n) + _pack(self.tokens, self.n)

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def _leaf(self, place: int) -> tuple[int, int]:
        """The leaf that the character at ``place`` is in, the last one with characters for a place at the text's end; where it begins."""
        tree, size = self.chars, len(self.chars) // 2
        place = min(place, int(tree[1]) - 1)
        i, begin = 1, 0
        while i < size:
            i *= 2
            if begin + tree[i] <= place:
                begin += int(tree[i])
                i += 1
        return i - size, begin

    def _put(self, tree: np.ndarray, lo: int, hi: int, values: np.ndarray) -> None:
        """Leaves lo..hi get the values, then zeros; sums above are renewed."""
        size = len(tree) // 2
        tree[size + lo : size + hi + 1] = 0
        tree[size + lo : size + lo + len(values)] = values
        a, b = (size + lo) // 2, (size + hi) // 2
        while a:
            tree[a : b + 1] = tree[2 * a : 2 * b + 2 : 2] + tree[2 * a + 1 : 2 * b + 2 : 2]
            a, b = a // 2, b // 2

    def apply(self, edits: list[tuple[int, int, str]]) -> str:
        """Replace text[start:stop] for each edit, all given in the present text's characters; the new text. May be called again and again.

        Edits are taken in order of (start, stop); one that begins inside the one before is cut to what is left, ends beyond the text
        are cut to it, a null replacement is empty.
        """
        text, clean, at = self.text, [], 0
        for start, stop, new in sorted(((max(0, e[0]), e[1], e[2] or "") for e in edits), key=lambda e: (e[0], e[1])):
            start, stop = min(max(start, at), len(text)), min(max(start, stop, at), len(text))
            if start < stop or new:
                clean.append((start, stop, new))
            at = stop
        if not clean:
            return text
        if not text:
            self.text = "".join(new for *_, new in clean)
            self._take(*leaves(self.text, self.tokenizer))
            self.reencoded += self.n
            return self.text
        # regions: (first leaf, last leaf, begin, end, edits); those that meet are one
        regions: list[list] = []
        for start, stop, new in clean:
            (lo, begin), (hi, last) = self._leaf(start), self._leaf(max(start, stop - 1))
            regions.append([lo, hi, begin, last + int(self.chars[len(self.chars) // 2 + hi]), [(start, stop, new)]])
        size = len(self.chars) // 2
        k = 0
        while k < len(regions):
            region = regions[k]
            while k + 1 < len(regions) and regions[k + 1][2] <= region[3]:
                other = regions.pop(k + 1)
                region[1], region[3] = max(region[1], other[1]), max(region[3], other[3])
                region[4] += other[4]
            lo, hi, begin, end, own = region[:5]
            pieces, at = [], begin
            for start, stop, new in own:
                pieces += [text[at:start], new]
                at = stop
            new = "".join([*pieces, text[at:end]])
            left, right = text[begin - 1 : begin] if begin else "", text[end : end + 1]
            inner = new or right
            if left and inner and not _CUT.search(left + inner[0]):
                region[0], region[2] = self._leaf(begin - 1)
                if k and regions[k - 1][3] >= region[2]:
                    k -= 1
                continue
            if right and new and not _CUT.search(new[-1] + right):
                region[1], last = self._leaf(end)
                region[3] = last + int(self.chars[size + region[1]])
                continue
            region[5:] = [new]
            k += 1
        parts, before, grown = [], 0, []
        for lo, hi, begin, end, _, new in regions:
            parts += [text[before:begin], new]
            before = end
            chars, tokens = leaves(new, self.tokenizer)
            self.reencoded += len(chars)
            if len(chars) <= hi - lo + 1:
                self._put(self.chars, lo, hi, chars)
                self._put(self.tokens, lo, hi, tokens)
            else:
                grown.append((lo, hi, chars, tokens))
        if grown:
            own_c, own_t = self.chars[size : size + self.n], self.tokens[size : size + self.n]
            all_c, all_t, done = [], [], 0
            for lo, hi, chars, tokens in grown:
                all_c += [own_c[done:lo], chars]
                all_t += [own_t[done:lo], tokens]
                done = hi + 1
            all_c, all_t = np.concatenate([*all_c, own_c[done:]]), np.concatenate([*all_t, own_t[done:]])
            used = all_c > 0
            self._take(all_c[used], all_t[used])
        self.text = "".join([*parts, text[before:]])
        return self.text


_NUMBER = re.compile(r"\d{4,}")


def redactions(text: str) -> list[tuple[int, int, str]]:
    """The edits that the query applies: numbers of four or more digits are masked and every later copy of a line goes."""
    out, seen, at = [], set(), 0
    for line in text.split("\n"):
        end = at + len(line)
        if len(line) > 20 and line in seen:
            out.append((at, min(end + 1, len(text)), ""))
        else:
            seen.add(line)
            out += [(at + m.start(), at + m.end(), "[number]") for m in _NUMBER.finditer(line)]
        at = end + 1
    return out


TREES = "doc_id long, text string, tree binary, n_pretokens int, n_tokens int"
EDITED = TREES + ", n_edits int, n_reencoded int, n_tokens_after int"


def _batch(names: list[str], ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"text": pa.string(), "tree": pa.binary()}
    columns = list(zip(*rows)) or [()] * (len(names) - 1)
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, kinds.get(n, pa.int32())) for n, c in zip(names[1:], columns))], names=names)


def _slices(batch: pa.RecordBatch):
    """The batch in parts of few enough rows that their trees needn't all be held at once."""
    step = max(1, min(batch.num_rows, 2_000_000 * max(1, batch.num_rows) // max(1, batch.nbytes)))
    for lo in range(0, batch.num_rows, step):
        yield batch.slice(lo, step)


def _build(path: str):
    names = [x.split()[0] for x in TREES.split(", ")]

    def of(batches):
        tokenizer = chunks(path)
        for batch in batches:
            for part in _slices(batch):
                rows = []
                for text in part.column(1).to_pylist():
                    if text is None:
                        rows.append((None,) * 4)
                        continue
                    tree = CountTree(text, tokenizer)
                    rows.append((text, tree.to_bytes(), tree.n, tree.total))
                yield _batch(names, part.column(0), rows)

    return of


def _edit(path: str, given: bool, keep: bool):
    names = [x.split()[0] for x in EDITED.split(", ") if keep or x.split()[0] not in ("text", "tree")]

    def of(batches):
        tokenizer = chunks(path)
        for batch in batches:
            for part in _slices(batch):
                edits = part.column(3).to_pylist() if given else None
                rows = []
                for k, (text, kept) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    if text is None:
                        rows.append((None,) * (len(names) - 1))
                        continue
                    tree = CountTree(text, tokenizer, kept)
                    before, n = tree.total, tree.n
                    todo = redactions(text) if edits is None else [(e["start"], e["stop"], e["text"]) for e in edits[k] or () if e and e["start"] is not None and e["stop"] is not None]
                    if todo:
                        tree.apply(todo)
                    rows.append((*((tree.text, tree.to_bytes() if todo else kept) if keep else ()), n, before, len(todo), tree.reencoded, tree.total))
                yield _batch(names, part.column(0), rows)

    return of


def count_trees(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, text, tree, n_pretokens, n_tokens): each document with its segment tree, one row for each of ``docs``; a table to be written and kept.

    A null text gives nulls, an empty one an empty tree. Null and repeated doc_ids pass through; further columns are dropped; an empty table
    gives an empty result. No shuffle.
    """
    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(_build(tokenizer), TREES)


def edited(trees: DataFrame, edits: DataFrame | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """``trees`` after edits: (doc_id, text, tree, n_pretokens, n_tokens, n_edits, n_reencoded, n_tokens_after).

    ``edits`` are rows (doc_id, start, stop, text): characters start..stop of the document become the text; without them, ``redactions``. n_pretokens
    and n_tokens are those before, n_reencoded says how many chunks were encoded. The result's doc_id, text and tree go into the
    next round of edits. Edits without a document, or with a null doc_id, start or stop, are ignored; documents without edits keep their tree and aren't
    encoded. See ``CountTree.apply`` for edits that overlap or reach beyond the text. Rows that share a doc_id all get its edits. Only the edits
    are grouped; documents are shuffled only where Spark doesn't broadcast the edits.
    """
    base = pick(trees, "doc_id", "text", "tree")
    if edits is None:
        return base.mapInArrow(_edit(tokenizer, False, True), EDITED)
    given = pick(edits, "doc_id", "start", "stop", "text").where("doc_id IS NOT NULL AND start IS NOT NULL AND stop IS NOT NULL")
    lists = given.groupBy(F.col("doc_id").cast("long").alias("e_id")).agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), "text"))).alias("edits"))
    joined = base.join(lists, F.col("doc_id") == F.col("e_id"), "left").select("doc_id", "text", "tree", "edits")
    return joined.mapInArrow(_edit(tokenizer, True, True), EDITED)


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, n_edits, n_reencoded, n_tokens_after): counts before and after ``redactions``, one row for each of ``docs``.

    The trees are written first and the edits applied to the written ones, as a later job would. Nulls and the rest as in ``count_trees``.
    """
    kept = cut(count_trees(docs, tokenizer))
    return kept.select("doc_id", "text", "tree").mapInArrow(_edit(tokenizer, False, False), EDITED.replace(" text string, tree binary,", ""))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
