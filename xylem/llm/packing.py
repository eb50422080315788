"""Operator 10: conflict-constrained best-fit packing of documents into sequences.

Documents (in tokens) go to sequences of ``capacity`` tokens, the largest first. A bin carries a bitmap of the sources and
of the duplicate clusters in it; a document doesn't fit a bin that holds its source or its cluster already. Bins are
ordered by residual; the search begins at the smallest residual that is large enough and goes on through larger ones until it
meets a compatible bin: the tightest there is. A tree over the residuals keeps, for each node, the bits that *all* bins below have,
so that a subtree whose bins all conflict is skipped at once. With no compatible bin a new one is opened.

A document longer than the capacity is cut into full sequences, which are bins of their own, and a rest, which is packed.

Shards of documents (by hash of doc_id and text) are packed independently, so the work is spread and a shard's order is all that matters.
"""

from __future__ import annotations

import math

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, each_word_array, pick
from .tokens import TOKENIZER, chunks

CAPACITY = 8192
#: Documents in a shard, about. The number of shards follows the table alone.
SHARD_DOCS = 16_384


class Bins:
    """Open bins by residual, with the tree of common bits."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.size = 1 << capacity.bit_length()
        self.common = [-1] * (2 * self.size)  # -1: no bins below, that is, all bits
        self.at: list[dict[int, int]] = [{} for _ in range(capacity + 1)]  # residual: {bin: bitmap}

    def _renew(self, residual: int) -> None:
        value = -1
        for bits in self.at[residual].values():
            value &= bits
        i = residual + self.size
        common = self.common
        common[i] = value
        while i > 1:
            i >>= 1
            value = common[2 * i] & common[2 * i + 1]
            if common[i] == value:
                break
            common[i] = value

    def put(self, number: int, residual: int, bits: int) -> None:
        if residual > 0:
            self.at[residual][number] = bits
            self._renew(residual)

    def take(self, residual: int, number: int) -> int:
        bits = self.at[residual].pop(number)
        self._renew(residual)
        return bits

    def tightest(self, need: int, bits: int) -> tuple[int, int] | None:
        """(residual, bin) of the compatible bin with the least residual >= need; of several the first opened."""
        stack = []
        i = need + self.size
        # the subtrees to the right of the path from the leaf to the root, nearest first
        order = [i]
        while i > 1:
            if not i & 1:
                order.append(i + 1)
            i >>= 1
        common = self.common
        for root in order:
            stack = [root]
            while stack:
                i = stack.pop()
                if common[i] & bits:  # all bins below hold one of the bits, or there are none
                    continue
                if i >= self.size:
                    residual = i - self.size
                    best = min((k for k, b in self.at[residual].items() if not b & bits), default=None)
                    if best is not None:
                        return residual, best
                    continue
                stack += [2 * i + 1, 2 * i]
        return None


def pack(sizes: list[int], bits: list[int], capacity: int) -> list[int]:
    """The bin of each item, in the order given; sizes are between 1 and capacity; bit 0 is set in every item and in no bin."""
    bins, out, opened = Bins(capacity), [], 0
    for size, own in zip(sizes, bits):
        found = bins.tightest(size, own)
        if found is None:
            number, residual, held = opened, capacity, 0
            opened += 1
        else:
            residual, number = found
            held = bins.take(residual, number)
        bins.put(number, residual - size, (held | own) & ~1)
        out.append(number)
    return out


def _measure(path: str):
    """Token count and the hash of the text's words, which names the cluster of its copies."""

    def of(batches):
        tokenizer = chunks(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lengths = [tokenizer.length(t) if t else 0 for t in texts]
            clusters = [xxhash.xxh64_intdigest(w.tobytes()) - (1 << 63) for w in each_word_array(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int32()), batch.column(2), pa.array(clusters, pa.int64()), batch.column(3)], names=["doc_id", "n_tokens", "source", "cluster", "tie"])

    return of


_OUT = "shard int, bin long, doc_id long, start int, length int, source string"


def _bits(values: list) -> list[int]:
    """A bit for every value that occurs twice or more; others can't conflict and get none."""
    seen: dict = {}
    for v in values:
        seen[v] = seen.get(v, 0) + 1
    places = {v: 1 << k for k, v in enumerate(v for v, c in seen.items() if c > 1 and v is not None)}
    return [places.get(v, 0) for v in values]


def _pack_shard(rows: list[tuple], capacity: int) -> list[tuple]:
    """(bin, doc_id, start, length, source) of a shard's (doc_id, n_tokens, source, cluster, tie), any order."""
    rows = sorted(rows, key=lambda r: (-(r[1] % capacity), -r[1], r[0] is None, r[0] or 0, r[4]))
    rest = [r for r in rows if r[1] % capacity]
    source, cluster = _bits([r[2] for r in rest]), _bits([r[3] for r in rest])
    n = max((s.bit_length() for s in source), default=0) + 1
    # one bit set in no bin keeps an item without conflicts from looking like an empty subtree
    bits = [1 | s << 1 | c << n for s, c in zip(source, cluster)]
    out, number = [], 0
    packed = pack([r[1] % capacity for r in rest], bits, capacity)
    for r, b in zip(rest, packed):
        out.append((b, r[0], r[1] - r[1] % capacity, r[1] % capacity, r[2]))
    number = max(packed, default=-1) + 1
    for r in rows:
        for start in range(0, r[1] - r[1] % capacity, capacity):
            out.append((number, r[0], start, capacity, r[2]))
            number += 1
    return out


def _shard(capacity: int):
    def of(batches):
        shards: dict[int, list] = {}
        for batch in batches:
            for s, *row in zip(*(c.to_pylist() for c in batch.columns)):
                shards.setdefault(s, []).append(tuple(row))
        for s in sorted(shards):
            out = _pack_shard(shards.pop(s), capacity)
            b, ids, start, length, source = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array([s] * len(b), pa.int32()), pa.array([(s << 32) + x for x in b], pa.int64()), pa.array(ids, pa.int64()), pa.array(start, pa.int32()), pa.array(length, pa.int32()), pa.array(source, pa.string())],
                names=["shard", "bin", "doc_id", "start", "length", "source"],
            )

    return of


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, shard_docs: int = SHARD_DOCS, clusters: DataFrame | None = None) -> DataFrame:
    """(shard, bin, doc_id, start, length, source): every piece of every document and its bin; bins are numbered apart in each shard.

    Pieces cover each document's tokens once. A text without tokens (null, empty) has no row. A null source conflicts
    with nothing; documents with the same words are one cluster. With ``clusters`` (doc_id, class_id), such as the result of the n-gram Jaccard join, documents
    of one class are, and only those that it doesn't name, or with a null there, go by their words; of a doc_id's several classes the least counts. Ties go by doc_id (null last), then by a hash of the text. Repeated
    rows are packed each, into different bins. Further columns are ignored. An empty table gives an empty result.
    """
    base = pick(docs, "doc_id", "text", "source").select(F.col("doc_id").cast("long"), "text", F.col("source").cast("string"), F.xxhash64("doc_id", "text").alias("tie"))
    measured = cut(base.where("text IS NOT NULL").mapInArrow(_measure(tokenizer), "doc_id long, n_tokens int, source string, cluster long, tie long").where("n_tokens > 0"))
    if clusters is not None:
        named = pick(clusters, "doc_id", "class_id").where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("class_id").alias("class_id"))
        measured = measured.join(named, "doc_id", "left").withColumn("cluster", F.when(F.col("class_id").isNull(), F.col("cluster")).otherwise(F.xxhash64("class_id"))).drop("class_id")
    shards = max(1, math.ceil(measured.count() / shard_docs))
    keyed = measured.select(F.pmod(F.xxhash64("tie"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "n_tokens", "source", "cluster", "tie")
    return keyed.repartitionById(shards, F.col("shard")).mapInArrow(_shard(capacity), _OUT)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"))
