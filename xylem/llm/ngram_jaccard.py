"""Operator 3: n-gram Jaccard self-join as a distributed T-occurrence search.

A document is the set of its word n-grams.  Two documents with Jaccard similarity of at least ``threshold`` share at
least T n-grams, T following from their sizes.  DivideSkip splits a query's inverted lists into long ones, which are
set aside, and short ones, which are merged; a document that reaches T lies in at least T - L of the short lists.

* A first pass finds frequent n-grams (long lists).  They only set the order in which lists are set aside: any
  order gives the same result.
* In the second pass each document sends its short lists' postings: its n-grams but the last ceil(threshold * size) - 1
  of the common order (other n-grams by hash, frequent ones last).  N-grams are spread over shards.
* A shard drops the lists of one document, which are most; several shards' remaining lists make a unit, so that units are few however many shards there are.
* In a unit the lists are merged and occurrences counted, those of a range of documents at a time.  Common n-grams that aren't in both short lists lie behind the
  cut that comes first in the common order, so L is what that document sets aside.  By the pigeonhole principle a pair that reaches T - L over
  all units reaches its share in one of them. Units that it doesn't reach it in have less than a share each, so the counts of the others,
  added up, show which pairs can't reach T - L; the rest are the candidates.
* Only candidates' full sets are fetched, to one cell for each group of candidates (a large group has a grid of cells, so that a
  document with many partners isn't copied for each); the remaining lists are probed by binary search and the exact overlap decides.

Copies with one n-gram set are one entry throughout, so groups of copies cost nothing extra.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, each_word_array, give_back, gram_hashes, pick, semi_or_anti, set_hash, word_hashes

N = 5
THRESHOLD = 0.4
#: N-grams whose postings a shard gets, the least number of shards, and postings that are looked up at once.
SHARD_GRAMS, LEAST_SHARDS, MERGE_POSTINGS = 12_000_000, 16, 1_500_000
#: Postings of lists with two documents or more that a unit of shards merges, in blobs of so many (at most 24 bytes each: rows of megabytes take far more of the JVM
#: than their size), and occurrences of pairs that are counted at once.
UNIT_POSTINGS, BLOB_POSTINGS, MERGE_PAIRS = 6_000_000, 10_000, 500_000
#: Bytes of a row group of blobs: whoever writes or reads it holds all of it, and a reader's column as much again.
BLOB_ROW_GROUP = 8_000_000
#: How many frequent n-grams the order knows of; an aid to speed, not to the result.
FREQUENT, FREQUENT_LEAST = 100_000, 16
CELL_BYTES, CELL_PAIRS = 64_000_000, 60_000
#: Bytes of rows that go to a Python worker at once, about, and pairs that come from it at once.
BATCH_BYTES, PAIR_ROWS = 8_000_000, 100_000
_EMPTY = np.empty(0, np.uint64)
_S32, _DOC = np.uint64(32), np.uint64(0xFFFFFFFF)


def gram_set(text: str | None, n: int = N) -> np.ndarray:
    """The sorted distinct n-gram hashes of a text."""
    return np.unique(gram_hashes(word_hashes(text), n))


def gram_sets(column: pa.Array, n: int):
    """The gram set of each text of a column."""
    return (np.unique(gram_hashes(w, n)) for w in each_word_array(column))


def _flush(sets: list[np.ndarray]) -> pa.RecordBatch | None:
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    often = counts >= 4
    if not often.any():
        return None
    c = counts[often].astype(np.int64)
    none = pa.nulls(len(c), pa.int64())
    return pa.RecordBatch.from_arrays([none, pa.array(values[often].view(np.int64)), pa.array(c), pa.array(np.ones(len(c), np.int8))], names=["doc_id", "sid", "n", "kind"])


def _sets(n: int):
    """Each document's set hash and size, and n-grams that are frequent in what the task has seen."""

    def of(batches):
        waiting, size = [], 0
        for batch in batches:
            sids, sizes, keep = [], [], []
            for k, g in enumerate(gram_sets(batch.column(1), n)):
                if len(g):
                    keep.append(k), sids.append(set_hash(g)), sizes.append(len(g))
                    waiting.append(g)
                    size += len(g)
            if keep:
                ids = batch.column(0).take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.zeros(len(keep), np.int8))], names=["doc_id", "sid", "n", "kind"])
            if size > 1_000_000:
                if (out := _flush(waiting)) is not None:
                    yield out
                waiting, size = [], 0
        if waiting and (out := _flush(waiting)) is not None:
            yield out

    return of


def prefix_length(size: int, threshold: float) -> int:
    return size - math.ceil(threshold * size - 1e-9) + 1


def short_lists(grams: np.ndarray, frequent: np.ndarray, rank: np.ndarray, threshold: float) -> np.ndarray:
    """The n-grams of a set whose lists are merged: rare ones first."""
    p = prefix_length(len(grams), threshold)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
        hot = frequent[at] == grams
        if hot.any():
            hot_grams = grams[hot]
            grams = np.concatenate([grams[~hot], hot_grams[np.argsort(rank[at[hot]])]])
    return grams[:p]


def cut_places(last: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Where in the common order the short lists end, given each one's last n-gram: 32 bits that rise with the order, so only different ones tell which is first."""
    places = (last >> np.uint64(33)).astype(np.uint32)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, last), len(frequent) - 1)
        places = np.where(frequent[at] == last, (1 << 31) + len(frequent) + rank[at], places).astype(np.uint32)
    return places


def _postings(n: int, threshold: float, shards: int, frequent: np.ndarray, rank: np.ndarray):
    """Blobs of postings for each shard: set hashes, sizes, cuts, numbers of n-grams, and the n-grams (32 bits of them)."""

    def blobs(sids, sizes, lists):
        grams = np.concatenate(lists)
        doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        shard = (grams % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard * len(lists) + doc, kind="stable")
        grams, doc, shard = grams[order], doc[order], shard[order]
        short = (grams >> np.uint64(24)).astype(np.uint32)
        edges = np.searchsorted(shard, np.arange(shards + 1))
        out_s, out_n, out_b = [], [], []
        sids, sizes, cuts = np.array(sids, np.int64), np.array(sizes, np.uint32), cut_places(np.array([x[-1] for x in lists]), frequent, rank)
        for s in range(shards):
            lo, hi = edges[s], edges[s + 1]
            if lo < hi:
                d, c = np.unique(doc[lo:hi], return_counts=True)
                out_s.append(s), out_n.append(len(d))
                out_b.append(sids[d].tobytes() + sizes[d].tobytes() + cuts[d].tobytes() + c.astype(np.uint32).tobytes() + short[lo:hi].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(out_s, pa.int32()), pa.array(out_n, pa.int32()), pa.array(out_b, pa.binary())], names=["shard", "n", "blob"])

    def of(batches):
        sids, sizes, lists, seen, size = [], [], [], set(), 0
        for batch in batches:
            for g in gram_sets(batch.column(0), n):
                if not len(g) or (sid := set_hash(g)) in seen:
                    continue
                seen.add(sid)
                s = short_lists(g, frequent, rank, threshold)
                sids.append(sid), sizes.append(len(g)), lists.append(s)
                size += len(s)
            if size > 1_000_000:
                yield blobs(sids, sizes, lists)
                sids, sizes, lists, seen, size = [], [], [], set(), 0
        if lists:
            yield blobs(sids, sizes, lists)

    return of


def required(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """The overlap T that sets of these sizes need."""
    return np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)


def _joined(columns: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The columns of postings in one piece each; their pieces are let go."""
    out = []
    for x in columns:
        out.append(np.concatenate(x))
        x.clear()
        give_back()
    return out


def _pack(sid, size, place, count, grams) -> bytes:
    return b"".join(x.tobytes() for x in (sid, size, place, count.astype(np.uint32), grams))


def _shared_lists(columns: list[list[np.ndarray]]):
    """(number of documents, blob, number of n-grams) of a shard's lists with two documents or more; a set that several tasks have sent counts once."""
    sid, size, place, count, grams = _joined(columns)
    once = np.zeros(len(sid), bool)
    once[np.unique(sid, return_index=True)[1]] = True
    if not once.all():
        grams = grams[np.repeat(once, count)]
        sid, size, place, count = sid[once], size[once], place[once], count[once]
    give_back()
    again = np.sort(grams)
    again = np.unique(again[1:][again[1:] == again[:-1]])
    if not len(again):
        return
    keep = np.empty(len(grams), bool)
    for lo in range(0, len(grams), MERGE_POSTINGS):
        some = grams[lo : lo + MERGE_POSTINGS]
        keep[lo : lo + len(some)] = again[np.minimum(np.searchsorted(again, some), len(again) - 1)] == some
    edges = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
    kept = np.concatenate([[0], np.cumsum(keep, dtype=np.uint32)])[edges]
    grams, count = grams[keep], np.diff(kept)
    has = count > 0
    sid, size, place, count = sid[has], size[has], place[has], count[has]
    edges = np.concatenate([[0], np.cumsum(count)])
    lo = 0
    while lo < len(sid):
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + BLOB_POSTINGS, "right")) - 1)
        yield hi - lo, _pack(sid[lo:hi], size[lo:hi], place[lo:hi], count[lo:hi], grams[edges[lo] : edges[hi]]), int(edges[hi] - edges[lo])
        lo = hi


def _merge_unit(columns: list[list[np.ndarray]], threshold: float, units: int):
    """Pairs of set hashes whose count in this unit's lists reaches their share of T - L; by how much, and how much all units must have.

    Besides a few numbers for each posting, no more than the pairs of a range of documents are held.
    """
    sid, size, place, count, grams = _joined(columns)
    # a document has an entry for each shard, all of one size and cut; documents by size: within a list the partners of similar size then are neighbours
    sids = np.sort(sid)
    sids = sids[np.append(True, sids[1:] != sids[:-1])]
    entry = np.empty(len(sid), np.uint32)
    for lo in range(0, len(sid), MERGE_POSTINGS):
        entry[lo : lo + MERGE_POSTINGS] = np.searchsorted(sids, sid[lo : lo + MERGE_POSTINGS])
    del sid
    sizes, places = np.empty(len(sids), np.int32), np.empty(len(sids), np.uint32)
    sizes[entry], places[entry] = size, place
    order = np.argsort(sizes, kind="stable")
    new = np.empty(len(sids), np.uint32)
    new[order] = np.arange(len(sids), dtype=np.uint32)
    sid, size, place, entry = sids[order], sizes[order], places[order], new[entry]
    del sids, sizes, places, order, new
    # a posting is its n-gram and its document in one number
    key = grams.astype(np.uint64)
    del grams
    key <<= _S32
    key |= np.repeat(entry, count)
    del entry, count
    key.sort()
    give_back()
    suffix = (np.ceil(threshold * size - 1e-9) - 1).astype(np.int32)
    for code, c in _counted_pairs(key, size, threshold):
        a, b = code // len(sid), code % len(sid)
        # common n-grams outside the merged lists lie behind the first of both cuts; where that isn't known, behind either
        aside = np.where(place[a] < place[b], suffix[a], np.where(place[a] > place[b], suffix[b], np.maximum(suffix[a], suffix[b])))
        total = np.maximum(1, required(size[a].astype(np.int64), size[b], threshold) - aside)
        below = np.ceil(total / units) - 1  # the most that a unit without the pair has of it
        good = (c > below) & (a != b)
        a, b = sid[a[good]], sid[b[good]]
        excess, missing = np.minimum(c - below, units)[good].astype(np.int32), (total - units * below)[good].astype(np.int32)
        found = pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(excess), pa.array(missing)], names=["a", "b", "excess", "missing"])
        for lo in range(0, len(found), PAIR_ROWS):
            yield found.slice(lo, PAIR_ROWS)


def _counted_pairs(key: np.ndarray, size: np.ndarray, threshold: float):
    """(pair codes, counts) from sorted postings: all pairs of a range of documents with later ones at a time, each pair once."""
    limit = np.searchsorted(size, np.floor(size / threshold + 1e-9), "right").astype(np.uint32)  # by document: the first that is too large

    def partners(at: slice | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of postings, and the place after the last of their list that they meet: each meets the later ones up to the largest size allowed."""
        some = key[at]
        doc = some & _DOC
        return doc, np.searchsorted(key, (some & ~_DOC) | limit[doc])

    met, own, n = np.zeros(len(size)), np.empty(len(key), np.uint64), 0
    for lo in range(0, len(key), MERGE_POSTINGS):
        doc, stop = partners(slice(lo, lo + MERGE_POSTINGS))
        at = np.arange(lo, lo + len(doc))
        stop -= at + 1
        met += np.bincount(doc.astype(np.int64), stop, len(size))
        has = stop > 0
        some = (doc[has] << _S32) | at[has].astype(np.uint64)
        own[n : n + len(some)] = some
        n += len(some)
    own = own[:n]
    own.sort()  # by document
    met = np.cumsum(met)
    lo = 0
    while lo < len(own):
        d = int(own[lo] >> _S32)
        to = max(d + 1, int(np.searchsorted(met, (met[d - 1] if d else 0) + MERGE_PAIRS, "right")))
        hi = int(np.searchsorted(own, np.uint64(to << 32)))
        at = (own[lo:hi] & _DOC).astype(np.int64)
        yield _count_pairs(key, at, partners(at)[1] - at - 1, len(size))
        lo = hi


def _count_pairs(key: np.ndarray, at: np.ndarray, partners: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the pairs of postings ``at`` with as many that follow as ``partners`` says, MERGE_PAIRS at once."""
    pieces = -(-partners // MERGE_PAIRS)
    piece = _within(pieces)
    left, length = np.repeat(at, pieces), np.minimum(np.repeat(partners, pieces) - piece * MERGE_PAIRS, MERGE_PAIRS)
    begin = left + 1 + piece * MERGE_PAIRS
    total = np.cumsum(length)
    code, count = np.empty(0, np.int64), np.empty(0, np.int64)
    lo = 0
    while lo < len(left):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + MERGE_PAIRS, "right")))
        n = length[lo:hi]
        some = np.repeat((key[left[lo:hi]] & _DOC).astype(np.int64) * n_docs, n)
        some += (key[np.repeat(begin[lo:hi], n) + _within(n)] & _DOC).astype(np.int64)
        some, c = np.unique(some, return_counts=True)
        if len(code):
            some, back = np.unique(np.concatenate([code, some]), return_inverse=True)
            c = np.bincount(back, np.concatenate([count, c]), len(some)).astype(np.int64)
        code, count = some, c
        lo = hi
    return code, count


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... lengths[0]-1, 0, 1, ..."""
    total = int(lengths.sum())
    starts = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(starts, lengths)


def _held(batches) -> dict[int, list[list[np.ndarray]]]:
    """By shard, of documents their set hashes, sizes, cuts and numbers of n-grams, and the n-grams: a piece of each for each blob. The batches are let go."""
    held: dict[int, list[list[np.ndarray]]] = {}
    for batch in batches:
        for s, k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            raw = raw.as_buffer()
            columns = held.setdefault(s, [[], [], [], [], []])
            for x, kind, n, at in zip(columns, (np.int64, *[np.uint32] * 4), (k, k, k, k, -1), (0, 8 * k, 12 * k, 16 * k, 20 * k)):
                x.append(np.frombuffer(raw, kind, n, at).copy())
        del batch, raw
    return held


def _shared(batches):
    held = _held(batches)
    for s in list(held):
        for k, blob, grams in _shared_lists(held.pop(s)):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([k], pa.int32()), pa.array([blob], pa.binary()), pa.array([grams], pa.int64())], names=["shard", "n", "blob", "grams"])
    give_back()


def _merge(threshold: float, units: int):
    def of(batches):
        held = _held(batches)
        for u in list(held):
            yield from _merge_unit(held.pop(u), threshold, units)
        give_back()

    return of


def _fetch(n: int):
    def rows(sids, sets):
        return pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(sets, pa.binary())], names=["sid", "grams"])

    def of(batches):
        for batch in batches:
            sids, sets, size = [], [], 0
            for g in gram_sets(batch.column(0), n):
                if len(g):
                    sids.append(set_hash(g)), sets.append(g.tobytes())
                    size += g.nbytes
                if size > 8_000_000:
                    yield rows(sids, sets)
                    sids, sets, size = [], [], 0
            yield rows(sids, sets)

    return of


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted sets: the smaller one's are looked up in the larger by binary search."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


class Forest:
    """Connected groups of hashable nodes; each group's root is its least node."""

    def __init__(self):
        self.parent: dict = {}

    def root(self, x):
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    def join(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _probe(threshold: float):
    """Rows sorted by cell, sets (with their numbers of documents) before pairs; for each set with links in a cell its root there and how many documents it is linked with."""

    def of(batches):
        cell, sets, links, forest = None, {}, {}, Forest()

        def done():
            sids = list(links)
            return pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array([forest.root(x) for x in sids], pa.int64()), pa.array([links[x] for x in sids], pa.int64())], names=["sid", "root", "links"])

        for batch in batches:
            for c, a, b, docs, raw in zip(*(x.to_pylist() for x in batch.columns)):
                if c != cell:
                    if links:
                        yield done()
                    cell, sets, links, forest = c, {}, {}, Forest()
                if raw is not None:
                    sets[a] = (np.frombuffer(raw, np.uint64), docs)
                elif a in sets and b in sets:
                    (x, nx), (y, ny) = sets[a], sets[b]
                    k = overlap(x, y)
                    if k / (len(x) + len(y) - k) >= threshold:
                        links[a], links[b] = links.get(a, 0) + ny, links.get(b, 0) + nx
                        forest.join(a, b)
        if links:
            yield done()

    return of


def _small(df: DataFrame) -> DataFrame:
    """``df``, after the session's limit on the bytes of a batch that goes to Python is lowered to BATCH_BYTES: a batch of blobs would be as large as a shard."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def similar_sets(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members: sid, doc_id, n) and (linked: sid, root, links): for different sets with Jaccard >= threshold.

    A row of ``linked`` says with how many documents (of other sets) the set is linked in one cell, and the least set that these links
    connect it to; a set has a row for each cell it has links in, and no pair is in two cells. So n near copies give rows
    in proportion to n, although each of their links is verified and counted.
    """
    base = _small(pick(docs, "doc_id", "text")).where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    seen = cut(base.mapInArrow(_sets(n), "doc_id long, sid long, n long, kind byte"))
    members = seen.where("kind = 0").select("sid", "doc_id", "n").distinct()
    often = seen.where("kind = 1").groupBy("sid").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_LEAST).orderBy(F.desc("n"), "sid").limit(FREQUENT).collect()
    hot = np.array([r["sid"] for r in often], np.int64).view(np.uint64)
    by = np.argsort(hot)
    frequent, rank = hot[by], -by  # rarest of them first
    total = seen.where("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(LEAST_SHARDS, math.ceil(total / SHARD_GRAMS))
    blobs = base.select("text").mapInArrow(_postings(n, threshold, shards, frequent, rank), "shard int, n int, blob binary")
    shared = cut(blobs.repartitionById(shards, F.col("shard")).mapInArrow(_shared, "shard int, n int, blob binary, grams long"), row_group=BLOB_ROW_GROUP)
    n_units = min(shards, max(LEAST_SHARDS, math.ceil(shared.agg(F.coalesce(F.sum("grams"), F.lit(0))).first()[0] / UNIT_POSTINGS)))
    reached = shared.select((F.col("shard") % n_units).alias("unit"), "n", "blob").repartitionById(n_units, F.col("unit")).mapInArrow(_merge(threshold, n_units), "a long, b long, excess int, missing int")
    candidates = cut(reached.groupBy("a", "b").agg(F.sum("excess").alias("excess"), F.max("missing").alias("missing")).where("excess >= missing").select("a", "b"))
    ends = candidates.select(F.explode(F.array(F.struct(F.col("a").alias("sid"), F.col("b").alias("other")), F.struct(F.col("b").alias("sid"), F.col("a").alias("other")))).alias("e")).select("e.*")
    # a document's leader is the least set hash among itself and its candidates: near copies of one text have the same
    leaders = ends.groupBy("sid").agg(F.min("other").alias("other")).select("sid", F.least("sid", "other").alias("leader"))
    one = cut(leaders.join(members.groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.count(F.lit(1)).alias("docs")), "sid"))
    n_one = one.count()
    wanted = one.select(F.col("doc_id").alias("w")).distinct()
    texts = semi_or_anti(base, wanted, F.col("doc_id") == F.col("w"), "left_semi", n_one)
    sets = texts.select("text").mapInArrow(_fetch(n), "sid long, grams binary")
    end = lambda c: one.select(F.col("sid").alias(c), F.col("leader").alias(f"l{c}"), F.col("n").alias(f"n{c}"))
    led = candidates.join(end("a"), "a").join(end("b"), "b").select(F.least("la", "lb").alias("leader"), "a", "b", "na", "nb")
    pairs = cut(_cells(led))
    places = pairs.select("cell", F.explode(F.array("a", "b")).alias("sid")).distinct()
    ids = one.select("sid", "docs")
    first = sets.join(F.broadcast(ids) if n_one <= BROADCAST_ROWS else ids, "sid").dropDuplicates(["sid"])
    placed = places.join(first, "sid").select("cell", F.col("sid").alias("a"), F.lit(None).cast("long").alias("b"), "docs", "grams")
    rows = placed.unionByName(pairs.select("cell", "a", "b", F.lit(None).cast("long").alias("docs"), F.lit(None).cast("binary").alias("grams")))
    rows = rows.repartition("cell").sortWithinPartitions("cell", F.col("b").isNotNull())
    return members, cut(rows.mapInArrow(_probe(threshold), "sid long, root long, links long"))


def _cells(led: DataFrame) -> DataFrame:
    """(cell, a, b): the cell in which each pair is probed, from (leader, a, b, na, nb).

    The pairs of one leader share a cell; those of one with many are spread over a grid of blocks of its documents, so that
    no cell has more than about CELL_PAIRS pairs or CELL_BYTES of sets.
    """
    docs = F.approx_count_distinct("a") + F.approx_count_distinct("b")
    load = led.groupBy(F.col("leader").alias("k")).agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.col("na") + F.col("nb")).alias("grams"), docs.alias("docs"))
    by_pairs = F.sqrt(2 * F.col("pairs") / F.lit(float(CELL_PAIRS)))
    by_bytes = 8 * F.col("docs") * F.col("grams") / F.lit(float(CELL_BYTES))  # a cell has two blocks
    load = load.select("k", F.greatest(F.lit(1), F.ceil(by_pairs), F.ceil(by_bytes)).cast("int").alias("blocks"))
    block = lambda c: F.pmod(F.xxhash64(c), F.col("blocks"))
    cell = F.xxhash64("leader", F.least(block("a"), block("b")), F.greatest(block("a"), block("b")))
    return led.join(load, F.col("leader") == F.col("k")).select(cell.alias("cell"), "a", "b")


def ngram_jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links): one row for each document.

    Two documents are linked if their n-gram sets have Jaccard similarity >= threshold; ``n_links`` counts the other documents that a document is
    linked with, ``class_id`` is the least doc_id of all that it is connected to by links. Neither needs a row for each pair: copies
    with one set are counted together, and links of different sets are counted in the cell that verifies them.

    A text of fewer than ``n`` words is one n-gram. A document without words (null, empty, blank, only punctuation) has no links and is its
    own class; rows with a null doc_id are left out. Repeated rows count once; a doc_id with several different texts has a row for each n-gram set,
    each counted as a document. Columns besides doc_id and text are ignored. An empty table gives an empty result.
    """
    members, linked = similar_sets(docs, n, threshold)
    roots = components(linked.select(F.col("root").alias("a"), F.col("sid").alias("b")))
    sets = members.groupBy("sid").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("least"))
    sets = sets.join(linked.groupBy("sid").agg(F.sum("links").alias("links")), "sid", "left").join(roots.withColumnRenamed("node", "sid"), "sid", "left")
    sets = sets.select("sid", "least", F.coalesce("root", "sid").alias("root"), (F.col("docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    classes = sets.groupBy("root").agg(F.min("least").alias("class_id"))
    found = members.join(sets.join(classes, "root").select("sid", "class_id", "n_links"), "sid").select("doc_id", "class_id", F.col("n_links").cast("int").alias("n_links"))
    ids = pick(docs, "doc_id").select(F.col("doc_id").cast("long")).where("doc_id is not null").distinct()
    alone = ids.join(members.select("doc_id").distinct(), "doc_id", "left_anti")
    return found.unionByName(alone.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).alias("n_links")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of ``edges`` (a, b); the root is the least node. Large-star and small-star steps until nothing changes.

    A node's least neighbour comes from an aggregate, combined before the shuffle, so that a node with very many neighbours isn't one task's group.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = lambda e: e.groupBy("a").agg(F.min("b").alias("m"))
    state = cut(edges.where("a <> b").select("a", "b").distinct())
    last = None
    while True:
        ends = both(state)
        large = ends.where("b > a").join(least(ends), "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        down = cut(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        small = down.join(least(down), "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        state = cut(small)
        now = tuple(state.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if now == last:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = now


def dropped_ids(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, sid): the documents that are not the least doc_id of their group of similar ones."""
    members, linked = similar_sets(docs, n, threshold)
    roots = components(linked.select(F.col("root").alias("a"), F.col("sid").alias("b")))
    of = members.join(roots, members["sid"] == roots["node"], "left").select("doc_id", "sid", F.coalesce("root", "sid").alias("root"))
    least = of.groupBy("root").agg(F.min(F.struct("doc_id", "sid")).alias("least"))
    return of.join(least, "root").where(F.struct("doc_id", "sid") != F.col("least")).select("doc_id", "sid")


def _sid(n: int):
    def of(batches):
        for batch in batches:
            sids = [set_hash(g) if len(g) else None for g in gram_sets(batch.column(0), n)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sids, pa.int64())], names=[*batch.schema.names, "sid"])

    return of


def keep_one_of_each_group(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without near copies: of every connected group of similar documents the one with the least doc_id stays.

    All columns stay as they are. Rows without words or without doc_id stay. Repeated rows (same doc_id, same n-grams) leave one.
    """
    gone = cut(dropped_ids(docs, n, threshold))
    base = pick(docs, "doc_id", "text")
    repeated = base.where(F.col("text").rlike(r"\w") & F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").limit(1).count()
    plain = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    names = {c: f"_{docs.columns.index(c)}" for c in ("doc_id", "text")}
    n_gone = gone.count()
    if not repeated:  # then doc_id alone names a document
        key = gone.select(F.col("doc_id").alias("gone_id")).distinct()
        left = semi_or_anti(plain, key, F.col(names["doc_id"]).cast("long") == F.col("gone_id"), "left_anti", n_gone)
        return left.toDF(*docs.columns)
    types = ", ".join(f"`{c}` {t}" for c, t in [(names["text"], dict(plain.dtypes)[names["text"]])] + [(c, t) for c, t in plain.dtypes if c != names["text"]])
    order = [names["text"], *[c for c in plain.columns if c != names["text"]]]
    marked = plain.select(order).mapInArrow(_sid(n), types + ", sid long")
    key = gone.select(F.col("doc_id").alias("gone_id"), F.col("sid").alias("gone_sid")).distinct()
    left = semi_or_anti(marked, key, (F.col(names["doc_id"]).cast("long") == F.col("gone_id")) & (F.col("sid") == F.col("gone_sid")), "left_anti", n_gone)
    bare = F.col("sid").isNull() | F.col(names["doc_id"]).isNull()
    once = left.where(~bare).dropDuplicates([names["doc_id"], "sid"]).unionByName(left.where(bare))
    return once.select(plain.columns).toDF(*docs.columns)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(list_transform(string_split_regex(lower(text), '\s+'), lambda x: regexp_replace(x, '[^\p{{L}}\p{{N}}]', '', 'g')), lambda x: x <> '') AS w
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
sets AS (
  SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= {N} THEN list_transform(range(1, len(w) - {N - 2}), lambda i: array_to_string(w[i:i + {N - 1}], ' ')) ELSE [array_to_string(w, ' ')] END)) AS g
  FROM words WHERE len(w) > 0),
lists AS (SELECT min(doc_id) AS k, count(*) AS docs, len(g) AS n, g FROM sets GROUP BY g),
postings AS (SELECT k, n, docs, unnest(g) AS gram FROM lists),
pairs AS (
  SELECT a.k AS ka, b.k AS kb, any_value(a.n) AS na, any_value(b.n) AS nb, any_value(b.docs) AS docs, count(*) AS o
  FROM postings a JOIN postings b ON a.gram = b.gram AND a.k <> b.k GROUP BY a.k, b.k),
linked AS (SELECT ka, kb, docs FROM pairs WHERE CAST(o AS DOUBLE) / (na + nb - o) >= {THRESHOLD}),
reach AS (SELECT k, k AS other FROM lists UNION SELECT r.k, l.kb FROM reach r JOIN linked l ON l.ka = r.other),
classes AS (SELECT k, min(other) AS class_id FROM reach GROUP BY k),
counts AS (SELECT ka, sum(docs) AS links FROM linked GROUP BY ka),
found AS (
  SELECT s.doc_id, c.class_id, CAST(l.docs - 1 + coalesce(x.links, 0) AS INTEGER) AS n_links
  FROM sets s JOIN lists l ON l.g = s.g JOIN classes c ON c.k = l.k LEFT JOIN counts x ON x.ka = l.k)
SELECT doc_id, class_id, n_links FROM found
UNION ALL
SELECT DISTINCT doc_id, doc_id, 0 FROM documents WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM found)
"""
